"""The similarity search over several blocks against brute force, and its whole query set."""

import numpy as np
from pyspark.sql import functions as F

from opsloom.operators import traces
from opsloom.plans import queries

SF = "/root/testdata/sf0.01"


def test_blocks_give_what_brute_force_gives(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)] + [(i, [1.0] * 6) for i in range(90, 110)] + [(110, [0.0] * 6), (111, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r.query_id, r.place): (r.vec_id, r.cosine) for r in traces.nearest(v, q, 4, vector_block=16, query_block=7).collect()}
    m = np.array([x or [0.0] * 6 for _, x in rows])
    size = np.sqrt((m * m).sum(1))
    want = {}
    for a in range(0, 112, 5):
        c = [round(float(m[a] @ m[b] / (size[a] * size[b])), 6) if size[a] * size[b] > 0 else 0.0 for b in range(112)]
        best = sorted((b for b in range(112) if b != a), key=lambda b: (-c[b], b))[:4]
        want |= {(a, k + 1): (b, c[b]) for k, b in enumerate(best)}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-9 for x in want)


def test_query_set_grows_with_the_table(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r.query_id for r in queries()["nearest_vectors"](spark, SF).select("query_id").distinct().collect()} == ids
