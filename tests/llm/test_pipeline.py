"""Each stage of the pipeline against brute force over what its predecessor kept."""

import corpus_pipeline as cp
from opsloom.llm.decontaminate import ORACLE_SQL as LEAKS
from opsloom.llm.exact_dedup import ORACLE_SQL as COPIES
from opsloom.llm.near_dedup import ORACLE_SQL as NEAR

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        con = duckdb.connect()
        if k:
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{k - 1}/*.parquet')")
            con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
        rule = {"exact_dedup": (COPIES, "kept"), "near_dedup": (NEAR, "kept"), "decontamination": (LEAKS, "NOT contaminated")}.get(name)
        if rule:
            want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({rule[0]}) WHERE {rule[1]}").fetchall()}
            assert {r.doc_id for r in out.collect()} == want
        if k < len(cp.STAGES) - 1:
            assert out.columns == names
        else:
            rows = out.collect()
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and all(r.exact for r in rows)
        docs = out
