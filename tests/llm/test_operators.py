"""The corpus operators on hard small tables, against SQL or brute force, and their held-out accuracy."""

import duckdb
import pytest
from pyspark.sql import functions as F

from opsloom.llm import near_dedup, queries
from opsloom.llm.queries import oracle_sql
from opsloom.llm.sentence_sampling import decode_segmentations, sample_segmentations

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i}" for i in range(3000))
NEAR = [f"v{i}" for i in range(100)]
DOCS = [
    (1, None), (2, ""), (3, "   "), (4, "one two"), (5, "one  two"), (6, "ONE two"), (7, LONG), (8, LONG), (9, LONG + " end"),
    (10, " ".join(NEAR)), (11, " ".join([*NEAR[:50], "changed", *NEAR[51:]])), (12, "the quick brown fox jumps over the lazy dog and then runs away"),
    (13, "x the quick brown fox jumps over the lazy dog and y"), (14, "!!!"), (15, "été \U0001f600 中文"), (16, "one two"), (17, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit(7).alias("_id"), F.lit("z").alias("kept")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("b1", DOCS[11][1]), ("b2", "lazy dog"), ("b3", None), ("b4", "")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 18)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    urls = [None, "", "x", "http://A.Example.com/en/x?q", "http://www.example.com/en/", "https://net", "https://a.net/es/1#f", "http://b.org", "://c.com/"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    df = queries.queries()[name](spark, tables)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_whole_and_empty_tables(spark, tables, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0
    rows = queries.queries()[name](spark, tables).collect()
    key = "page_id" if name == "op6_url_filters" else "doc_id"
    assert {r[key] for r in rows} == ({r[0] for r in DOCS} if key == "doc_id" else set(range(9)))


def test_segmentations_decode_and_differ(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    enc = sample_segmentations(docs, samples=3)
    dec = {(r.doc_id, r["sample"]): r.text for r in decode_segmentations(enc).collect()}
    text = dict(DOCS)
    assert all((text[d] or "") == t for (d, _), t in dec.items())
    rows = enc.collect()
    assert len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)
    again = {(r.doc_id, r["sample"]): tuple(r.ids) for r in sample_segmentations(docs.repartition(3), samples=3).collect()}
    assert again == {(r.doc_id, r["sample"]): tuple(r.ids) for r in rows}


def test_crowd_of_near_copies_is_one_component(spark):
    """More members under a key than all pairs are made of, linked in a chain of small changes."""
    base = [f"t{i}" for i in range(200)]
    docs = spark.createDataFrame([(k, " ".join([*base, f"own{k}"])) for k in range(80)], "doc_id long, text string")
    out = near_dedup.near_duplicates(docs).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL").select("doc_id", "lang")
    j = queries.queries()["op3_language_id"](spark, SF).where("held_out AND lang_pred <> 'und'").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in j) / len(j) >= 0.9
