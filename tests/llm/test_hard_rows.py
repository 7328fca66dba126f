"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: every operator and every stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opsloom.llm import decontaminate, exact_dedup, language_mix, near_dedup, quality_knn, secret_markov, sentence_sampling, substring_dedup, toxicity_cnn, url_rules

WORDS = " ".join(f"w{i % 977}" for i in range(200_000))  # about a megabyte
SHORT = "the quick brown fox jumps over the lazy dog and then runs away from all of it"
ROWS = [(1, SHORT), (1, SHORT), (2, SHORT), (3, None), (4, ""), (5, WORDS), (6, "\n \t"), (7, "één \U0001f600 中文"), (8, "=" * 1_000_000), (None, SHORT + " x"), (None, None), (9, "one two three")]
CLASHES = ["_id", "id", "kept", "keep_id", "kept_id", "kept_hash", "score", "spans", "items", "best", "hit", "node", "shard", "component_id", "bench_hit", "quality_score", "toxicity", "h", "base", "tokens", "row", "_Kept_id"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return d.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES[:-1]])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(1, 0, 1), (None, 1, None), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", "one two three"), ("b", None), ("c", ""), ("a", "one two three")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def operators(spark, folder):
    labels, benchmark = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    return {
        "near": near_dedup.near_duplicates, "exact": exact_dedup.exact_duplicates, "repeats": substring_dedup.remove_repeats, "secrets": secret_markov.find_secrets, "leaks": lambda d: decontaminate.find_benchmark(d, benchmark),
        "languages": lambda d: language_mix.identify_languages(d, language_mix.learn_languages(d.withColumn("lang", F.lit("xx")))), "quality": lambda d: quality_knn.score_quality(d, quality_knn.quality_model(d.select("doc_id", "text"), labels), score_col="score"),
        "toxicity": lambda d: toxicity_cnn.score_toxicity(d, toxicity_cnn.learn_toxicity(d.select("doc_id", "text"), labels), score_col="score"), "pieces": lambda d: sentence_sampling.sample_segmentations(d, packed=True, checked=True),
        "urls": lambda d: url_rules.judge_urls(d, spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string"), "doc_id", "text"),
    }


NAMES = ["near", "exact", "repeats", "secrets", "leaks", "languages", "quality", "toxicity", "pieces", "urls"]


@pytest.mark.parametrize("name", NAMES)
def test_operator_on_hard_rows(spark, folder, docs, name):
    """One row for each input row (two for a text with segmentations), each identifier as often as it comes in; none for an empty table."""
    run = operators(spark, folder)[name]
    rows = run(docs).collect()
    ids = sorted((r["doc_id"] for r in rows), key=repr)
    if name == "pieces":
        assert set(ids) == {d for d, _ in ROWS} and all(r.exact for r in rows)
    else:
        assert ids == sorted((d for d, _ in ROWS), key=repr)
    assert run(docs.limit(0)).count() == 0


def test_ties_and_repeats_have_their_results(spark, folder, docs):
    ops = operators(spark, folder)
    near = [(r.doc_id, r.component_id, r.kept) for r in ops["near"](docs).collect() if r.doc_id in (1, 2)]
    assert sorted(near) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    exact = {(r.doc_id, r.keep_id, r.group_size) for r in ops["exact"](docs).collect()}
    assert {(1, 1, 3), (2, 1, 3), (3, 3, 3), (4, 3, 3), (None, 3, 3)} <= exact
    for name in ("quality", "toxicity"):
        scores = {r.doc_id: r.score for r in ops[name](docs).collect()}
        assert scores[1] == scores[2] and scores[3] == scores[4]
    for name in ("quality", "leaks", "toxicity"):
        out = ops[name](docs)
        replaced = {"quality": {"score"}, "toxicity": {"score"}, "leaks": {"bench_hit"}}[name]
        row = out.where("doc_id = 9").first()
        assert all(row[c] == f"own {c}" for c in CLASHES[:-1] if c not in replaced)
    found = {r.doc_id: (r.bench_hit, r.bench_items) for r in ops["leaks"](docs).collect()}
    assert found[9] == (3, ["a"]) and found[3] == (0, []) and found[None] == (0, [])


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_on_hard_rows(spark, folder, docs, k):
    """A stage gives back rows as they were, with all their columns, and nothing for an empty table."""
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    rows = out.collect()
    assert stage(spark, docs.limit(0), folder).count() == 0
    if k == len(corpus_pipeline.STAGES) - 1:
        assert {r.doc_id for r in rows} == {d for d, _ in ROWS}
        return
    assert out.columns == docs.columns
    whole = [tuple(r) for r in docs.collect()]
    assert all(tuple(r) in whole for r in rows)
    kept = sorted((r.doc_id for r in rows), key=repr)
    want = {"exact_dedup": [1, 1, 3, 5, 6, 7, 8, 9, None], "near_dedup": [1, 1, 3, 4, 5, 6, 7, 8, 9, None], "decontamination": [1, 1, 2, 3, 4, 5, 6, 7, 8, None, None]}.get(name)
    if name == "near_dedup":  # the null row with a text is a near copy of row 1, the one without stays
        assert kept == sorted(want, key=repr)
    elif want:
        assert kept == sorted(want, key=repr)


def test_pipeline_on_an_empty_table(spark, folder, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
