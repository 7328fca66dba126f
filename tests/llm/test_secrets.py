"""Secret spans against Python: the fixed patterns' digests, and tokens that the models add."""

import hashlib
import random
import re
import string

import pytest

from pyspark.sql import functions as F

from opsloom.llm import queries, secret_markov

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_base_digests_like_python(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    n_spans = 0
    for r in queries.queries()["op4_secret_scans"](spark, SF).collect():
        want = base(texts[r.doc_id])
        n_spans += len(want)
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert set(filter(None, written(want).split(","))) <= set(r.spans.split(","))
    assert n_spans > 20


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    made = [("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32)), True) for _ in range(400)]
    words = {w for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for w in re.findall(secret_markov.TOKEN, t or "")}
    ordinary = ["configuration_value", "someVariableName", "internationalization", "read_next_record", "getElementById"]
    return spark.createDataFrame(made + [(w, False) for w in [*sorted(words), *ordinary]], "value string, random boolean").cache()


def test_planted_tokens_are_added(spark, samples):
    """Random tokens with and without digits are found where they are; ordinary words, identifiers and base spans aren't."""
    rng = random.Random(2)
    letters = ["".join(rng.choice(string.ascii_letters) for _ in range(n)) for n in (18, 24, 40) * 5]
    digits = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (18, 24, 40) * 5]
    docs = [(i, f"é \U0001f600 word {t}, andere understanding") for i, t in enumerate(letters + digits)]
    docs += [(100, "someVariableName configuration_value internationalization"), (101, "password=" + letters[1]), (102, None), (103, "")]
    got = {r.doc_id: r for r in secret_markov.find_secrets(spark.createDataFrame(docs, "doc_id long, text string"), samples).collect()}
    for i, t in enumerate(letters + digits):
        assert [(s.start, s.end, s.value, s.kind) for s in got[i].added] == [(9, 9 + len(t), t, "markov")]
    assert got[100].added == [] and got[101].added == [] and len(got[101].base) == 1 and got[102].base == got[103].added == []


def test_long_runs_and_many_hits(spark, samples):
    rng = random.Random(3)
    many = [("".join(rng.choice("0123456789abcdef") for _ in range(30))) for _ in range(3000)]
    tokens = ["".join(rng.choice(string.ascii_letters) for _ in range(26)) for _ in range(600)]
    docs = [(1, "=" * 1_000_000), (2, " ".join(many)), (3, " ".join(tokens)), (4, "a" * 200_000), (5, "token " * 50_000)]
    got = {r.doc_id: r for r in secret_markov.find_secrets(spark.createDataFrame(docs, "doc_id long, text string"), samples).collect()}
    assert [(s.start, s.end) for s in got[2].base] == [(31 * i, 31 * i + 30) for i in range(3000)] and got[2].added == []
    at = [(27 * i, 27 * i + 26) for i in range(600)]
    added = [(s.start, s.end) for s in got[3].added]
    assert set(added) <= set(at) and len(added) > 590 and added == sorted(added)
    assert got[4].base and got[1].base == got[5].base == []


def test_without_samples_nothing_is_added(spark):
    none = spark.createDataFrame([], "value string, random boolean")
    docs = spark.createDataFrame([(1, "password: abcdefgh"), (1, "password: abcdefgh")], "doc_id long, text string")
    rows = secret_markov.find_secrets(docs, none).collect()
    assert len(rows) == 2 and all(len(r.base) == 1 and r.added == [] for r in rows)


def test_samples_are_of_all_documents(spark):
    docs = spark.range(4500).select(F.col("id").alias("doc_id"), F.concat(F.lit("ordinary_token_"), F.col("id"), F.lit(" secret=value"), F.col("id")).alias("text"))
    n = {r["random"]: r["count"] for r in secret_markov.labelled_samples(docs).groupBy("random").count().collect()}
    assert n == {True: 4500, False: 4500}
