"""Hashed vectors and blended ranking against plain Python, tickets, technologies."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opsloom.operators import search, stacks, vectors
from opsloom.sources.observations import MINUTE


def plain(text):
    v = [0.0] * 256
    words = re.findall("[0-9a-zçğıöşü_./-]+", (text or "").lower())
    features = words + [words[i] + " " + words[i + 1] for i in range(len(words) - 1)]
    for w in words:
        features += [w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 3 else []
    for f in features:
        h = int(hashlib.blake2b(f.encode(), digest_size=4).hexdigest(), 16)
        v[h % 256] += 1 if h >= 1 << 31 else -1
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


TEXTS = ["Disk full on db-01: vacuum failed", "payment timeout şifre çok uzun", "", None, "disk full", "timeout while reading from payment gateway", "restart of the web tier", "db-01 disk disk disk"]


def test_vectors_equal_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "lesson_id long, text string").repartition(3)
    for r in vectors.with_vectors(df).collect():
        assert r.vector == pytest.approx(plain(r.text), abs=1e-6)


def test_blended_ranking_equals_scoring_all_pairs(spark):
    rnd = random.Random(1)
    words = "disk full timeout payment gateway restart web tier error slow memory leak".split()
    lessons = [(i, rnd.choice(["", "disk full", "a payment timeout again"]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9))), rnd.randrange(1, 9)) for i in range(80)]
    queries = [("q1", "disk full"), ("q2", "payment timeout at gateway"), ("q3", "unrelated"), ("q4", " "), ("q5", None)]
    token = lambda t: set(re.findall(r"[a-z][a-z0-9_\-]{2,}", t.lower())) - set(search.PLAIN_TOKENS)
    want = []
    for q, text in queries[:3]:
        scored = []
        for i, title, body, seen in lessons:
            a, b = token(text), token(f"{title} {body}")
            common = len(a & b)
            lex = 0.7 * common / len(a) + 0.3 * common / len(a | b) if common else 0.0
            lex = max(lex, 0.6) if text.lower() in title.lower() else lex
            cosine = sum(x * y for x, y in zip(plain(text), plain(body)))
            score = round(0.75 * lex + 0.25 * max(0.0, cosine - 0.1) + min(0.1, 0.02 * (seen - 1)), 4)
            if score > 0.02:
                scored.append((-score, i))
        want += [(q, i, -s, k) for k, (s, i) in enumerate(sorted(scored)[:6], 1)]
    df = vectors.with_vectors(spark.createDataFrame(lessons, "lesson_id long, title string, text string, occurrences int"))
    got = vectors.ranked_lessons(spark.createDataFrame(queries, "query_id string, query string"), df.repartition(4)).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.place) for r in got] == [(q, k) for q, _, _, k in want]
    assert [r.score for r in got] == pytest.approx([s for _, _, s, _ in want], abs=2e-4)


def test_a_task_holds_a_block_of_scores_however_large_its_batches(monkeypatch):
    rnd = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    asked = [{"query_id": i, "query": " ".join(q), "t": q} for i, q in enumerate(rnd.sample(words, 3) for _ in range(200))]
    texts = [rnd.sample(words, 4) for _ in range(4000)]
    vs = np.array([vectors.vector(" ".join(t)) for t in texts], np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array([""] * 4000), pa.array(texts), pa.array([i % 3 for i in range(4000)]), pa.ListArray.from_arrays(pa.array(np.arange(4001) * 256, pa.int32()), pa.array(vs.reshape(-1)))], names=["lesson_id", "title", "t", "occurrences", "vector"])
    arrow = [pa.int64(), pa.int64(), pa.float64()]
    tracemalloc.start()
    found = list(vectors.finder(asked, arrow, 6)(iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Six tables of 4000 by 200 scores would be 38 MB.
    assert peak < 20_000_000 and len(found) == 1 and found[0].num_rows == 1200
    monkeypatch.setattr(vectors, "BLOCK_SCORES", 200 * 4000)
    assert found[0].equals(next(vectors.finder(asked, arrow, 6)(iter([batch]))))
    assert list(vectors.finder([], arrow, 6)(iter([batch]))) == []


def test_tickets_count_time_without_related_items(spark):
    m = MINUTE
    signals = spark.createDataFrame([("f1", "lock wait exceeded on table", "billing", "db-1", 100 * m), ("f2", "cache miss", "shop", "web-1", 300 * m)], "fingerprint string, template string, service string, host string, onset_us long")
    rows = [(1, "nothing known", 95 * m), (2, "nothing known", 200 * m), (3, "nothing known", 990 * m), (4, "billing is slow", 310 * m), (5, "lock wait exceeded again", 100 * m), (6, "cpu of something", 200 * m), (7, "all of orders hang", 405 * m), (8, None, None)]
    breaches = spark.createDataFrame([("cpu", "web-9")], "metric string, host string")
    incidents = spark.createDataFrame([("I1", "orders", 400 * m)], "incident string, name string, onset_us long")
    got = {r.ticket_id: (r.relevance, r.related, r.near) for r in search.tickets(spark.createDataFrame(rows, "ticket_id long, text string, us long"), signals, 30, 1000 * m, breaches, incidents).collect()}
    assert got == {1: (0.35, 0, True), 2: (0.0, 0, False), 3: (0.18, 0, False), 4: (0.39, 1, False), 5: (0.64, 1, True), 6: (0.45, 1, False), 7: (0.87, 1, True), 8: (0.0, 0, False)}


def test_technologies_by_evidence(spark):
    evidence = [("h", "nginx", "port", None), ("h", "nginx", "port", None), ("h", "nginx", "process", "1.2"), ("h", "flask", "log", None), ("h", "django", "log", None), ("h", "pg", "banner", "16"), ("h", "mysql", "port", None), ("h", "x", "rumour", None), ("g", "openresty", "agent", None), ("g", "nginx", "process", None)]
    c = stacks.attributed(spark.createDataFrame(evidence, "host string, key string, source string, version string"))
    assert {(r.host, r.key): (r.weight, r.sources, r.confidence, r.version) for r in c.collect()} == {("h", "nginx"): (3, 2, "high", "1.2"), ("h", "flask"): (2, 1, "possible", None), ("h", "django"): (2, 1, "possible", None), ("h", "pg"): (3, 1, "certain", "16"), ("h", "mysql"): (1, 1, "possible", None), ("g", "openresty"): (3, 1, "certain", None), ("g", "nginx"): (2, 1, "possible", None)}
    t = spark.createDataFrame([("nginx", "nginx", "web", 0), ("openresty", "OpenResty", "web", 0), ("flask", "Flask", "app", 1), ("django", "Django", "app", 1), ("pg", "PostgreSQL", "db", 2), ("mysql", "MySQL", "db", 2)], "key string, name string, layer string, role_rank int")
    gone = spark.createDataFrame([("openresty", "nginx")], "key string, replaces string")
    assert {(r.host, r.layer, r.place, r.key) for r in stacks.host_stacks(c, t, gone).collect()} == {("h", "web", 1, "nginx"), ("h", "app", 1, "django"), ("h", "app", 2, "flask"), ("h", "db", 1, "pg"), ("h", "db", 2, "mysql"), ("g", "web", 1, "openresty")}
    assert {(r.host, r.key) for r in stacks.named(c, t, gone).collect()} == {("h", "nginx"), ("h", "pg"), ("g", "openresty")}
