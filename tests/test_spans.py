"""Spans out of lines, tail sampling as table and stream, depths in long chains and circles."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from opsloom.functions import text
from opsloom.operators import spans, traces

OBS = "seq long, us long, message string, severity string, service string, host string, environment string, attributes map<string,string>"
T0 = datetime(2024, 1, 1, tzinfo=UTC)


def told(spark, *rows):
    """Each row is (message, attributes, and others by name)."""
    full = [(i, 1_700_000_000_000_000, m, o.get("severity", "INFO"), o.get("service", "web"), o.get("host", "h1"), "prod", a) for i, (m, a, o) in enumerate(rows)]
    return {r.seq: r for r in spans.spans_of_lines(spark.createDataFrame(full, OBS), b"k").collect()}


def test_rules_of_spans(spark):
    hexes = "00-" + "ab" * 16 + "-" + "cd" * 8 + "-01"
    r = told(
        spark,
        ("nothing here", None, {}),
        ("took 15 ms", {"x": "1"}, {}),
        ("GET /a/12345?q=1 took 15.5 ms", {}, {}),
        ("hello", {"DURATION": "2s", "Trace_Id": "t1", "status": "503"}, {}),
        (f"call {hexes} done", {"rt": "7", "kind": "PRODUCER", "http.status_code": "abc"}, {"severity": "CRITICAL"}),
        ("x trace_id=abcdef99 y", {"took": "-5"}, {"service": "-", "host": ""}),
        ("select a from b", {"request_id": "q1", "user": "Anna", "sid": "s9"}, {"service": "http"}),
        ("LOGIN_ERROR", {"clientId": "shop", "SessionId": "z", "userId": "u"}, {}),
        ("x", {"elapsed": "90000000"}, {}),
        (None, {"latency_s": "oops", "duration": "0.25", "target": "y", "s-sitename": "site"}, {"service": None}),
    )
    assert set(r) == {2, 3, 4, 5, 6, 7, 8, 9}
    assert (r[2].operation, r[2].kind, r[2].duration_ms, r[2].trace_id, r[2].link) == ("GET /a/{id}", "server", 15.5, None, "none")
    assert (r[3].duration_ms, r[3].trace_id, r[3].status, r[3].error, r[3].kind) == (2000.0, "t1", 503, True, "internal")
    assert (r[4].trace_id, r[4].parent_id, r[4].kind, r[4].status, r[4].error, r[4].duration_ms) == ("ab" * 16, "cd" * 8, "producer", 0, True, 7000.0)
    assert (r[5].trace_id, r[5].has_duration, r[5].kind, r[5].service) == ("abcdef99", False, "log", "http")
    assert (r[6].kind, r[6].user_ref, r[6].session_id, r[6].service, r[6].operation) == ("db", spark.range(1).select(text.pseudonym(F.lit("Anna"), b"k")).first()[0], "s9", "h1", "select a from b")
    assert (r[7].kind, r[7].operation, r[7].error, r[7].session_id, r[7].link, r[7].trace_id) == ("user", "sso login_error → shop", True, "sso:z", "session", None)
    assert (r[8].has_duration, r[8].duration_ms) == (False, 0.0)
    assert (r[9].duration_ms, r[9].kind, r[9].service) == (250.0, "client", "site")


SPAN = "trace_id string, span_id long, ts timestamp, duration_ms double, error boolean, kind string, claims boolean"


def test_claims_take_what_was_held_and_slow_spans_stay_alone(spark, streamed):
    at = lambda s: T0 + timedelta(seconds=s)
    # Traces whose hash is outside the share that is always kept.
    a, b, c = [r.t for r in spark.range(200).select(F.concat(F.lit("tr"), "id").alias("t")).where(~spans.by_hash(F.col("t"), 10)).orderBy("t").limit(3).collect()]
    rows = [(a, 1, at(0), 5.0, False, "server", False), (a, 2, at(100), 5.0, False, "server", False), (a, 3, at(150), 5.0, True, "server", True), (a, 4, at(160), 5.0, False, "server", False)]
    rows += [(b, 5, at(10), 5.0, False, "server", False), (b, 6, at(20), 5000.0, False, "server", False), (b, 7, at(30), 1.0, False, "user", False), (c, 8, at(200), 1.0, False, "server", False)]
    df = spark.createDataFrame(rows, SPAN)
    table = spans.kept(df.withColumn("us", F.unix_micros("ts")), 10, 1000, F.col("claims"), "us", 120_000_000)
    assert sorted(r.span_id for r in table.collect()) == [2, 3, 4, 6, 7]
    live = streamed(df, lambda s: spans.kept_stream(s, 10, 1000), "kept", parts=2, by="ts")
    assert sorted(r.span_id for r in live.collect()) == [2, 3, 4, 6, 7]


def test_depths_of_chains_and_circles(spark):
    chain = [("t", i, i - 1 if i else None) for i in range(40)]
    circle = [("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("c", 4, 3), ("c", 5, 4), ("c", 6, None), ("c", 7, 6)]
    df = spark.createDataFrame(chain + circle, "trace_id string, span_id long, parent_id long")
    got = {(r.trace_id, r.span_id): r.depth for r in traces.depths(df).collect()}
    assert [got["t", i] for i in range(40)] == list(range(40))
    assert [got["c", i] for i in range(1, 8)] == [3, 3, 3, 4, 5, 0, 1]
    assert traces.depths(df.limit(0)).count() == 0


def test_merged_rollups_add_histograms(spark):
    row = (1, "s", "op", "server", "prod", 2, 1, 7.5, 5.0, [1, 0, 1] + [0] * 20)
    df = spark.createDataFrame([row], "bar long, service string, operation string, kind string, environment string, calls long, errors long, total_ms double, max_ms double, h array<long>")
    out = spans.merge_rollups(df, df.withColumn("max_ms", F.lit(9.0))).first()
    assert (out.calls, out.errors, out.total_ms, out.max_ms, out.h[:3]) == (4, 2, 15.0, 9.0, [2, 0, 2])
