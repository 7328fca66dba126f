"""Rules that are easy to lose: scrubbing beside letters, clocks, pools, parents."""

from pyspark.sql import functions as F

from opsloom.functions import stamps, text
from opsloom.operators import rollups, traces
from opsloom.sources.observations import MINUTE, repair_clock


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scrub_also_beside_letters(spark):
    assert one(spark, text.scrub(F.lit("id10000000146x and 10000000146"))) == "id[TCKN]x and [TCKN]"
    assert one(spark, text.scrub(F.lit("id12345678901x"))) == "id12345678901x"


def test_clocks(spark):
    arrival = 1_700_000_000_000_000
    r = lambda ahead: one(spark, repair_clock(F.lit(arrival + ahead), F.lit(arrival)))
    assert r(10 * MINUTE) == arrival + 10 * MINUTE and r(-400 * 1440 * MINUTE) == arrival - 400 * 1440 * MINUTE
    assert r(180 * MINUTE - 60_000_000) == arrival - 60_000_000 and r(20 * MINUTE) == arrival + 20 * MINUTE and r(2 * 1440 * MINUTE) == arrival
    assert one(spark, repair_clock(F.lit(None).cast("bigint"), F.lit(arrival))) == arrival


def test_pools_leave_silent_hosts_out(spark):
    rows = [("a1", "a", 10, 0, False), ("a2", "a", 10, 1, False), ("a3", "a", 10, 0, False), ("a4", "a", 1000, 5, True), ("b1", "b", 1, 0, False), ("b2", "b", 100, 0, False)]
    got = {r.pool: (r.outliers, r.worst, r.silent) for r in rollups.pools(spark.createDataFrame(rows, "host string, pool string, lines long, errors long, silent boolean")).collect()}
    assert got == {"a": (0, "a4", 1), "b": (0, None, 0)}


def test_parents(spark):
    """Explicit first; a call outwards may lie in a span of its own service; a log encloses nothing."""
    rows = [(1, 1, "web", "server", 0.0, 100.0, None), (1, 2, "web", "client", 10.0, 50.0, None), (1, 3, "db", "db", 12.0, 10.0, None), (1, 4, "x", "log", 0.0, 100.0, None), (1, 5, "y", "server", 90.0, 5.0, 3), (1, 6, "web", "internal", 20.0, 1.0, None), (1, 7, "z", "server", 0.0, 100.0, 99)]
    s = spark.createDataFrame(rows, "trace_id long, span_id long, service string, kind string, start_ms double, duration_ms double, parent_ref long").withColumn("error", F.lit(False))
    got = {r.span_id: (r.parent_id, r.inferred) for r in traces.parents(s).collect()}
    assert got[1] == (None, False) and got[2] == (7, True) and got[3] == (2, True) and got[5] == (3, False) and got[7] == (1, True)
    assert got[6] == (3, True)  # spans 1 and 2 are of its own service


def test_stamps_that_are_none(spark):
    for value in ("soon", "", "99/99/2024 10:00:00", "2024-13-01 00:00:00"):
        assert one(spark, stamps.micros_of(F.lit(value), 2024)) is None
    assert one(spark, stamps.micros_of(F.lit("Jan  2 03:04:05"), 2023)) == 1_672_628_645_000_000


def test_flattened_records_keep_the_first_key_and_texts(spark):
    flat = lambda t: one(spark, text.flatten_json(F.lit(t)))
    assert flat('{"a":{"b":1},"a.b":2,"c":"{x"}') == {"a.b": "1", "c": "{x"}
    assert flat('{"a":{"b":{"c":{"d":1}}}}') == {"a.b.c": '{"d":1}'} and flat("[1]") is None and flat("{}") == {}


def test_records_whose_keys_differ_in_case_only(spark):
    from opsloom.sources import ingest

    rows = ingest.canonical(spark.createDataFrame([('{"Host":"a","host":"b","message":"m"}',), ("no json",)], "value string"), 2024).collect()
    assert (rows[0].host, rows[0].message) == ("a", "m") and rows[1].host is None


def test_broken_archives_are_a_row(spark, tmp_path):
    from opsloom.sources import ingest

    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    (tmp_path / "cut.gz").write_bytes(b"\x1f\x8b\x08\x00")
    (tmp_path / "fine.log").write_text("one\ntwo\n")
    rows = {(r.source.rsplit("/", 1)[-1], r.line_no): (r.value, bool(r.error)) for r in ingest.read_lines(spark, str(tmp_path)).collect()}
    assert rows == {("bad.zip", 0): (None, True), ("cut.gz", 0): (None, True), ("fine.log", 1): ("one", False), ("fine.log", 2): ("two", False)}
