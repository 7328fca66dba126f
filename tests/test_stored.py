"""Stored counters: repeated batches, late lines, generations, retention, upserts; and the impact search."""

from pyspark.sql import functions as F

from opsloom.operators import impact
from opsloom.sources.observations import MINUTE
from opsloom.streaming import stored

DAY0 = 19_700  # days since 1970
LINE = "us long, environment string, host string, service string, severity string, message string"


def lines(spark, *rows):
    return spark.createDataFrame([((DAY0 + d) * stored.DAY_US + m * MINUTE, "prod", h, "s", sev, f"took {ms} ms") for d, m, h, sev, ms in rows], LINE)


def totals(spark, path, **span):
    return {(r.minute - DAY0 * 1440, r.host): (r.lines, r.errors, sum(r.h)) for r in stored.read_counters(spark, path, **span).collect()}


def test_repeated_batches_change_nothing_and_late_lines_add(spark, tmp_path):
    path = str(tmp_path)
    assert totals(spark, path) == {} and stored.compact(spark, path, 0) == -1
    first, second = lines(spark, (0, 5, "a", "INFO", 3), (0, 5, "a", "ERROR", 900), (1, 7, "b", "INFO", 1)), lines(spark, (0, 5, "a", "INFO", 8))
    for _ in range(3):
        stored.add_batch(first, 0, path)
    stored.add_batch(second, 1, path)
    want = {(5, "a"): (3, 1, 3), (1447, "b"): (1, 0, 1)}
    assert totals(spark, path) == want
    now = (DAY0 + 1) * stored.DAY_US
    assert stored.compact(spark, path, now) == 0 and totals(spark, path) == want
    # A batch that is in the generation comes once more, and one that is not.
    stored.add_batch(second, 1, path)
    stored.add_batch(lines(spark, (0, 5, "a", "CRITICAL", 8)), 2, path)
    want[5, "a"] = (4, 2, 4)
    assert totals(spark, path) == want
    assert totals(spark, path, since_us=DAY0 * stored.DAY_US + 1440 * MINUTE) == {(1447, "b"): (1, 0, 1)} and totals(spark, path, until_us=DAY0 * stored.DAY_US + 6 * MINUTE) == {(5, "a"): (4, 2, 4)}
    assert stored.compact(spark, path, now + 400 * stored.DAY_US) == 1 and totals(spark, path) == {(1447, "b"): (1, 0, 1)}
    # A generation without its marker doesn't count.
    stored.counters(first).write.parquet(f"{path}/generations/generation=2")
    assert totals(spark, path) == {(1447, "b"): (1, 0, 1)}
    row = stored.host_figures(stored.read_counters(spark, path)).first()
    assert (row.host, row.lines, row.error_rate) == ("b", 1, 0.0)


def test_a_stream_into_stored_counters(spark, tmp_path):
    rows = lines(spark, *[(0, i % 3, "a", "INFO", i) for i in range(30)])
    for k in range(3):
        rows.where(F.col("us") % 3 >= 0).sample(1.0).write.parquet(f"{tmp_path}/in/{k}")
    for _ in range(2):  # the second run finds nothing new
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        stored.count_stream(source, f"{tmp_path}/out", f"{tmp_path}/state")
    assert totals(spark, f"{tmp_path}/out") == {(m, "a"): (30, 0, 30) for m in range(3)}


def test_lines_are_filed_by_sound_stamps(spark, tmp_path):
    arrival = DAY0 * stored.DAY_US
    us = {"sound": arrival - 5, "old": arrival - 500 * stored.DAY_US, "ahead": arrival + 3 * stored.DAY_US, "none": None, "late": arrival - 399 * stored.DAY_US}
    df = spark.createDataFrame([(k, v, arrival) for k, v in us.items()], "k string, us long, arrival_us long")
    for _ in range(2):
        stored.add_lines(df, 0, str(tmp_path))
    got = {r.k: r.filed_us for r in spark.read.parquet(str(tmp_path)).collect()}
    assert got == {"sound": us["sound"], "old": arrival, "ahead": arrival, "none": arrival, "late": us["late"]}


def test_upserts_keep_the_newest(spark, tmp_path):
    path, ddl = str(tmp_path), "k string, v string, at long"
    up = lambda *rows: stored.upsert(spark, spark.createDataFrame(rows, ddl), path, ["k"], "at")
    assert up(("a", "1", 1), ("b", "1", 5)) == 0
    assert up(("a", "2", 2), ("b", "old", 4), ("c", None, 1)) == 1 and up(("a", "3", 2)) == 2
    assert {(r.k, r.v) for r in stored.read_table(spark, path).collect()} == {("a", "3"), ("b", "1"), ("c", None)}


def test_reach_of_causes(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a2"), ("a", "c"), ("d", "c"), ("a2", "x"), ("e", "e")], "source string, target string")
    reach = impact.reached(spark.createDataFrame([("a",), ("x",), ("e",)], "root string"), edges)
    got = {(r.root, r.node): (r.distance, r.via) for r in reach.collect()}
    assert got == {("a", "a"): (0, None), ("a", "b"): (1, "a"), ("a", "c"): (2, "b"), ("a", "d"): (3, "c"), ("x", "x"): (0, None), ("x", "a2"): (1, "x"), ("x", "c"): (2, "a2"), ("x", "a"): (3, "c"), ("x", "d"): (3, "c"), ("x", "b"): (4, "a"), ("e", "e"): (0, None)}
    assert [tuple(r) for r in impact.chain(reach).orderBy("place").collect()][:4] == [(1, "a", 0), (2, "e", 0), (3, "x", 0), (4, "a2", 1)]
    assert sorted(map(tuple, impact.paths(reach, "x", "b").collect())) == [(0, "x"), (1, "a2"), (2, "c"), (3, "a"), (4, "b")]
    assert impact.reached(spark.createDataFrame([("a",)], "root string"), edges, 1).count() == 2
    placed = spark.createDataFrame([("DB-1", "pg"), ("DB-1", "cron"), ("w1", "web")], "host string, service string")
    deps = spark.createDataFrame([("web", "db-1", 3), ("web", "auth", 2), ("web", "w1", 1)], "source string, target string, n long")
    hot = spark.createDataFrame([("pg",)], "service string")
    assert {tuple(r) for r in impact.mapped_dependencies(deps, placed, hot).collect()} == {("web", "pg", 3), ("web", "auth", 2)}
