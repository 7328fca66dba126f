"""What must not grow faster than the rows: plans without lists of a group's rows, held against plain Python."""

import random

from opsloom.functions import text
from opsloom.operators import correlation, flows, graph, incidents, mining, search, spans, storms, traces
from opsloom.plans import state_views
from opsloom.sources.observations import with_once
from pyspark.sql import functions as F

MINUTE = 60_000_000


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_signals_keep_no_list_of_minutes(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(90) * MINUTE + rng.randrange(1000), rng.choice(("a", "b")), rng.choice(("h1", "h2", "-", None)), rng.choice(("INFO", "ERROR")), f"order {i}") for i in range(400)]
    df = correlation.fingerprinted(spark.createDataFrame(rows, "seq long, us long, service string, host string, severity string, message string"))
    got = correlation.signals(df)
    assert "collect_list" not in plan(got)
    span = (max(r[1] for r in rows) - min(r[1] for r in rows)) // MINUTE + 1
    want = {}
    for service, severity in {(r[2], r[4]) for r in rows}:
        own = [r for r in rows if (r[2], r[4]) == (service, severity)]
        n = {}
        for r in own:
            n[r[1] // MINUTE] = n.get(r[1] // MINUTE, 0) + 1
        v = sorted([0] * max(0, span - len(n)) + list(n.values()))
        base, peak = v[len(v) // 2], max(n.values())
        first_peak = min(m for m, k in n.items() if k == peak)
        onset = min(m for m, k in n.items() if k >= max(1, 2 * base) or m == first_peak)
        want[service, severity] = (len(own), len({r[3] for r in own} & {"h1", "h2"}), peak, base, onset * MINUTE, min(r[1] for r in own), max(r[1] for r in own))
    assert {(r.service, r.severity): (r.lines, r.hosts, r.peak, r.baseline, r.onset_us, r.first_us, r.last_us) for r in got.collect()} == want


def test_template_compiles_no_pattern_for_each_row(spark):
    texts = ["order 12 took 7 ms", "a\0b 12 /x 1.2.3.4:80", "1234567890123456 and 123", "at /a/b 2024-01-01 10:00:00", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "m string").select(text.template(F.col("m")).alias("t"))
    assert [r.t for r in df.collect()] == ["order <n> took <n>ms", "a\0b <n> <path> <ip>", "<hex> and <n>", "at <path> <ts>", None, ""]
    body = plan(df).split("== Physical Plan ==")[1]
    assert body.count("split(") == 2 and ", \0, -1)" in body


def test_slow_burn_reads_no_window_again(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(300), rng.choice(("a", "b", None)), rng.choice(("h1", "h2", "h3", None)), rng.choice(("ERROR", "CRITICAL", "INFO"))) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, us long, service string, host string, severity string")
    got = incidents.slow_burn(df, ["service"], 20, 4, 2)
    assert "collect_set" not in plan(got)
    want = set()
    bad = [r for r in rows if r[4] != "INFO"]
    for seq, us, service, _, _ in bad:
        ahead = [r for r in bad if r[2] == service and us <= r[1] <= us + 20]
        hosts = {r[3] for r in ahead} - {None}
        if len(ahead) >= 4 and len(hosts) >= 2:
            want.add((seq, service, len(ahead), len(hosts)))
    assert {(r.seq, r.service, r.n, r.hosts) for r in got.collect()} == want and len(want) > 100


def test_tickets_pair_kinds_and_not_rows(spark):
    """Joins give out no more than kinds times kinds, three slots a ticket, however many tickets and signals are alike."""
    signals = spark.range(3000).select(F.concat(F.lit("g"), "id").alias("fingerprint"), F.lit("payment module failed").alias("template"), F.lit("svc-a").alias("service"), F.concat(F.lit("h"), F.col("id") % 2).alias("host"), (F.col("id") * MINUTE).alias("onset_us"))
    rows = spark.range(2000).select(F.col("id").alias("ticket_id"), F.when(F.col("id") % 2 == 0, "trouble with svc-a").otherwise("payment module").alias("text"), (F.col("id") * 2 * MINUTE).alias("us"))
    df = search.tickets(rows, signals, 30)
    got = {r.ticket_id: (r.relevance, r.related, r.near) for r in df.collect()}
    assert got == {i: (round(0.65 * (0.6 if i % 2 == 0 else 0.3) + 0.35 * (2 * i <= 3029), 2), 3000, 2 * i <= 3029) for i in range(2000)}
    # Pairs of tickets and signals would be grouped by both.
    assert "fingerprint" not in plan(df).split("== Physical Plan ==")[1]


def test_small_and_large_traces_have_the_same_parents(spark):
    rng = random.Random(6)
    spans = [(t, 100 * t + i, rng.choice("abc"), float(rng.randrange(60)), float(rng.randrange(1, 80)), False, rng.choice(("db", "server", "user", "log")), 100 * t + rng.randrange(12) if i % 5 == 0 else None) for t in range(30) for i in range(12)]
    df = spark.createDataFrame(spans, "trace_id long, span_id long, service string, start_ms double, duration_ms double, error boolean, kind string, parent_ref long")
    got = [sorted(map(tuple, traces.parents(df, small=n).select("trace_id", "span_id", "parent_id", "parent_service", "inferred").collect()), key=str) for n in (0, 12)]
    assert got[0] == got[1] and len(got[0]) == len(spans) and sum(r[4] for r in got[0]) > 50


def test_a_users_span_claims_its_trace(spark):
    rows = [(1, 1, 0.0, 5.0, False, "server"), (1, 2, 1.0, 5.0, False, "user"), (2, 3, 0.0, 900.0, False, "server"), (2, 4, 0.0, 5.0, False, "server")]
    df = spark.createDataFrame(rows, "trace_id long, span_id long, start_ms double, duration_ms double, error boolean, kind string")
    assert {r.span_id for r in search.sampled_traces(df, 0, 895).collect()} == {1, 2, 3}


def test_cells_of_a_service_that_follow_each_other_are_one_node(spark, monkeypatch):
    nodes = []
    whole = graph.components

    def counted(given, links):
        nodes.append(given.count())
        return whole(given, links)

    monkeypatch.setattr(correlation.graph, "components", counted)
    cells = spark.createDataFrame([("a", b) for b in range(60)] + [("A", 3), ("b", 70), ("b", 71), ("c", 59), ("c", 80)], "service string, bar long")
    depends = spark.createDataFrame([("a", "c")], "source string, target string")
    rows = correlation.storm_clusters(cells, depends).collect()
    own = {(r["service"], r["bar"]): r["cluster"] for r in rows}
    assert nodes == [4] and len(rows) == 65
    assert {own["a", b] for b in range(60)} | {own["A", 3], own["c", 59]} == {"000000000000@a"}
    assert own["b", 70] == own["b", 71] == "000000000070@b" and own["c", 80] == "000000000080@c"


def test_windows_of_storms_are_not_broadcast(spark):
    at = spark.createDataFrame([(1, 0, "a", "h", 0, 0)], "seq long, us long, service string, host string, bar long, t0 long")
    clusters = spark.createDataFrame([("a", 0, "a@0", ("a", 0))], "service string, bar long, cluster string, first struct<service:string,bar:long>")
    found = storms.claimed(at, clusters, spark.createDataFrame([("h", "a")], "host string, home string"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "a@0")]


def test_columns_worked_out_once_are_compiled_and_not_worked_out_again(spark):
    """A generator is given a column; a filter on its size would hold the whole expression a second time."""
    df = with_once(spark.range(3).selectExpr("id", "array(id, id + 1) AS a"), b=F.transform("a", lambda x: x * 2), c=F.col("id") + 7)
    body = plan(df).split("== Physical Plan ==")[1]
    assert "_once" in body.split("Generate ")[1].split("[")[0] and "Filter" not in body
    assert sorted(map(tuple, df.collect())) == [(i, [i, i + 1], [2 * i, 2 * i + 2], i + 7) for i in range(3)]


def test_spans_keep_the_order_of_attributes_and_durations(spark):
    rows = [["Took", "oops", "duration", "7ms", "rt_ms", "-", "TRACE", "b", "traceid", "a"], ["elapsed", "nothing", "x", "1"], ["rt_ms", "5", "Rt_Ms", "6", "trace", "-", "dd.trace_id", "c"], ["rt_ms", "none", "took", "2s"]]
    attributes = F.coalesce(*[F.when(F.col("seq") == i, F.create_map(*map(F.lit, a))) for i, a in enumerate(rows, 1)])
    df = spark.createDataFrame([(i, 0, "x", "INFO", "s", "h", "prod") for i in range(1, 5)], "seq long, us long, message string, severity string, service string, host string, environment string").withColumn("attributes", attributes)
    got = {r.seq: (r.trace_id, r.duration_ms, r.has_duration) for r in spans.spans_of_lines(df).collect()}
    assert got == {1: ("b", 7.0, True), 3: ("c", 6.0, True), 4: (None, 2000.0, True)}


def test_span_rollups_deal_lines_out_and_are_worked_out_once(spark, tmp_path):
    """Few row groups are few tasks, and two sources of the same rollup read its lines once."""
    e = spark.range(40).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 7 AS user_id", "element_at(array('view', 'click', 'error', 'signup', 'purchase'), cast(id % 5 + 1 AS int)) AS event_type", "cast(id AS double) AS value", "'{\"k\": 1}' AS props")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert "hashpartitioning(event_id" in plan(state_views.line_span_rollup(spark, str(tmp_path))).split("== Physical Plan ==")[1]
    merged = state_views.merged_rollups(spark, str(tmp_path))
    assert "event_id" not in plan(merged) and sum(r.calls for r in merged.collect()) == 2 * 32


def test_lines_are_mined_in_one_pass(spark):
    """Neither lines nor shapes are masked or folded again for lengths, heads, parts, totals and the largest clusters."""
    df = spark.createDataFrame([(f"{w} on disk {i} of node{i % 3}", i, i) for i in range(50) for w in ("read", "write", "")] + [(None, 60, 1)], "message string, us long, seq long")
    clusters = mining.mine(df)
    body = plan(mining.stats(clusters)).split("== Physical Plan ==")[1]
    assert "regexp_replace" not in body and "min_by" not in body
    assert body.count("MapInArrow") <= 2
    assert sorted((r.template, r.lines) for r in clusters.collect()) == [("<*>", 1), ("on disk <*> of <*>", 50), ("read on disk <*> of <*>", 50), ("write on disk <*> of <*>", 50)]


def test_keys_are_looked_for_once_and_numbers_masked_without_lists(spark):
    lines = ["order 7 created", "order 8 created", "ORDER 7 took 1.5 ms at 9%a", "order 8 took 20 MS at 9%a", "order 7  by 10.0.0.1", "order 8 by 10.0.0.2:80", "order 7 at 2024-01-01 10:00:00", "none", None]
    df = flows.suggested_steps(spark.createDataFrame([(m, i) for i, m in enumerate(lines)], "message string, us long"), r"order (\d+)")
    body = plan(df).split("== Physical Plan ==")[1]
    assert body.count("regexp_extract(message") == 1 and "RLIKE" in body
    assert {(r.template, r.keys, r.position) for r in df.collect()} == {("order <n> created", 2, 0.0), ("order <n> took <n>ms at <n>a", 2, 0.417), ("order <n> by <ip>", 2, 0.833)}


def test_templates_of_numbers_equal_those_by_pieces(spark, monkeypatch):
    rng = random.Random(8)
    bits = ["12", "1.5", "7 ms", "7MS", "3 s", "3 sec", "9%", "9%a", "4 kb", "1.2.3", "10.0.0.1", "2024-01-01", "deadbeef", "deadbeef-", "0123456789abcdef", "123456789012345", "/a/b", "https:", "order", "é9", "_1", "\0", "\n", "  ", " ", "-", ".", "$1", "\\"]
    df = spark.createDataFrame([("".join(rng.choice(bits) + rng.choice(("", " ", "-")) for _ in range(rng.randrange(1, 7))),) for _ in range(2000)], "m string")
    short = df.select(text.template(F.col("m")).alias("t"))
    monkeypatch.setattr(text, "LONG_MASKS", "^")
    assert [r.t for r in short.collect()] == [r.t for r in df.select(text.template(F.col("m")).alias("t")).collect()]


def test_lines_of_a_file_with_one_row_group_are_masked_by_all_tasks(spark):
    lines = spark.range(40).coalesce(1).selectExpr("concat('line ', id, ' done') AS message", "id AS us", "id AS seq")
    assert "RepartitionByExpression" in mining.shapes(lines)._jdf.queryExecution().optimizedPlan().toString().split("Generate")[-1]
    assert mining.shapes(lines).select("lines").collect() == [(40,)]
