"""Queries: operators bound to the tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import graph, incidents, rollups, traces
from ..sources import formats
from ..sources.observations import MINUTE, deduplicate, from_events, micros, repair_clock, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR, DAY = 60 * MINUTE, 1440 * MINUTE
#: 1 January 2024, where the event table begins, and its end 30 days later.
START = 1_704_067_200_000_000
END = START + 30 * DAY

OBS = """obs AS (SELECT event_id AS seq, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN CASE WHEN value >= 200 THEN 'CRITICAL' ELSE 'ERROR' END WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS severity,
  'svc-' || event_type AS service, 'prd-app-' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS host, CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'test' ELSE 'dev' END AS environment,
  event_type || ' request ' || event_id || ' took ' || CAST(round(value) AS BIGINT) || ' ms' AS message, event_type || ' request <n> took <n>ms' AS template, CAST(round(value) AS DOUBLE) AS ms, value, user_id, event_type, props FROM events),
o AS (SELECT *, severity IN ('ERROR', 'CRITICAL') AS bad, array_position(['DEBUG', 'INFO', 'WARN', 'ERROR', 'CRITICAL'], severity) - 1 AS lvl FROM obs)"""
LINES = """p0 AS (SELECT l_orderkey AS trace_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS span_id, 'supplier-' || (l_suppkey % 5) AS service, CAST((l_partkey * 37 + l_linenumber * 11) % 400 AS DOUBLE) AS start_ms, CAST((l_suppkey * 53 + l_partkey * 7) % 900 + 1 AS DOUBLE) AS duration_ms, l_returnflag = 'R' AS error, CASE (l_partkey + l_linenumber) % 8 WHEN 0 THEN 'db' WHEN 1 THEN 'client' WHEN 2 THEN 'user' WHEN 3 THEN 'log' ELSE 'server' END AS kind, l_linenumber FROM lineitem),
p AS (SELECT * EXCLUDE (l_linenumber), CASE WHEN l_linenumber = 3 THEN first_value(span_id) OVER (PARTITION BY trace_id ORDER BY start_ms, -duration_ms, span_id) END AS parent_ref FROM p0)"""
BOUNDS = "b AS (SELECT i, CASE i WHEN 0 THEN 0.0 ELSE x[i] END AS lo, CASE i WHEN 22 THEN 240000.0 ELSE x[i + 1] END AS hi FROM (SELECT [1,2,5,10,20,50,100,200,300,500,750,1000,1500,2000,3000,5000,7500,10000,20000,30000,60000,120000] AS x, unnest(range(0, 23)) AS i))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans of a trace; the third line names the trace's first span as its parent."""
    li = table(spark, sf_dir, "lineitem")
    kinds = F.array(*map(F.lit, ("db", "client", "user", "log", "server", "server", "server", "server")))
    s = li.select(
        F.col("l_orderkey").alias("trace_id"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("span_id"), F.concat(F.lit("supplier-"), F.col("l_suppkey") % 5).alias("service"),
        ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 400).cast("double").alias("start_ms"), ((F.col("l_suppkey") * 53 + F.col("l_partkey") * 7) % 900 + 1).cast("double").alias("duration_ms"), (F.col("l_returnflag") == "R").alias("error"),
        F.element_at(kinds, (F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(8)) + 1).cast("int")).alias("kind"), "l_linenumber",
    )
    first = Window.partitionBy("trace_id").orderBy("start_ms", -F.col("duration_ms"), "span_id")
    return s.withColumn("parent_ref", F.when(F.col("l_linenumber") == 3, F.first("span_id").over(first))).drop("l_linenumber")


@query(f"WITH {OBS}, n AS (SELECT severity AS key, CAST(floor((us - {START}) / {DAY}) AS BIGINT) AS bar, count(*) AS lines FROM o WHERE bad AND service LIKE 'svc-%' AND us >= {START} AND us < {END} GROUP BY 1, 2) SELECT bar, key, coalesce(lines, 0) AS lines FROM (SELECT key, unnest(range(0, 30)) AS bar FROM (SELECT DISTINCT key FROM n)) LEFT JOIN n USING (key, bar)")
def log_histogram(spark, sf_dir):
    """ERROR+ lines of services `svc-*` by day and level, zero-filled."""
    obs = from_events(spark, sf_dir).where(rollups.severe() & text.glob(F.col("service"), "svc-*"))
    return rollups.histogram(obs, "severity", DAY, START, 30)


@query(f"WITH {OBS}, n AS (SELECT host AS key, CAST(floor((us - {START}) / {DAY}) AS BIGINT) AS bar, count(*) AS lines FROM o WHERE us >= {START} AND us < {END} GROUP BY 1, 2), t AS (SELECT key FROM n GROUP BY 1 ORDER BY sum(lines) DESC, key LIMIT 3), m AS (SELECT CASE WHEN key IN (SELECT key FROM t) THEN key ELSE '_other' END AS key, bar, CAST(sum(lines) AS BIGINT) AS lines FROM n GROUP BY 1, 2) SELECT bar, key, coalesce(lines, 0) AS lines FROM (SELECT key, unnest(range(0, 30)) AS bar FROM (SELECT DISTINCT key FROM m)) LEFT JOIN m USING (key, bar)")
def host_series(spark, sf_dir):
    return rollups.histogram(from_events(spark, sf_dir), "host", DAY, START, 30, 3)


@query(f"WITH {OBS} SELECT seq, us, severity, message FROM o WHERE bad AND us < {START + 20 * DAY} ORDER BY us DESC, seq DESC LIMIT 50")
def search_newest(spark, sf_dir):
    """A page of the newest ERROR+ lines behind a keyset cursor."""
    obs = from_events(spark, sf_dir).where(rollups.severe() & (F.col("us") < START + 20 * DAY))
    return obs.orderBy(F.desc("us"), F.desc("seq")).limit(50).select("seq", "us", "severity", "message")


@query(f"WITH {OBS} SELECT 'severity' AS field, severity AS value, count(*) AS lines FROM o WHERE service IN ('svc-error', 'svc-click') GROUP BY 2 UNION ALL SELECT 'service', service, count(*) FROM o WHERE bad GROUP BY 2 UNION ALL SELECT 'host', host, count(*) FROM o WHERE bad AND service IN ('svc-error', 'svc-click') GROUP BY 2")
def facets(spark, sf_dir):
    clauses = {"severity": rollups.severe(), "service": F.col("service").isin("svc-error", "svc-click")}
    return rollups.facets(from_events(spark, sf_dir), clauses, ["severity", "service", "host"])


@query(f"WITH {OBS} SELECT template, service, count(*) AS lines, CAST(max(lvl) AS INT) AS level, count(DISTINCT host) AS hosts, min(us) AS first_us, max(us) AS last_us, arg_max(message, {{'a': us, 'b': seq}}) AS sample, substr(sha1(template || chr(0) || service), 1, 12) AS group_key FROM o GROUP BY 1, 2")
def message_groups(spark, sf_dir):
    return rollups.groups(from_events(spark, sf_dir))


@query(f"""WITH {OBS} SELECT 'level' AS leaf, count(*) AS lines FROM o WHERE lvl >= 2 UNION ALL SELECT 'glob', count(*) FROM o WHERE host LIKE 'prd-app-1_' UNION ALL SELECT 'number', count(*) FROM o WHERE coalesce(TRY_CAST(props->>'$.k' AS DOUBLE) > 50, false) UNION ALL SELECT 'present', count(*) FROM o WHERE coalesce(props->>'$.k', '-') NOT IN ('', '-') UNION ALL SELECT 'not_missing', count(*) FROM o UNION ALL SELECT 'text', count(*) FROM o WHERE message LIKE '%error request%'""")
def predicates(spark, sf_dir):
    """Lines that each kind of filter leaf passes; NOT of a missing field is true."""
    k = F.col("attributes")["k"]
    leaves = {
        "level": text.rank(F.col("severity")) >= 2, "glob": text.glob(F.col("host"), "PRD-app-1?"), "number": text.compare(k, ">", 50), "present": text.present(k),
        "not_missing": ~text.compare(F.col("attributes")["nothing"], ">", 1), "text": text.fold(F.col("message")).contains("error request"),
    }
    row = from_events(spark, sf_dir).agg(*[F.count_if(v).alias(n) for n, v in leaves.items()])
    return row.select(F.explode(F.create_map(*[x for n in leaves for x in (F.lit(n), F.col(n))])).alias("leaf", "lines"))


@query(f"WITH {OBS} SELECT CAST(floor(us / {MINUTE}) AS BIGINT) AS bucket, host, severity, count(*) AS lines, CAST(sum(CAST(bad AS INT)) AS BIGINT) AS errors FROM o GROUP BY 1, 2, 3")
def minute_counts(spark, sf_dir):
    return rollups.counts(from_events(spark, sf_dir), ["host", "severity"])


@query(f"WITH {OBS} SELECT service, count(*) AS lines, CAST(sum(CAST(bad AS INT)) AS BIGINT) AS errors FROM o WHERE lvl >= 1 GROUP BY 1")
def facet_cube(spark, sf_dir):
    """The cube of all facets, then a count under a predicate from its rows alone."""
    cube = rollups.counts(from_events(spark, sf_dir), ["host", "service", "source", "severity"])
    return cube.where(text.rank(F.col("severity")) >= 1).groupBy("service").agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"))


@query(f"""WITH {OBS}, {BOUNDS}, h AS (SELECT service, i, lo, hi, count(*) AS c FROM o JOIN b ON (ms > lo OR i = 0) AND (ms <= hi OR i = 22) AND (i > 0 OR ms <= 1) WHERE ms >= 0 GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY service ORDER BY i) AS acc, sum(c) OVER (PARTITION BY service) AS n FROM h),
q AS (SELECT service, p, arg_min(lo + (hi - lo) * ((p * n - (acc - c)) / c), i) AS v FROM w, (SELECT unnest([0.5, 0.9, 0.99]) AS p) WHERE acc >= p * n GROUP BY 1, 2),
a AS (SELECT service, sum(c * (least(1.0, greatest(0.0, (100 - lo) / (hi - lo))) + least(1.0, greatest(0.0, (400 - lo) / (hi - lo))))) / 2 / any_value(n) AS apdex FROM w GROUP BY 1)
SELECT service, round(max(v) FILTER (p = 0.5), 6) AS p50, round(max(v) FILTER (p = 0.9), 6) AS p90, round(max(v) FILTER (p = 0.99), 6) AS p99, round(any_value(apdex), 6) AS apdex FROM q JOIN a USING (service) GROUP BY 1""")
def latency_quantiles(spark, sf_dir):
    return rollups.latency(from_events(spark, sf_dir), ["service"]).select("service", "p50", "p90", "p99", "apdex")


@query(f"WITH {OBS} SELECT environment, count(*) AS lines, CAST(sum(CAST(bad AS INT)) AS BIGINT) AS errors, round(1 - sum(CAST(bad AS INT)) / count(*), 9) AS availability, round(greatest(0.0, 1 - (sum(CAST(bad AS INT)) / count(*)) / 0.3), 6) AS budget_left, 1 - sum(CAST(bad AS INT)) / count(*) >= 0.7 AS met FROM o GROUP BY 1")
def service_levels(spark, sf_dir):
    s = rollups.service_levels(from_events(spark, sf_dir), ["environment"], 0.7)
    return s.withColumn("availability", F.round("availability", 9)).withColumn("budget_left", F.round("budget_left", 6))


@query(f"WITH {OBS}, n AS (SELECT CAST(floor(us / {DAY}) AS BIGINT) AS bucket, count(*) AS lines, sum(CAST(bad AS INT)) AS errors FROM o GROUP BY 1), c AS (SELECT bucket, lines, CAST(errors AS BIGINT) AS errors, CAST(sum(lines) OVER (ORDER BY bucket) AS BIGINT) AS all_lines, CAST(sum(errors) OVER (ORDER BY bucket) AS BIGINT) AS all_errors FROM n) SELECT *, round(greatest(0.0, 1 - (all_errors / all_lines) / 0.3), 6) AS budget_left FROM c")
def budget_burn(spark, sf_dir):
    return rollups.burn(from_events(spark, sf_dir), DAY, 0.7).withColumn("budget_left", F.round("budget_left", 6))


@query(f"WITH {OBS}, s AS (SELECT host, service, count(*) AS n FROM o GROUP BY 1, 2), t AS (SELECT host, service AS top_service FROM s QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, service) = 1) SELECT host, count(*) AS lines, count(*) FILTER (bad) AS errors, count(*) FILTER (severity = 'WARN') AS warnings, max(us) AS last_us, any_value(top_service) AS top_service, max(us) < {END} - {5 * MINUTE} AS silent, 'prd-app' AS pool FROM o JOIN t USING (host) GROUP BY 1")
def host_table(spark, sf_dir):
    return rollups.hosts(from_events(spark, sf_dir), END)


@query(f"""WITH {OBS}, h AS (SELECT host, count(*) AS lines, count(*) FILTER (bad) AS errors, max(us) < {END - 10 * DAY} - {7 * 60 * MINUTE} AS silent FROM o WHERE us < {END - 10 * DAY} GROUP BY 1), m AS (SELECT avg(lines) AS m, count(*) AS k FROM h WHERE NOT silent)
SELECT 'prd-app' AS pool, count(*) AS hosts, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(errors) AS BIGINT) AS errors, count(*) FILTER (silent) AS silent, arg_max(CASE WHEN errors > 0 THEN host END, {{'a': errors, 'b': lines, 'c': host}}) AS worst, count(*) FILTER (NOT silent AND (SELECT k FROM m) >= 3 AND (lines > 5 * (SELECT m FROM m) OR lines < (SELECT m FROM m) / 5)) AS outliers FROM h""")
def pools(spark, sf_dir):
    """Pools as they stood on a day, with hosts that had been silent for seven hours."""
    now = END - 10 * DAY
    return rollups.pools(rollups.hosts(from_events(spark, sf_dir).where(F.col("us") < now), now, 7 * HOUR))


@query(f"WITH {OBS} SELECT user_id, count(*) AS lines, count(*) FILTER (bad) AS errors, min(us) AS first_us, max(us) AS last_us, count(DISTINCT floor(us / {5 * MINUTE})) AS active, count(DISTINCT host) AS hosts FROM o GROUP BY 1")
def sessions(spark, sf_dir):
    return rollups.sessions(from_events(spark, sf_dir), "user_id")


@query(f"WITH {OBS}, a AS (SELECT us, seq, host FROM o WHERE seq = 500), n AS (SELECT o.seq, o.us, CASE WHEN (o.us, o.seq) < (a.us, a.seq) THEN -1 ELSE 1 END AS side FROM o JOIN a ON o.host = a.host AND abs(o.us - a.us) <= {DAY} AND o.seq <> a.seq) SELECT seq, us, side FROM n QUALIFY row_number() OVER (PARTITION BY side ORDER BY CASE side WHEN 1 THEN us ELSE -us END, CASE side WHEN 1 THEN seq ELSE -seq END) <= 5")
def context_window(spark, sf_dir):
    return rollups.context(from_events(spark, sf_dir), 500, 5, DAY)


@query(f"WITH {OBS} SELECT 'user_id' AS key, count(user_id) AS seen, count(user_id) AS numeric FROM o UNION ALL SELECT 'k', count(props->>'$.k'), count(TRY_CAST(props->>'$.k' AS DOUBLE)) FROM o")
def attribute_keys(spark, sf_dir):
    return rollups.attribute_keys(from_events(spark, sf_dir))


@query(f"WITH {OBS}, n AS (SELECT host, floor(us / {DAY}) AS bar, count(*) AS n FROM o GROUP BY 1, 2), k AS (SELECT DISTINCT host FROM n), g AS (SELECT host, unnest(range(CAST((SELECT min(bar) FROM n) AS BIGINT), CAST((SELECT max(bar) FROM n) AS BIGINT) + 1)) AS bar FROM k), m AS (SELECT host, greatest(4.0, 1.2 * median(coalesce(n, 0))) AS lim FROM g LEFT JOIN n USING (host, bar) GROUP BY 1) SELECT host, CAST(bar AS BIGINT) AS bar, n FROM n JOIN m USING (host) WHERE n >= lim")
def storm_hot_cells(spark, sf_dir):
    return incidents.hot_cells(from_events(spark, sf_dir), "host", DAY, 4, 1.2).select("host", "bar", "n")


@query(SQL["storm_hot_cells"].replace("SELECT host, CAST(bar AS BIGINT) AS bar, n FROM n JOIN m USING (host) WHERE n >= lim", ", c AS (SELECT host, CAST(bar AS BIGINT) AS bar, n FROM n JOIN m USING (host) WHERE n >= lim), i AS (SELECT *, bar - row_number() OVER (PARTITION BY host ORDER BY bar) AS g FROM c) SELECT host, min(bar) AS first_bar, max(bar) AS last_bar, CAST(sum(n) AS BIGINT) AS lines FROM i GROUP BY host, g"))
def storms(spark, sf_dir):
    """Hot cells joined to storms of neighbouring bars."""
    return incidents.runs(incidents.hot_cells(from_events(spark, sf_dir), "host", DAY, 4, 1.2).select("host", "bar", "n"), "host").drop("storm")


@query(f"WITH {OBS}, b AS (SELECT * FROM o WHERE bad) SELECT x.seq, x.service, count(*) AS n, CAST(count(DISTINCT y.host) AS INT) AS hosts FROM b x JOIN b y ON x.service = y.service AND y.us BETWEEN x.us AND x.us + {6 * HOUR} GROUP BY 1, 2 HAVING count(*) >= 4 AND count(DISTINCT y.host) >= 2")
def slow_burn(spark, sf_dir):
    return incidents.slow_burn(from_events(spark, sf_dir), ["service"], 6 * HOUR)


@query(f"""WITH {OBS}, e AS (SELECT CAST(floor({END} / {HOUR}) AS BIGINT) AS e), n AS (SELECT host, CAST(floor(us / {HOUR}) AS BIGINT) AS bar, count(*) AS n FROM o, e WHERE us < e * {HOUR} AND us >= (e - 168) * {HOUR} GROUP BY 1, 2),
w AS (SELECT host, CAST(sum(n) AS BIGINT) AS observed FROM n, e WHERE bar >= e - 24 GROUP BY 1), f AS (SELECT host, min(bar) AS lo FROM n, e WHERE bar < e - 24 GROUP BY 1), g AS (SELECT host, unnest(range(lo, e - 24)) AS bar FROM f, e), d AS (SELECT host, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (host, bar)),
m AS (SELECT host, median(n) AS med, count(*) AS bars FROM d GROUP BY 1), a AS (SELECT host, median(abs(n - med)) * 1.4826 AS mad FROM d JOIN m USING (host) GROUP BY 1),
z AS (SELECT host, observed, med * 24 AS normal, (observed - med * 24) / greatest(mad * sqrt(24.0), 1.0, 2.4 * med) AS z FROM w JOIN m USING (host) JOIN a USING (host) WHERE bars >= 30) SELECT host, observed, normal, round(z, 6) AS z, z >= 1.0 AND observed >= 2 AND observed >= 2 * normal AS anomaly FROM z""")
def rate_anomalies(spark, sf_dir):
    return incidents.anomalies(from_events(spark, sf_dir), "host", END, HOUR, 24, 168, 1.0, 2)


@query(f"WITH {OBS}, old AS (SELECT user_id, count(DISTINCT floor(us / {DAY})) AS bars, max(us) AS last_us FROM o WHERE us < {END - DAY} AND us >= {END - 11 * DAY} GROUP BY 1) SELECT user_id, bars, last_us FROM old WHERE bars * 2 >= 10 AND user_id NOT IN (SELECT user_id FROM o WHERE us >= {END - DAY} AND user_id IS NOT NULL)")
def silent_sources(spark, sf_dir):
    return incidents.silent(from_events(spark, sf_dir), "user_id", END, DAY, 1, 10)


@query(f"WITH {OBS} SELECT CAST(floor(us / {HOUR}) AS BIGINT) AS bar, count(*) AS matches FROM o WHERE severity = 'CRITICAL' OR message LIKE 'error%' GROUP BY 1 HAVING count(*) >= 2")
def alert_preview(spark, sf_dir):
    rule = (F.col("severity") == "CRITICAL") | F.col("message").startswith("error")
    return incidents.rule_windows(from_events(spark, sf_dir), rule, HOUR, 2)


@query(f"WITH {OBS} SELECT template, count(*) AS lines FROM o WHERE us >= {START + 5 * MINUTE} AND lvl >= 2 GROUP BY 1 HAVING template NOT IN (SELECT template FROM o WHERE us < {START + 5 * MINUTE})")
def new_patterns(spark, sf_dir):
    return incidents.new_templates(from_events(spark, sf_dir), START + 5 * MINUTE)


@query(f"WITH {OBS}, l AS (SELECT host, arg_max(environment, us * 1000 + seq % 1000) AS environment, arg_max(value, us * 1000 + seq % 1000) AS value FROM o GROUP BY 1) SELECT host, 'cpu' AS metric, value, CASE WHEN host = 'prd-app-03' THEN 'host' ELSE 'pool' END AS scope, CASE WHEN host = 'prd-app-03' THEN 5e0 ELSE 50e0 END AS warn, CASE WHEN host = 'prd-app-03' THEN 10e0 ELSE 100e0 END AS crit, CASE WHEN value >= CASE WHEN host = 'prd-app-03' THEN 10e0 ELSE 100e0 END THEN 'crit' WHEN value >= CASE WHEN host = 'prd-app-03' THEN 5e0 ELSE 50e0 END THEN 'warn' ELSE 'ok' END AS state FROM l")
def threshold_breaches(spark, sf_dir):
    """The latest value of each host under the policy that applies to it."""
    rules = spark.createDataFrame([("host", "prd-app-03", "cpu", 5.0, 10.0, 1), ("pool", "prd-app", "cpu", 40.0, 90.0, 2), ("pool", "prd-app", "cpu", 50.0, 100.0, 3), ("all", "*", "cpu", 1.0, 2.0, 4)], "scope string, target string, metric string, warn double, crit double, id int")
    latest = from_events(spark, sf_dir).groupBy("host").agg(F.max_by(F.struct("environment", "value"), F.struct("us", "seq")).alias("l"))
    latest = latest.select("host", "l.*", F.lit("cpu").alias("metric"), text.pool(F.col("host")).alias("pool"))
    return incidents.resolve_policies(latest, rules)


@query(f"""WITH {LINES}, {BOUNDS}, h AS (SELECT service, i, lo, hi, count(*) AS c FROM p JOIN b ON duration_ms > lo AND duration_ms <= hi GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY service ORDER BY i) AS acc, sum(c) OVER (PARTITION BY service) AS n FROM h), q AS (SELECT service, s, arg_min(lo + (hi - lo) * ((s * n - (acc - c)) / c), i) AS v FROM w, (SELECT unnest([0.5, 0.95, 0.99]) AS s) WHERE acc >= s * n GROUP BY 1, 2),
a AS (SELECT service, sum(c * (least(1.0, greatest(0.0, (300 - lo) / (hi - lo))) + least(1.0, greatest(0.0, (1200 - lo) / (hi - lo))))) / 2 / any_value(n) AS apdex FROM w GROUP BY 1), r AS (SELECT service, round(max(v) FILTER (s = 0.5), 6) AS p50, round(max(v) FILTER (s = 0.95), 6) AS p95, round(max(v) FILTER (s = 0.99), 6) AS p99 FROM q GROUP BY 1)
SELECT service, count(*) AS calls, count(*) FILTER (error) AS errors, round(count(*) FILTER (error) / count(*), 5) AS error_rate, round(avg(duration_ms), 4) AS avg_ms, max(duration_ms) AS max_ms, any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99, round(any_value(apdex), 6) AS apdex FROM p JOIN r USING (service) JOIN a USING (service) GROUP BY 1""")
def red_metrics(spark, sf_dir):
    return traces.red(spans_of(spark, sf_dir), ["service"])


@query(f"WITH {LINES} SELECT trace_id, count(*) AS spans, count(*) FILTER (error) AS errors, max(start_ms + duration_ms) - min(start_ms) AS length_ms, arg_min(service, {{'a': start_ms, 'b': span_id}}) AS root FROM p GROUP BY 1 HAVING max(start_ms + duration_ms) - min(start_ms) >= 500 ORDER BY length_ms DESC, trace_id LIMIT 50")
def trace_search(spark, sf_dir):
    return traces.search(spans_of(spark, sf_dir), 500, 50)


_PARENTS = f"""{LINES}, f AS (SELECT x.trace_id, x.span_id, y.span_id AS parent_id, y.service AS parent_service FROM p x JOIN p y ON x.trace_id = y.trace_id AND x.parent_ref = y.span_id AND x.span_id <> y.span_id),
c AS (SELECT x.trace_id, x.span_id, y.span_id AS parent_id, y.service AS parent_service, row_number() OVER (PARTITION BY x.trace_id, x.span_id ORDER BY y.duration_ms, y.start_ms DESC, y.span_id DESC) AS r FROM p x JOIN p y ON x.trace_id = y.trace_id AND y.kind <> 'log' AND y.start_ms <= x.start_ms + 0.5 AND x.start_ms + x.duration_ms <= y.start_ms + y.duration_ms + 0.5
  AND (y.start_ms, -y.duration_ms, y.span_id) < (x.start_ms, -x.duration_ms, x.span_id) AND (x.service <> y.service OR (x.kind IN ('db', 'client', 'external', 'producer') AND y.kind NOT IN ('db', 'client', 'external', 'producer')) OR y.kind IN ('user', 'mobile')) WHERE (x.trace_id, x.span_id) NOT IN (SELECT (trace_id, span_id) FROM f)),
t AS (SELECT p.*, coalesce(f.parent_id, c.parent_id) AS parent_id, coalesce(f.parent_service, c.parent_service) AS parent_service, c.parent_id IS NOT NULL AS inferred FROM p LEFT JOIN f USING (trace_id, span_id) LEFT JOIN (SELECT * FROM c WHERE r = 1) c USING (trace_id, span_id))"""


@query(f"WITH {_PARENTS} SELECT trace_id, span_id, service, kind, start_ms, duration_ms, error, parent_id, parent_service, inferred FROM t")
def span_parents(spark, sf_dir):
    return traces.parents(spans_of(spark, sf_dir))


@query(f"WITH {_PARENTS} SELECT parent_service AS src, service AS dst, count(*) AS calls, count(*) FILTER (error) AS errors, count(*) FILTER (inferred) AS inferred, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50, list_sort(list(duration_ms))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95 FROM t WHERE parent_id IS NOT NULL AND parent_service <> service AND kind <> 'log' GROUP BY 1, 2")
def service_topology(spark, sf_dir):
    return traces.edges(traces.parents(spans_of(spark, sf_dir)))


@query(f"WITH RECURSIVE {_PARENTS}, k AS (SELECT trace_id, parent_id AS span_id, sum(duration_ms) AS kids FROM t WHERE parent_id IS NOT NULL AND kind <> 'log' GROUP BY 1, 2), d(trace_id, span_id, depth) AS (SELECT trace_id, span_id, 0 FROM t WHERE parent_id IS NULL UNION ALL SELECT t.trace_id, t.span_id, d.depth + 1 FROM t JOIN d ON t.trace_id = d.trace_id AND t.parent_id = d.span_id), z AS (SELECT trace_id, min(start_ms) AS t0 FROM p GROUP BY 1) SELECT DISTINCT trace_id, span_id, greatest(0.0, duration_ms - coalesce(kids, 0.0)) AS self_ms, depth, start_ms - t0 AS offset_ms FROM t LEFT JOIN k USING (trace_id, span_id) JOIN d USING (trace_id, span_id) JOIN z USING (trace_id)")
def waterfalls(spark, sf_dir):
    """Each trace's spans with their own time, depth and offset."""
    with_parents = graph.written(traces.parents(spans_of(spark, sf_dir)))
    start = with_parents.groupBy("trace_id").agg(F.min("start_ms").alias("t0"))
    own = traces.self_times(with_parents, with_parents, "start_ms").join(traces.depths(with_parents), ["trace_id", "span_id"])
    return own.join(start, "trace_id").select("trace_id", "span_id", "self_ms", "depth", (F.col("start_ms") - F.col("t0")).alias("offset_ms")).distinct()


@query(f"""WITH e AS (SELECT o_orderkey AS key, 0 AS step, epoch_us(o_orderdate) // 1000000 AS t FROM orders UNION ALL SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000000 FROM lineitem WHERE l_linenumber < 4), f AS (SELECT key, step, min(t) AS t FROM e GROUP BY 1, 2), g AS (SELECT a.step, b.t - a.t AS g FROM f a JOIN f b ON a.key = b.key AND b.step = a.step + 1), r AS (SELECT step, count(*) AS reached FROM f GROUP BY 1),
q AS (SELECT step, median(g) AS m, CAST(list_sort(list(g))[least(count(*), CAST(floor(count(*) * 0.95) AS INT) + 1)] AS DOUBLE) AS p, count(*) FILTER (g >= 0) AS k, list_sort(list(g) FILTER (g >= 0)) AS w FROM g GROUP BY 1), l AS (SELECT step, CASE WHEN k >= 5 THEN greatest(60.0, 1.5 * w[least(k, CAST(floor(k * 0.95) AS INT) + 1)]) ELSE 900.0 END AS lim FROM q),
z AS (SELECT key, max(step) AS step, arg_max(t, step) AS t FROM f GROUP BY 1), s AS (SELECT z.step, count(*) AS n FROM z LEFT JOIN l USING (step) WHERE z.step < 3 AND {END // 1_000_000} - t > coalesce(lim, 900.0) GROUP BY 1)
SELECT step, reached, round(reached / first(reached) OVER (ORDER BY step), 4) AS of_first, round(reached / lag(reached) OVER (ORDER BY step), 4) AS from_prev, m AS median_s, p AS p95_s, coalesce(n, 0) AS stuck FROM r LEFT JOIN q USING (step) LEFT JOIN s USING (step)""")
def order_funnel(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("step"), F.floor(micros("o_orderdate") / 1_000_000).alias("t"))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber < 4").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("step"), F.floor(micros("l_shipdate") / 1_000_000).alias("t"))
    return traces.funnel(o.unionByName(li), 4, END // 1_000_000)


@query("SELECT s.s_nationkey AS src, c.c_nationkey AS dst, count(*) AS connections, count(DISTINCT l_suppkey) AS parties, epoch_us(max(l_shipdate)) AS last_t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2")
def flow_graph(spark, sf_dir):
    """Shipments as flows between the nations of supplier and customer."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return traces.flow_edges(j.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.col("l_suppkey").alias("party"), micros("l_shipdate").alias("t")))


@query(rf"WITH b AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^[^?#]*') AS b FROM pages), p AS (SELECT page_id, b, CASE WHEN b LIKE '%://%' THEN '/' || regexp_extract(b, '^.*?://[^/]*/(.*)$', 1) ELSE b END AS p FROM b), t AS (SELECT page_id, b, array_to_string(list_transform(string_split(p, '/'), lambda s: CASE WHEN regexp_matches(s, '{text.SEGMENT_ID}') OR regexp_matches(s, '\d{{4,}}') THEN '{{id}}' ELSE s END)[1:9], '/') AS t FROM p) SELECT page_id, CASE WHEN b = '' THEN '' WHEN t LIKE '/%' THEN t ELSE '/' || t END AS path FROM t")
def path_templates(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.path_template(F.col("url")).alias("path"))


@query("WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INT) AS place FROM s QUALIFY place <= 10")
def nearest_vectors(spark, sf_dir):
    """The ten nearest vectors to each one whose identifier is divisible by 50, among all."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return traces.nearest(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def inventory_enrichment(spark, sf_dir):
    """Records joined to their inventory; its size is known, and the join's kind is left to the optimizer."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", "n_name", "r_name")


@query("SELECT l_orderkey AS k, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT l_orderkey, min(l_linenumber) FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') = 0")
def deduplicated(spark, sf_dir):
    """One line of each order, a returned one where there is one."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_returnflag")
    return deduplicate(li, "k", F.col("l_returnflag") == "R", "n").select("k", "n")


@query(f"""WITH {OBS}, a AS (SELECT seq, us, CASE seq % 8 WHEN 0 THEN us + {3 * HOUR - MINUTE} WHEN 1 THEN us + {10 * MINUTE} WHEN 2 THEN us WHEN 3 THEN us - {400 * DAY} WHEN 4 THEN us + {3 * DAY} WHEN 5 THEN us + {20 * MINUTE} WHEN 6 THEN us - {10000 * DAY} END AS s FROM o), x AS (SELECT *, s - us AS ahead FROM a), y AS (SELECT *, CAST(ceil(ahead / {15 * MINUTE}) AS BIGINT) * {15 * MINUTE} AS off FROM x)
SELECT seq, CASE WHEN s IS NULL OR year(make_timestamp(s)) < 2000 OR ahead > {DAY} THEN us WHEN ahead >= {15 * MINUTE} AND ahead <= {14 * HOUR} AND off - ahead <= {5 * MINUTE} THEN s - off ELSE s END AS us FROM y""")
def clock_repair(spark, sf_dir):
    """Stamps put out of order in eight ways, then repaired against the arrival."""
    r = F.pmod("seq", F.lit(8))
    by = F.when(r == 0, 3 * HOUR - MINUTE).when(r == 1, 10 * MINUTE).when(r == 2, 0).when(r == 3, -400 * DAY).when(r == 4, 3 * DAY).when(r == 5, 20 * MINUTE).when(r == 6, -10_000 * DAY)
    return from_events(spark, sf_dir).select("seq", repair_clock(F.col("us") + by, F.col("us")).alias("us"))


@query(f"WITH {OBS} SELECT coalesce(a.template, b.template) AS template, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, CASE WHEN a.n IS NULL THEN 'only_b' WHEN b.n IS NULL THEN 'only_a' ELSE 'shared' END AS side FROM (SELECT template, count(*) AS n FROM o WHERE us < {START + 15 * DAY} GROUP BY 1) a FULL JOIN (SELECT template, count(*) AS n FROM o WHERE us >= {START + 15 * DAY} GROUP BY 1) b USING (template)")
def compare_halves(spark, sf_dir):
    o = from_events(spark, sf_dir).select(text.template(F.col("message")).alias("template"), (F.col("us") < START + 15 * DAY).alias("early"))
    n = o.groupBy("template").agg(F.count_if("early").alias("before"), F.count_if(~F.col("early")).alias("after"))
    return n.withColumn("side", F.when(F.col("before") == 0, "only_b").when(F.col("after") == 0, "only_a").otherwise("shared"))


@query(f"WITH {OBS} SELECT seq, host, service, CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'ERROR' THEN 'ERROR' WHEN 'WARN' THEN 'WARN' ELSE 'INFO' END AS severity, 'b' AS a, message FROM o")
def syslog_round_trip(spark, sf_dir):
    """Observations written as RFC 5424 lines and parsed again; urgencies 5 to 7 are all INFO."""
    o = from_events(spark, sf_dir)
    pri = F.element_at(F.array(*map(F.lit, ("135", "134", "132", "131", "130"))), text.rank(F.col("severity")) + 1)
    lines = o.select("seq", F.concat(F.lit("<"), pri, F.lit(">1 2024-01-01T00:00:00Z "), "host", F.lit(" "), "service", F.lit(' 7 - [x@1 a="b"] '), "message").alias("value"))
    return formats.syslog5424(lines).select("seq", "host", F.col("app").alias("service"), "severity", F.col("attributes")["a"].alias("a"), "message")


@query(f"WITH {OBS} SELECT seq, host, service, message FROM o")
def key_value_round_trip(spark, sf_dir):
    lines = from_events(spark, sf_dir).select("seq", F.concat(F.lit("host="), "host", F.lit(" service="), "service", F.lit(' msg="'), "message", F.lit('"')).alias("value"))
    a = F.col("attributes")
    return formats.key_values(lines).select("seq", a["host"].alias("host"), a["service"].alias("service"), a["msg"].alias("message"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'ERROR' WHEN event_id % 3 = 1 THEN 'WARN' ELSE 'INFO' END AS severity, 'GET /x/' || event_id || ' HTTP/1.1' AS request FROM events")
def access_round_trip(spark, sf_dir):
    code = F.when(F.col("seq") % 3 == 0, "503").when(F.col("seq") % 3 == 1, "404").otherwise("200")
    lines = from_events(spark, sf_dir).select("seq", F.concat(F.lit('10.0.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /x/'), "seq", F.lit(' HTTP/1.1" '), code, F.lit(' 12 "-" "agent"')).alias("value"))
    return formats.access(lines).select("seq", "severity", "request")


@query("SELECT event_id AS seq, 'v|w' AS vendor, CASE WHEN event_id % 11 >= 9 THEN 'CRITICAL' WHEN event_id % 11 >= 7 THEN 'ERROR' WHEN event_id % 11 >= 4 THEN 'WARN' ELSE 'INFO' END AS severity, event_type AS act FROM events")
def cef_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("CEF:0|v\\|w|p|1|9|n|"), F.col("event_id") % 11, F.lit("|src=1.2.3.4 act="), "event_type", F.lit(" msg=two words")).alias("value"))
    return formats.cef(lines).select("seq", F.replace("vendor", F.lit("\\|"), F.lit("|")).alias("vendor"), "severity", F.col("attributes")["act"].alias("act"))
