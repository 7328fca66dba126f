"""Queries of the views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import rollups, views
from ..sources.observations import MINUTE, from_events, table
from .catalog import DAY, END, HOUR, OBS, START, query

WEEK = 7 * DAY
_BARS = "CAST(floor((us - {start}) / {step}) AS BIGINT)"
METRICS = {"k": "cpu", "user_id": "memory"}
_METRICS = "m AS (SELECT us, host, environment, 'cpu' AS metric, TRY_CAST(props->>'$.k' AS DOUBLE) AS value FROM o WHERE props->>'$.k' IS NOT NULL UNION ALL SELECT us, host, environment, 'memory', CAST(user_id AS DOUBLE) FROM o WHERE user_id IS NOT NULL), l AS (SELECT metric, host, arg_max(value, {'a': us, 'b': value}) AS value FROM m GROUP BY 1, 2)"


@query(f"WITH {OBS}, n AS (SELECT CAST(floor((us - {START}) / {360 * MINUTE}) AS BIGINT) AS bar, count(*) AS total, count(*) FILTER (bad) AS errors, count(*) FILTER (severity = 'WARN') AS warn FROM o WHERE us >= {START} AND us < {END} GROUP BY 1) SELECT b AS bar, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warn, 0) AS warn FROM range(120) t(b) LEFT JOIN n ON b = bar")
def series(spark, sf_dir):
    """A month in bars whose width the ladder chooses: six hours."""
    return views.series(from_events(spark, sf_dir), START, END)


@query(f"WITH {OBS}, n AS (SELECT CAST(floor((us - {START}) / {DAY}) AS BIGINT) AS bar, severity, count(*) AS events FROM o WHERE us >= {START} AND us < {END} GROUP BY 1, 2) SELECT b AS bar, s AS severity, coalesce(events, 0) AS events FROM range(30) t(b), (SELECT unnest(['DEBUG', 'INFO', 'WARN', 'ERROR', 'CRITICAL']) AS s) LEFT JOIN n ON b = bar AND s = severity")
def severity_bars(spark, sf_dir):
    return views.severity_bars(from_events(spark, sf_dir), START, END, DAY)


@query(f"WITH {OBS} SELECT service, count(*) AS lines FROM o GROUP BY 1 ORDER BY lines DESC, service LIMIT 8")
def top_services(spark, sf_dir):
    return views.top_services(from_events(spark, sf_dir))


_P95 = "h AS (SELECT {k}, i, lo, hi, count(*) AS c FROM o JOIN b ON (ms > lo OR i = 0) AND (ms <= hi OR i = 22) AND (i > 0 OR ms <= 1) WHERE ms >= 0 GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY {k} ORDER BY i) AS acc, sum(c) OVER (PARTITION BY {k}) AS n FROM h), q AS (SELECT {k}, p, round(arg_min(lo + (hi - lo) * ((p * n - (acc - c)) / c), i), 6) AS v FROM w, (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS p) WHERE acc >= p * n GROUP BY {k}, p)"
_BOUNDS = "b AS (SELECT i, CASE i WHEN 0 THEN 0.0 ELSE x[i] END AS lo, CASE i WHEN 22 THEN 240000.0 ELSE x[i + 1] END AS hi FROM (SELECT [1,2,5,10,20,50,100,200,300,500,750,1000,1500,2000,3000,5000,7500,10000,20000,30000,60000,120000] AS x, unnest(range(0, 23)) AS i))"


@query(f"WITH {OBS}, {_BOUNDS}, {_P95.format(k='service')} SELECT service, count(*) AS lines, count(*) FILTER (bad) AS errors, round(count(*) FILTER (bad) / count(*), 5) AS error_rate, count(DISTINCT host) AS hosts, round(count(*) / 43200.0, 1) AS per_min, any_value(v) AS p95 FROM o JOIN q USING (service) WHERE p = 0.95 GROUP BY 1")
def service_table(spark, sf_dir):
    return views.service_table(from_events(spark, sf_dir), 43_200.0)


@query(f"WITH {OBS}, {_BOUNDS}, {_P95.format(k='day')} SELECT day, max(v) FILTER (p = 0.5) AS p50, max(v) FILTER (p = 0.9) AS p90, max(v) FILTER (p = 0.99) AS p99 FROM q GROUP BY 1".replace("array_position(['DEBUG', 'INFO', 'WARN', 'ERROR', 'CRITICAL'], severity) - 1 AS lvl FROM obs", f"array_position(['DEBUG', 'INFO', 'WARN', 'ERROR', 'CRITICAL'], severity) - 1 AS lvl, CAST(floor(us / {DAY}) AS BIGINT) AS day FROM obs"))
def latency_bars(spark, sf_dir):
    """Latency quantiles by day."""
    return rollups.latency(from_events(spark, sf_dir).withColumn("day", rollups.bucket(DAY)), ["day"]).select("day", "p50", "p90", "p99")


@query(f"WITH {OBS}, e AS (SELECT service, CASE WHEN ms <= 50 THEN 50 WHEN ms <= 100 THEN 100 WHEN ms <= 200 THEN 200 WHEN ms <= 300 THEN 300 WHEN ms <= 500 THEN 500 WHEN ms <= 1000 THEN 1000 WHEN ms <= 2000 THEN 2000 WHEN ms <= 5000 THEN 5000 ELSE 10000 END AS edge FROM o WHERE ms >= 0), c AS (SELECT service, edge, sum(count(*)) OVER (PARTITION BY service ORDER BY edge) AS acc, sum(count(*)) OVER (PARTITION BY service) AS n FROM e GROUP BY 1, 2) SELECT service, CAST(min(edge) AS DOUBLE) AS p95_edge FROM c WHERE acc >= 0.95 * n GROUP BY 1")
def latency_edges(spark, sf_dir):
    """p95 as the edge of its bucket."""
    return rollups.latency(from_events(spark, sf_dir), ["service"]).select("service", F.col("p95_edge").cast("double").alias("p95_edge"))


@query(f"WITH {OBS}, v AS (SELECT service, CAST(floor(us / {DAY}) AS BIGINT) AS day, list_sort(list(ms)) AS v FROM o WHERE ms >= 0 GROUP BY 1, 2) SELECT service, day, CASE WHEN len(v) >= 20 THEN v[CAST(floor(len(v) * 0.95) AS INT)] ELSE v[-1] END AS p95 FROM v")
def small_window_p95(spark, sf_dir):
    return views.small_p95(from_events(spark, sf_dir).withColumn("day", rollups.bucket(DAY)), ["service", "day"])


@query(f"WITH {OBS} SELECT environment, count(*) AS events, count(*) FILTER (bad) AS errors, round(1 - count(*) FILTER (bad) / count(*), 9) AS availability, count(DISTINCT host) AS hosts, CAST(coalesce(list_position(['prod', 'staging', 'test', 'qa', 'dev', 'unknown'], environment), 7) AS INT) AS place FROM o GROUP BY 1")
def environment_summary(spark, sf_dir):
    return views.environments(from_events(spark, sf_dir))


@query(f"WITH {OBS} SELECT host, 'events' AS source, count(*) AS lines, count(*) FILTER (bad) AS errors, max(us) AS last_us, arg_max(message, {{'a': us, 'b': seq}}) FILTER (bad) AS last_error FROM o GROUP BY 1")
def file_table(spark, sf_dir):
    return views.files(from_events(spark, sf_dir))


@query(f"WITH {OBS} SELECT service, CAST(row_number() OVER (PARTITION BY service ORDER BY ms DESC, seq) AS INT) AS place, seq, ms FROM o WHERE ms >= 0 QUALIFY place <= 10")
def slowest_lines(spark, sf_dir):
    return views.slowest(from_events(spark, sf_dir), "service")


@query(f"WITH {OBS} SELECT host, severity, count(*) AS lines FROM o WHERE substr(sha1(template || chr(0) || service), 1, 12) = substr(sha1('error request <n> took <n>ms' || chr(0) || 'svc-error'), 1, 12) GROUP BY 1, 2")
def group_by_host(spark, sf_dir):
    """Exact counts of one message group from its counters."""
    key = text.group_key(F.lit("error request <n> took <n>ms"), F.lit("svc-error"))
    return views.group_counter(from_events(spark, sf_dir), DAY).where(F.col("group_key") == key).groupBy("host", "severity").agg(F.sum("lines").alias("lines"))


@query(f"WITH {OBS}, n AS (SELECT template, service, CAST(floor((us - {START}) / {6 * DAY}) AS BIGINT) AS bar, count(*) AS n FROM o WHERE service <> 'svc-view' GROUP BY 1, 2, 3), t AS (SELECT template, service, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY b) AS trend FROM (SELECT DISTINCT template, service FROM n) g, range(5) r(b) LEFT JOIN n ON n.template = g.template AND n.service = g.service AND n.bar = b GROUP BY ALL) SELECT o.template, o.service, count(*) AS lines, CAST(max(lvl) AS INT) AS level, CAST(count(DISTINCT host) AS INT) AS hosts, 1 AS pools, any_value(trend) AS trend FROM o JOIN t ON o.template = t.template AND o.service = t.service WHERE o.service <> 'svc-view' GROUP BY 1, 2 HAVING max(lvl) >= 2".replace("SELECT template, service, string_agg", "SELECT g.template, g.service, string_agg"))
def live_groups(spark, sf_dir):
    """Message groups that reach WARN, without one service, with a trend of five bars."""
    return views.live_groups(from_events(spark, sf_dir), 2, F.col("service") != "svc-view", START, 6 * DAY, 5)


@query(f"WITH {OBS} SELECT service, count(*) FILTER (us >= {START + 2 * WEEK}) AS lines, count(*) FILTER (us < {START + 2 * WEEK}) AS before, count(*) FILTER (us >= {START + 2 * WEEK}) - count(*) FILTER (us < {START + 2 * WEEK}) AS change FROM o WHERE us >= {START + WEEK} AND us < {START + 3 * WEEK} GROUP BY 1")
def previous_week(spark, sf_dir):
    return views.previous_period(from_events(spark, sf_dir), START + 2 * WEEK, START + 3 * WEEK, "service")


@query(f"WITH {OBS} SELECT host, count(*) AS lines FROM o WHERE us >= {(START + 10 * DAY + 30_000_000 - 2880 * MINUTE) // MINUTE * MINUTE} AND us < {START + 10 * DAY + 30_000_000} GROUP BY 1")
def last_minutes(spark, sf_dir):
    """The last two days before a moment, pinned to the first minute's beginning."""
    obs = views.within(from_events(spark, sf_dir), *views.window_of(START + 10 * DAY + 30_000_000, 2880))
    return obs.groupBy("host").agg(F.count("*").alias("lines"))


@query(f"WITH {OBS}, {_METRICS} SELECT us, host, metric, value FROM m")
def metric_samples(spark, sf_dir):
    """Metrics out of records' attributes."""
    return views.metrics_of(from_events(spark, sf_dir), METRICS).select("us", "host", "metric", "value")


@query(f"WITH {OBS}, {_METRICS}, c AS (SELECT *, CASE metric WHEN 'cpu' THEN 80.0 ELSE 90.0 END AS crit FROM l) SELECT metric, round(avg(value), 1) AS avg, round(max(value), 1) AS max, count(*) AS hosts, arg_max(host, {{'a': value, 'b': host}}) AS worst, count(*) FILTER (value >= crit - 15 AND value < crit) AS warn_n, count(*) FILTER (value >= crit) AS crit_n FROM c GROUP BY 1")
def metric_summary(spark, sf_dir):
    return views.metric_summary(views.metrics_of(from_events(spark, sf_dir), METRICS), {"cpu": 80, "memory": 90})


@query(f"WITH {OBS}, {_METRICS} SELECT CAST(floor(us / {DAY}) AS BIGINT) AS bar, host, metric, round(avg(value), 1) AS value FROM m GROUP BY 1, 2, 3")
def metric_bars(spark, sf_dir):
    return views.metric_bars(views.metrics_of(from_events(spark, sf_dir), METRICS), DAY)


@query("WITH p AS (SELECT 'p' || (c_custkey % 12) AS pool, c_custkey, c_nationkey AS bar, c_acctbal < 0 AS bad FROM customer), n AS (SELECT pool, CAST(bar AS BIGINT) AS bar, count(*) AS lines, count(*) FILTER (bad) AS errors FROM p GROUP BY 1, 2), t AS (SELECT pool FROM n GROUP BY 1 ORDER BY sum(lines) DESC, pool LIMIT 8) SELECT CASE WHEN pool IN (SELECT pool FROM t) THEN pool ELSE '~other' END AS pool, bar, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(errors) AS BIGINT) AS errors FROM n GROUP BY 1, 2")
def pool_bars(spark, sf_dir):
    """Customers as hosts of twelve pools: the largest eight by bar, and the others."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), F.col("c_custkey") % 12, F.lit("-"), F.col("c_custkey")).alias("host"), F.col("c_nationkey").cast("bigint").alias("us"), F.when(F.col("c_acctbal") < 0, "ERROR").otherwise("INFO").alias("severity"))
    return views.pool_bars(c, 1, 0)


@query(f"WITH {OBS} SELECT CAST(floor(us / {HOUR}) AS BIGINT) AS hour, environment, service, count(*) AS lines, count(*) FILTER (bad) AS errors FROM o GROUP BY 1, 2, 3")
def merged_history(spark, sf_dir):
    """Counters of two halves added to each other are those of the whole."""
    o = from_events(spark, sf_dir)
    h = views.hour_history
    return views.merged_counts(h(o.where("seq % 2 = 0")), h(o.where("seq % 2 = 1"))).select("hour", "environment", "service", "lines", "errors")


@query(f"WITH {OBS}, e AS (SELECT service, CASE WHEN ms <= 50 THEN 50 WHEN ms <= 100 THEN 100 WHEN ms <= 200 THEN 200 WHEN ms <= 300 THEN 300 WHEN ms <= 500 THEN 500 WHEN ms <= 1000 THEN 1000 WHEN ms <= 2000 THEN 2000 WHEN ms <= 5000 THEN 5000 ELSE 10000 END AS edge FROM o WHERE ms >= 0), c AS (SELECT service, edge, sum(count(*)) OVER (PARTITION BY service ORDER BY edge) AS acc, sum(count(*)) OVER (PARTITION BY service) AS n FROM e GROUP BY 1, 2), p AS (SELECT service, CAST(min(edge) AS DOUBLE) AS p95_edge FROM c WHERE acc >= 0.95 * n GROUP BY 1) SELECT service, count(*) AS lines, count(*) FILTER (bad) AS errors, round(1 - count(*) FILTER (bad) / count(*), 9) AS availability, round(greatest(0.0, 1 - (count(*) FILTER (bad) / count(*)) / 0.3), 6) AS budget_left, any_value(p95_edge) AS p95_edge FROM o JOIN p USING (service) GROUP BY 1")
def history_figures(spark, sf_dir):
    """Service levels from the hourly history alone."""
    f = views.history_figures(views.hour_history(from_events(spark, sf_dir)), ["service"], 0.7)
    return f.withColumn("p95_edge", F.col("p95_edge").cast("double"))


@query(f"WITH {OBS} SELECT service, count(*) AS lines, 100.0::DOUBLE AS timestamp, 100.0::DOUBLE AS level, 100.0::DOUBLE AS host, 100.0::DOUBLE AS service_share, round(100 * avg(CAST(user_id IS NOT NULL AND props->>'$.k' IS NOT NULL AS INT)), 2) AS attributes FROM o GROUP BY 1")
def field_coverage(spark, sf_dir):
    c = views.coverage(from_events(spark, sf_dir).withColumn("kind", F.col("service")), "kind")
    return c.select(F.col("kind").alias("service"), "lines", "timestamp", "level", "host", F.col("service").alias("service_share"), "attributes")


@query(f"WITH {OBS}, n AS (SELECT us < {START + 15 * DAY} AS a, CAST(count(*) AS DOUBLE) AS events, round(avg(CAST(bad AS INT)), 4) AS error_share, CAST(count(DISTINCT service) AS DOUBLE) AS services, CAST(count(DISTINCT host) AS DOUBLE) AS hosts, CAST(count(DISTINCT template) AS DOUBLE) AS templates FROM o GROUP BY 1), u AS (UNPIVOT n ON events, error_share, services, hosts, templates INTO NAME metric VALUE v), p AS (SELECT metric, max(v) FILTER (a) AS a, max(v) FILTER (NOT a) AS b FROM u GROUP BY 1) SELECT metric, a, b, round(b - a, 4) AS delta, round(100 * (b - a) / nullif(a, 0), 1) AS delta_pct FROM p")
def compare_figures(spark, sf_dir):
    return views.kpis(from_events(spark, sf_dir), F.when(F.col("us") < START + 15 * DAY, "a").otherwise("b"))


@query(f"WITH {OBS}, f AS (SELECT us, seq FROM o ORDER BY us DESC, seq DESC LIMIT 20), c AS (SELECT us, seq FROM f ORDER BY us, seq LIMIT 1) SELECT o.seq, o.us, o.message FROM o, c WHERE (o.us, o.seq) < (c.us, c.seq) ORDER BY o.us DESC, o.seq DESC LIMIT 20")
def second_page(spark, sf_dir):
    """The page behind the first one's last line."""
    o = from_events(spark, sf_dir)
    last = views.page(o, 20).agg(F.min(F.struct("us", "seq")).alias("c")).select("c.*").first()
    return views.page(o, 20, (last["us"], last["seq"]) if last and last["us"] is not None else None).select("seq", "us", "message")


@query(f"WITH {OBS} SELECT seq, us, severity FROM o WHERE seq > 500 ORDER BY seq LIMIT 250")
def live_tail(spark, sf_dir):
    """Lines after a sequence number, 250 at most."""
    return from_events(spark, sf_dir).where("seq > 500").orderBy("seq").limit(250).select("seq", "us", "severity")


@query("SELECT doc_id AS seq, doc_id * 1000000 AS us, substr(coalesce(text, ''), 1, 2000) AS message, length(coalesce(text, '')) > 2000 AS truncated, CASE WHEN abs(doc_id % 300 - 150) > 120 THEN doc_id % 300 - 150 END AS skew_s FROM documents")
def shown_lines(spark, sf_dir):
    """Documents as long lines, arriving up to 150 s before or after their stamp."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), (F.col("doc_id") * 1_000_000).alias("us"), F.coalesce("text", F.lit("")).alias("message"))
    return views.line_objects(d.withColumn("received_us", F.col("us") + (F.pmod("seq", F.lit(300)) - 150) * 1_000_000))


APPS = [("shop", "host", "prd-app-01"), ("shop", "host", "PRD-APP-02"), ("shop", "service", "svc-p*"), ("pay", "service", "svc-?r*"), ("pay", "service", "SVC-click"), ("none", "host", "nowhere")]


@query(f"WITH {OBS}, m AS (SELECT 'shop' AS app, seq, host, service, bad FROM o WHERE host IN ('prd-app-01', 'prd-app-02') OR service LIKE 'svc-p%' UNION ALL SELECT 'pay', seq, host, service, bad FROM o WHERE service LIKE 'svc-_r%' OR service = 'svc-click') SELECT app, count(*) AS lines, count(*) FILTER (bad) AS errors, count(DISTINCT host) AS hosts, count(DISTINCT service) AS services FROM m GROUP BY 1")
def application_lines(spark, sf_dir):
    members = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("app"), F.lit(k).alias("kind"), F.lit(n).alias("name")) for a, k, n in APPS])))
    return views.applications(from_events(spark, sf_dir), members).select("app", F.col("lines").cast("bigint").alias("lines"), F.col("errors").cast("bigint").alias("errors"), "hosts", "services")


@query("WITH c AS (SELECT DISTINCT 'o_custkey' AS name, o_custkey AS value FROM orders UNION SELECT DISTINCT 'c_custkey', c_custkey FROM customer UNION SELECT DISTINCT 'l_orderkey', l_orderkey FROM lineitem UNION SELECT DISTINCT 'o_orderkey', o_orderkey FROM orders UNION SELECT DISTINCT 's_suppkey', s_suppkey FROM supplier), n AS (SELECT name, count(*) AS n FROM c GROUP BY 1), p AS (SELECT a.name AS left_name, b.name AS right_name, count(*) AS shared FROM c a JOIN c b ON a.value = b.value AND a.name < b.name GROUP BY 1, 2) SELECT left_name, right_name, shared, round(shared / least(x.n, y.n), 4) AS share FROM p JOIN n x ON x.name = left_name JOIN n y ON y.name = right_name WHERE shared / least(x.n, y.n) >= 0.5")
def related_columns(spark, sf_dir):
    """Columns of several tables whose values overlap."""
    parts = [table(spark, sf_dir, t).select(F.lit(c).alias("name"), F.col(c).alias("value")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey"))]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return views.value_overlaps(whole)


@query(f"WITH {OBS} SELECT severity, count(*) AS seen, count(*) * 4 AS estimate FROM o WHERE us >= {START} AND us < {END} AND ((us - {START}) % {(END - START) // 60}) * 4 < {(END - START) // 60} GROUP BY 1")
def sampled_slices(spark, sf_dir):
    return views.slices(from_events(spark, sf_dir), START, END).groupBy("severity").agg(F.count("*").alias("seen"), F.sum("weight").alias("estimate"))


@query(f"WITH {OBS} SELECT count(*) AS lines, count(DISTINCT seq) AS seqs, min(us) AS lo, max(us) AS hi FROM o")
def merged_days(spark, sf_dir):
    """Overlapping day files put together again, equal lines once."""
    o = from_events(spark, sf_dir).select("seq", "us", "message")
    days = o.where(F.col("us") < START + 20 * DAY).unionByName(o.where(F.col("us") >= START + 10 * DAY)).dropDuplicates(["us", "seq"])
    return days.agg(F.count("*").alias("lines"), F.countDistinct("seq").alias("seqs"), F.min("us").alias("lo"), F.max("us").alias("hi"))


@query("SELECT l_returnflag AS flag, count(*) AS n, round((p + 1.645 * 1.645 / (2 * n1) - 1.645 * sqrt(p * (1 - p) / n1 + 1.645 * 1.645 / (4.0 * n1 * n1))) / (1 + 1.645 * 1.645 / n1), 9) AS low FROM (SELECT l_returnflag, avg(CAST(l_linestatus = 'O' AS INT)) OVER (PARTITION BY l_returnflag) AS p, count(*) OVER (PARTITION BY l_returnflag) AS n1 FROM lineitem) GROUP BY 1, p, n1")
def wilson_bounds(spark, sf_dir):
    """Lower bounds of a share by the score interval."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("k"))
    return n.select("flag", "n", F.round(stats.wilson(F.col("k"), F.col("n")), 9).alias("low"))


@query("WITH x AS (SELECT l_discount > 0.05 AS a, l_tax > 0.04 AS b FROM lineitem), s AS (SELECT avg(CAST(a = b AS INT)) AS po, avg(CAST(a AS INT)) AS pa, avg(CAST(b AS INT)) AS pb FROM x) SELECT round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END ELSE (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 9) AS kappa FROM s")
def kappa_agreement(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_discount") > 0.05).alias("a"), (F.col("l_tax") > 0.04).alias("b"))
    s = x.agg(F.count_if(F.col("a") & F.col("b")).alias("yy"), F.count_if(F.col("a") & ~F.col("b")).alias("yn"), F.count_if(~F.col("a") & F.col("b")).alias("ny"), F.count_if(~F.col("a") & ~F.col("b")).alias("nn"))
    return s.select(F.round(stats.kappa(F.col("yy"), F.col("yn"), F.col("ny"), F.col("nn")), 9).alias("kappa"))
