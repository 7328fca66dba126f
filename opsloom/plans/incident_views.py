"""Queries of the incident engine, business flows and device sessions, each with its SQL.

Orders stand for alarms of forty services on a hundred and twenty hosts: spread
over a month, with every seventh of them inside one day, many inside an hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlation, flows, graph, incidents
from ..sources.observations import MINUTE, micros, table
from .catalog import DAY, END, HOUR, START, query

_WORDS = ("slow disk write", "connection lost", "service restarted", "request refused")
_TYPES = "['" + "', '".join(_WORDS) + "']"
ALARMS = f"""al AS (SELECT o_orderkey AS seq, {START} + 1000000 * CASE WHEN o_orderkey % 7 = 0 THEN 864000 + (o_custkey % 40) * 400 + o_orderkey % 900 ELSE (o_orderkey * 7919) % 2592000 END AS us, 'svc-' || (o_custkey % 40) AS service, 'host-' || (o_custkey % 120) AS host,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'ERROR' WHEN '3' THEN 'WARN' WHEN '4' THEN 'INFO' ELSE 'DEBUG' END AS severity, {_TYPES}[o_custkey % 4 + 1] AS alarm_type FROM orders),
rw AS (SELECT *, alarm_type || ' on order ' || seq AS message, alarm_type || ' on order <n>' AS template, substr(sha1(alarm_type || ' on order <n>|' || severity || '|' || service), 1, 12) AS fingerprint, severity IN ('ERROR', 'CRITICAL') AS bad, list_position(['DEBUG', 'INFO', 'WARN', 'ERROR', 'CRITICAL'], severity) - 1 AS lvl FROM al),
dep AS (SELECT 'svc-' || i AS source, 'svc-' || (i * 3 % 40) AS target FROM range(0, 40, 5) t(i) WHERE i <> i * 3 % 40)"""
SIGNALS = f"""{ALARMS}, sp AS (SELECT greatest(1, CAST(floor((max(us) - min(us)) / {MINUTE}) AS BIGINT) + 1) AS span FROM rw), pm AS (SELECT fingerprint, CAST(floor(us / {MINUTE}) AS BIGINT) AS minute, count(*) AS n FROM rw GROUP BY 1, 2),
ms AS (SELECT fingerprint, list_sort(list(n)) AS v, max(n) AS peak, arg_min(minute, {{'a': -n, 'b': minute}}) AS peak_minute FROM pm GROUP BY 1), mz AS (SELECT *, greatest(0, span - len(v)) AS zeros, (len(v) + greatest(0, span - len(v))) // 2 AS mid FROM ms, sp), mb AS (SELECT *, CASE WHEN mid < zeros THEN 0 ELSE v[mid - zeros + 1] END AS baseline FROM mz),
so AS (SELECT fingerprint, min(minute) * {MINUTE} AS onset_us FROM pm JOIN mb USING (fingerprint) WHERE n >= greatest(1, 2 * baseline) OR minute = peak_minute GROUP BY 1),
sg AS (SELECT fingerprint, any_value(template) AS template, any_value(severity) AS severity, any_value(service) AS service, count(*) AS lines, count(DISTINCT host) AS hosts, min(us) AS first_us, max(us) AS last_us, any_value(peak) AS peak, any_value(baseline) AS baseline, any_value(onset_us) AS onset_us,
  round(CASE WHEN any_value(peak) / (any_value(baseline) + 1) > 1 THEN least(1.0, (any_value(peak) / (any_value(baseline) + 1) - 1) / 9) ELSE 0.0 END, 3) AS burst, round(((max(us) - min(us)) / {MINUTE} + 1) / any_value(span), 3) AS share FROM rw JOIN mb USING (fingerprint) JOIN so USING (fingerprint) GROUP BY 1),
j1 AS (SELECT *, share >= 0.7 AND burst < 0.3 AND lines >= 8 AS chronic FROM sg), j2 AS (SELECT *, NOT chronic AND severity = 'WARN' AND lines >= 25 AND hosts <= 2 AS sustained FROM j1), jd AS (SELECT *, NOT chronic AND (severity IN ('ERROR', 'CRITICAL') OR burst >= 0.5 OR sustained) AS interesting FROM j2)"""
_GROUPED = f"""g AS (SELECT * FROM jd WHERE interesting),
lk AS (SELECT DISTINCT x.fingerprint AS a, y.fingerprint AS b FROM g x JOIN g y ON x.fingerprint <> y.fingerprint AND greatest(x.first_us, y.first_us) - least(x.last_us, y.last_us) <= {10 * MINUTE} WHERE EXISTS (SELECT 1 FROM en p JOIN en q USING (entity) WHERE p.fingerprint = x.fingerprint AND q.fingerprint = y.fingerprint) OR EXISTS (SELECT 1 FROM dep WHERE (source = x.service AND target = y.service) OR (source = y.service AND target = x.service))),
rc(a, b) AS (SELECT fingerprint, fingerprint FROM g UNION SELECT rc.a, lk.b FROM rc JOIN lk ON lk.a = rc.b), cm AS (SELECT a AS fingerprint, min(b) AS incident FROM rc GROUP BY 1), sz AS (SELECT incident, count(*) AS members, bool_or(severity IN ('ERROR', 'CRITICAL') OR burst >= 0.5) AS strong FROM g JOIN cm USING (fingerprint) GROUP BY 1 HAVING count(*) > 1 OR bool_or(severity IN ('ERROR', 'CRITICAL') OR burst >= 0.5)),
mb2 AS (SELECT g.*, incident, members FROM g JOIN cm USING (fingerprint) JOIN sz USING (incident))"""
_FIRST = "fo AS (SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY us, seq) <= 40), en AS (SELECT DISTINCT fingerprint, service AS entity FROM fo UNION SELECT fingerprint, host FROM fo)"
# Entities of all alarms of a signal; those of its first forty.
WHOLE = f"{SIGNALS}, en AS (SELECT DISTINCT fingerprint, service AS entity FROM rw UNION SELECT fingerprint, host FROM rw), {_GROUPED}"
INCIDENTS = f"{SIGNALS}, {_FIRST}, {_GROUPED}"


def alarms_of(spark, sf_dir) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    second = F.when(key % 7 == 0, 864_000 + (cust % 40) * 400 + key % 900).otherwise((key * 7919) % 2_592_000)
    level = F.substring("o_orderpriority", 1, 1)
    kind = F.element_at(F.array(*map(F.lit, _WORDS)), (cust % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"), (F.lit(START) + second * 1_000_000).alias("us"), F.concat(F.lit("svc-"), cust % 40).alias("service"), F.concat(F.lit("host-"), cust % 120).alias("host"),
        F.when(level == "1", "CRITICAL").when(level == "2", "ERROR").when(level == "3", "WARN").when(level == "4", "INFO").otherwise("DEBUG").alias("severity"),
        kind.alias("alarm_type"), F.concat(kind, F.lit(" on order "), key).alias("message"),
    )


def dependencies_of(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(0, 40, 5).where(i != i * 3 % 40).select(F.concat(F.lit("svc-"), i).alias("source"), F.concat(F.lit("svc-"), i * 3 % 40).alias("target"))


def _engine(spark, sf_dir, first=None):
    rows = correlation.fingerprinted(alarms_of(spark, sf_dir))
    s, e, d = correlation.signals(rows), correlation.signal_entities(rows, first), dependencies_of(spark)
    return rows, s, e, d


@query(f"WITH {SIGNALS} SELECT fingerprint, template, severity, service, lines, hosts, first_us, last_us, peak, baseline, onset_us, burst, share, chronic, sustained, interesting FROM jd")
def signals(spark, sf_dir):
    """Signals with burst, onset and what they are judged to be."""
    return correlation.judged(_engine(spark, sf_dir)[1])


@query(f"WITH {ALARMS}, fo AS (SELECT * FROM rw QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY us, seq) <= 40) SELECT DISTINCT fingerprint, service AS entity FROM fo UNION SELECT fingerprint, host FROM fo")
def signal_entities(spark, sf_dir):
    return _engine(spark, sf_dir, correlation.ENTITY_SAMPLE)[2]


@query(f"WITH RECURSIVE {INCIDENTS} SELECT fingerprint, incident, members FROM mb2")
def incident_members(spark, sf_dir):
    """Signals put together to incidents."""
    _, s, e, d = _engine(spark, sf_dir, correlation.ENTITY_SAMPLE)
    return correlation.incidents(s, e, d).select("fingerprint", "incident", "members")


@query(f"""WITH RECURSIVE {WHOLE}, fn AS (SELECT x.fingerprint, count(DISTINCT y.fingerprint) AS fan FROM mb2 x JOIN mb2 y ON x.incident = y.incident AND x.fingerprint <> y.fingerprint JOIN en p ON p.fingerprint = x.fingerprint JOIN en q ON q.fingerprint = y.fingerprint AND p.entity = q.entity GROUP BY 1),
pr AS (SELECT x.fingerprint, count(DISTINCT y.fingerprint) AS n FROM mb2 x JOIN mb2 y ON x.incident = y.incident AND x.fingerprint <> y.fingerprint JOIN dep ON dep.source = y.service AND dep.target = x.service GROUP BY 1), co AS (SELECT x.fingerprint, count(DISTINCT y.fingerprint) AS n FROM mb2 x JOIN mb2 y ON x.incident = y.incident AND x.fingerprint <> y.fingerprint JOIN dep ON dep.source = x.service AND dep.target = y.service GROUP BY 1),
sc AS (SELECT m.incident, m.fingerprint, m.onset_us, coalesce(fan, 0) AS fan, coalesce(pr.n, 0) AS provider, coalesce(co.n, 0) AS consumer, round(-((m.onset_us - min(m.onset_us) OVER (PARTITION BY m.incident)) / {MINUTE}) * 3 + CASE WHEN template LIKE '%disk%' OR template LIKE '%slow%' OR template LIKE '%connection%' THEN 1.5 ELSE 0 END + coalesce(fan, 0) * 0.3 + CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END * 0.3 + coalesce(pr.n, 0) * 2.0 - coalesce(co.n, 0) * 1.0, 2) AS cause_score FROM mb2 m LEFT JOIN fn USING (fingerprint) LEFT JOIN pr USING (fingerprint) LEFT JOIN co USING (fingerprint))
SELECT incident, fingerprint, cause_score, CAST(row_number() OVER (PARTITION BY incident ORDER BY cause_score DESC, onset_us, fingerprint) AS INT) AS place, fan, provider, consumer FROM sc QUALIFY place <= 4""")
def root_causes(spark, sf_dir):
    """The likeliest cause of each incident and three alternatives."""
    _, s, e, d = _engine(spark, sf_dir)
    e = graph.written(e)
    return correlation.root_causes(correlation.incidents(s, e, d), e, d).where("place <= 4").select("incident", "fingerprint", "cause_score", "place", F.col("fan").cast("bigint").alias("fan"), F.col("provider").cast("bigint").alias("provider"), F.col("consumer").cast("bigint").alias("consumer"))


@query(f"""WITH RECURSIVE {INCIDENTS}, ow AS (SELECT rw.*, incident FROM rw JOIN mb2 USING (fingerprint)), pk AS (SELECT incident, max(n) AS peak FROM (SELECT incident, us // {MINUTE} AS minute, count(*) AS n FROM ow GROUP BY 1, 2) GROUP BY 1), ho AS (SELECT incident, count(DISTINCT host) AS n_hosts FROM ow GROUP BY 1), fl AS (SELECT greatest(6.0, 0.5 * (count(DISTINCT service) + count(DISTINCT host))) AS dn FROM rw),
im AS (SELECT incident, count(*) AS members, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN lines ELSE 0 END) AS BIGINT) AS errors, min(first_us) AS start_us, max(last_us) AS end_us, max(baseline) AS baseline, count(DISTINCT service) AS n_services, bool_or(severity = 'CRITICAL') AS critical FROM mb2 GROUP BY 1),
sr AS (SELECT *, round(round(0.35 * round(CASE WHEN peak / (baseline + 1.0) > 1 THEN least(1.0, (peak / (baseline + 1.0) - 1) / 9) ELSE 0.0 END, 3), 3) + round(0.25 * (errors / lines), 3) + round(0.25 * least(1.0, (n_services + n_hosts) / dn), 3) + round(0.15 * least(1.0, (end_us - start_us) / 3600000000.0), 3), 3) AS score FROM im JOIN pk USING (incident) JOIN ho USING (incident), fl)
SELECT incident, members, lines, errors, start_us, end_us, n_services, n_hosts, score, CASE WHEN score >= 0.6 OR critical THEN 'critical' WHEN score >= 0.4 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM sr""")
def incident_scores(spark, sf_dir):
    rows, s, e, d = _engine(spark, sf_dir, correlation.ENTITY_SAMPLE)
    return correlation.scored(rows, correlation.incidents(s, e, d))


@query(f"""WITH RECURSIVE {WHOLE}, ow AS (SELECT rw.*, incident FROM rw JOIN mb2 USING (fingerprint)), t AS (SELECT incident, min(us) AS first_us, coalesce(max(us) FILTER (bad), max(us)) AS last_error_us FROM ow GROUP BY 1), nm AS (SELECT DISTINCT incident, service AS name FROM ow UNION SELECT DISTINCT incident, host FROM ow),
fd AS (SELECT incident, min(us) FILTER (us >= first_us AND us <= last_error_us + {10 * MINUTE} AND message LIKE '%restarted%') AS restart_us, min(us) FILTER (us > last_error_us AND lvl < 2) AS normal_us FROM rw JOIN nm ON name = service OR name = host JOIN t USING (incident) GROUP BY 1)
SELECT incident, first_us, last_error_us, CASE WHEN (SELECT max(us) FROM rw) - last_error_us < {2 * MINUTE} THEN 'ongoing' WHEN restart_us IS NOT NULL THEN 'restart' WHEN normal_us IS NOT NULL THEN 'self_healed' ELSE 'stopped' END AS kind, coalesce(restart_us, normal_us) AS recovered_us FROM t LEFT JOIN fd USING (incident)""")
def incident_recoveries(spark, sf_dir):
    rows, s, e, d = _engine(spark, sf_dir)
    return correlation.recoveries(rows, correlation.incidents(s, e, d))


@query(f"WITH RECURSIVE {WHOLE} SELECT 'raw' AS step, count(*) AS n FROM rw UNION ALL SELECT 'fingerprints', count(*) FROM jd UNION ALL SELECT 'meaningful', count(*) FROM jd WHERE interesting UNION ALL SELECT 'incidents', count(DISTINCT incident) FROM mb2")
def noise_funnel(spark, sf_dir):
    rows, s, e, d = _engine(spark, sf_dir)
    return correlation.noise_funnel(rows, s, correlation.incidents(s, e, d))


_CELLS = f"""{ALARMS}, cl AS (SELECT service, CAST(floor(us / {5 * MINUTE}) AS BIGINT) AS bar, count(*) AS n FROM rw GROUP BY 1, 2), nb AS (SELECT CAST(floor(max(us) / {5 * MINUTE}) - floor(min(us) / {5 * MINUTE}) + 1 AS BIGINT) AS bars FROM rw), md AS (SELECT service, CASE WHEN count(*) * 2 < any_value(bars) THEN 0.0 ELSE median(n) END AS m FROM cl, nb GROUP BY 1), hc AS (SELECT service, bar, n FROM cl JOIN md USING (service) WHERE n >= greatest(4.0, 3 * m)),
ad AS (SELECT x.service AS s1, x.bar AS b1, y.service AS s2, y.bar AS b2 FROM hc x JOIN hc y ON abs(x.bar - y.bar) <= 1 AND (x.service, x.bar) <> (y.service, y.bar) AND (x.service = y.service OR EXISTS (SELECT 1 FROM dep WHERE (source = x.service AND target = y.service) OR (source = y.service AND target = x.service)))),
re(s, b, t) AS (SELECT service, bar, lpad(CAST(bar AS VARCHAR), 12, '0') || '@' || service FROM hc UNION SELECT ad.s2, ad.b2, re.t FROM re JOIN ad ON ad.s1 = re.s AND ad.b1 = re.b), cu AS (SELECT s AS service, b AS bar, min(t) AS cluster FROM re GROUP BY 1, 2)"""


@query(f"WITH {_CELLS.split(',' + chr(10) + 'ad AS')[0]} SELECT service, bar, n FROM hc")
def hot_alarm_cells(spark, sf_dir):
    """Five-minute cells with three times a service's median, four alarms at least."""
    return incidents.hot_cells(alarms_of(spark, sf_dir), "service").select("service", "bar", "n")


@query(f"WITH RECURSIVE {_CELLS} SELECT service, bar, cluster FROM cu")
def storm_clusters(spark, sf_dir):
    cells = incidents.hot_cells(alarms_of(spark, sf_dir), "service")
    return correlation.storm_clusters(cells, dependencies_of(spark))


_STORM = f"""{_CELLS}, ss AS (SELECT cluster, min(bar) * {5 * MINUTE} - {2 * MINUTE} AS lo, (max(bar) + 1) * {5 * MINUTE} + {2 * MINUTE} AS hi FROM cu GROUP BY 1), sm AS (SELECT seq, min(cluster) AS cluster FROM rw JOIN (SELECT DISTINCT cluster, service FROM cu) USING (service) JOIN ss USING (cluster) WHERE us >= lo AND us <= hi GROUP BY 1)"""


@query(f"WITH RECURSIVE {_STORM} SELECT seq, cluster FROM sm")
def storm_members(spark, sf_dir):
    obs = alarms_of(spark, sf_dir)
    clusters = correlation.storm_clusters(incidents.hot_cells(obs, "service"), dependencies_of(spark))
    return correlation.storm_members(obs, clusters, 5 * MINUTE, 0)


@query(f"WITH RECURSIVE {_STORM}, tm AS (SELECT greatest(1.0, (max(us) - min(us)) / {MINUTE}) AS minutes FROM rw), ra AS (SELECT service, alarm_type, count(*) AS overall FROM rw GROUP BY 1, 2), oc AS (SELECT cluster, service, alarm_type, count(*) AS n FROM rw JOIN sm USING (seq) GROUP BY 1, 2, 3) SELECT seq, cluster FROM rw JOIN sm USING (seq) JOIN oc USING (cluster, service, alarm_type) JOIN ra USING (service, alarm_type) JOIN ss USING (cluster), tm WHERE n >= greatest(2.0, 2 * overall * ((hi - lo) / {MINUTE}) / minutes) OR bad")
def pruned_members(spark, sf_dir):
    """Storm members without the alarms that run at their normal rate."""
    obs = alarms_of(spark, sf_dir)
    clusters = correlation.storm_clusters(incidents.hot_cells(obs, "service"), dependencies_of(spark))
    members = correlation.storm_members(obs, clusters, 5 * MINUTE, 0)
    spans = clusters.groupBy("cluster").agg(((F.max("bar") + 1 - F.min("bar")) * 5 + 4).cast("double").alias("span_min"))
    return correlation.elevated(obs, members, spans)


FLOW = f"""ln AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) AS us, 'order ' || o_orderkey || ' created' AS message, 'INFO' AS severity FROM orders UNION ALL SELECT l_orderkey, epoch_us(l_shipdate), CASE WHEN l_returnflag = 'R' AND l_linenumber > 2 THEN 'order ' || l_orderkey || ' refused' WHEN l_linenumber = 1 THEN 'order ' || l_orderkey || ' packed' ELSE 'order ' || l_orderkey || ' shipped' END, CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'INFO' END FROM lineitem),
st AS (SELECT CAST(k AS VARCHAR) AS key, CASE WHEN message LIKE '%created' THEN 0 WHEN message LIKE '%packed' THEN 1 WHEN message LIKE '%shipped' THEN 2 WHEN severity = 'ERROR' THEN -1 END AS step, us, severity = 'ERROR' AS error FROM ln), ev AS (SELECT key, step, min(us) AS us, bool_or(error) AS error FROM st WHERE step IS NOT NULL GROUP BY 1, 2)"""
KEY, STEPS = r"order (\d+)", ["created", "packed", "shipped"]


def order_lines(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(micros("o_orderdate").alias("us"), F.concat(F.lit("order "), "o_orderkey", F.lit(" created")).alias("message"), F.lit("INFO").alias("severity"))
    li = table(spark, sf_dir, "lineitem")
    word = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 2), " refused").when(F.col("l_linenumber") == 1, " packed").otherwise(" shipped")
    return o.unionByName(li.select(micros("l_shipdate").alias("us"), F.concat(F.lit("order "), "l_orderkey", word).alias("message"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("INFO").alias("severity")))


@query(f"WITH {FLOW} SELECT key, step, us, error FROM ev")
def flow_events(spark, sf_dir):
    """Steps of orders read out of their log lines."""
    return flows.flow_events(order_lines(spark, sf_dir), KEY, STEPS)


_ITEMS = f"""{FLOW}, it AS (SELECT key, max(step) AS last_step, count(*) FILTER (step >= 0) AS steps_done, bool_or(error) AS error, max(us) FILTER (step = -1) AS fail_us, arg_max(us, step) AS last_us FROM ev GROUP BY 1), bf AS (SELECT it.key, max(ev.step) AS b FROM it JOIN ev ON ev.key = it.key AND ev.step >= 0 AND ev.us <= it.fail_us GROUP BY 1),
im AS (SELECT it.key, last_step, steps_done, error, last_step BETWEEN 0 AND 1 AND {END} - last_us > {40 * DAY} AS stuck, last_step = 2 AS done, CAST(CASE WHEN fail_us IS NOT NULL THEN least(2, coalesce(b + 1, 0)) END AS INT) AS failed_at, {END} - last_us AS waited_us FROM it LEFT JOIN bf USING (key))"""


@query(f"WITH {_ITEMS} SELECT key, last_step, steps_done, error, stuck, done, failed_at, waited_us FROM im")
def flow_items(spark, sf_dir):
    """Each order's place in the flow, and where it failed."""
    limits = spark.range(2).select(F.col("id").cast("int").alias("step"), F.lit(40.0 * DAY).alias("limit_us"))
    return flows.flow_items(flows.flow_events(order_lines(spark, sf_dir), KEY, STEPS), 3, END, limits)


@query(f"WITH {FLOW}, tp AS (SELECT CAST(k AS VARCHAR) AS key, regexp_replace(message, '[0-9]+', '<n>') AS template, min(us) AS us FROM ln GROUP BY 1, 2), pl AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, template) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM tp) SELECT template, count(*) AS keys, round(median(place / greatest(1, n - 1)), 3) AS position FROM pl GROUP BY 1 HAVING count(*) >= 2")
def suggested_steps(spark, sf_dir):
    return flows.suggested_steps(order_lines(spark, sf_dir), KEY)


@query(f"WITH {_ITEMS}, gp AS (SELECT a.step, list_sort(list(b.us - a.us)) AS v FROM ev a JOIN ev b ON a.key = b.key AND a.step >= 0 AND b.step = a.step + 1 GROUP BY 1), pp AS (SELECT step, CAST(v[least(len(v), CAST(floor(len(v) * 0.95) AS INT) + 1)] AS DOUBLE) AS p95 FROM gp) SELECT last_step AS step, count(*) AS stuck, max(waited_us) AS oldest_us FROM im LEFT JOIN pp ON step = last_step WHERE stuck GROUP BY 1, p95 HAVING count(*) >= 20 OR coalesce(max(waited_us) > 2 * p95, false)")
def stuck_steps(spark, sf_dir):
    events = flows.flow_events(order_lines(spark, sf_dir), KEY, STEPS)
    limits = spark.range(2).select(F.col("id").cast("int").alias("step"), F.lit(40.0 * DAY).alias("limit_us"))
    gaps = events.where("step >= 0").alias("a").join(events.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("b.step") == F.col("a.step") + 1)).select(F.col("a.step").alias("step"), (F.col("b.us") - F.col("a.us")).alias("gap"))
    return flows.stuck_steps(flows.flow_items(events, 3, END, limits), gaps.groupBy("step").agg(flows.nearest_rank("gap", 0.95).alias("p95_us")))


DEVICE = f"""dv AS (SELECT user_id || '/' || CAST(floor(epoch_us(ts) / {DAY}) AS BIGINT) AS session, 'app' || (user_id % 3) AS app, CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'android' END AS platform, user_id AS user, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'action' WHEN 'purchase' THEN 'http' WHEN 'error' THEN CASE WHEN value >= 200 THEN 'crash' ELSE 'error' END ELSE 'start' END AS kind, value AS dur_ms FROM events),
ds AS (SELECT session, app, platform, max(user) AS user, min(us) AS first_us, CAST(max(us + coalesce(dur_ms, 0.0) * 1000) AS DOUBLE) AS last_d, count(*) FILTER (kind = 'view') AS views, count(*) FILTER (kind = 'action') AS actions, count(*) FILTER (kind = 'http') AS requests, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'crash') AS crashes FROM dv GROUP BY 1, 2, 3)"""


def device_events(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id"), F.lit("/"), F.floor(micros("ts") / DAY)).alias("session"), F.concat(F.lit("app"), F.col("user_id") % 3).alias("app"), F.when(F.col("user_id") % 2 == 0, "web").otherwise("android").alias("platform"), F.col("user_id").alias("user"), micros("ts").alias("us"),
        F.when(kind == "view", "view").when(kind == "click", "action").when(kind == "purchase", "http").when(kind == "error", F.when(F.col("value") >= 200, "crash").otherwise("error")).otherwise("start").alias("kind"), F.col("value").alias("dur_ms"),
    )


@query(f"WITH {DEVICE} SELECT session, app, platform, user, first_us, CAST(floor(last_d) AS BIGINT) AS last_us, views, actions, requests, errors, crashes FROM ds")
def device_sessions(spark, sf_dir):
    return flows.device_sessions(device_events(spark, sf_dir))


@query(f"WITH {DEVICE} SELECT app, platform, count(*) AS sessions, count(DISTINCT user) AS users, CAST(sum(views) AS BIGINT) AS views, CAST(sum(actions) AS BIGINT) AS actions, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(crashes) AS BIGINT) AS crashes, round(1 - count(*) FILTER (crashes > 0) / count(*), 4) AS crash_free, round(1 - count(*) FILTER (errors > 0 OR crashes > 0) / count(*), 4) AS error_free FROM ds GROUP BY 1, 2")
def device_overview(spark, sf_dir):
    return flows.device_overview(flows.device_sessions(device_events(spark, sf_dir)))


@query(f"WITH {DEVICE}, vs AS (SELECT app, CASE kind WHEN 'view' THEN 'lcp' WHEN 'http' THEN 'ttfb' END AS vital, dur_ms * 30 AS value FROM dv WHERE kind IN ('view', 'http')), vv AS (SELECT app, vital, list_sort(list(value)) AS v FROM vs WHERE value IS NOT NULL GROUP BY 1, 2), vp AS (SELECT app, vital, v[CAST(floor(len(v) * 0.75) AS INT) + 1] AS p75, CAST(len(v) AS BIGINT) AS n FROM vv) SELECT app, vital, p75, n, CASE WHEN p75 <= CASE vital WHEN 'lcp' THEN 2500 ELSE 800 END THEN 'good' WHEN p75 > CASE vital WHEN 'lcp' THEN 4000 ELSE 1800 END THEN 'poor' ELSE 'needs' END AS grade FROM vp")
def web_vitals(spark, sf_dir):
    d = device_events(spark, sf_dir).where("kind IN ('view', 'http')")
    return flows.vitals(d.select("app", F.when(F.col("kind") == "view", "lcp").otherwise("ttfb").alias("vital"), (F.col("dur_ms") * 30).alias("value")))


@query(f"WITH {DEVICE}, sv AS (SELECT app, kind AS step, list_sort(list(dur_ms)) AS v FROM dv WHERE kind IN ('view', 'action') GROUP BY 1, 2 HAVING count(*) >= 2) SELECT app, step, CAST(len(v) AS BIGINT) AS n, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS p50, v[CAST(floor(len(v) * 0.75) AS INT) + 1] AS p75, v[CAST(floor(len(v) * 0.95) AS INT) + 1] AS p95 FROM sv")
def slow_device_steps(spark, sf_dir):
    d = device_events(spark, sf_dir).where("kind IN ('view', 'action')")
    return flows.slow_steps(d.select("app", F.col("kind").alias("step"), F.col("dur_ms").alias("duration_ms")))
