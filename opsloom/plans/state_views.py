"""Queries of spans out of lines, templates, states and learned profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, learning, mining, spans, states
from ..sources.observations import MINUTE, from_events, table
from .catalog import HOUR, OBS, START, query

_LINE_SPANS = f"""{OBS}, v AS (SELECT *, CAST(round(value) AS BIGINT) AS n, lpad(CAST(user_id AS VARCHAR), 8, '0') AS u FROM o),
ls AS (SELECT seq, 't' || u AS trace_id, CAST(seq AS VARCHAR) AS span_id, NULL AS parent_id, us AS start_us, n::DOUBLE AS duration_ms, true AS has_duration, service, 'GET /u/{{id}}/k/{{id}}' AS operation, 'server' AS kind, 200 AS status, false AS error, environment, host, '' AS user_ref, '' AS session_id, 'explicit' AS link, 1.0::DOUBLE AS confidence, 'click request' AS message, severity FROM v WHERE event_type = 'click'
  UNION ALL SELECT seq, 'r' || seq, NULL, NULL, us, n * 1000.0, n <= 86400, service, '/render view', 'client', 0, false, environment, host, '', '', 'explicit', 1.0, 'view ' || seq, severity FROM v WHERE event_type = 'view'
  UNION ALL SELECT seq, NULL, NULL, NULL, us, 0.0, false, service, 'sso login' || CASE WHEN value >= 150 THEN '_error' ELSE '' END || ' → shop', 'user', 0, value >= 150, environment, host, '', 'sso:s' || user_id, 'session', 0.7, 'sign on', severity FROM v WHERE event_type = 'purchase'
  UNION ALL SELECT seq, '0123456789abcdef00000000' || u, NULL, '00000000' || u, us, n::DOUBLE, true, service, 'select k from t where id=<n> took <n>ms', 'db', 0, true, environment, host, '', '', 'explicit', 1.0, 'select k from t where id=' || user_id || ' took ' || n || ' ms', severity FROM v WHERE event_type = 'error'
  UNION ALL SELECT seq, 'req-000' || seq, NULL, NULL, us, n::DOUBLE, true, service, 'POST /signup/{{id}}/done', 'server', 0, false, environment, host, '', '', 'explicit', 1.0, 'POST /signup/' || seq || '/done took ' || n || ' ms request_id=req-000' || seq, severity FROM v WHERE event_type = 'signup')"""
_SPAN_COLUMNS = "seq, trace_id, span_id, parent_id, start_us, duration_ms, has_duration, service, operation, kind, status, error, environment, host, user_ref, session_id, link, confidence, message, severity"


def lines_of(spark, sf_dir):
    """The event table as lines with the attributes that a source of each kind writes."""
    obs = from_events(spark, sf_dir, deal=True)
    kind, n, user = F.substring("service", 5, 20), F.round("value").cast("bigint").cast("string"), F.lpad(F.col("user_id").cast("string"), 8, "0")
    seq = F.col("seq").cast("string")
    pairs = lambda *kv: F.create_map(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)])
    attributes = (
        F.when(kind == "click", pairs("TraceId", F.concat(F.lit("t"), user), "Span.Id", seq, "duration", F.concat(n, F.lit("ms")), "Method", F.lit("GET"), "path", F.concat(F.lit("/u/"), F.col("user_id"), F.lit("/k/"), F.col("attributes")["k"], F.lit("?x=1")), "Status", F.lit("200")))
        .when(kind == "view", pairs("X-Request-Id", F.concat(F.lit("r"), seq), "elapsed_s", n, "span.name", F.lit("render view"), "peer.service", F.lit("db")))
        .when(kind == "purchase", pairs("clientId", F.lit("shop"), "type", F.when(F.col("value") >= 150, "login_error").otherwise("login"), "session_state", F.concat(F.lit("s"), F.col("user_id"))))
        .when(kind == "error", pairs("traceparent", F.concat(F.lit("00-0123456789abcdef00000000"), user, F.lit("-00000000"), user, F.lit("-01")), "db.statement", F.lit("select")))
    )
    message = (
        F.when(kind == "click", "click request").when(kind == "view", F.concat(F.lit("view "), seq)).when(kind == "purchase", "sign on")
        .when(kind == "error", F.concat(F.lit("select k from t where id="), F.col("user_id"), F.lit(" took "), n, F.lit(" ms")))
        .otherwise(F.concat(F.lit("POST /signup/"), seq, F.lit("/done took "), n, F.lit(" ms request_id=req-000"), seq))
    )
    return obs.withColumn("attributes", attributes).withColumn("message", message)


@query(f"WITH {_LINE_SPANS} SELECT {_SPAN_COLUMNS} FROM ls")
def line_spans(spark, sf_dir):
    """The span of every line that has one."""
    return spans.spans_of_lines(lines_of(spark, sf_dir))


_BUCKETS = ", ".join(f"count(*) FILTER (b = {i})" for i in range(23))


@query(f"WITH {_LINE_SPANS}, t AS (SELECT *, len(list_filter([1,2,5,10,20,50,100,200,300,500,750,1000,1500,2000,3000,5000,7500,10000,20000,30000,60000,120000], lambda x: x < duration_ms)) AS b FROM ls WHERE has_duration AND kind <> 'log') SELECT start_us // {HOUR} AS bar, service, operation, kind, environment, count(*) AS calls, count(*) FILTER (error) AS errors, round(sum(duration_ms), 3) AS total_ms, max(duration_ms) AS max_ms, [{_BUCKETS}] AS h FROM t GROUP BY 1, 2, 3, 4, 5")
def line_span_rollup(spark, sf_dir):
    """Calls, errors, time and histogram of each hour, service, operation, kind and environment."""
    return spans.rollup(spans.spans_of_lines(lines_of(spark, sf_dir)), HOUR)


@query(f"WITH {_LINE_SPANS}, t AS (SELECT start_us // {HOUR} AS bar, service, kind, environment, duration_ms, error FROM ls WHERE has_duration AND kind <> 'log') SELECT bar, service, kind, environment, 2 * count(*) AS calls, 2 * count(*) FILTER (error) AS errors, round(2 * sum(duration_ms), 3) AS total_ms FROM t GROUP BY 1, 2, 3, 4")
def merged_rollups(spark, sf_dir):
    """Two sources of the same rollup merged; their histograms add up to all calls."""
    # Bars and operations are few beside lines; written, they are worked out once for both sources.
    r = graph.written(spans.rollup(spans.spans_of_lines(lines_of(spark, sf_dir)), HOUR))
    m = spans.merge_rollups(r, r).where(F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x) == F.col("calls"))
    return m.groupBy("bar", "service", "kind", "environment").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.round(F.sum("total_ms"), 3).alias("total_ms"))


@query(f"""WITH {_LINE_SPANS}, c AS (SELECT trace_id, min(start_us) AS t FROM ls WHERE trace_id IS NOT NULL AND error AND link = 'explicit' GROUP BY 1)
SELECT seq, trace_id FROM ls LEFT JOIN c USING (trace_id) WHERE error OR duration_ms >= 1000 OR kind = 'user' OR start_us >= t - {2 * MINUTE} OR CAST('0x' || substr(sha1(trace_id), 1, 8) AS BIGINT) % 10000 < 1000""")
def kept_line_spans(spark, sf_dir):
    """Tail sampling: a trace is claimed by an explicit failure, a slow span keeps itself alone."""
    s = spans.spans_of_lines(lines_of(spark, sf_dir))
    return spans.kept(s, 10, 1000, F.col("error") & (F.col("link") == "explicit"), "start_us", 2 * MINUTE).select("seq", "trace_id")


#: An hour of the table counts as a minute, so that evaluations follow each other closely enough.
_VALUES = f"v AS (SELECT host, {START} + {MINUTE} * ((us - {START}) // {HOUR}) AS us, round(avg(value), 6) AS value FROM o GROUP BY 1, 2)"
_WARN, _CRIT, _WAIT, _COOL = 40.0, 90.0, 1, 4


def values_of(spark, sf_dir):
    minute = (F.lit(START) + MINUTE * F.floor((F.col("us") - START) / HOUR)).alias("us")
    v = from_events(spark, sf_dir).groupBy("host", minute).agg(F.round(F.avg("value"), 6).alias("value"))
    return v.select("host", F.lit("latency").alias("metric"), "us", "value", F.lit(_WARN).alias("warn"), F.lit(_CRIT).alias("crit"), F.lit(_WAIT).alias("for_min"), F.lit(_COOL).alias("cooldown_min"), F.lit(True).alias("tell_resolved"))


_STATES = f"""{OBS}, {_VALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, value) AS k FROM v),
s(host, k, us, value, level, status, since_us, told, told_at, notice) AS (SELECT DISTINCT host, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, 'ok', 'ok', NULL::BIGINT, '', NULL::BIGINT, '' FROM r UNION ALL
  SELECT host, k, us, value, level, CASE WHEN waits THEN 'pending' ELSE level END, since, CASE WHEN notice IN ('warn', 'crit') THEN notice ELSE told END, CASE WHEN notice IN ('warn', 'crit') THEN us ELSE told_at END, notice FROM (
    SELECT *, CASE WHEN level = 'ok' THEN CASE WHEN was <> 'ok' AND told0 <> '' THEN 'resolved' ELSE '' END WHEN waits THEN '' WHEN told = '' OR (told = 'warn' AND level = 'crit') OR us - told_at >= {_COOL * MINUTE} THEN level ELSE '' END AS notice FROM (
      SELECT *, CASE WHEN turns OR since0 IS NULL THEN us ELSE since0 END AS since, CASE WHEN turns THEN '' ELSE told0 END AS told, CASE WHEN turns THEN NULL ELSE told_at0 END AS told_at, level <> 'ok' AND us - (CASE WHEN turns OR since0 IS NULL THEN us ELSE since0 END) < {_WAIT * MINUTE} AS waits FROM (
        SELECT *, (level = 'ok') <> (was = 'ok') AS turns FROM (
          SELECT *, CASE WHEN raw = 'ok' AND was <> 'ok' AND value >= {_WARN} * 0.95 THEN was ELSE raw END AS level FROM (
            SELECT r.host, r.k, r.us, r.value, CASE WHEN r.value >= {_CRIT} THEN 'crit' WHEN r.value >= {_WARN} THEN 'warn' ELSE 'ok' END AS raw, CASE WHEN s.level <> 'ok' AND r.us - s.us > {15 * MINUTE} THEN 'ok' ELSE s.level END AS was,
              CASE WHEN s.level <> 'ok' AND r.us - s.us > {15 * MINUTE} THEN r.us ELSE s.since_us END AS since0, s.told AS told0, s.told_at AS told_at0 FROM s JOIN r ON r.host = s.host AND r.k = s.k + 1)))))),
st AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY host ORDER BY us, value), 'ok') AS was FROM s WHERE k > 0)"""


@query(f"WITH RECURSIVE {_STATES} SELECT host, 'latency' AS metric, us, value, level, status, since_us, CAST(CASE level WHEN 'crit' THEN {_CRIT} ELSE {_WARN} END AS DOUBLE) AS bound, notice FROM st")
def threshold_states(spark, sf_dir):
    """Each host's state after each value, with its notices."""
    return states.threshold_states(values_of(spark, sf_dir))


@query(f"WITH RECURSIVE {_STATES} SELECT host, us, was, status, notice FROM st WHERE status <> was OR notice <> ''")
def threshold_transitions(spark, sf_dir):
    """What changed, and what was told."""
    return states.transitions(states.threshold_states(values_of(spark, sf_dir))).select("host", "us", "was", "status", "notice")


_LIVES = f"""{OBS}, e AS (SELECT host AS key, us, seq, value AS score, CASE WHEN event_type = 'error' THEN 'seen' WHEN event_type = 'view' THEN 'clear' WHEN event_type = 'signup' THEN 'step' WHEN user_id % 5 = 0 THEN 'resolved' WHEN user_id % 5 = 1 THEN 'ignored' WHEN user_id % 5 = 2 THEN 'open' END AS event FROM o),
f AS (SELECT *, coalesce(sum(CASE WHEN event IN ('resolved', 'ignored') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e WHERE event IS NOT NULL),
b AS (SELECT key, ended, min(us) FILTER (event = 'seen') AS first_us, max(us) FILTER (event = 'seen') AS last_us, count(*) FILTER (event = 'seen') AS hits, arg_max(score, us) FILTER (event = 'seen') AS score FROM f GROUP BY 1, 2 HAVING count(*) FILTER (event = 'seen') > 0),
g AS (SELECT f.* FROM f JOIN b USING (key, ended) WHERE f.us >= first_us), x AS (SELECT key, ended, max(us) FILTER (event IN ('open', 'ack', 'resolved', 'ignored')) AS said_us FROM g GROUP BY 1, 2),
y AS (SELECT x.key, x.ended, arg_max(event, us) FILTER (event <> 'step' AND us = said_us) AS said, min(us) FILTER (event = 'step' AND us > coalesce(said_us, 0)) AS step_us, any_value(said_us) AS said_us FROM x JOIN g ON g.key = x.key AND g.ended = x.ended AND event IN ('open', 'ack', 'resolved', 'ignored', 'step') GROUP BY 1, 2)"""


@query(f"WITH {_LIVES} SELECT b.key, row_number() OVER (PARTITION BY b.key ORDER BY b.ended) AS life, first_us, last_us, hits, score, (SELECT min(us) FROM g WHERE g.key = b.key AND g.ended = b.ended AND event = 'clear' AND us > last_us) AS cleared_us, CASE WHEN coalesce(said, 'open') = 'open' AND step_us IS NOT NULL THEN 'ack' ELSE coalesce(said, 'open') END AS status, CASE WHEN coalesce(said, 'open') = 'open' AND step_us IS NOT NULL THEN step_us ELSE said_us END AS status_us FROM b LEFT JOIN y USING (key, ended)")
def anomaly_lives(spark, sf_dir):
    """Events of anomalies - found, cleared, acknowledged, ended - as one row for each life."""
    kind, user = F.substring("service", 5, 20), F.col("user_id") % 5
    event = F.when(kind == "error", "seen").when(kind == "view", "clear").when(kind == "signup", "step").when(user == 0, "resolved").when(user == 1, "ignored").when(user == 2, "open")
    e = from_events(spark, sf_dir).select(F.col("host").alias("key"), "us", "seq", F.col("value").alias("score"), event.alias("event")).where("event IS NOT NULL")
    return states.anomaly_lives(e).withColumn("life", F.col("life").cast("bigint"))


def hours_of_events(spark, sf_dir):
    """Lines a minute, failed lines a minute and mean latency of each host and hour; an alert is a line over 200 ms."""
    obs = from_events(spark, sf_dir)
    per = obs.groupBy("host", (F.floor(F.col("us") / HOUR) * HOUR).alias("us")).agg((F.count("*") / 60).alias("rate"), (F.count_if(F.col("severity").isin("ERROR", "CRITICAL")) / 60).alias("errors"), F.avg("value").alias("latency"), F.bool_or(F.col("value") >= 200).alias("alert"))
    kinds = F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).alias("value")) for k in ("rate", "errors", "latency")])
    return learning.hours_of(per.select("host", "us", "alert", F.explode(kinds).alias("s")).select("host", "us", "alert", "s.signal", "s.value"))


@query()
def learning_states(spark, sf_dir):
    """What each host's signals have learned, hour by hour. No SQL: the fold carries whole profiles."""
    return learning.learning_states(hours_of_events(spark, sf_dir))


@query()
def learned_shifts(spark, sf_dir):
    return learning.shifts(learning.learning_states(hours_of_events(spark, sf_dir)))


def template_lines(spark, sf_dir):
    """Lines of requests and of parts, customers and orders, as services write them."""
    e = from_events(spark, sf_dir).select(F.concat(F.col("message"), F.lit(" user="), F.col("user_id"), F.lit(" on "), "host"), "us", "seq")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part "), "p_name", F.lit(" brand "), "p_brand", F.lit(" size "), "p_size", F.lit(" price="), "p_retailprice"), F.lit(START).alias("us"), F.col("p_partkey").alias("seq"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("order "), "o_orderkey", F.lit(" is "), "o_orderstatus", F.lit(" with priority "), "o_orderpriority", F.lit(" for "), "o_custkey"), F.lit(START + 1).alias("us"), F.col("o_orderkey").alias("seq"))
    return e.toDF("message", "us", "seq").unionByName(p.toDF("message", "us", "seq")).unionByName(o.toDF("message", "us", "seq"))


@query()
def mined_templates(spark, sf_dir):
    """Templates of all lines with their counts and a grok pattern. No SQL: clusters grow line by line; tests hold them against a sequential miner."""
    return mining.with_grok(mining.mine(template_lines(spark, sf_dir)))


@query("SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS lines")
def mined_lines(spark, sf_dir):
    """Every line is in one cluster."""
    return mining.stats(mining.mine(template_lines(spark, sf_dir))).select("lines")
