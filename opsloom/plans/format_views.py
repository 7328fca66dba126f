"""Queries of grok packs and OTLP requests over lines and requests that the event table gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import grok, otlp
from ..sources.observations import from_events
from .catalog import OBS, query


def _kind():
    return F.substring("service", 5, 20)


def files_of(spark, sf_dir):
    """Four files as four programs write them: a broker, a monitor, a proxy, and a system log whose views are continued lines."""
    obs = from_events(spark, sf_dir)
    n, seq, user = F.round("value").cast("bigint").cast("string"), F.col("seq").cast("string"), F.col("user_id").cast("string")
    stamp = lambda f: F.date_format("ts", f)
    file = F.col("user_id") % 4
    line = (
        F.when(file == 0, F.concat(stamp("yyyy-MM-dd HH:mm:ss"), F.when(_kind() == "error", " [error]").otherwise(" [info]"), F.lit(" <0."), user, F.lit(".0> accepting connection "), seq))
        .when(file == 1, F.concat(F.lit("["), F.floor(F.col("us") / 1_000_000), F.lit("] PROBE: "), "host", F.lit(" answered in "), n, F.lit(" ms")))
        .when(file == 2, F.concat(F.floor(F.col("us") / 1_000_000), F.lit("    "), n, F.lit(" 10.0.0.7 TCP_MISS/"), F.when(_kind() == "error", "504").otherwise("200"), F.lit(" 512 GET http://shop.example.com/k/"), seq, F.lit(" ali HIER_DIRECT/10.0.9.8 text/html")))
        .otherwise(F.when(_kind() == "view", F.concat(F.lit("\tat frame "), seq)).otherwise(F.concat(stamp("MMM dd HH:mm:ss "), "host", F.lit(" app["), F.col("user_id") + 1, F.lit("]: did "), _kind(), F.lit(" "), seq)))
    )
    return obs.select(F.concat(F.lit("f"), file).alias("file"), (F.col("seq") + 1).alias("line_no"), line.alias("line"))


@query(f"""WITH {OBS}, l AS (SELECT *, CAST(round(value) AS BIGINT) AS n, user_id % 4 AS f, make_timestamp(us) AS ts FROM o), y AS (SELECT *, user_id % 4 = 3 AND event_type = 'view' AND count(*) FILTER (event_type <> 'view') OVER (PARTITION BY f ORDER BY seq) > 0 AS more,
  count(*) FILTER (event_type <> 'view') OVER (PARTITION BY f ORDER BY seq) AS e FROM l), g AS (SELECT CASE WHEN f = 3 AND event_type = 'view' AND e = 0 THEN -1 - seq ELSE e END AS e, min(seq) AS seq, count(*) AS lines, string_agg('at frame ' || seq, chr(10) ORDER BY seq) FILTER (event_type = 'view' AND e > 0) AS more FROM y WHERE f = 3 GROUP BY 1)
SELECT 'f0' AS file, seq + 1 AS line_no, 'RABBITMQ' AS pack, 1 AS lines, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS severity, NULL AS host, 'rabbitmq' AS service, 'accepting connection ' || seq AS message, 'pid=0.' || user_id || '.0' AS attributes FROM l WHERE f = 0
UNION ALL SELECT 'f1', seq + 1, 'NAGIOS_LOG', 1, CAST(us // 1000000 AS VARCHAR), NULL, NULL, 'nagios', host || ' answered in ' || n || ' ms', 'nagios_type=PROBE' FROM l WHERE f = 1
UNION ALL SELECT 'f2', seq + 1, 'SQUID_ACCESS', 1, CAST(us // 1000000 AS VARCHAR), CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END, NULL, 'squid', 'http://shop.example.com/k/' || seq, 'bytes=512;clientip=10.0.0.7;content_type=text/html;duration=' || n || ';hierarchy=HIER_DIRECT/10.0.9.8;squid_status=TCP_MISS;user=ali;verb=GET' FROM l WHERE f = 2
UNION ALL SELECT 'f3', g.seq + 1, 'SYSLOGLINE', lines, CASE WHEN g.e >= 0 THEN strftime(ts, '%b %d %H:%M:%S') END, NULL, CASE WHEN g.e >= 0 THEN host END, CASE WHEN g.e >= 0 THEN 'app' ELSE 'syslog' END, CASE WHEN g.e >= 0 THEN 'did ' || event_type || ' ' || g.seq ELSE 'at frame ' || g.seq END || coalesce(chr(10) || g.more, ''), CASE WHEN g.e >= 0 THEN 'pid=' || (user_id + 1) ELSE '' END FROM g JOIN l ON l.seq = g.seq""")
def grok_records(spark, sf_dir):
    """Files read by the pack that fits them, with continued lines in one record."""
    r = grok.parse(files_of(spark, sf_dir))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return r.withColumn("attributes", pairs)


@query("SELECT 'f0' AS file, 'RABBITMQ' AS pack, 1.0::DOUBLE AS share UNION ALL SELECT 'f1', 'NAGIOS_LOG', 1.0 UNION ALL SELECT 'f2', 'SQUID_ACCESS', 1.0 UNION ALL SELECT 'f3', 'SYSLOGLINE', round((SELECT count(*) FILTER (event_type <> 'view') / count(*) FROM events WHERE user_id % 4 = 3 AND event_id < 120), 2)")
def grok_packs(spark, sf_dir):
    return grok.detect(files_of(spark, sf_dir))


def _pairs(**values):
    """OTLP attributes."""
    return F.array(*[F.struct(F.lit(k.replace("__", ".")).alias("key"), F.struct(v.alias("stringValue")).alias("value")) for k, v in values.items()])


def _requests(obs, root, scope, item, record):
    """Requests of one host each, with its events out of a thousand."""
    per = obs.groupBy("host", (F.col("seq") / 1000).cast("bigint").alias("slot")).agg(F.collect_list(record).alias("records"), F.min("service").alias("service"))
    resource = F.struct(_pairs(service__name=F.lit("shop"), host__name=F.col("host")).alias("attributes"))
    body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.col("records").alias(item))).alias(scope))).alias(root))
    return per.select(F.concat("host", F.lit("/"), "slot").alias("id"), F.to_json(body).alias("body"))


def _nanos(us):
    return F.concat(us.cast("string"), F.lit("000"))


@query(f"WITH {OBS} SELECT host || '/' || (seq // 1000) AS id, us, CASE severity WHEN 'CRITICAL' THEN 'ERROR' ELSE severity END AS severity, 'shop' AS service, host, message, lpad(CAST(seq AS VARCHAR), 32, '0') AS trace_id, NULL AS span_id, 'host.name=' || host || ';kind=' || event_type || ';service.name=shop' AS attributes FROM o")
def otlp_logs(spark, sf_dir):
    """Log records out of OTLP requests."""
    obs = from_events(spark, sf_dir)
    number = F.when(F.col("severity") == "DEBUG", 5).when(F.col("severity") == "INFO", 9).when(F.col("severity") == "WARN", 13).otherwise(17)
    record = F.struct(_nanos(F.col("us")).alias("timeUnixNano"), number.alias("severityNumber"), F.struct(F.col("message").alias("stringValue")).alias("body"), _pairs(kind=_kind()).alias("attributes"), F.lpad(F.col("seq").cast("string"), 32, "0").alias("traceId"))
    r = otlp.log_records(_requests(obs, "resourceLogs", "scopeLogs", "logRecords", record))
    return r.withColumn("attributes", F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"))


@query(f"WITH {OBS}, c AS (SELECT host, us, max(seq % 500) AS v FROM o GROUP BY 1, 2), d AS (SELECT host, us, v, lag(v) OVER w AS p, us - lag(us) OVER w AS span_us FROM c WINDOW w AS (PARTITION BY host ORDER BY us)) SELECT host, 'requests' AS metric, us, span_us, CASE WHEN v < p THEN v ELSE v - p END::DOUBLE AS gain FROM d WHERE p IS NOT NULL")
def otlp_deltas(spark, sf_dir):
    """Gains of counters that start anew now and then, out of OTLP requests."""
    obs = from_events(spark, sf_dir)
    point = F.struct(_nanos(F.col("us")).alias("timeUnixNano"), (F.col("seq") % 500).cast("string").alias("asInt"))
    record = F.struct(F.lit("requests").alias("name"), F.struct(F.array(point).alias("dataPoints"), F.lit(True).alias("isMonotonic"), F.lit("2").alias("aggregationTemporality")).alias("sum"))
    points = otlp.metric_points(_requests(obs, "resourceMetrics", "scopeMetrics", "metrics", record))
    return otlp.counter_deltas(points).drop("series")


@query(f"WITH {OBS} SELECT host || '/' || (seq // 1000) AS id, lpad(CAST(user_id AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(seq AS VARCHAR), 16, '0') AS span_id, NULL AS parent_id, us AS start_us, CAST(round(value) AS DOUBLE) AS duration_ms, 'shop' AS service, host, event_type AS operation, CASE event_type WHEN 'error' THEN 'server' WHEN 'view' THEN 'client' ELSE 'internal' END AS kind, CASE event_type WHEN 'error' THEN 503 ELSE 0 END AS status, event_type = 'error' AS error FROM o")
def otlp_spans(spark, sf_dir):
    """Spans out of OTLP requests."""
    obs = from_events(spark, sf_dir)
    end = F.col("us") + F.round("value").cast("bigint") * 1000
    attributes = F.when(_kind() == "error", F.array(F.struct(F.lit("http.status_code").alias("key"), F.struct(F.lit("503").alias("intValue")).alias("value"))))
    record = F.struct(F.lpad(F.col("user_id").cast("string"), 32, "0").alias("traceId"), F.lpad(F.col("seq").cast("string"), 16, "0").alias("spanId"), _kind().alias("name"), F.when(_kind() == "error", "2").when(_kind() == "view", "SPAN_KIND_CLIENT").otherwise("1").alias("kind"), _nanos(F.col("us")).alias("startTimeUnixNano"), _nanos(end).alias("endTimeUnixNano"), attributes.alias("attributes"))
    return otlp.spans(_requests(obs, "resourceSpans", "scopeSpans", "spans", record)).drop("attributes")
