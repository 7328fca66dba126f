"""Queries of applications in detail, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apps, rollups
from ..sources.observations import from_events, table
from .catalog import DAY, END, HOUR, OBS, query
from .views import APPS

FROM = END - 10 * DAY
SILENT = 12 * HOUR
TARGETS = [("shop", 99.0), ("pay", 10.0), ("none", 99.9)]
#: Span services are those of the events' types, by supplier; hosts by order.
KINDS = ("click", "view", "purchase", "signup", "error")
_ALARMS = f"al AS (SELECT DISTINCT host, CASE severity WHEN 'CRITICAL' THEN 'crit' ELSE 'warn' END AS level FROM o WHERE bad AND us >= {END - HOUR * 6} AND us < {END})"
_HOSTS = f"""mh(app, host) AS (VALUES ('shop', 'prd-app-01'), ('shop', 'prd-app-02'), ('none', 'nowhere')),
sn AS (SELECT host, count(*) FILTER (us >= {FROM}) AS lines, count(*) FILTER (us >= {FROM} AND bad) AS errors, max(us) AS last_us FROM o WHERE us < {END} GROUP BY 1),
hr AS (SELECT app, host, coalesce(lines, 0) AS lines, coalesce(errors, 0) AS errors, (SELECT count(*) FROM al WHERE al.host = mh.host AND level = 'crit') AS crit, (SELECT count(*) FROM al WHERE al.host = mh.host AND level = 'warn') AS warn, CAST(0 AS BIGINT) AS anomaly, last_us,
  CASE WHEN last_us IS NULL THEN 'unknown' WHEN last_us < {END - SILENT} THEN 'silent' ELSE 'reporting' END AS state FROM mh LEFT JOIN sn USING (host))"""
_SERVICES = f"""sp AS (SELECT 'prd-app-' || lpad(CAST(l_orderkey % 20 AS VARCHAR), 2, '0') AS host, 'svc-' || ['click', 'view', 'purchase', 'signup', 'error'][l_suppkey % 5 + 1] AS service, l_returnflag = 'R' AS error FROM lineitem),
un AS (SELECT host, service, 1 AS l, CAST(bad AS INT) AS e, 0 AS c, 0 AS x FROM o WHERE us >= {FROM} AND us < {END} UNION ALL SELECT host, service, 0, 0, 1, CAST(error AS INT) FROM sp),
ap AS (SELECT 'shop' AS app, service LIKE 'svc-p%' AS member, * FROM un WHERE host IN ('prd-app-01', 'prd-app-02') OR service LIKE 'svc-p%' UNION ALL SELECT 'pay', true, * FROM un WHERE service LIKE 'svc-_r%' OR service = 'svc-click'),
sr AS (SELECT app, service, member, CAST(sum(l) AS BIGINT) AS lines, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(x) AS BIGINT) AS call_errors FROM ap GROUP BY 1, 2, 3)"""

_NUMBERS = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("reporting", "silent", "unknown", "crit", "warn", "lines", "errors", "calls", "call_errors"))


def _rows(spark, rows, names):
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])))


def _members(spark):
    return _rows(spark, APPS, ("app", "kind", "name"))


def _host_rows(spark, sf_dir):
    """Alarms are the hosts' ERROR and CRITICAL lines of the last six hours."""
    o = from_events(spark, sf_dir)
    late = o.where(rollups.severe() & (F.col("us") >= END - 6 * HOUR) & (F.col("us") < END))
    alarms = late.select("host", F.when(F.col("severity") == "CRITICAL", "crit").otherwise("warn").alias("level")).distinct()
    return apps.host_rows(o, _members(spark), alarms, FROM, END, SILENT)


def _service_rows(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("l_suppkey", F.lit(5)) + 1).cast("int"))
    host = F.concat(F.lit("prd-app-"), F.lpad(F.pmod("l_orderkey", F.lit(20)).cast("string"), 2, "0"))
    spans = table(spark, sf_dir, "lineitem").select(host.alias("host"), F.concat(F.lit("svc-"), kind).alias("service"), F.lit(FROM).alias("start_us"), (F.col("l_returnflag") == "R").alias("error"))
    return apps.service_rows(from_events(spark, sf_dir), spans, _members(spark), FROM, END)


@query(f"WITH {OBS}, {_ALARMS}, {_HOSTS} SELECT *, CASE WHEN lines > 0 THEN round(errors / lines, 5) END AS error_rate, CASE WHEN crit > 0 THEN 'crit' WHEN warn > 0 THEN 'warn' ELSE 'ok' END AS level FROM hr")
def application_hosts(spark, sf_dir):
    return _host_rows(spark, sf_dir)


@query(f"WITH {OBS}, {_SERVICES} SELECT *, CASE WHEN lines > 0 THEN round(errors / lines, 5) END AS error_rate, CASE WHEN calls > 0 THEN round(call_errors / calls, 5) END AS call_error_rate FROM sr")
def application_services(spark, sf_dir):
    return _service_rows(spark, sf_dir)


@query(f"""WITH {OBS}, {_ALARMS}, {_HOSTS}, {_SERVICES}, tg(app, target) AS (VALUES ('shop', 99.0), ('pay', 10.0), ('none', 99.9)),
h AS (SELECT app, count(*) FILTER (state = 'reporting') AS reporting, count(*) FILTER (state = 'silent') AS silent, count(*) FILTER (state = 'unknown') AS unknown, sum(crit) AS crit, sum(warn) AS warn FROM hr GROUP BY 1),
s AS (SELECT app, sum(lines) AS lines, sum(errors) AS errors, sum(calls) AS calls, sum(call_errors) AS call_errors FROM sr GROUP BY 1),
n AS (SELECT app, CAST(target AS DOUBLE) AS target, {_NUMBERS} FROM tg LEFT JOIN h USING (app) LEFT JOIN s USING (app)),
r AS (SELECT *, CASE WHEN calls > 0 THEN call_errors / calls WHEN lines > 0 THEN errors / lines END AS lost, (lines > 0 AND errors / lines >= 0.05) OR (calls > 0 AND call_errors / calls >= 0.05) AS high FROM n),
w AS (SELECT *, concat_ws(',', CASE WHEN (1 - lost) * 100 < target THEN 'slo_breach' END, CASE WHEN crit > 0 THEN 'thr_crit' END, CASE WHEN reporting = 0 AND silent > 0 THEN 'all_silent' END, CASE WHEN warn > 0 THEN 'thr_warn' END, CASE WHEN silent > 0 AND reporting > 0 THEN 'silent' END, CASE WHEN high THEN 'errors_high' END) AS reasons FROM r)
SELECT app, CASE WHEN coalesce((1 - lost) * 100 < target, false) OR crit > 0 OR (reporting = 0 AND silent > 0) THEN 'crit' WHEN reasons <> '' THEN 'warn' WHEN lines + calls + reporting > 0 THEN 'ok' ELSE 'nodata' END AS status, reasons, round(1 - lost, 6) AS availability, reporting, silent, unknown, crit, warn, CAST(0 AS BIGINT) AS anomaly, lines, errors, calls, call_errors FROM w""")
def application_health(spark, sf_dir):
    return apps.health(_members(spark), _host_rows(spark, sf_dir), _service_rows(spark, sf_dir), _rows(spark, TARGETS, ("app", "availability")))


@query(f"""WITH {OBS}, an AS (SELECT host, service, min(us) AS first_us, max(us) AS last_us, count(*) AS lines, max(us) >= {END - SILENT} AS open FROM o WHERE bad GROUP BY 1, 2),
i AS (SELECT * FROM an WHERE first_us < {END} AND (open OR last_us >= {END - DAY}))
SELECT 'shop' AS app, * FROM i WHERE host IN ('prd-app-01', 'prd-app-02') OR service LIKE 'svc-p%' UNION ALL SELECT 'pay', * FROM i WHERE service LIKE 'svc-_r%' OR service = 'svc-click'""")
def application_events(spark, sf_dir):
    """Failures of a host's service are open while the last is younger than twelve hours; the range is the last day."""
    bad = from_events(spark, sf_dir).where(rollups.severe()).groupBy("host", "service").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("lines"))
    return apps.events_of(bad.withColumn("open", F.col("last_us") >= END - SILENT), _members(spark), END - DAY, END)
