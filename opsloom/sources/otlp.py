"""OTLP in JSON: log records, metric points and spans out of export requests, and deltas of counters.

One request is one text. Its shape is known, so it is read with a schema and taken
apart by generators; nothing of it goes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_RESOURCE = f"resource:struct<attributes:{_ATTRIBUTES}>"
_LOGS = f"resourceLogs:array<struct<{_RESOURCE},scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,severityNumber:int,body:{_VALUE},attributes:{_ATTRIBUTES},traceId:string,spanId:string>>>>>>"
_POINT = f"array<struct<attributes:{_ATTRIBUTES},timeUnixNano:string,startTimeUnixNano:string,asDouble:double,asInt:string>>"
_METRICS = f"resourceMetrics:array<struct<{_RESOURCE},scopeMetrics:array<struct<metrics:array<struct<name:string,unit:string,gauge:struct<dataPoints:{_POINT}>,sum:struct<dataPoints:{_POINT},isMonotonic:boolean,aggregationTemporality:string>>>>>>>"
_SPANS = f"resourceSpans:array<struct<{_RESOURCE},scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:string>>>>>>>"
# Kinds of spans by name and number, and severity numbers by their upper end.
KINDS = (("internal", "1", "SPAN_KIND_INTERNAL"), ("server", "2", "SPAN_KIND_SERVER"), ("client", "3", "SPAN_KIND_CLIENT"), ("producer", "4", "SPAN_KIND_PRODUCER"), ("consumer", "5", "SPAN_KIND_CONSUMER"))
SEVERITIES = ((8, "DEBUG"), (12, "INFO"), (16, "WARN"), (20, "ERROR"), (24, "CRITICAL"))


def _text(value: Column) -> Column:
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"))


def _map(attributes: Column) -> Column:
    """Attributes as a map; of equal keys the last, empty for null."""
    e = F.coalesce(F.transform(attributes, lambda a: F.struct(a["key"].alias("key"), _text(a["value"]).alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))
    return F.map_from_entries(F.filter(e, lambda x, i: x["key"].isNotNull() & ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])))


def _micros(nanos: Column) -> Column:
    return F.floor(nanos.try_cast("decimal(20,0)") / 1000).cast("bigint")


def _each(requests: DataFrame, schema: str, root: str, scope: str, item: str) -> DataFrame:
    """(id, resource, x) for each item of each scope of each resource; a text that can't be read has none."""
    r = requests.select("id", F.explode(F.from_json("body", f"struct<{schema}>")[root]).alias("r"))
    r = r.select("id", F.inline(F.array(F.struct(_map(F.col("r")["resource"]["attributes"]).alias("resource"), F.col("r")[scope].alias("s")))))
    return r.select("id", "resource", F.explode("s").alias("s")).select("id", "resource", F.explode(F.col("s")[item]).alias("x"))


def _host(resource: Column) -> Column:
    return F.coalesce(resource["host.name"], resource["k8s.pod.name"], resource["service.instance.id"], F.lit(""))


def log_records(requests: DataFrame) -> DataFrame:
    """One row for each log record of the requests (id, body): us, severity, service, host, message, trace_id, span_id and attributes.

    A severity's text counts before its number; attributes are the resource's with
    the record's own over them. An unreadable body gives no rows.
    """
    d = _each(requests, _LOGS, "resourceLogs", "scopeLogs", "logRecords")
    number = F.col("x.severityNumber")
    by_number = F.coalesce(*[F.when((number >= 1) & (number <= top), name) for top, name in SEVERITIES])
    own = _map(F.col("x.attributes"))
    both = F.map_concat(F.map_filter("resource", lambda k, v: ~F.map_contains_key(own, k)), own)
    return d.select(
        "id", _micros(F.coalesce(F.nullif("x.timeUnixNano", F.lit("0")), "x.observedTimeUnixNano")).alias("us"), F.coalesce(F.nullif("x.severityText", F.lit("")), by_number, F.lit("INFO")).alias("severity"),
        F.coalesce(F.col("resource")["service.name"], F.lit("")).alias("service"), _host(F.col("resource")).alias("host"), F.coalesce(_text(F.col("x.body")), F.lit("")).alias("message"), F.nullif("x.traceId", F.lit("")).alias("trace_id"), F.nullif("x.spanId", F.lit("")).alias("span_id"), both.alias("attributes"),
    )


def metric_points(requests: DataFrame) -> DataFrame:
    """One row for each number of a gauge or sum: us, start_us, metric, unit, value, cumulative (a rising counter since its start), service, host and attributes."""
    d = _each(requests, _METRICS, "resourceMetrics", "scopeMetrics", "metrics")
    temporality = F.col("x.sum.aggregationTemporality")
    d = d.select("id", "resource", F.col("x.name").alias("metric"), F.col("x.unit").alias("unit"), (F.coalesce("x.sum.isMonotonic", F.lit(False)) & F.coalesce(temporality.isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE"), F.lit(False))).alias("cumulative"), F.explode(F.coalesce("x.gauge.dataPoints", "x.sum.dataPoints")).alias("p"))
    return d.select(
        "id", _micros(F.col("p.timeUnixNano")).alias("us"), _micros(F.col("p.startTimeUnixNano")).alias("start_us"), "metric", "unit", F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double")).alias("value"), "cumulative",
        F.coalesce(F.col("resource")["service.name"], F.lit("")).alias("service"), _host(F.col("resource")).alias("host"), _map(F.col("p.attributes")).alias("attributes"),
    )


def counter_deltas(points: DataFrame) -> DataFrame:
    """What each cumulative counter has gained since its point before: of one host, metric and set of attributes, in time order.

    A counter that starts anew, by its start or by falling, has gained its value;
    the first point of a series has no gain. Points of one time count once.
    """
    series = F.to_json(F.array_sort(F.map_entries("attributes")))
    p = points.where("cumulative AND us IS NOT NULL AND value IS NOT NULL").withColumn("series", series).groupBy("host", "metric", "series", "us").agg(F.max("value").alias("value"), F.max("start_us").alias("start_us"))
    order = Window.partitionBy("host", "metric", "series").orderBy("us")
    was, began = F.lag("value").over(order), F.lag("start_us").over(order)
    again = (F.col("value") < was) | F.coalesce(F.col("start_us") > began, F.lit(False))
    return p.withColumn("gain", F.when(was.isNull(), None).when(again, F.col("value")).otherwise(F.col("value") - was)).withColumn("span_us", F.col("us") - F.lag("us").over(order)).where("gain IS NOT NULL").select("host", "metric", "series", "us", "span_us", "gain")


def spans(requests: DataFrame) -> DataFrame:
    """One row for each span: trace_id, span_id, parent_id, start_us, duration_ms, service, host, operation, kind, status, error and attributes."""
    d = _each(requests, _SPANS, "resourceSpans", "scopeSpans", "spans")
    kind = F.coalesce(*[F.when(F.col("x.kind").isin(*names[1:]), names[0]) for names in KINDS], F.lit("internal"))
    d = d.withColumn("a", _map(F.col("x.attributes")))
    status = F.coalesce(F.coalesce(F.col("a")["http.status_code"], F.col("a")["http.response.status_code"]).try_cast("int"), F.lit(0))
    failed = F.coalesce(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False)) | (status >= 500)
    took = (F.col("x.endTimeUnixNano").try_cast("decimal(20,0)") - F.col("x.startTimeUnixNano").try_cast("decimal(20,0)")).cast("double") / 1e6
    return d.select(
        "id", F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.lower(F.nullif("x.parentSpanId", F.lit(""))).alias("parent_id"), _micros(F.col("x.startTimeUnixNano")).alias("start_us"), F.round(F.greatest(took, F.lit(0.0)), 3).alias("duration_ms"),
        F.coalesce(F.col("resource")["service.name"], F.lit("")).alias("service"), _host(F.col("resource")).alias("host"), F.col("x.name").alias("operation"), F.when(F.map_contains_key("a", "db.system") & (kind == "client"), "db").otherwise(kind).alias("kind"), status.alias("status"), failed.alias("error"), F.col("a").alias("attributes"),
    )
