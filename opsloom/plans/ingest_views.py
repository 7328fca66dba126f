"""Queries of ingestion: stamps, formats, roles, folding, hosts, and text functions, over lines made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stamps, text
from ..operators import correlation
from ..sources import formats, ingest
from ..sources.observations import from_events, repair_host, table
from .catalog import OBS, query

STAMPS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MMM/yyyy:HH:mm:ss +0000", "MMM d HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd'T'HHmmss'Z'", "EEE, d MMM yyyy HH:mm:ss +0000", "yyyy-MM-dd HH:mm:ss +00", "yyyyMMddHHmmss")


def stamped(spark, sf_dir) -> DataFrame:
    """(seq, us, stamp): each event's second, written in one of fourteen ways."""
    e = table(spark, sf_dir, "events")
    s = F.date_trunc("second", F.col("ts").cast("timestamp"))
    us = F.unix_micros(s)
    ways = [*[F.date_format(s, f.replace(" +0000", "").replace(" +00", "").replace("EEE, ", "")) for f in STAMPS], (us / 1_000_000).cast("bigint").cast("string"), F.floor(us / 1000).cast("string"), us.cast("string"), F.concat(us.cast("string"), F.lit("123"))]
    ways[2], ways[7], ways[8] = F.concat(ways[2], F.lit(" +0000")), F.concat(F.lit("Mon, "), ways[7], F.lit(" +0000")), F.concat(ways[8], F.lit(" +00"))
    return e.select(F.col("event_id").alias("seq"), us.alias("us"), F.element_at(F.array(*ways), (F.pmod("event_id", F.lit(len(ways))) + 1).cast("int")).alias("stamp"))


@query("SELECT event_id AS seq, epoch_us(date_trunc('second', ts)) AS us FROM events")
def stamp_shapes(spark, sf_dir):
    """Stamps in fourteen shapes read back."""
    return stamped(spark, sf_dir).select("seq", stamps.micros_of(F.col("stamp"), 2024).alias("us"))


@query("SELECT event_id AS seq, epoch_us(date_trunc('second', ts)) AS us, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN' ELSE 'INFO' END AS severity, 'svc-' || event_type AS service, 'stg-app-' || (user_id % 9) AS host, 'staging' AS environment, event_type || ' of ' || user_id AS message, CAST(value AS VARCHAR) AS amount FROM events")
def mapped_records(spark, sf_dir):
    """Records of unknown columns as observations: roles are told from names and values."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "err").when(F.col("event_type") == "signup", "Warning").otherwise("notice")
    made = stamped(spark, sf_dir).select("seq", F.col("stamp").alias("EventTime")).join(e, F.col("seq") == F.col("event_id")).select("seq", "EventTime", level.alias("x.loglevel"), F.concat(F.lit("svc-"), "event_type").alias("AppName"), F.concat(F.lit("stg-app-"), F.col("user_id") % 9).alias("src_hostname"), F.concat("event_type", F.lit(" of "), "user_id").alias("short_message"), F.col("value").alias("amount"))
    o = ingest.observations(made, 2024)
    return o.select(F.col("attributes")["seq"].cast("bigint").alias("seq"), "us", "severity", "service", "host", "environment", "message", F.col("attributes")["amount"].alias("amount"))


def sample_lines(spark, sf_dir) -> DataFrame:
    """Files of eight formats, made of the first two hundred events."""
    e = table(spark, sf_dir, "events").where("event_id < 200")
    i, k = F.col("event_id"), F.col("event_type")
    s = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    made = {
        "a.log": F.concat(s, F.lit(" ERROR [shop] "), k, F.lit(" failed")), "b.jsonl": F.to_json(F.struct(s.alias("ts"), k.alias("msg"))), "c.csv": F.when(i == 0, "time,level,text").otherwise(F.concat(s, F.lit(',INFO,"a, '), k, F.lit('"'))),
        "d.kv": F.concat(F.lit("level=info n="), i, F.lit(" msg=\""), k, F.lit(" x\"")), "e.access": F.concat(F.lit("10.0.0.1 - - ["), F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), k, F.lit(' HTTP/1.1" 200 5')),
        "f.syslog": F.concat(F.lit("<34>"), F.date_format(F.col("ts").cast("timestamp"), "MMM dd HH:mm:ss"), F.lit(" host1 app[7]: "), k), "g.cef": F.concat(F.lit("CEF:0|v|p|1|9|n|5|act="), k), "h.w3c": F.when(i == 0, "#Fields: date time cs-method").otherwise(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" GET"))),
    }
    return e.select(F.explode(F.array(*[F.struct(F.lit(n).alias("source"), (i + 1).alias("line_no"), c.alias("value")) for n, c in made.items()])).alias("x")).select("x.*")


@query("SELECT source, format, CAST(confidence AS DOUBLE) AS confidence, delimiter FROM (VALUES ('a.log', 'text', 0.5, NULL), ('b.jsonl', 'jsonl', 1.0, NULL), ('c.csv', 'csv', 0.9, ','), ('d.kv', 'kv', 1.0, NULL), ('e.access', 'access', 1.0, NULL), ('f.syslog', 'syslog', 1.0, NULL), ('g.cef', 'cef', 1.0, NULL), ('h.w3c', 'w3c', 0.95, NULL)) t(source, format, confidence, delimiter)")
def detected_formats(spark, sf_dir):
    d = ingest.detect_formats(sample_lines(spark, sf_dir))
    return d.select("source", "format", "confidence", "delimiter")


@query("SELECT 'f' || (event_id % 5) AS source, event_id // 5 * 3 + 1 AS line_no, epoch_us(date_trunc('second', ts)) AS us, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, 'svc-' || event_type AS service, event_type || ' ' || event_id || chr(10) || 'at line ' || event_id || chr(10) || 'Caused by: x' AS message FROM events")
def folded_records(spark, sf_dir):
    """Records of three lines each, in five files."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    head = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.lit(" [svc-"), "event_type", F.lit("] "), "event_type", F.lit(" "), i)
    three = F.array(*[F.struct((F.floor(i / 5) * 3 + n + 1).alias("line_no"), c.alias("value")) for n, c in enumerate((head, F.concat(F.lit("    at line "), i), F.lit("Caused by: x")))])
    lines = e.select(F.concat(F.lit("f"), i % 5).alias("source"), F.explode(three).alias("x")).select("source", "x.*")
    return ingest.text_records(lines, 2024)


@query(f"WITH {OBS}, m AS (SELECT seq, seq % 4 AS source, CASE WHEN seq % 10 < 7 AND seq >= 20 THEN us END AS us FROM o) SELECT seq, coalesce(last_value(us IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING), (SELECT min(us) FROM m)) AS us FROM m")
def carried_stamps(spark, sf_dir):
    o = from_events(spark, sf_dir).select("seq", (F.col("seq") % 4).alias("source"), F.col("seq").alias("line_no"), F.when((F.col("seq") % 10 < 7) & (F.col("seq") >= 20), F.col("us")).alias("us"))
    return ingest.carried(o).select("seq", "us")


@query(f"WITH {OBS}, h AS (SELECT seq, CASE seq % 4 WHEN 0 THEN host WHEN 1 THEN '[Nav]' WHEN 2 THEN '' ELSE 'Ax32:' END AS h FROM o) SELECT seq, CASE seq % 4 WHEN 0 THEN h ELSE 'agent-1' END AS host, CASE seq % 4 WHEN 1 THEN 'Nav' WHEN 3 THEN 'Ax32' END AS component FROM h")
def repaired_hosts(spark, sf_dir):
    o = from_events(spark, sf_dir)
    r = F.pmod("seq", F.lit(4))
    host, component = repair_host(F.when(r == 0, F.col("host")).when(r == 1, "[Nav]").when(r == 2, "").otherwise("Ax32:"), F.lit("agent-1"))
    return o.select("seq", host.alias("host"), component.alias("component"))


@query("SELECT event_id AS seq, ['prod', 'prod', 'test', 'uat', 'dev', 'staging', 'dr', 'prod', 'moon', ''][event_id % 10 + 1] AS environment, ['ERROR', 'WARN', 'INFO', 'CRITICAL', 'ERROR', 'DEBUG', 'INFO', 'CRITICAL', 'ERROR', 'WARN'][event_id % 10 + 1] AS severity, ['ERROR', 'WARN', 'INFO', 'CRITICAL', 'ERROR', 'WARN', 'ERROR', 'INFO', 'WARN', 'DEBUG'][event_id % 10 + 1] AS in_text FROM events")
def named_levels(spark, sf_dir):
    """Words of severities and environments, and levels that lines only hint at."""
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod("event_id", F.lit(10)) + 1).cast("int"))
    env = pick("Production", "PRD", "tst", "kabul", "gelistirme", "pre-prod", "disaster", "prod-eu", "Moon", " ")
    level = pick("err", "Warning", "notice", "fatal", "p2", "vrb", "unknown", "2", "3", "4")
    line = pick("ERROR x", "a warn: y", "plain", "[FATAL] z", "ORA-12345 seen", "request timed out", "x Traceback (most recent call last)", "terror", "access denied", "dbg: q")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.normal_environment(env).alias("environment"), text.severity_of(level).alias("severity"), text.severity_from_text(line).alias("in_text"))


@query("SELECT event_id AS seq, CAST(CASE event_id % 6 WHEN 0 THEN 120.0 WHEN 1 THEN 1200.0 WHEN 2 THEN 0.35 WHEN 3 THEN 2500.0 WHEN 4 THEN 75.0 END AS DOUBLE) AS ms, CASE event_id % 6 WHEN 0 THEN '0af7651916cd43dd8448eb211c80319c' WHEN 1 THEN 'r-1' WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'abc' END AS trace_id, CASE event_id % 6 WHEN 0 THEN 'b7ad6b7169203331' END AS parent_id FROM events")
def span_fields(spark, sf_dir):
    """Durations and identifiers out of attributes and lines."""
    r = F.pmod("event_id", F.lit(6))
    key = F.when(r == 0, "duration_ms").when(r == 1, "duration").when(r == 2, "took").when(r == 3, "elapsed_s").when(r == 4, "rt_ms").otherwise("latency")
    value = F.when(r == 0, "120").when(r == 1, "1.2s").when(r == 2, "350us").when(r == 3, "2.5").when(r == 4, "75").otherwise("soon")
    other = F.when(r == 1, "request_id").when(r == 5, "trace_id").otherwise("z")
    attributes = F.create_map(key, value, other, F.when(r == 1, "r-1").when(r == 5, "abc").otherwise("-"))
    line = F.when(r == 0, "tp 00-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-01 end").otherwise("none")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), attributes.alias("attributes"), line.alias("line"))
    return rows.select("seq", F.round(stamps.duration_ms(F.col("attributes")), 6).alias("ms"), stamps.trace_ids(F.col("attributes"), F.col("line")).alias("t")).select("seq", "ms", "t.trace_id", "t.parent_id")


@query("SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || event_id % 250 || ',db-0' || event_id % 9 WHEN 1 THEN 'pay-svc' ELSE '' END AS named, CASE event_id % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'pay-svc' END AS target FROM events")
def named_entities(spark, sf_dir):
    r = F.pmod("event_id", F.lit(3))
    m = F.when(r == 0, F.concat(F.lit("from 10.0.0."), F.col("event_id") % 250, F.lit(" connecting to postgres via DB-0"), F.col("event_id") % 9)).when(r == 1, "calling Pay-svc failed").otherwise("all is well")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.array_join(correlation.entities(m), ",").alias("named"), correlation.dependency(m).alias("target"))


@query("SELECT event_id AS seq, 'user <*> of k=<*> at <*> said ' || event_type AS template FROM events")
def drain_tokens(spark, sf_dir):
    m = F.concat(F.lit("user "), F.col("user_id"), F.lit(" of (k="), F.col("value"), F.lit(") at 10:20:30,5 said \""), "event_type", F.lit("\","))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.array_join(text.drain_tokens(m), " ").alias("template"))


@query("SELECT page_id, CASE WHEN url IS NULL THEN NULL ELSE CAST(levenshtein(left(url, 12), 'http://www.a') AS INT) END AS apart, url LIKE 'http%' AS fits, coalesce(html, '') LIKE '%a%' AS marked FROM pages")
def spelling_and_globs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.levenshtein(F.substring("url", 1, 12), F.lit("http://www.a")).alias("apart"), F.when(F.col("url").isNull(), None).otherwise(text.glob(F.col("url"), "HTTP*")).alias("fits"), text.glob(F.coalesce("html", F.lit("")), "*a*").alias("marked"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 'postgres' WHEN 1 THEN 'https' WHEN 2 THEN 'redis' WHEN 3 THEN 'kafka' WHEN 4 THEN 'ssh' ELSE 'tcp/6' END AS protocol, CASE l_partkey % 6 WHEN 0 THEN 'db' WHEN 1 THEN 'api' WHEN 2 THEN 'cache' WHEN 3 THEN 'messaging' WHEN 4 THEN 'file' ELSE 'other' END AS category FROM lineitem")
def port_names(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    port = F.element_at(F.array(*map(F.lit, (5432, 443, 6379, 9092, 22, 6))), (F.pmod("l_partkey", F.lit(6)) + 1).cast("int"))
    p = text.protocol(port)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", p.alias("protocol"), text.protocol_category(p).alias("category"))


@query(f"WITH {OBS} SELECT service, CAST(bit_or(CAST(1 << lvl AS INT)) AS INT) AS mask FROM o GROUP BY 1")
def severity_masks(spark, sf_dir):
    o = from_events(spark, sf_dir)
    return o.groupBy("service").agg(F.bit_or(text.severity_mask(F.col("severity"))).alias("mask"))


@query("SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS compared FROM events")
def paths_and_versions(spark, sf_dir):
    r = F.pmod("event_id", F.lit(3))
    a, b = F.when(r == 0, "1.10.2").when(r == 1, "1.9").otherwise("2.0"), F.when(r == 0, "1.9.9").when(r == 1, "1.10").otherwise("2.0.0")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.dig(F.concat(F.lit('{"data":[{"p":'), "props", F.lit("}]}")), "data[0].p.k").cast("bigint").alias("k"), text.version_order(a, b).alias("compared"))


@query("SELECT event_id AS seq, 'INFO' AS severity, 'h' || event_id % 7 AS host, event_type AS act FROM events")
def leef_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("LEEF:1.0|v|p|1|id|devname=h"), F.col("event_id") % 7, F.lit("\tsev=2\tact="), "event_type").alias("value"))
    p = formats.leef(lines)
    return p.select("seq", "severity", F.col("attributes")["devname"].alias("host"), F.col("attributes")["act"].alias("act"))
