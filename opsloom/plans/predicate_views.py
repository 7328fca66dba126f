"""Queries of filter leaves, small text functions, profiles and level shifts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import incidents, rollups, traces
from ..sources import ingest
from ..sources.observations import from_events, table
from .catalog import DAY, HOUR, LINES, OBS, START, query, spans_of


def _counts(df: DataFrame, leaves: dict) -> DataFrame:
    row = df.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(n) for n, v in leaves.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("leaf"), F.col(n).alias("lines")) for n in leaves])))


@query(f"WITH {OBS} SELECT 'hata' AS leaf, count(*) FILTER (severity = 'ERROR') AS lines FROM o UNION ALL SELECT 'from_warning', count(*) FILTER (lvl >= 2) FROM o UNION ALL SELECT 'crit_glob', count(*) FILTER (severity = 'CRITICAL') FROM o UNION ALL SELECT 'unknown', CAST(0 AS BIGINT) UNION ALL SELECT 'wild', count(*) FILTER (regexp_matches(message, 'error req\\S*t \\d')) FROM o UNION ALL SELECT 'no_space', CAST(0 AS BIGINT) UNION ALL SELECT 'any_case', count(*) FILTER (props->>'$.k' IS NOT NULL) FROM o UNION ALL SELECT 'either', count(*) FILTER (NOT bad OR host = 'prd-app-01') FROM o UNION ALL SELECT 'raw', count(*) FILTER (service || ' ' || message LIKE '%svc-error error%') FROM o")
def filter_leaves(spark, sf_dir):
    """Levels by their names, wildcards inside words, attributes in any case, and both logics."""
    s, m, a = F.col("severity"), F.col("message"), F.col("attributes")
    return _counts(from_events(spark, sf_dir), {
        "hata": text.level_is(s, "HATA"), "from_warning": text.level_is(s, "warning", ">="), "crit_glob": text.level_is(s, "cri*"), "unknown": text.level_is(s, "loud"), "wild": text.holds(m, "error REQ*t ?"), "no_space": text.holds(m, "error*took"),
        "any_case": text.present(text.attribute(a, "K")), "either": ~F.coalesce(text.level_is(s, "error", ">="), F.lit(False)) | (F.col("host") == "prd-app-01"), "raw": F.concat_ws(" ", "service", "message").contains("svc-error error"),
    })


@query(f"WITH {OBS} SELECT user_id, count(*) AS lines FROM o WHERE user_id IN (3, 4) GROUP BY 1")
def pseudonym_filter(spark, sf_dir):
    """A filter on a raw name compares pseudonyms."""
    key = b"key of this query"
    o = from_events(spark, sf_dir)
    wanted = [text.pseudonym(F.lit(v), key) for v in (" 3 ", "4")]
    return o.where(text.pseudonym(F.col("user_id").cast("string"), key).isin(*wanted)).groupBy("user_id").agg(F.count("*").alias("lines"))


@query(f"WITH {OBS} SELECT count(DISTINCT user_id) AS sessions, count(*) AS lines FROM o WHERE user_id IS NOT NULL")
def session_identities(spark, sf_dir):
    i = text.identity(F.col("attributes"), b"key of this query")
    return from_events(spark, sf_dir).select(i.alias("i")).where("i <> ''").agg(F.countDistinct("i").alias("sessions"), F.count("*").alias("lines"))


@query("""WITH t AS (SELECT page_id, url AS tok, string_split(url, '') AS cs FROM pages WHERE url IS NOT NULL), c AS (SELECT page_id, unnest(cs) AS c FROM t), n AS (SELECT page_id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY page_id) AS m FROM c GROUP BY 1, 2) SELECT page_id, round(sum(-(n / m) * log2(n / m)), 6) + 0.0 AS bits FROM n GROUP BY 1""")
def token_entropy(spark, sf_dir):
    """Bits of each page's whole url."""
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", (F.round(text.entropy(F.col("url")), 6) + 0.0).alias("bits"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '\n(#+ )', chr(1) || '\1', 'g'), '\n\s*\n|\x01'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
s(doc_id, i, done, head, cur) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, '', '' FROM d UNION ALL SELECT doc_id, i + 1, done + CASE WHEN brims THEN 1 ELSE 0 END, CASE WHEN brims AND done = 0 THEN cur ELSE head END, CASE WHEN brims OR cur = '' THEN p ELSE cur || chr(10) || chr(10) || p END FROM (SELECT s.*, d.ps[i + 1] AS p, s.cur <> '' AND length(s.cur) + length(d.ps[i + 1]) + 2 > 900 AS brims FROM s JOIN d ON d.doc_id = s.doc_id WHERE i < len(d.ps)))
SELECT s.doc_id, CAST(done + CASE WHEN cur <> '' THEN 1 ELSE 0 END AS INT) AS chunks, sha256(CASE WHEN done = 0 THEN cur ELSE head END) AS first_sha256 FROM s JOIN d ON d.doc_id = s.doc_id AND s.i = len(d.ps)""")
def text_chunks(spark, sf_dir):
    """Every document cut to chunks of about 900 characters at its paragraphs."""
    c = table(spark, sf_dir, "documents").select("doc_id", text.chunks(F.coalesce("text", F.lit(""))).alias("c"))
    return c.select("doc_id", F.size("c").alias("chunks"), F.sha2(F.coalesce(F.get("c", F.lit(0)), F.lit("")), 256).alias("first_sha256"))


@query("SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS deep, 'x' AS flat FROM events")
def flattened_json(spark, sf_dir):
    doc = F.concat(F.lit('{"a":{"b":'), "props", F.lit('},"c":"x"}'))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.flatten_json(doc).alias("m")).select("seq", F.col("m")["a.b.k"].alias("deep"), F.col("m")["c"].alias("flat"))


@query("SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'Android' WHEN 1 THEN 'macOS' ELSE '' END AS os, CASE event_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE 'Edge' END AS browser FROM events")
def agent_families(spark, sf_dir):
    a = F.element_at(F.array(F.lit("Linux; Android 14 Chrome/1 Safari/2"), F.lit("Mac OS X Safari/2"), F.lit("X Chrome/1 Edg/3")), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.agent_family(a).alias("f")).select("seq", "f.*")


@query(f"WITH {OBS} SELECT environment, 'events' AS source, count(*) AS lines, round(avg(CAST(bad AS INT)), 6) AS error_rate, min(us) AS first_us, max(us) AS last_us, count(DISTINCT us // {HOUR}) AS hours, count(*) FILTER (severity = 'DEBUG') AS debug, count(*) FILTER (severity = 'CRITICAL') AS critical FROM o GROUP BY 1")
def data_profile(spark, sf_dir):
    """What a data set holds: by environment and file, its range, error rate and severities."""
    o = from_events(spark, sf_dir)
    level = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return o.groupBy("environment", "source").agg(F.count("*").alias("lines"), F.round(F.avg(rollups.severe().cast("int")), 6).alias("error_rate"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct(rollups.bucket(HOUR)).alias("hours"), level("DEBUG"), level("CRITICAL"))


@query(f"WITH {LINES} SELECT service, kind, count(*) AS calls, count(*) FILTER (error) AS errors, round(avg(duration_ms), 4) AS avg_ms, max(duration_ms) AS max_ms FROM p WHERE kind IN ('db', 'client') GROUP BY 1, 2")
def service_calls(spark, sf_dir):
    """What a service calls: its databases and clients."""
    return traces.red(spans_of(spark, sf_dir).where("kind IN ('db', 'client')"), ["service", "kind"]).select("service", "kind", "calls", "errors", "avg_ms", "max_ms")


@query(f"WITH {OBS}, d AS (SELECT host, us // {DAY} AS bar, count(*) AS n FROM o GROUP BY 1, 2), m AS (SELECT host, median(n) AS med FROM d GROUP BY 1), x AS (SELECT host, bar, n > 1.5 * med AS high FROM d JOIN m USING (host)), i AS (SELECT *, bar - row_number() OVER (PARTITION BY host, high ORDER BY bar) AS g FROM x) SELECT host, min(bar) AS first_bar, max(bar) AS last_bar, count(*) AS bars FROM i WHERE high GROUP BY host, g")
def level_shifts(spark, sf_dir):
    """Runs of days on which a host logs half more than its usual."""
    o = from_events(spark, sf_dir).groupBy("host", rollups.bucket(DAY).alias("bar")).agg(F.count("*").alias("n"))
    usual = o.groupBy("host").agg(F.median("n").alias("med"))
    high = o.join(usual, "host").where("n > 1.5 * med").select("host", "bar", F.lit(1).cast("bigint").alias("n"))
    return incidents.runs(high, "host").select("host", "first_bar", "last_bar", F.col("lines").alias("bars"))


@query(f"WITH {OBS} SELECT user_id, count(*) AS lines, min(us) AS first_us FROM o WHERE user_id IN (SELECT user_id FROM o WHERE us >= {START + 29 * DAY}) GROUP BY 1")
def active_items(spark, sf_dir):
    """All lines of the users that a last day still saw (semi join)."""
    o = from_events(spark, sf_dir)
    return o.join(o.where(F.col("us") >= START + 29 * DAY).select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("lines"), F.min("us").alias("first_us"))


@query(f"WITH {LINES} SELECT trace_id, span_id, service, duration_ms FROM p WHERE trace_id IN (1, 7, 40)")
def trace_lookup(spark, sf_dir):
    return spans_of(spark, sf_dir).where(F.col("trace_id").isin(1, 7, 40)).select("trace_id", "span_id", "service", "duration_ms")


@query(f"WITH {OBS} SELECT CAST(floor((us - {START}) / {DAY}) AS BIGINT) AS bar, count(DISTINCT user_id) AS sessions, count(DISTINCT host) AS hosts, count(*) FILTER (bad) AS errors FROM o GROUP BY 1")
def session_bars(spark, sf_dir):
    """Distinct sessions by day."""
    o = from_events(spark, sf_dir)
    return o.groupBy(rollups.bucket(DAY, START).alias("bar")).agg(F.countDistinct("user_id").alias("sessions"), F.countDistinct("host").alias("hosts"), F.count_if(rollups.severe()).alias("errors"))


@query("SELECT event_id AS seq, epoch_us(date_trunc('second', ts)) AS us, event_type AS message, 'h' || user_id % 5 AS host, 'app' AS service, CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS severity FROM events")
def canonical_records(spark, sf_dir):
    """JSON records of differing keys as canonical rows: the first of each role's names that is there."""
    e = table(spark, sf_dir, "events")
    s = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    level = F.when(F.col("event_type") == "error", "err").otherwise("notice")
    host = F.concat(F.lit("h"), F.col("user_id") % 5)
    a = F.to_json(F.struct(s.alias("@timestamp"), F.col("event_type").alias("msg"), host.alias("hostname"), F.lit("app").alias("app"), level.alias("level")))
    b = F.to_json(F.struct(s.alias("ts"), F.col("event_type").alias("message"), host.alias("host"), F.lit("app").alias("service"), level.alias("severity")))
    lines = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("value"))
    return ingest.canonical(lines, 2024).select("seq", "us", "message", "host", "service", "severity")


@query(f"WITH {OBS} SELECT seq, host, CASE WHEN host = 'prd-app-03' THEN 'host' WHEN host LIKE 'prd-app-1%' THEN 'glob' WHEN service = 'svc-error' THEN 'application' WHEN environment = 'dev' THEN 'env' ELSE 'all' END AS scope, CASE WHEN host = 'prd-app-03' THEN 10.0 WHEN host LIKE 'prd-app-1%' THEN 20.0 WHEN service = 'svc-error' THEN 30.0 WHEN environment = 'dev' THEN 50.0 ELSE 60.0 END::DOUBLE AS crit FROM o")
def policy_scopes(spark, sf_dir):
    """The policy that applies to each line's host: host, glob, application (the strictest), environment, all."""
    o = from_events(spark, sf_dir).select("seq", "host", "environment", F.when(F.col("service") == "svc-error", F.array(F.lit("shop"), F.lit("pay"))).otherwise(F.array().cast("array<string>")).alias("applications"))
    policies = [("host", "prd-app-03", 10.0, 1), ("glob", "PRD-app-1*", 20.0, 2), ("application", "shop", 40.0, 3), ("application", "pay", 30.0, 4), ("env", "dev", 55.0, 5), ("env", "dev", 50.0, 6), ("all", "*", 60.0, 7)]
    return incidents.policy_for(o, policies)
