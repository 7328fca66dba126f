"""Queries of scopes, searches, thresholds' values, span rollups and small joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rollups, search, stacks, vectors, views
from ..sources.observations import MINUTE, from_events, table
from .catalog import BOUNDS, DAY, END, HOUR, LINES, OBS, START, query, spans_of
from .views import _METRICS, METRICS

_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9_\\-]{{2,}}')), lambda t: t NOT IN ('path', 'uuid', 'hex', 'url'))"


def literal(spark, names: str, rows: list[tuple]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names.split(), r, strict=True)]) for r in rows])))


@query(f"WITH {OBS} SELECT host, count(*) AS lines FROM o WHERE host LIKE 'prd-app-0_' OR host = 'prd-app-13' GROUP BY 1")
def team_scope(spark, sf_dir):
    teams = literal(spark, "team host", [("a", "PRD-app-0?"), ("a", "prd-app-13"), ("b", "*")])
    return search.in_scope(from_events(spark, sf_dir), teams, "a").groupBy("host").agg(F.count("*").alias("lines"))


@query(f"WITH {OBS} SELECT seq FROM o WHERE message LIKE '%request%' AND lower(service) LIKE '%error%' AND NOT (message LIKE '%7 ms%') AND severity IN ('ERROR', 'CRITICAL')")
def dataset_search(spark, sf_dir):
    terms = [("", "Request", False), ("service", "ERROR", False), ("", "7 ms", True)]
    return search.dataset_search(from_events(spark, sf_dir), terms, ["message", "service", "host"], ("ERROR", "CRITICAL")).select("seq")


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}') AS has_mail FROM documents WHERE regexp_matches(coalesce(text, ''), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')")
def refused_terms(spark, sf_dir):
    """Documents with a mail address, all of which a search would refuse as terms."""
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(text.EMAIL))
    return d.select("doc_id", search.refused(F.col("text")).alias("has_mail"))


@query(rf"""WITH q AS (SELECT item_id AS query_id, lower(coalesce(text, '')) AS query, {_TOKENS.format("coalesce(text, '')")} AS q FROM benchmark), l AS (SELECT conv_id * 100 + turn AS lesson_id, lower(coalesce(role, '')) AS title, 1 + conv_id % 7 AS occurrences, {_TOKENS.format("coalesce(role, '') || ' ' || coalesce(text, '')")} AS t FROM conversations),
m AS (SELECT query_id, lesson_id, len(q) AS nq, len(t) AS nt, len(list_intersect(q, t)) AS c, occurrences FROM q, l WHERE len(list_intersect(q, t)) > 0), s AS (SELECT query_id, lesson_id, round(0.7e0 * c / nq + 0.3e0 * c / (nq + nt - c) + least(0.1e0, 0.02e0 * (occurrences - 1)), 6) AS score FROM m)
SELECT query_id, lesson_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lesson_id) AS INT) AS place FROM s WHERE score > 0.02 QUALIFY place <= 6""")
def lesson_search(spark, sf_dir):
    """Conversation turns as lessons, benchmark items as queries."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    n = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("lesson_id"), F.coalesce("role", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), (1 + F.col("conv_id") % 7).alias("occurrences"))
    return search.lessons_for(q, n)


@query("SELECT a.page_id AS a, b.page_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM (SELECT page_id, {0} AS t FROM pages) a JOIN (SELECT page_id, {0} AS t FROM pages) b ON a.page_id + 1 = b.page_id WHERE len(a.t) > 0 AND len(b.t) > 0".format(_TOKENS.format("coalesce(url, '')")))
def token_similarity(spark, sf_dir):
    """Likeness of neighbouring pages' urls by tokens."""
    p = table(spark, sf_dir, "pages").select("page_id", search.tokens(F.coalesce("url", F.lit(""))).alias("t"))
    j = p.alias("a").join(p.alias("b"), F.col("a.page_id") + 1 == F.col("b.page_id")).where((F.size("a.t") > 0) & (F.size("b.t") > 0))
    return j.select(F.col("a.page_id").alias("a"), F.col("b.page_id").alias("b"), F.round(search.similarity(F.col("a.t"), F.col("b.t")), 6).alias("similarity"))


@query(f"""WITH {OBS}, s AS (SELECT DISTINCT 'g-' || service || host || (us - us % {HOUR}) AS fingerprint, service, host, us - us % {HOUR} AS onset_us FROM o WHERE seq % 50 = 0),
t AS (SELECT seq AS ticket_id, us, seq % 3 AS kind, service, host FROM o WHERE seq % 20 = 0), m AS (SELECT ticket_id, t.us, s.onset_us, 0.6 AS score FROM t JOIN s ON t.kind = 0 AND t.service = s.service UNION ALL SELECT ticket_id, t.us, s.onset_us, 0.45 FROM t JOIN s ON t.kind = 1
  UNION ALL SELECT ticket_id, us, NULL, 0.7 FROM t WHERE kind = 0 AND host = 'prd-app-03' UNION ALL SELECT ticket_id, us, {START + 9 * DAY}, 0.8 FROM t WHERE kind = 0 AND service = 'svc-error'),
b AS (SELECT ticket_id, max(score) AS best, count(*) AS related, count(onset_us) AS onsets, bool_or(abs(us - onset_us) <= {30 * MINUTE}) AS near FROM m GROUP BY 1), a AS (SELECT ticket_id, EXISTS (SELECT 1 FROM s WHERE abs(t.us - s.onset_us) <= {30 * MINUTE}) AS any_near FROM t),
j AS (SELECT t.ticket_id, t.us, coalesce(best, 0) AS best, coalesce(related, 0) AS related, coalesce(CASE WHEN coalesce(onsets, 0) > 0 THEN near ELSE any_near END, false) AS near FROM t LEFT JOIN b USING (ticket_id) JOIN a ON a.ticket_id = t.ticket_id)
SELECT ticket_id, CAST(round(CAST(CAST(least(1e0, 0.65e0 * CAST(best AS DOUBLE) + 0.35e0 * CASE WHEN near THEN 1e0 WHEN {START + 10 * DAY} - us <= {30 * MINUTE} THEN 0.5e0 ELSE 0e0 END) AS VARCHAR) AS DECIMAL(20, 17)), 2) AS DOUBLE) AS relevance, related, near FROM j""")
def ticket_relevance(spark, sf_dir):
    """Tickets against signals, a breach and an incident; those that name nothing count by time alone."""
    o = from_events(spark, sf_dir)
    s = o.where("seq % 50 = 0").select(F.concat(F.lit("g-"), "service", "host", F.col("us") - F.col("us") % HOUR).alias("fingerprint"), F.lit("error burst in payment module").alias("template"), "service", "host", (F.col("us") - F.col("us") % HOUR).alias("onset_us")).distinct()
    r = F.col("seq") % 3
    t = o.where("seq % 20 = 0").select(F.col("seq").alias("ticket_id"), "us", F.when(r == 0, F.concat(F.lit("trouble with "), "service", F.when(F.col("host") == "prd-app-03", " cpu").otherwise(""))).when(r == 1, "payment module shows an error").otherwise("nothing known").alias("text"))
    breaches = spark.createDataFrame([("cpu", "elsewhere")], "metric string, host string")
    incident = spark.createDataFrame([("INC-1", "svc-error", START + 9 * DAY), ("INC-1", "svc-none", START + 9 * DAY)], "incident string, name string, onset_us long")
    return search.tickets(t, s, 30, START + 10 * DAY, breaches, incident)


@query("SELECT (SELECT count(*) FROM conversations) AS lessons, true AS unit")
def lesson_vectors(spark, sf_dir):
    """Conversation turns with their vectors, each of length 1."""
    n = table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit("")).alias("text"))
    v = vectors.with_vectors(n)
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return v.agg(F.count("*").alias("lessons"), F.bool_and(F.abs(length - 1) < 1e-4).alias("unit"))


@query()
def blended_lessons(spark, sf_dir):
    """Lessons by words and vectors. No SQL: it has no blake2b; tests hold it against plain Python."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    n = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("lesson_id"), F.coalesce("role", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), (1 + F.col("conv_id") % 7).alias("occurrences"))
    return vectors.ranked_lessons(q, vectors.with_vectors(n))


@query(f"""WITH w AS (SELECT unnest(['port', 'process', 'listener', 'inventory', 'log', 'agent', 'trace', 'banner', 'manual']) AS source, unnest([1, 2, 2, 2, 2, 3, 3, 3, 5]) AS weight, unnest(range(9)) AS i),
e AS (SELECT 'host-' || (l_suppkey % 40) AS host, l_partkey % 25 AS k, source, weight, source IN ('agent', 'trace', 'banner', 'manual') AS direct FROM lineitem JOIN w ON i = CASE WHEN l_linenumber % 7 = 6 THEN l_orderkey % 9 ELSE l_linenumber % 5 END WHERE (l_partkey + l_suppkey) % 11 = 0),
p AS (SELECT host, k, source, max(weight) AS weight, bool_or(direct) AS direct FROM e GROUP BY 1, 2, 3), c AS (SELECT host, k, bool_or(direct) AS direct, sum(weight) AS weight, count(*) AS sources FROM p GROUP BY 1, 2),
d AS (SELECT c.*, n_name AS name, 'layer-' || n_regionkey AS layer, n_nationkey % 3 AS role_rank FROM c JOIN nation ON n_nationkey = k WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.host = c.host AND o.k = c.k + 3 AND c.k % 4 = 0)),
r AS (SELECT *, CASE WHEN direct THEN 'certain' WHEN sources >= 2 THEN 'high' ELSE 'possible' END AS confidence FROM d)
SELECT host, layer, name, CAST(weight AS BIGINT) AS weight, sources, confidence, CAST(row_number() OVER (PARTITION BY host, layer ORDER BY role_rank, CASE confidence WHEN 'certain' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, weight DESC, sources DESC, name) AS INT) AS place FROM r QUALIFY place <= 3""")
def host_stacks(spark, sf_dir):
    """What runs on each host by layer, from weighted evidence; nations stand for technologies, regions for layers."""
    w = F.array(*map(F.lit, ("port", "process", "listener", "inventory", "log", "agent", "trace", "banner", "manual")))
    i = F.when(F.col("l_linenumber") % 7 == 6, F.col("l_orderkey") % 9).otherwise(F.col("l_linenumber") % 5)
    e = table(spark, sf_dir, "lineitem").where("(l_partkey + l_suppkey) % 11 = 0").select(F.concat(F.lit("host-"), F.col("l_suppkey") % 40).alias("host"), (F.col("l_partkey") % 25).cast("string").alias("key"), F.get(w, i.cast("int")).alias("source"), F.lit(None).cast("string").alias("version"))
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("layer-"), "n_regionkey").alias("layer"), (F.col("n_nationkey") % 3).alias("role_rank"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0 AND n_nationkey < 22").select((F.col("n_nationkey") + 3).cast("string").alias("key"), F.col("n_nationkey").cast("string").alias("replaces"))
    return stacks.host_stacks(stacks.attributed(e), t, n).select("host", "layer", "name", "weight", "sources", "confidence", "place")


@query(f"""WITH {OBS}, {_METRICS}, {BOUNDS}, r AS (SELECT * FROM o WHERE us >= {START + 9 * DAY} AND us < {START + 10 * DAY}), h AS (SELECT host, i, lo, hi, count(*) AS c FROM r JOIN b ON (ms > lo OR i = 0) AND (ms <= hi OR i = 22) AND (i > 0 OR ms <= 1) WHERE ms >= 0 GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY host ORDER BY i) AS acc, sum(c) OVER (PARTITION BY host) AS n FROM h),
q AS (SELECT host, round(arg_min(lo + (hi - lo) * ((0.95 * n - (acc - c)) / c), i), 6) AS v FROM w WHERE acc >= 0.95 * n AND n >= 5 GROUP BY 1)
SELECT host, 'error_rate' AS metric, round(100.0 * count(*) FILTER (bad) / count(*), 3) AS value FROM r GROUP BY 1 UNION ALL SELECT host, 'errors_per_min', round(count(*) FILTER (bad) / 1440, 2) FROM r GROUP BY 1 UNION ALL SELECT host, 'silent_min', round(({START + 10 * DAY} - max(us)) / {MINUTE}, 1) FROM r GROUP BY 1 UNION ALL SELECT host, 'p95_ms', v FROM q UNION ALL SELECT host, metric, round(value, 2) FROM l""")
def threshold_values(spark, sf_dir):
    o = from_events(spark, sf_dir)
    return search.host_values(o, views.metrics_of(o, METRICS), START + 10 * DAY, 1440)


@query(f"WITH {OBS}, {_METRICS}, p AS (SELECT host, metric, us // {HOUR} AS bar, round(avg(value), 1) AS v FROM m WHERE us < {END} GROUP BY 1, 2, 3), n AS (SELECT host, metric, avg(v) AS observed FROM p WHERE bar >= {END // HOUR - 48} GROUP BY 1, 2), d AS (SELECT host, metric, median(v) AS med, count(*) AS k FROM p WHERE bar < {END // HOUR - 48} GROUP BY 1, 2 HAVING count(*) >= 30), a AS (SELECT host, metric, median(abs(v - med)) * 1.4826 AS mad FROM p JOIN d USING (host, metric) WHERE bar < {END // HOUR - 48} GROUP BY 1, 2), z AS (SELECT host, metric, observed, med, (observed - med) / greatest(mad, 1.0, 0.1 * med) AS z FROM n JOIN d USING (host, metric) JOIN a USING (host, metric)) SELECT host, metric, round(observed, 6) AS observed, round(med, 6) AS normal, round(z, 6) AS z, z >= 4 AND observed - med >= 15 AS anomaly FROM z")
def metric_anomalies(spark, sf_dir):
    return search.metric_anomalies(views.metrics_of(from_events(spark, sf_dir), METRICS), END, 48, step=HOUR)


@query(f"WITH {OBS}, p AS (SELECT host, us // {5 * MINUTE} AS bar, count(*) AS n FROM o WHERE us >= {END - 28 * DAY} AND us < {END - DAY} GROUP BY 1, 2), t AS (SELECT host, n FROM p WHERE isodow(make_timestamp(bar * {5 * MINUTE})) = isodow(make_timestamp({END})) AND abs(hour(make_timestamp(bar * {5 * MINUTE})) - hour(make_timestamp({END}))) <= 1) SELECT host, median(n) AS normal, count(*) AS bars FROM t GROUP BY 1 HAVING count(*) >= 1")
def seasonal_baseline(spark, sf_dir):
    return search.seasonal(from_events(spark, sf_dir), END, step=5 * MINUTE, least=1)


@query(f"WITH {OBS}, r AS (SELECT * FROM o WHERE us >= {START + 5 * DAY} AND us < {START + 6 * DAY}) SELECT 'errors' AS rule, count(*) FILTER (bad) AS lines, count(*) FILTER (bad) >= 5 AS fires FROM r UNION ALL SELECT 'quiet', count(*) FILTER (message LIKE '%purchase%'), count(*) FILTER (message LIKE '%purchase%') < 3 FROM r UNION ALL SELECT 'slow', count(*) FILTER (ms > 100), count(*) FILTER (ms > 100) >= 100000 FROM r")
def query_alerts(spark, sf_dir):
    rules = {"errors": (rollups.severe(), ">=", 5), "quiet": (F.col("message").contains("purchase"), "<", 3), "slow": (text.latency_ms(F.col("message")) > 100, ">=", 100_000)}
    return search.query_alerts(from_events(spark, sf_dir), rules, START + 5 * DAY, START + 6 * DAY)


@query(f"WITH {LINES}, c AS (SELECT trace_id, min(start_ms) AS t FROM p WHERE error OR kind IN ('user', 'mobile') GROUP BY 1) SELECT p.trace_id, span_id FROM p LEFT JOIN c USING (trace_id) WHERE error OR duration_ms >= 895 OR kind IN ('user', 'mobile') OR start_ms >= t - 120000 OR CAST('0x' || substr(sha1(CAST(p.trace_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 1000")
def sampled_traces(spark, sf_dir):
    return search.sampled_traces(spans_of(spark, sf_dir), 10, 895).select("trace_id", "span_id")


@query(f"WITH {LINES} SELECT CAST(floor(start_ms / 100) AS BIGINT) AS bar, service, kind, count(*) AS calls, count(*) FILTER (error) AS errors, sum(duration_ms) AS total_ms, max(duration_ms) AS max_ms FROM p GROUP BY 1, 2, 3")
def span_rollup(spark, sf_dir):
    return search.span_rollup(spans_of(spark, sf_dir), 100).drop("h")


@query(f"WITH {LINES}, a AS (SELECT trace_id, count(*) AS spans, count(DISTINCT service) AS services, bool_or(error) AS failed FROM p WHERE kind NOT IN ('user', 'mobile', 'log') GROUP BY 1) SELECT p.trace_id, p.span_id, coalesce(spans, 0) AS spans, coalesce(services, 0) AS services, coalesce(failed, false) AS failed FROM p LEFT JOIN a USING (trace_id) WHERE kind = 'user'")
def step_backends(spark, sf_dir):
    """What lies behind each step of a user, in the services."""
    s = spans_of(spark, sf_dir)
    behind = s.where(~F.col("kind").isin("user", "mobile", "log")).groupBy("trace_id").agg(F.count("*").alias("spans"), F.countDistinct("service").alias("services"), F.max("error").alias("failed"))
    return s.where("kind = 'user'").join(behind, "trace_id", "left").select("trace_id", "span_id", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("services", F.lit(0)).alias("services"), F.coalesce("failed", F.lit(False)).alias("failed"))


@query("WITH i AS (SELECT s_suppkey AS record, 'Srv-' || s_suppkey AS host FROM supplier) SELECT l_orderkey, l_linenumber, l_suppkey, record, host FROM lineitem LEFT JOIN i ON record = CASE WHEN l_suppkey % 4 = 3 THEN NULL ELSE l_suppkey END")
def inventory_keys(spark, sf_dir):
    """Lines that use a record's name, alias or address, or something unknown."""
    k = F.col("s_suppkey")
    inv = table(spark, sf_dir, "supplier").select(k.alias("record"), F.concat(F.lit("Srv-"), k).alias("name"), F.array(F.concat(F.lit("alias"), k), F.concat(F.lit("other"), k)).alias("aliases"), F.concat(F.lit("10.0.0."), k).alias("ip"))
    r, s = F.col("l_suppkey") % 4, F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.when(r == 0, F.concat(F.lit("SRV-"), s)).when(r == 1, F.concat(F.lit("Alias"), s)).when(r == 2, F.concat(F.lit("10.0.0."), s)).otherwise("who").alias("name"))
    return search.inventory_join(rows, inv).drop("name")


@query("SELECT prefix, count(*) AS services FROM (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) || '-' || p_size AS service, lower(split_part(p_type, ' ', 1)) AS prefix FROM part) WHERE length(prefix) >= 2 GROUP BY 1 HAVING count(*) >= 2")
def application_groups(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.concat(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.lit("-"), "p_size").alias("service"))
    return search.application_groups(s)


@query("SELECT min(conv_id * 100 + turn) AS id, role AS question, text AS answer FROM conversations GROUP BY role, text")
def training_examples(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("question"), F.col("text").alias("answer"))
    return search.training_examples(c).select("id", "question", "answer")
