"""Scopes, searches over texts and lessons, tickets, and alert values of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..sources.observations import MINUTE
from .rollups import bucket, severe
from .spans import kept

#: Tokens of a template, and those that say nothing.
TOKEN, PLAIN_TOKENS = r"[a-z][a-z0-9_\-]{2,}", ("path", "uuid", "hex", "url")


def tokens(column: Column) -> Column:
    """Distinct tokens of a text."""
    return F.array_except(F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0)), F.array(*map(F.lit, PLAIN_TOKENS)))


def similarity(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 0 without tokens on either side."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def in_scope(obs: DataFrame, teams: DataFrame, team: str) -> DataFrame:
    """Lines of a team's hosts; `teams` has team and host as a glob. Hosts are matched once each, then lines by host."""
    glob = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("pattern"), r"([.+()\[\]{}^$|\\])", r"\\$1"), r"\*+", ".*"), r"\?", "."), F.lit("$"))
    own = teams.where(F.col("team") == team).select(F.col("host").alias("pattern")).select(glob.alias("re"))
    hosts = obs.select("host").distinct()
    return obs.join(hosts.join(own, F.regexp_like(F.lower("host"), F.col("re"))).select("host").distinct(), "host", "left_semi")


def haystack(fields: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def dataset_search(obs: DataFrame, terms: list[tuple[str, str, bool]], fields: list[str], severities: tuple[str, ...] = ()) -> DataFrame:
    """Lines that hold every term and none of the negated ones; a term is (field or empty for any of `fields`, text, negated)."""
    keep = F.col("severity").isin(*severities) if severities else F.lit(True)
    for field, term, negated in terms:
        there = F.coalesce((F.lower(F.col(field)) if field else haystack(fields)).contains(term.lower()), F.lit(False))
        keep = keep & (~there if negated else there)
    return obs.where(keep)


def refused(term: Column) -> Column:
    """Whether a search term holds what scrubbing would replace."""
    return text.scrub(term) != F.coalesce(term, F.lit(""))


def lessons_for(queries: DataFrame, lessons: DataFrame, most: int = 6) -> DataFrame:
    """The best lessons for each query by shared tokens, coverage first, with a little for how often a lesson occurred.

    `queries` (query_id, query), `lessons` (lesson_id, title, text, occurrences).
    Lessons and queries meet by tokens that they share, and by nothing else.
    """
    q = queries.select("query_id", F.lower("query").alias("query"), tokens(F.col("query")).alias("q"))
    n = lessons.select("lesson_id", F.lower("title").alias("title"), "occurrences", tokens(F.concat_ws(" ", "title", "text")).alias("t"))
    met = q.select("query_id", F.size("q").alias("nq"), F.explode("q").alias("token")).join(n.select("lesson_id", F.size("t").alias("nt"), F.explode("t").alias("token")), "token").groupBy("query_id", "lesson_id", "nq", "nt").agg(F.count("*").alias("common"))
    lex = 0.7 * F.col("common") / F.col("nq") + 0.3 * F.col("common") / (F.col("nq") + F.col("nt") - F.col("common"))
    j = met.withColumn("lex", lex).join(n.select("lesson_id", "title", "occurrences"), "lesson_id").join(q.select("query_id", "query"), "query_id")
    score = F.when(F.col("title").contains(F.col("query")), F.greatest("lex", F.lit(0.6))).otherwise(F.col("lex")) + F.least(F.lit(0.1), 0.02 * (F.col("occurrences") - 1))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "lesson_id"))
    return j.withColumn("score", F.round(score, 6)).where("score > 0.02").withColumn("place", place).where(F.col("place") <= most).select("query_id", "lesson_id", "score", "place")


def _near_any(rows: DataFrame, onsets: DataFrame, window_us: int) -> DataFrame:
    """(ticket_id, near_any): whether any of the onsets lies within the window of a ticket's time. A slot's first and last onset tell it, whatever their number."""
    slots = onsets.where("onset_us IS NOT NULL").groupBy(F.floor(F.col("onset_us") / window_us).alias("slot")).agg(F.min("onset_us").alias("lo"), F.max("onset_us").alias("hi"))
    at = rows.select("ticket_id", "us", F.explode(F.array(*[(F.floor(F.col("us") / window_us) + k).alias("slot") for k in (-1, 0, 1)])).alias("slot")).join(slots, "slot")
    close = F.col("lo").between(F.col("us") - window_us, F.col("us") + window_us) | F.col("hi").between(F.col("us") - window_us, F.col("us") + window_us)
    return at.groupBy("ticket_id").agg(F.bool_or(close).alias("near_any"))


def tickets(rows: DataFrame, signals: DataFrame, window_min: int = 30, now_us: int | None = None, breaches: DataFrame | None = None, incidents: DataFrame | None = None) -> DataFrame:
    """How much a ticket (ticket_id, text, us) has to do with signals, breaches and incidents: relevance, related and near.

    `signals` has fingerprint (unique), template, service, host and onset_us. A shared
    service or host counts 0.6, each shared specific word 0.15; a match needs one
    of the former or two words. A breach (metric, host) that the ticket names
    counts 0.7, an incident (incident, name, onset_us; a row for each of its
    services and hosts) 0.8. 0.65 of the best is text, 0.35 time: in full if a
    related onset - of all signals, where nothing is related - is within the
    window, half if the ticket itself is no older than that at `now_us`.
    """
    window = window_min * MINUTE
    # Tickets of the same tokens, and signals of the same names and words, are one kind each: kinds are paired, not rows.
    said_by = rows.select("ticket_id", "us", F.array_sort(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).alias("said"))
    known = signals.select("onset_us", F.array_sort(F.array_compact(F.array_distinct(F.array(F.lower("service"), F.lower("host"))))).alias("names"), F.coalesce(F.array_sort(F.filter(tokens(F.col("template")), lambda w: F.length(w) >= 4)), F.array().cast("array<string>")).alias("words"))
    slot = lambda at: F.floor(at / window)
    slots = known.groupBy("names", "words", slot(F.col("onset_us")).alias("slot")).agg(F.count("*").alias("k"), F.count("onset_us").alias("onsets"), F.min("onset_us").alias("lo"), F.max("onset_us").alias("hi"))
    kinds = slots.groupBy("names", "words").agg(F.sum("k").alias("k"), F.sum("onsets").alias("onsets"))
    t = said_by.select("said").distinct().select("said", F.explode("said").alias("token"))
    named = kinds.select("names", "words", "k", "onsets", F.explode("names").alias("token"), F.lit(1).alias("name"), F.lit(0).alias("word"))
    worded = kinds.select("names", "words", "k", "onsets", F.explode("words").alias("token"), F.lit(0).alias("name"), F.lit(1).alias("word"))
    m = t.join(named.unionByName(worded), "token").groupBy("said", "names", "words", "k", "onsets").agg(F.max("name").alias("name"), F.sum("word").alias("n"))
    m = m.where("name = 1 OR n >= 2").withColumn("score", F.least(F.lit(1.0), 0.6 * F.col("name") + 0.15 * F.col("n")))
    items = m.select("said", "score", "k", "onsets")
    times = m.select("said", "names", "words").join(slots.where("slot IS NOT NULL").select("names", "words", "slot", "lo", "hi"), ["names", "words"]).select("said", "slot", "lo", "hi")
    if breaches is not None:
        broken = breaches.select(F.explode(F.array(F.lower("host"), "metric")).alias("token"), F.concat_ws("@", "metric", "host").alias("breach"))
        items = items.unionByName(t.join(broken, "token").select("said", "breach").distinct().select("said", F.lit(0.7).alias("score"), F.lit(1).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("onsets")))
    if incidents is not None:
        at = incidents.select(F.lower("name").alias("token"), "incident", "onset_us")
        met = t.join(at, "token").groupBy("said", "incident").agg(F.min("onset_us").alias("onset_us"))
        items = items.unionByName(met.select("said", F.lit(0.8).alias("score"), F.lit(1).cast("bigint").alias("k"), F.col("onset_us").isNotNull().cast("bigint").alias("onsets")))
        times = times.unionByName(met.where("onset_us IS NOT NULL").select("said", slot(F.col("onset_us")).alias("slot"), F.col("onset_us").alias("lo"), F.col("onset_us").alias("hi")))
    best = items.groupBy("said").agg(F.max("score").alias("best"), F.sum("onsets").alias("onsets"), F.sum("k").alias("related"))
    times = times.groupBy("said", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # A slot's first and last onset tell whether one is near; tickets of the same tokens and time are asked for once.
    asked = said_by.select("said", "us").distinct().select("said", "us", F.explode(F.array(*[(slot(F.col("us")) + i).alias("slot") for i in (-1, 0, 1)])).alias("slot")).join(times, ["said", "slot"])
    close = F.col("lo").between(F.col("us") - window, F.col("us") + window) | F.col("hi").between(F.col("us") - window, F.col("us") + window)
    near_own = asked.groupBy("said", "us").agg(F.bool_or(close).alias("near"))
    j = said_by.join(best, "said", "left").join(near_own, ["said", "us"], "left").join(_near_any(rows, signals, window), "ticket_id", "left")
    near = F.coalesce(F.when(F.coalesce("onsets", F.lit(0)) > 0, F.coalesce("near", F.lit(False))).otherwise(F.col("near_any")), F.lit(False))
    young = F.lit(False) if now_us is None else F.coalesce(F.lit(now_us) - F.col("us") <= window, F.lit(False))
    time = F.when(near, 1.0).when(young, 0.5).otherwise(0.0)
    return j.select("ticket_id", F.round(F.least(F.lit(1.0), 0.65 * F.coalesce("best", F.lit(0.0)) + 0.35 * time), 2).alias("relevance"), F.coalesce("related", F.lit(0)).alias("related"), near.alias("near"))


def host_values(obs: DataFrame, metrics: DataFrame, now_us: int, window_min: int) -> DataFrame:
    """(host, metric, value) that thresholds look at: newest metrics, and of the window's lines error_rate, errors_per_min, silent_min and p95_ms."""
    rows = obs.where((F.col("us") >= now_us - window_min * MINUTE) & (F.col("us") < now_us)).withColumn("b", stats.bucket(text.latency_ms(F.col("message"))))
    n = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if(severe()).alias("e"), F.max("us").alias("last"), stats.histogram(F.col("b")).alias("h"), F.count("b").alias("timed"))
    pairs = F.array(
        F.struct(F.lit("error_rate").alias("metric"), F.round(100.0 * F.col("e") / F.col("n"), 3).alias("value")), F.struct(F.lit("errors_per_min").alias("metric"), F.round(F.col("e") / window_min, 2).alias("value")),
        F.struct(F.lit("silent_min").alias("metric"), F.round((F.lit(now_us) - F.col("last")) / MINUTE, 1).alias("value")), F.struct(F.lit("p95_ms").alias("metric"), F.when(F.col("timed") >= 5, F.round(stats.quantile(F.col("h"), 0.95), 6)).alias("value")),
    )
    own = n.select("host", F.explode(pairs).alias("p")).select("host", "p.*").where("value IS NOT NULL")
    newest = metrics.groupBy("host", "metric").agg(F.round(F.max_by("value", F.struct("us", "value")), 2).alias("value"))
    return own.unionByName(newest)


def metric_anomalies(metrics: DataFrame, now_us: int, window: int, least: int = 30, limit: float = 4.0, delta: float = 15.0, step: int = MINUTE) -> DataFrame:
    """Metrics whose mean over the last bars lies far above the bars before, by median and scaled deviation."""
    per = metrics.where(F.col("us") < now_us).groupBy("host", "metric", bucket(step).alias("bar")).agg(F.round(F.avg("value"), 1).alias("v"))
    cut = now_us // step - window
    now = per.where(F.col("bar") >= cut).groupBy("host", "metric").agg(F.avg("v").alias("observed"))
    old = per.where(F.col("bar") < cut)
    med = old.groupBy("host", "metric").agg(F.median("v").alias("med"), F.count("*").alias("n")).where(F.col("n") >= least)
    mad = old.join(med, ["host", "metric"]).groupBy("host", "metric").agg((F.median(F.abs(F.col("v") - F.col("med"))) * stats.MAD_SCALE).alias("mad"))
    j = now.join(med, ["host", "metric"]).join(mad, ["host", "metric"])
    j = j.withColumn("z", stats.zscore(F.col("observed"), F.col("med"), F.col("mad")))
    return j.select("host", "metric", F.round("observed", 6).alias("observed"), F.round("med", 6).alias("normal"), F.round("z", 6).alias("z"), ((F.col("z") >= limit) & (F.col("observed") - F.col("med") >= delta)).alias("anomaly"))


def seasonal(obs: DataFrame, now_us: int, weeks: int = 4, step: int = MINUTE, least: int = 60) -> DataFrame:
    """Lines of each host in the bars of the same weekday and hour, give or take one, of the weeks before: their median and how many bars."""
    day = 1440 * MINUTE
    at = F.col("bar") * step
    hour, weekday = F.pmod(F.floor(at / (60 * MINUTE)), F.lit(24)), F.pmod(F.floor(at / day) + 3, F.lit(7))
    now_hour, now_weekday = now_us // (60 * MINUTE) % 24, (now_us // day + 3) % 7
    per = obs.where((F.col("us") >= now_us - weeks * 7 * day) & (F.col("us") < now_us - day)).groupBy("host", bucket(step).alias("bar")).agg(F.count("*").alias("n"))
    same = per.where((weekday == now_weekday) & (F.abs(hour - now_hour) <= 1))
    return same.groupBy("host").agg(F.median("n").alias("normal"), F.count("*").alias("bars")).where(F.col("bars") >= least)


def query_alerts(obs: DataFrame, rules: dict[str, tuple[Column, str, int]], start_us: int, end_us: int) -> DataFrame:
    """Rules (predicate, `>=` or `<`, number of lines) over a whole window: how many lines match, and whether the rule fires. One scan for all."""
    counted = obs.where((F.col("us") >= start_us) & (F.col("us") < end_us)).agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, (p, _, _) in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("lines"), (F.col(n) >= least if op == ">=" else F.col(n) < least).alias("fires")) for n, (_, op, least) in rules.items()])
    return counted.select(F.inline(rows))


def sampled_traces(spans: DataFrame, percent: float, slow_ms: float, hold_ms: float = 120_000) -> DataFrame:
    """Spans that are kept: a fixed share of traces by hash, failed, slow and users' spans, and the traces that an error or a user's or device's span claims."""
    return kept(spans, percent, slow_ms, F.col("error") | F.col("kind").isin("user", "mobile"), "start_ms", hold_ms)


def span_rollup(spans: DataFrame, step_ms: int) -> DataFrame:
    """Calls, errors, time and histogram of each bar, service and kind: what services are shown from."""
    b = spans.withColumn("b", stats.bucket(F.col("duration_ms"))).withColumn("bar", F.floor(F.col("start_ms") / step_ms).cast("bigint"))
    return b.groupBy("bar", "service", "kind").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), stats.histogram(F.col("b")).alias("h"))


def inventory_join(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows (name) with the record (record, name, aliases, ip) whose name, alias or address they use, in that order."""
    keys = inventory.select("record", F.col("name").alias("host"), F.explode(F.concat(F.array(F.struct(F.lower("name").alias("key"), F.lit(0).alias("rank"))), F.transform("aliases", lambda a: F.struct(F.lower(a).alias("key"), F.lit(1).alias("rank"))), F.array(F.struct(F.col("ip").alias("key"), F.lit(2).alias("rank"))))).alias("k"))
    one = keys.where("k.key IS NOT NULL").groupBy(F.col("k.key").alias("key")).agg(F.min_by(F.struct("record", "host"), F.struct("k.rank", "record")).alias("r"))
    return rows.join(one, F.lower("name") == F.col("key"), "left").select(*rows.columns, F.col("r.record").alias("record"), F.col("r.host").alias("host"))


def application_groups(services: DataFrame, least: int = 2, generic: tuple[str, ...] = ("app", "svc", "service", "prd", "prod", "test", "dev")) -> DataFrame:
    """Groups of services with a prefix of two letters or more before the first `-`, `_` or `.`, which isn't a generic one."""
    prefix = F.regexp_extract(F.lower("service"), r"^([a-z]{2,}[a-z0-9]*)[-_.]", 1)
    return services.select("service", prefix.alias("prefix")).where((F.col("prefix") != "") & ~F.col("prefix").isin(*generic)).distinct().groupBy("prefix").agg(F.count("*").alias("services")).where(F.col("services") >= least)


def training_examples(pairs: DataFrame, parts: int = 10, held: int = 1) -> DataFrame:
    """Questions and answers, each pair once, with a split that a hash of the question fixes."""
    once = pairs.groupBy("question", "answer").agg(F.min("id").alias("id"))
    return once.select("id", "question", "answer", F.when(F.pmod(F.crc32(F.col("question").cast("binary")), F.lit(parts)) < held, "eval").otherwise("train").alias("split"))
