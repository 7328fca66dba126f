"""Views that screens ask for: series, tables, details, metrics, comparisons, applications.

All of them aggregate with a partial step before the shuffle; grids of bars come
from the range that was asked for, never from the data's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..sources.observations import MINUTE
from .rollups import bucket, severe

# Steps of a chart's bars in minutes and, below a minute's range, in seconds; bars wanted; order of environments.
STEP_MINUTES = (1, 2, 5, 10, 15, 30, 60, 120, 180, 360, 720, 1440)
STEP_SECONDS = (1, 2, 5, 10, 15, 30, 60)
MOST_BARS = 126
ENVIRONMENT_ORDER = ("prod", "staging", "test", "qa", "dev", "unknown")


def step_us(range_us: int) -> int:
    """Width of a bar: the first step of the ladder that keeps the bars within MOST_BARS."""
    for step in STEP_MINUTES:
        if range_us / (step * MINUTE) <= MOST_BARS:
            return step * MINUTE
    return STEP_MINUTES[-1] * MINUTE


def window_of(now_us: int, last_minutes: int) -> tuple[int, int]:
    """The last minutes before a moment as (start, end), from the beginning of the first minute; resolved once for a query."""
    end = now_us
    return (end - last_minutes * MINUTE) // MINUTE * MINUTE, end


def within(obs: DataFrame, start_us: int, end_us: int) -> DataFrame:
    return obs.where((F.col("us") >= start_us) & (F.col("us") < end_us))


def bars(obs: DataFrame, start_us: int, end_us: int, step: int) -> DataFrame:
    """One row for each bar of the range, from a table of its size."""
    return obs.sparkSession.range((end_us - start_us + step - 1) // step).select(F.col("id").alias("bar"))


def series(obs: DataFrame, start_us: int, end_us: int, step: int | None = None) -> DataFrame:
    """Lines, ERROR+ and WARN lines by bar, quiet bars as zeros."""
    step = step or step_us(end_us - start_us)
    n = within(obs, start_us, end_us).groupBy(bucket(step, start_us).alias("bar")).agg(F.count("*").alias("total"), F.count_if(severe()).alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warn"))
    return bars(obs, start_us, end_us, step).join(n, "bar", "left").select("bar", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "errors", "warn")])


def severity_bars(obs: DataFrame, start_us: int, end_us: int, step: int) -> DataFrame:
    """Lines by bar and each of the severities, quiet ones as zeros."""
    n = within(obs, start_us, end_us).groupBy(bucket(step, start_us).alias("bar"), "severity").agg(F.count("*").alias("events"))
    every = bars(obs, start_us, end_us, step).select("bar", F.explode(F.array(*map(F.lit, text.SEVERITIES))).alias("severity"))
    return every.join(n, ["bar", "severity"], "left").select("bar", "severity", F.coalesce("events", F.lit(0)).alias("events"))


def top_services(obs: DataFrame, most: int = 8) -> DataFrame:
    return obs.where(text.present(F.col("service"))).groupBy("service").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "service").limit(most)


def service_table(obs: DataFrame, minutes: float) -> DataFrame:
    """One row for each service: lines, ERROR+ lines and share, hosts, lines a minute, p95 of the latencies in messages."""
    rows = obs.where(text.present(F.col("service"))).withColumn("b", stats.bucket(text.latency_ms(F.col("message"))))
    n = rows.groupBy("service").agg(F.count("*").alias("lines"), F.count_if(severe()).alias("errors"), F.countDistinct("host").alias("hosts"))
    h = rows.groupBy("service").agg(stats.histogram(F.col("b")).alias("h"))
    return n.join(h, "service").select("service", "lines", "errors", F.round(F.col("errors") / F.col("lines"), 5).alias("error_rate"), "hosts", F.round(F.col("lines") / minutes, 1).alias("per_min"), F.round(stats.quantile(F.col("h"), 0.95), 6).alias("p95"))


def environments(obs: DataFrame) -> DataFrame:
    """Events, errors, availability and hosts of each environment, with its place in a fixed order."""
    env = F.when(text.present(F.col("environment")), F.col("environment")).otherwise("unknown")
    n = obs.groupBy(env.alias("environment")).agg(F.count("*").alias("events"), F.count_if(severe()).alias("errors"), F.countDistinct("host").alias("hosts"))
    place = F.array_position(F.array(*map(F.lit, ENVIRONMENT_ORDER)), F.col("environment"))
    return n.select("environment", "events", "errors", F.round(1 - F.col("errors") / F.col("events"), 9).alias("availability"), "hosts", F.when(place > 0, place).otherwise(len(ENVIRONMENT_ORDER) + 1).cast("int").alias("place"))


def files(obs: DataFrame) -> DataFrame:
    """Lines, errors, last stamp and last ERROR+ message of each host and file."""
    return obs.groupBy("host", "source").agg(F.count("*").alias("lines"), F.count_if(severe()).alias("errors"), F.max("us").alias("last_us"), F.max_by(F.when(severe(), F.col("message")), F.when(severe(), F.struct("us", "seq"))).alias("last_error"))


def slowest(obs: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The slowest lines of each key. Each task keeps its best before the shuffle only as far as Spark's group limit does."""
    rows = obs.withColumn("ms", text.latency_ms(F.col("message"))).where("ms IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ms"), "seq"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "seq", "ms")


def group_counter(obs: DataFrame, step: int) -> DataFrame:
    """Lines by bar, host, message group and severity: what a filter on a group is answered from."""
    key = text.group_key(text.template(F.col("message")), F.col("service"))
    return obs.groupBy(bucket(step).alias("bar"), "host", key.alias("group_key"), "severity").agg(F.count("*").alias("lines"))


def live_groups(obs: DataFrame, least_level: int, service: Column, start_us: int, step: int, trend_bars: int) -> DataFrame:
    """Message groups whose highest level is `least_level` or more, among lines that `service` keeps, with their hosts, pools and trend."""
    rows = obs.where(F.coalesce(service, F.lit(False))).withColumn("template", text.template(F.col("message"))).withColumn("pool", text.pool(F.col("host"))).withColumn("bar", bucket(step, start_us))
    per = rows.groupBy("template", "service", "bar").agg(F.count("*").alias("n"), F.max(text.rank(F.col("severity"))).alias("level"), F.collect_set("host").alias("hosts"), F.collect_set("pool").alias("pools"))
    trend = F.transform(F.sequence(F.lit(0), F.lit(trend_bars - 1)), lambda i: F.coalesce(F.element_at(F.map_from_entries(F.collect_list(F.struct("bar", "n"))), i.cast("bigint")), F.lit(0)))
    g = per.groupBy("template", "service").agg(F.sum("n").alias("lines"), F.max("level").alias("level"), F.size(F.array_distinct(F.flatten(F.collect_list("hosts")))).alias("hosts"), F.size(F.array_distinct(F.flatten(F.collect_list("pools")))).alias("pools"), F.array_join(trend, ",").alias("trend"))
    return g.where(F.col("level") >= least_level)


def previous_period(obs: DataFrame, start_us: int, end_us: int, key: str) -> DataFrame:
    """Lines of each key in a range and in the one of the same length before it."""
    size = end_us - start_us
    now = F.col("us") >= start_us
    n = within(obs, start_us - size, end_us).groupBy(key).agg(F.count_if(now).alias("lines"), F.count_if(~now).alias("before"))
    return n.withColumn("change", F.col("lines") - F.col("before"))


def metrics_of(records: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(us, host, metric, value) of records whose attributes hold metrics; `keys` names the metric that each attribute stands for."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), text.number(F.col("attributes")[k]).alias("value")) for k, m in keys.items()])
    return records.select("us", "host", "environment", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p")).select("us", "host", "environment", "p.*")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest value of each metric and host; of equal stamps the largest."""
    return metrics.groupBy("metric", "host").agg(F.max_by("value", F.struct("us", "value")).alias("value"))


def metric_summary(metrics: DataFrame, crit: dict[str, float], gap: float = 15.0) -> DataFrame:
    """Of each metric's newest values: mean, largest, worst host, and how many reach the warning and the critical level."""
    limits = F.create_map(*[x for m, v in crit.items() for x in (F.lit(m), F.lit(float(v)))])
    n = latest_metrics(metrics).withColumn("crit", limits[F.col("metric")])
    return n.groupBy("metric").agg(
        F.round(F.avg("value"), 1).alias("avg"), F.round(F.max("value"), 1).alias("max"), F.count("*").alias("hosts"), F.max_by("host", F.struct("value", "host")).alias("worst"),
        F.count_if((F.col("value") >= F.col("crit") - gap) & (F.col("value") < F.col("crit"))).alias("warn_n"), F.count_if(F.col("value") >= F.col("crit")).alias("crit_n"),
    )


def metric_bars(metrics: DataFrame, step: int) -> DataFrame:
    """Mean of each metric and host by bar."""
    return metrics.groupBy(bucket(step).alias("bar"), "host", "metric").agg(F.round(F.avg("value"), 1).alias("value"))


def pool_bars(obs: DataFrame, step: int, start_us: int, most: int = 8) -> DataFrame:
    """Lines and errors of the largest pools by bar, all others as `~other`."""
    n = obs.groupBy(text.pool(F.col("host")).alias("pool"), bucket(step, start_us).alias("bar")).agg(F.count("*").alias("lines"), F.count_if(severe()).alias("errors"))
    top = n.groupBy("pool").agg(F.sum("lines").alias("n")).orderBy(F.desc("n"), "pool").limit(most).select("pool", F.lit(True).alias("named"))
    named = n.join(F.broadcast(top), "pool", "left").withColumn("pool", F.when(F.col("named"), F.col("pool")).otherwise("~other"))
    return named.groupBy("pool", "bar").agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Minute or hour counters from several runs, summed: a new part is added to what is stored."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    measures = [c for c in whole.columns if c in ("lines", "errors", "warn") or c.startswith("l_")]
    return whole.groupBy(*[c for c in whole.columns if c not in measures]).agg(*[F.sum(c).alias(c) for c in measures])


def hour_history(obs: DataFrame) -> DataFrame:
    """Lines, errors and a latency histogram of nine columns by hour, environment and service."""
    e = stats.bucket(text.latency_ms(F.col("message")), stats.EDGES)
    rows = obs.withColumn("e", e)
    return rows.groupBy(bucket(60 * MINUTE).alias("hour"), "environment", "service").agg(F.count("*").alias("lines"), F.count_if(severe()).alias("errors"), *[F.count_if(F.col("e") == i).alias(f"l_{i}") for i in range(len(stats.EDGES) + 1)])


def history_figures(history: DataFrame, keys: list[str], target: float) -> DataFrame:
    """Availability, remaining budget and p95 (the bucket's edge) from stored counters alone."""
    n = len(stats.EDGES) + 1
    h = history.groupBy(*keys).agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"), F.array(*[F.sum(f"l_{i}") for i in range(n)]).alias("h"))
    share = F.col("errors") / F.col("lines")
    return h.select(*keys, "lines", "errors", F.round(1 - share, 9).alias("availability"), F.round(F.greatest(F.lit(0.0), 1 - share / (1 - target)), 6).alias("budget_left"), stats.edge_quantile(F.col("h"), 0.95).alias("p95_edge"))


def small_p95(obs: DataFrame, keys: list[str]) -> DataFrame:
    """p95 of few values: the sorted list's element before 95 in 100, or the largest of fewer than 20. For windows of bounded size."""
    v = obs.select(*keys, text.latency_ms(F.col("message")).alias("ms")).where("ms IS NOT NULL").groupBy(*keys).agg(F.sort_array(F.collect_list("ms")).alias("v"))
    n = F.size("v")
    return v.select(*keys, F.when(n >= 20, F.element_at("v", F.floor(n * 0.95).cast("int"))).otherwise(F.element_at("v", -1)).alias("p95"))


def coverage(obs: DataFrame, key: str) -> DataFrame:
    """Share of lines with each of the core fields, in percent."""
    fields = {"timestamp": F.col("us").isNotNull(), "level": text.present(F.col("severity")), "host": text.present(F.col("host")), "service": text.present(F.col("service")), "attributes": F.size(F.map_filter("attributes", lambda k, v: v.isNotNull())) > 1}
    return obs.groupBy(key).agg(F.count("*").alias("lines"), *[F.round(100 * F.avg(c.cast("int")), 2).alias(n) for n, c in fields.items()])


def kpis(obs: DataFrame, side: Column) -> DataFrame:
    """Key figures of two sides of a data set, with their difference."""
    t = text.template(F.col("message"))
    n = obs.withColumn("side", side).groupBy("side").agg(F.count("*").cast("double").alias("events"), F.round(F.avg(severe().cast("int")), 4).alias("error_share"), F.countDistinct("service").cast("double").alias("services"), F.countDistinct("host").cast("double").alias("hosts"), F.countDistinct(t).cast("double").alias("templates"))
    names = ("events", "error_share", "services", "hosts", "templates")
    long = n.select("side", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in names])).alias("x")).select("side", "x.*")
    p = long.groupBy("metric").agg(F.max(F.when(F.col("side") == "a", F.col("v"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("v"))).alias("b"))
    d = F.round(F.col("b") - F.col("a"), 4)
    return p.select("metric", "a", "b", d.alias("delta"), F.round(100 * (F.col("b") - F.col("a")) / F.nullif("a", F.lit(0.0)), 1).alias("delta_pct"))


def page(obs: DataFrame, most: int, before: tuple[int, int] | None = None) -> DataFrame:
    """Newest lines first, behind the cursor (us, seq) of the last line of the page before."""
    # The bound on time alone reaches the scan; that on both doesn't.
    rows = obs if before is None else obs.where(F.col("us") <= before[0]).where(F.struct("us", "seq") < F.struct(F.lit(before[0]).alias("us"), F.lit(before[1]).cast("bigint").alias("seq")))
    return rows.orderBy(F.desc("us"), F.desc("seq")).limit(most)


def line_objects(obs: DataFrame, most: int = 2000, skew_s: int = 120) -> DataFrame:
    """Lines as shown: the message cut, whether it was, and how far its stamp is off its arrival where that is much."""
    off = F.floor((F.col("received_us") - F.col("us")) / 1_000_000)
    return obs.select("seq", "us", F.substring("message", 1, most).alias("message"), (F.length("message") > most).alias("truncated"), F.when(F.abs(off) > skew_s, off).alias("skew_s"))


def member_services(services: DataFrame, members: DataFrame) -> DataFrame:
    """(service, app) of the distinct `services` whose name a member's glob fits."""
    globs = members.where("kind = 'service'").select("app", F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("name"), r"([.+()\[\]{}^$|\\])", r"\\$1"), r"\*+", ".*"), r"\?", "."), F.lit("$")).alias("re"))
    return services.select("service").distinct().join(globs, F.regexp_like(F.lower("service"), F.col("re"))).select("service", "app").distinct()


def owned(counts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of `counts`, one for each host and service, once for each application that has the host or the service."""
    by_host = counts.join(members.where("kind = 'host'").select(F.lower("name").alias("h"), "app"), F.lower("host") == F.col("h")).select("app", *counts.columns)
    by_service = counts.join(member_services(counts, members), "service").select("app", *counts.columns)
    return by_host.unionByName(by_service).distinct()


def applications(obs: DataFrame, members: DataFrame) -> DataFrame:
    """Lines of applications. `members` has app, kind (host, or service as a glob) and name.

    A line counts once for an application, by its host or else by its service.
    Hosts and services are joined as distinct names, not line by line.
    """
    once = owned(obs.groupBy("host", "service").agg(F.count("*").alias("lines"), F.count_if(severe()).alias("errors")), members)
    return once.groupBy("app").agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"), F.countDistinct("host").alias("hosts"), F.countDistinct("service").alias("services"))


def value_overlaps(columns: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of columns (name, value) that share at least this part of the smaller one's distinct values."""
    d = columns.where("value IS NOT NULL").distinct()
    size = d.groupBy("name").agg(F.count("*").alias("n"))
    pair = d.alias("a").join(d.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.name") < F.col("b.name"))).groupBy(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name")).agg(F.count("*").alias("shared"))
    sized = pair.join(size.select(F.col("name").alias("left_name"), F.col("n").alias("n1")), "left_name").join(size.select(F.col("name").alias("right_name"), F.col("n").alias("n2")), "right_name")
    share = F.col("shared") / F.least("n1", "n2")
    return sized.where(share >= least).select("left_name", "right_name", "shared", F.round(share, 4).alias("share"))


def slices(obs: DataFrame, start_us: int, end_us: int, parts: int = 60, keep: int = 4) -> DataFrame:
    """A sample that is the same each time: of every `parts`-th of the range only its first 1 / `keep`; each line stands for `keep`."""
    width = (end_us - start_us) // parts
    return within(obs, start_us, end_us).where(F.pmod(F.col("us") - start_us, F.lit(width)) * keep < width).withColumn("weight", F.lit(keep))
