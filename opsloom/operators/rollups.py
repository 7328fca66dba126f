"""Counters over observations: histograms, facets, groups, service levels, latency, fleets.

Every operator aggregates with a partial step before its shuffle; zero-filled
grids come from the bounded range of buckets, never from the data's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..sources.observations import MINUTE

SEVERE = ("ERROR", "CRITICAL")


def severe() -> Column:
    return F.col("severity").isin(*SEVERE)


def bucket(step_us: int, start_us: int = 0) -> Column:
    return F.floor((F.col("us") - start_us) / step_us).cast("bigint")


def counts(obs: DataFrame, keys: list[str], step_us: int = MINUTE) -> DataFrame:
    """Lines and ERROR+ lines by bucket and keys."""
    return obs.groupBy(bucket(step_us).alias("bucket"), *keys).agg(F.count("*").alias("lines"), F.count_if(severe()).alias("errors"))


def histogram(obs: DataFrame, key: str, step_us: int, start_us: int, bars: int, most: int = 8) -> DataFrame:
    """Lines by bar and key, zero-filled; keys beyond the `most` largest become `_other`."""
    rows = obs.where((F.col("us") >= start_us) & (F.col("us") < start_us + bars * step_us))
    n = rows.groupBy(bucket(step_us, start_us).alias("bar"), F.col(key).alias("key")).agg(F.count("*").alias("lines"))
    top = n.groupBy("key").agg(F.sum("lines").alias("total")).orderBy(F.desc("total"), "key").limit(most).select("key", F.lit(True).alias("named"))
    n = n.join(F.broadcast(top), "key", "left").groupBy("bar", F.when(F.col("named"), F.col("key")).otherwise("_other").alias("key")).agg(F.sum("lines").alias("lines"))
    grid = n.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"))
    return grid.join(n, ["key", "bar"], "left").select(F.col("bar").cast("bigint").alias("bar"), "key", F.coalesce("lines", F.lit(0)).alias("lines"))


def facets(obs: DataFrame, clauses: dict[str, Column], fields: list[str]) -> DataFrame:
    """Counts of each field's values; a field's own clause doesn't restrict its values. One scan for all fields."""
    exploded = []
    for f in fields:
        keep = F.lit(True)
        for name, clause in clauses.items():
            if name != f:
                keep = keep & F.coalesce(clause, F.lit(False))
        exploded.append(F.when(keep, F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))))
    rows = obs.select(F.explode(F.filter(F.array(*exploded), lambda x: x.isNotNull())).alias("x"))
    return rows.groupBy("x.field", "x.value").agg(F.count("*").alias("lines"))


def groups(obs: DataFrame) -> DataFrame:
    """Similar messages: count, highest level, hosts, first and last stamp, newest sample, by template and service."""
    rows = obs.withColumn("template", text.template(F.col("message")))
    made = rows.groupBy("template", "service").agg(
        F.count("*").alias("lines"), F.max(text.rank(F.col("severity"))).alias("level"), F.countDistinct("host").alias("hosts"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("message", F.struct("us", "seq")).alias("sample"),
    )
    return made.withColumn("group_key", text.group_key(F.col("template"), F.col("service")))


def service_levels(obs: DataFrame, keys: list[str], target: float = 0.99) -> DataFrame:
    """Availability and what is left of the error budget."""
    n = obs.groupBy(*keys).agg(F.count("*").alias("lines"), F.count_if(severe()).alias("errors"))
    n = n.withColumn("availability", 1 - F.col("errors") / F.col("lines"))
    return n.withColumn("budget_left", F.greatest(F.lit(0.0), 1 - (1 - F.col("availability")) / (1 - target))).withColumn("met", F.col("availability") >= target)


def burn(obs: DataFrame, step_us: int, target: float = 0.99) -> DataFrame:
    """Cumulative budget by bar. The window runs over one row for each bar."""
    n = counts(obs, [], step_us)
    so_far = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("all_lines", F.sum("lines").over(so_far)).withColumn("all_errors", F.sum("errors").over(so_far))
    return n.withColumn("budget_left", F.greatest(F.lit(0.0), 1 - (F.col("all_errors") / F.col("all_lines")) / (1 - target)))


def latency(obs: DataFrame, keys: list[str], target_ms: float = 100) -> DataFrame:
    """Quantiles and Apdex of the milliseconds in messages, from mergeable histograms."""
    ms = obs.select(*keys, text.latency_ms(F.col("message")).alias("ms"))
    at = ms.select(*keys, stats.bucket(F.col("ms")).alias("b"), stats.bucket(F.col("ms"), stats.EDGES).alias("e"))
    h = at.groupBy(*keys).agg(stats.histogram(F.col("b")).alias("h"), stats.histogram(F.col("e"), stats.EDGES).alias("e"))
    q = [F.round(stats.quantile(F.col("h"), p), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)]
    return h.select(*keys, "h", *q, stats.edge_quantile(F.col("e"), 0.95).alias("p95_edge"), F.round(stats.apdex(F.col("h"), target_ms), 6).alias("apdex"))


def hosts(obs: DataFrame, now_us: int, silent_us: int = 5 * MINUTE) -> DataFrame:
    """Host table: lines, errors, warnings, last stamp, silence, busiest service (ties: smallest name)."""
    by = obs.groupBy("host", "service").agg(F.count("*").alias("n"), F.count_if(severe()).alias("e"), F.count_if(F.col("severity") == "WARN").alias("w"), F.max("us").alias("last"))
    top = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("service"))))
    out = by.groupBy("host").agg(F.sum("n").alias("lines"), F.sum("e").alias("errors"), F.sum("w").alias("warnings"), F.max("last").alias("last_us"), F.element_at(top, 1)["service"].alias("top_service"))
    return out.withColumn("silent", F.col("last_us") < now_us - silent_us).withColumn("pool", text.pool(F.col("host")))


def pools(host_rows: DataFrame) -> DataFrame:
    """Hosts folded by pool, with the worst host (most errors, then lines) if it has errors.

    Outliers are hosts that aren't silent and have over five times or under a
    fifth of the mean of those, if there are three of them or more.
    """
    live = F.when(~F.col("silent"), F.col("lines"))
    mean = host_rows.groupBy("pool").agg(
        F.count("*").alias("hosts"), F.sum("lines").alias("lines"), F.sum("errors").alias("errors"), F.count_if("silent").alias("silent"), F.avg(live).alias("mean"), F.count(live).alias("live"),
        F.max_by(F.when(F.col("errors") > 0, F.col("host")), F.struct("errors", "lines", "host")).alias("worst"),
    )
    odd = host_rows.join(mean.select("pool", "mean", "live"), "pool").where("NOT silent AND live >= 3 AND (lines > 5 * mean OR lines < mean / 5)").groupBy("pool").agg(F.count("*").alias("outliers"))
    return mean.join(odd, "pool", "left").select("pool", "hosts", "lines", "errors", "silent", "worst", F.coalesce("outliers", F.lit(0)).alias("outliers"))


def sessions(obs: DataFrame, identity: str, step_us: int = 5 * MINUTE) -> DataFrame:
    """One row for each identity: lines, errors, first and last stamp, active bars, hosts."""
    return obs.groupBy(identity).agg(
        F.count("*").alias("lines"), F.count_if(severe()).alias("errors"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct(bucket(step_us)).alias("active"), F.countDistinct("host").alias("hosts")
    )


def context(obs: DataFrame, anchor_seq: int, n: int = 5, reach_us: int = 30 * MINUTE) -> DataFrame:
    """Lines before and after an anchor in its host and source, `n` on each side at most, within the reach."""
    a = obs.where(F.col("seq") == anchor_seq).select(F.col("us").alias("a_us"), F.col("seq").alias("a_seq"), F.col("host").alias("a_host"), F.col("source").alias("a_source"))
    near = obs.join(F.broadcast(a), (F.col("host") == F.col("a_host")) & (F.col("source") == F.col("a_source")) & (F.abs(F.col("us") - F.col("a_us")) <= reach_us))
    before = near.where(F.struct("us", "seq") < F.struct("a_us", "a_seq")).orderBy(F.desc("us"), F.desc("seq")).limit(n).select("seq", "us", F.lit(-1).alias("side"))
    after = near.where(F.struct("us", "seq") > F.struct("a_us", "a_seq")).orderBy("us", "seq").limit(n).select("seq", "us", F.lit(1).alias("side"))
    return before.unionByName(after)


def attribute_keys(obs: DataFrame) -> DataFrame:
    """Attribute keys with how often they occur and how often as numbers."""
    x = obs.select(F.explode("attributes").alias("key", "v")).where(F.col("v").isNotNull())
    return x.groupBy("key").agg(F.count("*").alias("seen"), F.count_if(text.number(F.col("v")).isNotNull()).alias("numeric"))
