"""Which technologies run on a host, from weighted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What evidence of each source weighs, and the sources that show a technology itself.
WEIGHTS = {"port": 1, "process": 2, "listener": 2, "inventory": 2, "log": 2, "agent": 3, "trace": 3, "banner": 3, "manual": 5}
DIRECT = ("agent", "trace", "banner", "manual")
CONFIDENCES = ("certain", "high", "possible")


def attributed(evidence: DataFrame) -> DataFrame:
    """What speaks for each host and technology: host, key, direct, weight, sources, version and confidence.

    `evidence` has host, key, source and version, any number of rows for each. A
    source counts once, with its weight; evidence of other sources is passed over.
    Direct evidence is certain, two sources are high, else it is possible.
    """
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("source")].cast("long")
    per = evidence.withColumn("weight", weight).where("weight IS NOT NULL").groupBy("host", "key", "source").agg(F.max("weight").alias("weight"), F.min("version").alias("version"))
    c = per.groupBy("host", "key").agg(F.bool_or(F.col("source").isin(*DIRECT)).alias("direct"), F.sum("weight").alias("weight"), F.count("*").alias("sources"), F.min_by("version", F.when(F.col("version").isNotNull(), F.struct(-F.col("weight"), "source"))).alias("version"))
    return c.withColumn("confidence", F.when(F.col("direct"), "certain").when(F.col("sources") >= 2, "high").otherwise("possible"))


def _without_replaced(claims: DataFrame, replaces: DataFrame) -> DataFrame:
    """Claims without those for which the same host has one that replaces it."""
    gone = claims.select("host", "key").join(replaces, "key").select("host", F.col("replaces").alias("key")).distinct()
    return claims.join(gone, ["host", "key"], "left_anti")


def _score(*tail: Column) -> list[Column]:
    return [F.desc("direct"), F.desc("weight"), F.desc("sources"), *tail]


def host_stacks(claims: DataFrame, technologies: DataFrame, replaces: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` technologies of each host and layer, by role, confidence and weight.

    `technologies` has key, name, layer and role_rank; `replaces` has key and
    replaces: the former, where both are found, stands for the latter.
    """
    known = _without_replaced(claims.join(technologies, "key"), replaces)
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence"))
    order = Window.partitionBy("host", "layer").orderBy("role_rank", rank, F.desc("weight"), F.desc("sources"), "name")
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("host", "layer", "place", "key", "name", "version", "weight", "sources", "confidence")


def named(claims: DataFrame, technologies: DataFrame, replaces: DataFrame) -> DataFrame:
    """(host, role_rank, key): the one technology that a host has in a role; none where two tie on indirect evidence."""
    known = _without_replaced(claims.join(technologies, "key"), replaces)
    ranked = known.withColumn("k", F.row_number().over(Window.partitionBy("host", "role_rank").orderBy(*_score(F.asc("key")))))
    top = ranked.where("k <= 2").groupBy("host", "role_rank").agg(F.min_by(F.struct("key", "direct", "weight", "sources"), "k").alias("a"), F.max_by(F.struct("direct", "weight", "sources"), "k").alias("b"), F.count("*").alias("n"))
    tie = (F.col("n") == 2) & ~F.col("a.direct") & (F.struct("a.direct", "a.weight", "a.sources") == F.col("b"))
    return top.where(~tie).select("host", "role_rank", "a.key")
