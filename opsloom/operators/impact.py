"""The error map of incidents: services by their part in them, and what a cause reaches over dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def reached(roots: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Breadth-first search from many sources at once: (root, node, distance, via).

    `roots` has root, `edges` has source and target, walked from target to source:
    from what is broken to what depends on it. `via` is the node a step before,
    the first by name of those as near; a root reaches itself at 0. Each round
    goes one step from what the last one found new, so circles end; `most` bounds
    the steps. Of a node with many dependents only their number goes over the wire.
    """
    back = written(edges.select(F.col("target").alias("node"), F.col("source").alias("next")).where("node <> next").distinct())
    found = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("via")).distinct())
    front, distance = found, 0
    while most is None or distance < most:
        distance += 1
        step = front.select("root", "node").join(back, "node").groupBy("root", F.col("next").alias("node")).agg(F.min("node").alias("via"))
        front = written(step.join(found.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(distance).alias("distance"), "via"))
        if front.isEmpty():
            break
        found = written(found.unionByName(front))
    return found


def chain(reach: DataFrame) -> DataFrame:
    """Each reached service once, nearest root first, in the order in which an impact spreads: (place, node, distance)."""
    near = reach.groupBy("node").agg(F.min("distance").alias("distance"))
    # One row for each service that an incident reaches.
    return near.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", "node"))).select("place", "node", "distance")


def paths(reach: DataFrame, root: str, node: str) -> DataFrame:
    """The way from one root to one node, as rows (distance, node)."""
    rows = reach.where(F.col("root") == root)
    end = rows.where(F.col("node") == node)
    out = end.select("distance", "node", "via")
    steps = (end.agg(F.max("distance")).first()[0]) or 0
    at = out
    for _ in range(steps):
        at = rows.join(at.select(F.col("via").alias("node")), "node").select("distance", "node", "via")
        out = out.unionByName(at)
    return out.select("distance", "node")


def mapped_dependencies(edges: DataFrame, placed: DataFrame, hot: DataFrame) -> DataFrame:
    """Dependencies on hosts as dependencies on the services there.

    `edges` has source, target and n; `placed` has host and service; `hot` names
    services in incidents (service). A target that is a host stands for its
    services; of several, for those in incidents, if there are any. What then
    points at itself goes.
    """
    where = placed.select(F.lower("host").alias("target"), "service").distinct().join(hot.select("service").distinct().withColumn("hot", F.lit(True)), "service", "left")
    some = Window.partitionBy("target")
    where = where.withColumn("any_hot", F.coalesce(F.bool_or("hot").over(some), F.lit(False))).where(~F.col("any_hot") | F.coalesce("hot", F.lit(False))).select("target", "service")
    out = edges.join(where, "target", "left").select("source", F.coalesce("service", "target").alias("target"), "n").where("source <> target")
    return out.groupBy("source", "target").agg(F.sum("n").alias("n"))


def error_map(obs: DataFrame, roots: DataFrame, affected: DataFrame, deps: DataFrame) -> DataFrame:
    """Services with their part - root, affected, erroring or clean - ERROR+ lines and hosts.

    A service stands on the map if it is a root, affected, or an end of a dependency.
    """
    errors = obs.where(F.col("severity").isin("ERROR", "CRITICAL")).groupBy("service").agg(F.count("*").alias("errors"), F.countDistinct("host").alias("hosts"))
    known = roots.select("service").unionByName(affected.select("service")).unionByName(deps.select(F.col("source").alias("service"))).unionByName(deps.select(F.col("target").alias("service"))).distinct()
    flag = lambda df, name: df.select("service").distinct().withColumn(name, F.lit(True))
    m = known.join(errors, "service", "left").join(flag(roots, "root"), "service", "left").join(flag(affected, "hit"), "service", "left")
    kind = F.when(F.col("root"), "root").when(F.col("hit"), "affected").when(F.col("errors") > 0, "erroring").otherwise("clean")
    return m.select("service", kind.alias("kind"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("hosts", F.lit(0)).alias("hosts"))
