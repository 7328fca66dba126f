"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import durable

#: Nodes at most whose neighbours are looked up in a broadcast table, since each has over 2 / HEAVY_NODES of all edge ends.
HEAVY_NODES = 50_000
#: Neighbours up to which a node is never heavy.
LIGHT = 256


def _with_smallest(pairs: DataFrame, rows: int) -> DataFrame:
    """(u, v, m): each pair with the smallest v that its u has, or u itself.

    The minima are aggregates with a partial step. A node with many neighbours,
    such as the centre of a star, isn't joined by key: it is one of a bounded
    number of heavy nodes, whose minima are broadcast.
    """
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    heavy = low.where(F.col("n") > max(LIGHT, 2 * rows // HEAVY_NODES)).select("u", F.col("m").alias("h"))
    marked = pairs.join(F.broadcast(heavy), "u", "left")
    light = marked.where("h IS NULL").select("u", "v").join(low.select("u", "m"), "u")
    return light.unionByName(marked.where("h IS NOT NULL").select("u", "v", F.col("h").alias("m")))


def _cut(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges as a table, with their number, which the job that writes them observes."""
    seen = Observation()
    table = durable(edges.observe(seen, F.count("*").alias("n")))
    return table, seen.get.get("n") or 0


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every linked node.

    `links` has the columns a and b. Returns (node, component) for each node of
    a link; a link from a node to itself adds nothing. Each round hangs the
    larger neighbours of every node, then the smaller ones, under the smallest
    neighbour; the number of rounds grows with the logarithm of the longest
    path, and each ends in a checkpoint, so that the plan stays short. Stars need no round.
    """
    edges, rows = _cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    for _ in range(most_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = durable(_with_smallest(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct())
        small = _with_smallest(large, rows).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges, rows = _cut(small.where("u > v").distinct())
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
