"""Connected components of small aggregated graphs, such as those of signals or hot cells."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Nodes up to which Spark may broadcast their labels.
BROADCAST_NODES = 20_000


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="graph-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; one of this process only where Spark runs in it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (shared or _own_folder()).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df`: a table in the folder that driver and executors share, read again."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that grows with the data: it is never broadcast, for which Spark would judge it by its compressed files."""
    return df.hint("merge")


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each of `nodes` (node) reaches over `links` (a, b).

    Every round a node takes the smallest label of its neighbours, and then that
    label's own label, so labels travel twice as far each time.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(nodes.select("node", F.col("node").alias("component")))
    side = (lambda df: df) if labels.count() <= BROADCAST_NODES else shuffled
    for _ in range(most_rounds):
        near = both.join(side(labels.select(F.col("node").alias("b"), "component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(side(near), "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        after = written(hooked.join(side(jump), "mid").select("node", "was", F.least("mid", "far").alias("component")))
        labels = after.select("node", "component")
        if after.where("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
