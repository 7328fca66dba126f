"""Helpers that several corpus operators need: durable cuts and input selection."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="shared-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's `spark.checkpoint.dir`.

    Only where that is unset and Spark runs in this one process is a temporary
    folder made instead; on a cluster that would lie on one machine, so it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (shared or _own_folder()).rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df`: write it as a table in the shared folder and read that.

    What is read has its real size. (A checkpoint keeps the size that was
    estimated for its plan, a product over all joins, which grows without bound
    where a loop cuts its plan again and again.)
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column, folds: int):
    """crc32 of a value written as text, modulo `folds`: splits learning rows from held-out ones."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))


def give_back() -> None:
    """Hand memory that this process has freed back to the system: that of Arrow's pool and of the C library, where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, a step over a task's Arrow batches, that gives freed memory back at its end and every second.

    Spark keeps a task's Python worker for later tasks; what the worker doesn't give back lies beside their memory, and the executor's.
    """
    @functools.wraps(run)
    def step(batches):
        last = time.monotonic()
        try:
            for batch in run(batches):
                yield batch
                if time.monotonic() > last + 1:
                    give_back()
                    last = time.monotonic()
        finally:
            give_back()

    return step
