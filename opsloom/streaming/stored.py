"""Counters and lines kept as Parquet: batches that can be repeated, generations that replace each other, retention.

Counters are sums, so what a batch adds is written as a table of its own, under
its number: a batch that is run again replaces itself and changes nothing, and the
counters are the sum of all batches. From time to time the batches so far are
added up into a generation. A generation counts from when its marker is written,
after it is whole, so a job that dies leaves the one before in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..sources.observations import MINUTE

DAY_US = 1440 * MINUTE
#: Days that counters are kept.
KEEP_DAYS = 400
KEYS = ("minute", "environment", "host", "service")
_PLACES = range(len(stats.BOUNDS) + 1)
COUNTERS = "minute long, environment string, host string, service string, lines long, errors long, h array<long>, day long"


def counters(lines: DataFrame) -> DataFrame:
    """Lines, ERROR+ lines and the histogram of `<n> ms` by minute, environment, host and service."""
    rows = lines.select(F.floor(F.col("us") / MINUTE).alias("minute"), "environment", "host", "service", (F.coalesce(text.rank(F.col("severity")), F.lit(1)) >= 3).alias("bad"), stats.bucket(text.latency_ms(F.col("message"))).alias("b"))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("lines"), F.count_if("bad").alias("errors"), stats.histogram(F.col("b")).alias("h")).withColumn("day", F.floor(F.col("minute") / 1440))


def summed(rows: DataFrame, keys: tuple = KEYS) -> DataFrame:
    """Counters of equal keys added up, histograms place by place."""
    return rows.groupBy(*keys).agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"), F.array(*[F.sum(F.col("h")[i]) for i in _PLACES]).alias("h"))


def add_batch(lines: DataFrame, batch: int, path: str) -> None:
    """What a micro-batch of lines adds, under its number. For `foreachBatch`: the same number again replaces what it wrote."""
    counters(lines).write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")


def _markers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("upto long, oldest_day long, generation long").option("ignoreMissingFiles", True).parquet(f"{path}/markers")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of the file system that Spark reads."""
    try:
        spark.read.text(path).limit(0).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def _current(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(generation, last batch in it, oldest day that is kept) of the last marker."""
    if not _exists(spark, f"{path}/markers"):
        return -1, -1, -(1 << 40)
    last = _markers(spark, path).orderBy(F.desc("generation")).limit(1).collect()
    return (last[0].generation, last[0].upto, last[0].oldest_day) if last else (-1, -1, -(1 << 40))


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """Counters that count: the current generation and the batches after it."""
    now = generation, upto, _ = _current(spark, path)
    rows = spark.createDataFrame([], COUNTERS)
    if generation >= 0:
        rows = spark.read.schema(COUNTERS).parquet(f"{path}/generations/generation={generation}")
    if _exists(spark, f"{path}/batches"):
        later = spark.read.schema(COUNTERS + ", batch long").parquet(f"{path}/batches").where(F.col("batch") > upto)
        rows = rows.unionByName(later.drop("batch"))
    return rows, now


def read_counters(spark: SparkSession, path: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """Stored counters of [since, until), added up; days past the retention are left out. Days are folders, so others aren't read."""
    rows, (_, _, oldest) = _rows(spark, path)
    rows = rows.where(F.col("day") >= oldest)
    if since_us is not None:
        rows = rows.where((F.col("day") >= since_us // DAY_US) & (F.col("minute") >= since_us // MINUTE))
    if until_us is not None:
        rows = rows.where((F.col("day") <= until_us // DAY_US) & (F.col("minute") < until_us // MINUTE))
    return summed(rows)


def compact(spark: SparkSession, path: str, now_us: int, keep_days: int = KEEP_DAYS) -> int:
    """Add the batches so far up into a new generation without days past the retention; its number. No batches, no new generation."""
    generation, _, _ = _current(spark, path)
    if not _exists(spark, f"{path}/batches"):
        return generation
    # The batches are fixed before they are read, so one that comes meanwhile counts after this generation.
    upto = spark.read.schema(COUNTERS + ", batch long").parquet(f"{path}/batches").agg(F.max("batch")).first()[0]
    if upto is None:
        return generation
    generation, before, _ = _current(spark, path)
    parts = spark.read.schema(COUNTERS + ", batch long").parquet(f"{path}/batches").where((F.col("batch") > before) & (F.col("batch") <= upto)).drop("batch")
    if generation >= 0:
        parts = parts.unionByName(spark.read.schema(COUNTERS).parquet(f"{path}/generations/generation={generation}"))
    oldest = now_us // DAY_US - keep_days
    whole = summed(parts.where(F.col("day") >= oldest)).withColumn("day", F.floor(F.col("minute") / 1440))
    whole.repartitionByRange("day", "minute").write.mode("overwrite").partitionBy("day").parquet(f"{path}/generations/generation={generation + 1}")
    mark = spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.lit(oldest).cast("long").alias("oldest_day"))
    mark.write.mode("overwrite").parquet(f"{path}/markers/generation={generation + 1}")
    return generation + 1


def count_stream(lines: DataFrame, path: str, checkpoint: str) -> None:
    """Work off a stream of lines into stored counters; late lines add to their own minute, however late."""
    lines.writeStream.foreachBatch(lambda df, batch: add_batch(df, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def filed_under(us: Column, arrival_us: Column, keep_days: int = KEEP_DAYS) -> Column:
    """The time under which a line is filed: its stamp, or its arrival where the stamp is missing, past the retention or over a day ahead."""
    sound = us.between(arrival_us - keep_days * DAY_US, arrival_us + DAY_US)
    return F.when(sound, us).otherwise(arrival_us)


def add_lines(lines: DataFrame, batch: int, path: str) -> None:
    """Lines of a micro-batch in folders by the day they are filed under; the same batch again replaces itself. `lines` has us and arrival_us."""
    filed = lines.withColumn("filed_us", filed_under(F.col("us"), F.col("arrival_us")))
    filed.withColumn("dt", F.date_format(F.timestamp_micros("filed_us"), "yyyy-MM-dd")).write.mode("overwrite").partitionBy("dt").parquet(f"{path}/batch={batch}")


def upsert(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], order: str) -> int:
    """A keyed table with the newest row of each key: `rows` merged into the current generation, by the column `order`; the new generation.

    Of one key and order, the row given now replaces the one that is stored. Equal
    input again changes nothing. The table is written anew; a marker switches over
    when it is whole.
    """
    generation = table_generation(spark, path)
    every = rows.withColumn("_new", F.lit(1))
    if generation >= 0:
        every = every.unionByName(read_table(spark, path).withColumn("_new", F.lit(0)))
    others = [c for c in rows.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, "_new")).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
    best.write.mode("overwrite").parquet(f"{path}/generations/generation={generation + 1}")
    spark.range(1).select(F.lit(1).alias("whole")).write.mode("overwrite").parquet(f"{path}/markers/generation={generation + 1}")
    return generation + 1


def table_generation(spark: SparkSession, path: str) -> int:
    """The generation of an upserted table that is whole; -1 before the first."""
    if not _exists(spark, f"{path}/markers"):
        return -1
    last = spark.read.schema("whole int, generation long").parquet(f"{path}/markers").agg(F.max("generation")).first()[0]
    return -1 if last is None else last


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """An upserted table as it stands."""
    return spark.read.parquet(f"{path}/generations/generation={table_generation(spark, path)}")


def host_figures(stored: DataFrame) -> DataFrame:
    """Lines, ERROR+ lines, share and p95 of each host out of stored counters, a few rows for each minute instead of all lines."""
    per = summed(stored, ("environment", "host"))
    return per.select("environment", "host", "lines", "errors", F.round(F.col("errors") / F.col("lines"), 5).alias("error_rate"), F.round(stats.quantile(F.col("h"), 0.95), 6).alias("p95_ms"))
