"""Observations: the one row type that all operators read.

Columns: ts, us (microseconds since 1970, UTC), message, severity, service, host,
environment, attributes, source, line_no, seq. The session time zone is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a time stamp without zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def with_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out once: by a generator of one row, into which the optimizer copies no expressions and through which it moves none.

    The generator is given a column that is there already, since what stands in a generator beside a function of lists isn't compiled; as an
    outer one it is given no filter on its size, which would work the column out again.
    """
    made = rows.select("*", F.array(F.struct(*[c.alias(n) for n, c in columns.items()])).alias("_once"))
    return made.select(*[F.col(f"`{c}`") for c in rows.columns], F.inline_outer("_once"))


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows dealt out over all tasks by a column with many values, before steps that cost far more than the rows' bytes: a small file of few row groups is read by few tasks, whatever its rows cost later."""
    return rows.repartition(by)


def from_events(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """The event table as observations, dealt out over all tasks for steps that cost much for each line."""
    e = table(spark, sf_dir, "events")
    e = dealt(e, "event_id") if deal else e
    kind = F.col("event_type")
    severity = F.when(kind == "error", F.when(F.col("value") >= 200, "CRITICAL").otherwise("ERROR")).when(kind == "signup", "WARN").when(kind == "view", "DEBUG").otherwise("INFO")
    return e.select(
        "ts",
        micros("ts").alias("us"),
        F.concat(kind, F.lit(" request "), F.col("event_id"), F.lit(" took "), F.round("value").cast("bigint"), F.lit(" ms")).alias("message"),
        severity.alias("severity"),
        F.concat(F.lit("svc-"), kind).alias("service"),
        F.concat(F.lit("prd-app-"), F.lpad(F.pmod("user_id", F.lit(20)).cast("string"), 2, "0")).alias("host"),
        F.when(F.pmod("user_id", F.lit(3)) == 0, "prod").when(F.pmod("user_id", F.lit(3)) == 1, "test").otherwise("dev").alias("environment"),
        F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k")).alias("attributes"),
        F.lit("events").alias("source"),
        F.col("event_id").alias("line_no"),
        F.col("event_id").alias("seq"),
        "value",
        "user_id",
    )


def deduplicate(rows: DataFrame, key: str, prefer: Column, order: str) -> DataFrame:
    """One row of each key, the preferred one, then the first; rows without a key all stay.

    The choice is an aggregate with a partial step, so a frequent key moves one row for each task.
    """
    keyless = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    keyed = rows.where(~keyless)
    best = keyed.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct((~prefer).cast("int"), F.col(order))).alias("_r"))
    kept = best.select(key, "_r.*").select(*rows.columns)
    return kept.unionByName(rows.where(keyless))


# From how far ahead a stamp counts as a local clock, how far a zone can be, and the delay that may be left.
AHEAD_US, FARTHEST_US, DELAY_US = 15 * MINUTE, 14 * 60 * MINUTE, 5 * MINUTE
#: 1 January 2000.
YEAR_2000 = 946_684_800_000_000


def repair_clock(us: Column, arrival: Column) -> Column:
    """A stamp that is missing, before 2000 or over a day ahead becomes the arrival.

    One that is 15 minutes to 14 hours ahead is a local clock without zone: it goes
    back by whole quarter hours, if that leaves a delay of five minutes at most.
    """
    ahead, quarter = us - arrival, 15 * MINUTE
    back = F.ceil(ahead / quarter).cast("bigint") * quarter
    zone = (ahead >= AHEAD_US) & (ahead <= FARTHEST_US) & (back - ahead <= DELAY_US)
    return F.when(us.isNull() | (us < YEAR_2000) | (ahead > 1440 * MINUTE), arrival).when(zone, us - back).otherwise(us)


#: Fixed value: names that are a process or component, not a host.
BAD_HOST = r"^\[.*\]$|:$|\s|^-$"


def repair_host(host: Column, agent: Column) -> tuple[Column, Column]:
    """(host, component): a bad host name is the component; without a host, it is the agent's."""
    bad = F.coalesce(host.rlike(BAD_HOST), F.lit(False))
    named = F.when(bad, "").otherwise(F.coalesce(host, F.lit("")))
    known = F.when(agent.isNull() | agent.isin("", "unknown"), "").otherwise(agent)
    return F.when(named == "", known).otherwise(named), F.when(bad, F.regexp_replace(host, r"^[\[\]:]+|[\[\]:]+$", ""))
