"""Business flows read from log lines, and sessions of users' devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.observations import with_once
from .rollups import severe

#: Step of an error that carries the key and matches no step.
FAIL = -1
# Limits of good and of poor for each vital.
VITALS_GOOD = {"lcp": 2500.0, "fcp": 1800.0, "ttfb": 800.0}
VITALS_POOR = {"lcp": 4000.0, "fcp": 3000.0, "ttfb": 1800.0}


def flow_events(obs: DataFrame, key: str, steps: list[str]) -> DataFrame:
    """(key, step, us, error): the first line of each key and step.

    `key` is a pattern with one group, `steps` are patterns, of which a line is
    the first that it matches; an ERROR+ line that matches none is FAIL. The error
    flag is that of any line of the step.
    """
    step = F.when(severe(), FAIL)
    for i, pattern in reversed(list(enumerate(steps))):
        step = F.when(F.col("message").rlike(f"(?i){pattern}"), i).otherwise(step)
    rows = obs.select(F.substring(F.regexp_extract("message", f"(?i){key}", 1), 1, 80).alias("key"), step.alias("step"), "us", severe().alias("error"))
    return rows.where("key <> '' AND step IS NOT NULL").groupBy("key", "step").agg(F.min("us").alias("us"), F.max("error").alias("error"))


def flow_items(events: DataFrame, steps: int, now_us: int, limits: DataFrame) -> DataFrame:
    """Each key: its last step, steps done, whether it waits too long (`limits`: step, limit_us), failed or is done, and where it failed.

    A failure blocks the step after the last one reached before it.
    """
    fail = F.max(F.when(F.col("step") == FAIL, F.col("us")))
    per = events.groupBy("key").agg(F.max("step").alias("last_step"), F.count_if(F.col("step") >= 0).alias("steps_done"), F.max("error").alias("error"), fail.alias("fail_us"), F.min("us").alias("start_us"), F.max_by("us", "step").alias("last_us"), F.collect_list(F.struct("step", "us")).alias("all"))
    before = F.array_max(F.transform(F.filter("all", lambda x: (x["step"] >= 0) & (x["us"] <= F.col("fail_us"))), lambda x: x["step"]))
    failed_at = F.when(F.col("fail_us").isNotNull(), F.least(F.lit(steps - 1), F.coalesce(before + 1, F.lit(0))))
    waited = F.lit(now_us) - F.col("last_us")
    j = per.join(limits.select(F.col("step").alias("last_step"), "limit_us"), "last_step", "left")
    stuck = F.col("last_step").between(0, steps - 2) & (waited > F.coalesce("limit_us", F.lit(900_000_000.0)))
    return j.select("key", "last_step", "steps_done", "error", F.coalesce(stuck, F.lit(False)).alias("stuck"), (F.col("last_step") == steps - 1).alias("done"), failed_at.alias("failed_at"), waited.alias("waited_us"))


def suggested_steps(obs: DataFrame, key: str) -> DataFrame:
    """Templates that carry a key, by the median of their relative place on the keys' paths; those of two keys or more."""
    rows = with_once(obs.select("message", "us"), key=F.regexp_extract("message", f"(?i){key}", 1)).where("key <> ''").select("key", text.template(F.col("message")).alias("template"), "us")
    first = rows.groupBy("key", "template").agg(F.min("us").alias("us"))
    path = Window.partitionBy("key")
    placed = first.withColumn("place", F.row_number().over(path.orderBy("us", "template")) - 1).withColumn("n", F.count("*").over(path))
    return placed.groupBy("template").agg(F.count("*").alias("keys"), F.round(F.median(F.col("place") / F.greatest(F.lit(1), F.col("n") - 1)), 3).alias("position")).where("keys >= 2")


def stuck_steps(items: DataFrame, gaps: DataFrame, least: int = 20) -> DataFrame:
    """Steps with `least` stuck items, or one that has waited over twice the step's p95 (`gaps`: step, p95_us)."""
    n = items.where("stuck").groupBy(F.col("last_step").alias("step")).agg(F.count("*").alias("stuck"), F.max("waited_us").alias("oldest_us"))
    return n.join(gaps, "step", "left").where((F.col("stuck") >= least) | F.coalesce(F.col("oldest_us") > 2 * F.col("p95_us"), F.lit(False))).select("step", "stuck", "oldest_us")


def device_sessions(events: DataFrame) -> DataFrame:
    """Counters of each session of (session, app, platform, user, us, kind, dur_ms)."""
    kinds = {"views": "view", "actions": "action", "requests": "http", "errors": "error", "crashes": "crash"}
    return events.groupBy("session", "app", "platform").agg(F.max("user").alias("user"), F.min("us").alias("first_us"), F.max(F.col("us") + F.coalesce("dur_ms", F.lit(0.0)) * 1000).cast("bigint").alias("last_us"), *[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])


def device_overview(sessions: DataFrame) -> DataFrame:
    """Sessions, users and sums of each app and platform, and the shares without crashes and without errors."""
    sums = [F.sum(c).alias(c) for c in ("views", "actions", "requests", "errors", "crashes")]
    o = sessions.groupBy("app", "platform").agg(F.count("*").alias("sessions"), F.countDistinct("user").alias("users"), *sums, F.count_if(F.col("crashes") > 0).alias("crashed"), F.count_if((F.col("errors") > 0) | (F.col("crashes") > 0)).alias("bad"))
    share = lambda c: F.round(1 - F.col(c) / F.col("sessions"), 4)
    return o.select("app", "platform", "sessions", "users", "views", "actions", "requests", "errors", "crashes", share("crashed").alias("crash_free"), share("bad").alias("error_free"))


def nearest_rank(value: str, share: float) -> Column:
    """Aggregate: the sorted values' element at index floor(share x n)."""
    return F.expr(f"percentile_disc({share} + 1e-12D) WITHIN GROUP (ORDER BY {value})")


def vitals(samples: DataFrame) -> DataFrame:
    """p75 and grade of each app's vitals (app, vital, value)."""
    limit = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[F.col("vital")]
    v = samples.where("value IS NOT NULL").groupBy("app", "vital").agg(nearest_rank("value", 0.75).alias("p75"), F.count("*").alias("n"))
    return v.withColumn("grade", F.when(F.col("p75") <= limit(VITALS_GOOD), "good").when(F.col("p75") > limit(VITALS_POOR), "poor").otherwise("needs"))


def slow_steps(spans: DataFrame) -> DataFrame:
    """Steps of an app with two samples or more: p50, p75 and p95."""
    return spans.groupBy("app", "step").agg(F.count("*").alias("n"), *[nearest_rank("duration_ms", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.75, 0.95)]).where("n >= 2")
