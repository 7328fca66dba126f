"""Threshold states with hysteresis, waiting time, cooldown and escalation, and the life of anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.observations import MINUTE
from .folds import fold, fold_stream

# The share of the lower limit below which a level is left, minutes after which a metric that isn't sent is
# closed quietly, and minutes between notices where a policy names none.
HYSTERESIS, GONE_MIN, COOLDOWN_MIN = 0.95, 15, 30
STATES = "host string, metric string, us long, value double, level string, status string, since_us long, bound double, notice string"


def _quiet() -> dict:
    return {"level": "ok", "since": None, "seen": None, "told": "", "told_at": None}


def _judge(s: dict, r: dict) -> list:
    us, v, warn, crit = r["us"], r["value"], r["warn"], r["crit"]
    if v is None or (warn is None and crit is None):
        return []
    if s["level"] != "ok" and us - s["seen"] > GONE_MIN * MINUTE:
        s.update(level="ok", since=us)
    level = "crit" if crit is not None and v >= crit else "warn" if warn is not None and v >= warn else "ok"
    low = warn if warn is not None else crit
    if level == "ok" and s["level"] != "ok" and v >= low * HYSTERESIS:
        level = s["level"]
    notice, status = "", level
    if level == "ok":
        if s["level"] != "ok":
            notice = "resolved" if s["told"] and r["tell_resolved"] else ""
            s.update(since=us, told="", told_at=None)
    else:
        if s["level"] == "ok":
            s.update(since=us, told="", told_at=None)
        if us - s["since"] < (r["for_min"] or 0) * MINUTE:
            status = "pending"
        elif not s["told"] or (s["told"] == "warn" and level == "crit") or us - s["told_at"] >= (r["cooldown_min"] or COOLDOWN_MIN) * MINUTE:
            notice = level
            s.update(told=level, told_at=us)
    s.update(level=level, seen=us)
    if s["since"] is None:
        s["since"] = us
    bound = crit if level == "crit" else warn if level == "warn" else low
    return [{"us": us, "value": v, "level": level, "status": status, "since_us": s["since"], "bound": bound, "notice": notice}]


def threshold_states(values: DataFrame) -> DataFrame:
    """The state of every host and metric after each of its values, and the notice that it sends.

    `values` has host, metric, us, value and the policy that applies: warn and
    crit (either may be null), for_min, cooldown_min and tell_resolved. A level is
    held until the value falls under 95 % of the lower limit. A level shorter than
    for_min is pending and sends nothing. It is told once, again when warn turns
    crit, and again after cooldown_min (null or 0: 30). A host and metric that
    wasn't sent for over 15 minutes has become ok without a notice. Rows without a
    value or a limit are passed over. Values should be those of evaluations, such
    as one a minute.
    """
    return fold(values, ["host", "metric"], ["us", "value"], _quiet, _judge, STATES)


def threshold_stream(values: DataFrame) -> DataFrame:
    """`threshold_states` over a stream of values; its state is a few fields for each host and metric."""
    return fold_stream(values, ["host", "metric"], ["us", "value"], _quiet, _judge, STATES)


def transitions(states: DataFrame) -> DataFrame:
    """Only the rows in which the status changed or a notice was sent, with the status before."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("host", "metric").orderBy("us", "value")), F.lit("ok"))
    return states.withColumn("was", before).where("status <> was OR notice <> ''")


def anomaly_lives(events: DataFrame) -> DataFrame:
    """One row for each life of an anomaly, from the events of its key.

    `events` has key, us, seq, event and score: `seen` (a scan found it, with its
    score), `clear` (a scan didn't), `step` (an operator's first step acknowledges
    it), `ack`, `open`, `resolved` and `ignored`. The first `seen` after a
    `resolved` or `ignored`, or of the key, opens a new life; events before it
    change nothing. Returns key, life (from 1), first_us, last_us, hits, score (of
    the last `seen`), cleared_us (the first `clear` after the last `seen`), status
    and status_us.
    """
    order = Window.partitionBy("key").orderBy("us", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("ended", F.coalesce(F.sum(F.col("event").isin("resolved", "ignored").cast("int")).over(before), F.lit(0)))
    opened = Window.partitionBy("key", "ended").orderBy("us", "seq")
    e = e.withColumn("hits", F.sum((F.col("event") == "seen").cast("int")).over(opened)).where("hits > 0")
    last_seen = F.max(F.when(F.col("event") == "seen", F.struct("us", "seq"))).over(Window.partitionBy("key", "ended"))
    e = e.withColumn("at", F.struct("us", "seq")).withColumn("last_seen", last_seen)
    e = e.withColumn("status", F.when(F.col("event") == "step", "ack").when(~F.col("event").isin("seen", "clear"), F.col("event")))
    # A step acknowledges what is still open; it doesn't take back a status.
    said = F.last("status", ignorenulls=True).over(opened.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("said", F.coalesce(said, F.lit("open"))).withColumn("status", F.when((F.col("event") == "step") & (F.col("said") != "open"), None).otherwise(F.col("status")))
    lives = e.groupBy("key", "ended").agg(
        F.min("us").alias("first_us"), F.max("last_seen").getField("us").alias("last_us"), F.count_if(F.col("event") == "seen").alias("hits"), F.max_by("score", F.when(F.col("event") == "seen", F.col("at"))).alias("score"),
        F.min(F.when((F.col("event") == "clear") & (F.col("at") > F.col("last_seen")), F.col("us"))).alias("cleared_us"),
        F.max(F.when(F.col("status").isNotNull(), F.struct("us", "seq", "status"))).alias("s"),
    )
    return lives.select("key", F.row_number().over(Window.partitionBy("key").orderBy("ended")).alias("life"), "first_us", "last_us", "hits", "score", "cleared_us", F.coalesce("s.status", F.lit("open")).alias("status"), F.col("s.us").alias("status_us"))
