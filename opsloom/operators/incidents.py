"""Signals, bursts, alert storms, anomalies, thresholds and links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..sources.observations import MINUTE
from .rollups import bucket, severe


def signals(obs: DataFrame, step_us: int = MINUTE) -> DataFrame:
    """Observations of one fingerprint with their burst score.

    The baseline is the upper median over all bars of the data's span, quiet ones
    counting as zeros; zeros are counted, not made.
    """
    f = text.fingerprint(text.template(F.col("message")), F.col("severity"), F.col("service"))
    per = obs.groupBy(f.alias("fingerprint"), bucket(step_us).alias("bar")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max(text.rank(F.col("severity"))).alias("level"))
    span = obs.agg((F.floor((F.max("us") - F.min("us")) / step_us) + 1).cast("int").alias("span"))
    s = per.groupBy("fingerprint").agg(F.sum("n").alias("lines"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("level").alias("level"), F.max("n").alias("peak"), F.sort_array(F.collect_list("n")).alias("bars"))
    s = s.join(F.broadcast(span)).withColumn("zeros", F.greatest(F.lit(0), F.col("span") - F.size("bars")))
    middle = F.floor((F.size("bars") + F.col("zeros")) / 2).cast("int") - F.col("zeros")
    s = s.withColumn("baseline", F.when(middle < 0, 0).otherwise(F.element_at("bars", middle + 1)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("peak") / (F.col("baseline") + 1) - 1) / 9))
    return s.select("fingerprint", "lines", "level", "first_us", "last_us", "peak", "baseline", F.round(score, 3).alias("burst"), (F.size("bars") / F.col("span")).alias("share"))


def hot_cells(obs: DataFrame, key: str, step_us: int = 5 * MINUTE, least: int = 4, ratio: float = 3.0) -> DataFrame:
    """Cells of key and bar with at least max(`least`, `ratio` x the median over all bars, empty ones too)."""
    bars = obs.agg(F.floor(F.min("us") / step_us).alias("lo"), F.floor(F.max("us") / step_us).alias("hi")).select((F.col("hi") - F.col("lo") + 1).cast("int").alias("bars"))
    n = obs.groupBy(key, bucket(step_us).alias("bar")).agg(F.count("*").alias("n"))
    m = n.groupBy(key).agg(F.sort_array(F.collect_list("n")).alias("c")).join(F.broadcast(bars))
    value = lambda i: F.when(i < F.col("bars") - F.size("c"), 0).otherwise(F.element_at("c", (i - (F.col("bars") - F.size("c")) + 1).cast("int")))
    half = F.floor(F.col("bars") / 2).cast("int")
    median = F.when(F.col("bars") % 2 == 1, value(half).cast("double")).otherwise((value(half - 1) + value(half)) / 2)
    limits = m.select(key, F.greatest(F.lit(float(least)), median * ratio).alias("limit"))
    return n.join(limits, key).where("n >= limit")


def runs(cells: DataFrame, key: str) -> DataFrame:
    """Neighbouring hot cells of a key as one storm (gaps and islands)."""
    w = Window.partitionBy(key).orderBy("bar")
    island = F.sum((F.coalesce(F.col("bar") - F.lag("bar").over(w), F.lit(2)) > 1).cast("int")).over(w)
    return cells.withColumn("storm", island).groupBy(key, "storm").agg(F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"), F.sum("n").alias("lines"))


def slow_burn(obs: DataFrame, keys: list[str], window_us: int = 15 * MINUTE, least: int = 4, hosts: int = 2) -> DataFrame:
    """ERROR+ observations that open a window with `least` such ones on `hosts` hosts.

    Buckets as wide as the window are the sort key's prefix, so a window reads two buckets and no key is one task's.
    An observation counts for all moments from a window before it to its own; for
    its host it counts for those after that host's observation before. So both
    counts are running sums, and no window is read again for each row.
    """
    bad = obs.where(severe()).select("seq", *keys, "us", "host").withColumn("_b", F.floor(F.col("us") / window_us))
    both = bad.withColumn("_own", F.lit(True)).unionByName(bad.withColumn("_b", F.col("_b") - 1).withColumn("_own", F.lit(False)))
    last = F.lag("us").over(Window.partitionBy(*keys, "_b", "host").orderBy("us"))
    opened = F.col("us") - window_us
    seen = F.when(F.col("host").isNotNull(), 1).otherwise(0)
    step = lambda at, n, h, row: F.struct(at.alias("_at"), F.lit(n).alias("_n"), h.alias("_h"), row.alias("_row"))
    none, zero = F.lit(False), F.lit(0)
    steps = F.array(step(opened, 1, zero, none), step(F.greatest(opened, F.coalesce(F.col("_last") + 1, opened)), 0, seen, none), step(F.col("us") + 1, -1, -seen, none), step(F.col("us"), 0, zero, F.lit(True)))
    moves = both.withColumn("_last", last).select("seq", *keys, "_b", "_own", F.inline(F.when(F.col("_own"), steps).otherwise(F.slice(steps, 1, 3))))
    up_to = Window.partitionBy(*keys, "_b").orderBy("_at")
    out = moves.withColumn("n", F.sum("_n").over(up_to)).withColumn("hosts", F.sum("_h").over(up_to).cast("int"))
    return out.where(F.col("_row") & (F.col("n") >= least) & (F.col("hosts") >= hosts)).select("seq", *keys, "n", "hosts")


def anomalies(obs: DataFrame, key: str, now_us: int, step_us: int = MINUTE, window: int = 5, baseline: int = 1440, limit: float = 4.0, least: int = 50) -> DataFrame:
    """Keys whose last `window` bars hold far more lines than the bars before, by median and scaled absolute deviation.

    Quiet bars since a key's first one count as zeros.
    """
    end = now_us // step_us
    n = obs.where((F.col("us") < end * step_us) & (F.col("us") >= (end - baseline) * step_us)).groupBy(key, bucket(step_us).alias("bar")).agg(F.count("*").alias("n"))
    cut = end - window
    now = n.where(F.col("bar") >= cut).groupBy(key).agg(F.sum("n").alias("observed"))
    old = n.where(F.col("bar") < cut)
    first = old.groupBy(key).agg(F.min("bar").alias("lo"))
    grid = first.select(key, F.explode(F.sequence(F.col("lo"), F.lit(cut - 1))).alias("bar"))
    full = grid.join(old, [key, "bar"], "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    med = full.groupBy(key).agg(F.median("n").alias("med"), F.count("*").alias("bars"))
    mad = full.join(med, key).groupBy(key).agg((F.median(F.abs(F.col("n") - F.col("med"))) * stats.MAD_SCALE).alias("mad"))
    j = now.join(med, key).join(mad, key).where("bars >= 30")
    j = j.withColumn("normal", F.col("med") * window).withColumn("z", stats.zscore(F.col("observed"), F.col("med") * window, F.col("mad") * float(window**0.5)))
    return j.select(key, "observed", "normal", F.round("z", 6).alias("z"), ((F.col("z") >= limit) & (F.col("observed") >= least) & (F.col("observed") >= 2 * F.col("normal"))).alias("anomaly"))


def silent(obs: DataFrame, key: str, now_us: int, step_us: int, window: int, baseline: int) -> DataFrame:
    """Keys in at least half of the baseline's bars and none since the window began (anti join)."""
    cut = now_us // step_us - window
    old = obs.where((F.col("us") < cut * step_us) & (F.col("us") >= (cut - baseline) * step_us))
    steady = old.groupBy(key).agg(F.countDistinct(bucket(step_us)).alias("bars"), F.max("us").alias("last_us")).where(F.col("bars") * 2 >= baseline)
    return steady.join(obs.where(F.col("us") >= cut * step_us).select(key).distinct(), key, "left_anti")


def resolve_policies(latest: DataFrame, policies: DataFrame) -> DataFrame:
    """The policy for each host and metric: host name, then pool, environment, all; the newest of equals.

    `policies` (scope, target, metric, warn, crit, id) is a table people write, joined by metric and target.
    """
    at = latest.select("*", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit("host").alias("scope"), F.col("host").alias("target")), F.struct(F.lit(1).alias("rank"), F.lit("pool").alias("scope"), F.col("pool").alias("target")), F.struct(F.lit(2).alias("rank"), F.lit("env").alias("scope"), F.col("environment").alias("target")), F.struct(F.lit(3).alias("rank"), F.lit("all").alias("scope"), F.lit("*").alias("target")))).alias("s")).select("*", "s.*").drop("s")
    best = at.join(policies, ["scope", "target", "metric"]).groupBy("host", "metric").agg(F.min_by(F.struct("value", "scope", "warn", "crit"), F.struct("rank", -F.col("id"))).alias("b")).select("host", "metric", "b.*")
    state = F.when(F.col("value") >= F.col("crit"), "crit").when(F.col("value") >= F.col("warn"), "warn").otherwise("ok")
    return best.withColumn("state", state)


def rule_windows(obs: DataFrame, rule: Column, step_us: int, least: int) -> DataFrame:
    """Windows in which an alert rule would fire."""
    return obs.where(F.coalesce(rule, F.lit(False))).groupBy(bucket(step_us).alias("bar")).agg(F.count("*").alias("matches")).where(F.col("matches") >= least)


def new_templates(obs: DataFrame, since_us: int, least: int = 1) -> DataFrame:
    """WARN+ templates that don't occur before a moment."""
    t = obs.select(text.template(F.col("message")).alias("template"), "severity", "us")
    now = t.where((F.col("us") >= since_us) & (text.rank(F.col("severity")) >= 2)).groupBy("template").agg(F.count("*").alias("lines"))
    return now.where(F.col("lines") >= least).join(t.where(F.col("us") < since_us).select("template").distinct(), "template", "left_anti")


def policy_for(rows: DataFrame, policies: list[tuple[str, str, float, int]]) -> DataFrame:
    """Rows (host, environment, applications) with the scope and limit of the policy that applies.

    `policies` are (scope, target, limit, id), as few as people write. A host's own
    comes first, then globs over hosts, its applications' (the strictest limit), its
    environment's and the one for all; of equals the newest.
    """
    order = {"host": 0, "glob": 1, "application": 2, "env": 3, "all": 4}
    fits = {"host": lambda t: F.col("host") == t, "glob": lambda t: text.glob(F.col("host"), t), "application": lambda t: F.array_contains("applications", t), "env": lambda t: F.col("environment") == t, "all": lambda t: F.lit(True)}
    made = [F.when(fits[s](t), F.struct(F.lit(order[s]).alias("rank"), F.lit(limit if s == "application" else 0.0).alias("strict"), F.lit(-k).alias("age"), F.lit(s).alias("scope"), F.lit(float(limit)).alias("crit"))) for s, t, limit, k in policies]
    best = F.array_min(F.filter(F.array(*made), lambda x: x.isNotNull()))
    return rows.withColumn("best", best).select(*[c for c in rows.columns if c not in ("environment", "applications")], "best.scope", "best.crit")
