"""Mergeable latency histograms, their quantiles and Apdex, and robust spreads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BOUNDS = (1, 2, 5, 10, 20, 50, 100, 200, 300, 500, 750, 1000, 1500, 2000, 3000, 5000, 7500, 10000, 20000, 30000, 60000, 120000)
EDGES = (50, 100, 200, 300, 500, 1000, 2000, 5000)
MAD_SCALE = 1.4826


def bucket(ms: Column, bounds: tuple = BOUNDS) -> Column:
    """Index of the bucket (lower, upper] that holds a value; the last is open."""
    return sum(((ms > b).cast("int") for b in bounds[1:]), (ms > bounds[0]).cast("int"))


def histogram(at: Column, bounds: tuple = BOUNDS) -> Column:
    """Aggregate: counts by bucket index (of a column made before the aggregation), nulls ignored. Histograms merge by adding them."""
    return F.array(*[F.count_if(at == i) for i in range(len(bounds) + 1)])


def _low(i: Column, bounds: tuple) -> Column:
    return F.when(i == 0, 0.0).otherwise(F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.greatest(i, F.lit(1))))


def _high(i: Column, bounds: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(float(b)) for b in (*bounds, 2 * bounds[-1])]), i + 1)


def quantile(hist: Column, q: float, bounds: tuple = BOUNDS) -> Column:
    """Quantile interpolated inside its bucket; null for an empty histogram."""
    want = F.aggregate(hist, F.lit(0).cast("bigint"), lambda s, c: s + c) * q

    def step(s: Column, i: Column) -> Column:
        c = F.element_at(hist, i + 1)
        here = s["v"].isNull() & (c > 0) & (s["n"] + c >= want)
        v = _low(i, bounds) + (_high(i, bounds) - _low(i, bounds)) * ((want - s["n"]) / c)
        return F.struct((s["n"] + c).alias("n"), F.when(here, v).otherwise(s["v"]).alias("v"))

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds))), start, step, lambda s: s["v"])


def edge_quantile(hist: Column, q: float, bounds: tuple = EDGES) -> Column:
    """Upper edge of the bucket in which the quantile lies; twice the last edge for the open one."""
    want = F.aggregate(hist, F.lit(0).cast("bigint"), lambda s, c: s + c) * q

    def step(s: Column, i: Column) -> Column:
        n = s["n"] + F.element_at(hist, i + 1)
        return F.struct(n.alias("n"), F.when(s["v"].isNull() & (n >= want) & (want > 0), _high(i, bounds)).otherwise(s["v"]).alias("v"))

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds))), start, step, lambda s: s["v"])


def apdex(hist: Column, target_ms: float, bounds: tuple = BOUNDS) -> Column:
    """(satisfied up to the target + half of those up to four times it) / all, interpolated inside buckets."""
    n = F.aggregate(hist, F.lit(0).cast("bigint"), lambda s, c: s + c)

    def below(x: float) -> Column:
        share = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(float(x)) - _low(i, bounds)) / (_high(i, bounds) - _low(i, bounds))))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds))), F.lit(0.0), lambda s, i: s + F.element_at(hist, i + 1) * share(i))

    return F.when(n > 0, (below(target_ms) + below(4 * target_ms)) / 2 / n)


def zscore(value: Column, median: Column, mad: Column) -> Column:
    """Distance from the median in spreads; a flat baseline still has a spread."""
    return (value - median) / F.greatest(mad, F.lit(1.0), median * 0.1)


def wilson(good: Column, n: Column, z: float = 1.645) -> Column:
    """Lower bound of a share."""
    p = good / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)).otherwise(0.0)


def kappa(yes_yes: Column, yes_no: Column, no_yes: Column, no_no: Column) -> Column:
    """Agreement of two raters beyond chance; 1 or 0 where chance alone agrees always."""
    n = yes_yes + yes_no + no_yes + no_no
    seen = (yes_yes + no_no) / n
    chance = ((yes_yes + yes_no) * (yes_yes + no_yes) + (no_yes + no_no) * (yes_no + no_no)) / (n * n)
    return F.when(chance >= 1, F.when(seen >= 1, 1.0).otherwise(0.0)).otherwise((seen - chance) / (1 - chance))
