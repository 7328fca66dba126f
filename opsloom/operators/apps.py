"""Applications in detail: their hosts and services, and a status with its reasons.

Lines and spans are counted by host and service before any join; what is joined
is as large as the number of hosts and services, not as that of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.observations import MINUTE
from .rollups import severe
from .views import member_services, owned, within

# Silence of a host, and the error rate that makes a reason.
SILENT_US = 5 * MINUTE
HIGH_ERRORS = 0.05
#: Reasons that make a status critical; any other makes it a warning.
CRITICAL = ("slo_breach", "thr_crit", "all_silent")


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names]


def _rate(errors: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.round(F.col(errors) / F.col(of), 5))


def host_rows(obs: DataFrame, members: DataFrame, alarms: DataFrame, start_us: int, now_us: int, silent_us: int = SILENT_US) -> DataFrame:
    """Member hosts of applications with their lines, last sign of life, state and level.

    `members` has app, kind and name, `alarms` host and level (crit, warn or
    anomaly). Every named host has one row for each application, without lines
    too: unknown where none was ever seen, silent where the last one is older
    than `silent_us`, else reporting. The level is crit before warn, else ok.
    Names are compared without regard to case; a null name is no host.
    """
    inside = (F.col("us") >= start_us) & (F.col("us") < now_us)
    seen = obs.where(F.col("us") < now_us).groupBy(F.lower("host").alias("host")).agg(F.count_if(inside).alias("lines"), F.count_if(inside & severe()).alias("errors"), F.max("us").alias("last_us"))
    level = alarms.groupBy(F.lower("host").alias("host")).agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("crit", "warn", "anomaly")])
    hosts = members.where("kind = 'host' AND name IS NOT NULL").select("app", F.lower("name").alias("host")).distinct()
    state = F.when(F.col("last_us").isNull(), "unknown").when(F.col("last_us") < now_us - silent_us, "silent").otherwise("reporting")
    rows = hosts.join(seen, "host", "left").join(level, "host", "left").select("app", "host", *_zero("lines", "errors", "crit", "warn", "anomaly"), "last_us", state.alias("state"))
    return rows.withColumns({"error_rate": _rate("errors", "lines"), "level": F.when(F.col("crit") > 0, "crit").when(F.col("warn") > 0, "warn").otherwise("ok")})


def service_rows(obs: DataFrame, spans: DataFrame, members: DataFrame, start_us: int, now_us: int) -> DataFrame:
    """Services of applications with lines and calls, whichever of both they have.

    `spans` has host, service, start_us and error. A service belongs to an
    application by its own name (`member`) or by a member host that it ran on;
    then only what it did there counts. Rows without a service have none here.
    """
    lines = within(obs, start_us, now_us).groupBy("host", "service").agg(F.count("*").alias("lines"), F.count_if(severe()).alias("errors"))
    calls = spans.where((F.col("start_us") >= start_us) & (F.col("start_us") < now_us)).groupBy("host", "service").agg(F.count("*").alias("calls"), F.count_if("error").alias("call_errors"))
    total = lambda counts, *names: owned(counts, members).where("service IS NOT NULL").groupBy("app", "service").agg(*[F.sum(n).alias(n) for n in names])
    both = total(lines, "lines", "errors").join(total(calls, "calls", "call_errors"), ["app", "service"], "full")
    named = member_services(both, members).withColumn("member", F.lit(True))
    rows = both.join(named, ["app", "service"], "left").select("app", "service", F.coalesce("member", F.lit(False)).alias("member"), *_zero("lines", "errors", "calls", "call_errors"))
    return rows.withColumns({"error_rate": _rate("errors", "lines"), "call_error_rate": _rate("call_errors", "calls")})


def health(members: DataFrame, hosts: DataFrame, services: DataFrame, targets: DataFrame) -> DataFrame:
    """Status of each application with its reasons, out of `host_rows` and `service_rows`.

    `targets` has app and availability in percent (null: no target), at most one
    row for each application. Availability is that of calls, of lines where there
    are none. Reasons come in a fixed order; without any the status is ok, or
    nodata where nothing was seen. Latency targets and lines without a service
    are not looked at.
    """
    h = hosts.groupBy("app").agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("reporting", "silent", "unknown")], *[F.sum(x).alias(x) for x in ("crit", "warn", "anomaly")])
    s = services.groupBy("app").agg(*[F.sum(x).alias(x) for x in ("lines", "errors", "calls", "call_errors")])
    numbers = ("reporting", "silent", "unknown", "crit", "warn", "anomaly", "lines", "errors", "calls", "call_errors")
    rows = members.select("app").distinct().join(h, "app", "left").join(s, "app", "left").join(targets.select("app", F.col("availability").alias("target")), "app", "left").select("app", "target", *_zero(*numbers))
    c = F.col
    lost = F.when(c("calls") > 0, c("call_errors") / c("calls")).when(c("lines") > 0, c("errors") / c("lines"))
    high = lambda errors, of: (c(of) > 0) & (c(errors) / c(of) >= HIGH_ERRORS)
    reasons = {
        "slo_breach": F.coalesce((1 - lost) * 100 < c("target"), F.lit(False)),
        "thr_crit": c("crit") > 0,
        "all_silent": (c("reporting") == 0) & (c("silent") > 0),
        "thr_warn": c("warn") > 0,
        "anomaly": c("anomaly") > 0,
        "silent": (c("silent") > 0) & (c("reporting") > 0),
        "errors_high": high("errors", "lines") | high("call_errors", "calls"),
    }
    rows = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(x, F.lit(name)) for name, x in reasons.items()])))
    status = F.when(F.arrays_overlap("reasons", F.array(*map(F.lit, CRITICAL))), "crit").when(F.size("reasons") > 0, "warn").when(c("lines") + c("calls") + c("reporting") > 0, "ok").otherwise("nodata")
    return rows.select("app", status.alias("status"), F.array_join("reasons", ",").alias("reasons"), F.round(1 - lost, 6).alias("availability"), *numbers)


def events_of(anomalies: DataFrame, members: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Anomalies that were open or seen in the range on an application's hosts or services, once for each application.

    `anomalies` has host, service, first_us, last_us and open; those that began
    after the range are not its own. Either of host and service may be null.
    """
    inside = anomalies.where((F.col("first_us") < end_us) & (F.col("open") | (F.col("last_us") >= start_us)))
    places = owned(inside.select("host", "service").distinct(), members)
    same = F.col("p.host").eqNullSafe(F.col("a.host")) & F.col("p.service").eqNullSafe(F.col("a.service"))
    return inside.alias("a").join(places.alias("p"), same).select("p.app", "a.*")
