"""Alarm storms as a whole: hot cells of services and hosts, clusters, slow burns that take alarms back, and the cards that remain.

Alarms have seq (unique), us, service, host, severity, alarm_type, message and rack
(where the host stands; empty for unknown). Nulls in service, host, alarm_type and
rack count as empty. Bars are counted from the minute of the first alarm. No step
pairs the alarms of a group: they meet clusters by service and bar, and all that is
compared with each other are cells, clusters and signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.observations import MINUTE
from . import correlation, graph, incidents
from .correlation import cause_rank
from .rollups import severe

# Types and words of network alarms, words of causes beside those of `correlation`, texts that blame a service, weights of a card.
INFRASTRUCTURE = ("network_down", "network_flap", "pkt_loss", "ntp_drift")
INFRASTRUCTURE_WORDS = ("arayuz", "link", "paket kaybi", "network", "interface", "packet loss", "switch", "power", "guc", "koptu")
WORDS = ("disk", "storage", "power", "switch", "link", "bgp", "san", "nfs", "tablespace", "veritabani", "baglanti havuzu", "arayuz", "koptu", "paket kaybi", "dis servis", "heap", "outofmemory")
BLAMES = (r"([a-z][\w\-]+) servisine yapilan cagri", r"([a-z][\w\-]+) baglantisi reddedildi", r"dis servis ([a-z][\w\-]+)")
WEIGHTS = {"burst": 0.30, "severity": 0.20, "blast_radius": 0.20, "duration": 0.15, "criticality": 0.15}
#: Width of a bar; alarms that heat a service's or a host's bar, and times its median; minutes around a cluster's bars.
STEP, HOT, HOST_HOT, RATIO, PAD = 5 * MINUTE, 4, 5, 3.0, 2 * MINUTE
#: A slow burn: least rank of its types, ERROR+ alarms in 15 minutes, their hosts, and how long alarms after it belong to it.
BURN_RANK, BURN_LEAST, BURN_HOSTS, BURN_WINDOW, BURN_AFTER = 1.5, 4, 2, 15 * MINUTE, 10 * MINUTE
#: A card needs this many alarms and ERROR+ ones; so many cards are shown; hosts of a rack that make it a cause.
CARD_ALARMS, CARD_ERRORS, CARDS, RACK_HOSTS = 15, 3, 15, 3


def placed(alarms: DataFrame, step_us: int = STEP) -> DataFrame:
    """Alarms with empty texts for nulls, their bar, when bars begin (t0) and how many there are (bars)."""
    span = alarms.agg((F.floor(F.min("us") / MINUTE) * MINUTE).alias("t0"), F.max("us").alias("_end"))
    full = alarms.withColumns({c: F.coalesce(c, F.lit("")) for c in ("service", "host", "alarm_type", "rack")})
    at = full.crossJoin(F.broadcast(span))
    return at.withColumn("bar", F.floor((F.col("us") - F.col("t0")) / step_us)).withColumn("bars", (F.floor((F.col("_end") - F.col("t0")) / step_us) + 1).cast("int")).drop("_end")


def homes(at: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """(host, home): the service of each host's first alarm, or that of the inventory (host, service) if that alarm has none."""
    first = at.where("host <> ''").groupBy("host").agg(F.min_by("service", F.struct("us", "seq")).alias("home"))
    if inventory is not None:
        known = inventory.groupBy("host").agg(F.min("service").alias("known"))
        first = first.join(known, "host", "left").select("host", F.coalesce(F.nullif("home", F.lit("")), "known").alias("home"))
    return first.where("home <> ''")


def heated(at: DataFrame, home: DataFrame, least: int = HOT, host_least: int = HOST_HOT, ratio: float = RATIO) -> DataFrame:
    """Hot cells (service, bar, kind, key, n, median, threshold): a service's own count is over its limit, or that of one of its hosts.

    Limits are `ratio` medians over all bars, empty ones too, and `least` or
    `host_least`. The service itself goes before hosts, and hosts by name.
    """
    per = at.groupBy("service", "host", "bar", "bars").agg(F.count("*").alias("n"))
    of = lambda kind: per.where(f"{kind} <> ''").groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("key"), "bar", "bars").agg(F.sum("n").alias("n"))
    n = of("service").unionByName(of("host"))
    counts = n.groupBy("kind", "key").agg(F.array_sort(F.collect_list("n")).alias("c"), F.first("bars").alias("b"))
    value = lambda i: F.when(i < F.col("b") - F.size("c"), 0).otherwise(F.get("c", (i - F.col("b") + F.size("c")).cast("int")))
    half = F.floor(F.col("b") / 2)
    median = F.when(F.col("b") % 2 == 1, value(half).cast("double")).otherwise((value(half - 1) + value(half)) / 2)
    limits = counts.withColumn("median", median).select("kind", "key", "median", F.greatest(F.when(F.col("kind") == "host", float(host_least)).otherwise(float(least)), ratio * F.col("median")).alias("threshold"))
    hot = n.join(limits, ["kind", "key"]).where("n >= threshold").join(home.withColumnRenamed("host", "key"), "key", "left")
    hot = hot.withColumn("service", F.when(F.col("kind") == "service", F.col("key")).otherwise(F.col("home"))).where("service IS NOT NULL")
    why = F.min(F.struct((F.col("kind") == "host").alias("later"), "key", "kind", "n", "median", "threshold"))
    return hot.groupBy("service", "bar").agg(why.alias("w")).select("service", "bar", "w.kind", "w.key", "w.n", "w.median", "w.threshold")


def infrastructure() -> Column:
    """An alarm of the network: by its type, or by its message if it has none."""
    said = F.lower(F.coalesce("message", F.lit(""))).rlike("|".join(INFRASTRUCTURE_WORDS))
    return F.when(F.col("alarm_type") != "", F.lower("alarm_type").isin(*INFRASTRUCTURE)).otherwise(said)


def cell_racks(at: DataFrame, cells: DataFrame) -> DataFrame:
    """(service, bar, rack): where most network alarms of a hot cell stand (ties: the smallest name); cells without a known rack have no row."""
    per = at.where(infrastructure()).groupBy("service", "bar", "rack").agg(F.count("*").alias("n")).join(cells.select("service", "bar"), ["service", "bar"], "left_semi")
    return per.groupBy("service", "bar").agg(F.min(F.struct((-F.col("n")).alias("most"), "rack")).alias("r")).select("service", "bar", "r.rack").where("rack <> ''")


def clustered(at: DataFrame, cells: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Cells (service, bar) with their cluster, named after its first cell by service and bar.

    Cells of neighbouring bars belong together if their services are one, depend on
    each other, or have network alarms in the same rack.
    """
    of = correlation.storm_clusters(cells, dependencies, cell_racks(at, cells)).withColumnRenamed("cluster", "_c")
    first = of.groupBy("_c").agg(F.min(F.struct("service", "bar")).alias("first"))
    return of.join(first, "_c").select("service", "bar", F.concat_ws("@", "first.service", "first.bar").alias("cluster"), "first")


def claimed(at: DataFrame, clusters: DataFrame, home: DataFrame, step_us: int = STEP, pad_us: int = PAD) -> DataFrame:
    """(seq, cluster): alarms of a cluster's services, or of their hosts, between its bars with `pad_us` around; the cluster with the first cell wins."""
    t0 = at.agg(F.min("t0").alias("t0"))
    wide = clusters.groupBy("cluster").agg(F.min("bar").alias("lo_bar"), F.max("bar").alias("hi_bar"), F.min("first").alias("first")).crossJoin(F.broadcast(t0))
    wide = wide.select("cluster", "lo_bar", "hi_bar", F.struct("first", "cluster", (F.col("t0") + F.col("lo_bar") * step_us - pad_us).alias("lo"), (F.col("t0") + (F.col("hi_bar") + 1) * step_us + pad_us).alias("hi")).alias("w"))
    around = -(-pad_us // step_us)
    reach = clusters.select("cluster", "service").distinct().join(wide, "cluster").select("service", F.explode(F.sequence(F.col("lo_bar") - around, F.col("hi_bar") + around)).alias("bar"), "w")
    windows = graph.written(reach.groupBy("service", "bar").agg(F.array_sort(F.collect_list("w")).alias("ws")))
    fits = lambda ws: F.get(F.filter(ws, lambda w: (w["lo"] <= F.col("us")) & (F.col("us") <= w["hi"])), F.lit(0))
    own = at.select("seq", "us", "service", "host", "bar").join(home, "host", "left").join(graph.shuffled(windows), ["service", "bar"], "left").withColumn("mine", fits("ws")).drop("ws")
    both = own.join(graph.shuffled(windows.withColumnRenamed("service", "home")), ["home", "bar"], "left").withColumn("w", F.least("mine", fits("ws")))
    return both.where("w IS NOT NULL").select("seq", F.col("w.cluster").alias("cluster"))


def blamed(at: DataFrame, patterns: tuple[str, ...] = BLAMES) -> DataFrame:
    """(seq, blamed): the service that a message says is at fault, lower-cased: of the first pattern that names a known one but the alarm's own."""
    names = F.array(*[F.lower(F.regexp_extract("message", f"(?i){p}", 1)) for p in patterns])
    named = at.select("seq", F.lower("service").alias("own"), F.posexplode(names).alias("place", "blamed")).where("blamed <> '' AND blamed <> own")
    known = at.where("service <> ''").select(F.lower("service").alias("blamed")).distinct()
    return named.join(known, "blamed", "left_semi").groupBy("seq").agg(F.min_by("blamed", "place").alias("blamed"))


def slow_burns(at: DataFrame, clusters: DataFrame, patterns: tuple[str, ...] = BLAMES, pad_us: int = PAD, least: int = CARD_ALARMS) -> tuple[DataFrame, DataFrame]:
    """Chains of a service whose alarms of a cause escalate without heating a bar: members (seq, cluster) and spans (cluster, lo, hi).

    A type escalates that has ERROR+ alarms enough in a window on several hosts;
    the service's alarms from its first to its last such alarm, with a margin, and
    those that blame it meanwhile are the chain, if they are `least` or more. A
    service with a cell in a cluster has none: that is judged before any chain takes
    alarms. An alarm of one chain that blames the service of another is in both.
    """
    bad = at.where(severe() & (cause_rank(F.lower("alarm_type"), 0.0) >= BURN_RANK) & (F.col("service") != "")).withColumn("kind", F.lower("alarm_type"))
    escalating = incidents.slow_burn(bad, ["service", "kind"], BURN_WINDOW, BURN_LEAST, BURN_HOSTS).select("service", "kind").distinct()
    chains = bad.join(escalating, ["service", "kind"], "left_semi").join(clusters, "service", "left_anti")
    chains = chains.groupBy("service").agg((F.min("us") - pad_us).alias("lo"), (F.max("us") + pad_us + BURN_AFTER).alias("hi")).select(F.concat(F.lit("burn@"), "service").alias("cluster"), "service", "lo", "hi")
    chains = graph.written(chains)
    inside = F.col("us").between(F.col("lo"), F.col("hi"))
    own = at.select("seq", "us", "service").join(chains, "service").where(inside).select("seq", "cluster")
    others = at.select("seq", "us").join(graph.shuffled(blamed(at, patterns)), "seq").join(chains.withColumn("blamed", F.lower("service")), "blamed").where(inside).select("seq", "cluster")
    members = graph.written(own.unionByName(others).distinct())
    big = members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return members.join(big, "cluster", "left_semi"), chains.join(big, "cluster", "left_semi").select("cluster", "lo", "hi")


def storms(alarms: DataFrame, dependencies: DataFrame, inventory: DataFrame | None = None, patterns: tuple[str, ...] = BLAMES) -> tuple[DataFrame, DataFrame]:
    """Members (seq, cluster, kept) and spans (cluster, lo, hi, claimed) of all storms.

    Slow burns take their alarms out of other clusters. Not kept are alarms of pairs
    of service and type that run at their normal rate inside the cluster.
    """
    at = graph.written(placed(alarms))
    home = graph.written(homes(at, inventory))
    cells = graph.written(heated(at, home))
    clusters = graph.written(clustered(at, cells, dependencies))
    burning, burn_spans = slow_burns(at, clusters, patterns)
    dense = claimed(at, clusters, home).join(graph.shuffled(burning), "seq", "left_anti")
    members = graph.written(dense.unionByName(burning.select("seq", "cluster")))
    t0 = at.agg(F.min("t0").alias("t0"))
    dense_spans = clusters.groupBy("cluster").agg(F.min("bar").alias("b"), F.max("bar").alias("e")).crossJoin(F.broadcast(t0)).select("cluster", (F.col("t0") + F.col("b") * STEP - PAD).alias("lo"), (F.col("t0") + (F.col("e") + 1) * STEP + PAD).alias("hi"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("claimed"))
    spans = graph.written(dense_spans.unionByName(burn_spans).join(sizes, "cluster"))
    minutes = spans.select("cluster", F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo")) / MINUTE).alias("span_min"))
    kept = correlation.elevated(at, members, minutes).withColumn("kept", F.lit(True))
    return graph.written(members.join(graph.shuffled(kept), ["seq", "cluster"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))), spans


def quiet_minutes(at: DataFrame, own: DataFrame) -> DataFrame:
    """(cluster, base): median alarms a minute of a cluster's services in minutes that don't begin between its start and end.

    `own` is (cluster, service, start_us, end_us). Each service's counts are a
    histogram, from which the minutes inside are taken off, so a long history isn't
    read again for every cluster.
    """
    per = at.where("service <> ''").groupBy("service", (F.floor(F.col("us") / MINUTE) * MINUTE).alias("minute")).agg(F.count("*").alias("n"))
    all_of = own.join(per.groupBy("service", "n").agg(F.count("*").alias("k")), "service").select("cluster", "n", "k")
    first = F.ceil(F.col("start_us") / MINUTE) * MINUTE
    held = own.where(first <= F.col("end_us")).select("cluster", "service", F.explode(F.sequence(first, F.col("end_us"), F.lit(MINUTE))).alias("minute"))
    inside = held.join(graph.shuffled(per), ["service", "minute"]).select("cluster", "n", F.lit(-1).cast("bigint").alias("k"))
    left = all_of.unionByName(inside).groupBy("cluster", "n").agg(F.sum("k").alias("k")).where("k > 0")
    return left.groupBy("cluster").agg(F.percentile("n", F.lit(0.5), F.col("k")).alias("base"))


def cards(alarms: DataFrame, members: DataFrame, spans: DataFrame, critical: DataFrame | None = None, most: int = CARDS) -> DataFrame:
    """Clusters with their score, place and verdict: card, demoted (beyond `most`) or small.

    Scores are of the alarms that were kept. `critical` is (host, critical): the
    share of critical hosts among those that it lists. Equal scores go by the number
    of alarms before pruning, then by the cluster's name. Clusters of which nothing
    is kept have no row.
    """
    at = placed(alarms)
    rows = graph.written(at.join(graph.shuffled(members.where("kept").select("seq", "cluster")), "seq"))
    fleet = at.agg(F.countDistinct(F.nullif("service", F.lit(""))).alias("s"), F.countDistinct(F.nullif("host", F.lit(""))).alias("h")).select(F.greatest(F.lit(6.0), 0.5 * (F.col("s") + F.col("h"))).alias("half"))
    per = rows.groupBy("cluster", F.floor(F.col("us") / MINUTE).alias("minute")).agg(
        F.count("*").alias("n"), F.count_if(severe()).alias("bad"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.max(F.col("severity") == "CRITICAL").alias("worst"))
    whole = per.groupBy("cluster").agg(F.sum("n").alias("alarms"), F.sum("bad").alias("errors"), F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.max("n").alias("peak"), F.coalesce(F.max("worst"), F.lit(False)).alias("worst"))
    services = rows.where("service <> ''").select("cluster", "service").distinct()
    hosts = rows.where("host <> ''").select("cluster", "host").distinct()
    base = quiet_minutes(at, services.join(whole.select("cluster", "start_us", "end_us"), "cluster"))
    share = hosts.select("cluster", F.lit(0.0).alias("share")).distinct() if critical is None else hosts.join(critical.groupBy("host").agg(F.max("critical").alias("critical")), "host").groupBy("cluster").agg(F.avg(F.col("critical").cast("int")).alias("share"))
    j = whole
    for part in (services.groupBy("cluster").agg(F.count("*").alias("n_services")), hosts.groupBy("cluster").agg(F.count("*").alias("n_hosts")), base, share):
        j = j.join(part, "cluster", "left")
    j = j.na.fill(0, ["n_services", "n_hosts", "base", "share"]).join(spans.select("cluster", "claimed"), "cluster").crossJoin(F.broadcast(fleet))
    ratio = F.col("peak") / (F.col("base") + 1.0)
    raw = {
        "burst": F.round(F.when(ratio > 1, F.least(F.lit(1.0), (ratio - 1) / 9)).otherwise(0.0), 3), "severity": F.col("errors") / F.col("alarms"),
        "blast_radius": F.least(F.lit(1.0), (F.col("n_services") + F.col("n_hosts")) / F.col("half")), "duration": F.least(F.lit(1.0), (F.col("end_us") - F.col("start_us")) / (60.0 * MINUTE)), "criticality": F.col("share"),
    }
    j = j.withColumn("score", F.round(sum((F.round(WEIGHTS[k] * raw[k], 3) for k in WEIGHTS), F.lit(0.0)), 3))
    level = F.when((F.col("score") >= 0.6) | F.col("worst"), "critical").when(F.col("score") >= 0.4, "high").when(F.col("score") >= 0.2, "medium").otherwise("low")
    small = (F.col("alarms") < CARD_ALARMS) | (F.col("errors") < CARD_ERRORS)
    j = graph.written(j.select("cluster", "alarms", "errors", "n_services", "n_hosts", "start_us", "end_us", "base", "score", level.alias("severity"), "claimed", small.alias("small")))
    order = [F.desc("score"), F.desc("claimed"), F.asc("cluster")]
    best = j.where("NOT small").orderBy(*order).limit(most).agg(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("claimed")).alias("c"), "cluster")).alias("b"))
    shown = best.select(F.posexplode(F.array_sort("b")).alias("p", "x")).select((F.col("p") + 1).alias("place"), "x.cluster")
    return j.join(F.broadcast(shown), "cluster", "left").withColumn("verdict", F.when(F.col("small"), "small").when(F.col("place").isNull(), "demoted").otherwise("card")).drop("small")


def audited(alarms: DataFrame, members: DataFrame, judged: DataFrame) -> DataFrame:
    """(seq, cluster, outcome) of every alarm: card, demoted or small after its cluster; baseline for what no cluster keeps."""
    of = members.where("kept").join(judged.select("cluster", "verdict"), "cluster").select("seq", "cluster", "verdict")
    return alarms.select("seq").join(graph.shuffled(of), "seq", "left").select("seq", "cluster", F.coalesce("verdict", F.lit("baseline")).alias("outcome"))


def causes(alarms: DataFrame, members: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Signals of each cluster with their score as its cause, and their place.

    What kind of alarm a signal is weighs more than who fired first, since noise fires
    first too. A signal's kind and rack are those of its first alarm. The first
    onset of a cause counts, and so does a rack in which network alarms came from
    RACK_HOSTS hosts or more (the rack with most hosts; ties: the smallest name).
    """
    rows = correlation.fingerprinted(placed(alarms).join(graph.shuffled(members.where("kept").select("seq", "cluster")), "seq"))
    rows = graph.written(rows.withColumn("fingerprint", F.concat_ws("|", "cluster", "fingerprint")))
    first = rows.groupBy("fingerprint").agg(F.min(F.struct("us", "seq", F.lower("alarm_type").alias("kind"), "rack")).alias("o")).select("fingerprint", "o.kind", "o.rack")
    s = graph.written(correlation.signals(rows, "cluster").join(first, "fingerprint"))
    net = s.where(F.col("kind").isin(*INFRASTRUCTURE) & (F.col("kind") != "ntp_drift") & (F.col("rack") != "")).select("cluster", "rack", "fingerprint")
    racks = net.join(rows.where("host <> ''").select("fingerprint", "host").distinct(), "fingerprint").groupBy("cluster", "rack").agg(F.countDistinct("host").alias("hosts"))
    best = racks.groupBy("cluster").agg(F.min(F.struct((-F.col("hosts")).alias("h"), "rack")).alias("b")).where(F.col("b.h") <= -RACK_HOSTS).select("cluster", "b.rack")
    in_rack = net.join(best, ["cluster", "rack"]).select("fingerprint", F.lit(True).alias("in_rack"))
    rank, cause = text.rank(F.col("severity")), cause_rank(F.col("kind"), 0.0)
    lead = s.groupBy("cluster").agg(F.min_by("onset_us", F.struct("first_us", -F.coalesce(rank, F.lit(-1)), "fingerprint")).alias("earliest"), F.min(F.when(cause >= 2, F.col("onset_us"))).alias("first_cause_us"))
    entities = correlation.signal_entities(rows).join(s.select("fingerprint", "cluster"), "fingerprint").select("cluster", "fingerprint", "entity")
    sizes = s.where("service <> ''").groupBy("cluster", F.lower("service").alias("own")).agg(F.count("*").alias("k"))
    d = dependencies.select(F.lower("source").alias("source"), F.lower("target").alias("target")).distinct()
    pair = d.join(sizes.select("cluster", F.col("own").alias("source"), F.col("k").alias("k_source")), "source").join(sizes.select("cluster", F.col("own").alias("target"), F.col("k").alias("k_target")), ["cluster", "target"])
    # A service that depends on itself counts its other signals only.
    alike = (F.col("source") == F.col("target")).cast("int")
    provider = pair.groupBy("cluster", F.col("target").alias("own")).agg(F.sum(F.col("k_source") - alike).alias("provider"))
    consumer = pair.groupBy("cluster", F.col("source").alias("own")).agg(F.sum(F.col("k_target") - alike).alias("consumer"))
    j = s.withColumn("own", F.lower("service")).join(lead, "cluster").join(correlation.shared_fan(entities, "cluster"), "fingerprint", "left").join(in_rack, "fingerprint", "left")
    j = j.join(provider, ["cluster", "own"], "left").join(consumer, ["cluster", "own"], "left").na.fill(0, ["fan", "provider", "consumer"])
    word = F.coalesce(F.col("template").rlike("|".join(correlation.CAUSE_WORDS + WORDS)), F.lit(False)).cast("int")
    minutes = (F.col("onset_us") - F.col("earliest")) / MINUTE
    first_cause = (F.coalesce((cause >= 2) & (F.col("onset_us") == F.col("first_cause_us")), F.lit(False))).cast("int")
    score = cause * 1.2 + F.coalesce(rank, F.lit(0)) * 0.8 + F.log1p("lines") * 0.6 - minutes * 0.4 + word * 0.5 + F.least(F.lit(3), F.col("provider")) * 0.6 - F.least(F.lit(3), F.col("consumer")) * 0.6 + F.col("fan") * 0.05 + first_cause * 1.5 + F.coalesce("in_rack", F.lit(False)).cast("int") * 2.5
    j = j.withColumn("cause_score", F.round(score, 2))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("cause_score"), "first_us", F.desc(rank), "fingerprint"))
    return j.withColumn("place", place).select("cluster", "fingerprint", "kind", "severity", "service", "lines", "onset_us", "fan", "provider", "consumer", "cause_score", "place")
