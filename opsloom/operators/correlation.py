"""The incident engine: signals, what links them, incidents, their root cause, score and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.observations import MINUTE
from . import graph
from .rollups import bucket, severe

# Entities and dependencies named in messages, words of causes, signs of a restart, how likely a type of alarm is a cause, weights of an incident's score.
ENTITY = r"(?i)\b(?:\d{1,3}(?:\.\d{1,3}){3}|[a-z][\w\-]*(?:-\d+|\.[a-z]+)+|[a-z]+-(?:api|db|svc|service|cache|queue|worker|gateway|proxy)\b)"
DEPENDENCY = r"(?i)(?:upstream|downstream|to|from|calling|call to|connect(?:ing|ion)? to|dependency)\s+((?:[a-z][a-z0-9_.-]*?)?(?:-api|-service|-svc|-db|-cache|-queue|-gateway|-proxy|-worker|db-\d+|db|postgres(?:ql)?|mysql|redis|kafka|rabbitmq|elasticsearch|mongo(?:db)?|cache))\b"
CAUSE_WORDS = ("database", "db", "postgres", "mysql", "redis", "kafka", "queue", "connection", "network", "dns", "disk", "storage", "latency", "duration", "slow", "certificate", "auth", "gateway", "no space", "oom")
RESTART = r"(?i)\b(restart(?:ed|ing)?|reboot(?:ed)?|start(?:ed|ing)? (?:up|service|server|application)|(?:database|system) (?:is )?ready|listening on|boot(?:ed|ing)?|initializ(?:ed|ing)|reloaded|recovered|back online|healthy|failover complete|shut(?:ting)? down|pool (?:reset|recreated)|reconnected)\b"
CAUSE_RANK = {
    "network_down": 5.0, "pkt_loss": 4.5, "network_flap": 3.5, "disk_full": 5.0, "db_write_fail": 3.5, "oom_risk": 3.5, "ext_unreach": 4.5, "ext_slow": 3.5, "db_conn_pool": 2.5, "conn_refused": 2.5, "batch_overlap": 3.0, "batch_slow": 2.0,
    "gc_pressure": 2.0, "mem_high": 1.5, "cpu_high": 1.5, "thread_pool": 1.5, "queue_backlog": 1.5, "disk_warn": 1.5, "timeout": 1.0, "http_5xx": 0.5, "latency_high": 0.5, "txn_fail": 0.5, "cert_expiry": 0.0, "backup_warn": 0.0, "ntp_drift": 0.0, "log_rotate": 0.0,
}
WEIGHTS = {"burst": 0.35, "severity": 0.25, "blast_radius": 0.25, "duration": 0.15}
#: First observations of a signal whose entities are looked at where a query asks for those only; minutes within which signals can belong together.
ENTITY_SAMPLE, WINDOW_MIN = 40, 10
#: Chronic: share of the data's span, burst below, lines at least. Sustained: WARN lines at least, hosts at most.
CHRONIC_SHARE, CHRONIC_BURST, CHRONIC_LINES, SUSTAINED_LINES, SUSTAINED_HOSTS = 0.7, 0.3, 8, 25, 2
QUIET_US = 2 * MINUTE


def entities(message: Column) -> Column:
    """Addresses, hosts and services that a message names, lower-cased."""
    # All of them have a dot or a dash, so texts without are not searched.
    searched = F.when(~F.contains(message, F.lit(".")) & ~F.contains(message, F.lit("-")), "").otherwise(message)
    return F.array_distinct(F.transform(F.regexp_extract_all(searched, F.lit(ENTITY), F.lit(0)), F.lower))


def dependency(message: Column) -> Column:
    """What a message says it calls; null for nothing."""
    return F.nullif(F.lower(F.regexp_extract(message, DEPENDENCY, 1)), F.lit(""))


def cause_rank(alarm_type: Column, otherwise: float) -> Column:
    """How likely a type of alarm is a cause (5) and not a symptom (0); `otherwise` for types that aren't listed."""
    ranks = F.create_map(*[F.lit(x) for pair in CAUSE_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.coalesce(alarm_type, F.lit(""))), F.lit(otherwise))


def dependency_edges(obs: DataFrame) -> DataFrame:
    """How often ERROR+ lines of a service name another one."""
    t = obs.where(severe() & text.present(F.col("service"))).select("service", dependency(F.col("message")).alias("target"))
    return t.where("target IS NOT NULL AND target <> lower(service)").groupBy("service", "target").agg(F.count("*").alias("lines"))


def fingerprinted(obs: DataFrame) -> DataFrame:
    rows = obs.withColumn("template", text.template(F.col("message")))
    return rows.withColumn("fingerprint", text.fingerprint(F.col("template"), F.col("severity"), F.col("service")))


def signals(rows: DataFrame, within: str | None = None) -> DataFrame:
    """Fingerprinted observations as signals with their burst; `within` is a column that fingerprints don't cross and whose span counts for them.

    The baseline is the upper median over all minutes of the data's span, quiet
    ones counting as zeros; zeros are counted, not made. The onset is the first
    minute with twice the baseline, or the peak minute.
    """
    groups = [within] if within else []
    ids = [*groups, "fingerprint"]
    span = rows.groupBy(*groups).agg(F.greatest(F.lit(1), F.floor((F.max("us") - F.min("us")) / MINUTE) + 1).cast("int").alias("span"))
    # The pairs of minute and host are what is left of the rows: they are written once and are what all counts come from.
    texts = ["template", "severity", "service"]
    cells = graph.written(rows.groupBy(*ids, *texts, bucket(MINUTE).alias("minute"), F.when(text.present(F.col("host")), F.col("host")).alias("host")).agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi")))
    per = cells.groupBy(*ids, "minute").agg(F.sum("n").alias("n"))
    # Texts are keys first, since an aggregate that keeps one sorts its rows; what is left has a row for each spelling of a service.
    s = cells.groupBy(*ids, *texts).agg(F.sum("n").alias("lines"), F.min("lo").alias("first_us"), F.max("hi").alias("last_us"))
    s = s.groupBy(*ids).agg(F.sum("lines").alias("lines"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *[F.first(c).alias(c) for c in texts])
    hosts = cells.where("host IS NOT NULL").groupBy("fingerprint").agg(F.countDistinct("host").alias("hosts"))
    s = s.join(span, within) if within else s.crossJoin(F.broadcast(span))
    # How many minutes have each count: the middle one is found by sums over the counts and not over the minutes.
    counts = per.groupBy(*ids, "n").agg(F.count("*").alias("k"), F.min("minute").alias("first_minute"))
    up_to = Window.partitionBy(*ids).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(*ids)
    placed = counts.withColumn("up_to", F.sum("k").over(up_to)).withColumn("busy", F.sum("k").over(all_of))
    placed = placed.join(s.select(*ids, "span"), ids).withColumn("middle", F.floor(F.greatest(F.col("busy"), F.col("span")) / 2) - F.greatest(F.lit(0), F.col("span") - F.col("busy")))
    peaks = placed.groupBy(*ids).agg(F.max("n").alias("peak"), F.max_by("first_minute", "n").alias("peak_minute"), F.coalesce(F.min(F.when((F.col("middle") >= 0) & (F.col("up_to") > F.col("middle")), F.col("n"))), F.lit(0).cast("bigint")).alias("baseline"))
    onset = placed.join(peaks, ids).where(F.col("n") >= F.greatest(F.lit(1), 2 * F.col("baseline"))).groupBy(*ids).agg(F.min("first_minute").alias("risen"))
    s = s.join(hosts, "fingerprint", "left").join(peaks, ids).join(onset, ids, "left")
    ratio = F.col("peak") / (F.col("baseline") + 1)
    share = F.round(((F.col("last_us") - F.col("first_us")) / MINUTE + 1) / F.col("span"), 3)
    return s.select(*ids, "template", "severity", "service", "lines", F.coalesce("hosts", F.lit(0)).alias("hosts"), "first_us", "last_us", "peak", "baseline", (F.least("risen", "peak_minute") * MINUTE).alias("onset_us"), F.round(F.when(ratio > 1, F.least(F.lit(1.0), (ratio - 1) / 9)).otherwise(0.0), 3).alias("burst"), share.alias("share"))


def judged(s: DataFrame) -> DataFrame:
    """Signals with chronic, sustained and interesting."""
    chronic = (F.col("share") >= CHRONIC_SHARE) & (F.col("burst") < CHRONIC_BURST) & (F.col("lines") >= CHRONIC_LINES)
    s = s.withColumn("chronic", chronic)
    s = s.withColumn("sustained", ~F.col("chronic") & (F.col("severity") == "WARN") & (F.col("lines") >= SUSTAINED_LINES) & (F.col("hosts") <= SUSTAINED_HOSTS))
    return s.withColumn("interesting", ~F.col("chronic") & (severe() | (F.col("burst") >= 0.5) | F.col("sustained")))


def signal_entities(rows: DataFrame, first: int | None = None) -> DataFrame:
    """(fingerprint, entity) of all observations of each signal: its service, hosts, and what messages name; with `first`, of so many first ones only."""
    some = rows
    if first is not None:
        place = F.row_number().over(Window.partitionBy("fingerprint").orderBy("us", "seq"))
        some = rows.select("fingerprint", "us", "seq", "service", "host", "message").withColumn("place", place).where(F.col("place") <= first)
    named = F.concat(entities(F.coalesce("message", F.lit(""))), F.array(F.lower("service"), F.lower("host")))
    return some.select("fingerprint", F.explode(named).alias("entity")).where("entity IS NOT NULL AND entity <> ''").distinct()


def signal_links(s: DataFrame, of_signal: DataFrame, dependencies: DataFrame, window_min: int = WINDOW_MIN) -> DataFrame:
    """Links (a, b) that connect the same signals as all pairs would that lie within the window and share an entity or a dependency.

    In the order of their beginnings, a signal is near some earlier one of its
    group if it is near the one that ends last; so one link for each is enough, and
    a group of any size is sorted, not paired. Both ends of a dependency are one
    group: signals of one service share that service anyway.
    """
    depends = dependencies.select(F.concat_ws(">", F.lower("source"), F.lower("target")).alias("entity"), F.explode(F.array(F.lower("source"), F.lower("target"))).alias("service"))
    by_dependency = s.select("fingerprint", F.lower("service").alias("service")).join(depends, "service").select("fingerprint", "entity")
    grouped = of_signal.unionByName(by_dependency).distinct().join(s.select("fingerprint", "first_us", "last_us"), "fingerprint")
    before = Window.partitionBy("entity").orderBy("first_us", "fingerprint").rowsBetween(Window.unboundedPreceding, -1)
    near = grouped.withColumn("prior", F.max(F.struct("last_us", "fingerprint")).over(before)).where(F.col("first_us") - F.col("prior.last_us") <= window_min * MINUTE)
    return near.select(F.col("prior.fingerprint").alias("a"), F.col("fingerprint").alias("b")).distinct()


def incidents(s: DataFrame, of_signal: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Interesting signals with the incident (smallest fingerprint) that they belong to.

    An incident has several signals, or one that is ERROR+ or bursts.
    """
    good = graph.written(judged(s).where("interesting"))
    own = of_signal.join(good.select("fingerprint"), "fingerprint", "left_semi")
    of = graph.components(good.select(F.col("fingerprint").alias("node")), signal_links(good, own, dependencies))
    named = good.join(of.select(F.col("node").alias("fingerprint"), F.col("component").alias("incident")), "fingerprint")
    size = named.groupBy("incident").agg(F.count("*").alias("members"), F.max((severe() | (F.col("burst") >= 0.5))).alias("strong")).where("members > 1 OR strong")
    return named.join(size.select("incident", "members"), "incident")


def alike(pairs: DataFrame, within: str, key: str, value: str) -> DataFrame:
    """(within, key, same): the smallest key of its group that has the very same values; from distinct (within, key, value).

    Equal numbers and hashes of values only propose keys that are alike. They are if
    their values together are as many as those of each; else each key stays alone.
    No key's values are put in a list.
    """
    by = [within, "_n", "_h"]
    told = pairs.groupBy(within, key).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64(value)).alias("_h"))
    kinds = pairs.join(graph.shuffled(told), [within, key]).groupBy(*by).agg(F.min(key).alias("_first"), F.countDistinct(value).alias("_all"))
    return told.join(graph.shuffled(kinds), by).select(within, key, F.when(F.col("_all") == F.col("_n"), F.col("_first")).otherwise(F.col(key)).alias("same"))


def shared_fan(entities: DataFrame, within: str) -> DataFrame:
    """(fingerprint, fan): with how many other signals of its group a signal shares an entity; from distinct (within, fingerprint, entity).

    Signals with the same entities are one, and then entities of the same signals are
    one, so what is paired are kinds of both.
    """
    entities = graph.written(entities)
    of = graph.written(alike(entities, within, "fingerprint", "entity"))
    each = graph.written(entities.join(graph.shuffled(of.where("same = fingerprint").select(within, "fingerprint")), [within, "fingerprint"], "left_semi"))
    one = alike(each, within, "entity", "fingerprint").where("same = entity").select(within, "entity")
    each = graph.written(each.join(graph.shuffled(one), [within, "entity"], "left_semi"))
    met = each.withColumnRenamed("fingerprint", "own").join(graph.shuffled(each.withColumnRenamed("fingerprint", "same")), [within, "entity"]).select(within, "own", "same").distinct()
    fan = met.join(of.groupBy(within, "same").agg(F.count("*").alias("k")), [within, "same"]).groupBy(within, "own").agg((F.sum("k") - 1).alias("fan"))
    return of.withColumnRenamed("same", "own").join(fan, [within, "own"]).select("fingerprint", "fan")


def root_causes(members: DataFrame, of_signal: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Each member's score as the cause of its incident, and its place: the earliest onset weighs most, then who is depended on."""
    members = graph.written(members)
    fan = shared_fan(of_signal.join(members.select("fingerprint", "incident"), "fingerprint").select("incident", "fingerprint", "entity"), "incident")
    # How many members a service has in an incident; a dependency then counts them for the other end.
    sizes = members.groupBy("incident", F.lower("service").alias("service")).agg(F.count("*").alias("k"))
    d = dependencies.select(F.lower("source").alias("source"), F.lower("target").alias("target")).distinct()
    pair = sizes.select("incident", F.col("service").alias("source"), F.col("k").alias("k_source")).join(d, "source").join(sizes.select("incident", F.col("service").alias("target"), F.col("k").alias("k_target")), ["incident", "target"])
    provider = pair.groupBy("incident", F.col("target").alias("own")).agg(F.sum("k_source").alias("provider"))
    consumer = pair.groupBy("incident", F.col("source").alias("own")).agg(F.sum("k_target").alias("consumer"))
    earliest = members.groupBy("incident").agg(F.min("onset_us").alias("earliest"))
    m = members.withColumn("own", F.lower("service")).join(fan, "fingerprint", "left").join(provider, ["incident", "own"], "left").join(consumer, ["incident", "own"], "left").join(earliest, "incident")
    zero = lambda c: F.coalesce(c, F.lit(0))
    word = F.lit(False)
    for w in CAUSE_WORDS:
        word = word | F.col("template").contains(w)
    lead = (F.col("onset_us") - F.col("earliest")) / MINUTE
    score = F.round(-lead * 3 + word.cast("int") * 1.5 + zero("fan") * 0.3 + text.rank(F.col("severity")) * 0.3 + zero("provider") * 2.0 - zero("consumer") * 1.0, 2)
    place = F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("cause_score"), "onset_us", "fingerprint"))
    return m.withColumn("cause_score", score).withColumn("place", place).select("incident", "fingerprint", "cause_score", "place", zero("fan").alias("fan"), zero("provider").alias("provider"), zero("consumer").alias("consumer"))


def scored(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Incidents with their weighted score and severity.

    `rows` are the fingerprinted observations. Burst is that of all members
    together against their largest baseline; the blast radius is measured against
    half of all services and hosts.
    """
    fleet = rows.agg(F.countDistinct("service").alias("s"), F.countDistinct("host").alias("h")).select(F.greatest(F.lit(6.0), 0.5 * (F.col("s") + F.col("h"))).alias("denominator"))
    own = rows.join(members.select("fingerprint", "incident"), "fingerprint")
    peak = own.groupBy("incident", bucket(MINUTE).alias("minute")).agg(F.count("*").alias("n")).groupBy("incident").agg(F.max("n").alias("peak"))
    hosts = own.where(text.present(F.col("host"))).groupBy("incident").agg(F.countDistinct("host").alias("n_hosts"))
    m = members.groupBy("incident").agg(
        F.count("*").alias("members"), F.sum("lines").alias("lines"), F.sum(F.when(severe(), F.col("lines")).otherwise(0)).alias("errors"), F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us"),
        F.max("baseline").alias("baseline"), F.countDistinct("service").alias("n_services"), F.max(F.col("severity") == "CRITICAL").alias("critical"),
    )
    j = m.join(peak, "incident").join(hosts, "incident", "left").crossJoin(F.broadcast(fleet))
    ratio = F.col("peak") / (F.col("baseline") + 1.0)
    raw = {
        "burst": F.round(F.when(ratio > 1, F.least(F.lit(1.0), (ratio - 1) / 9)).otherwise(0.0), 3), "severity": F.col("errors") / F.col("lines"),
        "blast_radius": F.least(F.lit(1.0), (F.col("n_services") + F.coalesce("n_hosts", F.lit(0))) / F.col("denominator")), "duration": F.least(F.lit(1.0), (F.col("end_us") - F.col("start_us")) / 3_600_000_000),
    }
    parts = {k: F.round(WEIGHTS[k] * v, 3) for k, v in raw.items()}
    j = j.select("*", *[v.alias(f"part_{k}") for k, v in parts.items()])
    score = F.round(sum((F.col(f"part_{k}") for k in WEIGHTS), F.lit(0.0)), 3)
    level = F.when((F.col("score") >= 0.6) | F.col("critical"), "critical").when(F.col("score") >= 0.4, "high").when(F.col("score") >= 0.2, "medium").otherwise("low")
    return j.withColumn("score", score).select("incident", "members", "lines", "errors", "start_us", "end_us", "n_services", F.coalesce("n_hosts", F.lit(0)).alias("n_hosts"), "score", level.alias("severity"))


def recoveries(rows: DataFrame, members: DataFrame) -> DataFrame:
    """How each incident ended: ongoing, restart, self_healed or stopped.

    Ongoing: under two quiet minutes at the data's end. Restart: a line that says
    so, of an affected service or host, from the first signal to ten minutes after
    the last ERROR+ line. Self-healed: a line below WARN of one of them after that.
    """
    own = rows.join(members.select("fingerprint", "incident"), "fingerprint")
    t = own.groupBy("incident").agg(F.min("us").alias("first_us"), F.coalesce(F.max(F.when(severe(), F.col("us"))), F.max("us")).alias("last_error_us"))
    end = rows.agg(F.max("us").alias("data_end"))
    names = own.select("incident", F.explode(F.array(F.lower("service"), F.lower("host"))).alias("name")).where("name <> ''").distinct()
    named = rows.select("us", "seq", "message", "severity", F.explode(F.array_distinct(F.array(F.lower("service"), F.lower("host")))).alias("name"))
    sign = (F.col("us") >= F.col("first_us")) & (F.col("us") <= F.col("last_error_us") + 10 * MINUTE) & F.col("message").rlike(RESTART)
    calm = (F.col("us") > F.col("last_error_us")) & (text.rank(F.col("severity")) < 2)
    found = named.join(names, "name").join(t, "incident").groupBy("incident").agg(F.min(F.when(sign, F.col("us"))).alias("restart_us"), F.min(F.when(calm, F.col("us"))).alias("normal_us"))
    j = t.join(found, "incident", "left").crossJoin(F.broadcast(end))
    kind = F.when(F.col("data_end") - F.col("last_error_us") < QUIET_US, "ongoing").when(F.col("restart_us").isNotNull(), "restart").when(F.col("normal_us").isNotNull(), "self_healed").otherwise("stopped")
    return j.select("incident", "first_us", "last_error_us", kind.alias("kind"), F.coalesce("restart_us", "normal_us").alias("recovered_us"))


def noise_funnel(rows: DataFrame, s: DataFrame, members: DataFrame) -> DataFrame:
    """Observations, fingerprints, interesting signals and incidents: what is left at each step."""
    j = judged(s)
    return rows.agg(F.count("*").alias("n")).select(F.lit("raw").alias("step"), "n").unionByName(j.agg(F.count("*").alias("n")).select(F.lit("fingerprints").alias("step"), "n")).unionByName(j.agg(F.count_if("interesting").alias("n")).select(F.lit("meaningful").alias("step"), "n")).unionByName(members.agg(F.countDistinct("incident").alias("n")).select(F.lit("incidents").alias("step"), "n"))


def storm_clusters(cells: DataFrame, dependencies: DataFrame, racks: DataFrame | None = None) -> DataFrame:
    """Hot cells (service, bar) with their cluster: those of neighbouring bars of one service, of a dependency or of a rack belong together.

    `racks` is (service, bar, rack). Cells of a rack are linked to the smallest one
    of their bar, and those of two bars to each other, so a rack isn't paired.
    """
    node = F.concat_ws("@", F.lpad(F.col("bar").cast("string"), 12, "0"), "service")
    c = cells.select("service", "bar", node.alias("node"), F.lower("service").alias("own")).distinct()
    # Cells of a service that follow each other are linked anyway: they are one run, named after its first cell, and runs are the graph's nodes.
    in_order = Window.partitionBy("own").orderBy("bar", "service")
    c = c.withColumn("begins", F.coalesce(F.col("bar") - F.lag("bar").over(in_order) > 1, F.lit(True)).cast("int"))
    c = c.withColumn("k", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    c = graph.written(c.withColumn("run", F.first("node").over(Window.partitionBy("own", "k").orderBy("bar", "service"))).select("service", "bar", "own", "run"))
    near = c.select("run", "own", F.explode(F.array(F.col("bar") - 1, F.col("bar"), F.col("bar") + 1)).alias("bar"))
    at = c.select(F.col("run").alias("b"), F.col("own").alias("other"), "bar")
    either = dependencies.select(F.lower("source").alias("own"), F.lower("target").alias("other")).unionByName(dependencies.select(F.lower("target").alias("own"), F.lower("source").alias("other"))).distinct()
    links = near.join(either, "own").join(graph.shuffled(at), ["bar", "other"]).select(F.col("run").alias("a"), "b")
    if racks is not None:
        stands = graph.shuffled(c).join(racks, ["service", "bar"]).select("run", "bar", "rack")
        heads = graph.written(stands.groupBy("rack", "bar").agg(F.min("run").alias("b")))
        to_head = stands.join(graph.shuffled(heads), ["rack", "bar"]).select(F.col("b").alias("a"), F.col("run").alias("b"))
        links = links.unionByName(to_head).unionByName(heads.select("rack", (F.col("bar") + 1).alias("bar"), F.col("b").alias("a")).join(graph.shuffled(heads), ["rack", "bar"]).select("a", "b"))
    of = graph.components(c.select(F.col("run").alias("node")).distinct(), links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return c.join(of.withColumnRenamed("node", "run"), "run").select("service", "bar", F.col("component").alias("cluster"))


def storm_members(obs: DataFrame, clusters: DataFrame, step_us: int, origin_us: int, pad_us: int = 2 * MINUTE) -> DataFrame:
    """(seq, cluster): observations of a cluster's services from `pad_us` before its first bar to as much after its last; the first cluster wins."""
    span = clusters.groupBy("cluster").agg((F.min("bar") * step_us + origin_us - pad_us).alias("lo"), ((F.max("bar") + 1) * step_us + origin_us + pad_us).alias("hi"))
    wide = clusters.select("cluster", "service").distinct().join(span, "cluster")
    return obs.join(wide, "service").where("us >= lo AND us <= hi").groupBy("seq").agg(F.min("cluster").alias("cluster"))


def elevated(obs: DataFrame, members: DataFrame, spans: DataFrame) -> DataFrame:
    """Members without the pairs of service and alarm type that run at their normal rate inside the cluster.

    A pair stays if it has twice what its overall rate gives for the cluster's
    minutes, and two at least; ERROR+ lines stay too, but for types that are no cause.
    """
    total = obs.agg(F.greatest(F.lit(1.0), (F.max("us") - F.min("us")) / MINUTE).alias("minutes"))
    rate = obs.groupBy("service", "alarm_type").agg(F.count("*").alias("overall"))
    inside = obs.join(graph.shuffled(members), "seq")
    own = inside.groupBy("cluster", "service", "alarm_type").agg(F.count("*").alias("n"))
    j = inside.join(own, ["cluster", "service", "alarm_type"]).join(rate, ["service", "alarm_type"]).join(spans, "cluster").crossJoin(F.broadcast(total))
    expected = F.col("overall") * F.col("span_min") / F.col("minutes")
    return j.where((F.col("n") >= F.greatest(F.lit(2.0), 2 * expected)) | (severe() & (cause_rank(F.col("alarm_type"), 1.0) > 0))).select("seq", "cluster")
