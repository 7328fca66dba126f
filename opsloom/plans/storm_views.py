"""Queries of alarm storms as a whole, each with its SQL.

Orders stand for alarms of forty services on 120 hosts in five racks: every seventh
inside one day, the rest over a month, and those of one service every hundred
seconds, which never heats a bar but escalates. Every eleventh blames a service.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlation, storms
from ..sources.observations import MINUTE, table
from .catalog import START, query
from .incident_views import dependencies_of

_KINDS = tuple(correlation.CAUSE_RANK)
_LIST = "['" + "', '".join(_KINDS) + "']"
_RANKS = ", ".join(f"('{k}', {v})" for k, v in correlation.CAUSE_RANK.items())
_STEP = 5 * MINUTE

ALARMS = f"""sa AS (SELECT o_orderkey AS seq, {START} + 1000000 * CASE WHEN o_orderkey % 40 = 39 THEN o_orderkey * 5 // 2 WHEN o_orderkey % 7 = 0 THEN 864000 + (o_orderkey % 40) * 400 + o_custkey % 900 ELSE (o_orderkey * 7919) % 2592000 END AS us, 'svc-' || (o_orderkey % 40) AS service, 'host-' || (o_orderkey % 120) AS host,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'ERROR' WHEN '3' THEN 'WARN' WHEN '4' THEN 'INFO' ELSE 'DEBUG' END AS severity, CASE WHEN o_orderkey % 40 = 39 THEN 'oom_risk' ELSE {_LIST}[o_custkey % {len(_KINDS)} + 1] END AS alarm_type,
  CASE WHEN o_orderkey % 11 = 0 THEN 'svc-' || (o_orderkey * 3 % 40) || ' servisine yapilan cagri ' || o_orderkey ELSE 'alarm ' || o_orderkey END AS message, 'dc/r' || (o_orderkey % 5) AS rack FROM orders),
dep AS (SELECT 'svc-' || i AS source, 'svc-' || (i * 3 % 40) AS target FROM range(0, 40, 5) t(i) WHERE i <> i * 3 % 40), cr(alarm_type, cause) AS (VALUES {_RANKS})"""

CELLS = f"""{ALARMS}, t AS (SELECT min(us) // {MINUTE} * {MINUTE} AS t0, max(us) AS te FROM sa), ap AS (SELECT sa.*, t0, (us - t0) // {_STEP} AS bar, (te - t0) // {_STEP} + 1 AS bars, severity IN ('ERROR', 'CRITICAL') AS bad, cause FROM sa JOIN cr USING (alarm_type), t),
ho AS (SELECT host, arg_min(service, {{'a': us, 'b': seq}}) AS home FROM ap GROUP BY 1), n AS (SELECT 'service' AS kind, service AS key, bar, any_value(bars) AS b, count(*) AS n FROM ap GROUP BY 2, 3 UNION ALL SELECT 'host', host, bar, any_value(bars), count(*) FROM ap GROUP BY 2, 3),
md AS (SELECT kind, key, list_sort(list(n)) AS c, any_value(b) - count(*) AS zeros, any_value(b) AS b FROM n GROUP BY 1, 2), mv AS (SELECT kind, key, CASE WHEN b // 2 < zeros THEN 0 ELSE c[b // 2 - zeros + 1] END AS hi, CASE WHEN b // 2 - 1 < zeros THEN 0 ELSE c[b // 2 - zeros] END AS lo, b FROM md),
lm AS (SELECT kind, key, CASE WHEN b % 2 = 1 THEN CAST(hi AS DOUBLE) ELSE (hi + lo) / 2.0 END AS median FROM mv), lx AS (SELECT *, greatest(CASE kind WHEN 'host' THEN 5.0 ELSE 4.0 END, 3 * median) AS threshold FROM lm),
hc AS (SELECT CASE kind WHEN 'service' THEN key ELSE home END AS service, bar, kind, key, n, median, threshold FROM n JOIN lx USING (kind, key) LEFT JOIN ho ON kind = 'host' AND host = key WHERE n >= threshold QUALIFY row_number() OVER (PARTITION BY CASE kind WHEN 'service' THEN key ELSE home END, bar ORDER BY kind = 'host', key) = 1)"""

MEMBERS = f"""{CELLS}, rk AS (SELECT service, bar, rack FROM ap JOIN hc USING (service, bar) WHERE alarm_type IN ('network_down', 'network_flap', 'pkt_loss', 'ntp_drift') GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY service, bar ORDER BY count(*) DESC, rack) = 1),
ce AS (SELECT service, bar, rack FROM hc LEFT JOIN rk USING (service, bar)), ad AS (SELECT x.service AS s1, x.bar AS b1, y.service AS s2, y.bar AS b2 FROM ce x JOIN ce y ON abs(x.bar - y.bar) <= 1 AND (x.service = y.service OR x.rack = y.rack OR EXISTS (SELECT 1 FROM dep WHERE (source = x.service AND target = y.service) OR (source = y.service AND target = x.service)))),
re(s, b, fs, fb) AS (SELECT service, bar, service, bar FROM hc UNION SELECT s2, b2, fs, fb FROM re JOIN ad ON s1 = s AND b1 = b), fi AS (SELECT s AS service, b AS bar, min({{'s': fs, 'b': fb}}) AS f FROM re GROUP BY 1, 2), cu AS (SELECT service, bar, f, f.s || '@' || f.b AS cluster FROM fi),
sp AS (SELECT cluster, any_value(f) AS f, (SELECT t0 FROM t) + min(bar) * {_STEP} - {2 * MINUTE} AS lo, (SELECT t0 FROM t) + (max(bar) + 1) * {_STEP} + {2 * MINUTE} AS hi FROM cu GROUP BY 1), cs AS (SELECT DISTINCT cluster, service AS cs FROM cu),
cm AS (SELECT seq, arg_min(cluster, f) AS cluster FROM ap JOIN ho USING (host) JOIN (SELECT * FROM cs JOIN sp USING (cluster)) ON us BETWEEN lo AND hi AND (service = cs OR home = cs) GROUP BY 1),
ba AS (SELECT * FROM ap WHERE bad AND cause >= 1.5 AND service NOT IN (SELECT service FROM cu)), op AS (SELECT DISTINCT x.service, x.alarm_type FROM ba x JOIN ba y ON x.service = y.service AND x.alarm_type = y.alarm_type AND y.us BETWEEN x.us AND x.us + {15 * MINUTE} GROUP BY x.seq, x.service, x.alarm_type HAVING count(*) >= 4 AND count(DISTINCT y.host) >= 2),
ch AS (SELECT 'burn@' || service AS cluster, service AS own, min(us) - {2 * MINUTE} AS lo, max(us) + {12 * MINUTE} AS hi FROM ba JOIN op USING (service, alarm_type) GROUP BY 1, 2), bl AS (SELECT *, regexp_extract(message, '(svc-[0-9]+) servisine', 1) AS blames FROM ap),
bm AS (SELECT seq, cluster FROM bl JOIN ch ON us BETWEEN lo AND hi AND (service = own OR (blames = own AND blames <> service)) QUALIFY count(*) OVER (PARTITION BY cluster) >= 15),
mm AS (SELECT seq, cluster FROM cm WHERE seq NOT IN (SELECT seq FROM bm) UNION ALL SELECT seq, cluster FROM bm), sz AS (SELECT cluster, lo, hi FROM sp UNION ALL SELECT cluster, lo, hi FROM ch), ov AS (SELECT service, alarm_type, count(*) AS overall FROM ap GROUP BY 1, 2), tm AS (SELECT greatest(1.0, (max(us) - min(us)) / {MINUTE}) AS minutes FROM ap),
kp AS (SELECT seq, cluster, count(*) OVER (PARTITION BY cluster, service, alarm_type) >= greatest(2.0, 2 * overall * greatest(1.0, (hi - lo) / {MINUTE}) / minutes) OR (bad AND cause > 0) AS kept FROM mm JOIN ap USING (seq) JOIN ov USING (service, alarm_type) JOIN sz USING (cluster), tm)"""

CARDS = f"""{MEMBERS}, rw AS (SELECT ap.*, cluster FROM kp JOIN ap USING (seq) WHERE kept), pk AS (SELECT cluster, max(n) AS peak FROM (SELECT cluster, us // {MINUTE}, count(*) AS n FROM rw GROUP BY 1, 2) GROUP BY 1), wh AS (SELECT cluster, count(*) AS alarms, count(*) FILTER (bad) AS errors, count(DISTINCT service) AS n_services, count(DISTINCT host) AS n_hosts, min(us) AS start_us, max(us) AS end_us, bool_or(severity = 'CRITICAL') AS worst FROM rw GROUP BY 1),
pm AS (SELECT service, us // {MINUTE} * {MINUTE} AS minute, count(*) AS n FROM ap GROUP BY 1, 2), bs AS (SELECT cluster, median(n) AS base FROM (SELECT DISTINCT cluster, service FROM rw) JOIN wh USING (cluster) JOIN pm USING (service) WHERE NOT minute BETWEEN start_us AND end_us GROUP BY 1),
fl AS (SELECT greatest(6.0, 0.5 * (count(DISTINCT service) + count(DISTINCT host))) AS half FROM ap), cz AS (SELECT cluster, count(*) AS claimed FROM mm GROUP BY 1),
cj AS (SELECT wh.*, coalesce(base, 0.0) AS base, claimed, round(0.30 * round(greatest(0.0, least(1.0, (peak / (coalesce(base, 0.0) + 1) - 1) / 9)), 3), 3) + round(0.20 * errors / alarms, 3) + round(0.20 * least(1.0, (n_services + n_hosts) / half), 3) + round(0.15 * least(1.0, (end_us - start_us) / {60.0 * MINUTE}), 3) AS raw FROM wh JOIN pk USING (cluster) JOIN cz USING (cluster) LEFT JOIN bs USING (cluster), fl),
sc AS (SELECT *, round(raw, 3) AS score, alarms < 15 OR errors < 3 AS small FROM cj), pl AS (SELECT *, row_number() OVER (PARTITION BY small ORDER BY score DESC, claimed DESC, cluster) AS at_place FROM sc),
cd AS (SELECT cluster, alarms, errors, n_services, n_hosts, start_us, end_us, base, score, CASE WHEN score >= 0.6 OR worst THEN 'critical' WHEN score >= 0.4 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS severity, claimed, CASE WHEN NOT small AND at_place <= 15 THEN at_place END AS place, CASE WHEN small THEN 'small' WHEN at_place <= 15 THEN 'card' ELSE 'demoted' END AS verdict FROM pl)"""


def alarms_of(spark, sf_dir) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    burning = key % 40 == 39
    second = F.when(burning, F.floor(key * 5 / 2)).when(key % 7 == 0, 864_000 + (key % 40) * 400 + cust % 900).otherwise((key * 7919) % 2_592_000)
    level = F.substring("o_orderpriority", 1, 1)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (cust % len(_KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("seq"), (F.lit(START) + second * 1_000_000).alias("us"), F.concat(F.lit("svc-"), key % 40).alias("service"), F.concat(F.lit("host-"), key % 120).alias("host"),
        F.when(level == "1", "CRITICAL").when(level == "2", "ERROR").when(level == "3", "WARN").when(level == "4", "INFO").otherwise("DEBUG").alias("severity"),
        F.when(burning, "oom_risk").otherwise(kind).alias("alarm_type"),
        F.when(key % 11 == 0, F.concat(F.lit("svc-"), key * 3 % 40, F.lit(" servisine yapilan cagri "), key)).otherwise(F.concat(F.lit("alarm "), key)).alias("message"),
        F.concat(F.lit("dc/r"), key % 5).alias("rack"),
    )


@query(f"WITH {CELLS} SELECT service, bar, kind, key, n, median, threshold FROM hc")
def storm_cells(spark, sf_dir):
    """Hot cells of services, by their own count or by one of their hosts."""
    at = storms.placed(alarms_of(spark, sf_dir))
    return storms.heated(at, storms.homes(at))


@query(f"WITH RECURSIVE {MEMBERS} SELECT seq, cluster, kept FROM kp")
def storm_claims(spark, sf_dir):
    """Alarms with their cluster or slow burn, and whether they stay in it."""
    return storms.storms(alarms_of(spark, sf_dir), dependencies_of(spark))[0]


@query(f"WITH RECURSIVE {CARDS} SELECT * FROM cd")
def storm_cards(spark, sf_dir):
    """Clusters with their score and place: cards, demoted and small ones."""
    alarms = alarms_of(spark, sf_dir)
    return storms.cards(alarms, *storms.storms(alarms, dependencies_of(spark)))


@query(f"WITH RECURSIVE {CARDS} SELECT sa.seq, x.cluster, coalesce(x.verdict, 'baseline') AS outcome FROM sa LEFT JOIN (SELECT seq, cluster, verdict FROM kp JOIN cd USING (cluster) WHERE kept) x USING (seq)")
def storm_audit(spark, sf_dir):
    """What became of every alarm."""
    alarms = alarms_of(spark, sf_dir)
    members, spans = storms.storms(alarms, dependencies_of(spark))
    return storms.audited(alarms, members, storms.cards(alarms, members, spans))


@query()
def storm_causes(spark, sf_dir):
    """Signals of each cluster, ranked as its cause."""
    alarms, dependencies = alarms_of(spark, sf_dir), dependencies_of(spark)
    return storms.causes(alarms, storms.storms(alarms, dependencies)[0], dependencies)
