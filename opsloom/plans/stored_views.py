"""Queries served from stored counters, and the error map."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import impact
from ..operators.graph import shared_folder
from ..sources.observations import MINUTE, from_events
from ..streaming import stored
from .catalog import BOUNDS, DAY, END, OBS, START, query
from .incident_views import ALARMS, alarms_of, dependencies_of


def store_of(spark, sf_dir) -> str:
    """The event table stored in four batches, the second of which comes twice, with a generation made in between."""
    path = f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}"
    obs = from_events(spark, sf_dir)
    for batch, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        stored.add_batch(obs.where(F.col("seq") % 4 == part), batch, path)
    stored.compact(spark, path, END)
    stored.add_batch(obs.where(F.col("seq") % 4 == 3), 3, path)
    return path


@query(f"WITH {OBS} SELECT us // {MINUTE} AS minute, environment, host, service, count(*) AS lines, count(*) FILTER (bad) AS errors FROM o WHERE us >= {START + 3 * DAY} AND us < {START + 20 * DAY} GROUP BY 1, 2, 3, 4")
def stored_counters(spark, sf_dir):
    """Minutes of a span of days out of the stored counters."""
    return stored.read_counters(spark, store_of(spark, sf_dir), START + 3 * DAY, START + 20 * DAY).drop("h")


@query(f"""WITH {OBS}, {BOUNDS}, v AS (SELECT environment, host, bad, len(list_filter([1,2,5,10,20,50,100,200,300,500,750,1000,1500,2000,3000,5000,7500,10000,20000,30000,60000,120000], lambda x: x < ms)) AS i FROM o),
c AS (SELECT environment, host, i, count(*) AS n FROM v GROUP BY 1, 2, 3), r AS (SELECT c.*, sum(n) OVER w - n AS below, sum(n) OVER (PARTITION BY environment, host) * 0.95 AS want FROM c WINDOW w AS (PARTITION BY environment, host ORDER BY i)),
q AS (SELECT environment, host, round(lo + (hi - lo) * ((want - below) / n), 6) AS p95_ms FROM r JOIN b USING (i) WHERE below < want AND below + n >= want)
SELECT environment, host, count(*) AS lines, count(*) FILTER (bad) AS errors, round(count(*) FILTER (bad) / count(*), 5) AS error_rate, any_value(p95_ms) AS p95_ms FROM o JOIN q USING (environment, host) GROUP BY 1, 2""")
def stored_host_table(spark, sf_dir):
    """The table of hosts from stored counters."""
    return stored.host_figures(stored.read_counters(spark, store_of(spark, sf_dir)))


_GRAPH = f"{ALARMS}, rt AS (SELECT service FROM rw WHERE severity = 'CRITICAL' GROUP BY 1 ORDER BY count(*) DESC, service LIMIT 3), af AS (SELECT DISTINCT service FROM rw WHERE bad AND seq % 7 = 0), d2 AS (SELECT * FROM dep UNION SELECT 'svc-' || i, 'svc-' || (i + 1) FROM range(0, 20) t(i) WHERE i % 3 <> 2 UNION SELECT 'svc-3', 'svc-1')"


def graph_of(spark, sf_dir):
    """Alarms, the services with most critical ones as roots, those hit in the busy day, and dependencies with a circle."""
    a = alarms_of(spark, sf_dir)
    roots = a.where("severity = 'CRITICAL'").groupBy("service").count().orderBy(F.desc("count"), "service").limit(3).select("service")
    hit = a.where(F.col("severity").isin("ERROR", "CRITICAL") & (F.col("seq") % 7 == 0)).select("service").distinct()
    i = F.col("id")
    row = spark.range(20).where(i % 3 != 2).select(F.concat(F.lit("svc-"), i).alias("source"), F.concat(F.lit("svc-"), i + 1).alias("target"))
    deps = dependencies_of(spark).unionByName(row).unionByName(spark.range(1).select(F.lit("svc-3").alias("source"), F.lit("svc-1").alias("target"))).distinct()
    return a, roots, hit, deps


@query(f"WITH RECURSIVE {_GRAPH}, w(root, node, distance) AS (SELECT service, service, 0 FROM rt UNION SELECT w.root, d2.source, w.distance + 1 FROM w JOIN d2 ON d2.target = w.node WHERE distance < 12), n AS (SELECT root, node, min(distance) AS distance FROM w GROUP BY 1, 2) SELECT n.root, n.node, n.distance, (SELECT min(p.node) FROM n p JOIN d2 ON d2.target = p.node AND d2.source = n.node WHERE p.root = n.root AND p.distance = n.distance - 1) AS via FROM n")
def impact_reach(spark, sf_dir):
    """What each root cause reaches, how far off and over which service."""
    _, roots, _, deps = graph_of(spark, sf_dir)
    return impact.reached(roots.select(F.col("service").alias("root")), deps)


@query(f"WITH {_GRAPH}, er AS (SELECT service, count(*) AS errors, count(DISTINCT host) AS hosts FROM rw WHERE bad GROUP BY 1), kn AS (SELECT service FROM rt UNION SELECT service FROM af UNION SELECT source FROM d2 UNION SELECT target FROM d2) SELECT service, CASE WHEN service IN (SELECT service FROM rt) THEN 'root' WHEN service IN (SELECT service FROM af) THEN 'affected' WHEN errors > 0 THEN 'erroring' ELSE 'clean' END AS kind, coalesce(errors, 0) AS errors, coalesce(hosts, 0) AS hosts FROM kn LEFT JOIN er USING (service)")
def error_map(spark, sf_dir):
    """Services on the error map by their part."""
    return impact.error_map(*graph_of(spark, sf_dir))
