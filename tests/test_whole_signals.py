"""Entities come from all observations of a signal: what only its late ones name links, counts and ranks too."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opsloom.operators import correlation, storms
from opsloom.plans import incident_views, queries
from opsloom.sources.observations import MINUTE

SCHEMA = "seq long, us long, service string, host string, severity string, alarm_type string, message string"
#: 45 refused calls of `web`, each to another address; `shop` complains of the last one, and is calm later.
ROWS = [(k, k * 1000, "web", "h1", "ERROR", "conn_refused", f"call to 10.0.0.{k} refused") for k in range(45)]
ROWS += [(45, 2 * MINUTE, "shop", "h2", "ERROR", "timeout", "10.0.0.44 is slow"), (46, 20 * MINUTE, "shop", "h2", "INFO", "", "order served")]


@pytest.fixture
def late(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    monkeypatch.setattr(incident_views, "alarms_of", lambda spark, sf_dir: df)
    return df


def test_an_incident_of_late_names_recovers_once(spark, late):
    rows = queries()["incident_recoveries"](spark, "").collect()
    assert [(r.first_us, r.last_error_us, r.kind, r.recovered_us) for r in rows] == [(0, 2 * MINUTE, "self_healed", 20 * MINUTE)]


def test_the_funnel_counts_incidents_of_late_names(spark, late):
    assert {r.step: r.n for r in queries()["noise_funnel"](spark, "").collect()} == {"raw": 47, "fingerprints": 3, "meaningful": 2, "incidents": 1}


def test_late_names_are_shared_with_causes(spark, late):
    rows = queries()["root_causes"](spark, "").collect()
    assert len({r.incident for r in rows}) == 1 and [(r.place, r.fan) for r in sorted(rows, key=lambda r: r.place)] == [(1, 1), (2, 1)]


def test_late_names_are_shared_with_causes_of_storms(spark):
    df = spark.createDataFrame([(*r, "") for r in ROWS], SCHEMA + ", rack string")
    members = df.selectExpr("seq", "'c' AS cluster", "true AS kept")
    rows = storms.causes(df, members, spark.createDataFrame([], "source string, target string")).collect()
    assert {(r.service, r.severity): r.fan for r in rows} == {("web", "ERROR"): 1, ("shop", "ERROR"): 2, ("shop", "INFO"): 1}


@pytest.mark.parametrize("collide", [False, True])
def test_fans_equal_all_pairs(spark, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(correlation.F, "xxhash64", lambda c: F.length(c).cast("bigint"))
    rng = random.Random(5)
    has = {}
    for s in range(60):
        has[f"g{s % 2}", f"s{s}"] = {f"e{rng.randrange(40)}" for _ in range(rng.randrange(1, 5))}
    for s in range(60, 90):
        has[f"g{s % 2}", f"s{s}"] = set(rng.choice([e for (g, _), e in has.items() if g == f"g{s % 2}"]))
    for g in ("g0", "g1"):
        has[g, f"{g}-many"] = {f"e{k}" for k in range(300)}
    df = spark.createDataFrame([(g, s, e) for (g, s), es in has.items() for e in es], "g string, fingerprint string, entity string")
    want = {s: sum(bool(es & others) for (h, t), others in has.items() if h == g and t != s) for (g, s), es in has.items()}
    got = correlation.shared_fan(df, "g")
    assert {r.fingerprint: r.fan for r in got.collect()} == want and "collect_" not in got._jdf.queryExecution().toString()


def test_lines_without_a_message_keep_service_and_host(spark):
    rows = correlation.fingerprinted(spark.createDataFrame([(1, 0, "Web", "h1", "ERROR", "", None), (2, 1, "web", "", "ERROR", "", None)], SCHEMA))
    assert sorted(r.entity for r in correlation.signal_entities(rows).collect()) == ["h1", "web"]


def test_texts_passed_over_name_nothing(spark):
    texts = ["slow disk write on order 12", "Web-API at 10.0.0.1", "a.b", "x-1", "-", ".", "", None, "db1.local-", "order_svc", "my-db;SVC-7"]
    df = spark.createDataFrame([(t,) for t in texts], "m string").select("m", correlation.entities(F.col("m")).alias("e"))
    found = {r.m: r.e for r in df.collect()}
    assert found == {t: None if t is None else list(dict.fromkeys(x.lower() for x in re.findall(correlation.ENTITY, t))) for t in texts}
