"""Hosts, services and status of applications on rows made by hand."""

import pytest

from opsloom.operators import apps

MIN = 60_000_000
NOW = 1000 * MIN
START = NOW - 60 * MIN


@pytest.fixture(scope="module")
def obs(spark):
    rows = [("A", "web", NOW - MIN, "INFO")] * 30 + [("a", "web", NOW - 2 * MIN, "ERROR"), ("b", "db", START - MIN, "INFO"), ("c", "shop-x", NOW - MIN, "INFO"), (None, "shop-y", NOW - MIN, "ERROR"), ("b", None, START - MIN, "INFO"), ("b", "db", NOW + MIN, "ERROR"), ("e", "web", NOW - MIN, "INFO")]
    return spark.createDataFrame(rows, "host string, service string, us long, severity string")


@pytest.fixture(scope="module")
def members(spark):
    rows = [("one", "host", "a"), ("one", "host", "A"), ("one", "host", "B"), ("one", "host", None), ("one", "service", "shop-*"), ("two", "host", "b"), ("three", "host", "zz"), ("four", "service", "none.*"), ("five", "host", "e")]
    return spark.createDataFrame(rows, "app string, kind string, name string")


@pytest.fixture(scope="module")
def alarms(spark):
    return spark.createDataFrame([("A", "warn"), ("a", "crit"), ("e", "anomaly"), ("q", "crit")], "host string, level string")


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame([("a", "api", NOW - MIN, True), ("x", "shop-x", NOW - MIN, False), ("a", "api", NOW, True), ("x", "api", NOW - MIN, True)], "host string, service string, start_us long, error boolean")


def test_hosts(obs, members, alarms):
    got = {(r["app"], r["host"]): (r["lines"], r["errors"], r["state"], r["level"], r["error_rate"]) for r in apps.host_rows(obs, members, alarms, START, NOW).collect()}
    assert got == {
        ("one", "a"): (31, 1, "reporting", "crit", 0.03226),
        ("one", "b"): (0, 0, "silent", "ok", None),
        ("two", "b"): (0, 0, "silent", "ok", None),
        ("three", "zz"): (0, 0, "unknown", "ok", None),
        ("five", "e"): (1, 0, "reporting", "ok", 0.0),
    }


def test_services_by_lines_and_calls(obs, members, spans):
    got = {(r["app"], r["service"]): (r["member"], r["lines"], r["errors"], r["calls"], r["call_errors"]) for r in apps.service_rows(obs, spans, members, START, NOW).collect()}
    assert got == {
        ("one", "web"): (False, 31, 1, 0, 0),
        ("one", "shop-x"): (True, 1, 0, 1, 0),
        ("one", "shop-y"): (True, 1, 1, 0, 0),
        ("one", "api"): (False, 0, 0, 1, 1),
        ("five", "web"): (False, 1, 0, 0, 0),
    }


def test_status_and_reasons(spark, obs, members, alarms, spans):
    targets = spark.createDataFrame([("one", 99.0), ("five", None)], "app string, availability double")
    hosts, services = apps.host_rows(obs, members, alarms, START, NOW), apps.service_rows(obs, spans, members, START, NOW)
    got = {r["app"]: (r["status"], r["reasons"], r["availability"]) for r in apps.health(members, hosts, services, targets).collect()}
    assert got == {
        "one": ("crit", "slo_breach,thr_crit,thr_warn,silent,errors_high", 0.5),
        "two": ("crit", "all_silent", None),
        "three": ("nodata", "", None),
        "four": ("nodata", "", None),
        "five": ("warn", "anomaly", 1.0),
    }
    calm = apps.health(members, apps.host_rows(obs, members, alarms.limit(0), START, NOW), services, targets.limit(0))
    assert {r["app"]: r["status"] for r in calm.collect()}["five"] == "ok"


def test_empty_tables(obs, members, alarms, spans):
    assert apps.host_rows(obs, members.limit(0), alarms, START, NOW).count() == 0
    assert apps.service_rows(obs.limit(0), spans.limit(0), members, START, NOW).count() == 0
    assert {r["state"] for r in apps.host_rows(obs.limit(0), members, alarms, START, NOW).collect()} == {"unknown"}


def test_events_once_for_each_application(spark, members):
    rows = [("A", "shop-x", 0, 5, True, 1), ("a", None, START, START, False, 2), (None, "shop-y", 0, START - 1, False, 3), (None, "SHOP-y", 0, START, False, 4), ("b", "db", NOW, NOW, True, 5), (None, None, 0, NOW, True, 6), ("b", "db", 0, NOW, False, 7)]
    anomalies = spark.createDataFrame(rows, "host string, service string, first_us long, last_us long, open boolean, id long")
    got = sorted((r["app"], r["id"]) for r in apps.events_of(anomalies, members, START, NOW).collect())
    assert got == [("one", 1), ("one", 2), ("one", 4), ("one", 7), ("two", 7)]
