"""Grok packs over lines as programs write them, and OTLP requests with odd contents."""

import json

import pytest
from pyspark.sql import functions as F

from opsloom.sources import grok, otlp

FILES = {
    "rabbit": ["2026-09-22 09:14:02.003 [info] <0.812.0> accepting AMQP connection", "2026-09-22 09:15:03.500 [warning] <0.812.0> closing", "  because of heartbeats", "", "odd line"],
    "bind": ["22-Sep-2026 09:14:02.003 queries: info: client @0x7f3c 10.0.4.12#51422 (shop.example.com): query: shop.example.com IN A + (10.0.9.53)"],
    "docker": ['time="2026-09-22T09:14:02.003+03:00" level=info msg="Starting up"', 'time="2026-09-22T09:15:03.500+03:00" level=error msg="no image" x'],
    "esxi": ["2026-09-22T06:14:02.003Z info hostd[2099001] [Originator@6876 sub=Vimsvc] Event 4412"],
    "wall": ["Sep 22 09:15:10 fw-ist-03 kernel: [812231.112] [UFW BLOCK] IN=eth0 OUT= MAC=00:11 SRC=192.168.7.4 DST=10.0.4.30 LEN=60"],
    "web": ['10.0.0.1 - anna [22/Sep/2026:09:14:02 +0300] "GET /a HTTP/1.1" 404 12 "-" "curl/8"', '10.0.0.1 - - [22/Sep/2026:09:14:02 +0300] "GET /b HTTP/1.1" 502 - "-" "x y"'],
    "prose": ["nothing", "that any", "pack reads"],
}


def test_packs_read_their_files(spark):
    lines = spark.createDataFrame([(f, i, x) for f, ls in FILES.items() for i, x in enumerate(ls, 1)], "file string, line_no long, line string").repartition(3)
    packs = {r.file: (r.pack, r.share) for r in grok.detect(lines).collect()}
    # Of packs that fit alike, the first one named counts: COMMONAPACHELOG before COMBINEDAPACHELOG, SYSLOGLINE before IPTABLES.
    # Half of the broker's lines fit, which is too few.
    assert {k: v[0] for k, v in packs.items()} == {"bind": "BIND9_QUERY", "docker": "DOCKER_DAEMON", "esxi": "VMWARE_ESXI", "wall": "SYSLOGLINE", "web": "COMMONAPACHELOG"}
    rows = {(r.file, r.line_no): r for r in grok.parse(lines).collect()}
    web = rows["web", 1]
    assert (web.severity, web.message, web.service, web.attributes["verb"], web.attributes["auth"]) == ("WARN", "/a", "http", "GET", "anna") and rows["web", 2].severity == "ERROR" and "bytes" not in rows["web", 2].attributes
    assert (rows["bind", 1].message, rows["bind", 1].severity, rows["bind", 1].attributes["clientip"]) == ("shop.example.com", "info", "10.0.4.12")
    assert (rows["esxi", 1].service, rows["esxi", 1].attributes["context"]) == ("hostd", "2099001")
    assert (rows["wall", 1].host, rows["wall", 1].service) == ("fw-ist-03", "kernel")
    assert not [k for k in rows if k[0] == "prose"] and grok.parse(lines.limit(0)).count() == 0


def test_continued_lines_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(grok, "BLOCK", 2)
    body = ["2026-09-22 09:14:02 [info] <1> a", " b", " c", " d", "odd", "2026-09-22 09:14:02 [info] <1> e"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate([*body, *body[:1] * 20], 1)], "file string, line_no long, line string")
    got = {r.line_no: (r.message, r.lines) for r in grok.parse(lines).collect()}
    assert got[1] == ("a\nb\nc\nd", 4) and got[5] == ("odd", 1) and got[6] == ("e", 1)
    marks = grok.last_so_far(lines, "file", "line_no", F.when(F.col("line_no") == 2, 7), "mark", 3).orderBy("line_no").collect()
    assert [r.mark for r in marks] == [None] + [7] * 25


def test_patterns_are_checked():
    assert grok.expand("%{A:x}-%{B}", {"A": "%{B}+", "B": "b"}).fields == ("x",)
    for bad in ({"A": "%{B}", "B": "%{A}"}, {"A": "%{NONE}"}, {f"A{i}" if i else "A": f"%{{A{i + 1}}}" for i in range(30)}):
        with pytest.raises(ValueError):
            grok.expand("%{A}", bad)
    for risky in ("(a+)+b", "x" * 5000):
        with pytest.raises(ValueError):
            grok.checked(risky)
    for p in grok.PACKS:
        assert set(p.roles.values()) <= set(grok.expand(p.pattern).fields)


def test_otlp_with_odd_contents(spark):
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    log = {"resourceLogs": [{"resource": {"attributes": [text("service.name", "s"), text("a", "1"), text("a", "2")]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "0", "observedTimeUnixNano": "1700000000000000999", "severityNumber": 22, "body": {"intValue": "7"}, "attributes": [text("a", "3")]}, {}]}, {}]}, {}]}
    df = spark.createDataFrame([("1", json.dumps(log)), ("2", "{broken"), ("3", None), ("4", "{}")], "id string, body string")
    rows = sorted(otlp.log_records(df).collect(), key=lambda r: r.us is None)
    assert (rows[0].us, rows[0].severity, rows[0].service, rows[0].message, rows[0].attributes) == (1700000000000000, "CRITICAL", "s", "7", {"service.name": "s", "a": "3"})
    assert len(rows) == 2 and (rows[1].us, rows[1].severity, rows[1].message) == (None, "INFO", "")
    point = lambda t, v, start=0: {"timeUnixNano": f"{t}000000", "startTimeUnixNano": f"{start}000000", "asInt": str(v)}
    points = [point(1000, 5), point(2000, 9), point(3000, 2, 2500), point(4000, 2, 2500), point(4000, 3, 2500), point(5000, 1, 2500)]
    metric = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "sum": {"isMonotonic": True, "aggregationTemporality": "AGGREGATION_TEMPORALITY_CUMULATIVE", "dataPoints": points}}, {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "1000000", "asDouble": 1.5}]}}]}]}]}
    got = otlp.metric_points(spark.createDataFrame([("1", json.dumps(metric))], "id string, body string"))
    assert {(r.metric, r.cumulative) for r in got.collect()} == {("m", True), ("g", False)}
    assert [r.gain for r in otlp.counter_deltas(got).orderBy("us").collect()] == [4.0, 2.0, 1.0, 1.0]
    assert otlp.spans(df).count() == 0
