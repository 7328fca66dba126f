"""Storms against one alarm after the other in plain Python."""

import math
import random
import re
import statistics
from collections import Counter, defaultdict

import pytest

from opsloom.operators import storms
from opsloom.operators.correlation import CAUSE_RANK, CAUSE_WORDS
from opsloom.sources.observations import MINUTE

SCHEMA = "seq long, us long, service string, host string, severity string, alarm_type string, message string, rack string"
BAD = ("ERROR", "CRITICAL")


def made(seed):
    """Background noise, three storms, and a slow burn of which other services complain."""
    rnd = random.Random(seed)
    kinds, out = list(CAUSE_RANK), []

    def add(minute, service, host, severity, kind, message):
        us = int(minute * MINUTE) + rnd.randrange(50) * 1_000_000 + 7 * MINUTE
        out.append((len(out), us, service, host, severity, kind, message, f"dc/r{int(host[1:]) % 3}" if host and rnd.random() < 0.9 else None))

    for _ in range(260):
        k = rnd.randrange(9)
        add(rnd.uniform(0, 300), f"s{k}", f"h{k * 2 + rnd.randrange(2)}", rnd.choice(["INFO", "WARN", "ERROR"]), rnd.choice(kinds), "background")
    for at, services in ((40, (0, 1, 2)), (120, (3,)), (200, (4, 5))):
        for _ in range(70):
            k = rnd.choice(services)
            add(at + rnd.uniform(0, 9), f"s{k}", f"h{k * 2 + rnd.randrange(2)}", rnd.choice(["WARN", "ERROR", "CRITICAL"]), rnd.choice(["pkt_loss", "timeout", "disk_full", "cert_expiry"]), f"disk {rnd.randrange(99)} is slow")
    for i in range(14):
        add(235 + i * 3, "s11", f"h{22 + i % 2}", "ERROR", "oom_risk", "heap is short")
        add(235 + i * 3, "s4", "h8", "ERROR", "timeout", "S11 servisine yapilan cagri gecikti")
    for i in range(30):
        add(260 + rnd.uniform(0, 4), None, "h6", "ERROR", None, "link down")
    add(10, None, None, None, None, None)
    return out


DEPENDS = [("s0", "s1"), ("s1", "s2"), ("s5", "s4")]


def plain(alarms):
    rows = sorted(({**dict(zip(SCHEMA.replace(" string", "").replace(" long", "").split(", "), a)), "raw": a} for a in alarms), key=lambda o: (o["us"], o["seq"]))
    for o in rows:
        for c in ("service", "host", "alarm_type", "rack", "message"):
            o[c] = o[c] or ""
    t0 = rows[0]["us"] // MINUTE * MINUTE
    for o in rows:
        o["bar"] = (o["us"] - t0) // (5 * MINUTE)
    bars = rows[-1]["bar"] + 1
    home = {}
    for o in rows:
        if o["host"]:
            home.setdefault(o["host"], o["service"])
    hot = set()
    for kind, least in (("service", 4), ("host", 5)):
        count = defaultdict(Counter)
        for o in rows:
            if o[kind]:
                count[o[kind]][o["bar"]] += 1
        for key, c in count.items():
            limit = max(least, 3 * statistics.median([c[b] for b in range(bars)]))
            service = key if kind == "service" else home[key]
            hot |= {(service, b) for b, n in c.items() if n >= limit and service}
    racks = defaultdict(Counter)
    for o in rows:
        words = any(w in o["message"].lower() for w in storms.INFRASTRUCTURE_WORDS)
        if o["alarm_type"].lower() in storms.INFRASTRUCTURE or (not o["alarm_type"] and words):
            racks[o["service"], o["bar"]][o["rack"]] += 1
    rack = {c: min(n, key=lambda r: (-n[r], r)) for c, n in racks.items()}
    group = {c: c for c in hot}
    changed = True
    while changed:
        changed = False
        for a in hot:
            for b in hot:
                near = abs(a[1] - b[1]) <= 1 and (a[0] == b[0] or (a[0], b[0]) in DEPENDS or (b[0], a[0]) in DEPENDS or (rack.get(a, "") and rack.get(a) == rack.get(b)))
                if near and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    members, span = defaultdict(list), {}
    for first in sorted(set(group.values())):
        cells = [c for c in hot if group[c] == first]
        services = {c[0] for c in cells}
        lo, hi = t0 + min(c[1] for c in cells) * 5 * MINUTE - 2 * MINUTE, t0 + (max(c[1] for c in cells) + 1) * 5 * MINUTE + 2 * MINUTE
        name = f"{first[0]}@{first[1]}"
        taken = {o["seq"] for m in members.values() for o in m}
        members[name] = [o for o in rows if lo <= o["us"] <= hi and o["seq"] not in taken and (o["service"] in services or (o["host"] and home[o["host"]] in services))]
        span[name] = (lo, hi)
    known = {o["service"].lower() for o in rows if o["service"]}

    def blames(o):
        for p in storms.BLAMES:
            m = re.search(p, o["message"], re.I)
            if m and m[1].lower() in known and m[1].lower() != o["service"].lower():
                return m[1].lower()
        return ""

    burns = {}
    for service in sorted({o["service"] for o in rows if o["service"]} - {c[0] for c in hot}):
        chain = []
        for kind in {o["alarm_type"].lower() for o in rows}:
            items = [o for o in rows if o["service"] == service and o["alarm_type"].lower() == kind and o["severity"] in BAD and CAUSE_RANK.get(kind, 0) >= 1.5]
            for o in items:
                ahead = [x for x in items if o["us"] <= x["us"] <= o["us"] + 15 * MINUTE]
                if len(ahead) >= 4 and len({x["host"] for x in ahead}) >= 2:
                    chain += items
                    break
        if chain:
            lo, hi = chain and (min(o["us"] for o in chain) - 2 * MINUTE, max(o["us"] for o in chain) + 12 * MINUTE)
            mine = [o for o in rows if lo <= o["us"] <= hi and (o["service"] == service or blames(o) == service.lower())]
            if len(mine) >= 15:
                burns[f"burn@{service}"] = mine
                span[f"burn@{service}"] = (lo, hi)
    gone = {o["seq"] for m in burns.values() for o in m}
    members = {k: [o for o in m if o["seq"] not in gone] for k, m in members.items()} | burns
    total = max(1.0, (rows[-1]["us"] - rows[0]["us"]) / MINUTE)
    overall = Counter((o["service"], o["alarm_type"]) for o in rows)
    kept = {}
    for name, m in members.items():
        inside = Counter((o["service"], o["alarm_type"]) for o in m)
        minutes = max(1.0, (span[name][1] - span[name][0]) / MINUTE)
        stays = lambda o: inside[o["service"], o["alarm_type"]] >= max(2.0, 2 * overall[o["service"], o["alarm_type"]] * minutes / total) or (o["severity"] in BAD and CAUSE_RANK.get(o["alarm_type"], 1) > 0)
        kept[name] = [o for o in m if stays(o)]
    return rows, hot, members, kept


def score_of(rows, m, critical):
    services, hosts = {o["service"] for o in m} - {""}, {o["host"] for o in m} - {""}
    start, end = m[0]["us"], m[-1]["us"]
    per = Counter((o["service"], o["us"] // MINUTE * MINUTE) for o in rows if o["service"])
    outside = [n for (s, t), n in per.items() if s in services and not start <= t <= end]
    ratio = max(Counter(o["us"] // MINUTE for o in m).values()) / ((statistics.median(outside) if outside else 0) + 1)
    half = max(6.0, 0.5 * (len({o["service"] for o in rows} - {""}) + len({o["host"] for o in rows} - {""})))
    listed = [h for h in hosts if h in critical]
    raw = {"burst": round(min(1.0, (ratio - 1) / 9), 3) if ratio > 1 else 0, "severity": sum(o["severity"] in BAD for o in m) / len(m), "blast_radius": min(1.0, (len(services) + len(hosts)) / half), "duration": min(1.0, (end - start) / 60 / MINUTE), "criticality": sum(critical[h] for h in listed) / len(listed) if listed else 0}
    return round(sum(round(storms.WEIGHTS[k] * v, 3) for k, v in raw.items()), 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_storms_equal_a_sequential_run(spark, seed):
    alarms = made(seed)
    rows, hot, members, kept = plain(alarms)
    df = spark.createDataFrame(alarms, SCHEMA).repartition(3)
    deps = spark.createDataFrame(DEPENDS, "source string, target string")
    at = storms.placed(df)
    assert {(r.service, r.bar) for r in storms.heated(at, storms.homes(at)).collect()} == hot
    got, spans = storms.storms(df, deps)
    found = got.collect()
    assert {(r.seq, r.cluster) for r in found} == {(o["seq"], k) for k, m in members.items() for o in m}
    assert {(r.seq, r.cluster) for r in found if r.kept} == {(o["seq"], k) for k, m in kept.items() for o in m}
    assert "burn@s11" in kept and any(o["service"] == "s4" for o in kept["burn@s11"])
    critical = {f"h{i}": i % 3 == 0 for i in range(0, 20, 2)}
    judged = storms.cards(df, got, spans, spark.createDataFrame(list(critical.items()), "host string, critical boolean"), most=2)
    result = {r.cluster: r for r in judged.collect()}
    expected = {k: score_of(rows, m, critical) for k, m in kept.items() if m}
    assert {k: r.score for k, r in result.items()} == pytest.approx(expected, abs=0.0011)
    small = {k for k, m in kept.items() if m and (len(m) < 15 or sum(o["severity"] in BAD for o in m) < 3)}
    assert {k for k, r in result.items() if r.verdict == "small"} == small
    order = sorted((k for k in result if k not in small), key=lambda k: (-result[k].score, -len(members[k]), k))
    assert [k for k, r in sorted(result.items(), key=lambda x: x[1].place or 99) if r.place] == order[:2]
    outcome = Counter(r.outcome for r in storms.audited(df, got, judged).collect())
    in_any = {o["seq"] for m in kept.values() for o in m}
    assert outcome["baseline"] == len(rows) - len(in_any)
    assert outcome["card"] == sum(len(kept[k]) for k in order[:2])


def test_causes_equal_all_pairs(spark):
    alarms = made(3)
    _, _, _, kept = plain(alarms)
    df, deps = spark.createDataFrame(alarms, SCHEMA), spark.createDataFrame(DEPENDS, "source string, target string")
    got, _ = storms.storms(df, deps)
    found = {(r.cluster, r.service, r.severity, r.kind, r.onset_us, r.lines): (r.fan, r.provider, r.consumer, r.cause_score) for r in storms.causes(df, got, deps).collect()}
    expected = {}
    for cluster, m in kept.items():
        groups = defaultdict(list)
        for o in m:
            groups[re.sub(r"\d+", "<n>", o["message"]), o["severity"], o["service"]].append(o)
        span = max(1, (max(o["us"] for o in m) - min(o["us"] for o in m)) // MINUTE + 1)
        signals = []
        for (template, severity, service), own in groups.items():
            per = Counter(o["us"] // MINUTE * MINUTE for o in own)
            values = sorted(per.values())
            zeros = max(0, span - len(values))
            middle = (len(values) + zeros) // 2
            base = 0 if middle < zeros else values[middle - zeros]
            onset = min(t for t, n in per.items() if n >= max(1, 2 * base) or n == values[-1])
            signals.append({"template": template, "severity": severity, "service": service, "own": own, "onset": onset, "kind": own[0]["alarm_type"], "rack": own[0]["rack"], "hosts": {o["host"] for o in own} - {""}, "entities": ({o["host"] for o in own[:40]} | {service}) - {""}})
        levels = ["DEBUG", "INFO", "WARN", "ERROR", "CRITICAL"]
        earliest = min(signals, key=lambda s: (s["own"][0]["us"], -levels.index(s["severity"])))["onset"]
        cause_onset = min((s["onset"] for s in signals if CAUSE_RANK.get(s["kind"], 0) >= 2), default=None)
        hosts = defaultdict(set)
        for s in signals:
            if s["kind"] in storms.INFRASTRUCTURE and s["kind"] != "ntp_drift" and s["rack"]:
                hosts[s["rack"]] |= s["hosts"]
        top = min(hosts, key=lambda r: (-len(hosts[r]), r), default=None)
        top = top if top and len(hosts[top]) >= storms.RACK_HOSTS else None
        for s in signals:
            others = [x for x in signals if x is not s]
            fan = sum(bool(x["entities"] & s["entities"]) for x in others)
            provider, consumer = sum((x["service"], s["service"]) in DEPENDS for x in others), sum((s["service"], x["service"]) in DEPENDS for x in others)
            cause = CAUSE_RANK.get(s["kind"], 0)
            score = cause * 1.2 + levels.index(s["severity"]) * 0.8 + math.log1p(len(s["own"])) * 0.6 - (s["onset"] - earliest) / MINUTE * 0.4 + 0.5 * any(w in s["template"] for w in CAUSE_WORDS + storms.WORDS)
            score += min(provider, 3) * 0.6 - min(consumer, 3) * 0.6 + fan * 0.05 + (1.5 if cause >= 2 and s["onset"] == cause_onset else 0)
            score += 2.5 if top and s["rack"] == top and s["kind"] in storms.INFRASTRUCTURE and s["kind"] != "ntp_drift" else 0
            expected[cluster, s["service"], s["severity"], s["kind"], s["onset"], len(s["own"])] = (fan, provider, consumer, score)
    assert set(found) == set(expected)
    for k, v in expected.items():
        assert found[k] == pytest.approx(v, abs=0.0051)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    deps = spark.createDataFrame([], "source string, target string")
    got, spans = storms.storms(df, deps)
    judged = storms.cards(df, got, spans)
    assert got.count() == judged.count() == storms.audited(df, got, judged).count() == storms.causes(df, got, deps).count() == 0
