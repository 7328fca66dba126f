"""Template mining, threshold states, anomaly lives and learning, against plain loops, and the same over streams."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from opsloom.functions import text
from opsloom.operators import folds, learning, mining, states
from opsloom.sources.observations import MINUTE

BASE = 1_704_067_200_000_000  # a Monday


def sequential(messages):
    """The miner, one line after the other, with the tree written out."""
    root, memory, order = {}, {}, []
    for tokens in messages:
        if tuple(tokens) in memory:
            memory[tuple(tokens)]["lines"] += 1
            continue
        node = root
        for key in (str(len(tokens)), "*" if tokens[0] == "<*>" else tokens[0]):
            if key not in node and len(node) >= mining.CHILDREN:
                key = "*"
            node = node.setdefault(key, {})
        leaf = node.setdefault("clusters", [])
        best, most = None, 0
        for c in leaf:
            if len(c["tokens"]) == len(tokens):
                n = sum(a == b or "<*>" in (a, b) for a, b in zip(c["tokens"], tokens))
                if n > most:
                    best, most = c, n
        if best is None or most / len(tokens) < 0.5:
            best = {"tokens": list(tokens), "lines": 0}
            leaf.append(best)
            order.append(best)
        best["tokens"] = [a if a == b else "<*>" for a, b in zip(best["tokens"], tokens)]
        best["lines"] += 1
        memory[tuple(tokens)] = best
    return sorted((" ".join(c["tokens"]), c["lines"]) for c in order)


@pytest.mark.parametrize("children", [100, 3])
def test_templates_equal_a_sequential_miner(spark, monkeypatch, children):
    monkeypatch.setattr(mining, "CHILDREN", children)
    rnd = random.Random(4)
    words = ["login", "logout", "error", "open", "close", "disk", "node", "alpha", "beta", "gamma"]
    lines = [" ".join([rnd.choice(words), *(rnd.choice([*words, str(rnd.randrange(999)), f"user={rnd.choice(words)}", "10.0.0.7"]) for _ in range(rnd.randrange(0, 6)))]) for _ in range(600)] + ["", "  ", None, "17 ms"]
    df = spark.createDataFrame([(m, BASE + i // 2, i) for i, m in enumerate(lines)], "message string, us long, seq long")
    tokens = [r.t for r in df.orderBy("us", "seq").select(mining.shape(F.col("message")).alias("t")).collect()]
    found = mining.mine(df.repartition(5))
    assert sorted((r.template, r.lines) for r in found.collect()) == sequential(tokens)
    assert mining.stats(found).first().lines == len(lines)
    parts = mining.mine(df, 5)
    assert sum(r.lines for r in parts.collect()) == len(lines)
    assert mining.mine(df.limit(0)).count() == 0


def test_streamed_templates(spark, streamed):
    lines = [f"{w} on disk {i}" for i in range(5) for w in ("read", "write")] + ["read on tape 3", "42 done"]
    df = spark.createDataFrame([(m, BASE + i, i) for i, m in enumerate(lines)], "message string, us long, seq long")
    out = streamed(df, mining.mine_stream, "templates").collect()
    last = {}
    for r in sorted(out, key=lambda r: (r.us, r.seq)):
        last[r.node, r.leaf, r.cluster] = (r.template, r.lines)
    assert sorted(last.values()) == sorted((r.template, r.lines) for r in mining.mine(df).collect())


def test_grok_of_a_template():
    assert mining.grok_of("login from <*> took <*> user=<*>", "login from (10.0.4.30) took 12ms user=anna,") == r"^login\s+from\s+\(%{IPORHOST:f1}\)\s+took\s+%{QUANTITY:f2}\s+user=%{NOTSPACE:user},$"
    assert mining.grok_of("<*>") == "^%{NOTSPACE:f1}$"


def judged(rows):
    """Threshold states of one metric, written as the rules read."""
    out, level, since, told, told_at, seen = [], "ok", None, "", None, None
    for us, v, warn, crit, wait, cool, resolved in rows:
        if level != "ok" and us - seen > 15 * MINUTE:
            level, since = "ok", us
        now = "crit" if crit is not None and v >= crit else "warn" if warn is not None and v >= warn else "ok"
        if now == "ok" != level and v >= 0.95 * (warn if warn is not None else crit):
            now = level
        notice = ""
        if now == "ok":
            if level != "ok":
                notice, since, told, told_at = "resolved" if told and resolved else "", us, "", None
        else:
            if level == "ok":
                since, told, told_at = us, "", None
            if us - since >= wait * MINUTE and (not told or (told, now) == ("warn", "crit") or us - told_at >= (cool or 30) * MINUTE):
                notice, told, told_at = now, now, us
        pending = now != "ok" and us - since < wait * MINUTE
        since = us if since is None else since
        level, seen = now, us
        out.append((us, now, "pending" if pending else now, since, notice))
    return out


def series(seed):
    rnd = random.Random(seed)
    t, rows = BASE, []
    for _ in range(120):
        t += rnd.choice([1, 1, 1, 2, 20]) * MINUTE
        rows.append((t, float(rnd.choice([10, 60, 77, 79, 80, 85, 92, 95])), rnd.choice([80.0] * 9 + [None]), 90.0, 3, 10, True))
    return rows


def test_threshold_states_and_their_stream(spark, streamed):
    rows = [(h, "cpu", *r) for h in ("a", "b", "c") for r in series(h)]
    df = spark.createDataFrame(rows, "host string, metric string, us long, value double, warn double, crit double, for_min int, cooldown_min int, tell_resolved boolean")
    got = states.threshold_states(df.repartition(4))
    seen = got.orderBy("host", "us").collect()
    want = [(h, *o) for h in ("a", "b", "c") for o in judged([r[2:] for r in rows if r[0] == h])]
    assert [(r.host, r.us, r.level, r.status, r.since_us, r.notice) for r in seen] == want
    assert {r.notice for r in seen} == {"", "warn", "crit", "resolved"} and {r.status for r in seen} == {"ok", "pending", "warn", "crit"}
    live = streamed(df, states.threshold_stream, "levels")
    assert sorted(map(tuple, live.select(*got.columns).collect())) == sorted(map(tuple, seen))
    moved = states.transitions(got).count()
    assert 0 < moved < len(seen)
    assert states.threshold_states(df.limit(0)).count() == 0
    lacking = spark.createDataFrame([("a", "cpu", BASE, None, 1.0, None, 0, 0, True), ("a", "cpu", BASE, 5.0, None, None, 0, 0, True)], df.schema)
    assert states.threshold_states(lacking).count() == 0


def test_lives_of_anomalies(spark):
    events = [("k", 1, "step", None), ("k", 2, "seen", 3.0), ("k", 3, "seen", 4.0), ("k", 4, "clear", None), ("k", 5, "step", None), ("k", 6, "clear", None), ("k", 7, "resolved", None), ("k", 8, "clear", None), ("k", 9, "seen", 9.0), ("k", 10, "ignored", None), ("k", 11, "ack", None), ("m", 1, "seen", 1.0), ("m", 2, "clear", None), ("m", 3, "seen", 2.0)]
    df = spark.createDataFrame([(k, us, us, e, s) for k, us, e, s in events], "key string, us long, seq long, event string, score double")
    got = sorted(map(tuple, states.anomaly_lives(df).collect()))
    assert got == [("k", 1, 2, 3, 2, 4.0, 4, "resolved", 7), ("k", 2, 9, 9, 1, 9.0, None, "ignored", 10), ("m", 1, 1, 3, 2, 2.0, None, "open", None)]


def hour_rows(values, signal="rate", host="h", alerts=()):
    return [(host, BASE + i * learning.HOUR_US, [(signal, float(v))] if v is not None else [], i in alerts) for i, v in enumerate(values)]


HOURS = "host string, us long, values array<struct<signal:string,value:double>>, alerts boolean"


def learned(spark, rows, **more):
    return learning.learning_states(spark.createDataFrame(rows, HOURS), **more).orderBy("us", "signal").collect()


def test_a_flat_signal_is_learned_and_a_shift_sends_it_back(spark):
    out = learned(spark, hour_rows([10] * 60 + [30] * 24 + [30] * 40))
    events = [(i, r.event) for i, r in enumerate(out) if r.event]
    # Two whole days make the change known, at the third day's first hour; 24 far hours later it learns anew.
    assert events[0] == (48, "learned") and events[1] == (83, "relearn")
    assert out[82].shift_hours == 23 and out[82].direction == 1 and out[82].expected == 10 and out[83].status == "learning" and out[83].expected == 30
    row = learning.shifts(learning.learning_states(spark.createDataFrame(hour_rows([10] * 60 + [30] * 24 + [30] * 40), HOURS))).first()
    assert (row.hours, row.direction, row.end) == (23, 1, "relearn")


def test_shifts_that_are_incidents_or_pass(spark):
    silent = learned(spark, hour_rows([10] * 60 + [0] * 30))
    assert [r.event for r in silent if r.event] == ["learned", "incident:silence"]
    alarmed = learned(spark, hour_rows([10] * 60 + [30] * 30, alerts={70}))
    assert [r.event for r in alarmed if r.event] == ["learned", "incident:alert"]
    passing = learned(spark, hour_rows([10] * 60 + [30] * 5 + [10, 10, 30, 10, 10, 10, 30]))
    assert [r.shift_hours for r in passing[60:]] == [1, 2, 3, 4, 5, 5, 5, 6, 6, 6, 0, 1] and [r.event for r in passing if r.event] == ["learned"]


def test_daily_cycles_wait_for_a_weekend_and_means_decay(spark):
    wave = [20 + 15 * (i % 24 > 8) for i in range(24 * 7)]
    out = learned(spark, hour_rows(wave), most_days=30)
    first = next(i for i, r in enumerate(out) if r.event == "learned")
    assert datetime.fromtimestamp(out[first].us / 1e6, UTC).weekday() == 6 and "weekly" in out[100].reasons
    capped = learned(spark, hour_rows(wave), most_days=3)
    assert [(i, r.event) for i, r in enumerate(capped) if r.event] == [(71, "cap")]
    rnd = random.Random(2)
    values = [round(10 + rnd.random(), 3) for _ in range(24 * 5)]
    got = learned(spark, hour_rows(values))
    mean, n = {}, {}
    for i, v in enumerate(values):
        h = i % 24
        n[h] = n.get(h, 0) + 1
        weight = 1 / n[h] if i <= 48 else max(0.1, 1 / n[h])
        mean[h] = round(v if n[h] == 1 else mean[h] + weight * (v - mean[h]), 4)
        assert got[i].expected == pytest.approx(mean[h], abs=1e-9)
    profile = learning.learned_profiles(spark.createDataFrame(hour_rows(values), HOURS)).first()
    assert profile.weekday == pytest.approx([mean[h] for h in range(24)]) and profile.weekend == [None] * 24


def test_learning_as_a_stream(spark, streamed):
    rows = [(h, us, v, a) for h in ("x", "y") for _, us, v, a in hour_rows([5, None, 7] * 20)]
    df = spark.createDataFrame(rows, HOURS)
    table = learning.learning_states(df)
    live = streamed(df, learning.learning_stream, "learned")
    key = lambda d: sorted(repr(tuple(r)) for r in d.select(*table.columns).collect())
    assert key(live) == key(table)


def test_hours_of_values(spark):
    df = spark.createDataFrame([("h", "cpu", BASE, 1.0, False), ("h", "cpu", BASE + MINUTE, 3.0, True), ("h", "rate", BASE + 61 * MINUTE, None, False)], "host string, signal string, us long, value double, alert boolean")
    got = {r.us: ([tuple(v) for v in r["values"]], r.alerts) for r in learning.hours_of(df).collect()}
    assert got == {BASE: ([("cpu", 2.0)], True), BASE + learning.HOUR_US: ([], False)}


def test_a_fold_keeps_one_key_at_a_time(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(10)] + [(None, 3, 5)], "k string, t int, v int")
    out = folds.fold(df.repartition(3), ["k"], ["t"], lambda: {"sum": 0}, lambda s, r: [s.__setitem__("sum", s["sum"] + r["v"])] and [], "k string, total int", lambda s, k: [{"total": s["sum"]}])
    assert {tuple(r) for r in out.collect()} == {("a", 10), (None, 5)}
