"""Spans out of log lines, and which spans of a stream are kept.

A line is a span if it has a duration or belongs to a trace. What it is called,
its kind, service and whether it failed follow from its attributes by fixed rules.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import stamps, stats, text
from ..sources.observations import MINUTE, with_once

# Attributes (lower case) that name a trace, span, parent, request, session and user.
TRACE_KEYS = ("trace_id", "traceid", "trace.id", "otel.trace_id", "x-b3-traceid", "dd.trace_id", "trace")
SPAN_KEYS = ("span_id", "spanid", "span.id", "otel.span_id", "x-b3-spanid")
PARENT_KEYS = ("parent_span_id", "parentspanid", "parent_id", "parent.id", "x-b3-parentspanid")
REQUEST_KEYS = (
    "request_id", "requestid", "x-request-id", "req_id", "reqid", "request.id", "http.request_id", "correlation_id", "correlationid", "x-correlation-id", "correlation",
    "activity_id", "activityid", "transaction_id", "txn_id", "msgid",
)
SESSION_KEYS = ("session_id", "sessionid", "jsessionid", "session.id", "sid", "session", "phpsessid", "asp.net_sessionid")
USER_KEYS = ("user", "user_id", "userid", "username", "user.id", "uid", "cs-username", "enduser.id", "sap.user", "user.name")
# Attributes that name an operation, a status, a method, a kind, a span and a server, in the order in which they count.
OPERATION_KEYS = ("http.route", "route", "endpoint", "operation", "span.name", "operation_name", "url.path", "http.target", "path", "uri", "url", "http.url", "cs-uri-stem")
STATUS_KEYS = ("http.status_code", "status_code", "sc-status", "status", "http.status", "response_code", "statuscode")
METHOD_KEYS = ("http.method", "method", "cs-method", "http.request.method")
KIND_KEYS, NAME_KEYS, SERVER_KEYS = ("span.kind", "kind", "span_kind"), ("span.name", "name", "operation"), ("s-sitename", "cs-host", "host.name", "server_name")
KINDS = ("server", "client", "internal", "producer", "consumer", "db", "external", "user", "mobile", "log")
# Services that say only how a line came, patterns inside lines, and sign-on events.
NO_SERVICE = ("http", "w3c", "access", "-", "")
REQUEST_LINE = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)"
PARENT_IN_LINE = r"\b00-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}\b"
ID_IN_LINE = r"(?i)\b(trace_?id|request_?id|req_?id|correlation_?id|x-request-id)[=:]\s*\"?([A-Za-z0-9\-_.]{6,64})"
DB_LINE = r"(?i)\b(select|insert|update|delete)\b.+\b(from|into|set)\b"
SIGN_ON = r"(?i)^(LOGIN|LOGOUT|CODE_TO_TOKEN|REFRESH_TOKEN|LOGIN_ERROR|IMPERSONATE|CLIENT_LOGIN)$"
DAY_MS = 86_400_000.0


def lowered(attributes: Column) -> Column:
    """Attributes as (key, value) entries with lower-case keys, in their order; of keys that differ in case only, the last."""
    entries = F.transform(F.map_entries(attributes), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    keys = entries["key"]
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    once = F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(F.filter(entries, lambda e, i: ~later(e, i)))
    return F.coalesce(once, F.array().cast("array<struct<key:string,value:string>>"))


def _whichever(entries: Column, low: Column, names: tuple) -> Column:
    """The first attribute, in the line's own order, that has one of these names and a value. Most lines have none, which the map tells in compiled code."""
    first = F.get(F.filter(entries, lambda e: e["key"].isin(*names) & text.present(e["value"])), F.lit(0))["value"]
    return F.when(_first(low, names).isNotNull(), first)


def _value(low: Column, name: str) -> Column:
    return F.when(text.present(low[name]), low[name])


def _first(low: Column, names: tuple) -> Column:
    """The attribute that comes first in a list of names."""
    return F.coalesce(*[_value(low, n) for n in names])


def _has(low: Column, *names: str) -> Column:
    return F.arrays_overlap(F.map_keys(low), F.array(*map(F.lit, names)))


def _part(column: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def _duration(low: Column) -> Column:
    """The first attribute of a duration that can be read, in milliseconds."""
    read = lambda e: F.coalesce(e["value"].try_cast("double") * e["factor"], stamps.milliseconds(e["value"]))
    named = [F.struct(_value(low, k).alias("value"), F.lit(factor).cast("double").alias("factor")) for k, factor in stamps.DURATIONS]
    every = F.transform(F.filter(F.array(*named), lambda e: e["value"].isNotNull()), read)
    # The first that is there can mostly be read; a list of all is only made where it can't.
    first = F.coalesce(*[F.when(e["value"].isNotNull(), e) for e in named])
    return F.when(first.isNotNull(), F.coalesce(read(first), F.get(F.filter(every, lambda x: x.isNotNull()), F.lit(0))))


def _sign_ons(rows: DataFrame, key: bytes) -> DataFrame:
    """Events of an identity provider as steps of a user; the session links the applications that they open."""
    typ = F.when(F.coalesce(F.col("_type").rlike(SIGN_ON), F.lit(False)), F.col("_type")).otherwise(F.trim("message"))
    client, user = F.col("_client"), _first(F.col("_low"), ("userid", "user_id", "username"))
    return rows.select(
        "seq", F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.col("us").alias("start_us"), F.lit(0.0).alias("duration_ms"), F.lit(False).alias("has_duration"),
        F.substring(F.coalesce(_value(F.col("_low"), "realmid"), F.nullif("service", F.lit("")), F.lit("sso")), 1, 120).alias("service"), F.concat(F.lit("sso "), F.lower(typ), F.lit(" → "), F.substring(client, 1, 60)).alias("operation"),
        F.lit("user").alias("kind"), F.lit(0).alias("status"), F.upper(typ).endswith("_ERROR").alias("error"), F.coalesce("environment", F.lit("")).alias("environment"), F.substring(F.coalesce("host", F.lit("")), 1, 120).alias("host"),
        text.pseudonym(user, key).alias("user_ref"), F.concat(F.lit("sso:"), F.substring(F.col("_session"), 1, 120)).alias("session_id"), F.lit("session").alias("link"), F.lit(0.7).alias("confidence"),
        F.substring(text.scrub(F.col("message")), 1, 300).alias("message"), "severity",
    )


def spans_of_lines(obs: DataFrame, key: bytes = b"") -> DataFrame:
    """The span that each observation describes; lines with neither a duration nor a trace or request give none.

    `obs` has seq, us, message, severity, service, host, environment and
    attributes (a map of texts). Ids come from a trace parent (attribute or line),
    from attributes, then from the line; a duration from attributes, else from
    `<n> ms` in a line that has an id or a method. One below 0 or over a day is no
    duration. A line failed if its status is 500 or more, or it has none and is
    ERROR or worse. Users become pseudonyms under `key`. Null attributes are none.
    """
    base = with_once(obs.withColumn("message", F.coalesce("message", F.lit(""))), _entries=lowered(F.col("attributes")))
    base = with_once(base, _low=F.map_from_entries("_entries"))
    low, own_order, line = F.col("_low"), F.col("_entries"), F.col("message")
    base = with_once(base, _type=F.coalesce(_value(low, "type"), _value(low, "event")), _session=_first(low, ("sessionid", "session_id", "session_state")), _client=_first(low, ("clientid", "client_id", "client")))
    said = F.coalesce(F.col("_type").rlike(SIGN_ON), F.lit(False)) | F.trim("message").rlike(SIGN_ON)
    base = with_once(base, _sign_on=_has(low, "clientid", "client_id") & said & F.col("_session").isNotNull() & F.col("_client").isNotNull())

    request = _value(low, "request")
    s = with_once(
        base.where(~F.col("_sign_on")), _parent=F.coalesce(_value(low, "traceparent"), _part(line, PARENT_IN_LINE, 0)), _trace=_whichever(own_order, low, TRACE_KEYS), _request=_whichever(own_order, low, REQUEST_KEYS), _span=_whichever(own_order, low, SPAN_KEYS),
        _up=_whichever(own_order, low, PARENT_KEYS), _user=_whichever(own_order, low, USER_KEYS), _sess=_whichever(own_order, low, SESSION_KEYS), _method=F.coalesce(_first(low, METHOD_KEYS), _part(request, REQUEST_LINE, 1), _part(line, REQUEST_LINE, 1)),
        _target=F.coalesce(_first(low, OPERATION_KEYS), _part(request, REQUEST_LINE, 2), _part(line, REQUEST_LINE, 2)), _named_ms=_duration(low),
    )
    in_line = F.when(F.col("_trace").isNull() & F.col("_request").isNull(), _part(line, ID_IN_LINE, 2))
    s = with_once(s, _found=in_line, _pieces=F.split(F.col("_parent"), "-"))
    has_id = F.coalesce("_parent", "_trace", "_request", "_found", "_span", "_up", "_user", "_sess").isNotNull()
    pieces = F.col("_pieces")
    explicit = F.when(F.size(pieces) >= 3, F.get(pieces, F.lit(1)))
    found_trace = F.lower(F.regexp_extract(line, ID_IN_LINE, 1)).startswith("trace")
    trace = F.coalesce(explicit, "_trace", F.when(found_trace, F.col("_found")), "_request", "_found")
    s = with_once(s, trace_id=F.substring(trace, 1, 128), parent_id=F.substring(F.coalesce("_up", F.when(F.size(pieces) >= 3, F.get(pieces, F.lit(2)))), 1, 128), _any_ms=F.coalesce("_named_ms", F.when(has_id | F.col("_method").isNotNull(), text.latency_ms(line))))
    s = with_once(s.where("_any_ms IS NOT NULL OR trace_id IS NOT NULL"), _ms=F.when((F.col("_any_ms") >= 0) & (F.col("_any_ms") <= DAY_MS), F.col("_any_ms")))

    status = F.coalesce(F.substring(_first(low, STATUS_KEYS), 1, 3).try_cast("int"), F.lit(0))
    kind = F.lower(F.coalesce(_first(low, KIND_KEYS), F.lit("")))
    ladder = F.when(kind.isin(*KINDS), kind).when(_has(low, "db.system", "db.statement") | line.rlike(DB_LINE), "db").when(_has(low, "target", "upstream", "peer.service"), "client")
    ladder = ladder.when(F.col("_method").isNotNull() | _has(low, "request"), "server").when(F.col("_ms").isNull(), "log").otherwise("internal")
    called = F.when(F.col("_target").isNotNull(), F.concat(F.coalesce(F.concat("_method", F.lit(" ")), F.lit("")), text.path_template(F.col("_target"))))
    called = F.coalesce(called, F.nullif(F.substring(_first(low, NAME_KEYS), 1, 80), F.lit("")), F.nullif(F.substring(text.template(line), 1, 80), F.lit("")), F.lit("-"))
    own = F.coalesce("service", F.lit(""))
    served = F.when(~own.isin(*NO_SERVICE), own).otherwise(F.coalesce(_first(low, SERVER_KEYS), F.nullif("host", F.lit("")), F.lit("http")))
    has_session = F.col("_sess").isNotNull()
    out = with_once(s, status=status).select(
        "seq", "trace_id", F.substring("_span", 1, 128).alias("span_id"), "parent_id", F.col("us").alias("start_us"), F.round(F.coalesce("_ms", F.lit(0.0)), 3).alias("duration_ms"), F.col("_ms").isNotNull().alias("has_duration"),
        F.substring(served, 1, 120).alias("service"), F.substring(called, 1, 160).alias("operation"), ladder.alias("kind"), "status", ((F.col("status") >= 500) | ((F.col("status") == 0) & (F.coalesce(text.rank(F.col("severity")), F.lit(1)) >= 3))).alias("error"),
        F.coalesce("environment", F.lit("")).alias("environment"), F.substring(F.coalesce("host", F.lit("")), 1, 120).alias("host"), text.pseudonym(F.substring("_user", 1, 128), key).alias("user_ref"), F.coalesce(F.substring("_sess", 1, 128), F.lit("")).alias("session_id"),
        F.when(F.col("trace_id").isNotNull(), "explicit").when(has_session, "session").otherwise("none").alias("link"), F.when(F.col("trace_id").isNotNull(), 1.0).when(has_session, 0.7).otherwise(0.0).alias("confidence"),
        F.substring(text.scrub(line), 1, 300).alias("message"), "severity",
    )
    return out.unionByName(_sign_ons(base.where("_sign_on"), key))


def rollup(spans: DataFrame, step_us: int = MINUTE) -> DataFrame:
    """Calls, errors, time, longest and histogram by bar, service, operation, kind and environment, of spans with a duration."""
    timed = spans.where("has_duration AND kind <> 'log'").withColumn("b", stats.bucket(F.col("duration_ms"))).withColumn("bar", F.floor(F.col("start_us") / step_us).cast("bigint"))
    return timed.groupBy("bar", "service", "operation", "kind", "environment").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.round(F.sum("duration_ms"), 3).alias("total_ms"), F.max("duration_ms").alias("max_ms"), stats.histogram(F.col("b")).alias("h"))


def merge_rollups(*parts: DataFrame) -> DataFrame:
    """Rollups of several sources or hours as one: sums, maxima and histograms added place by place."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    keys = ("bar", "service", "operation", "kind", "environment")
    histogram = F.array(*[F.sum(F.col("h")[i]) for i in range(len(stats.BOUNDS) + 1)])
    return every.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.round(F.sum("total_ms"), 3).alias("total_ms"), F.max("max_ms").alias("max_ms"), histogram.alias("h"))


def by_hash(trace_id: Column, percent: float) -> Column:
    """Whether a trace is in the share that is always kept."""
    h = F.conv(F.substring(F.sha1(trace_id.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(h % 10_000 < percent * 100, F.lit(False))


def kept(spans: DataFrame, percent: float, slow_ms: float, claims: Column, at: str, hold: float) -> DataFrame:
    """Spans that tail sampling keeps, over a table.

    Kept are spans that claim, failed or slow ones, those of a user or device, and
    a share of traces by hash. A trace that is claimed gives all spans from `hold`
    before the first claim on; a slow span keeps itself alone. `claims` says which
    spans claim their trace, `at` names the column of time.
    """
    claimed = spans.where(F.coalesce(claims, F.lit(False)) & F.col("trace_id").isNotNull()).groupBy("trace_id").agg(F.min(at).alias("_claimed"))
    own = F.coalesce(claims, F.lit(False)) | F.col("error") | (F.col("duration_ms") >= slow_ms) | F.col("kind").isin("user", "mobile") | by_hash(F.col("trace_id"), percent)
    by_claim = F.coalesce(F.col(at) >= F.col("_claimed") - F.lit(hold), F.lit(False))
    return spans.join(claimed, "trace_id", "left").where(own | by_claim).select(*spans.columns)


def kept_stream(spans: DataFrame, percent: float, slow_ms: float, hold: str = "2 minutes") -> DataFrame:
    """Tail sampling over a stream with an event-time column `ts`: spans of a trace are held back until it is claimed, two minutes at most.

    `spans` has trace_id (not null), ts, duration_ms, error, kind, claims and any
    others. What is kept for itself is given out at once; what is held is given
    out by a claim, and dropped with the trace's state when nothing has come for
    `hold` of event time.
    """
    limit_ms = pd.Timedelta(hold).total_seconds() * 1000
    columns, ddl = spans.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema.fields)
    rows = spans.withWatermark("ts", hold).withColumn("_share", by_hash(F.col("trace_id"), percent))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        claimed, held = json.loads(state.get[0]) if state.exists else (False, [])
        frame = pd.concat(list(frames), ignore_index=True).sort_values("ts", kind="stable")
        out, last = [], 0
        for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
            ms = int(row["ts"].value // 1_000_000)
            last = max(last, ms)
            held = [h for h in held if ms - h["_ms"] <= limit_ms]
            if row["claims"]:
                claimed, held, freed = True, [], held
                out += [{c: pd.Timestamp(h[c]) if c == "ts" else h[c] for c in columns} for h in freed]
            own = {c: row[c] for c in columns}
            if claimed or row["error"] or row["duration_ms"] >= slow_ms or row["kind"] in ("user", "mobile") or row["_share"]:
                out.append(own)
            else:
                held.append({c: str(v) if c == "ts" else v for c, v in own.items()} | {"_ms": ms})
        state.update((json.dumps([claimed, held]),))
        state.setTimeoutTimestamp(max(int(last + limit_ms), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    return rows.groupBy("trace_id").applyInPandasWithState(run, ddl, "state string", "append", GroupStateTimeout.EventTimeTimeout)
