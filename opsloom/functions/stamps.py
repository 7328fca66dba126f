"""Time stamps of log lines, durations and identifiers, as Column expressions. The session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present

#: Shapes of stamps as patterns, and the format that reads each; the first that fits counts. Where day and month could be either, the day comes first.
SHAPES = (
    (r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$", ("d/MMM/yyyy:HH:mm:ss Z",)),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", ("dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss")),
    (r"^\d{2}/\d{2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", ("MM/dd/yyyy h:mm:ss a",)),
    (r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$", ("dd.MM.yyyy HH:mm:ss",)),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", ("yyyy/MM/dd HH:mm:ss",)),
    (r"^\d{4}\.\d{2}\.\d{2} \d{2}:\d{2}:\d{2}$", ("yyyy.MM.dd HH:mm:ss",)),
    (r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}$", ("dd-MM-yyyy HH:mm:ss",)),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4} \d{2}:\d{2}:\d{2}$", ("d-MMM-yyyy HH:mm:ss",)),
    (r"^[A-Z][a-z]{2} \d{1,2} \d{4} \d{2}:\d{2}:\d{2}$", ("MMM d yyyy HH:mm:ss",)),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}$", ("d MMM yyyy HH:mm:ss",)),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}\.\d{3}$", ("d MMM yyyy HH:mm:ss.SSS",)),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", ("d MMM yyyy HH:mm:ss Z",)),
    (r"^\d{8}T\d{6}$", ("yyyyMMdd'T'HHmmss",)),
    (r"^\d{14}$", ("yyyyMMddHHmmss",)),
)
#: A stamp at the start of a line.
HEAD = r"^\[?(\d{4}[-/.]\d{2}[-/.]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?: ?(?:Z|[+-]\d{2}:?\d{2}|[+-]\d{2}(?!\d)))?|\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}|\d{2}[./-]\d{2}[./-]\d{4} \d{2}:\d{2}:\d{2}(?: [AP]M)?|[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}|\d{8}T\d{6}Z?|\d{13}|\d{10}(?:\.\d+)?)\]?(?=\s|$)\s*"
# Attributes that hold a duration, with what makes it milliseconds; those without a factor name their unit in the value.
DURATIONS = (
    ("duration_ms", 1.0), ("elapsed_ms", 1.0), ("latency_ms", 1.0), ("response_time_ms", 1.0), ("took_ms", 1.0), ("time_ms", 1.0), ("rt_ms", 1.0), ("time-taken", 1.0), ("time_taken", 1.0),
    ("duration_us", 0.001), ("duration_micros", 0.001), ("duration_ns", 1e-6), ("duration_s", 1000.0), ("latency_s", 1000.0), ("request_time", 1000.0), ("elapsed_s", 1000.0), ("rt", 1000.0),
    ("duration", None), ("elapsed", None), ("latency", None), ("took", None), ("response_time", None),
)
TRACEPARENT = r"\b([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})\b"


def micros_of(value: Column, year: int) -> Column:
    """Microseconds since 1970 of a stamp in any of the known shapes; null for another.

    Digits alone are seconds (10), milliseconds (13), microseconds (16) or
    nanoseconds (19) since 1970; a stamp without a year gets `year`, one without
    a zone is UTC.
    """
    s = F.trim(value)
    s = F.regexp_replace(s, r" ([+-]\d{2})$", " $100")
    s = F.regexp_replace(s, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "")
    s = F.when(s.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}$"), F.regexp_replace(s, r"^([A-Z][a-z]{2})\s+(\d{1,2}) ", f"$1 $2 {year} ")).otherwise(s)
    s = F.regexp_replace(s, r"^(\d{8}T\d{6})(?:\.\d+)?Z?$", "$1")
    long = s.try_cast("bigint")
    out = F.when(s.rlike(r"^\d{10}$"), long * 1_000_000).when(s.rlike(r"^\d{13}$"), long * 1000).when(s.rlike(r"^\d{16}$"), long).when(s.rlike(r"^\d{19}$"), F.floor(long / 1000)).when(s.rlike(r"^\d{10}\.\d+$"), F.round(s.try_cast("decimal(28,9)") * 1_000_000).cast("bigint"))
    iso = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(\d),(\d)", "$1.$2"), r" ?([+-]\d{2})(\d{2})$", "$1:$2"), r"(:\d{2}) (?=[+-])", "$1")
    out = out.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.unix_micros(iso.try_cast("timestamp")))
    for shape, formats in SHAPES:
        out = out.when(s.rlike(shape), F.unix_micros(F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])))
    return out


def milliseconds(value: Column) -> Column:
    """A duration whose value names its unit (`1.2s`, `350us`); a bare fraction under a minute is seconds, else milliseconds."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|sec|us|µs|ns)?\s*$"
    n, unit = F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")).try_cast("double"), F.regexp_extract(value, pattern, 2)
    bare = F.when((n != F.floor(n)) & (n < 60), n * 1000).otherwise(n)
    return F.when(unit == "ms", n).when(unit.isin("s", "sec"), n * 1000).when(unit.isin("us", "µs"), n * 0.001).when(unit == "ns", n * 1e-6).otherwise(bare)


def duration_ms(attributes: Column) -> Column:
    """The first duration among an observation's attributes (lower-case keys), in milliseconds; none below 0 or over a day."""
    tried = [F.when(present(attributes[k]), milliseconds(attributes[k]) if factor is None else F.coalesce(attributes[k].try_cast("double") * factor, milliseconds(attributes[k]))) for k, factor in DURATIONS]
    d = F.coalesce(*tried)
    return F.when((d >= 0) & (d <= 86_400_000), d)


def trace_ids(attributes: Column, line: Column) -> Column:
    """(trace_id, parent_id) from a trace parent in the attributes or the line, else from attributes of trace or request."""
    parent = F.coalesce(F.when(present(attributes["traceparent"]), attributes["traceparent"]), F.regexp_extract(line, TRACEPARENT, 0))
    trace, up = (F.nullif(F.regexp_extract(parent, TRACEPARENT, i), F.lit("")) for i in (2, 3))
    named = F.coalesce(*[F.when(present(attributes[k]), attributes[k]) for k in ("trace_id", "traceid", "trace.id", "request_id", "requestid", "x-request-id", "correlation_id")])
    return F.struct(F.coalesce(trace, named).alias("trace_id"), up.alias("parent_id"))
