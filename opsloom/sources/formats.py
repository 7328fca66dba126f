"""Log formats as projections: each takes a DataFrame with a string column `value` and gives parsed columns.

Lines that don't have the format give nulls; nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_of

# Fixed values.
KV = r'([\w.\-@]+)=("(?:[^"\\]|\\.)*"|\S+)'
RFC5424 = r"^<(\d+)>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[.*?\])+) ?(.*)$"
RFC3164 = r"^(?:<(\d+)>)?([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w./\-]+)(?:\[(\d+)\])?:\s*(.*)$"
CLF = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}|-) (\S+)(?: "([^"]*)" "([^"]*)")?(?: (.*))?$'
CEF_PAIR = r"(\w+)=((?:\\.|[^\\=])*?)(?=\s+\w+=|$)"


def _fields(value: Column, pattern: str, names: str) -> list[Column]:
    return [F.nullif(F.regexp_extract(value, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names.split())]


def _pairs(value: Column, pattern: str) -> Column:
    keys, values = F.regexp_extract_all(value, F.lit(pattern), 1), F.regexp_extract_all(value, F.lit(pattern), 2)
    bare = F.transform(values, lambda v: F.regexp_replace(v, r'^"(.*)"$', "$1"))
    pairs = F.arrays_zip(keys.alias("k"), bare.alias("v"))
    first = F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.map_from_arrays(F.transform(first, lambda x: x["k"]), F.transform(first, lambda x: x["v"]))


def jsonl(lines: DataFrame) -> DataFrame:
    """One JSON object a line as a map of strings; null where a line is no object."""
    return lines.select("*", F.from_json("value", "map<string,string>").alias("attributes"))


def key_values(lines: DataFrame) -> DataFrame:
    """`key=value` pairs, of which a line needs two; the first of a repeated key counts."""
    made = _pairs(F.col("value"), KV)
    return lines.select("*", F.when(F.size(made) >= 2, made).alias("attributes"))


def delimited(lines: DataFrame, names: list[str], sep: str = ",") -> DataFrame:
    """Separated values with quotes under given names."""
    return lines.select("*", F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep}).alias("record")).select("*", "record.*").drop("record")


def syslog5424(lines: DataFrame) -> DataFrame:
    """pri, stamp, host, app, pid, msgid, sd, message, severity (of PRI modulo 8) and the structured data's pairs."""
    out = lines.select("*", *_fields(F.col("value"), RFC5424, "pri stamp host app pid msgid sd message"))
    return out.withColumn("severity", F.when(F.col("pri").isNotNull(), _urgency("pri"))).withColumn("attributes", _pairs(F.coalesce("sd", F.lit("")), r'([\w.\-]+)="((?:[^"\\]|\\.)*)"'))


def syslog3164(lines: DataFrame) -> DataFrame:
    out = lines.select("*", *_fields(F.col("value"), RFC3164, "pri stamp host app pid message"))
    return out.withColumn("severity", F.when(F.col("pri").isNotNull(), _urgency("pri")))


def _urgency(pri: str) -> Column:
    return severity_of(F.pmod(F.col(pri).cast("int"), F.lit(8)).cast("string"))


def access(lines: DataFrame) -> DataFrame:
    """Common and combined access lines; 5xx is ERROR, 4xx WARN."""
    out = lines.select("*", *_fields(F.col("value"), CLF, "client ident user stamp request status bytes referer agent extra"))
    status = F.col("status").try_cast("int")
    return out.withColumn("severity", F.when(status >= 500, "ERROR").when(status >= 400, "WARN").when(F.col("request").isNotNull(), "INFO"))


def cef(lines: DataFrame) -> DataFrame:
    """CEF header and extension; severity from 0 to 10."""
    body = F.regexp_extract("value", r"CEF:(\d+\|.*)$", 1)
    part = F.split(body, r"(?<!\\)\|", 8)
    names = ("version", "vendor", "product", "device_version", "event_id", "name", "level")
    out = lines.select("*", *[F.nullif(F.get(part, i), F.lit("")).alias(n) for i, n in enumerate(names)], _pairs(F.coalesce(F.get(part, 7), F.lit("")), CEF_PAIR).alias("attributes"))
    level = F.col("level").try_cast("int")
    return out.withColumn("severity", F.when(level >= 9, "CRITICAL").when(level >= 7, "ERROR").when(level >= 4, "WARN").when(level >= 0, "INFO"))


def leef(lines: DataFrame) -> DataFrame:
    """LEEF header and its attributes, which tabs separate; severity from 0 to 10 in `sev`."""
    part = F.split(F.regexp_extract("value", r"LEEF:(\d+(?:\.\d+)?\|.*)$", 1), r"(?<!\\)\|", 6)
    names = ("version", "vendor", "product", "device_version", "event_id")
    out = lines.select("*", *[F.nullif(F.get(part, i), F.lit("")).alias(n) for i, n in enumerate(names)], _pairs(F.coalesce(F.get(part, 5), F.lit("")), r"(\w+)=([^\t]*)").alias("attributes"))
    level = F.col("attributes")["sev"].try_cast("int")
    return out.withColumn("severity", F.when(level >= 9, "CRITICAL").when(level >= 7, "ERROR").when(level >= 4, "WARN").otherwise("INFO"))


def w3c(lines: DataFrame, directive: str) -> DataFrame:
    """Lines under a `#Fields:` directive as a map; a dash is absent."""
    names = directive.removeprefix("#Fields:").split()
    parts = F.split("value", " ")
    made = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(F.slice(parts, 1, len(names)), lambda v: F.nullif(v, F.lit("-"))))
    return lines.select("*", F.when(~F.col("value").startswith("#") & (F.size(parts) == len(names)), made).alias("attributes"))


def windows_event(lines: DataFrame) -> DataFrame:
    """Windows event XML: computer, provider, event id, level 1 to 5 as severity."""
    at = lambda path: F.nullif(F.xpath_string("value", F.lit(path)), F.lit(""))
    level = at("/Event/System/Level").try_cast("int")
    severity = F.when(level == 1, "CRITICAL").when(level == 2, "ERROR").when(level == 3, "WARN").when(level == 5, "DEBUG").when(level.isNotNull(), "INFO")
    return lines.select("*", at("/Event/System/Computer").alias("host"), at("/Event/System/Provider/@Name").alias("service"), at("/Event/System/EventID").alias("event_id"), severity.alias("severity"), at("/Event/EventData/Data").alias("message"))


def fold_continuations(lines: DataFrame, starts: Column, file: str = "source", line: str = "line_no") -> DataFrame:
    """Records of several lines: a line that doesn't start one belongs to the one before it in its file."""
    from pyspark.sql import Window

    group = F.sum(starts.cast("int")).over(Window.partitionBy(file).orderBy(line))
    numbered = lines.withColumn("_record", group)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, "value"))), lambda x: x["value"]), "\n")
    return numbered.groupBy(file, "_record").agg(F.min(line).alias(line), joined.alias("value")).drop("_record")
