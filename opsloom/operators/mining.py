"""Templates of log lines by a prefix tree of token count and first token, and grok patterns for them.

A line's tokens go to a leaf of the tree; there they join the cluster with which
they share most places, if that is half of them, and what differs becomes `<*>`.
Leaves don't know of each other, so they are worked on side by side. Lines are put
together by their masked tokens first: however often a line's shape returns, it
is one row of its leaf, and stays in the cluster it went to first.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.observations import dealt, with_once
from .folds import fold, fold_stream
from .graph import written

WILD = "<*>"
#: Share of places that must agree; children of a node, after which new keys share one.
SIMILAR, CHILDREN = 0.5, 100
#: Shapes of a leaf that one task works on; a leaf with more is mined in parts, whose clusters are mined again.
LEAF_SHAPES = 200_000

# What a variable's sample value looks like, and the grok name for it.
VALUE_TYPES = (
    (r"^\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?$", "IPORHOST"), (r"^[+-]?\d+(?:\.\d+)?$", "NUMBER"), (r"^\d+(?:\.\d+)?\s?(?:ms|us|ns|s|sec|m|min|h|%|[KMGT]i?B|[kmgt]b|B)$", "QUANTITY"),
    (r"^/", "UNIXPATH"), (r"^https?://", "URI"), (r"^[0-9a-f-]{36}$", "UUID"), (r"^\d{4}-\d{2}-\d{2}", "TIMESTAMP_ISO8601"),
)
_TRIM = ",;:()[]{}\"'"


def shape(message: Column) -> Column:
    """A line's masked tokens; a line without any is one variable."""
    tokens = text.drain_tokens(F.coalesce(message, F.lit("")))
    return F.when(F.size(tokens) == 0, F.array(F.lit(WILD))).otherwise(tokens)


def _agree(a: list, b: list) -> int:
    return sum(x == y or x == WILD or y == WILD for x, y in zip(a, b))


def _start() -> dict:
    return {"clusters": []}


def _place(clusters: list, row: dict) -> int:
    """Put a shape into the clusters of its leaf: number of the one that it joins or founds."""
    tokens = list(row["tokens"])
    best, shared = -1, 0
    for i, c in enumerate(clusters):
        if len(c["tokens"]) == len(tokens) and (n := _agree(c["tokens"], tokens)) > shared:
            best, shared = i, n
    if best < 0 or shared < SIMILAR * len(tokens):
        clusters.append({"tokens": tokens, "lines": row["lines"], "first_us": row["first_us"], "last_us": row["last_us"], "sample": row["sample"]})
        return len(clusters) - 1
    c = clusters[best]
    c["tokens"] = [x if x == y else WILD for x, y in zip(c["tokens"], tokens)]
    c["lines"] += row["lines"]
    c["last_us"] = max(c["last_us"], row["last_us"])
    return best


def _absorb(state: dict, row: dict) -> list:
    _place(state["clusters"], row)
    return []


def _clusters(state: dict, key: dict) -> list:
    return [c | {"cluster": i} for i, c in enumerate(state["clusters"])]


_ROW = "tokens array<string>, lines long, first_us long, last_us long, sample string"


def shapes(lines: DataFrame) -> DataFrame:
    """One row for each shape: tokens, lines, first (us, seq), first_us, last_us and the first line as sample. `lines` has message, us and seq."""
    at = F.struct("us", "seq")
    s = with_once(dealt(lines.select("message", "us", "seq"), "seq"), tokens=text.drain_tokens(F.coalesce("message", F.lit(""))))
    s = s.withColumn("tokens", F.when(F.size("tokens") == 0, F.array(F.lit(WILD))).otherwise(F.col("tokens"))).groupBy("tokens")
    return s.agg(F.count("*").alias("lines"), F.min(at).alias("first"), F.max("us").alias("last_us"), F.min_by("message", at).alias("sample")).withColumn("first_us", F.col("first.us"))


def _leaves(s: DataFrame) -> DataFrame:
    """Shapes with their leaf: token count and first token, each its own node for the first hundred keys that come, else `*`."""
    s = s.withColumn("length", F.size("tokens").cast("string"))
    lengths = s.groupBy("length").agg(F.min("first").alias("f")).orderBy("f").limit(CHILDREN).select("length", F.col("length").alias("node"))
    s = s.join(F.broadcast(lengths), "length", "left").withColumn("node", F.coalesce("node", F.lit("*")))
    head = F.get("tokens", F.lit(0))
    s = s.withColumn("head", F.when(head == WILD, "*").otherwise(head))
    ranked = s.groupBy("node", "head").agg(F.min("first").alias("f")).withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("f"))).where(F.col("k") <= CHILDREN)
    # A hundred heads for each of at most a hundred and one nodes.
    known = ranked.select("node", "head", F.lit(True).alias("known"))
    return s.join(F.broadcast(known), ["node", "head"], "left").withColumn("leaf", F.when(F.col("known"), F.col("head")).otherwise("*")).drop("head", "known", "length")


def mine(lines: DataFrame, leaf_shapes: int = LEAF_SHAPES) -> DataFrame:
    """Clusters of log lines: node, leaf, cluster (its number in the leaf), template, lines, first_us, last_us and sample.

    `lines` has message, us and seq, which order the lines; a null message is an
    empty one. Clusters grow in the order in which shapes come first. A leaf with
    over `leaf_shapes` shapes is mined in parts, and their clusters once more.
    Lines are read once: their shapes are written, which lengths, heads and leaves
    are then told from, and so are the first clusters.
    """
    placed = _leaves(written(shapes(lines)))
    big = placed.groupBy("node", "leaf").agg(F.ceil(F.count("*") / leaf_shapes).cast("int").alias("parts"))
    # As few rows as there are leaves, a hundred and one times a hundred and one at most.
    placed = placed.join(F.broadcast(big), ["node", "leaf"]).withColumn("part", F.pmod(F.xxhash64("tokens"), F.col("parts")).cast("int"))
    ddl = f"node string, leaf string, parts int, part int, cluster int, {_ROW}"
    first = written(fold(placed.select("node", "leaf", "parts", "part", "first", "tokens", "lines", "first_us", "last_us", "sample"), ["node", "leaf", "parts", "part"], ["first"], _start, _absorb, ddl, _clusters))
    whole = first.where("parts = 1").select("node", "leaf", "cluster", *["tokens", "lines", "first_us", "last_us", "sample"])
    again = fold(first.where("parts > 1"), ["node", "leaf"], ["first_us", "sample"], _start, _absorb, f"node string, leaf string, cluster int, {_ROW}", _clusters)
    out = whole.unionByName(again.select(*whole.columns))
    return out.select("node", "leaf", "cluster", F.array_join("tokens", " ").alias("template"), "lines", "first_us", "last_us", "sample")


def _learn(state: dict, row: dict) -> list:
    """One line of a stream: the tree below its token count."""
    tokens = list(row["tokens"])
    head = "*" if tokens[0] == WILD else tokens[0]
    tree = state.setdefault("tree", {})
    if head not in tree and len(tree) >= CHILDREN:
        head = "*"
    own = tree.setdefault(head, [])
    line = {"tokens": tokens, "lines": 1, "first_us": row["us"], "last_us": row["us"], "sample": row["message"]}
    k = _place(own, line)
    return [{"leaf": head, "cluster": k, "template": " ".join(own[k]["tokens"]), "lines": own[k]["lines"], "us": row["us"], "seq": row["seq"]}]


def mine_stream(lines: DataFrame) -> DataFrame:
    """Every line of a stream (message, us, seq) with its cluster, and that cluster's template and lines so far.

    State is kept for each token count: its leaves, with clusters only.
    """
    rows = lines.select(F.size(shape(F.col("message"))).alias("node"), shape(F.col("message")).alias("tokens"), "message", "us", "seq")
    return fold_stream(rows, ["node"], ["us", "seq"], dict, _learn, "node int, leaf string, cluster int, template string, lines long, us long, seq long")


def most_frequent(clusters: DataFrame, most: int = 200) -> DataFrame:
    """The clusters with most lines."""
    return clusters.orderBy(F.desc("lines"), "template", "first_us").limit(most)


def stats(clusters: DataFrame) -> DataFrame:
    """One row: clusters, their lines, clusters of one line, and the share of lines in the ten largest."""
    top = clusters.orderBy(F.desc("lines"), "template").limit(10).agg(F.sum("lines").alias("top_lines"))
    total = clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.count_if(F.col("lines") == 1).alias("single"))
    return total.join(F.broadcast(top)).select("clusters", "lines", "single", F.round(F.coalesce(F.col("top_lines") / F.nullif("lines", F.lit(0)), F.lit(0.0)), 4).alias("top_share"))


def grok_of(template: str, sample: str = "") -> str:
    """A grok pattern for a template: words as they are, and each variable as a capture typed by its value in the sample.

    Punctuation around a value stays outside its capture; `key=<*>` is captured under its key, other variables as f1, f2, ...
    """
    values = [t for t in (sample or "").split() if t.strip(_TRIM)]
    parts, count = [], 0
    for i, token in enumerate(template.split(" ")):
        name = token[: -len(WILD) - 1] if token.endswith("=" + WILD) else ""
        if token != WILD and not name:
            parts.append(re.escape(token))
            continue
        count += 1
        raw = values[i] if i < len(values) else ""
        value = raw.strip(_TRIM)
        before, after = (raw[: raw.index(value)], raw[raw.index(value) + len(value) :]) if value else ("", "")
        if name:
            key, value, before = re.escape(name) + "=", value.partition("=")[2] or value, ""
        else:
            key = ""
        kind = next((k for p, k in VALUE_TYPES if re.match(p, value)), "NOTSPACE")
        field = re.sub(r"\W", "_", name) or f"f{count}"
        parts.append(f"{re.escape(before)}{key}%{{{kind}:{field}}}{re.escape(after)}")
    return "^" + r"\s+".join(parts) + "$"


def with_grok(clusters: DataFrame) -> DataFrame:
    """Clusters with a grok pattern proposed from template and sample; Arrow batches of templates, of which there are few."""
    @F.pandas_udf("string")
    def proposed(template: pd.Series, sample: pd.Series) -> pd.Series:
        return pd.Series([grok_of(t, s or "") for t, s in zip(template, sample)], dtype=object)

    return clusters.withColumn("grok", proposed("template", "sample"))
