"""Secret scans: fixed patterns, and character Markov models.

Two first-order models over characters, one of random strings and one of
ordinary identifiers, are counted from labelled samples. A token whose
log-likelihood ratio is high for its length is a secret although no pattern
names it. DataFrame functions only: the models are a table of ratios, kept as a
constant array in the plan.

All work on a text is linear in its length: matches are found in one pass, and
where they are follows from the lengths of what lies between them, summed in
blocks. (An array that grows by one element at a time would be copied each time.)
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, free_names, table

#: Kind, pattern, group that is measured, its least length. Group 0 is the whole match.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Tokens that the models judge, whatever they are made of.
TOKEN = r"[A-Za-z0-9+/_=-]{10,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: ASCII codes: what a row of the table of ratios has.
CODES = 128
#: Lengths from which on a threshold of its own is calibrated.
LENGTHS = (0, 12, 16, 24, 40)
#: Log-likelihood ratio (natural) that a secret has at least; and how far it lies above the given share of ordinary tokens of its length.
LEAST_RATIO, SHARE, MARGIN = 8.0, 0.999, 2.0
#: Elements of an array that are worked on together.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once although a lambda inside names it often."""
    return F.get(F.transform(F.array(value), body), 0)


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK elements."""
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.slice(x, i * BLOCK + 1, BLOCK)))


def _running(lengths: Column) -> Column:
    """Sums of an array's elements before each one; block by block, so that no long array is copied for each element. Not for an empty array."""
    before = lambda x: F.aggregate(x, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("o")), lambda s, v: F.struct((s["n"] + v).alias("n"), F.concat(s["o"], F.array(s["n"])).alias("o")))
    inner = F.transform(_blocks(lengths), before)
    outer = lambda b: before(F.transform(b, lambda x: x["n"]))["o"]
    return _let(inner, lambda b: F.flatten(F.zip_with(b, outer(b), lambda x, base: F.transform(x["o"], lambda v: v + base))))


def _placed(text: Column, hits: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The matches `hits` of a pattern as structs (start, rank, end, kind, value); start and end in code points.

    Between two matches lies a piece of the text split by the same pattern.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = lambda g: F.zip_with(g, F.transform(hits, lambda x: F.length(x)), lambda gap, n: gap + F.coalesce(n, F.lit(0)))
    # A match begins after all steps before it and its own gap.
    starts = _let(gaps, lambda g: F.zip_with(_running(steps(g)), g, lambda before, gap: before + gap))
    every = F.zip_with(hits, starts, lambda m, s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("end"), F.lit(kind).alias("kind"), (F.regexp_extract(m, pattern, group) if group else m).alias("value")))
    kept = F.filter(every, lambda z: z["value"].isNotNull() & (F.length(z["value"]) >= least))
    return F.when(F.size(hits) > 0, kept).otherwise(F.array().cast(SPANS))


#: Type of an array of spans.
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def with_base_spans(rows: DataFrame, text: str, out: str) -> DataFrame:
    """`rows` with the spans of the fixed patterns in the column `out`, by start, then kind as listed."""
    names = free_names(rows, *(f"hits_{k}" for k, *_ in PATTERNS))
    found = rows.select("*", *[F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(n) for n, (_, pattern, _, _) in zip(names, PATTERNS, strict=True)])
    spans = [_placed(F.col(text), F.col(n), kind, i, pattern, group, least) for i, (n, (kind, pattern, group, least)) in enumerate(zip(names, PATTERNS, strict=True))]
    return found.withColumn(out, F.sort_array(F.concat(*spans))).drop(*names)


def _apart(tokens: Column, base: Column) -> Column:
    """The spans of `tokens` that overlap none of `base`; both by start. A block of tokens is held against the base spans in its range."""
    overlaps = lambda lo, hi: lambda b: (b["start"] < hi) & (lo < b["end"])
    within = lambda x: F.filter(base, overlaps(F.element_at(x, 1)["start"], F.element_at(x, -1)["end"]))
    one = lambda x: _let(within(x), lambda near: F.filter(x, lambda t: ~F.exists(near, overlaps(t["start"], t["end"]))))
    return F.when(F.size(tokens) == 0, tokens).otherwise(F.flatten(F.transform(_blocks(tokens), one)))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(value, random): values that the fixed patterns found, and the tokens outside them, of all documents; each once, as a checkpoint. `id_col` isn't looked at."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = with_base_spans(texts, "text", "base").withColumn("rest", F.regexp_replace("text", "|".join(p for _, p, _, _ in PATTERNS), " "))
    random = F.transform("base", lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("random")))
    plain = F.transform(F.regexp_extract_all("rest", F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("value"), F.lit(False).alias("random")))
    return durable(found.select(F.inline(F.concat(random, plain))).distinct())


def learn_ratios(samples: DataFrame) -> list[float] | None:
    """Log ratios of transitions, by code * CODES + next code; None if a class has no transitions.

    At most CODES * CODES * 2 counts come to the driver.
    """
    code = F.transform(F.split("value", ""), lambda c: F.ascii(c))
    pair = F.explode(F.arrays_zip(F.col("c").alias("a"), F.slice("c", 2, F.size("c")).alias("b"))).alias("p")
    moves = samples.where(F.length("value") > 1).select("random", code.alias("c")).select("random", pair).select("random", "p.a", "p.b").where(f"a < {CODES} AND b < {CODES}")
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in moves.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    total = {}
    for (r, a, _), n in counts.items():
        total[r, a] = total.get((r, a), 0) + n
    if not any(r for r, *_ in counts) or all(r for r, *_ in counts):
        return None
    states = len(ALPHABET)
    chance = lambda r, a, b: (counts.get((r, a, b), 0) + 0.5) / (total.get((r, a), 0) + 0.5 * states)
    known = {ord(c) for c in ALPHABET}
    return [round(math.log(chance(True, a, b) / chance(False, a, b)), 4) if a in known and b in known else 0.0 for a in range(CODES) for b in range(CODES)]


def ratio(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of an ASCII string: above 0 the random model fits better."""
    constant = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    return _let(codes, lambda k: F.aggregate(F.zip_with(k, F.slice(k, 2, F.size(k)), lambda a, b: F.element_at(constant, a * CODES + b + 1)), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))


def thresholds(samples: DataFrame, ratios: list[float]) -> list[float]:
    """For each of LENGTHS, the ratio from which on a token of that length is a secret: well above nearly all ordinary samples."""
    group = sum(((F.length("value") >= n).cast("int") for n in LENGTHS[1:]), F.lit(0))
    # To a hundredth, so that what is sorted in one task is a histogram and not the samples.
    scored = samples.where("NOT random").select(group.alias("g"), F.round(ratio(F.col("value"), ratios), 2).alias("r")).groupBy("g", "r").agg(F.count("*").alias("n"))
    known = {r["g"]: r["q"] for r in scored.groupBy("g").agg(F.percentile("r", F.lit(SHARE), F.col("n")).alias("q")).collect()}
    return [max(LEAST_RATIO, known.get(g, 0.0) + MARGIN) for g in range(len(LENGTHS))]


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every text.

    Returns `id_col`, base (array of spans of the fixed patterns) and added
    (spans of tokens of ten characters or more that the models call random and
    that overlap no base span). Each span has start, end (code points, end
    exclusive), kind and value; a null or empty text has none. `samples` (value,
    random) trains the models and calibrates the ratio that a token must reach
    for its length; by default they are drawn from `docs`. Where a class has no
    samples, nothing is added. Spans of equal start are in the order of their
    kinds; equal rows are returned each; other columns are not looked at.
    """
    samples = labelled_samples(docs, id_col, text_col) if samples is None else samples
    ratios = learn_ratios(samples)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_base_spans(rows, "text", "base")
    if ratios is None:
        return rows.select(F.col("id").alias(id_col), "base", F.slice("base", 1, 0).alias("added"))
    limits = thresholds(samples, ratios)
    limit = lambda t: F.element_at(F.array(*map(F.lit, limits)), sum(((F.length(t) >= n).cast("int") for n in LENGTHS[1:]), F.lit(1)))
    rows = rows.withColumn("tokens", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    rows = rows.withColumn("likely", F.transform("tokens", lambda t: ratio(t, ratios) >= limit(t)))
    placed = F.filter(F.zip_with(_placed(F.col("text"), F.col("tokens"), "markov", len(PATTERNS), TOKEN, 0, 1), "likely", lambda s, y: F.when(y, s)), lambda s: s.isNotNull())
    # Most texts have none, and then no place is looked for.
    some = F.when(F.exists("likely", lambda y: y), placed).otherwise(F.array().cast(SPANS))
    rows = rows.select("id", "base", some.alias("some"))
    return rows.select(F.col("id").alias(id_col), "base", _apart(F.col("some"), F.col("base")).alias("added"))


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Secrets in all of `documents`."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.sort_array(F.concat("base", "added"))).alias("spans"))
