"""Benchmark decontamination with suffix arrays over the training shards.

Every task cuts its rows into shards and sorts all suffixes of a shard's words
(prefix doubling, in which only what still ties is sorted again). Every suffix of
every benchmark item is then binary-searched: word by word its range of equal
beginnings narrows, so that a window's range holds exactly its occurrences, and
what a suffix has in common with its neighbours in the order is its longest
verbatim match. No candidates are listed. No shuffle is needed: the benchmark
travels to the data, in slices of bounded size, one at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, free_names, lean, table
from .textarrow import ALNUM_LOWER, Words, mix, powers, spread, text_blocks, words

U = np.uint64
#: Consecutive words of an item that make a window.
WINDOW = 10
#: Bytes of text in a shard, for which one suffix array is built.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text that a pass over the documents carries, about; a larger benchmark takes several passes.
SLICE_BYTES = 16 << 20
#: Words up to which ranges are narrowed one word at a time; longer matches are measured by hashes of what precedes.
STEPWISE = 16


def suffix_order(code: np.ndarray) -> np.ndarray:
    """Positions of an array in the order of their suffixes. Each text ends in a code of its own, so no two suffixes are equal."""
    n = len(code)
    bits = max(1, int(code.max()).bit_length())
    depth = max(1, 62 // bits)
    padded = np.concatenate([code, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.ones(n, bool)  # of the groups that tie so far, along the order
    begins[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    while True:
        tied = ~begins
        tied[:-1] |= ~begins[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            return order
        at, own = order[tied], group[tied]
        # Suffixes that tie so far hold no end of a text yet, so what follows is inside the array.
        after = rank[at + depth]
        by = np.lexsort((after, own))
        at, after = at[by], after[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        order[tied], begins[tied] = at, fresh
        group[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at] = group[tied]
        depth *= 2


class Shard(NamedTuple):
    """The words of some texts as codes, each text ended by one of its own, and their suffix array."""

    known: np.ndarray  # sorted hashes of the words; a word's code is its place here after all ends of texts
    code: np.ndarray
    text: np.ndarray  # of each position
    offset: np.ndarray  # of each position in its text
    order: np.ndarray


def laid_out(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words with one place more after each text: text, offset in the text, and whether a word is there."""
    count = np.diff(w.bounds)
    text = np.repeat(np.arange(len(count)), count + 1)
    offset = np.arange(len(text)) - np.repeat(w.bounds[:-1] + np.arange(len(count)), count + 1)
    return text, offset, offset < count[text]


def make_shard(w: Words) -> Shard:
    text, offset, word = laid_out(w)
    known, place = np.unique(w.hashes, return_inverse=True)
    code = text.astype(np.int64)
    code[word] = place + len(w.bounds) - 1
    return Shard(known, code, text, offset, suffix_order(code))


class Slice(NamedTuple):
    """Some benchmark items, ready to be searched."""

    ids: list[str]
    hashes: np.ndarray  # words with one place more after each item, which is 0
    text: np.ndarray
    at: np.ndarray  # positions of the suffixes
    left: np.ndarray  # words of each suffix
    length: np.ndarray  # words of the window that begins there, if it is the first of equal windows; else 0
    window: np.ndarray  # that window's number
    bounds: np.ndarray  # window k is in the items owners[bounds[k] : bounds[k + 1]]
    owners: np.ndarray


def make_slice(ids: list, texts: list, window: int = WINDOW) -> Slice:
    """Every suffix of every item, with the window that begins there."""
    parts = [words(b, ALNUM_LOWER) for b in text_blocks(pa.array(texts, pa.string()), 1 << 40)]
    w = parts[0] if parts else Words(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    text, offset, word = laid_out(w)
    hashes = np.zeros(len(text), U)
    hashes[word] = w.hashes
    at = np.flatnonzero(word)
    n = np.diff(w.bounds)[text[at]]
    left = n - offset[at]
    length = np.where(n >= window, np.where(left >= window, window, 0), np.where(offset[at] == 0, n, 0))
    numbers: dict[bytes, int] = {}
    owners: list[set] = []
    number = np.full(len(at), -1)
    for k in np.flatnonzero(length).tolist():
        own = hashes[at[k] : at[k] + length[k]].tobytes()
        if own not in numbers:
            numbers[own] = number[k] = len(owners)
            owners.append(set())
        owners[numbers[own]].add(int(text[at[k]]))
    bounds = np.concatenate([[0], np.cumsum([len(o) for o in owners], dtype=np.int64)])
    return Slice([str(i) for i in ids], hashes, text, at, left, np.where(number >= 0, length, 0), number, bounds, np.array([i for o in owners for i in sorted(o)], np.int64))


class Found(NamedTuple):
    """What a slice's suffixes have in a shard."""

    common: np.ndarray  # words of the longest match of each suffix
    place: np.ndarray  # a position in the shard where it is
    suffix: np.ndarray  # windows that occur, by their suffix,
    low: np.ndarray  # and the range of the order that holds their occurrences
    high: np.ndarray


def _narrow(shard: Shard, low: np.ndarray, high: np.ndarray, depth: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range in which the word at `depth` has the code."""

    def edge(right: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) // 2
            x = shard.code[shard.order[mid] + depth]
            up = (x <= code[live]) if right else (x < code[live])
            a[live[up]], b[live[~up]] = mid[up] + 1, mid[~up]
            live = live[a[live] < b[live]]
        return a

    return edge(False), edge(True)


def _prefix(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, U)
    np.cumsum(mix(code.astype(U) + U(1)) * up[: len(code)], out=sums[1:])
    return sums, down


def search(shard: Shard, items: Slice) -> Found:
    """Binary search of every suffix of the slice among those of the shard."""
    texts = int(shard.text[-1]) + 1
    slot = np.minimum(np.searchsorted(shard.known, items.hashes), max(0, len(shard.known) - 1))
    there = (shard.known[slot] == items.hashes) & (items.hashes > 0) if len(shard.known) else np.zeros(len(items.hashes), bool)
    code = np.where(there, slot + texts, -1)
    m = len(items.at)
    common, place = np.zeros(m, np.int64), np.zeros(m, np.int64)
    low, high = np.zeros(m, np.int64), np.full(m, len(shard.order))
    suffix, lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, depth = np.flatnonzero(code[items.at] >= 0), 0
    while len(live) and depth < max(STEPWISE, int(items.length.max())):
        a, b = _narrow(shard, low[live], high[live], depth, code[items.at[live] + depth])
        some = a < b
        live = live[some]
        low[live], high[live] = a[some], b[some]
        depth += 1
        common[live], place[live] = depth, shard.order[low[live]]
        whole = live[items.length[live] == depth]
        suffix.append(whole)
        lows.append(low[whole])
        highs.append(high[whole])
        live = live[code[items.at[live] + depth] >= 0]
    if len(live):
        _measure(shard, items, code, live, low[live], high[live], common, place)
    return Found(common, place, np.concatenate(suffix), np.concatenate(lows), np.concatenate(highs))


def _measure(shard: Shard, items: Slice, code: np.ndarray, live: np.ndarray, low: np.ndarray, high: np.ndarray, common: np.ndarray, place: np.ndarray) -> None:
    """Longest matches of suffixes that go on beyond STEPWISE words: a binary search over the order, whose comparisons are binary searches over lengths."""
    (mine, down), (theirs, _) = _prefix(code), _prefix(shard.code)
    start, left, n = items.at[live], items.left[live], len(shard.code)

    def shared(at: np.ndarray, k: np.ndarray) -> np.ndarray:
        a, b = np.zeros(len(k), np.int64), np.minimum(left[k], n - at)
        while (a < b).any():
            mid = (a + b + 1) // 2
            equal = (mine[start[k] + mid] - mine[start[k]]) * down[start[k]] == (theirs[at + mid] - theirs[at]) * down[at]
            a, b = np.where(equal, mid, a), np.where(equal, b, mid - 1)
        return a

    a, b = low.copy(), high.copy()
    open_ = np.flatnonzero(a < b)
    while len(open_):
        mid = (a[open_] + b[open_]) // 2
        at = shard.order[mid]
        k = shared(at, open_)
        # Past its end a suffix has nothing, which comes before any code.
        own = np.where(k < left[open_], code[np.minimum(start[open_] + k, len(code) - 1)], -2)
        before = shard.code[np.minimum(at + k, n - 1)] < own
        a[open_[before]], b[open_[~before]] = mid[before] + 1, mid[~before]
        open_ = open_[a[open_] < b[open_]]
    every = np.arange(len(live))
    for near in (a - 1, a):
        inside = (near >= low) & (near < high)
        at = shard.order[np.where(inside, near, low)]
        k = np.where(inside, shared(at, every), 0)
        better = k > common[live]
        common[live[better]], place[live[better]] = k[better], at[better]


def _search(items: Slice, last: bool, text_col: str, names: dict[str, str]):
    """The body of a pass: extends the columns that hold what was found before."""

    def run(batches):
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            before = {c: column(names[c]).to_pylist() for c in ("spans", "items", "best")}
            n_words, n_hit, spans, found, best = [], [], [], [], []
            for block in text_blocks(column(text_col), SHARD_BYTES):
                w = words(block, ALNUM_LOWER)
                counts, rows = np.diff(w.bounds), len(block.bounds) - 1
                shard = make_shard(w)
                got = search(shard, items)
                times = got.high - got.low
                at = shard.order[spread(got.low, times)]
                which, length = np.repeat(items.window[got.suffix], times), np.repeat(items.length[got.suffix], times)
                order = np.argsort(at, kind="stable")
                at, which, length = at[order], which[order], length[order]
                cut = np.searchsorted(shard.text[at], np.arange(rows + 1))
                top = _longest(shard, items, got, rows)
                for d in range(rows):
                    r, own = block.first + d, slice(cut[d], cut[d + 1])
                    new = np.stack([shard.offset[at[own]], shard.offset[at[own]] + length[own]], 1).astype(np.int32)
                    if before["spans"][r]:
                        new = np.concatenate([np.frombuffer(before["spans"][r], np.int32).reshape(-1, 2), new])
                    n_words.append(int(counts[d]))
                    if len(new):
                        edge = np.bincount(new[:, 0], minlength=counts[d] + 1) - np.bincount(new[:, 1], minlength=counts[d] + 1)
                        hit = np.cumsum(edge[:-1]) > 0
                        n_hit.append(int(hit.sum()))
                        flip = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                        new = flip.reshape(-1, 2).astype(np.int32)
                    else:
                        n_hit.append(0)
                    spans.append(None if last or not len(new) else new.tobytes())
                    seen = np.unique(which[own])
                    owners = items.owners[spread(items.bounds[seen], items.bounds[seen + 1] - items.bounds[seen])]
                    found.append(sorted({*(before["items"][r] or ()), *(items.ids[i] for i in np.unique(owners).tolist())}))
                    old, now = before["best"][r], top.get(d)
                    best.append(now if old is None or now and now["words"] > old["words"] else old)
            out = {"spans": pa.array(spans, pa.binary()), "items": pa.array(found, pa.list_(pa.string())), "best": pa.array(best, _BEST), "words": pa.array(n_words, pa.int64()), "hit": pa.array(n_hit, pa.int64())}
            own = {names[c]: x for c, x in out.items()}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(i) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return run


def _longest(shard: Shard, items: Slice, got: Found, rows: int) -> dict[int, dict]:
    """For each text in which the longest match of some suffix lies: the longest of them, the earliest suffix first."""
    some = np.flatnonzero(got.common)
    text = shard.text[got.place[some]]
    some = some[np.lexsort((some, -got.common[some], text))]
    text = shard.text[got.place[some]]
    first = some[np.flatnonzero(np.diff(text, prepend=-1))]
    return {int(shard.text[got.place[k]]): {"words": int(got.common[k]), "item": items.ids[items.text[items.at[k]]], "at": int(shard.offset[got.place[k]])} for k in first}


_BEST = pa.struct([("words", pa.int64()), ("item", pa.string()), ("at", pa.int64())])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Mark the words of documents that repeat benchmark windows verbatim.

    Adds to `docs`: `bench_words`, `bench_hit` (words inside an occurrence of a
    window), `bench_items` (ids as sorted strings of the items with an occurring
    window), `bench_longest` (words, item and word offset of the longest of the
    verbatim matches that suffixes of items have in this document; each suffix
    counts where its longest match in a shard is; null without one). A null or
    empty text, or one without words, has no words and no hits; an item without
    words has no windows; equal items each count; an empty benchmark marks
    nothing. Equal rows are marked each. Columns of `docs` with these names are
    replaced. A benchmark larger than `slice_bytes` is searched in several
    passes; the driver holds one slice at a time, and passes end in checkpoints.
    """
    out = docs.drop("bench_words", "bench_hit", "bench_items", "bench_longest")
    own = out.columns
    names = dict(zip(("spans", "items", "best", "words", "hit"), free_names(out, "spans", "items", "best", "words", "hit"), strict=True))
    empty = {"spans": "binary", "items": "array<string>", "best": "struct<words:bigint,item:string,at:bigint>", "words": "bigint", "hit": "bigint"}
    out = out.select("*", *[F.lit(None).cast(kind).alias(names[c]) for c, kind in empty.items()])
    sized = benchmark.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = sized.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0)).alias("n")).first()["n"]
    pieces = max(1, -(-total // slice_bytes))
    for k in range(pieces):
        rows = (sized if pieces == 1 else sized.where(F.pmod(F.xxhash64("i"), F.lit(pieces)) == k)).collect()
        part = make_slice([r["i"] for r in rows], [r["t"] for r in rows])
        out = out.mapInArrow(lean(_search(part, k == pieces - 1, text_col, names)), out.schema)
        if k < pieces - 1:
            out = durable(out)
    c = lambda n: F.col(names[n])
    return out.select(*own, c("words").alias("bench_words"), c("hit").alias("bench_hit"), c("items").alias("bench_items"), c("best").alias("bench_longest"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` without any hit word, with their own columns only."""
    # Under other names, so that none of them is replaced.
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    marked = find_benchmark(docs.toDF(*names.values()), benchmark, names[text_col])
    return marked.where("bench_hit = 0").select(*[F.col(own).alias(c) for c, own in names.items()])


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """All of `documents` against all of `benchmark`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("bench_words").alias("n_words"), F.col("bench_hit").alias("n_hit"), F.size("bench_items").cast("long").alias("n_items"), F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"), (F.col("bench_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s, w FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM iw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM dp),
hit AS (SELECT doc_id, n, s, item_id FROM dw JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM hit)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
