"""Substring deduplication by level-wise doubling.

Windows of five words are looked at first; those repeated at that length alone
are extended to ten words, and those repeated there to twenty, the length that is
removed. (The window and the number of doublings are parameters.) The loop ends
at the length that is removed: a longer window that repeats holds only words
that are gone already. Below it only anchors are sent: of the windows of a
level's length inside each target window, the one with the smallest hash. Equal
target windows have equal anchors, so none is lost, and few positions travel; a
target window whose anchor is alone at some length goes no further.

A level is one shuffle by hash. Before it, each shard sends one entry for each
distinct window, its first; what repeats inside the shard is settled there. So
a window that fills a third of the corpus is one entry per shard. Verdicts go
back by document and meet the texts again under the same key, whose exchange
all later steps share. Levels below the last compare 64-bit hashes, which can
only let more through; the last compares 128 bits, made of three overlapping
windows of half the length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textarrow import SPACED, Block, mix, ngrams, spread, text_blocks, words

U = np.uint64
WINDOW = 20
#: Times that the length doubles before it is that of the window.
DOUBLINGS = 2
#: Bytes of text in a shard of the first level.
SHARD_BYTES = 4 << 20
#: Bytes of text for which there is a bucket of hashes, and one of documents: what a task holds at once.
BUCKET_BYTES = 2 << 20

#: The key of a null identifier, and the bits of a place below the row's rank among those of its key.
LAST, PLACE_BITS = (1 << 63) - 1, 32

_ENTRIES = "bucket int, settled boolean, hashes binary, docs binary, places binary"
_VERDICTS = "shard int, docs binary, places binary"


def _sliding_first_min(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value among g[i : i + width], for each i where that fits."""
    at = np.arange(len(g))
    have = 1
    while have < width:
        step = min(have, width - have)
        n = len(at) - step
        if n <= 0:
            return np.zeros(0, np.int64)
        a, b = at[:n], at[step:]
        at = np.where(g[b] < g[a], b, a)
        have += step
    return at


def _windows(block: Block, base: int, window: int):
    """Of the block's target windows: text, start in the text, anchor's start in the text; and the base windows' hashes with bounds."""
    w = words(block, SPACED)
    grams, bounds = ngrams(w, base)
    count = np.diff(w.bounds)
    n = np.maximum(count - window + 1, 0)
    text = np.repeat(np.arange(len(count)), n)
    start = spread(np.zeros(len(count), np.int64), n)
    anchor = _sliding_first_min(grams, window - base + 1)
    first = bounds[:-1][text]
    return text, start, (anchor[first + start] - first) if len(text) else start, grams, bounds


def _pack(bucket, settled, hashes, docs, places):
    """Rows of entries by bucket, in the order of the documents."""
    if not len(docs):
        return None
    order = np.argsort(bucket, kind="stable")
    bucket, hashes, docs, places = bucket[order], hashes[order], docs[order], places[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    blob = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.full(len(cut) - 1, settled)), blob(hashes), blob(docs), blob(places.astype(np.int64))], names=["bucket", "settled", "hashes", "docs", "places"])


def _shard_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    """Keys spread over shards, also those with a common stride."""
    x = docs.view(U)
    x = x ^ (x << U(13))
    x = x ^ (x >> U(7))
    x = x ^ (x << U(17))
    return ((x >> U(1)) % U(buckets)).astype(np.int32)


def _shard_column(key: Column, buckets: int) -> Column:
    """The same number as `_shard_of`."""
    x = key.bitwiseXOR(F.shiftleft(key, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    x = x.bitwiseXOR(F.shiftleft(x, 17))
    return (F.shiftrightunsigned(x, 1) % F.lit(buckets)).cast("int")


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(20)) % U(buckets)).astype(np.int32)


def _first_level(base: int, window: int, buckets: int):
    def run(batches):
        for batch in batches:
            ids = _keys_of(batch.column(0))
            for block in text_blocks(batch.column(1), SHARD_BYTES):
                text, _, anchor, grams, bounds = _windows(block, base, window)
                at = np.unique(bounds[:-1][text] + anchor)
                if not len(at):
                    continue
                doc = np.searchsorted(bounds, at, "right") - 1
                h, docs, places = grams[at], ids[block.first + doc], at - bounds[doc]
                yield from _candidates(h, docs, places, buckets)

    return run


def _candidates(h: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int) -> list[pa.RecordBatch]:
    """Entries of windows below the target length. What repeats here is settled, and its first is sent for other shards to see."""
    _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    often = n[inverse] > 1
    first = np.zeros(len(h), bool)
    first[np.unique(inverse, return_index=True)[1]] = True
    out = [_pack(_bucket_of(h[first], buckets), False, h[first], docs[first], places[first])]
    out.append(_pack(_shard_of(docs[often], buckets), True, np.zeros(int(often.sum()), np.uint8), docs[often], places[often]))
    return [x for x in out if x is not None]


def _verdicts(docs: np.ndarray, places: np.ndarray, buckets: int) -> pa.Table:
    shard = _shard_of(docs, buckets)
    order = np.lexsort((places, docs, shard))
    shard, docs, places = shard[order], docs[order], places[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
    blob = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    return pa.table({"shard": pa.array(shard[cut[:-1]]), "docs": blob(docs), "places": blob(places.astype(np.int64))})


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _judge(buckets: int, keep_first: bool, parts: int):
    """Of a bucket: entries whose hash, of so many 64-bit parts, occurs again, but for the first of each if `keep_first`; and all settled ones."""

    def run(rows: pa.Table) -> pa.Table:
        open_rows = rows.filter(pa.array([not x for x in rows.column("settled").to_pylist()]))
        done = rows.filter(rows.column("settled"))
        h, docs, places = _joined(open_rows.column("hashes"), U).reshape(-1, parts), _joined(open_rows.column("docs"), np.int64), _joined(open_rows.column("places"), np.int64)
        order = np.lexsort((places, docs, *h.T))
        h, docs, places = h[order], docs[order], places[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]).all(1)
        if not keep_first:
            again[:-1] |= again[1:]
        return _verdicts(np.concatenate([docs[again], _joined(done.column("docs"), np.int64)]), np.concatenate([places[again], _joined(done.column("places"), np.int64)]), buckets)

    return run


def _keys_of(ids) -> np.ndarray:
    """Identifiers as sort keys: a null one comes last."""
    return ids.fill_null(LAST).to_numpy()


def _ranks(texts: pa.Table, ids: np.ndarray) -> np.ndarray:
    """The place of each row among those of its key, in the order of their texts; rows that compare equal here are equal."""
    rank = np.zeros(len(ids), np.int64)
    _, inverse, n = np.unique(ids, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n[inverse] > 1)
    if len(shared):
        null = texts.column("doc_id").is_null().to_pylist()
        text = dict(zip(shared.tolist(), texts.column("text").take(pa.array(shared)).to_pylist(), strict=True))
        order = sorted(shared.tolist(), key=lambda i: (ids[i], null[i], text[i]))
        for before, i in zip(order, order[1:]):
            rank[i] = rank[before] + 1 if ids[i] == ids[before] else 0
    return rank


def _of_key(verdicts: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verdicts of the first level as (row among `ids`, place), for every row of the key."""
    docs, places = _joined(verdicts.column("docs"), np.int64), _joined(verdicts.column("places"), np.int64)
    order = np.argsort(ids, kind="stable")
    lo, hi = (np.searchsorted(ids[order], docs, side) for side in ("left", "right"))
    return order[spread(lo, hi - lo)], np.repeat(places, hi - lo)


def _of_row(verdicts: pa.Table, ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verdicts of the last level, which name the row of the key, as (row among `ids`, place)."""
    docs, places = _joined(verdicts.column("docs"), np.int64), _joined(verdicts.column("places"), np.int64)
    order = np.lexsort((rank, ids))
    return order[np.searchsorted(ids[order], docs) + (places >> PLACE_BITS)], places & ((1 << PLACE_BITS) - 1)


def _next_level(size: int, window: int, buckets: int):
    """Extend the target windows whose anchors of `size` words survive to anchors of twice that, or to the targets themselves."""

    def run(texts: pa.Table, verdicts: pa.Table) -> pa.Table:
        out = []
        if verdicts.num_rows and texts.num_rows:
            ids = _keys_of(texts.column("doc_id"))
            rank = _ranks(texts, ids)
            row, place = _of_key(verdicts, ids)
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            docs, starts, hashes = [], [], []
            for block in text_blocks(texts.column("text"), SHARD_BYTES):
                text, start, anchor, grams, bounds = _windows(block, size, window)
                lo, hi = np.searchsorted(row, [block.first, block.first + len(block.bounds) - 1])
                alive = np.zeros(len(grams), bool)
                at = bounds[row[lo:hi] - block.first] + place[lo:hi]
                # A verdict can be another row's that shares the identifier and is longer.
                alive[at[at < bounds[row[lo:hi] - block.first + 1]]] = True
                first = bounds[:-1][text]
                keep = alive[first + anchor]
                if 2 * size < window:
                    _, _, anchor, grams, bounds = _windows(block, 2 * size, window)
                    at = np.unique((bounds[:-1][text] + anchor)[keep])
                    doc = np.searchsorted(bounds, at, "right") - 1
                    hashes.append(grams[at])
                    docs.append(ids[block.first + doc])
                    starts.append(at - bounds[doc])
                    continue
                at = (first + start)[keep]
                a, b, c = grams[at], grams[at + size // 2], grams[at + size]
                hashes.append(np.stack([mix(a * U(0x2545F4914F6CDD1D) + c), mix(mix(a * U(0x9E3779B97F4A7C15) + b) * U(0xD1342543DE82EF95) + c)], 1))
                docs.append(ids[block.first + text[keep]])
                starts.append((rank[block.first + text[keep]] << PLACE_BITS) | start[keep])
            h, docs, places = np.concatenate(hashes), np.concatenate(docs), np.concatenate(starts)
            out = _candidates(h, docs, places, buckets) if 2 * size < window else _targets(h, docs, places, buckets)
        return pa.Table.from_batches(out) if out else pa.table({"bucket": pa.array([], pa.int32()), "settled": pa.array([], pa.bool_()), "hashes": pa.array([], pa.binary()), "docs": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})

    return run


def _targets(h: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int) -> list[pa.RecordBatch]:
    """Entries of target windows. All but the first of equal ones are settled here, and the first is sent."""
    order = np.lexsort((places, docs, *h.T))
    later = np.zeros(len(h), bool)
    later[order[1:]] = (h[order[1:]] == h[order[:-1]]).all(1)
    out = [_pack(_bucket_of(h[~later, 0], buckets), False, h[~later], docs[~later], places[~later])]
    out.append(_pack(_shard_of(docs[later], buckets), True, np.zeros(int(later.sum()), np.uint8), docs[later], places[later]))
    return [x for x in out if x is not None]


def _finish(window: int):
    def run(texts: pa.Table, verdicts: pa.Table) -> pa.Table:
        ids = _keys_of(texts.column("doc_id"))
        row, place = _of_row(verdicts, ids, _ranks(texts, ids)) if verdicts.num_rows else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        n_words, n_removed, kept_text, spans = [], [], [], []
        for i, text in enumerate(texts.column("text").to_pylist()):
            parts = (text or "").encode().split()
            own = place[cut[i] : cut[i + 1]]
            n_words.append(len(parts))
            found = []
            if len(own):
                gap = np.flatnonzero(np.diff(own) > window)
                found = list(zip(own[np.concatenate([[0], gap + 1])].tolist(), (own[np.concatenate([gap, [len(own) - 1]])] + window).tolist(), strict=True))
                total, at, kept = len(parts), 0, []
                for a, b in found:
                    kept += parts[at:a]
                    at = b
                parts = kept + parts[at:total]
            n_removed.append(n_words[-1] - len(parts))
            kept_text.append(b" ".join(parts).decode())
            spans.append([{"start": a, "end": b} for a, b in found])
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept_text, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, doublings: int = DOUBLINGS) -> DataFrame:
    """Remove each word that lies in a window that also starts earlier.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one
    space) and removed (word spans, end exclusive). Words are runs without ASCII
    white space, unchanged; windows lie in one document and are judged on the
    input; earlier is a smaller identifier, or an earlier start in the same
    document. A null identifier is larger than any other, and rows that share
    one are documents of their own, in the order of their texts; one task looks
    at all of them. A null, empty or wordless text has no words; a text shorter
    than a window loses nothing. An empty table gives an empty result; other
    columns are not looked at. `window` must be divisible by two `doublings` times.
    """
    size = window >> doublings
    if doublings < 1 or size << doublings != window or not size:
        raise ValueError("window must be divisible by two as often as lengths double")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    volume = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = (1 + volume // BUCKET_BYTES) | 1
    texts = docs.withColumn("shard", _shard_column(F.coalesce("doc_id", F.lit(LAST)), buckets))
    judge = lambda rows, last: rows.groupBy("bucket").applyInArrow(_judge(buckets, last, 2 if last else 1), _VERDICTS)
    back = lambda verdicts, step, schema: texts.groupBy("shard").cogroup(verdicts.groupBy("shard")).applyInArrow(step, schema)
    entries = docs.mapInArrow(_first_level(size, window, buckets), _ENTRIES)
    while size < window:
        # Windows that are alone at this length go no further.
        entries = back(judge(entries, False), _next_level(size, window, buckets), _ENTRIES)
        size *= 2
    return back(judge(entries, True), _finish(window), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words or more, over all of `documents`."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM p),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
word AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
