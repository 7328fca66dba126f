"""Toxicity with a convolutional text classifier trained in numpy.

A word's vector is the sum of a hashed embedding of the word and one of its
first bytes. Filters of one, two and three words run over the whole text, their
largest responses are pooled, and a linear layer scores them. The decision
threshold is calibrated for each language group, told by the letters of the
text alone, and moved to a score of 0.5.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, table
from .textarrow import ALNUM_LOWER, Block, mix, powers, text_blocks, words

U = np.uint64
#: Rows of each embedding table, and dimensions.
ROWS, DIM = 1 << 15, 16
WIDTHS, FILTERS = (1, 2, 3), 16
#: Leading bytes of a word that have an embedding of their own.
PREFIX = 5
#: Rows of each class that are learned from at most, with their whole texts.
PER_CLASS = 1500
#: Rows in which a hashed word must occur in the sample to have an embedding.
LEAST_ROWS = 4
EPOCHS, BATCH, RATE, SEED = 5, 32, 0.01, 11
#: Words from which on a batch takes no further row.
BATCH_WORDS = 1 << 16
#: Language groups by the letters that stand out: second bytes after 0xC3.
GROUPS = {"de": (0xA4, 0xB6, 0xBC, 0x9F, 0x84, 0x96, 0x9C), "es": (0xB1, 0xA1, 0xAD, 0xB3, 0xBA, 0x91), "fr": (0xA8, 0xAA, 0xA7, 0xA0, 0xB4, 0x88, 0x8A, 0x87)}
NAMES = ("plain", *GROUPS)


def word_rows(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the word and prefix embeddings for each word, and the texts' bounds."""
    w = words(block, ALNUM_LOWER)
    if not len(w.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.bounds
    m = ALNUM_LOWER[block.data]
    up, down = powers(len(m))
    sums = np.zeros(len(m) + 1, U)
    np.cumsum(m * up[: len(m)], out=sums[1:])
    stop = np.minimum(w.start + PREFIX, w.end)
    prefix = mix((sums[stop] - sums[w.start]) * down[w.start] + U(77))
    return (w.hashes >> U(49)).astype(np.int64), (prefix >> U(49)).astype(np.int64), w.bounds


def groups(block: Block) -> np.ndarray:
    """Language group of each text: the letters with marks that are most frequent, if one in 200 bytes is such."""
    n = len(block.bounds) - 1
    text = np.repeat(np.arange(n), np.diff(block.bounds))
    second = np.flatnonzero(block.data[:-1] == 0xC3) + 1
    counts = np.stack([np.bincount(text[second[np.isin(block.data[second], marks)]], minlength=n) for marks in GROUPS.values()], 1)
    best = counts.argmax(1) + 1
    return np.where(counts.max(1) * 200 >= np.maximum(np.diff(block.bounds), 1), best, 0)


class Net(NamedTuple):
    word: np.ndarray
    prefix: np.ndarray
    filters: list  # of each width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    constant: float
    thresholds: np.ndarray  # of each language group
    scale: float


class Laid(NamedTuple):
    """Word vectors of some texts one after the other, with zeros between them."""

    x: np.ndarray
    first: np.ndarray  # position of each text's first word
    count: np.ndarray
    at: np.ndarray  # position of each word


def lay(net: Net, word: np.ndarray, prefix: np.ndarray, bounds: np.ndarray) -> Laid:
    n, reach = len(bounds) - 1, max(WIDTHS) - 1
    count = np.diff(bounds)
    at = np.arange(len(word)) + np.repeat(np.arange(n) * reach, count)
    x = np.zeros((len(word) + (n + 1) * reach, DIM), np.float32)
    x[at] = net.word[word] + net.prefix[prefix]
    return Laid(x, bounds[:-1] + np.arange(n) * reach, count, at)


def responses(net: Net, laid: Laid, k: int) -> np.ndarray:
    """Response of the filters of one width at every position; past a text's end they read zeros."""
    reach = max(WIDTHS) - 1
    n = len(laid.x) - reach
    z = laid.x[:n] @ net.filters[k][0]
    for j in range(1, WIDTHS[k]):
        z += laid.x[j : n + j] @ net.filters[k][j]
    return z


def pooled(net: Net, laid: Laid) -> np.ndarray:
    """Largest response of each filter in each text, at least 0; 0 in a text without words."""
    held = np.zeros((len(laid.count), len(WIDTHS) * FILTERS), np.float32)
    some = np.flatnonzero(laid.count)
    if len(some):
        edges = np.stack([laid.first[some], laid.first[some] + laid.count[some]], 1).ravel()
        for k in range(len(WIDTHS)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            z = np.concatenate([responses(net, laid, k), np.full((1, FILTERS), -np.inf, np.float32)])
            held[some, cols] = np.maximum(np.maximum.reduceat(z, edges, axis=0)[::2] + net.bias[cols], 0)
    return held


def logits(net: Net, block: Block) -> np.ndarray:
    return pooled(net, lay(net, *word_rows(block))) @ net.out + net.constant


def scores(net: Net, block: Block) -> np.ndarray:
    """0 to 1; 0.5 is the calibrated threshold of the text's language group."""
    z = (logits(net, block) - net.thresholds[groups(block)]) / net.scale
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _share_tables(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, which: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """An embedding table that begins with the smoothed log odds of each row, and the rows that occur often enough."""
    seen = np.zeros((2, ROWS))
    for r, label in zip(rows, y, strict=True):
        seen[int(label), np.unique(r[which])] += 1
    often = seen.sum(0) >= LEAST_ROWS
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    made = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
    made[:, 0] = np.clip(odds, -2, 4)
    made[~often] = 0
    return made, often


def _batches(order: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]):
    """Cut a permutation into batches of BATCH rows, or fewer where they are long."""
    part, size = [], 0
    for i in order.tolist():
        part.append(i)
        size += len(rows[i][0])
        if len(part) == BATCH or size >= BATCH_WORDS:
            yield np.array(part)
            part, size = [], 0
    if part:
        yield np.array(part)


def train(rows: list[tuple[np.ndarray, np.ndarray]], group: np.ndarray, y: np.ndarray) -> Net:
    """Adam on the log loss, then thresholds. One row in five is held back for them."""
    rng = np.random.default_rng(SEED)
    held_back = np.arange(len(y)) % 5 == 0
    fit = np.flatnonzero(~held_back)
    own = [rows[i] for i in fit]
    word, often_word = _share_tables(own, y[fit], 0, rng)
    prefix, often_prefix = _share_tables(own, y[fit], 1, rng)
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2])  # half begin by looking for what the odds say
    wide = len(WIDTHS) * FILTERS
    net = Net(word, prefix, filters, np.zeros(wide, np.float32), rng.normal(0, 0.1, wide).astype(np.float32), 0.0, np.zeros(len(NAMES)), 1.0)
    params = {"word": word, "prefix": prefix, "bias": net.bias, "out": net.out, "constant": np.zeros(1, np.float32)} | {f"f{k}": f for k, f in enumerate(filters)}
    moment = {n: (np.zeros_like(p), np.zeros_like(p)) for n, p in params.items()}
    step = 0
    for _ in range(EPOCHS):
        for part in _batches(rng.permutation(fit), rows):
            step += 1
            n = [len(rows[i][0]) for i in part]
            bounds = np.concatenate([[0], np.cumsum(n)])
            w, p = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            laid = lay(net, w, p, bounds)
            back = np.full(len(laid.x), -1)
            back[laid.at] = np.arange(len(w))
            top = np.zeros((len(part), wide), np.float32)
            where = np.zeros((len(part), wide), np.int64)
            for k in range(len(WIDTHS)):
                z = responses(net, laid, k)
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for i in np.flatnonzero(laid.count).tolist():
                    span = z[laid.first[i] : laid.first[i] + laid.count[i]]
                    where[i, cols] = span.argmax(0) + laid.first[i]
                    top[i, cols] = span.max(0)
            pre = top + net.bias
            h = np.where((laid.count > 0)[:, None], np.maximum(pre, 0), 0)
            chance = 1 / (1 + np.exp(-np.clip(h @ net.out + params["constant"][0], -30, 30)))
            err = ((chance - y[part]) / len(part)).astype(np.float32)
            dh = err[:, None] * net.out * ((pre > 0) & (laid.count > 0)[:, None])
            grad = {"out": h.T @ err, "constant": np.array([err.sum()], np.float32), "bias": dh.sum(0), "word": np.zeros_like(word), "prefix": np.zeros_like(prefix)}
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g = np.zeros_like(filters[k])
                for j in range(width):
                    pos = where[:, cols] + j
                    g[j] = np.einsum("dfe,df->ef", laid.x[pos], dh[:, cols])
                    dx = dh[:, cols, None] * filters[k][j].T[None]
                    real = back[pos] >= 0
                    np.add.at(grad["word"], w[back[pos][real]], dx[real])
                    np.add.at(grad["prefix"], p[back[pos][real]], dx[real])
                grad[f"f{k}"] = g
            grad["word"][~often_word] = 0
            grad["prefix"][~often_prefix] = 0
            for name, value in params.items():
                m, v = moment[name]
                m += 0.1 * (grad[name] - m)
                v += 0.001 * (grad[name] ** 2 - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = net._replace(constant=float(params["constant"][0]))
    z = np.array([float((pooled(net, lay(net, *rows[i], np.array([0, len(rows[i][0])]))) @ net.out + net.constant)[0]) for i in range(len(y))])
    return net._replace(thresholds=_calibrate(z[held_back], y[held_back], group[held_back]), scale=float(max(1e-3, np.abs(z).mean() / 4)))


def _calibrate(z: np.ndarray, y: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each language group, the middle of the cut with the fewest errors; groups with few rows of a class take that of all."""

    def cut(pick):
        order = np.argsort(z[pick], kind="stable")
        a, b = z[pick][order], y[pick][order]
        wrong = np.concatenate([[0], np.cumsum(b)]) / max(1, b.sum()) + (len(b) - b.sum() - np.concatenate([[0], np.cumsum(1 - b)])) / max(1, (1 - b).sum())
        edge = np.concatenate([[a[0] - 1], (a[1:] + a[:-1]) / 2, [a[-1] + 1]])
        best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        return float((edge[best[0]] + edge[best[-1]]) / 2)

    whole = np.ones(len(z), bool)
    if not len(z) or y.min() == y.max():
        return np.zeros(len(NAMES))
    common = cut(whole)
    out = np.full(len(NAMES), common)
    for g in range(len(NAMES)):
        pick = group == g
        if pick.sum() and min(y[pick].sum(), (1 - y[pick]).sum()) >= 15:
            out[g] = cut(pick)
    return out


def _rows(batches):
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            w, p, bounds = word_rows(block)
            n = len(bounds) - 1
            blob = lambda x: pa.array([x[a:b].astype(np.uint16).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            rows = slice(block.first, block.first + n)
            yield pa.RecordBatch.from_arrays([batch.column(0)[rows], blob(w), blob(p), pa.array(groups(block).astype(np.int32)), batch.column(2)[rows]], names=["doc_id", "w", "p", "g", "label"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS) -> Net | None:
    """Train on at most `per_class` identifiers of each class, those with the smallest hashes, and their whole texts.

    `labels` (doc_id, `label_col`) holds only rows that may be learned from; an
    identifier that any of its rows calls toxic is toxic. None if a class has no rows.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("label"))
    few = known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).unionByName(known.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    some = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "label")
    got = some.mapInArrow(_rows, "doc_id long, w binary, p binary, g int, label int").toArrow()
    y = got.column("label").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return None
    ids, blobs = got.column("doc_id").to_pylist(), list(zip(got.column("w").to_pylist(), got.column("p").to_pylist(), strict=True))
    # The rows' order must not depend on the tasks'; rows that are equal in it are equal.
    order = sorted(range(len(y)), key=lambda i: (ids[i], *blobs[i]))
    rows = [tuple(np.frombuffer(x, np.uint16).astype(np.int64) for x in blobs[i]) for i in order]
    return train(rows, got.column("g").to_numpy()[order], y[order])


def _score(net: Net | None, text_at: int):
    def run(batches):
        for batch in batches:
            made = [scores(net, block) for block in text_blocks(batch.column(text_at))] if net else [np.zeros(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(made).astype(float) if made else np.zeros(0))], names=batch.schema.names)

    return run


def score_toxicity(docs: DataFrame, net: Net | None, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """`docs` with the column `score_col` (0 to 1; from 0.5 on: toxic), which replaces one of that name.

    Null, empty and wordless texts get the score of a text in which no filter
    responds. Without a net every score is 0. Labels, identifiers and other
    columns are never looked at, and equal texts have equal scores. An empty
    table gives an empty result.
    """
    out = docs.drop(score_col).withColumn(score_col, F.lit(0.0))
    return out.mapInArrow(_score(net, out.columns.index(text_col)), out.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all of `documents`, learned from the labelled rows whose fold of five isn't 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = learn_toxicity(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = score_toxicity(docs, net, score_col="score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
