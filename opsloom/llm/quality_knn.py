"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are words, hashed, and the shapes of a text: four-grams of byte classes,
and how its words repeat and how long they are. Labelled rows span a latent space
(the leading right singular vectors of their weighted term matrix). Their vectors
travel to every task; each document's cosines with all of them are computed in
blocks, and the nearest vote with their similarity.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, lean, table
from .textarrow import ALNUM_LOWER, SPACED, Block, text_blocks, words

#: Hashed shape terms; terms of repeats and lengths after them; then hashed words.
SHAPES, HABITS, WORDS = 1024, 32, 1024
TERMS = SHAPES + HABITS + WORDS
#: Labelled rows at most that are learned from: those with the smallest hash of the identifier.
LABELLED = 4000
#: Dimensions of the latent space, neighbours that vote, and the power of their similarity.
LATENT, NEIGHBOURS, POWER = 40, 15, 8
#: Cosines that differ by less than this are alike.
TIE = 1e-6
#: Documents in a block of cosines, and of terms.
BLOCK, ROWS = 512, 2048

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 1


def term_counts(block: Block) -> np.ndarray:
    """Texts x TERMS counts."""
    n = len(block.bounds) - 1
    c = _CLASS[block.data]
    text = np.repeat(np.arange(n), np.diff(block.bounds))
    out = np.zeros((n, TERMS), np.float32)
    if len(c) > 3:
        gram = (c[:-3] << np.uint32(24)) | (c[1:-2] << np.uint32(16)) | (c[2:-1] << np.uint32(8)) | c[3:]
        cell = (gram * np.uint32(2654435761)) >> np.uint32(22)
        same = text[:-3] == text[3:]
        out[:, :SHAPES] = np.bincount(text[:-3][same] * SHAPES + cell[same].astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
    w = words(block, SPACED)
    of = np.repeat(np.arange(n), np.diff(w.bounds))
    for k, gap in enumerate((1, 2, 3, 4, 8)):  # a word that stands there already so many words before
        if len(of) > gap:
            again = (w.hashes[gap:] == w.hashes[:-gap]) & (of[gap:] == of[:-gap])
            out[:, SHAPES + k] = np.bincount(of[gap:][again], minlength=n)
    length = np.minimum(w.end - w.start, 25).astype(np.int64) - 1
    if len(of):
        out[:, SHAPES + 6 : SHAPES + 31] = np.bincount(of * 25 + length, minlength=n * 25).reshape(n, 25)
        w = words(block, ALNUM_LOWER)
        of = np.repeat(np.arange(n), np.diff(w.bounds))
        out[:, SHAPES + HABITS :] = np.bincount(of * WORDS + (w.hashes >> np.uint64(54)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    return out


class Neighbours(NamedTuple):
    weights: np.ndarray  # of the terms
    axes: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # labelled rows x latent dimensions, of length 1
    labels: np.ndarray
    prior: float


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Roots of the terms' shares, shapes and words each among their own, times their weights."""
    x = np.empty_like(counts)
    for part in (slice(0, SHAPES + HABITS), slice(SHAPES + HABITS, TERMS)):
        x[:, part] = np.sqrt(counts[:, part] / np.maximum(counts[:, part].sum(1, keepdims=True), 1))
    return x * weights


def latent(counts: np.ndarray, weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Vectors of length 1; zero for a text without terms."""
    v = weighted(counts, weights) @ axes
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _terms(batches):
    for batch in batches:
        for block in text_blocks(batch.column(0), most=ROWS):
            rows = [x.tobytes() for x in term_counts(block)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)[block.first : block.first + len(rows)]], names=["terms", "label"])


def learn_neighbours(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> Neighbours:
    """Fit on all rows of `labelled`, whose number `bounded_sample` keeps down; the driver holds TERMS numbers for each."""
    few = labelled.select(text_col, F.col(label_col).cast("double").alias("label")).where("label IS NOT NULL")
    got = few.mapInArrow(lean(_terms), "terms binary, label double").toArrow()
    if not got.num_rows:
        return Neighbours(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    terms = np.frombuffer(b"".join(got.column("terms").to_pylist()), np.float32).reshape(-1, TERMS)
    labels = got.column("label").to_numpy()
    # The rows' order must not depend on the tasks'; rows that are equal in it are equal.
    order = sorted(range(len(terms)), key=lambda i: (terms[i].tobytes(), labels[i]))
    terms, labels = terms[order], labels[order]
    weights = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))).astype(np.float32) + 1
    x = weighted(terms, weights)
    values, axes = np.linalg.eigh(x.T @ x)
    axes = np.ascontiguousarray(axes[:, np.argsort(-values)[:LATENT]].astype(np.float32))
    return Neighbours(weights, axes, latent(terms, weights, axes), labels, float(labels.mean()))


def vote(counts: np.ndarray, model: Neighbours) -> np.ndarray:
    """Share of label 1 among the nearest labelled rows, weighted by similarity; the prior where nothing is similar.

    All rows as near as the last of NEIGHBOURS vote, so ties fall in no order.
    """
    out = np.full(len(counts), model.prior)
    k = min(NEIGHBOURS, len(model.labels))
    for a in range(0, len(counts), BLOCK) if k else ():
        v = latent(counts[a : a + BLOCK], model.weights, model.axes)
        cosine = v @ model.vectors.T
        least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
        row, near = np.nonzero(cosine >= least - TIE)
        weight = np.maximum(cosine[row, near], 0).astype(float) ** POWER
        total = np.bincount(row, weight, len(v))
        some = total > 1e-9
        out[a : a + BLOCK][some] = (np.bincount(row, weight * model.labels[near], len(v)) / np.maximum(total, 1e-9))[some]
    return np.clip(out, 0, 1)


def _score(model: Neighbours, text_at: int):
    def run(batches):
        for batch in batches:
            scores = [vote(term_counts(block), model) for block in text_blocks(batch.column(text_at), most=ROWS)]
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=batch.schema.names)

    return run


def score_quality(docs: DataFrame, model: Neighbours, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """`docs` with the column `score_col` (0 to 1, higher: better), which replaces one of that name.

    Null and empty texts count as texts without terms and get the share of label
    1 among the labelled rows, as every text does if there are none (0.5 then).
    Labels, identifiers and other columns are never looked at, and equal texts
    have equal scores. An empty table gives an empty result.
    """
    out = docs.drop(score_col).withColumn(score_col, F.lit(0.0))
    return out.mapInArrow(lean(_score(model, out.columns.index(text_col))), out.schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> Neighbours:
    """Learn `labels.quality` from the rows whose fold of five isn't 0."""
    known = labels.where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    return learn_neighbours(bounded_sample(docs, known))


def bounded_sample(docs: DataFrame, known: DataFrame, most: int = LABELLED) -> DataFrame:
    """Texts of the labelled rows with the smallest hashes; the list that is broadcast has at most `most` rows.

    Every pair of a label row and a document with its identifier is one to learn from; a null identifier has none.
    """
    few = known.where("label IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of all of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, score_col="score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
