"""Language identification as a mixture.

Each language has a distribution over hashed letter trigrams, counted over all
learning rows. A document's trigrams are drawn from a mixture of languages whose
proportions expectation-maximisation estimates; languages leave the set as long
as that raises the penalised likelihood, so a text in one language gets one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, table
from .textarrow import Block, text_blocks

#: Buckets of the trigram hash.
CELLS = 1 << 13
#: Texts whose counts are held at a time, in an array of CELLS numbers each.
ROWS = 512
#: Steps of expectation-maximisation after each change of the set.
STEPS = 12
#: What a language costs, times the logarithm of the number of trigrams.
PENALTY = 3.0
SMOOTHING = 0.3

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def cell_counts(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, count) of the trigrams of each text, by text; runs without letters count as one blank."""
    n = len(block.bounds) - 1
    raw = block.data
    b = _LETTER[raw]
    if len(b) > 1:  # the second byte of a Latin capital with a mark
        b[1:] = np.where((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E), raw[1:] + 0x20, b[1:])
    text = np.repeat(np.arange(n), np.diff(block.bounds))
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0) | (b[:-1] != 0) | (text[1:] != text[:-1])
    b, text = b[keep].astype(np.uint32), text[keep]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    cell = ((gram * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    good = (text[:-2] == text[2:]) & ((b[:-2] != 0).astype(np.int8) + (b[1:-1] != 0) + (b[2:] != 0) > 1)
    held = np.bincount(text[:-2][good] * CELLS + cell[good], minlength=n * CELLS)
    at = np.flatnonzero(held)
    return at // CELLS, at % CELLS, held[at]


class Languages(NamedTuple):
    names: list[str]
    chances: np.ndarray  # of a cell in a language; cells x languages


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for block in text_blocks(batch.column(1), most=ROWS):
            text, cell, n = cell_counts(block)
            own = names[block.first : block.first + len(block.bounds) - 1]
            for name in set(own.tolist()):
                pick = (own == name)[text]
                total.setdefault(name, np.zeros(CELLS, np.int64))
                total[name] += np.bincount(cell[pick], weights=n[pick], minlength=CELLS).astype(np.int64)
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "cell", "n"])


def learn_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Languages:
    """Trigram distributions of all rows with a language. The driver gets CELLS sums a language."""
    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, cell int, n long")
    rows = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    counts = np.full((CELLS, len(names)), SMOOTHING)
    where = {x: i for i, x in enumerate(names)}
    counts[rows.column("cell").to_numpy(), [where[x] for x in rows.column("lang").to_pylist()]] += rows.column("n").to_numpy()
    return Languages(names, counts / counts.sum(0))


def mixtures(text: np.ndarray, cell: np.ndarray, n: np.ndarray, texts: int, chances: np.ndarray) -> np.ndarray:
    """Proportions of each language in each text; zeros where a text has no trigram."""
    share = np.zeros((texts, chances.shape[1]))
    have = np.unique(text)
    if not len(have) or not chances.shape[1]:
        return share
    row = np.searchsorted(have, text)
    first = np.searchsorted(text, have)
    total = np.add.reduceat(n, first).astype(float)

    def fit(rows: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pick = np.isin(row, rows)
        r, p, w = np.searchsorted(rows, row[pick]), chances[cell[pick]], n[pick].astype(float)
        cut = np.searchsorted(r, np.arange(len(rows)))
        theta = allowed / allowed.sum(1, keepdims=True)
        for _ in range(STEPS):
            joint = theta[r] * p
            joint *= (w / joint.sum(1))[:, None]
            theta = np.add.reduceat(joint, cut) / total[rows, None]
        return theta, np.add.reduceat(np.log((theta[r] * p).sum(1)) * w, cut)

    rows = np.arange(len(have))
    allowed = np.ones((len(have), chances.shape[1]))
    best, like = fit(rows, allowed)
    while len(rows):
        rows = rows[allowed[rows].sum(1) > 1]
        if not len(rows):
            break
        fewer = allowed[rows].copy()
        # What explains nothing leaves at once; else the smallest is tried.
        least = np.where(fewer > 0, best[rows], 2).argmin(1)
        gone = (best[rows] < 1e-3) & (fewer > 0)
        gone[np.arange(len(rows)), least] = True
        gone[np.arange(len(rows)), best[rows].argmax(1)] = False
        fewer[gone] = 0
        theta, now = fit(rows, fewer)
        better = now + PENALTY * np.log(total[rows]) * gone.sum(1) >= like[rows]
        rows, theta, now, fewer = rows[better], theta[better], now[better], fewer[better]
        best[rows], like[rows], allowed[rows] = theta, now, fewer
    share[have] = best
    return share


def _identify(model: Languages):
    def run(batches):
        for batch in batches:
            text = batch.column(1)
            top, score, mixed = [], [], []
            for block in text_blocks(text, most=ROWS):
                n = len(block.bounds) - 1
                share = mixtures(*cell_counts(block), n, model.chances)
                ascii_letter = np.zeros(len(block.data) + 1, np.int64)
                np.cumsum(((block.data | 0x20) >= 97) & ((block.data | 0x20) <= 122), out=ascii_letter[1:])
                letters = ascii_letter[block.bounds[1:]] > ascii_letter[block.bounds[:-1]]
                for i in range(n):
                    if not letters[i] and block.data[block.bounds[i] : block.bounds[i + 1]].size:
                        letters[i] = any(c.isalpha() for c in text[block.first + i].as_py())
                    if not letters[i] or not model.names:
                        top.append("und")
                        score.append(0.0)
                        mixed.append([])
                        continue
                    own = share[i] if share[i].any() else np.full(len(model.names), 1 / len(model.names))
                    k = int(own.argmax())
                    top.append(model.names[k])
                    score.append(float(min(1.0, own[k])))
                    mixed.append([{"lang": model.names[j], "share": float(own[j])} for j in np.argsort(-own, kind="stable") if own[j] > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], names=["doc_id", "lang_pred", "score", "mixture"])

    return run


def identify_languages(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each text, and the mixture that it was chosen from.

    Returns doc_id, lang_pred, score (the language's proportion) and mixture
    (languages and proportions, largest first). A text that is null, or has no
    letter, is `und` with score 0 and an empty mixture, as is any text if the
    model knows no language; a text with letters but no trigram has all
    languages alike. Of languages with equal proportions the first by name
    counts. Equal rows have equal results, each its own; an empty table gives an
    empty result; other columns are not looked at.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_identify(model), "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all of `documents`, learned from those whose fold of four isn't 2."""
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(fold("doc_id", 4) != 2))
    found = identify_languages(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
