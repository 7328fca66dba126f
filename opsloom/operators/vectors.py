"""Texts as vectors by signed feature hashing, and lessons ranked by words and vectors together."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .search import tokens

#: Places of a vector. Its name stands beside stored vectors, so that others aren't compared with them.
PLACES, MODEL = 256, "hash-v1"
# Fixed value: what a word is.
WORD = r"[0-9a-zçğıöşü_./-]+"
#: Queries that one search carries to every task, at most.
MOST_QUERIES = 10_000
#: Scores of lessons and queries that a task holds at once.
BLOCK_SCORES = 200_000


@functools.lru_cache(1 << 18)
def _feature(text: str) -> tuple[int, float]:
    h = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big")
    return h % PLACES, 1.0 if h >> 31 else -1.0


def vector(text: str | None) -> np.ndarray:
    """The vector of a text: its words, pairs of neighbouring words and, of words over three characters, their trigrams; of length 1, or zero without words."""
    words = re.findall(WORD, (text or "").lower())
    v = np.zeros(PLACES)
    for feature in (*words, *map(" ".join, zip(words, words[1:])), *(w[i : i + 3] for w in words if len(w) > 3 for i in range(len(w) - 2))):
        place, sign = _feature(feature)
        v[place] += sign
    length = np.sqrt(v @ v)
    return v / length if length else v


def with_vectors(rows: DataFrame, text_col: str = "text", out: str = "vector") -> DataFrame:
    """Rows with the vector of a text column; kept as a column, it is an index that searches read instead of the texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` array<float>"

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col)
            made = np.zeros((batch.num_rows, PLACES), np.float32)
            for k, t in enumerate(texts):
                made[k] = vector(t.as_py())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * PLACES, pa.int32()), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def finder(asked: list, arrow: list, most: int):
    """What finds the best lessons of each query (query_id, query, t) in a task's batches of lessons; `arrow` has the types of what it gives."""
    matrix = np.array([vector(r["query"]) for r in asked], np.float32).reshape(len(asked), PLACES).T.astype(np.float64)
    sizes, postings = np.array([len(r["t"]) for r in asked], np.float64), {}
    for i, r in enumerate(asked):
        for t in r["t"]:
            postings.setdefault(t, []).append(i)
    texts, ids = [r["query"] for r in asked], [r["query_id"] for r in asked]
    step = max(1, BLOCK_SCORES // max(1, len(ids)))

    def scored(names, titles, words, seen, own):
        rows, n = len(names), len(ids)
        shared, union = np.zeros((rows, n)), np.array([len(w) for w in words], np.float64)[:, None] + sizes[None, :]
        for k, mine in enumerate(words):
            for t in mine:
                if t in postings:
                    shared[k, postings[t]] += 1
        with np.errstate(divide="ignore", invalid="ignore"):
            lex = np.where(shared > 0, 0.7 * shared / sizes[None, :] + 0.3 * shared / (union - shared), 0.0)
        for k, title in enumerate(titles):
            for i in [i for i, q in enumerate(texts) if q in title] if title else []:
                lex[k, i] = max(lex[k, i], 0.6)
        score = 0.75 * lex + 0.25 * np.maximum(0.0, own @ matrix - 0.1) + np.minimum(0.1, 0.02 * (np.array(seen, np.float64) - 1))[:, None]
        return np.round(score, 6)

    def run(batches):
        # What a task holds is a block of scores and the best few of each query so far, however many lessons it reads.
        best = [[] for _ in ids]
        for batch in batches:
            for at in range(0, batch.num_rows if ids else 0, step):
                block = batch.slice(at, step)
                names, titles, words, seen = (block.column(c).to_pylist() for c in ("lesson_id", "title", "t", "occurrences"))
                own = np.array(block.column("vector").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(names), PLACES)
                score = scored(names, titles, words, seen, own)
                for i, so_far in enumerate(best):
                    low = so_far[-1][0] if len(so_far) == most else 0.02
                    good = np.flatnonzero((score[:, i] > 0.02) & (score[:, i] >= low))
                    if len(good):
                        best[i] = sorted(so_far + [(float(score[k, i]), names[k]) for k in good.tolist()], key=lambda x: (-x[0], x[1]))[:most]
        out = [(q, name, score) for q, own in zip(ids, best) for score, name in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), arrow)], names=["query_id", "lesson_id", "score"])

    return run


def ranked_lessons(queries: DataFrame, lessons: DataFrame, most: int = 6) -> DataFrame:
    """The best lessons of each query by shared words and, as a weaker signal, their vectors.

    `queries` has query_id and query; `lessons` has lesson_id, title, text,
    occurrences and vector. Shared words count by coverage of the query first, a
    query that stands in a title at least 0.6; three quarters of that and a quarter
    of the cosine beyond 0.1, and a little for occurrences. Queries, MOST_QUERIES
    at most, travel to the lessons, which are read once in blocks; a task gives
    its best few for each query. Equal scores: the smaller lesson_id.
    """
    asked = queries.select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("query"), tokens(F.coalesce("query", F.lit(""))).alias("t")).where("trim(query) <> ''").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; ask in parts")
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *lessons.schema.fields]}
    arrow = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(lessons.schema["lesson_id"].dataType), pa.float64()]

    rows = lessons.select("lesson_id", F.lower(F.coalesce("title", F.lit(""))).alias("title"), tokens(F.concat_ws(" ", "title", "text")).alias("t"), F.coalesce("occurrences", F.lit(1)).alias("occurrences"), "vector")
    found = rows.mapInArrow(finder(asked, arrow, most), f"query_id {kinds['query_id']}, lesson_id {kinds['lesson_id']}, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "lesson_id"))
    return found.withColumn("place", place).where(F.col("place") <= most)
