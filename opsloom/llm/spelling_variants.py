"""Spelling variants by Aho-Corasick automata over the halves of words.

Two words differ by one code point at most only if one of the halves of the
shorter (or equally long) one stands unchanged in the other: the first at its
beginning or the second at its end. Halves are dealt by hash to shards, each of
which builds an automaton of its halves; a word goes to the shards of the three
halves that it can share with words of its own length or one less, and is
scanned there. A hit at the right offset, of a half of the right length, leaves
one half in question; the words that hold the half are found by what that half
is with one place left open, so words that share a half aren't compared two by
two. Each pair is found once: of two halves that both stand, the first counts.

Words are counted from Arrow buffers. A half that many words share is dealt over
several shards, among which its holders are split; the scanned words go to all.
"""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, table
from .textarrow import Block, text_blocks

#: A run is changed if this divides its checksum.
EVERY = 31
#: Code points of a word, at least, and its occurrences over all documents, at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A near word is a word's form if it occurs this many times as often.
FACTOR = 10
#: Rows that a shard gets, about.
SHARD_ROWS = 20_000
#: A half is split if more words hold it; more generous where words are so many that over MOST_SPLIT halves would be.
SPLIT_HALF, MOST_SPLIT = 5_000, 20_000
#: Distinct words that a task counts before it hands them on.
FLUSH = 500_000
#: Bytes of a long text that are cut into runs at a time.
PIECE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # UTF-8 of U+00C0 to U+00FF is this byte and one more


@functools.cache
def _crc_table() -> np.ndarray:
    """The byte table of the reflected polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def crc32_of(data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of many byte ranges at once; `state` is the crc32 of what precedes each."""
    t = _crc_table()
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    c = state[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    active = len(c)
    for j in range(int(length[0]) if len(length) else 0):
        active = int(np.searchsorted(-length[:active], -j, "left"))  # those longer than j
        head = c[:active]
        c[:active] = t[(head ^ data[start[:active] + j]) & 255] ^ (head >> 8)
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of letters; none crosses a bound."""
    inside = _LETTER[data]
    lead = data == _LEAD
    inside |= lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _pieces(block: Block):
    """A long text in pieces that end between runs; other blocks whole."""
    n = len(block.data)
    if len(block.bounds) != 2 or n <= 2 * PIECE:
        yield block
        return
    a = 0
    while a < n:
        b = min(n, a + PIECE)
        while b < n and (_LETTER[block.data[b]] or block.data[b] == _LEAD or block.data[b] & 0xC0 == 0x80):
            b += 1
        yield Block(block.first, block.data[a:b], np.array([0, b - a]))
        a = b


def changed_words(ids: list, block: Block, least: int = LEAST_LENGTH) -> pa.Array:
    """The runs of a block's texts, lower-cased, some with one code point taken out, that have enough code points."""
    data = block.data
    if not len(data):
        return pa.array([], pa.string())
    start, end = _runs(data, block.bounds)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    more = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])  # continuation bytes so far
    points = end - start - (more[end] - more[start])
    k = np.flatnonzero(points >= least)
    start, end, points = start[k], end[k], points[k]
    of = np.searchsorted(block.bounds, start, "right") - 1
    heads = [f"{d}:".encode() for d in ids]
    pad = np.array([len(h) for h in heads], np.int64)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    state = crc32_of(flat, np.cumsum(pad) - pad, pad, np.zeros(len(heads), np.uint32))
    crc = crc32_of(data, start, end - start, state[of])
    hit = crc % EVERY == 0
    keep = ~hit
    length = (end - start)[keep]
    offsets = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(start[keep] - offsets[:-1], length) + np.arange(offsets[-1])
    plain = pa.LargeStringArray.from_buffers(int(keep.sum()), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])).cast(pa.string())
    cut = []
    for i in np.flatnonzero(hit & (points > least)):
        w = data[start[i] : end[i]].tobytes().decode()
        p = int(crc[i]) % len(w)
        cut.append(w[:p] + w[p + 1 :])
    return pa.concat_arrays([plain, pa.array(cut, pa.string())])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts and how often they occur. Counted in each task before the shuffle."""

    def count(batches):
        held = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in text_blocks(batch.column(1)):
                own = ids[block.first : block.first + len(block.bounds) - 1]
                for piece in _pieces(block):
                    v = pc.value_counts(changed_words(own, piece, least_length))
                    for w, n in zip(v.field(0).to_pylist(), v.field(1).to_pylist()):
                        held[w] = held.get(w, 0) + n
                    if len(held) > FLUSH:
                        yield out()
                        held.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    rows = rows.select(F.coalesce(rows.columns[0], F.lit("null")).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _halves(word: Column, length: Column) -> Column:
    """(half, side, held) of a word: its own halves, and the one that it may share with shorter words only."""
    first = F.floor(length / 2).cast("int")
    shorter = F.floor((length - 1) / 2).cast("int")
    second, short_second = length - first, length - 1 - shorter
    begin = lambda n: F.struct(F.substring(word, F.lit(1), n).alias("half"), F.lit(0).alias("side"))
    end = lambda n: F.struct(F.substring(word, length - n + 1, n).alias("half"), F.lit(1).alias("side"))
    own = F.array(begin(first).withField("held", F.lit(True)), end(second).withField("held", F.lit(True)))
    extra = F.when(shorter != first, F.array(begin(shorter).withField("held", F.lit(False)))).otherwise(F.array(end(short_second).withField("held", F.lit(False))))
    return F.when((shorter != first) | (short_second != second), F.concat(own, extra)).otherwise(own)


def _search(rows: pa.Table) -> pa.Table:
    """Near pairs of a shard: every word is scanned by the automaton of the halves that the shard holds."""
    held = ({}, {})  # word -> n, by the side of the half that the shard holds
    open_at = ({}, {})  # word with one place open -> code points that fill it
    segments: dict[str, int] = {}
    scanned: dict[str, int] = {}
    for word, n, half, side, holds in zip(*(rows.column(c).to_pylist() for c in ("word", "n", "half", "side", "held"))):
        scanned[word] = n
        if holds:
            segments[half] = segments.get(half, 0) | 1 << side
            held[side][word] = n
            cut = len(half)
            for i in range(cut, len(word)) if side == 0 else range(len(word) - cut):
                key = word[:i] + "\0" + word[i + 1 :]
                open_at[side][key] = open_at[side].get(key, "") + word[i]
    out: list[tuple] = []
    if segments:
        automaton = ahocorasick.Automaton()
        for s, sides in segments.items():
            automaton.add_word(s, (len(s), sides))
        automaton.make_automaton()
        for x, n in scanned.items():
            length = len(x)
            for last, (cut, sides) in automaton.iter(x):
                for side in (0, 1):
                    if not sides >> side & 1 or last != (cut - 1 if side == 0 else length - 1):
                        continue
                    rest = range(cut, length) if side == 0 else range(length - cut)
                    if cut == (length // 2 if side == 0 else length - length // 2):
                        for i in rest:
                            for c in open_at[side].get(x[:i] + "\0" + x[i + 1 :], ""):
                                if c > x[i]:
                                    y = x[:i] + c + x[i + 1 :]
                                    out.append((x, n, y, held[side][y]))
                    short = length - 1
                    if cut == (short // 2 if side == 0 else short - short // 2):
                        for y in {x[:i] + x[i + 1 :] for i in rest}:
                            if y in held[side] and not (side == 1 and x.startswith(y[: short // 2])):
                                out.append((x, n, y, held[side][y]))
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.table({"a": pa.array(cols[0], pa.string()), "na": pa.array(cols[1], pa.int64()), "b": pa.array(cols[2], pa.string()), "nb": pa.array(cols[3], pa.int64())})


def near_words(counted: DataFrame, shard_rows: int = SHARD_ROWS, split_half: int = SPLIT_HALF) -> DataFrame:
    """(a, na, b, nb): every pair of words that differ by one inserted, deleted or replaced code point, once, with their counts.

    `counted` has distinct words with at least three code points, and n.
    """
    rows = counted.select("word", "n", F.explode(_halves(F.col("word"), F.char_length("word"))).alias("h")).select("word", "n", "h.half", "h.side", "h.held")
    total = 3 * counted.count()
    shards = max(1, total // shard_rows)
    most = max(split_half, total // MOST_SPLIT)
    # At most MOST_SPLIT halves have so many rows.
    hot = rows.groupBy("half", "side").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("half", "side", F.ceil(F.col("rows") / most).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(hot), ["half", "side"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.when(F.col("held"), F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.select("word", "n", "half", "side", own.alias("own"), F.pmod(F.xxhash64("half", "side"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = rows.select("word", "n", "half", "side", F.coalesce(F.col("own") == F.col("part"), F.lit(False)).alias("held"), "shard", "part")
    return rows.groupBy("shard", "part").applyInArrow(_search, "a string, na long, b string, nb long")


def spelling_variants(counted: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Near words, form and root of every counted word.

    `counted` has distinct words (word) and how often they occur (n). Two words
    are near if they differ by exactly one inserted, deleted or replaced code
    point. A word's form is its near word of largest n (ties: smallest in code
    point order) if that is at least `factor` times its own; its root is the last
    form of the chain, or itself. Returns word, form, root, n, n_near and form_n
    (both forms null where there is none). An empty table gives an empty result.
    """
    pairs = near_words(counted)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("x"), F.col("nb").alias("xn")), F.struct(F.col("b").alias("word"), F.col("a").alias("x"), F.col("na").alias("xn")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("xn")).alias("k"), F.col("x").alias("x"))).alias("best"))
    told = counted.join(best, "word", "left").withColumn("xn", -F.col("best.k"))
    has = F.col("xn") >= factor * F.col("n")
    told = durable(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.x")).alias("form"), F.when(has, F.col("xn")).alias("form_n")))
    # n grows by the factor with each form, so a chain has as many forms as its largest n has digits to that base; each round doubles what a word has followed.
    jump = told.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    largest = told.agg(F.max("form_n")).first()[0] or 0
    steps = 1
    while factor**steps <= largest:
        jump = durable(jump.alias("j").join(jump.select(F.col("word").alias("to"), F.col("to").alias("far")), "to", "left").select("word", F.coalesce("far", "to").alias("to")))
        steps *= 2
    found = told.join(jump, "word", "left")
    return found.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`spelling_variants` of the words of all texts.

    Runs of A-Z, a-z and U+00C0 to U+00FF are lower-cased (A-Z only); where 31
    divides h, the crc32 of `<id>:<run>`, the run's code point h % length is
    taken out. Words have at least 7 code points and 2 occurrences. Null and
    empty texts have no words; a null identifier is written `null`; rows that
    repeat count each; other columns are not looked at. A long text is read in
    pieces of a megabyte, apart from a run that is longer.
    """
    return spelling_variants(durable(count_words(docs, id_col, text_col)))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants over all of `documents`."""
    return group_spellings(table(spark, sf_dir, "documents"))


#: SQL has no crc32, so it is worked out from a byte table.
ORACLE_SQL = r"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
coded AS (SELECT run, n, length(run) AS m, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bs FROM per),
h AS (SELECT run, n, m, xor(list_reduce(list_transform(bs, lambda b: b::BIGINT), lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM coded, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % m)::BIGINT) || substring(run, (h % m)::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON w.word = c.a || c.b UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON w.word = c.a || c.b),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, last, form) AS (SELECT word, word, form FROM f UNION ALL SELECT c.word, c.form, f.form FROM chain c JOIN f ON f.word = c.form)
SELECT f.word, f.form, c.last AS root, n, n_near, form_n FROM f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
