"""Suffix arrays, longest matches and hit words against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from opsloom.llm import decontaminate as d
from opsloom.llm.textarrow import ALNUM_LOWER, text_blocks, words

RNG = np.random.default_rng(4)


def some_text(n, vocabulary):
    return " ".join(f"w{i}" for i in RNG.integers(0, vocabulary, n))


LONG = some_text(300, 8)
TEXTS = [None, "", "the", "the the the the the", some_text(80, 2), some_text(400, 30), "A b-c " + LONG + " z", LONG, LONG, "x " * 500, "!!"]
ITEMS = ["the", "The", LONG, some_text(12, 2), some_text(30, 30) + " the", None, "", "w1 w2", "x x x x x x x x x x x x the", LONG[:200] + " the"]


def split(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def shard_of(texts):
    return d.make_shard(words(next(text_blocks(pa.array(texts, pa.string()), 1 << 30)), ALNUM_LOWER))


def test_order_is_that_of_the_suffixes():
    s = shard_of(TEXTS)
    code = s.code.tolist()
    assert s.order.tolist() == sorted(range(len(code)), key=lambda i: code[i : i + 1200])


def test_longest_matches():
    s, items = shard_of(TEXTS), d.make_slice([f"i{k}" for k in range(len(ITEMS))], ITEMS)
    got = d.search(s, items)
    docs, own = [split(t) for t in TEXTS], [split(t) for t in ITEMS]
    starts = [(k, i) for k, w in enumerate(own) for i in range(len(w))]
    assert len(starts) == len(items.at)
    for (k, i), common, place in zip(starts, got.common.tolist(), got.place.tolist(), strict=True):
        best = 0
        for w in docs:
            for j in range(len(w)):
                n = 0
                while j + n < len(w) and i + n < len(own[k]) and w[j + n] == own[k][i + n]:
                    n += 1
                best = max(best, n)
        assert common == best
        if best:
            t, o = s.text[place], s.offset[place]
            assert docs[t][o : o + best] == own[k][i : i + best]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 200])
def test_hit_words(spark, slice_bytes):
    """Also in several passes, over columns with clashing names, and with equal rows and items."""
    rows = [(i, t, "s", "b", 3) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "s", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, best string, bench_hit int")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(ITEMS)], "item_id int, text string")
    out = d.find_benchmark(docs, bench, slice_bytes=slice_bytes).collect()
    assert len(out) == len(rows) and all(r.spans == "s" and r.best == "b" for r in out)
    for r in out:
        w, hit, items = split(TEXTS[r.doc_id]), set(), set()
        for k, t in enumerate(ITEMS):
            own = split(t)
            n = min(10, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items.add(str(k))
        assert (r.bench_words, r.bench_hit, r.bench_items) == (len(w), len(hit), sorted(items))
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {r.doc_id for r in out if not r.bench_hit}


def test_common_words_list_no_candidates():
    """Items that end in a frequent word meet a text of nothing else without a row for each pair."""
    s = shard_of(["the " * 100_000])
    items = d.make_slice(list(range(400)), [some_text(11, 1000) + " the" for _ in range(400)])
    got = d.search(s, items)
    assert int((got.high - got.low).sum()) == 0 and (got.common[items.left == 1] == 1).all()
