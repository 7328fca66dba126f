"""Rows without identifier, and rows that share one, in the operators and stages that join by it."""

from opsloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from opsloom.llm.sentence_sampling import sample_segmentations
from opsloom.llm.substring_dedup import remove_repeats

A, B, C, D = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
# 5: two rows, same text; 6: two texts, one of them linked with 3; nulls: one of its own, one a copy of 3, one wordless.
ROWS = [(3, A), (5, B), (5, B), (6, A + " end"), (6, C), (None, D), (None, A), (None, None)]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_near_components(spark):
    got = sorted(map(repr, near_duplicates(frame(spark)).select("doc_id", "n_shingles", "component_id", "kept", "class_id").collect()))
    row = lambda *v: "Row(doc_id={}, n_shingles={}, component_id={}, kept={}, class_id={})".format(*v)
    want = [row(3, 56, 3, True, 3), row(5, 56, 5, True, 5), row(5, 56, 5, True, 5), row(6, 57, 3, False, 6), row(6, 56, 6, True, 6), row(None, 56, None, True, None), row(None, 56, 3, False, 3), row(None, 0, None, True, None)]
    assert got == sorted(want)


def test_near_stage(spark):
    got = sorted(map(repr, map(tuple, drop_near_duplicates(frame(spark)).collect())))
    assert got == sorted(map(repr, [(3, A), (5, B), (5, B), (6, C), (None, D), (None, None)]))


def test_segmentations(spark):
    """As many rows, and as exact ones, as the same texts have under identifiers of their own."""
    rows = sample_segmentations(frame(spark), checked=True).collect()
    assert all(r.exact for r in rows)
    alone = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    want = sorted(repr(ROWS[r.doc_id][0]) for r in sample_segmentations(alone).collect())
    assert sorted(repr(r.doc_id) for r in rows) == want and want.count("None") > 2
    first = [tuple(r.ids) for r in rows if r.doc_id == 5 and r["sample"] == 1]
    assert len(first) == 2 and first[0] == first[1]


def test_repeats(spark):
    docs = [*ROWS, (7, B + " " + C), (9, "x y " + D), (9, " ".join(A.split()[:40])), (9, "p q")]
    got = sorted(map(repr, map(tuple, remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).select("doc_id", "n_words", "n_removed", "kept_text").collect())))
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, want = set(), []
    for d, t in order:
        w, gone = (t or "").split(), set()
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if g in seen else set()
            seen.add(g)
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(map(repr, want))
