"""The conversation trie, license scans and spelling variants against plain Python, and on hard rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import conversation_trie, license_scan, spelling_variants

CLASHES = ["conv", "depth", "a", "b", "block", "pos", "digest", "chars", "_id", "_text", "word", "n", "form", "base", "blocks", "n_words", "half", "k"]


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def trie(rows):
    """The contract, conversation by conversation."""
    tie = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, tie(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        made = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append(c)
        ends[tuple(made)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def found_trie(df):
    out = conversation_trie.rebuilt_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[1]))


def test_trie_with_hot_turns_and_a_deep_conversation(spark):
    rnd = random.Random(5)
    rows = []
    for c in [*range(0, 330), -7, -250, 2**40 + 3]:
        for t in range(rnd.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "same start" if t == 0 else f"tur{rnd.randrange(2)}é\U0001f600"))
    rows += [(100, t, "user", f"long {t}") for t in range(20, 700)]  # a conversation with about a third of all rows
    assert found_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)) == trie(rows)


def test_trie_on_hard_rows(spark):
    rows = [(0, None, "user", "x"), (0, 1, None, None), (0, 1, "user", ""), (0, 1, "user", "y"), (0, 1, "user", "y"), (5, 0, "user", "z" * 1_000_000), (None, 0, "user", "x"), (205, 1, "user", "w"), (200, None, None, None)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found_trie(df) == trie(rows)
    assert found_trie(df.limit(0)) == []


def test_end_digests_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    import pyarrow as pa

    rows = [(1, 2, c) for c in range(8)] + [(1, 3, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part)], names=["a", "b", "conv"]) for part in (rows[:4], rows[4:])]
    pieces = [r for b in conversation_trie._pieces(batches) for r in b.to_pylist()]
    assert [r["ids"] for r in pieces] == ["0,1,2", "3,4,5", "6,7", "9"]
    shas = [r for b in conversation_trie._digests([pa.RecordBatch.from_pylist(pieces)]) for r in b.to_pylist()]
    assert [r["sha"] for r in shas] == [hashlib.sha256(x).hexdigest() for x in (b"0,1,2,3,4,5,6,7", b"9")]


def scanned(text, templates, phrases, least):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = sorted((i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    met = []
    for label, t in templates:
        t = t.lower().split()
        s = 1 << (len(t) - 1).bit_length()
        for k in range(0, len(w), s):
            share = len(set(w[k : k + 2 * s]) & set(t)) / len(set(t))
            if math.ceil(least * len(set(t)) - 1e-9) <= round(share * len(set(t))):
                met.append((k, min(2 * s, len(w) - k), label, share))
    return len(w), base, sorted(met)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_license_blocks_against_all_pairs(spark, monkeypatch, least):
    rnd = random.Random(3)
    templates = [(f"t{i}", " ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(1, 12)))) for i in range(12)]
    phrases = [("a b", "ab"), ("a a", "aa"), ("c", "c")]
    # Common words first, so that a document's block has rare and common ones; one text is read in many pieces.
    texts = [" ".join(rnd.choice("aaaabbbccdefghijklmnopxyzé") for _ in range(rnd.randrange(0, 80))) for _ in range(60)]
    texts += [" ".join(rnd.choice("abcdefghijklmnopxyz") for _ in range(4000)), None, "", "..", "A--B\nA", "a" * 9000 + " b c"]
    monkeypatch.setattr(license_scan, "BLOCK_BYTES", 500)
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a b")]
    vocabulary = license_scan._vocabulary(templates, phrases)
    import pyarrow as pa

    counts = np.zeros(len(vocabulary), np.int64)
    for f in license_scan._texts(pa.array([t for _, t in rows]), vocabulary, np.arange(len(vocabulary))):
        counts += np.bincount(f.number, minlength=len(counts))
    ix = license_scan._index(vocabulary, counts, templates, phrases, least)
    got = [(f.n_words, license_scan._phrase_places(f, ix), license_scan._met(f, ix)) for f in license_scan._texts(pa.array([t for _, t in rows]), ix.hashes, ix.number)]
    assert got == [scanned(t, templates, phrases, least) for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = license_scan.scan_licenses(clashing(df), templates, phrases, least)
    assert out.columns == ["doc_id", "n_words", "base", "blocks"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, [tuple(b) for b in r.base], [tuple(b) for b in r.blocks]) for r in out.collect()), key=key) == sorted(((d, *scanned(t, templates, phrases, least)) for d, t in rows), key=key)
    assert license_scan.scan_licenses(df.limit(0), templates, phrases, least).count() == 0
    assert (license_scan.word_counts(df, vocabulary) == counts).all()


def test_license_templates_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        license_scan.scan_licenses(spark.createDataFrame([(1, "x")], "doc_id long, text string"))


def near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def variants(counts):
    by = {w: sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: b[0] if b and counts[b[0]] >= 10 * counts[w] else None for w, b in by.items()}
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(by[w]), counts.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("split, rows", [(5_000, 20_000), (20, 50)])
def test_spellings_against_all_pairs(spark, split, rows):
    """Words over few letters, a third with one beginning; halves that are split, and many shards."""
    rnd = random.Random(9)
    counts = {}
    while len(counts) < 500:
        n = rnd.choice([7, 7, 8, 8, 9, 10])
        w = "".join(rnd.choice("abé") for _ in range(n))
        counts["abcdef" + w[:3] if rnd.random() < 0.33 else w] = rnd.choice([2, 3, 5, 60, 700, 9000, 120000])
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    pairs = [(min(r.a, r.b), max(r.a, r.b)) for r in spelling_variants.near_words(df, rows, split).collect()]
    assert sorted(pairs) == sorted(tuple(sorted(p)) for p in itertools.combinations(counts, 2) if near(*p))
    out = spelling_variants.spelling_variants(df)
    assert sorted(map(tuple, out.select("word", "form", "root", "n", "n_near", "form_n").collect())) == variants(counts)


def test_words_on_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "PIECE", 200)
    rnd = random.Random(1)
    prose = " ".join("".join(rnd.choice("abcÉéÿÀ÷") for _ in range(rnd.choice([6, 7, 8, 9]))) for _ in range(3000))
    rows = [(1, prose), (1, prose), (2, None), (3, ""), (None, "Résumés Resumes RESUMES œuvresÿ 中文xyzabcd"), (4, "a" * 3000), (5, "ÄÖÜäöüß_ÄÖÜäöüß"), (6, "x÷y×zabcd " * 3)]
    want = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.word: r.n for r in spelling_variants.count_words(df, least_count=1).collect()}
    assert got == dict(want)
    assert spelling_variants.group_spellings(df.limit(0)).count() == 0
