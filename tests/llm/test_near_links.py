"""Links that the signatures alone would call too far apart."""

import numpy as np
import pyarrow as pa

from opsloom.llm import components, near_dedup


def test_pair_with_far_signatures_is_linked(monkeypatch):
    base = [f"w{i}" for i in range(39)]
    # 35 shingles each, 30 shared: 30 of 40 is 0.75 exactly.
    a, b = " ".join(base), " ".join(base[:34] + [f"z{i}" for i in range(5)])
    x, y = near_dedup.shingle_sets(pa.array([a, b]))
    assert len(np.intersect1d(x, y)) * 4 == len(np.union1d(x, y)) * 3
    real = near_dedup.signatures

    def unlucky(flat, bounds):
        """The real signatures, but 30 symbols of the sets' own: three of the first chunk, and what follows, stay."""
        out = real(flat, bounds)
        out[:, :18] = 7
        for row, start in zip(out, bounds[:-1], strict=True):
            row[18:] = (int(flat[start:].sum() & np.uint64(0xFFF)) + np.arange(30)) % 65536
        return out

    monkeypatch.setattr(near_dedup, "signatures", unlucky)
    docs = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": [a, b]})
    got = pa.Table.from_batches(near_dedup._sketch("doc_id", "text")(docs.to_batches()))
    sig = [np.frombuffer(s, np.uint16) for s in got.column("sig").to_pylist()]
    assert (sig[0] != sig[1]).sum() > 24
    met = [k for batch in near_dedup._keys(iter([pa.record_batch([got.column("doc_id").combine_chunks(), got.column("sig").combine_chunks()], names=["doc_id", "sig"])])) for k in batch.column("key").to_pylist()]
    assert len(set(met)) < len(met)
    together = pa.record_batch([pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array([a]), pa.array([b])], names=["a", "b", "text_a", "text_b"])
    assert pa.Table.from_batches(near_dedup._confirm([together])).to_pylist() == [{"a": 1, "b": 2}]


def test_linked_sets_share_a_rare_shingle():
    """Of all pairs of sets, none that is linked goes without a shared entry of the kind that the crowd join looks at."""
    rng = np.random.default_rng(5)
    frequency = rng.integers(0, 50, 1 << near_dedup.CELLS_BITS)
    core = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = []
    for _ in range(150):
        keep = core[rng.random(40) < rng.choice([0.5, 0.8, 0.95, 1.0])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 12)).astype(np.uint64)])))
    sets = [x for x in sets if len(x)]
    first = [near_dedup.rare_first(x, frequency) for x in sets]
    n_linked = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j and len(x) <= len(y) and near_dedup.linked(x, y):
                n_linked += 1
                assert set(first[i][0][: first[i][1]].tolist()) & set(first[j][0].tolist())
    assert n_linked > 100


def test_bitmaps_never_part_linked_sets():
    rng = np.random.default_rng(6)
    for n in (1, 4, 40, 900):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for lost in (0, n // 8, n // 7, n // 4):
            y = np.unique(np.concatenate([x[lost:], rng.integers(0, 1 << 63, max(0, n // 8 - lost)).astype(np.uint64)]))
            if len(y) and near_dedup.linked(x, y):
                both = near_dedup.bitmaps(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
                differ = np.bitwise_count((both[0] ^ both[1]).view(np.uint64)).sum()
                assert 7 * int(differ) <= len(x) + len(y)


def brute(docs):
    """Smallest identifier reachable over links, by comparing all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = (t or "").translate(low).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    part = {d: d for d in sets}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_crowds_of_unlinked_members(spark, monkeypatch):
    """Texts that share most of a passage meet under the same keys; chains and pairs among them are found exactly."""
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    rng = np.random.default_rng(1)
    core = [f"c{i}" for i in range(40)]
    docs = []
    for k in range(60):
        docs.append((10 * k, " ".join(core + [f"own{k}_{i}" for i in range(int(rng.integers(6, 14)))])))
        if k % 6 == 0:
            docs.append((10 * k + 1, docs[-1][1] + " tail"))
    docs += [(1000 + k, " ".join(core[k : k + 30] + [f"z{i}" for i in range(k)])) for k in range(12)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = brute(docs)
    assert got == want and 1 < len(set(want.values())) < len(docs)


def test_components_of_stars_and_chains(spark, monkeypatch):
    from opsloom.llm import components as c

    monkeypatch.setattr(c, "LIGHT", 3)
    links = [(0, i) for i in range(5, 40)] + [(99, i) for i in range(60, 90)] + [(i, i + 1) for i in range(200, 230)] + [(7, 61), (300, 300)]
    got = {r.node: r.component for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {0: 0, 99: 0} | dict.fromkeys(range(5, 40), 0) | dict.fromkeys(range(60, 90), 0) | dict.fromkeys(range(200, 231), 200)


def test_sets_of_few_rows_are_held_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(["a b c d e f"] * 600 + [None] + ["x" * near_dedup.PAIR_BYTES] * 2 + ["y"] * 597)], names=["n", "text"])
    slices = list(near_dedup.parts([batch], 1))
    assert pa.Table.from_batches(slices).equals(pa.Table.from_batches([batch]))
    assert max(x.num_rows for x in slices) <= near_dedup.PAIRS and len(slices) >= 5


def test_stars_take_no_round(spark, monkeypatch):
    rounds, whole = [], components._with_smallest
    monkeypatch.setattr(components, "_with_smallest", lambda pairs, rows: rounds.append(rows) or whole(pairs, rows))
    star = spark.createDataFrame([(1, k) for k in range(2, 300)] + [(5, 5)], "a long, b long")
    assert {tuple(r) for r in components.components(star).collect()} == {(k, 1) for k in range(1, 300)} and not rounds
    path = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(90, 50), (90, 60), (60, 50)], "a long, b long")
    want = {(k, 1) for k in range(1, 41)} | {(k, 50) for k in (50, 60, 90)}
    assert {tuple(r) for r in components.components(path).collect()} == want and rounds
