"""Sampled segmentations against the enumeration of all paths."""

import math

import numpy as np
import pyarrow as pa
import pytest

from opsloom.llm import sentence_sampling as s
from opsloom.llm.textarrow import text_blocks


@pytest.fixture(scope="module")
def voc():
    return s.load_vocabulary()


def paths(text: str, voc) -> dict[tuple[int, ...], float]:
    """Every segmentation of the text with its probability."""
    piece = {voc.flat[voc.start[i] : voc.start[i] + voc.length[i]].tobytes(): i for i in voc.ids.tolist()}
    data = (" " + text).encode()
    heads = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
    lost = {i for a, b in zip(heads, heads[1:]) if data[a:b] not in piece for i in range(a, b)}

    def walk(i):
        if i == len(data):
            yield (), 0.0
        for n in range(1, voc.longest + 1):
            one = piece.get(data[i : i + n]) if i + n <= len(data) else None
            if one is not None:
                for rest, w in walk(i + n):
                    yield (one, *rest), w + float(voc.weight[one])
        if i in lost:
            one = int(voc.byte_id[data[i]])
            for rest, w in walk(i + 1):
                yield (one, *rest), w + float(voc.weight[one])

    found = dict(walk(0))
    total = sum(map(math.exp, found.values()))
    return {p: math.exp(w) / total for p, w in found.items()}


def sampled(text: str, keys: int, samples: int, voc) -> list[list[tuple]]:
    """(ids, log_prob, log_inclusion) of the samples under each key."""
    block = next(text_blocks(pa.array([text] * keys), 1 << 30))
    got = s.sample_block(block, np.arange(keys, dtype=np.int64), s.Lattices(voc, 1.0), samples)
    out = [[] for _ in range(keys)]
    for r, d in enumerate(got.text.tolist()):
        out[d].append((tuple(got.ids[got.bounds[r] : got.bounds[r + 1]].tolist()), got.log_prob[r], got.log_inclusion[r]))
    assert got.exact.all()
    return out


#: Rare paths have chances down to 1e-29; none is left out.
@pytest.mark.parametrize("text", ["the", "no x", "a\nb", "ü中", "cats", "house"])
def test_all_paths_and_their_probabilities(voc, text):
    want = paths(text, voc)
    for own in sampled(text, 3, len(want) + 2, voc):
        assert len({p for p, *_ in own}) == len(own)
        assert {p for p, *_ in own} == want.keys()
        assert all(abs(lp - math.log(want[p])) < 1e-6 for p, lp, _ in own)
        assert all(inclusion == 0 for *_, inclusion in own)


def test_frequencies_are_those_of_sampling_without_replacement(voc):
    want = paths("the", voc)
    n = 20_000
    got = sampled("the", n, 2, voc)
    for p, q in want.items():
        first = sum(own[0][0] == p for own in got) / n
        both = q + sum(x * q / (1 - x) for other, x in want.items() if other != p)
        seen = [own for own in got if p in (own[0][0], own[1][0])]
        close = lambda a, b: abs(a - b) < 5 * math.sqrt(max(b, 1 / n) / n)
        assert close(first, q) and close(len(seen) / n, both)
        if both > 0.01:  # weights by inclusion give every path's probability back
            weighed = sum(q / math.exp(next(i for x, _, i in own if x == p)) for own in seen) / n
            assert abs(weighed - q) < 0.1 * q + 0.01


def test_no_result_depends_on_the_block(voc):
    texts = ["the cat sat", None, "", "on the mat " * 40, "x" * 3000, "ü中 \n\n y"]
    alone = []
    for k, t in enumerate(texts):
        batch = pa.record_batch([pa.array([k], pa.int64()), pa.array([t], pa.string())], names=["d", "t"])
        alone += pa.Table.from_batches(s._sample(voc, 3, 1.0, False, True)([batch])).to_pylist()
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["d", "t"])
    together = pa.Table.from_batches(s._sample(voc, 3, 1.0, False, True)([batch])).to_pylist()
    assert alone == together and all(r["exact"] for r in together)


def test_store_is_let_go_and_hashes_are_not_believed(voc):
    small = s.Lattices(voc, 1.0, most=8)
    for word in ("alpha", "beta", "gamma", "alpha"):
        data = np.frombuffer(f" {word}".encode(), np.uint8)
        at = small.place(data, np.array([0]), np.array([len(data)]))
        assert small.data[at[0] : at[0] + len(data)].tobytes() == data.tobytes() and small.size <= 16
    big = s.Lattices(voc, 1.0)
    one = np.frombuffer(b" alpha", np.uint8)
    first = big.place(one, np.array([0]), np.array([6]))[0]
    big.data[first] = 33  # as if other bytes had the hash
    again = big.place(one, np.array([0]), np.array([6]))[0]
    assert again != first and big.data[again : again + 6].tobytes() == b" alpha"


def test_nothing_is_summed_where_one_edge_leaves(monkeypatch, voc):
    lattice, seen = s.Lattices(voc, 1.0), []
    whole = s.Search.others

    def others(self, edge, owner, out):
        found = whole(self, edge, owner, out)
        seen.extend(np.diff(np.append(found.head, len(found.choice))).tolist())
        return found

    monkeypatch.setattr(s.Search, "others", others)
    texts = pa.array(["中文 日本 zqź \U0001f600 the words of a text " * 5])
    block, = text_blocks(texts, s.BLOCK_BYTES)
    found = s.sample_block(block, np.array([5]), lattice, 2)
    assert found.exact.all() and len(found.text) == 2 and 1 not in seen
    # Every piece is found by its slot.
    at = np.flatnonzero(voc.known >= 0)
    assert len(voc.hashes) >= len(at) and all(int(voc.hashes[voc.known[slot]] >> np.uint64(64 - 22)) == slot for slot in at[:500].tolist())


LONG = "the words of a text that goes on and on without an end, 日本 and more of the same "


def test_far_parts_are_not_looked_at_and_would_change_nothing(monkeypatch, voc):
    block, = text_blocks(pa.array([LONG * 60, LONG, "x", "the " * 900, ""]), 1 << 30)
    keys, seen, whole = np.arange(5, dtype=np.int64), [], s._cut_off

    def cut_off(location, bound, u):
        seen.append(len(location))
        return whole(location, bound, u)

    monkeypatch.setattr(s, "_cut_off", cut_off)
    got = []
    for reach in (s.REACH, 1 << 20, s.HIGHEST):  # as it is; everything at once; too few for most texts, which are looked at again
        seen.clear()
        monkeypatch.setattr(s, "REACH", reach)
        got.append((s.sample_block(block, keys, s.Lattices(voc, 1.0), 3), sum(seen)))
    for other, _ in got[1:]:
        assert all(np.array_equal(x, y) for x, y in zip(got[0][0], other, strict=True))
    assert 3 * got[0][1] < got[1][1]


def test_segments_that_return_outlive_the_others(monkeypatch, voc):
    built, whole = [], s.build_lattice

    def build(data, *args):
        built.append(data.tobytes())
        return whole(data, *args)

    monkeypatch.setattr(s, "build_lattice", build)
    texts, words = [], []
    for k in range(12):
        words = [f"again{j}" for j in range(9)] + [f"once{k}x{j}" for j in range(40)]
        texts.append(" ".join(words + words[:9]))
    small, wide = s.Lattices(voc, 1.0, most=600), s.Lattices(voc, 1.0)
    for k, text in enumerate(texts):
        block, = text_blocks(pa.array([text]), 1 << 30)
        x, y = (s.sample_block(block, np.array([k]), store, 2) for store in (small, wide))
        assert all(np.array_equal(a, b) for a, b in zip(x, y, strict=True)) and x.exact.all() and small.size < 1200
    # Once for each of the two stores.
    assert b"".join(built).count(b" again3") == 2
