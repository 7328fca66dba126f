"""SentencePiece segmentations sampled without replacement, and decoding.

A text's segmentations are the paths of a lattice whose edges are vocabulary
pieces. Gumbel top-k: were every path's log probability perturbed by a Gumbel
variable of its own, the k largest would be a sample without replacement. The
search never lists paths. It keeps sets of paths with a perturbed bound each, best
first (A*): a set's best path is drawn from the lattice, and what is left of the
set falls into parts by the first edge where a path differs, whose bounds are
Gumbel variables cut off at the parent's. All random numbers are hashes of the
row key, the draw and the place, so results depend on no partitioning.

The lattice falls apart at white space that no piece crosses. Its messages are
computed once for each distinct segment that a task meets, as long as a bounded
store of them holds it. All texts of a block are searched at once, array by array.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, table
from .textarrow import Block, mix, powers, spread, text_blocks

U = np.uint64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of each text, and the exponent that flattens (below 1) or sharpens the pieces' weights.
SAMPLES, ALPHA = 2, 1.0
BLOCK_BYTES = 1 << 18
#: Bytes of distinct segments whose lattices a task keeps for its next blocks.
STORE_BYTES = 1 << 20
_FILTER = 22


class Vocabulary(NamedTuple):
    """Pieces with their mark for a space as a space; bytes that are pieces of their own come last."""

    flat: np.ndarray  # bytes of all pieces
    start: np.ndarray
    length: np.ndarray
    weight: np.ndarray  # log weight of each piece
    byte_id: np.ndarray  # piece of each byte
    hashes: np.ndarray  # sorted hashes of ordinary pieces, and their ids
    ids: np.ndarray
    known: np.ndarray  # of each slot: the first of its hashes; bit filter of beginnings behind which pieces go on
    begins: np.ndarray
    longest: int


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model with byte pieces.

    A piece's score in a merge model is its rank; its weight is that of Zipf's
    law at the rank. Pieces without a rank weigh as the last one does, byte
    pieces half as much.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    text, weight, byte_id, ordinary = [b""] * n, np.full(n, -np.inf), np.full(256, -1), []
    for i in range(n):
        if sp.is_byte(i):
            b = int(sp.id_to_piece(i)[3:5], 16)
            text[i], byte_id[b], weight[i] = bytes([b]), i, -np.log(2.0 * n)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).replace("▁", " ")
            if " " in piece.lstrip(" "):
                raise ValueError("a piece crosses white space")
            text[i] = piece.encode()
            weight[i] = -np.log(min(n, 1.0 - sp.get_score(i)))
            ordinary.append(i)
    if (byte_id < 0).any():
        raise ValueError("the vocabulary has no byte pieces")
    weight -= np.log(np.exp(weight[np.isfinite(weight)]).sum())
    length = np.array([len(t) for t in text])
    start = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(text), np.uint8)
    sums, down = _sums(flat)
    span = lambda a, n: mix((sums[a + n] - sums[a]) * down[a] + n.astype(U))
    own = np.array(ordinary)
    h = span(start[own], length[own])
    order = np.argsort(h)
    known, begins = np.full(1 << _FILTER, -1, np.int32), np.zeros(1 << _FILTER, bool)
    slot, one = np.unique((h[order] >> U(64 - _FILTER)).astype(np.int64), return_index=True)
    known[slot] = one
    for n_bytes in range(1, int(length[own].max())):
        a = start[own[length[own] > n_bytes]]
        begins[(span(a, np.full(len(a), n_bytes)) >> U(64 - _FILTER)).astype(np.int64)] = True
    return Vocabulary(flat, start, length, weight, byte_id, h[order], own[order], known, begins, int(length[own].max()))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return sums, down


#: Chances in a lattice are whole numbers of 2**-52, logarithms of 2**-32: sums of them are exact, so no result depends on what else is in a block.
CHANCE, LOG = 52, 32


def build_lattice(data: np.ndarray, begin: np.ndarray, end: np.ndarray, voc: Vocabulary, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lattice over the segments data[begin:end], which follow each other without gaps.

    Edges come by the position where they begin, then by length. Gives the first
    edge of each position and one more, each edge's piece, the position that it
    leads to, and the logarithm of its chance among the edges of its position.
    """
    n = len(data)
    sums, down = _sums(data)
    stop = np.repeat(end, end - begin)
    sets = []
    head = np.flatnonzero((data & 0xC0) != 0x80)
    alive = head
    width = np.ones(n, np.int8)
    width[data >= 0xC0], width[data >= 0xE0], width[data >= 0xF0] = 2, 3, 4
    single = np.zeros(n, bool)
    for size in range(1, voc.longest + 1):
        alive = alive.take(np.flatnonzero(alive + size <= stop.take(alive)))
        if not len(alive):
            break
        h = mix((sums.take(alive + size) - sums.take(alive)) * down.take(alive) + U(size))
        slot = (h >> U(64 - _FILTER)).view(np.int64)
        k = voc.known.take(slot)
        maybe = np.flatnonzero(k >= 0)
        hit, place, k = h.take(maybe), alive.take(maybe), k.take(maybe).astype(np.int64)
        # Few slots have more than one hash.
        go = np.flatnonzero(voc.hashes[k] < hit)
        while len(go):
            k[go] += 1
            go = go[k[go] < len(voc.hashes)]
            go = go[voc.hashes[k[go]] < hit[go]]
        k = np.minimum(k, len(voc.hashes) - 1)
        good = voc.hashes[k] == hit
        place = place[good]
        sets.append((place, voc.ids[k[good]]))
        single[place[width[place] == size]] = True
        alive = alive.take(np.flatnonzero(voc.begins.take(slot)))
    # Characters that are no piece fall into bytes.
    lost = head[~single[head]]
    lost = spread(lost, np.minimum(width[lost], stop[lost] - lost))
    sets.insert(0, (lost, voc.byte_id[data[lost]]))
    count = np.zeros(n, np.int64)
    for place, _ in sets:
        count[place] += 1
    first = np.concatenate([[0], np.cumsum(count)])
    piece, used = np.empty(first[-1], np.int32), first[:-1].copy()
    for place, ids in sets:
        piece[used[place]] = ids
        used[place] += 1
    at = np.repeat(np.arange(n), count)
    to = at + voc.length[piece]
    weight = voc.weight[piece] * alpha
    # Messages go from the ends of the segments to their beginnings, by the distance to the end.
    left = stop - np.arange(n)
    by_left = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
    by_left = by_left[count[by_left] > 0]
    edges = spread(first[by_left], count[by_left])
    message = np.zeros(n + 1)
    message[:n] = -np.inf
    target = np.where(to == stop[at], n, to)  # nothing is left after an edge to the end
    cut = np.concatenate([[0], np.flatnonzero(np.diff(left[by_left])) + 1, [len(by_left)]])
    heads = np.cumsum(count[by_left]) - count[by_left]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        lo, hi = heads[a], heads[b] if b < len(heads) else len(edges)
        own = edges[lo:hi]
        message[by_left[a:b]] = np.logaddexp.reduceat(weight[own] + message[target[own]], heads[a:b] - lo)
    return first, piece, to, weight + message[target] - message[at]


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """`array`, or a larger copy with room for `more` after its first `used` entries."""
    if used + more <= len(array):
        return array
    larger = np.empty(max(2 * len(array), used + more), array.dtype)
    larger[:used] = array[:used]
    return larger


class Lattices:
    """Lattices of the distinct segments that a task has met, one after the other.

    A segment is worked out once and then found again by its hash and bytes. What
    is kept is bounded: beyond `most` bytes of segments those that came only once
    are let go before the next block, and all of them if that leaves over half.
    """

    def __init__(self, voc: Vocabulary, alpha: float, most: int = STORE_BYTES):
        self.voc, self.alpha, self.most = voc, alpha, most
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.uses = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)  # of known segments, by hash
        self.size, self.edges = 0, 0
        self.data, self.first = np.zeros(0, np.uint8), np.zeros(1, np.int32)
        self.stop = np.zeros(0, np.int64)  # of the segment that begins at a position
        self.piece, self.to = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.origin = np.zeros(0, np.int32)  # the position where each edge begins
        self.upto = np.zeros(0, U)  # chance of choosing an edge or one before it
        self.chance, self.log = np.zeros(0), np.zeros(0, np.int64)

    def _keep_used(self) -> None:
        """Let go of the segments that came once since the last time."""
        kept = self.uses > 1
        at = self.at[kept]
        length = self.stop[at] - at
        if not len(at) or length.sum() > self.most // 2:
            return self._clear()
        places, count = spread(at, length), self.first[at + length] - self.first[at]
        edges, begin = spread(self.first[at], count), np.cumsum(length) - length
        moved = np.repeat(begin - at, count)
        self.hashes, self.at, self.uses = self.hashes[kept], begin, np.ones(len(at), np.int64)
        self.first = np.concatenate([np.zeros(1, np.int32), np.cumsum(self.first[places + 1] - self.first[places], dtype=np.int32)])
        self.data, self.stop = self.data[places], np.zeros(len(places), np.int64)
        self.stop[begin] = begin + length
        self.to, self.origin = ((x[edges] + moved).astype(np.int32) for x in (self.to, self.origin))
        self.piece, self.upto, self.chance, self.log = (x[edges] for x in (self.piece, self.upto, self.chance, self.log))
        self.size, self.edges = len(places), len(edges)

    def place(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Where each segment data[start:stop] begins here; together they are all of `data`."""
        if self.size > self.most:
            self._keep_used()
        sums, down = _sums(data)
        length = stop - start
        h, one, kind, times = np.unique(mix((sums[stop] - sums[start]) * down[start] + length.astype(U)), return_index=True, return_inverse=True, return_counts=True)
        slot = np.searchsorted(self.hashes, h)
        found = np.zeros(len(h), bool)
        inside = slot < len(self.hashes)
        found[inside] = self.hashes[slot[inside]] == h[inside]
        at = np.zeros(len(h), np.int64)
        at[found] = self.at[slot[found]]
        self.uses[slot[found]] += times[found]
        new = ~found
        at[new] = self._add(data, start[one[new]], length[one[new]])
        hashes, places, uses = np.concatenate([self.hashes, h[new]]), np.concatenate([self.at, at[new]]), np.concatenate([self.uses, times[new]])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.uses = hashes[order], places[order], uses[order]
        at = at[kind]
        # Equal hashes are not taken for equal bytes.
        other = self.data[np.minimum(spread(at, length), self.size - 1)] != data
        other = np.logical_or.reduceat(other, start) | (self.stop[at] - at != length)
        if other.any():
            at[other] = self._add(data, start[other], length[other])
        return at

    def _add(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.int64)
        own = data[spread(start, length)]
        end = np.cumsum(length)
        first, piece, to, log = build_lattice(own, end - length, end, self.voc, self.alpha)
        n, e = len(own), len(piece)
        chance = np.exp(np.minimum(log, 0))
        upto = np.cumsum(np.rint(chance * 2.0**CHANCE).astype(U))  # sums wrap around, differences don't
        upto -= np.concatenate([np.zeros(1, U), upto])[np.repeat(first[:-1], np.diff(first))]
        upto[first[1:][np.diff(first) > 0] - 1] = U(1 << (CHANCE + 1))
        stops = np.zeros(n, np.int64)
        stops[end - length] = end
        for name, used, value in (("data", self.size, own), ("stop", self.size, stops + self.size), ("piece", self.edges, piece), ("to", self.edges, (to + self.size).astype(np.int32)), ("origin", self.edges, (np.repeat(np.arange(n), np.diff(first)) + self.size).astype(np.int32)), ("upto", self.edges, upto), ("chance", self.edges, chance), ("log", self.edges, np.rint(np.minimum(log, 0) * 2.0**LOG).astype(np.int64))):
            grown = _room(getattr(self, name), used, len(value))
            grown[used : used + len(value)] = value
            setattr(self, name, grown)
        self.first = _room(self.first, self.size + 1, n)
        self.first[self.size : self.size + n + 1] = first + self.edges
        at = self.size + end - length
        self.size, self.edges = self.size + n, self.edges + e
        return at


_SPREAD = U(0xD1342543DE82EF95)


def hashed(*parts) -> np.ndarray:
    """A hash of integers, or of arrays of them; cheapest with the arrays last."""
    h = np.full(1, 0x9E3779B97F4A7C15, U)
    for p in parts:
        h = mix(np.atleast_1d(np.asarray(p)).astype(U) + h * _SPREAD)
    return h


def _unit(h: np.ndarray) -> np.ndarray:
    # The largest one would be rounded to 1.
    return np.minimum((h >> U(11)).astype(float) + 0.5, (1 << 53) - 1.0) / float(1 << 53)


def uniform(*parts) -> np.ndarray:
    """Numbers strictly between 0 and 1, hashed from integers."""
    return _unit(hashed(*parts))


def draw(lattice: Lattices, start: np.ndarray, stop: np.ndarray, key: np.ndarray, place: np.ndarray):
    """One path from each start to its stop: edges, and their bounds by path.

    `key` is hashed from the text's key and the number of the draw, `place` is
    the place of the start in its text; together they make the random numbers.
    """
    seed = key * _SPREAD + (place - start).astype(U)
    n = len(start)
    pos, live = start.copy(), np.flatnonzero(start < stop)
    steps = []
    while len(live):
        here = pos.take(live)
        u = mix(seed.take(live) + here.view(U)) >> U(64 - CHANCE)
        edge = lattice.first.take(here).astype(np.int64)
        go = np.flatnonzero(lattice.upto.take(edge) <= u)
        at, least = edge.take(go), u.take(go)
        while len(go):
            at += 1
            on = lattice.upto.take(at) <= least
            edge[go] = at
            on = np.flatnonzero(on)
            go, at, least = go.take(on), at.take(on), least.take(on)
        steps.append((live, edge))
        here = lattice.to.take(edge)
        pos[live] = here
        live = live.take(np.flatnonzero(here < stop.take(live)))
    count = np.zeros(n, np.int64)
    for own, _ in steps:
        count[own] += 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    edges = np.empty(bounds[-1], np.int64)
    for k, (own, edge) in enumerate(steps):
        edges[bounds[own] + k] = edge
    return edges, bounds


def _cut_off(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at `location`, each given that it is at most `bound`."""
    return -np.logaddexp(-bound, -(location - np.log(-np.log(u))))


#: A position of which more than 1 - NEAR is taken has its rest summed up; shares are whole numbers of 2**-SHARE.
NEAR, SHARE = 1e-6, 40
#: Parts behind a beginning whose logarithm of the chance is below -REACH are looked at only where they may be among the best; no Gumbel variable at 0 reaches HIGHEST.
REACH, HIGHEST = 44, 37


class Others(NamedTuple):
    """Edges that are left at some positions."""

    choice: np.ndarray  # all edges of each position, those that are out too
    share: np.ndarray  # of each, relative to the position's likeliest; 0 for those that are out
    head: np.ndarray  # where each position's edges begin among them
    total: np.ndarray  # of each position's shares
    log_sum: np.ndarray  # logarithm of the chance of each position's edges; -inf where none is left


class Search:
    """The search over all texts of a block at once, one draw after the other.

    Path k of text j is edges[begin[k, j] : begin[k, j] + length[k, j]]. An open
    set of text j holds the paths that share the first `at` edges of `path` and go
    on with none of the edges that are out: the path's own next one and, along
    `chain`, those of the sets that this one was left over from.
    """

    def __init__(self, lattice: Lattices, key: np.ndarray, samples: int):
        m, slots = len(key), samples * (samples + 1)
        self.lattice, self.key, self.samples = lattice, key, samples
        self.edges, self.segment = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin, self.length = np.zeros((samples, m), np.int64), np.zeros((samples, m), np.int64)
        self.perturbed, self.log_prob = np.full((samples, m), -np.inf), np.zeros((samples, m))
        self.bound = np.full((m, slots), -np.inf)
        self.path, self.at, self.chain = np.zeros((m, slots), np.int16), np.zeros((m, slots), np.int64), np.full((m, slots), -1, np.int32)

    def out_of(self, texts: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among `texts`, edge) of the edges that are out of the sets in these slots; none for slot -1."""
        owner, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own = np.flatnonzero(slot >= 0)
        slot = slot[own]
        while len(own):
            j = texts[own]
            owner.append(own)
            edges.append(self.edges[self.begin[self.path[j, slot], j] + self.at[j, slot]])
            slot = self.chain[j, slot]
            own, slot = own[slot >= 0], slot[slot >= 0]
        return np.concatenate(owner), np.concatenate(edges)

    def add(self, draw_no: int, texts: np.ndarray, edges: np.ndarray, segment: np.ndarray, length: np.ndarray, bound: np.ndarray, since: np.ndarray, slot: np.ndarray) -> None:
        """Take a drawn path of each of `texts`; what is left of the set in `slot` falls apart by the first edge that differs."""
        k = draw_no - 1
        begin = np.cumsum(length) - length
        self.begin[k, texts], self.length[k, texts], self.perturbed[k, texts] = begin + len(self.edges), length, bound
        self.edges, self.segment = np.concatenate([self.edges, edges]), np.concatenate([self.segment, segment])
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lattice.log[edges])])  # wraps around, differences don't
        self.log_prob[k, texts] = (before[begin + length] - before[begin]) / 2.0**LOG
        # Parts get less likely along the path: the first ones nearly always hold the best, and where they may not, all are looked at.
        far = np.flatnonzero(before[:-1] - np.repeat(before[begin], length) >= -(REACH << LOG))
        reach = np.searchsorted(far, begin + length) - np.searchsorted(far, begin)
        size = length - since
        first = np.minimum(np.maximum(reach - since, 1), size)
        best, where = self.parts(draw_no, texts, edges, before, begin, since, first, bound, slot)
        more = np.flatnonzero((first < size) & (best[:, -1] < HIGHEST - REACH))
        if len(more):
            best[more], where[more] = self.parts(draw_no, texts[more], edges, before, begin[more], since[more], size[more], bound[more], slot[more])
        for turn in range(best.shape[1]):
            some = best[:, turn] > -np.inf
            own, offset, cell = texts[some], where[some, turn], k * (self.samples + 1) + turn
            self.bound[own, cell], self.path[own, cell], self.at[own, cell] = best[some, turn], k, since[some] + offset
            self.chain[own, cell] = np.where(offset == 0, slot[some], -1)

    def parts(self, draw_no: int, texts: np.ndarray, edges: np.ndarray, before: np.ndarray, begin: np.ndarray, since: np.ndarray, size: np.ndarray, bound: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the best sets that a path leaves by differing at one of the `size` edges from `since` on, and after how many it does.

        One row for each text, best first; no more of them can be among the samples, or set the limit. -inf stands for no set.
        """
        head = np.cumsum(size) - size
        at = spread(begin + since, size)
        taken = self.lattice.chance[edges[at]]
        owner, out = self.out_of(texts, slot)
        np.add.at(taken, head[owner], self.lattice.chance[out])
        rest = np.log1p(-np.minimum(taken, 1 - NEAR))
        # Near 1 the difference would be rounding: there what is left is summed up edge by edge.
        near = np.flatnonzero(taken > 1 - NEAR)
        here = self.lattice.origin[edges[at[near]]]
        alone = self.lattice.first[here + 1] - self.lattice.first[here] == 1
        rest[near[alone]] = -np.inf  # nothing is left of one edge
        near = near[~alone]
        if len(near):
            slot_of = np.full(len(at), -1)
            slot_of[near] = np.arange(len(near))
            chained = slot_of[head[owner]]
            rest[near] = self.others(edges[at[near]], chained[chained >= 0], out[chained >= 0]).log_sum
        location = (before[at] - np.repeat(before[begin], size)) / 2.0**LOG + rest
        seed = hashed(self.key[texts], draw_no, 1 << 20)
        left, open_at = np.full(len(at), -np.inf), np.flatnonzero(rest > -np.inf)
        of = np.repeat(np.arange(len(texts)), size)[open_at]
        u = _unit(mix((at[open_at] - begin[of]).astype(U) + (seed * _SPREAD)[of]))
        left[open_at] = _cut_off(location[open_at], bound[of], u)
        turns = self.samples - draw_no + 1
        best, where = np.full((len(texts), turns), -np.inf), np.zeros((len(texts), turns), np.int64)
        for turn in range(turns):
            best[:, turn] = np.maximum.reduceat(left, head)
            at_best = np.flatnonzero(left == np.repeat(best[:, turn], size))
            place = np.empty(len(texts), np.int64)
            place[np.repeat(np.arange(len(texts)), size)[at_best[::-1]]] = at_best[::-1]
            where[:, turn] = place - head
            left[place] = -np.inf
        return best, where

    def pop(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts with open sets, the slot of the best of each, and its bound; the set is open no more."""
        slot = self.bound.argmax(1)
        best = self.bound[np.arange(len(slot)), slot]
        texts = np.flatnonzero(best > -np.inf)
        self.bound[texts, slot[texts]] = -np.inf
        return texts, slot[texts], best[texts]

    def others(self, edge: np.ndarray, owner: np.ndarray, out: np.ndarray) -> Others:
        """What leaves the positions where each `edge` begins, but for the edge itself and `out[i]` of `edge[owner[i]]`.

        Shares are relative to the likeliest of a position's own, so the smallest chances keep theirs.
        """
        first, start = self.lattice.first, self.lattice.origin[edge]
        count = first[start + 1] - first[start]
        head = np.cumsum(count) - count
        choice = spread(first[start], count)
        log = self.lattice.log[choice] / 2.0**LOG
        log[head + edge - first[start]] = -np.inf
        log[head[owner] + out - first[start[owner]]] = -np.inf
        best = np.maximum.reduceat(log, head)
        share = np.rint(np.exp(log - np.repeat(np.where(best > -np.inf, best, 0), count)) * 2.0**SHARE).astype(np.int64)
        total = np.add.reduceat(share, head)
        return Others(choice, share, head, total, best + np.log(np.maximum(total, 1)) - SHARE * np.log(2))

    def other_edges(self, texts: np.ndarray, slot: np.ndarray, edge: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from the position where each `edge` begins, drawn among those that are not out."""
        left = self.others(edge, *self.out_of(texts, slot))
        upto = np.cumsum(left.share)
        before = upto[left.head] - left.share[left.head]
        return left.choice[np.searchsorted(upto, before + np.floor(u * left.total).astype(np.int64), "right")]


class Sampled(NamedTuple):
    """Sampled segmentations of a block's texts, by text and sample."""

    text: np.ndarray
    sample: np.ndarray
    ids: np.ndarray  # of all, one after the other
    bounds: np.ndarray
    log_prob: np.ndarray
    perturbed: np.ndarray
    log_inclusion: np.ndarray
    exact: np.ndarray


def sample_block(block: Block, keys: np.ndarray, lattice: Lattices, samples: int) -> Sampled:
    """The sampled segmentations of each text of a block; one without pieces for an empty text."""
    size = np.diff(block.bounds)
    full, bare = np.flatnonzero(size), np.flatnonzero(size == 0)
    zeros = np.zeros(len(bare))
    if not len(full):
        return Sampled(bare, np.ones(len(bare), np.int64), np.zeros(0, np.int32), np.zeros(len(bare) + 1, np.int64), zeros, zeros, zeros, zeros == 0)
    # A space goes before each text that has any.
    size = size[full] + 1
    begin = np.cumsum(size) - size
    data = np.full(len(block.data) + len(full), 32, np.uint8)
    mask = np.ones(len(data), bool)
    mask[begin] = False
    data[mask] = block.data
    cut = np.zeros(len(data), bool)
    blank, line = data == 32, data == 10
    cut[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    cut[begin] = True
    start = np.flatnonzero(cut)
    stop = np.concatenate([start[1:], [len(data)]])
    text = np.searchsorted(begin, start, "right") - 1
    first, last = np.searchsorted(text, np.arange(len(full))), np.searchsorted(text, np.arange(len(full)), "right")
    seg_from = lattice.place(data, start, stop)
    seg_to = seg_from + stop - start
    place = start - begin[text]
    key = mix(keys[full].view(U) + U(1))

    search = Search(lattice, key >> U(1), samples)
    every = np.arange(len(full))
    edges, bounds = draw(lattice, seg_from, seg_to, hashed(1, key)[text], place)
    none = np.full(len(full), -1)
    search.add(1, every, edges, np.repeat(np.arange(len(start)), np.diff(bounds)), bounds[last] - bounds[first], -np.log(-np.log(uniform(search.key, 0, 0, 2 << 20))), np.zeros(len(full), np.int64), none)
    for draw_no in range(2, samples + 1):
        texts, slot, bound = search.pop()
        if not len(texts):
            break
        # The edge that must differ, then the rest of its segment, then the segments after it.
        at = search.at[texts, slot]
        was = search.begin[search.path[texts, slot], texts]
        seg = search.segment[was + at]
        lead = search.other_edges(texts, slot, search.edges[was + at], uniform(search.key[texts], at, draw_no, 3 << 20))
        count = last[texts] - seg
        segs = spread(seg, count)
        head = np.cumsum(count) - count
        begins = seg_from[segs].copy()
        begins[head] = lattice.to[lead]
        tail, bounds = draw(lattice, begins, seg_to[segs], hashed(draw_no, key)[text[segs]], place[segs] + begins - seg_from[segs])
        rest = bounds[head + count] - bounds[head]
        length = at + 1 + rest
        new = np.cumsum(length) - length
        edges, segment = np.empty(int(length.sum()), np.int64), np.empty(int(length.sum()), np.int64)
        for whole, old, mine, after in ((edges, search.edges, lead, tail), (segment, search.segment, seg, np.repeat(segs, np.diff(bounds)))):
            whole[spread(new, at)] = old[spread(was, at)]
            whole[new + at] = mine
            whole[spread(new + at + 1, rest)] = after
        search.add(draw_no, texts, edges, segment, length, bound, at, slot)

    sample, j = np.nonzero(search.length)
    order = np.argsort(j, kind="stable")
    sample, j = sample[order], j[order]
    length = search.length[sample, j]
    ids = lattice.piece[search.edges[spread(search.begin[sample, j], length)]]
    log_p, limit = search.log_prob[sample, j], search.bound.max(1)[j]
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        x = np.where(limit > -np.inf, np.exp(np.minimum(log_p - limit, 50.0)), np.inf)
        inclusion = np.where(x > 1e-12, np.log(-np.expm1(-x)), log_p - limit)
    exact = _spell_back(ids, length, data, begin[j], size[j], lattice.voc)
    order = np.argsort(np.concatenate([full[j], bare]), kind="stable")
    put = lambda a, b: np.concatenate([a, b])[order]
    counts = put(length, np.zeros(len(bare), np.int64))
    return Sampled(put(full[j], bare), put(sample + 1, np.ones(len(bare), np.int64)), ids, np.concatenate([[0], np.cumsum(counts)]), put(log_p, zeros), put(search.perturbed[sample, j], zeros), put(inclusion, zeros), put(exact, zeros == 0))


def _spell_back(ids: np.ndarray, length: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Whether each segmentation decodes to its text, data[begin : begin + size]."""
    width = voc.length[ids]
    head = np.cumsum(length) - length
    good = np.add.reduceat(width, head) == size
    kept = ids[np.repeat(good, length)]
    made = voc.flat[spread(voc.start[kept], voc.length[kept])]
    same = made == data[spread(begin[good], size[good])]
    if len(same):
        good[good] = np.logical_and.reduceat(same, np.cumsum(size[good]) - size[good])
    return good


def decode_ids(ids: np.ndarray, voc: Vocabulary) -> bytes:
    """The text of a segmentation, without the space that encoding puts before it."""
    return voc.flat[spread(voc.start[ids], voc.length[ids])].tobytes()[1:]


_SCHEMA = "doc_id long, sample int, ids {}, log_prob double, perturbed double, log_inclusion double"


def _sample(voc: Vocabulary, samples: int, alpha: float, packed: bool, checked: bool):
    def run(batches):
        lattice = Lattices(voc, alpha)
        for batch in batches:
            # A null identifier draws as one fixed number would; the output has it null.
            ids = batch.column(0).fill_null(-1).to_numpy()
            for block in text_blocks(batch.column(1), BLOCK_BYTES):
                x = sample_block(block, ids[block.first : block.first + len(block.bounds) - 1], lattice, samples)
                flat = np.ascontiguousarray(x.ids.astype("<i4"))
                if packed:
                    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x.text), [None, pa.py_buffer(4 * x.bounds), pa.py_buffer(flat)]).cast(pa.binary())
                else:
                    column = pa.ListArray.from_arrays(pa.array(x.bounds.astype(np.int32)), pa.array(flat))
                out = {"doc_id": batch.column(0).take(pa.array(block.first + x.text)), "sample": pa.array(x.sample.astype(np.int32)), "ids": column}
                out |= {c: pa.array(getattr(x, c)) for c in ("log_prob", "perturbed", "log_inclusion")}
                if checked:
                    out["exact"] = pa.array(x.exact)
                yield pa.RecordBatch.from_pydict(out)

    return run


def sample_segmentations(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, checked: bool = False) -> DataFrame:
    """Distinct segmentations of each whole text, sampled without replacement.

    Returns one row per text and sample: doc_id, sample (1 is the largest
    perturbed value), ids (piece ids; with `packed`, their little-endian 32-bit
    bytes), log_prob (under the lattice's distribution), perturbed, and
    log_inclusion (log probability that the sample holds this path, given the
    next perturbed value). With `checked`, exact tells whether decoding gives the
    text back. A text with fewer paths than `samples` has them all, with
    log_inclusion 0; a null or empty text has one row without ids. Rows that
    share an identifier and a text get the same samples, each its own rows; so do
    those of equal texts without identifier. An empty table gives an empty
    result; other columns are not looked at.
    """
    voc = load_vocabulary(model)
    schema = _SCHEMA.format("binary" if packed else "array<int>") + (", exact boolean" if checked else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(_sample(voc, samples, alpha, packed, checked)), schema)


def decode_segmentations(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """`encoded` with the decoded text of the column `ids_col` (array of int, or packed) as `out_col`.

    Null ids give a null text, no ids an empty one. Bytes that are no UTF-8 are replaced.
    """
    voc = load_vocabulary(model)
    out = encoded.drop(out_col).withColumn(out_col, F.lit("").cast("string"))
    at = out.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            texts = []
            for x in batch.column(at):
                x = x.as_py()
                ids = None if x is None else np.frombuffer(x, np.int32) if isinstance(x, bytes) else np.array(x, np.int64)
                texts.append(None if ids is None else decode_ids(ids, voc).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    return out.mapInArrow(lean(run), out.schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text of `documents`, as digests, with their round trip."""
    found = sample_segmentations(table(spark, sf_dir, "documents"), packed=True, checked=True)
    return found.select("doc_id", "sample", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "log_prob", "perturbed", "log_inclusion", F.sha2("ids", 256).alias("ids_sha256"), "exact")
