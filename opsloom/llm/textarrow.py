"""Vectorised words and word n-grams over the value buffers of Arrow text columns.

A word's hash is a 64-bit polynomial over its bytes (prefix sums times inverse
powers), passed through a bit mixer; an n-gram's hash is a polynomial over word
hashes. No Python string is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_STEP = U(0x9FB21C651E98DF25)
#: Bytes of text that are worked on at a time; a longer text is a block alone.
BLOCK_BYTES = 1 << 20

_SPACES = b" \t\n\v\f\r"


def _table(separators: bytes, lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    t[0] = 255 if 0 not in separators else 0
    return t


#: Byte tables: 0 stands for a separator. NUL is a word character where only white space separates; 255 never occurs in UTF-8.
SPACED = _table(_SPACES, lower=False)
SPACED_LOWER = _table(_SPACES, lower=True)
ALNUM_LOWER = _table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)), lower=True)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U(base), dtype=U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Block(NamedTuple):
    """Some consecutive texts of a batch."""

    first: int  # row of the first text in the batch
    data: np.ndarray  # their bytes
    bounds: np.ndarray  # text i is data[bounds[i]:bounds[i + 1]]


class Words(NamedTuple):
    """The words of a block."""

    hashes: np.ndarray  # uint64
    start: np.ndarray  # byte positions in the block
    end: np.ndarray
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i + 1]


def text_blocks(column, size: int = BLOCK_BYTES, most: int = 1 << 62) -> Iterator[Block]:
    """Cut an Arrow text column into blocks of whole texts, `most` at most; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(i + most, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        yield Block(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(block: Block, table: np.ndarray) -> Words:
    """Words of each text: runs of bytes whose entry in `table` isn't 0."""
    m = table[block.data]
    n = len(m)
    if not n:
        return Words(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block.bounds), np.int64))
    inside = m != 0
    first, last = inside.copy(), inside.copy()
    cut = block.bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(m * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    h[h == 0] = 1
    return Words(h, start, end, np.searchsorted(start, block.bounds))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and the bounds of the texts among them.

    A text with fewer words than n, but some, has one: that of all its words.
    """
    count = np.diff(w.bounds)
    of = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(of)])
    out = np.empty(bounds[-1], U)
    if len(w.hashes) >= n:
        h = w.hashes[: len(w.hashes) - n + 1].copy()
        for j in range(1, n):
            h *= _STEP
            h += w.hashes[j : len(w.hashes) - n + 1 + j]
        full = np.flatnonzero(count >= n)
        at = np.repeat(w.bounds[full] - bounds[full], of[full]) + _spread(bounds[full], of[full])
        out[_spread(bounds[full], of[full])] = h[at]
    for i in np.flatnonzero((count > 0) & (count < n)):
        h = U(0)
        with np.errstate(over="ignore"):
            for x in w.hashes[w.bounds[i] : w.bounds[i + 1]]:
                h = h * _STEP + x
        out[bounds[i]] = h
    return mix(out), bounds


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ... of all ranges, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


spread = _spread
