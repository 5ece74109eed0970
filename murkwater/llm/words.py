"""Words and word-sequence hashes of whole columns of text, vectorised over the bytes of a batch.

A word is a maximal run of characters other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). White
space is single bytes in UTF-8, so words are cut on bytes and never split a character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between batches."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        factors = np.full(max(n, 1), base, np.uint64)
        factors[0] = 1
        _powers[key] = np.multiply.accumulate(factors)
    return _powers[key][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's offset in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of a batch: byte spans, and ``first[d]``..``first[d + 1]`` are those of row d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(column: pa.Array) -> Words:
    data, off = raw(column)
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64))
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    edge[-1] = True
    start = inside & edge[:-1]
    start[1:] |= inside[1:] & ~inside[:-1]
    end = inside & edge[1:]
    end[:-1] |= inside[:-1] & ~inside[1:]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off))


def word_hashes(w: Words, lower: bool = False, block: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower`` A-Z count as a-z. Works in blocks of bytes."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(w.starts), np.uint64)
    i = 0
    while i < len(out):
        base = w.starts[i]
        j = max(i + 1, int(np.searchsorted(w.ends, base + block, "right")))
        n = int(w.ends[j - 1] - base)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[w.data[base : base + n]] * power(BASE, n), out=sums[1:])
        start, end = w.starts[i:j] - base, w.ends[i:j] - base
        out[i:j] = mixed((sums[end] - sums[start]) * power(INVERSE, n)[start] + (end - start).astype(np.uint64))
        i = j
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, over the whole batch; the last k-1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n] * _STEP[0]
    for i in range(1, k):
        total += hashes[i : i + n] * _STEP[i]
    return mixed(total)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """Hash (an array of one) of a sequence shorter than any k in use; its length sets it apart from k-grams."""
    total = (hashes * _STEP[: len(hashes)]).sum(dtype=np.uint64, keepdims=True)
    return mixed(total + np.full(1, len(hashes), np.uint64) * np.uint64(0xD1B54A32D192ED03))


def gram_sets(column: pa.Array, k: int, lower: bool = False) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row with fewer than k words has its whole sequence as its one shingle, a row without words none.
    """
    w = words(column)
    h = word_hashes(w, lower)
    g = grams(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            out.append(sequence_hash(h[a:b]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
