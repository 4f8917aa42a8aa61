"""Vectorised text primitives shared by the corpus operators (numpy over UTF-8 bytes, no Spark).

A slice is a run of whole documents of about ``SLICE_BYTES`` bytes, so the memory of every
function here is bounded by that constant, or by the longest single document.

Null texts count as empty everywhere in this module.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_MULT, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


@functools.cache
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n (n is a power of two, so few sizes exist)."""
    out = []
    for base in (int(_STEP), _inverse(int(_STEP))):
        powers = np.ones(n, dtype=np.uint64)
        have = 1
        while have < n:
            powers[have : 2 * have] = powers[:have] * _U(pow(base, have, 1 << 64))
            have *= 2
        out.append(powers)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _MULT
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def byte_class(members: bytes | range) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: `[\x20\x09-\x0D]`: what separates words in every operator but the license scan.
SPACE = byte_class(b" \t\n\v\f\r")
#: ASCII upper case to lower case, other bytes unchanged.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row bounds in them) for runs of rows of about `limit` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(buf: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words lie before each row bound."""
    if not len(buf):
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, np.zeros(len(bounds), dtype=np.int64)
    inside = ~breaks[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(len(buf), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, equal for equal bytes wherever they stand."""
    out = np.empty(len(starts), dtype=np.uint64)
    codes = _byte_codes()
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            base = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            n = int(ends[hi - 1] - base)
            power, inverse = _powers(1 << max(10, int(n - 1).bit_length()))
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(codes[buf[base : base + n]] * power[:n], out=sums[1:])
            at = starts[lo:hi] - base
            out[lo:hi] = mix((sums[ends[lo:hi] - base] - sums[at]) * inverse[at])
            lo = hi
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every window of `size` words of each row, and each window's row.

    `first` holds the number of words before each row bound. A row with fewer words than `size`,
    but at least one, gives one hash of its whole sequence.
    """
    n_rows = len(first) - 1
    counts = np.diff(first)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        weights = [_U(pow(int(_STEP), k + 1, 1 << 64)) for k in range(size)]
        rows = np.repeat(np.arange(n_rows), counts)
        n = len(words) - size + 1
        hashes, owner = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        if n > 0:
            total = np.zeros(n, dtype=np.uint64)
            for k, weight in enumerate(weights):
                total += words[k : k + n] * weight
            whole = rows[:n] == rows[size - 1 :]
            hashes, owner = mix(total[whole]), rows[:n][whole]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            total = mix(counts[short].astype(np.uint64))
            for k in range(size - 1):
                has = counts[short] > k
                total[has] += words[first[short[has]] + k] * weights[k]
            hashes = np.concatenate([hashes, mix(total)])
            owner = np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
    return hashes, owner


def distinct_by_row(hashes: np.ndarray, owner: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order, and the bounds of the rows among them. `owner` ascends."""
    if not len(hashes):
        return hashes, np.zeros(n_rows + 1, dtype=np.int64)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(n_rows + 1))
