"""Whole Arrow batches of texts as numpy arrays: words, shingles and hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**64, 256, dtype=U)
ODD = [U(int(x) | 1) for x in _RNG.integers(1, 2**63, 16, dtype=U)]
#: Texts are handled in blocks of about so many bytes, so that memory doesn't follow the size of a batch.
BLOCK = 300_000
_INVERSE = U(pow(int(ODD[0]), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows in them) for runs of rows of about `limit` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        width = np.int64
    elif pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        width = np.int32
    else:
        texts, width = texts.cast(pa.string()), np.int32
    if not len(texts):
        return
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


#: Bytes that end a word: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


BYTE_LOWER = BYTE[LOWER]


class Hasher:
    """Hashes of any stretch of a block of bytes, from running sums."""

    _up, _down = powers(ODD[0], 1), powers(_INVERSE, 1)

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE):
        if len(data) >= len(Hasher._up):
            n = max(len(data) + 1, 2 * BLOCK)
            Hasher._up, Hasher._down = powers(ODD[0], n), powers(_INVERSE, n)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * Hasher._up[: len(data)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * Hasher._down[lo])

    def pieces(self, size: int) -> np.ndarray:
        """The hash of every stretch of `size` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * Hasher._down[:n])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, A-Z in lower case; offsets of rows in them)."""
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]  # a word ends with its text
    first[edge] = ~space[edge]
    last[edge - 1] = ~space[edge - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Hasher(data, BYTE_LOWER).of(start, stop) + (stop - start).astype(U) * ODD[1], np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; fewer words are one run; none, an empty set."""
    for _, data, offsets in blocks(texts):
        words, rows = word_hashes(data, offsets)
        sums = np.zeros(max(len(words) - width + 1, 0), U)
        for j in range(width):
            sums += words[j : len(words) - width + 1 + j] * ODD[2 + j]
        sums = mix(sums)
        for lo, hi in zip(rows[:-1], rows[1:], strict=True):
            if hi - lo >= width:
                yield np.unique(sums[lo : hi - width + 1])
            elif hi > lo:
                yield mix((words[lo:hi] * np.array(ODD[2 : 2 + hi - lo], U)).sum(dtype=U, keepdims=True) + ODD[8 + hi - lo])
            else:
                yield np.zeros(0, U)
