"""Words of many texts at once, in numpy over UTF-8 bytes.

A block is a byte array holding whole texts back to back and the offsets of
each. Words are runs of bytes of a given class; as every separator here is an
ASCII byte and all bytes of other characters are 128 or more, runs of bytes are
runs of characters. A run's 64-bit hash is a sum over its eight-byte chunks, each
mixed with its place by nonlinear steps: unlike a polynomial modulo 2**64, whose
sums cancel on Thue-Morse strings whatever the base, it leaves two different
runs the same hash by the ordinary chance of 64 bits only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at white space only.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of digits, letters and non-ASCII characters, once in lower case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_RNG = np.random.Generator(np.random.PCG64(20240817))
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of a chunk with fewer than eight bytes, those that belong to the run.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.empty(size, np.uint64)
        have[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) for runs of rows of a string or binary column of about ``limit`` bytes. Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        size = np.where(np.asarray(column.is_null()), 0, np.diff(offs))
        if (size != np.diff(offs)).any():  # bytes below a null
            raw = np.concatenate([raw[a : a + n] for a, n in zip(offs, size, strict=False)]) if size.sum() else np.zeros(0, np.uint8)
            offs = np.concatenate(([0], np.cumsum(size)))
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes raw[start:end], none of them empty; the runs may overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    many = (size + 7) >> 3
    first = np.cumsum(many) - many
    k = np.arange(int(many.sum())) - np.repeat(first, many)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    v = eight[np.repeat(start, many) + 8 * k]
    v &= _MASK[np.minimum(np.repeat(size, many) - 8 * k, 8)]
    v = mix(mix(v ^ np.uint64(0x9E3779B97F4A7C15)) + k.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return mix(np.add.reduceat(v, first) + size.astype(np.uint64) * np.uint64(0xA3EC647659359ACD))


def words(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, start, end) of every word, in order. ``inside``: bytes of words, after A-Z became a-z."""
    low = LOWER[raw]
    ins = inside[low]
    begin = ins.copy()
    begin[1:] &= ~ins[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    begin[heads] = ins[heads]
    start = np.flatnonzero(begin)
    stop = ins.copy()
    stop[:-1] &= ~ins[1:]
    tails = heads[1:] - 1
    stop[tails] = ins[tails]
    if len(ins):
        stop[-1] = ins[-1]
    end = np.flatnonzero(stop) + 1
    h = run_hashes(low, start, end)
    return h, np.searchsorted(offs, start, "right") - 1, start, end


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words; the last n - 1 places are absent. Texts are not told apart."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + size]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out + np.uint64(n))
