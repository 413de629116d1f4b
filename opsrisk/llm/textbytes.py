"""Vectorised work on the UTF-8 bytes of an Arrow text column.

Every function takes the concatenated bytes of many texts and their offsets, so
that one numpy pass serves a whole batch; nothing crosses a text's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U64 = np.uint64
_MULT = _U64(0x9E3779B97F4A7C15)
# Powers of the odd multiplier and of its inverse modulo 2^64, grown on demand.
_POWERS: dict[str, np.ndarray] = {}
_KEPT = 1 << 19  # of them; more are made anew for each use, so that a worker does not hold what one long text took

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# One random 64-bit value per byte; seeded, so every task draws the same.
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(_U64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes (a longer text stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def made(size: int) -> tuple[np.ndarray, np.ndarray]:
        up = np.full(size, _MULT, _U64)
        up[0] = 1
        down = np.full(size, _U64(pow(int(_MULT), -1, 1 << 64)), _U64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)

    if n > _KEPT:
        return made(n)
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = made(min(_KEPT, max(2 * n, 1 << 16)))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over 64-bit integers."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash takes the hash of any byte range."""
    _, down = powers(len(data) + 1)
    out = np.empty(len(data) + 1, _U64)
    out[0] = 0
    np.multiply(_BYTE_VALUE[data], down[: len(data)], out=out[1:])
    np.add.accumulate(out, out=out)
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of bytes [start, end) for every pair; equal bytes hash alike wherever they stand."""
    up, _ = powers(len(prefix))
    # sum of value * m^-(i) over the range, scaled so that its first byte has weight 1
    return mix((prefix[ends] - prefix[starts]) * up[starts] + (ends - starts).astype(_U64))


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all blank-separated words, and each text's offset into them."""
    black = ~_BLANK[data]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    first[at] = black[at]
    at = offsets[1:][full] - 1
    last[at] = black[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and each text's offset into them."""
    starts, ends, at = word_ranges(data, offsets)
    return range_hash(prefix_hash(data), starts, ends), at


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of aligned hash arrays."""
    out = parts[0].copy()
    for x in parts[1:]:
        out = mix(out * _MULT + x)
    return out


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each text's offset into them.

    A text of one to k-1 words has one shingle, of all its words; a text without words has none.
    """
    n = np.diff(at)
    number = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate(([0], np.cumsum(number)))
    out = np.empty(out_at[-1], _U64)
    if len(hashes) >= k:
        rolled = combine([hashes[i : len(hashes) - k + 1 + i] for i in range(k)])
        long = n >= k
        pick = np.repeat(at[:-1][long] - out_at[:-1][long], number[long])
        slots = np.repeat(long, number)
        out[slots] = rolled[np.flatnonzero(slots) + pick]
    for d in np.flatnonzero((n > 0) & (n < k)):
        out[out_at[d]] = combine([hashes[i : i + 1] for i in range(at[d], at[d + 1])])[0] ^ _U64(n[d])
    return out, out_at
