"""Vectorised word splitting and hashing of Arrow string arrays, for use inside mapInArrow tasks.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D, after A-Z have
become a-z. Every word gets a 64-bit hash that depends on its bytes alone, so it
is the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds what a task holds beside its Arrow batch.
SLICE_BYTES = 1_000_000


def splitmix(x: np.ndarray | int) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte, after lower-casing.
_BYTE = splitmix(np.arange(256))[_LOWER]
_BASE = 0x9E6C63D0876A9A2B | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64, for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, dtype=U64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and row offsets (from 0, one more than rows), in slices of whole rows of about `most` bytes. Null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("") if array.null_count else array
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n = len(array)
    if not n:
        return
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: Everything but ASCII letters, digits and the bytes of other characters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length k the 64-bit hash of each word's first k bytes; 0 where the word has no more than k."""
    up, down = _power(len(data) + 1)
    out = []
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        for k in lengths:
            to = np.minimum(start + k, end)
            out.append(np.where(end - start > k, splitmix((total[to] - total[start]) * down[start] + U64(k << 32)), U64(0)))
    return out


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: start byte, end byte, 64-bit hash; and for each row the number of its first word (one entry more than rows).

    A row's end also ends its last word.
    """
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~space[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        hashes = splitmix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    return start, end, hashes, np.searchsorted(start, offsets)
