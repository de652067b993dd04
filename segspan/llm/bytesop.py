"""Vectorised text primitives on the UTF-8 bytes of an Arrow batch.

Everything here works on whole texts, concatenated: one numpy pass serves all
documents of a chunk, so no Python loop runs per word or per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Local(dict):
    """A cache that stays in its process: functions that use it travel with an empty one."""

    def __reduce__(self):
        return _Local, ()


_POWERS: dict[str, np.ndarray] = _Local()


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and leaves every other byte."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_table(kind: str) -> np.ndarray:
    """Bytes that belong to a word: `alnum` is 0-9, a-z and all above 0x7F; `space` is all but space and 0x09-0x0D."""
    t = np.zeros(256, dtype=bool)
    if kind == "alnum":
        t[48:58] = t[97:123] = t[128:] = True
    else:
        t[:] = True
        t[9:14] = t[32] = False
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i in 0..n."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) of a string column with at most `limit` bytes (one row may have more): (i, j, bytes, offsets).

    A null has no bytes.
    """
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(b: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and the first word's index of every text and the end."""
    if not len(b):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = table[b]
    before, after = np.empty_like(w), np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    after[-1], after[:-1] = False, w[1:]
    cut = offsets[(offsets > 0) & (offsets < len(b))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = P**i times the hash of bytes i..j-1."""
    up, _ = powers(len(b))
    h = np.empty(len(b) + 1, np.uint64)
    h[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=h[1:])
    return h


def range_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from prefix_hash."""
    _, down = powers(len(h) - 1)
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX2)


def word_hashes(b: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first, hashes) of all words of a chunk."""
    starts, ends, first = word_bounds(b, offsets, table)
    return starts, ends, first, range_hash(prefix_hash(b), starts, ends)


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1, for every i with so many words after it (text borders are not looked at)."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, _ = powers(k)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += w[j : j + n] * up[j + 1]
    return mix(h + np.uint64(k))
