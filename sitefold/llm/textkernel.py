"""Vectorised word handling over the raw UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All separators are ASCII, so working on bytes is exact for
UTF-8. Hashes have 64 bits; nothing here makes Python strings of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_POWERS: dict[str, np.ndarray] = {}
#: Bytes that are hashed at once; a longer word is hashed alone.
SPAN = 1 << 20


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[raw]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SPAN + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most so many bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of the bytes of each word."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        base = starts[k]
        until = max(int(np.searchsorted(ends, base + SPAN, "right")), k + 1)
        s, e = starts[k:until] - base, ends[k:until] - base
        part = raw[base : base + e[-1]]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(((_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        out[k:until] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        k = until
    return mix(out)


def window_hashes(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The hash of each run of ``length`` consecutive words; n - length + 1 values (rows are not regarded)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(seed), np.uint64)
    if length <= 16:
        for k in range(length):
            out *= np.uint64(0xD1342543DE82EF95)
            out += words[k : k + n]
        return mix(out)
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[length:] - total[:-length]) * down[:n] + out)


def run_starts(first_word: np.ndarray, length: int) -> np.ndarray:
    """Indices at which a run of ``length`` words lies within one row."""
    counts = np.diff(first_word)
    room = np.maximum(counts - length + 1, 0)
    total = int(room.sum())
    shift = np.repeat(first_word[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room)
    return np.arange(total) + shift
