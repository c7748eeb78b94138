"""Vectorised word hashing over Arrow text buffers.

A chunk of documents is one byte array with document offsets.  Words are maximal runs
of word bytes; a word's hash is a polynomial over per-byte random values modulo 2**64,
computed for all words of a chunk with a handful of numpy passes and no Python string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed seeds of the hash family; they only have to be the same in every worker.
_VALUE_SEED, _BASE, _STEP = 20240229, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 19

_VALUES = np.random.default_rng(_VALUE_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.arange(65, 91)


def _lowered(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[_UPPER] = out[_UPPER + 32]
    return out


#: Words between ASCII white space, A-Z lower-cased.
SPACED = (~_WHITE, np.where(_WHITE, np.uint64(0), _lowered(_VALUES)))
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Words of ASCII letters, digits and any non-ASCII bytes, A-Z lower-cased.
ALNUM = (_ALNUM, np.where(_ALNUM, _lowered(_VALUES), np.uint64(0)))

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``CHUNK_BYTES``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk in order, and where each document's words begin (one more than documents)."""
    is_word, values = kind
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    up, down = _powers(len(data))
    sums = np.add.reduceat(values[data] * up[: len(data)], starts)
    return mixed(sums * down[starts]), np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, across document ends too; the caller cuts them out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_STEP) + words[k : k + n]
    return mixed(out)
