"""Words and word hashes of whole Arrow batches in numpy.

Texts are read as UTF-8 bytes with A-Z in lower case. A word is a run of bytes without the six ASCII white-space characters, so no
character is ever cut. Batches are handed on in runs of whole documents of about ``RUN_BYTES``, which bounds the memory of one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)


class Words(NamedTuple):
    rows: slice  # of the batch
    data: np.ndarray  # lower-cased bytes of these rows
    offsets: np.ndarray  # byte range of each row, n + 1
    starts: np.ndarray  # byte range of each word
    ends: np.ndarray
    first: np.ndarray  # word range of each row, n + 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of whole documents, about ``run_bytes`` each."""
    raw, at = text_bytes(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + run_bytes, side="right")) - 1)
        yield slice(i, j), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each row's first word (n + 1)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] |= word[inner]
    closes[inner - 1] |= word[inner - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def split_words(column: pa.Array, run_bytes: int = RUN_BYTES, space: np.ndarray = _SPACE) -> Iterator[Words]:
    for rows, raw, offsets in runs(column, run_bytes):
        data = _LOWER[raw]
        yield Words(rows, data, offsets, *word_bounds(data, offsets, space))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty byte span; spans do not overlap and lie in order."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    power = np.multiply.accumulate(np.full(int(lengths.max()), _MULT | np.uint64(1), dtype=np.uint64))
    picked = data[within + np.repeat(starts, lengths)]
    return mix64(np.add.reduceat(_BYTE[picked] * power[within], begin) + lengths.astype(np.uint64))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbouring words of one document; with fewer than k words the whole sequence, without words none."""
    if len(hashes) == 0:
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = out * _MULT + hashes[j : j + n]
    return mix64(out)
