"""Interning of byte spans in an open-addressed numpy table, keyed by xxhash64 and verified byte by byte.

Whole batches go in at once: each round, the keys still open claim the free slot at their place, one claim per slot holds, and a key is
settled once its slot's owner has the same hash, the same length and the same bytes; the others probe the next place. Equal spans thus
share a slot, and spans that only share a hash never do.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import xxhash

# The primes of 64-bit xxHash.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

_LONG = 32  # spans from here on are hashed one by one by the library


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _number(padded: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The little-endian number of ``width`` bytes at each place."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out |= padded[at + j].astype(np.uint64) << np.uint64(8 * j)
    return out


def xxhash64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxHash64 with seed 0 of every byte span."""
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = P5 + lengths.astype(np.uint64)
    at, left = starts.copy(), np.where(lengths < _LONG, lengths, 0)
    while len(whole := np.flatnonzero(left >= 8)):
        lane = _rotl(_number(padded, at[whole], 8) * P2, 31) * P1
        h[whole] = _rotl(h[whole] ^ lane, 27) * P1 + P4
        at[whole] += 8
        left[whole] -= 8
    half = np.flatnonzero(left >= 4)
    h[half] = _rotl(h[half] ^ _number(padded, at[half], 4) * P1, 23) * P2 + P3
    at[half] += 4
    left[half] -= 4
    while len(some := np.flatnonzero(left > 0)):
        h[some] = _rotl(h[some] ^ padded[at[some]].astype(np.uint64) * P5, 11) * P1
        at[some] += 1
        left[some] -= 1
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(lengths >= _LONG)
    if len(long):
        raw = data.tobytes()
        h[long] = [xxhash.xxh64_intdigest(raw[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return h


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of every byte span, as int64."""
    crc, lengths = np.full(len(starts), 0xFFFFFFFF, np.uint32), ends - starts
    short = np.flatnonzero(lengths < _LONG)
    for j in range(int(lengths[short].max()) if len(short) else 0):
        short = short[lengths[short] > j]
        crc[short] = _CRC[(crc[short] ^ data[starts[short] + j]) & 255] ^ crc[short] >> np.uint32(8)
    out = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(lengths >= _LONG)
    if len(long):
        raw = data.tobytes()
        out[long] = [zlib.crc32(raw[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of equal ``lengths`` at ``a`` and ``b`` hold the same bytes."""
    same = a == b
    apart = np.flatnonzero(~same)
    if len(apart) == 0:
        return same
    n = lengths[apart]
    begin = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(begin, n)
    equal = data[np.repeat(a[apart], n) + within] == data[np.repeat(b[apart], n) + within]
    same[apart] = np.logical_and.reduceat(equal, begin)
    return same


class Interned(NamedTuple):
    slot: np.ndarray  # of each span; slots are numbered from 0 without gaps
    first: np.ndarray  # one span of each slot
    count: np.ndarray  # spans of each slot
    bucket: np.ndarray  # CRC-32 of each slot's bytes modulo the number of buckets


def intern_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, keys: np.ndarray | None = None) -> Interned:
    """Every non-empty span's slot; ``keys`` replaces the hashes in tests of clashes."""
    n, lengths = len(starts), ends - starts
    keys = xxhash64(data, starts, ends) if keys is None else keys
    mask = (1 << max(4, int(2 * n).bit_length())) - 1
    owner = np.full(mask + 1, -1, np.int64)
    place = (keys & np.uint64(mask)).astype(np.int64)
    rest = np.arange(n)
    while len(rest):
        at = place[rest]
        free = owner[at] < 0
        owner[at[free]] = rest[free]
        holder = owner[at]
        alike = np.flatnonzero((keys[holder] == keys[rest]) & (lengths[holder] == lengths[rest]))
        settled = np.zeros(len(rest), bool)
        settled[alike] = _same_bytes(data, starts[holder[alike]], starts[rest[alike]], lengths[rest[alike]])
        rest = rest[~settled]
        place[rest] = place[rest] + 1 & mask
    taken = np.flatnonzero(owner >= 0)
    number = np.zeros(mask + 1, np.int64)
    number[taken] = np.arange(len(taken))
    slot, first = number[place], owner[taken]
    return Interned(slot, first, np.bincount(slot, minlength=len(taken)), crc32(data, starts[first], ends[first]) % buckets)
