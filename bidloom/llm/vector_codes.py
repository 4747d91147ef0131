"""Codes for vectors: each vector is cut into parts, and each part gets the number of its nearest entry in that part's codebook.

Components become whole numbers, floor(scale * x). Each codebook starts from the vectors of the least ids and goes through rounds of
assignment and averaging (floor of sum by count), all in whole numbers, so that results do not depend on partitioning.

Assignments use adaptive distance bounds after Drake and Hamerly. A written table keeps, for each part of each vector, its b closest
entries, an upper bound for the nearest one, ordered lower bounds for the others and one outer bound for all entries that are not kept.
When codebooks move, bounds move by as much. While the upper bound lies below the first lower bound the assignment is certain; otherwise
the entries that the upper bound reaches are compared by exact whole-number distances, ties to the lower index; when it reaches the outer
bound all entries are. How many entries were needed is counted, and b follows it from round to round. Bounds decide the work only, never
the result: doubtful cases, ties among them, are always settled by whole numbers.

What goes through the driver is the codebooks and their sums (parts x entries x part width), whatever the number of vectors.

Defined results: vectors that are NULL or hold a NULL, NaN or infinite component are dropped, and so are those whose length is not that
of the first kept vector (the least id whose vector divides into the parts). Whole-number components are held to a bound at which squared
distances fit 64 bits (2^27 for 64 components, that is 131,072.0). Repeated ids are rows of their own; among the first ones equal ids go by their
vectors, and a NULL id comes last. With fewer vectors than entries the codebooks are as small. Without vectors the result is empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
FIRST_NEAR, LEAST_NEAR, MOST_NEAR = 16, 4, 32  # entries kept per part: at first, at least, at most
GROW_SHARE = 0.25  # of the parts compared with all entries; beyond it twice as many entries are kept
CHUNK = 1 << 20  # numbers of one distance table

_NUMBER, _BOUND = np.dtype("<u2"), np.dtype("<f4")


class Books(NamedTuple):
    entries: np.ndarray  # (parts, entries, width), whole numbers
    moved: np.ndarray  # (parts, entries): how far each entry went in the last round, rounded up


def largest(dim: int) -> int:
    """Components within this bound have squared distances of at most 2^62 over all parts."""
    return math.isqrt((1 << 60) // dim)


def whole_numbers(column: pa.Array, dim: int, scale: int, parts: int) -> np.ndarray:
    """(rows, parts, width) of a column of equally long lists of finite numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bound = largest(dim)
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return np.clip(x, -bound, bound).astype(np.int64).reshape(len(column), parts, dim // parts)


def exact_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) in whole numbers; products of doubles are exact as long as all sums stay below 2^53."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
    table = (x * x).sum(1)[:, None] + (entries * entries).sum(1)[None, :] - 2 * (x @ entries.T)
    return table.astype(np.int64)


def _closest(table: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``kept`` closest entries by (distance, index), their distances, and the next distance (infinite when there is none)."""
    order = np.argsort(table, axis=1, kind="stable")[:, : kept + 1]
    near = np.take_along_axis(table, order, 1)
    beyond = near[:, kept].astype(np.float64) if table.shape[1] > kept else np.full(len(table), np.inf)
    return order[:, :kept], near[:, :kept], beyond


class Bounds(NamedTuple):
    near: np.ndarray  # (rows, b) entries; the first one is the assignment
    upper: np.ndarray  # of the distance to the first
    lower: np.ndarray  # (rows, b): of the distances to the second, third, ... and, last, to all entries that are not kept


def search_all(x: np.ndarray, entries: np.ndarray, kept: int) -> Bounds:
    near, distance, beyond = _closest(exact_distances(x, entries), kept)
    return Bounds(near, np.sqrt(distance[:, 0].astype(np.float64)), np.sqrt(np.column_stack([distance[:, 1:].astype(np.float64), beyond])))


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, b: Bounds) -> tuple[Bounds, np.ndarray]:
    """The bounds after the entries moved, with certain assignments, and the number of kept entries each row needed (b + 1: all entries)."""
    kept = b.near.shape[1]
    upper = b.upper + moved[b.near[:, 0]]
    lower = np.column_stack([b.lower[:, :-1] - moved[b.near[:, 1:]], b.lower[:, -1] - moved.max(initial=0.0)])
    lower = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    near, needed = b.near.copy(), np.ones(len(x), np.int64)

    def reached(rows):
        # The slack exceeds all rounding; what it adds is compared in whole numbers.
        return (lower[rows] <= (upper[rows] * (1 + 1e-6) + 1e-6)[:, None]).sum(axis=1)

    open_ = np.flatnonzero(lower[:, 0] <= upper * (1 + 1e-6) + 1e-6)
    diff = x[open_] - entries[near[open_, 0]]
    upper[open_] = np.sqrt((diff * diff).sum(axis=1).astype(np.float64))
    count = reached(open_)
    open_, count = open_[count > 0], count[count > 0]

    everything = open_[count == kept]
    if len(everything):
        found = search_all(x[everything], entries, kept)
        near[everything], upper[everything], lower[everything] = found
        needed[everything] = kept + 1
    some, reach = open_[count < kept], count[count < kept]
    if len(some):
        width = int(reach.max()) + 1
        rows = np.arange(len(some))[:, None]
        diff = x[some][:, None, :] - entries[near[some, :width]]
        distance = (diff * diff).sum(axis=2)
        used = np.arange(width)[None, :] <= reach[:, None]
        # Compared entries in the order of (distance, index), then the others as they were.
        order = np.lexsort((near[some, :width], np.where(used, distance, np.iinfo(np.int64).max)), axis=1)
        beyond = np.column_stack([np.zeros(len(some)), lower[some, : width - 1]])
        known = np.where(used, np.sqrt(distance.astype(np.float64)), beyond)
        order = np.where(used, order, np.arange(width)[None, :])
        near[some, :width] = near[some, :width][rows, order]
        known = known[rows, order]
        upper[some] = known[:, 0]
        lower[some, : width - 1] = known[:, 1:]
        needed[some] = reach + 1
    return Bounds(near, upper, lower), needed


def resized(b: Bounds, kept: int) -> Bounds:
    """The bounds with ``kept`` entries: more are filled up with the assignment itself, fewer widen what the outer bound covers."""
    had = b.near.shape[1]
    if kept < had:
        return Bounds(b.near[:, :kept], b.upper, np.column_stack([b.lower[:, : kept - 1], b.lower[:, kept - 1 :].min(axis=1)]))
    if kept > had:
        fill = np.repeat(b.near[:, :1], kept - had, axis=1)
        return Bounds(np.column_stack([b.near, fill]), b.upper, np.column_stack([b.lower, np.repeat(b.lower[:, -1:], kept - had, axis=1)]))
    return b


def _packed(bounds: list[Bounds]) -> tuple[pa.Array, pa.Array]:
    """Entries and bounds of all parts as one binary value per row; bounds are widened to the next short float."""
    near = np.column_stack([b.near for b in bounds]).astype(_NUMBER)
    sides = [(np.nextafter(b.upper.astype(_BOUND), _BOUND.type(np.inf)), np.nextafter(b.lower.astype(_BOUND), _BOUND.type(-np.inf))) for b in bounds]
    both = np.column_stack([x for upper, lower in sides for x in (upper, lower)]).astype(_BOUND)
    return _binary(near), _binary(both)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    offsets = (np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _unpacked(near: pa.Array, both: pa.Array, kept: list[int]) -> list[Bounds]:
    n = len(near)
    numbers = np.frombuffer(b"".join(near.to_pylist()), _NUMBER).reshape(n, sum(kept)).astype(np.int64)
    sides = np.frombuffer(b"".join(both.to_pylist()), _BOUND).reshape(n, sum(kept) + len(kept)).astype(np.float64)
    bounds, at = [], 0
    for p, b in enumerate(kept):
        bounds.append(Bounds(numbers[:, at : at + b], sides[:, at + p], sides[:, at + p + 1 : at + p + 1 + b]))
        at += b
    return bounds


def _chunks(batch: pa.RecordBatch, dim: int, entries: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CHUNK // max(dim, entries))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


class _Sums:
    """What a task adds up: counts and component sums of each entry, and how many entries were needed."""

    def __init__(self, books: Books, kept: list[int]):
        self.n = np.zeros(books.entries.shape[:2], np.int64)
        self.total = np.zeros(books.entries.shape, np.int64)
        self.needed = [np.zeros(b + 2, np.int64) for b in kept]

    def add(self, part: int, x: np.ndarray, entry: np.ndarray, needed: np.ndarray | None) -> None:
        self.n[part] += np.bincount(entry, minlength=self.n.shape[1])
        order = np.argsort(entry, kind="stable")
        found, first = np.unique(entry[order], return_index=True)
        if len(found):
            self.total[part, found] += np.add.reduceat(x[order], first, axis=0)
        if needed is not None:
            self.needed[part] += np.bincount(needed, minlength=len(self.needed[part]))

    def rows(self) -> list[pa.Array]:
        part, entry = np.nonzero(self.n)
        rows = [(int(p), int(e), int(self.n[p, e]), self.total[p, e].tolist()) for p, e in zip(part, entry)]
        rows += [(p, -1 - j, int(c), []) for p, counts in enumerate(self.needed) for j, c in enumerate(counts) if c]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]


_SUMS = "part int, entry int, n long, total array<bigint>"


def _round(rows: DataFrame, books: Books, had: list[int] | None, kept: list[int], dim: int, kinds: str, scale: int) -> DataFrame:
    """One assignment: (vec_id, label, x, near, bounds) of every vector, and beside them rows of sums per task."""
    parts, entries = books.entries.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, names, types = _Sums(books, had or kept), ["vec_id", "label", "x", "near", "bounds", "part", "entry", "n", "total"], None
        for batch in batches:
            types = [batch.column(0).type, batch.column(1).type]
            for chunk in _chunks(batch, dim, entries):
                x = whole_numbers(chunk.column(2), dim, scale if had is None else 1, parts)
                old = _unpacked(chunk.column(3), chunk.column(4), had) if had else [None] * parts
                bounds = []
                for p in range(parts):
                    if old[p] is None:
                        b, needed = search_all(x[:, p], books.entries[p], kept[p]), None
                    else:
                        b, needed = reassign(x[:, p], books.entries[p], books.moved[p], old[p])
                    sums.add(p, x[:, p], b.near[:, 0], needed)
                    bounds.append(resized(b, kept[p]))
                flat = pa.array(x.reshape(-1).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), flat)
                empty = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), lists, *_packed(bounds), *empty], names)
        if types:
            added = sums.rows()
            empty = [pa.nulls(len(added[0]), t) for t in (*types, pa.list_(pa.int32()), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, *added], names)

    return rows.mapInArrow(run, f"{kinds}, x array<int>, near binary, bounds binary, {_SUMS}")


def _next_books(table: DataFrame, books: Books, kept: list[int]) -> tuple[Books, list[int]]:
    """The averaged codebooks with what they moved, and the number of entries to keep in the next round."""
    sums = table.filter("part IS NOT NULL").select("part", "entry", "n", F.posexplode_outer("total").alias("at", "value"))
    rows = sums.groupBy("part", "entry", F.coalesce("at", F.lit(0)).alias("at")).agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    # parts x entries x width rows, whatever the number of vectors
    part, entry, at, n, value = (c.to_numpy(zero_copy_only=False) for c in rows.toArrow().combine_chunks().columns)
    entries = books.entries.copy()
    needed = [np.zeros(b + 2, np.int64) for b in kept]
    real = entry >= 0
    entries[part[real], entry[real], at[real]] = value[real].astype(np.int64) // n[real]
    for p, e, c in zip(part[~real], entry[~real], n[~real]):
        needed[p][-1 - e] += c
    diff = entries - books.entries
    moved = np.nextafter(np.sqrt((diff * diff).sum(axis=2).astype(np.float64)), np.inf)
    return Books(entries, np.where(diff.any(axis=2), moved, 0.0)), [_adapted(b, c, entries.shape[1]) for b, c in zip(kept, needed)]


def _adapted(kept: int, needed: np.ndarray, entries: int) -> int:
    """More entries when many parts had to be compared with all; otherwise as many as any part needed that was settled by those kept."""
    total = needed.sum()
    if total == 0:
        return kept
    if needed[-1] > GROW_SHARE * total:
        return min(MOST_NEAR, 2 * kept, entries)
    return max(min(LEAST_NEAR, entries), min(kept, int(np.flatnonzero(needed[:-1]).max(initial=0))))


def _first_vectors(vectors: DataFrame, parts: int, entries: int, scale: int) -> tuple[int, np.ndarray]:
    """Length of the first kept vector, and the first ``entries`` vectors of that length cut into parts."""
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = vectors.orderBy(*by_id).limit(entries).select("embedding").toArrow().column(0).combine_chunks()
    if len(first) == 0:
        return 0, np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0])
    if any(len(v) != dim for v in first):
        first = vectors.filter(F.size("embedding") == dim).orderBy(*by_id).limit(entries).select("embedding").toArrow().column(0).combine_chunks()
    return dim, whole_numbers(first, dim, scale, parts).transpose(1, 0, 2).copy()


def checksum(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, near: int = FIRST_NEAR
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector of (vec_id, embedding, label), and the codebooks (parts, entries, width)."""
    if not 0 < entries <= 1 << 16:
        raise ValueError("a codebook has 1 to 65,536 entries")
    usable = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sized = (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    vectors = vectors.select("vec_id", "label", "embedding").filter(sized & usable)
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    dim, first = _first_vectors(vectors, parts, entries, scale)
    if dim == 0:
        return vectors.sparkSession.createDataFrame([], f"{kinds}, code string, error long"), first
    books, digits = Books(first, np.zeros(first.shape[:2])), max(2, len(f"{first.shape[1] - 1:x}"))
    rows, had, kept = vectors.filter(F.size("embedding") == dim), None, [min(near, first.shape[1])] * parts
    for r in range(rounds):
        table = stored(_round(rows, books, had, kept, dim, kinds, scale), f"codes-{r}")
        books, wanted = _next_books(table, books, had or kept)
        rows, had, kept = table.filter("part IS NULL").select("vec_id", "label", "x", "near", "bounds"), kept, wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch, dim, first.shape[1]):
                x = whole_numbers(chunk.column(2), dim, 1 if had else scale, parts)
                old = _unpacked(chunk.column(3), chunk.column(4), had) if had else [None] * parts
                code, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
                for p in range(parts):
                    b = search_all(x[:, p], books.entries[p], 1) if old[p] is None else reassign(x[:, p], books.entries[p], books.moved[p], old[p])[0]
                    code[:, p] = b.near[:, 0]
                    diff = x[:, p] - books.entries[p][code[:, p]]
                    error += (diff * diff).sum(axis=1)
                names = np.array([f"{e:0{digits}x}" for e in range(first.shape[1])], dtype=object)
                text = names[code].sum(axis=1)
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"{kinds}, code string, error long"), books.entries


def encode_with_errors(vectors: DataFrame, **settings) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): ``label_error`` adds up the errors of one label, NULL labels together."""
    codes, entries = encode(vectors, **settings)
    codes = stored(codes, "codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(checksum(entries)).alias("codebooks_sha256"))
