"""Repeated passages by sparse suffix arrays.

Of every text only the suffixes at content-selected places are kept: the places of the least word-sequence hash in each window of
``WINDOW`` places, so that equal passages select equal places whatever surrounds them, and every passage of ``PASSAGE`` words holds one.
Suffixes whose first ``KEY`` words occur nowhere else can have no partner and are left out. The others are sorted twice, by the words to
the right and by the words to the left; each is compared with its neighbour, and the match is extended to both sides. The neighbours also
bound how far any match of a suffix can reach on either side. Where these bounds leave windows of ``PASSAGE`` words that no neighbour shares,
windows of the same key and the same places in them are sorted by hash and compared with their neighbours in that order. A window belongs
to one place, the least of its first ``WINDOW``, and suffixes with the same words on both sides give their windows once; keys of many
places are dealt to several tasks. Stretches of ``PASSAGE`` or more equal words are united
per document.

Words are runs without ASCII white space, A-Z in lower case. Sorting is by ranges of the whole suffix key and the document, so copies
of one passage, and windows of one hash, spread over many tasks; the two ends of every sorted partition are compared afterwards.

Defined results: NULL, empty and short texts have no passage. A passage that occurs twice in one document counts as repeated.
Repeated rows repeat each other's passages. Documents without an id are matched like others and reported together, with a NULL doc_id;
a NULL partner is one of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm.common import stored
from bidloom.llm.words import _MULT, mix64, shingles, span_hashes, split_words

PASSAGE, KEY, WINDOW = 50, 8, 42
HOT = 4000  # places of one key that meet in one task; a key with more is dealt to several
REACH = PASSAGE  # words looked at on each side of a place; places are at most WINDOW apart, so stretches overlap


def selected_places(keys: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least key in every window of ``window`` neighbouring places (the last among equals)."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    window = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(keys, window)
    best = window - 1 - np.argmin(views[:, ::-1], axis=1) + np.arange(len(views))
    return np.unique(best)


def own_windows(keys: np.ndarray, at: np.ndarray, passage: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For selected places: the least and greatest number of words to the right in the windows of ``passage`` words that belong to them.

    A window belongs to the least key of its first ``window`` places, the last among equals.
    """
    padding = np.full(window - 1, np.iinfo(keys.dtype).max, keys.dtype)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([padding, keys, padding]), window - 1)
    here = keys[at][:, None]
    less, least = (views[at] < here)[:, ::-1], views[at + window] <= here
    left = np.where(less.any(axis=1), less.argmax(axis=1) + 1, window)
    right = np.where(least.any(axis=1), least.argmax(axis=1) + 1, window)
    return passage + 1 - left, right + passage - window


def _word_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for w in split_words(column):
        hashes = span_hashes(w.data, w.starts, w.ends)
        for i in range(len(w.first) - 1):
            yield w.rows.start + i, hashes[w.first[i] : w.first[i + 1]]


def _keys(hashes: np.ndarray, key: int) -> np.ndarray:
    return shingles(hashes, key).view(np.int64) if len(hashes) >= key else np.zeros(0, np.int64)


def suffix_places(docs: DataFrame, passage: int, key: int, window: int) -> DataFrame:
    """(doc_id, pos, key): the selected suffixes of every text long enough to hold a passage."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for i, hashes in _word_rows(batch.column(1)):
                if len(hashes) >= passage:
                    k = _keys(hashes, key)
                    at = selected_places(k, window)
                    rows.append(np.full(len(at), i))
                    places.append(at.astype(np.int32))
                    keys.append(k[at])
            names = batch.column(0).take(pa.array(np.concatenate(rows)))
            arrays = [names, pa.array(np.concatenate(places)), pa.array(np.concatenate(keys))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "pos", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pos int, key bigint")


def with_context(docs: DataFrame, places: DataFrame, key: int, reach: int, window: int) -> DataFrame:
    """(doc_id, pos, key, low, high, right, left): the words on both sides of each place as bytes of four per word, nearest first, and the
    range of its own windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = places.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("pos").alias("places"))
    joined = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            names, rows = batch.column(0), []
            out: list[tuple[int, int, int, int, int, bytes, bytes]] = []
            for i, hashes in _word_rows(batch.column(1)):
                k = _keys(hashes, key)
                words = (hashes >> np.uint64(32)).astype(">u4")
                back = words[::-1]
                n = len(words)
                at = np.sort(np.array([q for q in wanted[i] if q < len(k)], np.int64))
                if len(at) == 0 or n < reach:
                    continue
                for p, low, high in zip(at.tolist(), *(x.tolist() for x in own_windows(k, at, reach, window))):
                    rows.append(i)
                    out.append((p, int(k[p]), low, high, words[p : p + reach].tobytes(), back[n - p : n - p + reach].tobytes()))
                if len(out) >= 20_000:
                    yield _context_batch(names, rows, out)
                    rows, out = [], []
            yield _context_batch(names, rows, out)

    return joined.mapInArrow(run, f"doc_id {kind}, pos int, key bigint, low int, high int, right binary, left binary")


def _context_batch(names: pa.Array, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[]] * 6
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    arrays = [names.take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "pos", "key", "low", "high", "right", "left"])


def _common(a: bytes, b: bytes) -> int:
    """Equal words at the front."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, "u4", n), np.frombuffer(b, "u4", n)
    return int(np.argmax(x != y))


def _shared(a: tuple, b: tuple) -> tuple[int, int]:
    """Equal words to the right and to the left of two suffixes of one key; a, b: (doc, pos, key, right, left)."""
    return (_common(a[3], b[3]), _common(a[4], b[4])) if a[2] == b[2] else (-1, -1)


def _spans(a: tuple, b: tuple, right: int, left: int, passage: int) -> list[tuple]:
    """Spans of both suffixes when the stretch they share is long enough."""
    if right < 0 or right + left < passage:
        return []
    return [(x[0], x[1] - left, x[1] + right, y[0]) for x, y in ((a, b), (b, a))]


def neighbours(suffixes: DataFrame, side: str, other: str, passage: int, key: int) -> DataFrame:
    """(doc_id, begin, end, partner): spans from comparing each suffix with the next in the order of ``side``.

    Rows of edge -2 are (doc_id, begin: place, end: most words on ``side`` that a suffix shares with any other, part: words on the other
    side it shares with that neighbour, key, low and high: its own windows); left out where that neighbour holds all there is to find on
    its side.
    """
    all_of = passage - key if side == "right" else passage
    kind = suffixes.schema["doc_id"].dataType.simpleString()
    ordered = suffixes.select("doc_id", "pos", "key", "right", "left", "low", "high").orderBy("key", side, other, "doc_id", "pos")
    names = ["doc_id", "begin", "end", "partner", "part", "edge", "key", "right", "left", "low", "high"]
    schema = f"doc_id {kind}, begin int, end int, partner {kind}, part int, edge int, key bigint, right binary, left binary, low int, high int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            doc_kind = batch.schema.field(0).type
            kinds = [doc_kind, pa.int32(), pa.int32(), doc_kind, pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]

            def made(rows: list[tuple], kinds=kinds) -> pa.RecordBatch:
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

            def edge(row: tuple, first: int, part=part) -> tuple:
                return row[0], row[1], 0, None, part, first, row[2], row[3], row[4], None, None

            def bound(row: tuple, most: tuple[int, int]) -> list[tuple]:
                return [(row[0], row[1], most[0], None, most[1], -2, row[2], None, None, row[5], row[6])] if 0 <= most[1] < all_of else []

            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            out = []
            for row in rows:
                if before is None:
                    out.append(edge(row, 0))
                    most = (passage, 0)  # the neighbour lies in another partition
                else:
                    right, left = _shared(before, row)
                    out += [(*span, part, -1, 0, None, None, None, None) for span in _spans(before, row, right, left, passage)]
                    pair = (right, left) if side == "right" else (left, right)
                    out += bound(before, max(most, pair))
                    most = pair
                before = row
            yield made(out)
        if before is not None:
            yield made([edge(before, 1), *bound(before, (passage, 0))])

    return ordered.mapInArrow(run, schema)


def _edge_spans(found: DataFrame, passage: int) -> DataFrame:
    """Spans of the neighbours that lie in different partitions: two rows per partition, compared in the partitions' order."""
    edges = found.filter("edge >= 0").select("doc_id", "begin", "key", "right", "left", "part", "edge").coalesce(1).sortWithinPartitions("part", "edge")
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, before_part = None, None
        for batch in batches:
            out = []
            for *row, part, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if before is not None and part != before_part:
                    out += _spans(before, tuple(row), *_shared(before, tuple(row)), passage)
                before, before_part = tuple(row), part
            columns = list(zip(*out)) if out else [[]] * 4
            doc_kind = batch.schema.field(0).type
            arrays = [pa.array(c, k) for c, k in zip(columns, [doc_kind, pa.int32(), pa.int32(), doc_kind])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "begin", "end", "partner"])

    return edges.mapInArrow(run, f"doc_id {kind}, begin int, end int, partner {kind}")


def _open_ranges(by_right: DataFrame, by_left: DataFrame, passage: int) -> DataFrame:
    """(key, from, to): words to the right of the place in own windows that suffixes of the key may share with others than their neighbours."""

    def bounds(found: DataFrame, reach: str, held: str) -> DataFrame:
        return found.filter("edge = -2").select("key", "doc_id", F.col("begin").alias("pos"), "low", "high", F.col("end").alias(reach), F.col("part").alias(held))

    both = bounds(by_right, "right", "left_held").unionByName(bounds(by_left, "left", "right_held"), allowMissingColumns=True)
    each = both.groupBy("key", "doc_id", "pos", "low", "high").agg(
        F.max("right").alias("right"), F.max("left").alias("left"), F.min("left_held").alias("left_held"), F.min("right_held").alias("right_held")
    )
    least = F.greatest(F.col("low"), F.col("right_held") + 1, F.lit(passage) - F.col("left")).alias("from")
    most = F.least(F.col("high"), F.lit(passage - 1) - F.col("left_held"), F.col("right")).alias("to")
    full = each.filter("right IS NOT NULL AND left IS NOT NULL").select("key", least, most).filter("from <= to")
    return full.groupBy("key").agg(F.min("from").alias("from"), F.max("to").alias("to"))


def hot_keys(counted: DataFrame, hot: int) -> DataFrame:
    """(key, parts): the keys of more than ``hot`` places, at most one in ``hot`` places, and the number of parts each is dealt to."""
    return counted.filter(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("parts"))


def dealt(rows: DataFrame, often: DataFrame, by: Column) -> DataFrame:
    """``rows`` with ``part``: 0, or for a hot key the part that ``by`` (a hash of the row) falls to."""
    found = rows.join(F.broadcast(often), "key", "left")
    return found.withColumn("part", F.coalesce(F.pmod(by, F.col("parts")).cast("int"), F.lit(0))).drop("parts")


def in_all_parts(keys: DataFrame, often: DataFrame) -> DataFrame:
    """``keys`` (one row per key) once for every part of the key."""
    found = keys.join(F.broadcast(often), "key", "left")
    return found.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def windows(suffixes: DataFrame, ranges: DataFrame, often: DataFrame, passage: int) -> DataFrame:
    """(window, doc_id, begin): hash of each window of ``passage`` words that belongs to its place and lies in the key's range.

    Suffixes with the same words on both sides are matched as neighbours already; one of them stands for all, before the ranges are looked up.
    """
    kind = suffixes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                n = batch.num_rows
                pos, low, high = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 4, 5))
                words = np.zeros((n, 2 * passage), np.uint64)
                sizes = np.zeros((n, 2), np.int64)
                for i, (right, left) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    sizes[i] = len(right) // 4, len(left) // 4
                    words[i, passage : passage + sizes[i, 0]] = np.frombuffer(right, ">u4")
                    words[i, passage - sizes[i, 1] : passage] = np.frombuffer(left, ">u4")[::-1]
                r = np.arange(passage + 1)
                hashes = np.zeros((n, passage + 1), np.uint64) + r.astype(np.uint64)
                for j in range(passage):
                    hashes = hashes * _MULT + words[:, j : j + passage + 1] + np.uint64(1)
                fits = (r >= low[:, None]) & (r <= high[:, None]) & (r <= sizes[:, :1]) & (passage - r <= sizes[:, 1:])
                i, at = np.nonzero(fits)
                begin = (pos[i] + at - passage).astype(np.int32)
                arrays = [pa.array(mix64(hashes[i, at]).view(np.int64)), batch.column(0).take(pa.array(i)), pa.array(begin)]
                yield pa.RecordBatch.from_arrays(arrays, ["window", "doc_id", "begin"])

    one = suffixes.groupBy("key", "words").agg(F.min(F.struct("doc_id", "pos", "number", "low", "high")).alias("s")).select("key", "words", "s.*")
    met = dealt(one, often, F.col("words")).join(in_all_parts(ranges, often), ["key", "part"])
    asked = met.select("number", F.greatest("low", "from").alias("low"), F.least("high", "to").alias("high")).filter("low <= high")
    full = suffixes.select("number", "doc_id", "pos", "right", "left").join(asked, "number").drop("number")
    return full.mapInArrow(run, f"window bigint, doc_id {kind}, begin int")


def _window_spans(found: DataFrame, passage: int) -> DataFrame:
    """Spans of the windows that occur more than once: rows in the order of the hash, each compared with the next."""
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "begin", "partner", "window", "part", "edge"]
    schema = f"doc_id {kind}, begin int, partner {kind}, window bigint, part int, edge int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def edge(row: pa.RecordBatch, first: int) -> pa.RecordBatch:
            none = pa.nulls(1, row.column(1).type)
            return pa.RecordBatch.from_arrays([row.column(1), row.column(2), none, row.column(0), pa.array([part], pa.int32()), pa.array([first], pa.int32())], names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is None:
                yield edge(batch.slice(0, 1), 0)
                rows = batch
            else:
                rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            window = rows.column(0).to_numpy()
            same = np.flatnonzero(window[1:] == window[:-1])
            one, other = np.concatenate([same, same + 1]), np.concatenate([same + 1, same])
            numbers = [pa.array(np.full(len(one), x, np.int32)) for x in (part, -1)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(1).take(pa.array(one)), rows.column(2).take(pa.array(one)), rows.column(1).take(pa.array(other)), rows.column(0).take(pa.array(one)), *numbers], names
            )
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield edge(held, 1)

    compared = stored(found.orderBy("window", "doc_id", "begin").mapInArrow(run, schema), "windows-compared")
    # The two ends of every partition, in the partitions' order: one row each per partition.
    edges = compared.filter("edge >= 0")
    order = W.orderBy("part", "edge")
    beside = [f(c).over(order).alias(f"{c}_{s}") for c in ("doc_id", "window", "part") for s, f in (("before", F.lag), ("after", F.lead))]
    sides = edges.select("doc_id", "begin", "window", "part", *beside)
    met = [
        sides.filter(f"window = window_{s} AND part <> part_{s}").select("doc_id", "begin", F.col(f"doc_id_{s}").alias("partner"))
        for s in ("before", "after")
    ]
    pairs = compared.filter("edge = -1").select("doc_id", "begin", "partner").unionAll(met[0]).unionAll(met[1])
    return pairs.select("doc_id", "begin", (F.col("begin") + passage).alias("end"), "partner")


def _united(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one, with the least partner."""
    in_order = W.partitionBy("doc_id").orderBy("begin", "end")
    reached = F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("opens", F.coalesce(F.col("begin") > reached, F.lit(False)).cast("int"))
    numbered = marked.withColumn("stretch", F.sum("opens").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "stretch").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("partner").alias("partner"))
    return merged.select("doc_id", "begin", "end", "partner")


def find_repeats(docs: DataFrame, passage: int = PASSAGE, key: int = KEY, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, begin, end, partner): every stretch of ``passage`` or more words that occurs elsewhere too, as a range of word places.

    ``partner`` is the least document id that one of its parts was matched with.
    """
    if key + window - 1 > passage:
        raise ValueError("a passage must hold a whole window of places")
    places = stored(suffix_places(docs, passage, key, window), "suffix-places")
    shared = stored(places.groupBy("key").count().filter("count > 1"), "shared-keys")
    often = hot_keys(shared, hot)
    kept = dealt(places, often, F.xxhash64("doc_id", "pos")).join(in_all_parts(shared, often), ["key", "part"], "left_semi").select("doc_id", "pos")
    found = with_context(docs, kept, key, passage, window)
    suffixes = stored(found.withColumns({"words": F.xxhash64("right", "left"), "number": F.monotonically_increasing_id()}), "suffixes")
    spans, orders = None, []
    for side, other in (("right", "left"), ("left", "right")):
        found = stored(neighbours(suffixes, side, other, passage, key), f"by-{side}")
        part = found.filter("edge = -1").select("doc_id", "begin", "end", "partner").distinct().unionAll(_edge_spans(found, passage))
        spans = part if spans is None else spans.unionAll(part)
        orders.append(found)
    more = stored(windows(suffixes, _open_ranges(*orders, passage), often, passage), "windows")
    return _united(spans.unionAll(_window_spans(more, passage)).distinct())
