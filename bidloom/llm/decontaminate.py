"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with each run of white space as one space. An item of m characters may differ by
k = floor(rate x m) edits; it is split into k + 1 pieces, of which at least one must occur unchanged in a match. All pieces are looked
up in one pass over a text (Aho-Corasick), and every place a piece points to is verified with Myers' bit-parallel distance.

Items are taken in blocks of at most ``BLOCK_CHARS`` characters, so what a worker holds is bounded whatever the number of items.
Defined results: NULL or empty texts match nothing, NULL or empty items are never matched. Repeated rows match each for itself. Places are
character places of the normalised text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, BLOCK_CHARS = 0.05, 1_000_000
MATCH = "item_id long, distance int, start long, end long"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(place, piece): the item in k + 1 parts of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the closest place in ``text``, the earliest end among equals; one bit per character of the item."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus = minus | ~(diagonal | plus) & full
        h_minus = plus & diagonal
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = h_plus << 1 & full  # a match may begin anywhere
        h_minus = h_minus << 1 & full
        plus = h_minus | ~(diagonal | h_plus) & full
        minus = h_plus & diagonal
        if score < best[0]:
            best = score, j
    return best


class Matcher:
    """Pieces of one block of items, and the search for them."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(name, text, int(rate * len(text))) for name, text in ((n, normalise(t)) for n, t in items) if text]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.items):
            for place, piece in pieces(text, k):
                at.setdefault(piece, []).append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in at.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end): the closest place of each item within its budget."""
        if not self.items or not text:
            return []
        places: dict[int, set[int]] = {}
        for last, (size, owners) in self.automaton.iter(text):
            for i, place in owners:
                places.setdefault(i, set()).add(last - size + 1 - place)
        found = []
        for i, begins in places.items():
            name, item, k = self.items[i]
            best = None
            for low, high in self._windows(sorted(begins), len(item), k, len(text)):
                window = text[low:high]
                exact = window.find(item)
                distance, end = (0, exact + len(item)) if exact >= 0 else myers(item, window)
                if distance <= k and (best is None or distance < best[0]):
                    size = len(item) if distance == 0 else myers(item[::-1], window[:end][::-1])[1]
                    best = distance, low + end - size, low + end
            if best is not None:
                found.append((name, *best))
        return found

    @staticmethod
    def _windows(begins: list[int], m: int, k: int, n: int) -> list[tuple[int, int]]:
        """Merged stretches of text in which a match can lie."""
        out: list[list[int]] = []
        for b in begins:
            low, high = max(0, b - k), min(n, b + m + k)
            if out and low <= out[-1][1]:
                out[-1][1] = max(out[-1][1], high)
            else:
                out.append([low, high])
        return [(a, b) for a, b in out]


_MATCHERS: dict[str, Matcher] = {}


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for every item found in a document, at its closest place."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // block_chars + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in mine])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if name not in _MATCHERS:  # a worker builds the automaton of a block once
                _MATCHERS.clear()
                _MATCHERS[name] = Matcher(shared.value, rate)
            matcher = _MATCHERS[name]
            for batch in batches:
                names, rows = [], []
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        for match in matcher.search(normalise(text or "")):
                            names.append(doc_id)
                            rows.append(match)
                columns = list(zip(*rows)) if rows else [[]] * 4
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                arrays = [pa.array(names, batch.schema.field(0).type), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "distance", "start", "end"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {MATCH}")
        found = part if found is None else found.unionAll(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose id has no match; rows without an id stay."""
    leaked = find_leaks(docs, benchmark, rate).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs["doc_id"] == F.col("leaked_id"), "left_anti")
