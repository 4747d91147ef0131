"""Token ids in directly addressable codes.

Documents are laid out in ascending order of their id over range partitions. A segment holds whole documents of about
``SEGMENT_TOKENS`` ids. Ids are split into chunks of eight bits: level 0 has the lowest chunk of every id, and one bit per id that says
whether the id goes on at the next level; level 1 has the next chunk of those, and so on. A rank directory counts the set bits before every
512th place, so that the place at the next level is one directory entry and at most eight words away: any id is read without decoding
others. Segments are rows of Parquet files written by Spark, so that every store Spark reads will do.

Defined results: a NULL text is empty and gives the end id alone. Rows with the same doc_id lie side by side. An empty table gives an
empty file. The order of partitions is the order of their numbers; a retried task writes the same segments.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm.words import runs, span_hashes

END_ID, SEGMENT_TOKENS, SEGMENT_DOCS, RANK_BITS = 2, 1 << 20, 4096, 512
CACHE_SEGMENTS, RUN_TEXT_BYTES, JOINED_PIECES = 1_500_000, 4 << 20, 4096
SCHEMA = (
    "part int, seq int, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of unsigned ids."""
    levels, bitmaps, ranks = [], [], []
    rest = np.asarray(ids, dtype=np.uint64)
    while True:
        more = rest > 255
        levels.append((rest & np.uint64(255)).astype(np.uint8).tobytes())
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.int64)
        ranks.append((np.cumsum(counts) - counts).astype("<u8").tobytes())
        rest = rest[more] >> np.uint64(8)
        if not len(rest):
            return levels, bitmaps, ranks


def dac_decode(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids in order, from the last level upwards."""
    values = np.zeros(0, np.uint64)
    for level, bitmap in zip(reversed(levels), reversed(bitmaps)):
        low = np.frombuffer(level, np.uint8).astype(np.uint64)
        more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(low), bitorder="little").astype(bool)
        low[more] |= values << np.uint64(8)
        values = low
    return values


def dac_get(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place ``i``: one byte, one bit and one rank for each level it reaches."""
    value, shift = 0, 0
    for level, bitmap, rank in zip(levels, bitmaps, ranks):
        value |= level[i] << shift
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        bits = int.from_bytes(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * RANK_BITS)) - 1)
        i = int.from_bytes(rank[block * 8 : block * 8 + 8], "little") + bits.bit_count()
        shift += 8
    return value


_MARKS = np.zeros(256, dtype=bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


class Encoder:
    """Encodes runs of documents through the tokenizers library, each distinct piece of text once.

    Text is cut only between a visible ASCII character, or a character U+00C0 to U+00FF, and the space after it, and between an ASCII
    letter and the ASCII mark after it. The vocabulary's pattern never matches across such places and never looks back, so the pieces
    encode as they do in the whole text. Where a special token occurs, the second cut is left out.

    Pieces that begin with a space and end as the first cut asks can stand in any order, so many of them go through the library as one
    text; the bytes of each id tell where a piece ends. Special tokens have no space, so none arises at a seam.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        # In a byte-level vocabulary every character of a token stands for one byte.
        self.width = np.zeros(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(added[i].content.encode()) if i in added else len(token)
        self._clear()

    def _clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, places in ``flat`` and sizes
        self.flat: list[np.ndarray] = []
        self.n_ids = self.n_known = 0

    def _keep(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Add sorted pieces; levels of like size are merged, so each piece is copied a few times only."""
        self.levels.append((hashes, begin, size))
        self.n_known += len(hashes)
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) > len(self.levels[-2][0]):
            joined = [np.concatenate(c) for c in zip(self.levels[-2], self.levels[-1])]
            order = np.argsort(joined[0], kind="stable")
            self.levels[-2:] = [tuple(c[order] for c in joined)]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``flat`` and sizes; size -1 where a piece is not known."""
        begin, size = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int32)
        for known, at, n in self.levels:
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = known[place] == hashes
            begin[found], size[found] = at[place[found]], n[place[found]]
        return begin, size

    def _encode_texts(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each has."""
        last, lead = data[ends - 1], data[np.maximum(ends - 2, starts)]
        seam = (data[starts] == 32) & (((last > 32) & (last < 127)) | ((last >= 128) & (lead == 0xC3) & (ends - starts > 2)))
        joined, alone = np.flatnonzero(seam), np.flatnonzero(~seam)
        raw, flat, size = data.tobytes(), [], np.zeros(len(starts), np.int64)
        spans = list(zip(starts.tolist(), ends.tolist()))
        for at in range(0, len(joined), JOINED_PIECES):
            block = joined[at : at + JOINED_PIECES]
            [ids] = self._encode_texts([b"".join([raw[a:b] for a, b in (spans[i] for i in block.tolist())]).decode()])
            ids = np.array(ids, np.uint32)
            to, close = np.cumsum(self.width[ids]), np.cumsum(ends[block] - starts[block])
            upto = np.searchsorted(to, close, side="right")
            if len(ids) == 0 or not np.array_equal(to[upto - 1], close):  # the vocabulary is not one of bytes
                alone = np.concatenate([alone, block])
                continue
            size[block] = np.diff(upto, prepend=0)
            flat.append((block, ids))
        for at in range(0, len(alone), JOINED_PIECES):
            block = alone[at : at + JOINED_PIECES]
            got = self._encode_texts([raw[a:b].decode() for a, b in (spans[i] for i in block.tolist())])
            size[block] = np.fromiter(map(len, got), np.int64, len(got))
            flat.append((block, np.fromiter(chain.from_iterable(got), np.uint32, int(size[block].sum()))))
        begin, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint32)
        for block, ids in flat:
            n = size[block]
            out[np.repeat(begin[block] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and the number of ids of each document."""
        n_docs = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        cut = data == 32
        before = np.empty_like(data)
        before[0], before[1:] = 32, data[:-1]
        lead = np.zeros_like(data)
        lead[2:] = data[:-2]
        cut &= ((before > 32) & (before < 127)) | ((before >= 128) & (lead == 0xC3))
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            cut |= ((before | 32) >= 97) & ((before | 32) <= 122) & _MARKS[data]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        where = np.empty(len(distinct), np.int64)
        where[inverse] = np.arange(len(hashes))
        if self.n_known > CACHE_SEGMENTS:
            self._clear()
        begin, size = self._find(distinct)
        new = np.flatnonzero(size < 0)
        if len(new):
            at = where[new]
            got, n = self._encode_pieces(data, starts[at], ends[at])
            begin[new] = self.n_ids + np.cumsum(n) - n
            size[new] = n
            self.flat.append(got)
            self.n_ids += len(got)
            self._keep(distinct[new], begin[new], size[new])
        flat = np.concatenate(self.flat)
        self.flat = [flat]
        size, begin = size[inverse].astype(np.int64), begin[inverse]
        first = np.cumsum(size) - size
        ids = flat[np.repeat(begin - first, size) + np.arange(int(size.sum()))]
        doc = np.searchsorted(offsets, starts, side="right") - 1
        return ids, np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write the segments below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        part, seq = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        doc_tokens: list[int] = []
        held_tokens = 0

        def segment() -> pa.RecordBatch:
            levels, bitmaps, ranks = dac_encode(np.concatenate(held))
            values = [[part], [seq], [sum(doc_tokens)], [doc_ids], [doc_tokens], [levels], [bitmaps], [ranks]]
            blobs = pa.list_(pa.binary())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), blobs, blobs, blobs]
            names = ["part", "seq", "n_tokens", "doc_ids", "doc_tokens", "levels", "bitmaps", "ranks"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for rows, data, offsets in runs(batch.column(1), RUN_TEXT_BYTES):
                ids, counts = encoder.encode(data, offsets)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(np.uint32)
                counts = counts + 1
                names = batch.column(0).slice(rows.start, rows.stop - rows.start).to_pylist()
                at = 0
                for name, n in zip(names, counts.tolist()):
                    held.append(ids[at : at + n])
                    doc_ids.append(name)
                    doc_tokens.append(n)
                    at += n
                    held_tokens += n
                    if held_tokens >= segment_tokens or len(doc_ids) >= SEGMENT_DOCS:
                        yield segment()
                        seq += 1
                        held, doc_ids, doc_tokens, held_tokens = [], [], [], 0
        if held:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = dac_decode(row["levels"], row["bitmaps"]).astype("<u4")
                counts = np.asarray(row["doc_tokens"], np.int64)
                begin = np.cumsum(counts) - counts
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(begin.tolist(), counts.tolist())]
                n_docs = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n_docs, pa.int32()),
                        pa.array([row["seq"]] * n_docs, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(begin, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    docs = segments.mapInArrow(run, "part int, seq int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    # Places before a segment: sums within a partition, then over one total per partition.
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    inner = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    bases = segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("seq_base"))
    based = bases.join(parts, "part").select("part", "seq", (F.col("seq_base") + F.col("part_base")).alias("base"))
    return docs.join(based, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
