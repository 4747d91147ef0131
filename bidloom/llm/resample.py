"""Target-distribution importance resampling: documents drawn in proportion to how much more a target's n-grams they hold.

Features are runs of 1 to ``most_words`` consecutive words. Each falls into a bucket by its CRC-32; a bucket's gain is the scaled log ratio
of its smoothed share in the target and in all documents. A document's weight is the sum of its features' gains, and the documents of
the greatest weights plus Gumbel noise from a hash of the id are a draw without replacement in proportion to the ratio.

In tasks, the n-grams of about ``RUN_BYTES`` of text and at most ``BLOCK_WORDS`` first words at a time are interned in an open-addressed table (``interning``): slots hold bucket
and count, and the slots of the occurrences gather the gains. Bucket counts are added up per task before they are summed; there are
at most ``buckets`` of them. Ranks come from a range-partitioned written table and the row counts of its parts.

Defined results: a NULL, empty or blank text, or one without words, has no features and weight 0. Repeated rows count, and are scored and
ranked each for itself; they share their noise. A NULL doc_id has the noise of an empty id and comes last among ties. An empty target leaves
gains from the documents alone; without documents the result is empty. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import stored
from bidloom.llm.interning import intern_spans
from bidloom.llm.words import Words, split_words

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
RUN_BYTES, BLOCK_WORDS = 1 << 20, 1 << 17

# A word is a run of ASCII digits and letters and of all characters beyond ASCII.
_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def n_grams(w: Words, most_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each length that begin in each block of words: bytes of the words joined by one space, and start, end and row of each run."""
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    for at in range(0, len(owner), BLOCK_WORDS):
        block = slice(at, at + BLOCK_WORDS + most_words - 1)
        opens, row = w.starts[block], owner[block]
        lengths = w.ends[block] - opens
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[np.repeat(begin, lengths) + within] = w.data[np.repeat(opens, lengths) + within]
        for k in range(1, most_words + 1):
            n = max(0, min(len(begin) - k + 1, BLOCK_WORDS))
            whole = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
            yield joined, begin[whole], begin[whole + k - 1] + lengths[whole + k - 1], row[whole]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most_words: int = 1) -> np.ndarray:
    """Occurrences of all features of the only column of ``texts`` by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for w in split_words(batch.column(0), RUN_BYTES, _GAP):
                for data, starts, ends, _ in n_grams(w, most_words):
                    table = intern_spans(data, starts, ends, buckets)
                    np.add.at(held, table.bucket, table.count)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for bucket, n in rows:  # at most `buckets`
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratios = (((t + 1) * (all_source + buckets)) / ((s + 1) * (all_target + buckets)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most_words: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    source = bucket_counts(docs.select("text"), buckets, most_words)
    gain = docs.sparkSession.sparkContext.broadcast(gains(source, bucket_counts(target.select("text"), buckets, most_words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in split_words(batch.column(1), RUN_BYTES, _GAP):
                n = len(w.first) - 1
                features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for data, starts, ends, row in n_grams(w, most_words):
                    table = intern_spans(data, starts, ends, buckets)
                    gathered = gain.value[table.bucket][table.slot]
                    features += np.bincount(row, minlength=n)
                    np.add.at(weight, row, gathered)
                ids = batch.column(0).slice(w.rows.start, n)
                arrays = [ids, pa.array(np.diff(w.first)), pa.array(features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    most_words: int = 1,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document; ``rank`` counts the drawn ones from 1 and is NULL for the others."""
    weighed = stored(weigh(docs, target, buckets, most_words, seed), "weights").withColumn("able", F.col("n_words") >= least_words)
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    sorted_parts = weighed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_parts.withColumn("place", F.monotonically_increasing_id()), "weights-in-order")
    # The number of a part lies above bit 33 and the place within it below; parts before a row's own hold only rows before it.
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("able")).orderBy("part").collect()
    drawn = percent * sum(r["able"] for r in sizes) // 100
    offsets, before = [], 0
    for r in sizes:  # one row per part of the sort
        offsets.append((r["part"], before))
        before += r["n"]
    first = docs.sparkSession.createDataFrame(offsets, "part long, before long")
    ranked = placed.withColumn("part", part).join(F.broadcast(first), "part", "left").withColumn("rank", F.col("before") + within + 1)
    taken = F.when(F.col("able") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", taken.alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn documents with their own columns; an id that is drawn once goes in with all its rows."""
    taken = resample(docs, target, **settings).filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    named = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"))
    return named.join(taken, F.col("id").eqNullSafe(F.col("drawn_id")), "left_semi").select("doc.*")
