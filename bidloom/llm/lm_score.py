"""Language-model scoring by context-tree weighting over bytes, beside a smoothed word baseline.

The tree has all contexts of up to ``DEPTH`` bytes that occur, however rare. Every byte is coded as eight binary decisions along a code
tree, and every decision in every context has a Krichevsky-Trofimov estimate. Estimates of all depths are mixed by context-tree weighting:
a node weighs its own estimate against the product of its children's by their probability of the training data. Contexts are dealt out by
their last three bytes and weighed in tasks; the code length of each gram (context and next byte) goes to a written table. Grams that make
up more than one in ``HOT_SHARE`` training bytes are sent to all workers, the others are joined by document. With ``contexts``, only contexts
of at least that share of the training bytes are kept and the others share one child of their longest kept context.

Word counts of the baseline are exact for all training documents. Words that make up more than one in ``HOT_SHARE`` words of a sample are
counted on the side and sent to all workers (at most ``HOT_SHARE`` of them by that definition); all others are counted and joined by hash.

Defined results: a NULL text is empty: it has the end token and the closing byte only. Repeated rows are scored each for itself, and each
trains. Without training documents all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import stored
from bidloom.llm.words import runs, span_hashes, split_words

DEPTH, HOT_SHARE, SAMPLE_DOCS = 4, 1 << 20, 16_384  # a gram of up to six context bytes fits a long
BLOCK_GRAMS = 1 << 20  # grams of one step, whatever the length of a text
_LOG10_HALF = float(np.log10(0.5))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


# ---- words -------------------------------------------------------------------------------------------------------------------------


def _hot_words(rows: DataFrame, sample_docs: int, share: int) -> np.ndarray:
    """Hashes of frequent words from a bounded sample; which words these are changes the way of counting, never a count."""
    total = rows.count()
    part = min(1.0, sample_docs / max(1, total))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + (part == 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in split_words(batch.column(0)):
                words, n = np.unique(span_hashes(w.data, w.starts, w.ends), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    counts = picked.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "sample-words")
    seen = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * share > seen).filter("n > 1").select("word").toPandas()["word"].to_numpy(np.int64)
    return np.sort(hot.view(np.uint64))


def _word_rows(rows: DataFrame, hot) -> DataFrame:
    """(doc, word, n): rare words of each document; and (-1, place of a hot word, n): hot words of training documents, summed per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            docs, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for w in split_words(batch.column(2)):
                hashes = span_hashes(w.data, w.starts, w.ends)
                counts = np.diff(w.first)
                doc = np.repeat(docs[w.rows], counts)
                trains = np.repeat(train[w.rows], counts)
                place, is_hot = _places(known, hashes)
                summed = np.bincount(place[is_hot & trains], minlength=len(known))
                used = np.flatnonzero(summed)
                rare_doc, rare = doc[~is_hot], hashes[~is_hot].view(np.int64)
                n = len(used) + len(rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(used), -1), rare_doc])),
                        pa.array(np.concatenate([used, rare])),
                        pa.array(np.concatenate([summed[used], np.ones(len(rare), np.int64)])),
                        pa.array(np.concatenate([np.ones(len(used), bool), trains[~is_hot]]), pa.bool_()),
                    ],
                    ["doc", "word", "n", "train"],
                ) if n else pa.RecordBatch.from_pylist([], schema=pa.schema([("doc", pa.int64()), ("word", pa.int64()), ("n", pa.int64()), ("train", pa.bool_())]))

    return rows.select("row", "train", "text").mapInArrow(run, "doc bigint, word bigint, n bigint, train boolean")


def _places(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(known, hashes)
    inside = place < len(known)
    found = np.zeros(len(hashes), bool)
    found[inside] = known[place[inside]] == hashes[inside]
    return place, found


# ---- byte contexts -----------------------------------------------------------------------------------------------------------------
# A gram is ``depth`` context bytes, the nearest first with nine bits each, and the next byte. ``REST`` stands for all bytes of a context
# that is not kept. A binary decision of a byte has the number 2^k - 1 + (its first k bits), k from 0 to 7.

REST = 256
_TOP = 3  # contexts of so many bytes and more are weighed in tasks, each with everything below it


def _grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The gram of every byte and of the closing zero byte of each text, and its row, in blocks; zero bytes stand before each text."""
    n = len(offsets) - 1
    begin = offsets[:-1] + np.arange(n)  # of each text among all bytes and closing bytes
    padded = np.zeros(len(data) + (depth + 1) * n + depth, np.uint8)
    for i in range(n):
        at = offsets[i] + (depth + 1) * i + depth
        padded[at : at + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
    for low in range(0, len(data) + n, BLOCK_GRAMS):
        at = np.arange(low, min(low + BLOCK_GRAMS, len(data) + n))
        owner = np.searchsorted(begin, at, side="right") - 1
        at += depth * (owner + 1)
        grams = np.zeros(len(at), np.int64)
        for j in range(1, depth + 1):
            grams <<= 9
            grams |= padded[at - j]
        grams <<= 8
        grams |= padded[at]
        yield grams, owner


def gram_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n) of all texts; n counts training texts only and may be 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False)
            for part, data, offsets in runs(batch.column(1)):
                for grams, owner in _grams(data, offsets, depth):
                    mine = train[part][owner]
                    for used, weight in ((mine, 1), (~mine, 0)):
                        found, n = np.unique(grams[used], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64) * weight)], ["gram", "n"])

    return rows.select("train", "text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(x + shift) by Stirling's series eight places further on."""
    z = x + shift + 8.0
    series = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    for j in range(8):
        series = series - np.log(x + shift + j)
    return series


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the Krichevsky-Trofimov probability of the decisions so far, and the chance of a one."""
    own = _lgamma(zeros, 0.5) + _lgamma(ones, 0.5) - _lgamma(zeros + ones, 1.0) - np.log(np.pi)
    return np.where(zeros + ones > 0, own, 0.0), (ones + 0.5) / (zeros + ones + 1)


def _mix(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability of a node, and the share of its own estimate in it."""
    mixed = np.logaddexp(own, below) + np.log(0.5)
    return mixed, np.exp(own + np.log(0.5) - mixed)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, each row's place among them, and the sums of the values."""
    found, place = np.unique(keys, return_inverse=True)
    return found, place, *(np.bincount(place, v, len(found)) for v in values)


def _weighed(keys: np.ndarray, n: np.ndarray, depth: int):
    """For each k: (context of ``_TOP`` bytes << 8 | decision, zeros, ones, log weighted) of the top nodes; then for each row the chance of
    a one below the top, its top node and its bit. All grams of a context of ``_TOP`` bytes are there."""
    levels = []
    for d in range(depth, _TOP - 1, -1):
        levels.append(_summed(keys >> 8 + 9 * (depth - d) << 8 | keys & 255, n))
    for k in range(8):
        below, child, chance, at = None, None, None, None
        for found, place, total in levels:
            node = found >> 8 << 8 | (1 << k) - 1 + ((found & 255) >> (8 - k))
            bit = (found >> (7 - k) & 1).astype(bool)
            first = np.ones(len(node), bool)
            first[1:] = node[1:] != node[:-1]
            own_place = np.cumsum(first) - 1
            nodes = node[first]
            zeros, ones = (np.bincount(own_place, total * b, len(nodes)) for b in (~bit, bit))
            own, one = _estimate(zeros, ones)
            if below is None:
                mixed, chance, at = own, one, np.arange(len(nodes))
                row_node, row_bit = own_place[place], bit[place]
            else:
                up = np.searchsorted(nodes, child >> 17 << 8 | child & 255)
                mixed, share = _mix(own, np.bincount(up, below, len(nodes)))
                at = up[at]
                chance = share[at] * one[at] + (1 - share[at]) * chance
            below, child = mixed, nodes
        yield nodes, zeros, ones, mixed, chance[row_node], at[row_node], row_bit


def _by_context(batches: Iterator[pa.RecordBatch], depth: int, rows: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows in parts of about ``rows`` that end with a context of ``_TOP`` bytes; the first column is the key."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        if sum(len(h[0]) for h in held) < rows:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        top = columns[0] >> 8 + 9 * (depth - _TOP)
        cut = int(np.searchsorted(top, top[-1]))
        held = [[c[cut:] for c in columns]]
        if cut:
            yield [c[:cut] for c in columns]
    if held and sum(len(h[0]) for h in held):
        yield [np.concatenate(c) for c in zip(*held)]


def _with_keys(grams: DataFrame, contexts: int | None, depth: int) -> DataFrame:
    """(key, gram, n): the gram with the bytes beyond the longest kept context as ``REST``; without a bound every context is kept."""
    if contexts is None:
        return grams.select(F.col("gram").alias("key"), "gram", "n")
    total, kept = grams.agg(F.sum("n")).first()[0] or 0, []
    for d in range(1, depth + 1):
        big = grams.groupBy(F.shiftright("gram", 8 + 9 * (depth - d)).alias("c")).agg(F.sum("n").alias("n"))
        kept.append(np.array(sorted(r[0] for r in big.filter(F.col("n") * contexts >= total).select("c").collect()), np.int64))
    shared = grams.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy()
            key = np.zeros(len(gram), np.int64)
            for d, known in enumerate(shared.value, 1):
                context = gram >> 8 + 9 * (depth - d)
                key = key << 9 | np.where(np.isin(context, known), context & 511, REST)
            yield pa.RecordBatch.from_arrays([pa.array(key << 8 | gram & 255), batch.column(0), batch.column(1)], ["key", "gram", "n"])

    return grams.select("gram", "n").mapInArrow(run, "key bigint, gram bigint, n bigint")


def _top_chances(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the decisions in each context of two bytes: what the contexts of up to two bytes add to the chance of a one, and the share that
    is left to longer ones. There are at most 65,536 such contexts, whatever the corpus."""
    rows = nodes.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("mixed")).orderBy("node").toPandas()
    node, zeros, ones, below = (rows[c].to_numpy() for c in rows.columns)
    bottom, levels = node, []
    for _ in range(_TOP):
        own, one = _estimate(zeros, ones)
        mixed, share = _mix(own, below)
        up, place, zeros, ones, below = _summed(node >> 17 << 8 | node & 255, zeros, ones, mixed)
        levels.append((share, one, place))
        node = up
    added, left = np.zeros(len(node)), np.ones(len(node))
    for share, one, place in reversed(levels):
        added, left = added[place] + left[place] * share * one, left[place] * (1 - share)
    return bottom, added, left


def code_lengths(grams: DataFrame, contexts: int | None = None, depth: int = DEPTH) -> DataFrame:
    """(gram, n, log): log10 probability of the next byte of each gram in its context, by weighting all contexts of up to ``depth`` bytes."""
    if not _TOP <= depth <= 6:
        raise ValueError("a gram holds contexts of three to six bytes")
    keyed = _with_keys(grams, contexts, depth)
    dealt = keyed.repartition(F.shiftright("key", 8 + 9 * (depth - _TOP))).sortWithinPartitions("key")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, n in _by_context(batches, depth):
            for nodes, zeros, ones, mixed, *_ in _weighed(key, n, depth):
                arrays = [nodes >> 17 << 8 | nodes & 255, zeros, ones, mixed]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["node", "zeros", "ones", "mixed"])

    top = grams.sparkSession.sparkContext.broadcast(_top_chances(dealt.mapInArrow(weigh, "node bigint, zeros double, ones double, mixed double")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bottom, added, left = top.value
        for key, gram, n in _by_context(batches, depth):
            logs = np.zeros(len(key))
            for nodes, _, _, _, chance, at, bit in _weighed(key, n, depth):
                place = np.searchsorted(bottom, nodes >> 17 << 8 | nodes & 255)[at]
                one = added[place] + left[place] * chance
                logs += np.log10(np.where(bit, one, 1 - one))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n), pa.array(logs)], ["gram", "n", "log"])

    return dealt.mapInArrow(measure, "gram bigint, n bigint, log double")


def _gram_rows(rows: DataFrame, hot, depth: int) -> DataFrame:
    """(doc, gram, logs): sums over hot grams of each document under gram -1, and its other grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, log = hot.value
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for part, data, offsets in runs(batch.column(1)):
                for grams, owner in _grams(data, offsets, depth):
                    place, is_hot = _places(known, grams)
                    first, n_docs = owner[0], owner[-1] - owner[0] + 1
                    sums = np.bincount(owner[is_hot] - first, log[place[is_hot]], n_docs)
                    rare, mine = grams[~is_hot], docs[part][first : first + n_docs]
                    arrays = [
                        np.concatenate([mine, docs[part][owner[~is_hot]]]),
                        np.concatenate([np.full(n_docs, -1), rare]),
                        np.concatenate([sums, np.zeros(len(rare))]),
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["doc", "gram", "logs"])

    return rows.select("row", "text").mapInArrow(run, "doc bigint, gram bigint, logs double")


def _scores(rows: DataFrame, contexts: int | None, depth: int, share: int) -> DataFrame:
    """(doc, score), summed over equal rows. Grams above the share are sent to all workers, all others are joined: a choice of way only."""
    lengths = stored(code_lengths(stored(gram_counts(rows, depth), "grams"), contexts, depth), "code-lengths")
    total = lengths.agg(F.sum("n")).first()[0] or 0
    frequent = lengths.filter(F.col("n") * share > total).select("gram", "log").orderBy("gram").toPandas()
    hot = rows.sparkSession.sparkContext.broadcast((frequent["gram"].to_numpy(np.int64), frequent["log"].to_numpy(np.float64)))
    listed = stored(_gram_rows(rows, hot, depth), "gram-sums")
    rare = listed.filter("gram <> -1").join(lengths.select("gram", "log"), "gram").select("doc", F.col("log").alias("logs"))
    return listed.filter("gram = -1").select("doc", "logs").unionAll(rare).groupBy("doc").agg(F.sum("logs").alias("score"))


# ---- operator ----------------------------------------------------------------------------------------------------------------------


def score_documents(
    docs: DataFrame, contexts: int | None = None, share: int = HOT_SHARE, sample_docs: int = SAMPLE_DOCS, depth: int = DEPTH
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (~held_out(F.col("doc_id"))).alias("train"), F.xxhash64("doc_id", "text").alias("row"), "text")
    hot = spark.sparkContext.broadcast(_hot_words(rows, sample_docs, share))
    scores = _scores(rows, contexts, depth, share)

    listed = stored(_word_rows(rows, hot), "words")
    sums = listed.filter("doc = -1").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most `share` rows
    hot_counts = np.zeros(len(hot.value), np.int64)
    for word, n in sums:
        hot_counts[word] = n
    rare = listed.filter("doc <> -1")
    counted = rare.filter("train").groupBy("word").agg(F.sum("n").alias("c"))
    n_rare, v_rare = (x or 0 for x in counted.agg(F.sum("c"), F.count("c")).first())
    ends = rows.filter("train").count()
    total = int(hot_counts.sum()) + n_rare + ends
    distinct = int((hot_counts > 0).sum()) + v_rare + (ends > 0)
    per_doc = (
        rare.join(counted, "word", "left")
        .groupBy("doc")
        .agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) * F.col("n")).alias("logs"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        )
    )
    logs = spark.sparkContext.broadcast((np.log10(hot_counts + 0.1), hot_counts > 0))
    end_log, end_known = float(np.log10(ends + 0.1)), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        weight, is_known = logs.value
        for batch in batches:
            for w in split_words(batch.column(3), 1 << 20):
                hashes = span_hashes(w.data, w.starts, w.ends)
                n_docs = len(w.offsets) - 1
                owner = np.repeat(np.arange(n_docs), np.diff(w.first))
                place, is_hot = _places(known, hashes)
                mine, at = owner[is_hot], place[is_hot]
                part = batch.slice(w.rows.start, n_docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(np.diff(w.first) + 1),
                        pa.array(np.bincount(mine, weights=is_known[at], minlength=n_docs).astype(np.int64) + end_known),
                        pa.array(np.bincount(mine, weights=weight[at], minlength=n_docs) + end_log),
                        pa.array(np.diff(w.offsets) + 1),
                    ],
                    ["doc_id", "train", "row", "n_tokens", "hot_known", "hot_logs", "n_bytes"],
                )

    schema = f"doc_id {kind}, train boolean, row bigint, n_tokens long, hot_known long, hot_logs double, n_bytes long"
    scored = rows.select("doc_id", "train", "row", "text").mapInArrow(run, schema)
    base = float(np.log10(total + 0.1 * (distinct + 1))) if total else 0.0
    # Equal rows list their rare words under one number; each gets its own share of the sums.
    copies = rows.groupBy("row").agg(F.count("*").alias("copies"))
    joined = scored.join(per_doc, scored["row"] == per_doc["doc"], "left").join(copies, "row")
    joined = joined.join(scores.withColumnRenamed("doc", "row"), "row").withColumn("score", F.col("score") / F.col("copies"))
    rare_logs, rare_known = (F.coalesce(F.col(c), F.lit(0)) / F.col("copies") for c in ("logs", "known"))
    result = joined.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("hot_known") + rare_known.cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_logs") + rare_logs - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        "score",
        (F.col("score") / F.lit(_LOG10_HALF) / F.col("n_bytes")).alias("bits_per_byte"),
    )
    if total:
        return result
    return result.withColumns({c: F.lit(0.0) for c in ("base_score", "score", "bits_per_byte")})
