"""Languages of a document as a mixture: proportions by expectation-maximisation over n-gram likelihoods, the set by penalised likelihood.

Grams are each letter alone and each letter with its two neighbours, in lower case, where everything that is no letter or mark is a gap.
They are dealt into ``BUCKETS`` by a hash. Each language's gram probabilities come from counts over all training documents.

A document's grams are taken as drawn from a mixture of languages. Its log-likelihood is concave in the proportions, so with D the largest
sum of p(gram | language) / p(gram | mixture) over the languages and n grams, no proportions are better than the present ones by more than
n log(D / n). A document for which no mixture can beat its best single language by the penalty is settled by this bound; the others run
until the bound is small, then languages leave one by one, the least first, and the set of the best penalised likelihood is kept. The
penalty of each language beyond the first is ``PENALTY`` times the log of the number of grams. Whole texts count: long ones are gathered
into their bucket counts, which are all that the mixture needs.

Defined results: a text that is NULL or has no letter is ``und`` with proportion 0, and so is every text when nothing can be learned.
Rows without a language teach nothing. A NULL doc_id counts as an empty one in the split. Repeated rows count and are judged each for
itself. Equal likelihoods go to the language first in code-point order. Other columns are never read.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.words import mix64

UNKNOWN = "und"
BUCKETS, PENALTY, SMOOTHING = 1 << 16, 3.0, 0.5
RUN_CHARS, LONG = 1 << 18, 1 << 9  # characters of one step; letters from which a text is gathered into bucket counts
ROUNDS, SET_ROUNDS, CLOSE = 64, 24, 0.05  # of the mixture of all languages and of each smaller set; bound on what is missing, in penalties
NEGLIGIBLE = 1e-3  # proportion below which languages leave together


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@functools.cache
def _kinds() -> np.ndarray:
    """2 for letters, 1 for marks, 0 for everything else, by code point."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


class Grams(NamedTuple):
    rows: slice  # of the batch
    bucket: np.ndarray
    count: np.ndarray
    first: np.ndarray  # gram range of each row, n + 1
    letters: np.ndarray  # letters of each row


def grams(column: pa.Array) -> Iterator[Grams]:
    """The bucketed grams of whole texts, in runs of about ``RUN_CHARS`` characters."""
    at, n = 0, len(column)
    while at < n:
        texts, size, end = [], 0, at
        while end < n and (size < RUN_CHARS or end == at):
            texts.append((column[end].as_py() or "").lower())
            size += len(texts[-1])
            end += 1
        yield _grams(slice(at, end), texts)
        at = end


def _grams(rows: slice, texts: list[str]) -> Grams:
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts])  # of each text and the line end before it
    kind = _kinds()[points]
    place = np.flatnonzero(kind)
    shown = np.where(kind > 0, points, 0).astype(np.uint64)
    here, before, after = shown[place], shown[place - 1], shown[place + 1]
    whole = mix64(here << np.uint64(42) | before << np.uint64(21) | after)
    both = np.column_stack([whole, mix64(here)]).reshape(-1) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
    first = np.concatenate([[0], np.searchsorted(place, ends)])
    letters = np.add.reduceat(np.append(kind == 2, False), np.concatenate([[0], ends]))[: len(texts)] if texts else np.zeros(0, np.int64)
    bucket, count, size = _gathered(both.astype(np.int64), 2 * first)
    return Grams(rows, bucket, count, np.concatenate([[0], np.cumsum(size)]), letters)


def _gathered(bucket: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, counts and the number of entries of each row; rows of many grams have one entry per bucket."""
    size = np.diff(first)
    buckets, counts, at = [], [], 0
    for i in np.flatnonzero(size > 2 * LONG):
        counted = np.bincount(bucket[first[i] : first[i + 1]], minlength=BUCKETS)
        used = np.flatnonzero(counted)
        buckets += [bucket[at : first[i]], used]
        counts += [np.ones(first[i] - at, np.int64), counted[used]]
        at, size[i] = first[i + 1], len(used)
    buckets.append(bucket[at:])
    counts.append(np.ones(len(bucket) - at, np.int64))
    return np.concatenate(buckets), np.concatenate(counts), size


class Model(NamedTuple):
    languages: list[str]  # in code-point order
    chance: np.ndarray  # (buckets, languages)


def learn(docs: DataFrame) -> Model:
    """Gram probabilities of each language from all rows of ``docs`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for g in grams(batch.column(0)):
                owner = np.repeat(langs[g.rows], np.diff(g.first))
                for lang in dict.fromkeys(langs[g.rows]):
                    mine = owner == lang
                    counted = np.bincount(g.bucket[mine], g.count[mine], BUCKETS).astype(np.int64)
                    held[lang] = held[lang] + counted if lang in held else counted
        for lang, counted in held.items():
            used = np.flatnonzero(counted)
            arrays = [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counted[used])]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "bucket", "n"])

    counted = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string")).mapInArrow(run, "lang string, bucket bigint, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets
    languages = sorted(rows["lang"].unique().to_pylist())
    place = {lang: j for j, lang in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    counts[rows["bucket"].to_numpy(), np.array([place[x] for x in rows["lang"].to_pylist()], np.int64)] = rows["n"].to_numpy()
    return Model(languages, ((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32))


class Mixtures(NamedTuple):
    share: np.ndarray  # (rows, languages)
    loglik: np.ndarray  # of the shares
    missing: np.ndarray  # no other shares of the same languages are better by more than this


def improved(chance: np.ndarray, count: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int, close: np.ndarray) -> Mixtures:
    """Shares after expectation-maximisation; rows stop when what is missing is at most ``close``. Every row has grams."""
    share, loglik, missing = share.copy(), np.zeros(len(share)), np.full(len(share), np.inf)
    rest, size, total = np.arange(len(share)), np.diff(first), np.add.reduceat(count, first[:-1])
    for r in range(rounds + 1):
        starts = np.cumsum(size[rest]) - size[rest]
        mixed = (chance * np.repeat(share[rest], size[rest], axis=0).astype(np.float32)).sum(axis=1)
        loglik[rest] = np.add.reduceat(count * np.log(mixed), starts)
        ratio = np.add.reduceat(chance * (count / mixed)[:, None].astype(np.float32), starts) / total[rest][:, None]
        missing[rest] = total[rest] * np.log(np.maximum(1.0, np.where(share[rest] > 0, ratio, 0).max(axis=1)))
        go_on = missing[rest] > close[rest]
        if r == rounds or not go_on.any():
            break
        share[rest[go_on]] *= ratio[go_on]
        share[rest[go_on]] /= share[rest[go_on]].sum(axis=1, keepdims=True)
        if not go_on.all():
            kept = np.repeat(go_on, size[rest])
            chance, count, rest = chance[kept], count[kept], rest[go_on]
    return Mixtures(share, loglik, missing)


def _picked(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams of ``rows``, and their ranges."""
    size = first[rows + 1] - first[rows]
    to = np.concatenate([[0], np.cumsum(size)])
    return np.arange(to[-1]) + np.repeat(first[rows] - to[:-1], size), to


def mixtures(model: Model, bucket: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, languages): the shares of each row's languages; every row has grams."""
    chance, n = model.chance[bucket], len(model.languages)
    weight = count.astype(np.float64)
    total = np.add.reduceat(weight, first[:-1])
    single = np.column_stack([np.add.reduceat(weight * np.log(chance[:, j]), first[:-1]) for j in range(n)])
    best = single.argmax(axis=1)
    share = np.zeros((len(total), n))
    share[np.arange(len(total)), best] = 1.0
    penalty = PENALTY * np.log1p(total)
    if n == 1:
        return share
    # Near the best single language the mixture is close to its optimum already when the text has one language.
    start = share * 0.9 + 0.1 / n
    alone = single[np.arange(len(total)), best]
    found = improved(chance, weight, first, start, 2, CLOSE * penalty)
    open_ = np.flatnonzero(found.loglik + found.missing - alone > penalty)
    if len(open_) == 0:
        return share
    at, first = _picked(open_, first)
    chance, weight, penalty, alone = chance[at], weight[at], penalty[open_], alone[open_]
    found = improved(chance, weight, first, found.share[open_], ROUNDS, CLOSE * penalty)
    value, chosen = alone.copy(), share[open_]  # the single language is the set to beat
    now, rows = found, np.arange(len(open_))
    while len(rows):
        used = now.share > 0
        worth = now.loglik - penalty[rows] * (used.sum(axis=1) - 1)
        better = worth > value[rows]
        value[rows[better]], chosen[rows[better]] = worth[better], now.share[better]
        # The least language leaves, and with it all negligible ones; sets of one language are known already.
        least = np.where(used, now.share, np.inf).min(axis=1)
        leaves = used & (now.share <= np.maximum(least, NEGLIGIBLE)[:, None])
        fewer = np.where(leaves, 0.0, now.share)
        on = (fewer > 0).sum(axis=1) > 1
        if not on.any():
            break
        at, to = _picked(np.flatnonzero(on), first)
        chance, weight, first, rows = chance[at], weight[at], to, rows[on]
        fewer = fewer[on] / fewer[on].sum(axis=1, keepdims=True)
        now = improved(chance, weight, first, fewer, SET_ROUNDS, CLOSE * penalty[rows])
    share[open_] = chosen
    return share


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, shares): the language of the largest share, that share, and all languages of the set with theirs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for g in grams(batch.column(1)):
                n = len(g.letters)
                share = np.zeros((n, len(names)))
                share[:, -1] = 1.0
                able = np.flatnonzero(g.letters > 0) if known.languages else np.zeros(0, np.int64)
                if len(able):
                    at, first = _picked(able, g.first)
                    share[able, -1] = 0.0
                    share[able, :-1] = mixtures(known, g.bucket[at], g.count[at], first)
                top = share.argmax(axis=1)
                score = np.where(top < len(names) - 1, share[np.arange(n), top], 0.0)
                sets = [[(names[j], float(s[j])) for j in np.flatnonzero(s[:-1])] for s in share]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                listed = pa.array([[{"lang": a, "share": b} for a, b in s] for s in sets], kind)
                arrays = [batch.column(0).slice(g.rows.start, n), pa.array(names[top], pa.string()), pa.array(np.clip(score, 0.0, 1.0)), listed]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "shares"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, shares array<struct<lang:string,share:double>>")


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares): learned from the documents that are not held out, for all documents."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "shares")
