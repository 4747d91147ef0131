"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule votes for good or bad where its feature is clear and abstains otherwise. Votes of one document form a pattern; patterns are
counted over all documents, and the accuracies of the rules and the share of good documents are estimated on these counts (at most
three to the power of the number of rules). A document is kept when the fixed tests pass and its posterior is at least ``threshold``.

Defined results: a NULL or empty text has no words, fails the fixed test and is not kept. Repeated rows count and are judged each for
itself. An empty table gives an empty result. Columns of the input are never read except ``text``, and are handed on whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.llm.common import stored, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_ended_lines", "n_upper")


def _repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more: sort windows by hash, take the places of equal neighbours, add up what they cover."""
    n = F.size(hashes)
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    return windows


def _covered(windows: Column) -> Column:
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a == b, F.lit(False))
        twin = F.transform(s, lambda x, k: F.when(same(F.get(s, k - 1)["h"], x["h"]) | same(F.get(s, k + 1)["h"], x["h"]), x["i"]))
        return F.sort_array(F.filter(twin, lambda i: i.isNotNull()))

    def total(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
            lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum")),
            lambda acc: acc["sum"],
        )

    # A one-element transform names the sorted array, so that it is built once.
    return F.transform(F.array(ordered), lambda s: F.transform(F.array(places(s)), lambda p: total(p))[0])[0]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, COUNTS): the row as a struct and the counts of its text."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.struct("*").alias("doc"), body.alias("body"), words(F.col(text)).alias("words"))
    lines = F.filter(F.split("body", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    hashed = split.select("doc", "body", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), lines.alias("lines"))
    windowed = hashed.select(
        "doc",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("hashes")).alias("n_distinct_words"),
        F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"[.!?\x22)][\x20\x09-\x0D]*$")))).alias("n_ended_lines"),
        F.regexp_count("body", F.lit("[A-Z]")).alias("n_upper"),
        _repeated_words(F.col("hashes")).alias("windows"),
    )
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(0)
    counted = windowed.withColumn("n_repeat_words", repeated)
    return counted.select("doc", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> list[Column]:
    """1 for good, -1 for bad, 0 for no vote."""
    n, lines = F.col("n_words"), F.col("n_lines")

    def vote(good: Column, bad: Column) -> Column:
        return F.coalesce(F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)), F.lit(0))

    per_word, per_line = F.try_divide, lambda c: F.try_divide(F.col(c), lines)
    symbols, length = per_word(F.col("n_symbols"), n), per_word(F.col("word_chars"), n)
    repeats, distinct = per_word(F.col("n_repeat_words"), n), per_word(F.col("n_distinct_words"), n)
    upper = F.try_divide(F.col("n_upper"), F.col("word_chars"))
    return [
        vote(symbols <= 0.02, symbols > 0.1),
        vote((length >= 3.5) & (length <= 7), (length < 2.5) | (length > 12)),
        vote((per_line("n_dup_lines") <= 0.1) & (lines >= 3), (per_line("n_dup_lines") > 0.4) & (lines >= 3)),
        vote(repeats <= 0.05, repeats > 0.2),
        vote(distinct >= 0.4, distinct < 0.15),
        vote(per_line("n_ended_lines") >= 0.8, (per_line("n_ended_lines") < 0.1) & (lines >= 2)),
        vote(upper <= 0.1, upper > 0.4),
        vote(n >= 50, n < 10),
    ]


N_RULES = 8


def estimate(patterns: dict[int, int], rules: int = N_RULES, rounds: int = 60) -> tuple[list[float], float]:
    """Accuracies and the share of good documents by expectation-maximisation over counted vote patterns."""
    accuracy, prior = [0.8] * rules, 0.7
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        right, cast, good = [0.0] * rules, [0.0] * rules, 0.0
        for code, count in patterns.items():
            p = posterior(code, accuracy, prior)
            good += count * p
            for j, v in enumerate(decoded(code, rules)):
                if v:
                    cast[j] += count
                    right[j] += count * (p if v > 0 else 1 - p)
        prior = min(0.99, max(0.01, good / total))
        accuracy = [min(0.99, max(0.5, (right[j] + 8) / (cast[j] + 10))) for j in range(rules)]
    return accuracy, prior


def decoded(code: int, rules: int = N_RULES) -> list[int]:
    return [code // 3**j % 3 - 1 for j in range(rules)]


def posterior(code: int, accuracy: list[float], prior: float) -> float:
    odds = math.log(prior / (1 - prior))
    for a, v in zip(accuracy, decoded(code, len(accuracy))):
        odds += v * math.log(a / (1 - a))
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """(doc, COUNTS, base_failed, quality, kept): every row with its counts, posterior and verdict."""
    code = sum((v + 1) * 3**j for j, v in enumerate(votes()))
    counted = stored(with_counts(docs, text).withColumn("code", code.cast("int")).withColumn("base_failed", base_failed()), "quality-counts")
    patterns = {r["code"]: r["count"] for r in counted.groupBy("code").count().collect()}
    accuracy, prior = estimate(patterns)
    chances = F.from_json(F.lit(json.dumps([posterior(c, accuracy, prior) for c in range(3**N_RULES)])), "array<double>")
    judged = counted.withColumn("quality", F.element_at(chances, F.col("code") + 1)).drop("code")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    return judge(docs, threshold).filter("kept").select("doc.*")
