"""Exact set-similarity join: all pairs of keyword sets above a least Jaccard similarity, without comparing all holders of a word.

Words are ordered from rare to frequent. Two sets that reach the bound share a word so early in both orders that enough words follow it;
only these prefixes are joined. Sizes and the places of the shared word rule out most of what meets; the rest is compared in full. Sets
of the same content take part once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.session import cut_lineage

TINY = 1e-9


def set_contents(bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyword_set_id, content) and (content, n, words): sets of the same words share a content, named by its least id."""
    listed = bridge.groupBy("keyword_set_id").agg(F.array_sort(F.collect_set("keyword")).alias("words"))
    marked = cut_lineage(listed.withColumn("_fp", F.sha2(F.array_join("words", "\u0001"), 256)))
    names = marked.groupBy("_fp").agg(F.min("keyword_set_id").alias("content"))
    owned = marked.select("keyword_set_id", "_fp").join(names, "_fp").select("keyword_set_id", "content")
    contents = marked.join(names, marked["keyword_set_id"] == names["content"]).select("content", F.size("words").cast("long").alias("n"), "words")
    return owned, contents


def _least_shared(least: float, n_a: Column, n_b: Column) -> Column:
    return F.ceil(F.lit(least / (1 + least)) * (n_a + n_b) - F.lit(TINY))


def prefixes(contents: DataFrame, least: float) -> DataFrame:
    """(content, n, keyword, pos): the rarest words of each content, one of which it shares with every content above the bound."""
    words = contents.select("content", "n", F.explode("words").alias("keyword"))
    often = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("_often"))
    order = Window.partitionBy("content").orderBy("_often", "keyword")
    placed = words.join(often, "keyword").withColumn("pos", F.row_number().over(order) - 1)
    return placed.filter(F.col("pos") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(TINY))).select("content", "n", "keyword", "pos")


def candidate_pairs(early: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: contents that meet in a prefix word with room for enough shared words."""
    side = lambda s: early.select("keyword", *[F.col(c).alias(f"{c}_{s}") for c in ("content", "n", "pos")])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    room = F.least(n_a - F.col("pos_a"), n_b - F.col("pos_b"))
    sizes = F.least(n_a, n_b) >= F.lit(least) * F.greatest(n_a, n_b) - F.lit(TINY)
    met = side("a").join(side("b"), "keyword").filter(F.col("content_a") < F.col("content_b")).filter(sizes & (room >= _least_shared(least, n_a, n_b)))
    return met.select(F.col("content_a").alias("a"), F.col("content_b").alias("b")).distinct()


def similar_contents(contents: DataFrame, least: float) -> DataFrame:
    """(a, b, n_a, n_b, shared, n_union, jaccard, overlap_a, overlap_b) of all contents a < b with a Jaccard of at least ``least``."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies above 0 and up to 1")
    contents = cut_lineage(contents)
    pairs = candidate_pairs(cut_lineage(prefixes(contents, least)), least)
    side = lambda s: contents.select(F.col("content").alias(s), F.col("n").alias(f"n_{s}"), F.col("words").alias(f"_{s}"))
    shared = F.size(F.array_intersect("_a", "_b")).cast("long")
    sized = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", shared.alias("shared"))
    n_union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return sized.withColumn("n_union", n_union).filter(F.col("shared") >= F.lit(least) * F.col("n_union") - F.lit(TINY)).withColumns(
        {"jaccard": F.col("shared") / F.col("n_union"), "overlap_a": F.col("shared") / F.col("n_a"), "overlap_b": F.col("shared") / F.col("n_b")}
    )


def version_changes(versions: DataFrame, bridge: DataFrame, order: Sequence[str] = ("start_date", "campaign_version")) -> DataFrame:
    """Every version of a campaign beside the one before it: sizes, similarity, and the shared, added and dropped words as lists.

    Versions are few per campaign, and the words of each pair of sets are compared once.
    """
    owned, contents = set_contents(bridge)
    before = Window.partitionBy("campaign").orderBy(*order)
    steps = versions.select(
        "campaign", "campaign_version", "keyword_set_id",
        F.lag("campaign_version").over(before).alias("previous_version"), F.lag("keyword_set_id").over(before).alias("_previous_set"),
    ).filter("previous_version IS NOT NULL")
    named = lambda s: owned.select(F.col("keyword_set_id").alias(s), F.col("content").alias(f"{s}_content"))
    placed = steps.join(named("keyword_set_id"), "keyword_set_id", "left").join(named("_previous_set"), "_previous_set", "left")
    both = placed.select(F.col("keyword_set_id_content").alias("a"), F.col("_previous_set_content").alias("b")).distinct()
    side = lambda s: contents.select(F.col("content").alias(s), F.col("words").alias(f"_{s}"))
    none = F.array().cast("array<string>")
    now, was = F.coalesce("_a", none), F.coalesce("_b", none)
    listed = {"shared": F.array_intersect(now, was), "added": F.array_except(now, was), "dropped": F.array_except(was, now)}
    words = both.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        "a", "b", F.size(now).alias("n_now"), F.size(was).alias("n_before"), *[F.array_sort(v).alias(k) for k, v in listed.items()]
    )
    n_union = F.size("shared") + F.size("added") + F.size("dropped")
    same = F.col("keyword_set_id_content").eqNullSafe(F.col("a")) & F.col("_previous_set_content").eqNullSafe(F.col("b"))
    return placed.join(words, same).select(
        "campaign", "campaign_version", "previous_version", "n_now", "n_before", F.size("shared").alias("n_shared"),
        F.try_divide(F.size("shared"), n_union).alias("jaccard"),
        *[F.array_join(c, T.LIST_JOINER).alias(f"{c}_keywords") for c in listed],
    )
