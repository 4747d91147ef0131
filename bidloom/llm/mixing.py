"""Mixing of sources to target weights with exact repetition rates.

Sizes are added up per source; every source gets a target from its weight, held at ``most`` times its size, and the excess goes to the
others by weight until no source is above. The rate of a source is target over size; each of its documents is emitted floor(rate) times,
and once more when a number drawn from a hash of its id falls below the fraction.

Defined results: a NULL text has size 0, a NULL source is a source of its own and comes last; a source without words has target 0 and
is not emitted. Rows with the same id share their draw. Reruns give the same rows on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidloom.llm.common import WORD

WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source, so the windows below run over sources only.

    Sources reach their ceiling in the order of ceiling per weight. With the first k at their ceiling the level of the others is
    (all - ceilings) / (weights left); k is the first place at which nobody left is above.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sums.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (share * F.col("all_size") - most * F.col("size_before")) / F.col("weight_left")
    laid = (
        named.withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", level)
        .withColumn("open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    )
    # The level at the first open place holds for it and all later ones; before it sources stand at their ceiling.
    first = F.min(F.when(F.col("open"), F.struct(F.col("size_before"), F.col("weight_left")))).over(whole)
    final = (share * F.col("all_size") - most * first["size_before"]) / first["weight_left"]
    ceiling = (most * F.col("source_size")).cast("double")
    return laid.withColumn("target", F.coalesce(F.least(final * F.col("weight"), ceiling), ceiling)).select("source", "source_size", "target")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52)


def mix_rates(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc, size, source_size, target, copies): every row with the number of times the mix takes it."""
    sized = docs.select(F.struct("*").alias("doc"), F.col("source"), size_of(F.col("text")).alias("size"))
    targets = source_targets(sized.select("source", "size"), share=share, most=most)
    joined = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("doc.doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed rows: each document as often as the mix takes it, with its own columns only."""
    rows = mix_rates(docs, seed).filter("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
