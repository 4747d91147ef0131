"""Ranks, percentiles, as-of values and leads that do not gather a whole group in one task.

A plain window over a group sorts the group in a single task. A hot group may hold a third of all
rows, so these helpers split a group into buckets that depend only on the row (a value range, a
day), solve each bucket, and join a per-bucket carry that was computed from bucket summaries. The
number of buckets per group is bounded by the value grid or by the calendar, never by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per natural-log unit, and the value taken as the unit of the log scale.
BUCKETS_PER_LOG = 64
LOG_UNIT = 1e-6


def value_bucket(c: Column) -> Column:
    """Monotone bucket number of a double: equal or larger values never get a smaller bucket."""
    size = F.floor(F.log1p(F.abs(c) / LOG_UNIT) * BUCKETS_PER_LOG)
    return F.when(c < 0, -size).otherwise(size).cast("int")


def exact_sum(c: Column) -> Column:
    """Sum of report amounts (at most six decimals) in whole millionths, the same in any task order."""
    return F.sum(F.rint(c * 1000000).cast("bigint")) / F.lit(1000000.0)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which NULL meets NULL; the keys stay once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def with_rank(df: DataFrame, keys: Sequence[str], score: str, name: str, descending: bool = True) -> DataFrame:
    """Add the minimum-method rank (1 = best) of ``score`` within ``keys``.

    Equal scores are first counted together, so ties cost one row. The rank of a score is one plus
    the rows in better buckets plus the rows with better scores in its own bucket. NULL keys form a
    group; a NULL score has no rank.
    """
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    tally = (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, score)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", value_bucket(F.col(score)))
    )
    before = Window.partitionBy(*keys).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order(score)).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        tally.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    placed = tally.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ranks = join_null_safe(placed, offsets, [*keys, "_bucket"])
    ranks = ranks.select(*keys, score, (F.col("_before") + F.col("_inside") + 1).cast("int").alias(name))
    return join_null_safe(df, ranks, [*keys, score], "left")


def percentile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Exact linearly interpolated percentile of ``value`` per group; NULLs are skipped.

    Bucket counts locate the one or two buckets that hold the two order statistics; only those
    values are then counted and ordered.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_bucket", value_bucket(F.col(value)))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    spot = F.lit(q) * (F.col("_total") - 1)
    wanted = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(upto))
        .withColumn("_total", F.sum("_rows").over(whole))
        .withColumn("_lo", F.floor(spot))
        .withColumn("_hi", F.ceil(spot))
        .withColumn("_share", spot - F.col("_lo"))
        .withColumn("_start", F.col("_upto") - F.col("_rows"))
        .filter((F.col("_start") <= F.col("_hi")) & (F.col("_upto") > F.col("_lo")))
        .select(*keys, "_bucket", "_start", "_lo", "_hi", "_share")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    place = F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    counted = (
        join_null_safe(rows, wanted, [*keys, "_bucket"])
        .groupBy(*keys, "_bucket", "_start", "_lo", "_hi", "_share", value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_place", place)
    )

    def at(position: str) -> Column:
        hit = (F.col("_place") <= F.col(position)) & (F.col(position) < F.col("_place") + F.col("_n"))
        return F.max(F.when(hit, F.col(value)))

    return (
        counted.groupBy(*keys)
        .agg(at("_lo").alias("_v_lo"), at("_hi").alias("_v_hi"), F.max("_share").alias("_share"))
        .select(*keys, (F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * F.col("_share")).alias(name))
    )


def carry(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    order: Sequence[str],
    values: dict[str, str],
    backward: bool = False,
) -> DataFrame:
    """As-of value: for each ``new -> source`` the nearest non-NULL ``source`` at or before the row.

    Rows are ordered by (day, order). With ``backward`` the nearest at or after the row is taken.
    NULL keys form a group; rows without a day stand before all days.
    """
    direction = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    here = (
        Window.partitionBy(*keys, day)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    place = F.struct(*[F.col(c) for c in order])
    edge = F.min_by if backward else F.max_by
    daily = df.groupBy(*keys, day).agg(
        *[edge(F.col(src), F.when(F.col(src).isNotNull(), place)).alias(f"_edge_{new}") for new, src in values.items()]
    )
    past = Window.partitionBy(*keys).orderBy(direction(day)).rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select(
        *keys, day, *[F.last(f"_edge_{new}", ignorenulls=True).over(past).alias(f"_past_{new}") for new in values]
    )
    local = df.withColumns(
        {f"_here_{new}": F.last(F.col(src), ignorenulls=True).over(here) for new, src in values.items()}
    )
    out = join_null_safe(local, daily, [*keys, day])
    out = out.withColumns({new: F.coalesce(f"_here_{new}", f"_past_{new}") for new in values})
    return out.drop(*[f"_here_{new}" for new in values], *[f"_past_{new}" for new in values])


def following(
    df: DataFrame, keys: Sequence[str], day: str, order: Sequence[str], source: str, name: str
) -> DataFrame:
    """``source`` of the next row of the group in (day, order); NULL for the last row.

    NULL keys form a group; rows without a day stand before all days.
    """
    here = Window.partitionBy(*keys, day).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(day)
    first = (
        df.groupBy(*keys, day)
        .agg(F.min_by(source, F.struct(*order)).alias("_first"))
        .withColumn("_next_day", F.lead("_first").over(across))
        .drop("_first")
    )
    local = df.withColumn("_next_here", F.lead(source).over(here)).withColumn("_is_last", F.lead(F.lit(1)).over(here).isNull())
    return (
        join_null_safe(local, first, [*keys, day])
        .withColumn(name, F.when(F.col("_is_last"), F.col("_next_day")).otherwise(F.col("_next_here")))
        .drop("_next_here", "_is_last", "_next_day")
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """First ``n`` rows per group, numbered from 1.

    Spark pushes the limit below the shuffle, so a map task sends at most ``n`` rows per group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, by a combining aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def number_rows(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """Row number from 1 within ``keys``, where ``bucket`` is a monotone part of the order.

    Rows are numbered inside their bucket and shifted by the rows of earlier buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        join_null_safe(rows.withColumn("_place", F.row_number().over(inside)), shift, [*keys, "_bucket"])
        .withColumn(name, (F.col("_place") + F.col("_shift")).cast("int"))
        .drop("_bucket", "_place", "_shift")
    )
