"""Interval, as-of and override joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.grouped import carry


def interval_join(
    facts: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    date: str = "date",
    start: str = "start_date",
    end: str = "end_date",
) -> DataFrame:
    """Facts paired with every version whose half-open interval holds the fact date.

    A NULL end is open. Each version is listed once per month it covers, up to the last fact month,
    and the join is an equi join on (keys, month) with the day test as a residual. A hot key is
    therefore spread over its months, and neither side is compared outside the month.
    """
    last_month = facts.agg(F.max(F.trunc(date, "MM"))).scalar()
    final = F.least(F.trunc(F.coalesce(F.date_sub(F.col(end), 1), last_month), "MM"), last_month)
    first = F.trunc(start, "MM")
    months = F.sequence(first, final, F.expr("interval 1 month"))
    listed = (
        versions.filter(F.col(end).isNull() | (F.col(start) < F.col(end)))
        .filter(first <= final)
        .withColumn("_month", F.explode(months))
    )
    inside = (F.col(date) >= F.col(start)) & (F.col(end).isNull() | (F.col(date) < F.col(end)))
    return (
        facts.withColumn("_month", F.trunc(date, "MM"))
        .join(listed, [*keys, "_month"])
        .filter(inside)
        .drop("_month")
    )


def asof_backward(
    probes: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    date: str,
    order: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """Attach the latest history row on or before each probe date (NULLs when there is none).

    Both sides are stacked and the history row is carried forward day by day. On the same day the
    history sorts first, and among equal dates the largest ``order`` wins.
    """
    row = F.struct(*[F.col(c) for c in columns])
    left = probes.select(
        *keys, date, F.lit(1).alias("_side"), *[F.lit(None).cast(history.schema[c].dataType).alias(f"_o_{c}") for c in order],
        F.lit(None).cast(history.select(row.alias("r")).schema["r"].dataType).alias("_hist"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("_probe"),
    )
    right = history.select(
        *keys, date, F.lit(0).alias("_side"), *[F.col(c).alias(f"_o_{c}") for c in order],
        row.alias("_hist"),
        F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"),
    )
    stacked = carry(
        left.unionByName(right), keys, date, ["_side", *[f"_o_{c}" for c in order]], {"_asof": "_hist"}
    )
    return stacked.filter(F.col("_side") == 1).select(
        *[F.col(f"_probe.{c}").alias(c) for c in probes.columns],
        *[F.col(f"_asof.{c}").alias(c) for c in columns],
    )


def override_merge(base: DataFrame, extended: DataFrame, key: str) -> DataFrame:
    """Extended rows win by key; base rows without an extended row are kept."""
    kept = base.join(extended.select(key).distinct(), key, "left_anti")
    return extended.unionByName(kept, allowMissingColumns=True)


def guard_all_matched(rows: DataFrame, flag: Column, message: str) -> DataFrame:
    """Fail the job when ``flag`` is false on any row."""
    checked = F.when(flag, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return rows.filter(checked)


CELL_BITS, WHOLE_PARTS = 14, 64


def stab_join(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, low: str, high: str, cell_bits: int = CELL_BITS, parts: int = WHOLE_PARTS
) -> DataFrame:
    """Points with every span [low, high) of their keys that holds ``at``; an open ``high`` is NULL.

    The points' range is cut into cells, and a binary tree over them indexes the spans: a span lies in the few tree nodes that make it up,
    a point probes the nodes above its cell, and both meet on (keys, node), where the exact test is a residual. No node is larger than
    one of ``parts`` equal parts of the range, so even spans that hold everything spread a key over as many places. Each pair meets
    in one node only. Whole numbers serve as points; keys that are NULL meet nothing. Columns of both sides but the keys must differ.
    """
    least, most = points.agg(F.min(at), F.max(at)).first()
    if least is None:
        least, most = 0, 0
    shift = max(0, int(most - least).bit_length() - cell_bits)
    last = (most - least) >> shift
    top = max(0, int(last).bit_length() - max(0, parts.bit_length() - 1))

    def cell(c: Column) -> Column:
        return F.shiftright((c - F.lit(least)).cast("long"), shift)

    def node(level: Column | int, place: Column) -> Column:
        return F.struct(F.lit(level).cast("int").alias("level"), place.cast("long").alias("place"))

    first = F.greatest(F.lit(0), cell(F.col(low)))
    after = F.least(F.lit(last), F.coalesce(cell(F.col(high) - 1), F.lit(last))) + 1
    nodes = []
    for j in range(top + 1):
        left, right = F.shiftright(first + ((1 << j) - 1), j), F.shiftright(after, j)
        some = left < right
        if j < top:
            nodes += [F.when(some & (left % 2 == 1), F.array(node(j, left))), F.when(some & (right % 2 == 1), F.array(node(j, right - 1)))]
        else:
            nodes.append(F.when(some, F.transform(F.sequence(left, F.greatest(left, right - 1)), lambda p: node(top, p))))
    none = F.array().cast("array<struct<level:int,place:bigint>>")
    touched = spans.filter((F.col(high).isNull() | (F.col(high) > F.lit(least))) & (F.col(low) <= F.lit(most)) & (F.col(high).isNull() | (F.col(low) < F.col(high))))
    placed = touched.withColumn("_node", F.explode(F.concat(*[F.coalesce(n, none) for n in nodes])))
    above = F.array(*[node(j, F.shiftright(cell(F.col(at)), j)) for j in range(top + 1)])
    probes = points.filter(F.col(at).isNotNull()).withColumn("_node", F.explode(above))
    met = probes.join(placed, [*keys, "_node"])
    return met.filter((F.col(at) >= F.col(low)) & (F.col(high).isNull() | (F.col(at) < F.col(high)))).drop("_node")
