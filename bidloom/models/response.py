"""Response curves: the level of a row as a function of its budget, in pieces that are exact at every cent.

A tree model is a step function of the budget, and its steps are the thresholds of its trees on the budget column. They are read from the
fitted trees and turned into the last whole cent of each step; a linear model has one piece with a slope. Rows are scored at both ends of
each piece only, however fine the budget grid is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.models.fit import Fitted

BUDGET = "daily_budget"


def budget_steps(model: Fitted) -> list[int]:
    """Last whole cents before each change of a model's level; members of an ensemble together. None for linear models."""
    if model.members:
        return sorted({c for m in model.members for c in budget_steps(m)})
    if model.mean is not None or not hasattr(model.model, "trees"):
        return []
    place = list(model.columns()).index(BUDGET)
    mean, scale = model.encoding.moments[BUDGET]
    found = {float(t) for t in re.findall(rf"If \(feature {place} <= ([^)]+)\)", model.model.toDebugString)}
    steps = set()
    for threshold in found:
        cents = math.floor((threshold * scale + mean) * 100)
        # The cent on the threshold's side by the same arithmetic as the model's own column.
        while ((cents + 1) / 100 - mean) / scale <= threshold:
            cents += 1
        while (cents / 100 - mean) / scale > threshold:
            cents -= 1
        steps.add(cents)
    return sorted(steps)


def _raw(model: Fitted, rows: DataFrame, out: str) -> DataFrame:
    """The level before an ensemble's clip at 0, which would bend its pieces."""
    if not model.members:
        return model.predict(rows, out)
    parts = [f"_m{i}" for i in range(len(model.members))]
    for part, member in zip(parts, model.members):
        rows = member.predict(rows, part)
    total = float(sum(model.weights))
    blended = sum((F.lit(w / total) * F.col(p) for w, p in zip(model.weights, parts)), F.lit(0.0))
    return rows.withColumn(out, blended).drop(*parts)


def response_curve(model: Fitted, rows: DataFrame, low: float, high: float) -> DataFrame:
    """``rows`` once per piece of the budgets from ``low`` to ``high``: from_budget, to_budget, from_level, to_level.

    Both ends are whole cents and belong to the piece; between them the level is a straight line. Ensembles are clipped by ``level_at``.
    """
    least, most = math.ceil(low * 100 - 1e-9), math.floor(high * 100 + 1e-9)
    last = [c for c in budget_steps(model) if least <= c < most] + [most]
    pieces = list(zip([least, *[c + 1 for c in last[:-1]]], last))
    piece = F.array(*[F.struct(F.lit(a / 100).alias("from_budget"), F.lit(b / 100).alias("to_budget")) for a, b in pieces])
    listed = rows.drop(BUDGET).withColumn("_piece", F.explode(piece)).select("*", "_piece.from_budget", "_piece.to_budget").drop("_piece")
    for end in ("from", "to"):
        listed = _raw(model, listed.withColumn(BUDGET, F.col(f"{end}_budget")), f"{end}_level").drop(BUDGET)
    return listed


def level_at(budget: Column | str, clip: bool = False) -> Column:
    """The level of a curve's row at a budget inside its piece."""
    b = F.col(budget) if isinstance(budget, str) else budget
    width = F.col("to_budget") - F.col("from_budget")
    line = F.col("from_level") + F.coalesce(F.try_divide(b - F.col("from_budget"), width), F.lit(0.0)) * (F.col("to_level") - F.col("from_level"))
    return F.greatest(line, F.lit(0.0)) if clip else line


def curve_on_grid(curve: DataFrame, keys: Sequence[str], step: float, clip: bool = False) -> DataFrame:
    """(keys, budget, level) at every multiple of ``step`` that the pieces hold; no grid point is scored by the model."""
    first = F.ceil(F.col("from_budget") / step - 1e-9).cast("int")
    last = F.floor(F.col("to_budget") / step + 1e-9).cast("int")
    held = curve.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    points = held.withColumn("budget", F.explode(F.transform(F.sequence("_first", "_last"), lambda i: i * F.lit(float(step)))))
    return points.select(*keys, "budget", level_at("budget", clip).alias("level"))
