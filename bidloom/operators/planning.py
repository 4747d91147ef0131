"""Budget planning as table operators: decision grids, floors, allocation on a budget grid, audits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.operators.joins import guard_all_matched


def _dates(start: str, end: str) -> Column:
    return F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def decision_grid(candidates: DataFrame, start: str, end: str, budgets: Sequence[float]) -> DataFrame:
    """Every candidate on every planning day at every grid budget.

    Days and budgets are short settings listed inside the row, so nothing is cross joined.
    """
    return candidates.withColumn("date", _dates(start, end)).withColumn(
        "daily_budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    )


def candidate_rows(
    candidates: DataFrame, features: DataFrame, calendar: DataFrame, feature_columns: Sequence[str], start: str, end: str
) -> DataFrame:
    """Feature row per (date, segment, set) at budget 0.

    ``calendar`` holds one row per (date, region) of the planning window.
    """
    own = [c for c in feature_columns if c in features.columns]
    rows = (
        candidates.select("segment", "keyword_set_id").distinct()
        .withColumn("date", _dates(start, end))
        .withColumn("region", T.region_of_segment())
        .withColumn("match_types", T.match_part_of_segment())
        .withColumn("is_broad_match", T.is_broad_only("match_types"))
        .join(calendar, ["date", "region"], "left")
        .join(features.select("keyword_set_id", *own), "keyword_set_id", "left")
        .withColumn("daily_budget", F.lit(0.0))
    )
    absent = {c: F.lit(None).cast("double") for c in feature_columns if c not in rows.columns}
    return rows.withColumns(absent) if absent else rows


def rows_at_plan_budgets(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Candidate rows of a plan's (segment, set) at its budgets; an unknown pair stops the job."""
    template = rows.drop("daily_budget").withColumn("_known", F.lit(True))
    keys = [c for c in ("date", "segment", "keyword_set_id") if c in rows.columns and c in plan.columns]
    planned = plan.select(*dict.fromkeys([*keys, *[c for c in ("date",) if c in plan.columns]]), "daily_budget")
    joined = planned.join(template, keys, "left")
    known = guard_all_matched(joined, F.coalesce("_known", F.lit(False)), "plan keyword set is not a candidate")
    return known.drop("_known")


def apply_budget_floor(
    rows: DataFrame, minimums: DataFrame, level: str, out: str, atol: float = 0.01, budget: str = "daily_budget"
) -> DataFrame:
    """Level 0 where the cent-rounded budget plus tolerance is under the segment's minimum, or that of its day if ``minimums`` has days.

    Negative levels above the floor are kept.
    """
    low = F.coalesce(F.col("min_budget"), F.lit(0.0))
    below = T.half_even(budget, 2) + F.lit(max(atol, 0.0)) < low
    on = ["date", "segment"] if "date" in minimums.columns else ["segment"]
    return rows.join(minimums.select(*on, "min_budget"), on, "left").withColumn(
        out, F.when(below, F.lit(0.0)).otherwise(F.col(level))
    ).drop("min_budget")


def prune_negative_sets(curve: DataFrame) -> DataFrame:
    """Drop (segment, set) pairs predicted negative at budget 0; losing all sets stops the job."""
    at_zero = curve.filter("daily_budget = 0").groupBy("segment", "keyword_set_id").agg(F.min("level").alias("_l0"))
    kept = at_zero.filter("_l0 >= 0").select("segment", "keyword_set_id")
    left = at_zero.groupBy("segment").agg(F.count_if(F.col("_l0") >= 0).alias("_kept"))
    left = guard_all_matched(left, F.col("_kept") > 0, "a segment lost every keyword set").select("segment")
    return curve.join(kept.join(left, "segment", "left_semi"), ["segment", "keyword_set_id"], "left_semi")


# --- allocation on the grid ----------------------------------------------------------------


def _segment_arrays(curve: DataFrame, keys: Sequence[str], step: float, units: int, penalty: float) -> DataFrame:
    """Penalised value by budget unit, one array per (keys, segment); slots without a level are NULL, budgets off the grid stop the job.

    The number of slots is the number of grid budgets, so the arrays have a fixed size.
    """
    unit = F.round(F.col("budget") / F.lit(step)).cast("int")
    curve = guard_all_matched(curve, F.abs(F.col("budget") - unit * F.lit(step)) <= 1e-6 * step, "budget off the planning grid")
    worth = F.round(F.col("level") - F.lit(penalty) * F.col("budget"), 9)
    by_unit = F.map_from_entries(F.collect_list(F.struct(unit, worth)))
    return (
        curve.filter(unit.between(0, units))
        .groupBy(*keys, "segment", "keyword_set_id")
        .agg(by_unit.alias("m"))
        .select(
            *keys, "segment", "keyword_set_id",
            F.transform(F.sequence(F.lit(0), F.lit(units)), lambda i: F.try_element_at(F.col("m"), i)).alias("worth"),
        )
    )


def _fold(worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each total spend over the rows of ``worth`` (segments, slots), and the units picked by each segment.

    Adding a segment is a max-plus product: for a total of s units, the best split into b units for this segment and s - b for the
    earlier ones; the smaller b wins a tie. Slots without a value are NaN and totals that cannot be reached minus infinity.
    """
    worth = np.where(np.isnan(worth), -np.inf, worth)
    slots = worth.shape[1]
    total, split = np.arange(slots)[:, None], np.arange(slots)[None, :]
    value = np.where(np.arange(slots) == 0, 0.0, -np.inf)
    picks = np.zeros((slots, 0), np.int64)
    for own in worth:
        rest = total - split
        options = np.where(rest >= 0, np.round(value[np.maximum(rest, 0)] + own[None, :], 9), -np.inf)
        best = options.argmax(axis=1)
        value = options[np.arange(slots), best]
        picks = np.column_stack([picks[np.arange(slots) - best], best])
    return value, picks


def _best(worth: np.ndarray) -> tuple[float, list[int]] | None:
    """Greatest value over all totals and its picks; the lower total wins a tie."""
    value, picks = _fold(worth)
    at = int(value.argmax())
    return (float(value[at]), picks[at].tolist()) if np.isfinite(value[at]) else None


def _best_in_order(regions: list[np.ndarray]) -> tuple[float, list[int]] | None:
    """As ``_best`` over three regions whose totals must not rise from one to the next.

    With the best value of the third region up to each total at hand, all pairs of the first two totals are compared: quadratic in slots.
    Ties go to the lower total, then to the lower spend of the first and the second region.
    """
    (first, p1), (second, p2), (third, p3) = (_fold(w) for w in regions)
    slots = len(first)
    upto = np.maximum.accumulate(third)
    least = np.maximum.accumulate(np.where(np.append(True, upto[1:] > upto[:-1]), np.arange(slots), 0))
    u, a = np.arange(slots)[:, None], np.arange(slots)[None, :]
    room = np.minimum(a, slots - 1 - u - a)
    fits = (u >= a) & (room >= 0)
    room = np.maximum(room, 0)
    value = np.where(fits, np.round(first[:, None] + second[None, :] + upto[room], 9), -np.inf)
    top = value.max()
    if not np.isfinite(top):
        return None
    us, as_ = np.nonzero(value == top)
    bs = least[room[us, as_]]
    i = np.lexsort((bs, as_, us, us + as_ + bs))[0]
    return float(top), [*p1[us[i]].tolist(), *p2[as_[i]].tolist(), *p3[bs[i]].tolist()]


def _allocated(
    arrays: DataFrame, keys: Sequence[str], units: int, step: float, penalty: float, order: Sequence[str] = (), caps: DataFrame | None = None
) -> DataFrame:
    """Plan rows of every key: its few segments in text order are one row, folded on their own, so keys spread over the cluster."""
    entry = F.struct("segment", "keyword_set_id", "worth")
    listed = arrays.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("segments"))
    if caps is not None:
        shared = [k for k in keys if k in caps.columns]
        listed = listed.join(caps.select(*shared, "cap"), shared)
    most = F.lit(units) if caps is None else F.least(F.lit(units), F.floor(F.col("cap") / F.lit(step) + 1e-9)).cast("int")
    parts = [F.col(f"segments.{c}").alias(c) for c in ("segment", "keyword_set_id", "worth")]
    flat = listed.select(*keys, *parts, most.alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "segment", "keyword_set_id", "daily_budget", "milp_pred", "total_budget", "objective"]
        for batch in batches:
            rows, of, columns = batch.column(len(keys) + 2), [], [[], [], [], [], [], []]
            segments, sets, tops = (batch.column(len(keys) + j).to_pylist() for j in (0, 1, 3))
            for i in range(batch.num_rows):
                worth = np.array([[np.nan if v is None else v for v in w] for w in rows[i].as_py()], float).reshape(-1, units + 1)[:, : tops[i] + 1]
                place = list(range(len(worth)))
                if order:
                    region = np.array([s.split(" / ")[0].strip() for s in segments[i]])
                    place = [j for r in order for j in place if region[j] == r]
                    found = _best_in_order([worth[region == r] for r in order])
                else:
                    found = _best(worth)
                if found is None:
                    continue
                value, picks = found
                for j, u in zip(place, picks):
                    of.append(i)
                    level = round(worth[j, u] + penalty * (u * step), 9)
                    for column, x in zip(columns, (segments[i][j], sets[i][j], u * step, level, sum(picks) * step, value)):
                        column.append(x)
            kinds = [pa.string(), pa.string(), *[pa.float64()] * 4]
            at = pa.array(of, pa.int64())
            arrays = [*[batch.column(k).take(at) for k in range(len(keys))], *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = ", ".join(f"`{k}` {arrays.schema[k].dataType.simpleString()}" for k in keys)
    return flat.mapInArrow(run, f"{kinds}, segment string, keyword_set_id string, daily_budget double, milp_pred double, total_budget double, objective double")


def allocate_budgets(
    curve: DataFrame, cap: float, step: float, penalty: float = 0.0001, keys: Sequence[str] = ("date",), caps: DataFrame | None = None
) -> DataFrame:
    """Budgets per segment that maximise total level minus the spend penalty under a daily cap.

    ``curve`` has one set per (keys, segment) with (budget, level) on the grid. Every key is one row
    holding its few segments with cap/step slots each; keys are independent, so days and accounts
    spread over the cluster with one shuffle. Exact on the grid; ties take the lower spend. ``caps``
    (some of the keys, cap) lowers the cap of each key.
    """
    units = int(cap / step + 1e-9)
    keys = list(keys)
    return _allocated(_segment_arrays(curve, keys, step, units, penalty), keys, units, step, penalty, caps=caps)


def allocate_ordered(
    curve: DataFrame,
    cap: float,
    step: float,
    order: Sequence[str] = ("USA", "A", "B"),
    penalty: float = 0.0001,
    keys: Sequence[str] = ("date",),
    caps: DataFrame | None = None,
) -> DataFrame:
    """As :func:`allocate_budgets` with region spend in the given order (first spends most).

    Each region is folded to its best value per spend, then the three spends u >= a >= b with
    u + a + b within the cap are compared. A region without segments spends nothing.
    """
    if len(order) != 3:
        raise ValueError("the regional order names three regions")
    units = int(cap / step + 1e-9)
    keys = list(keys)
    known = guard_all_matched(curve, T.region_of_segment().isin(*order), "segment outside the regional order")
    return _allocated(_segment_arrays(known, keys, step, units, penalty), keys, units, step, penalty, order, caps)


def price_sweep(
    curve: DataFrame, cap: float, prices: Sequence[float], penalty: float = 0.0001
) -> tuple[DataFrame, DataFrame]:
    """One set per segment for a window of days, with an upper bound on any such plan.

    At a price on spend the days and segments separate, so the best set of a segment is the one with
    the largest priced value summed over the days. The smallest priced total plus price times cap
    times days bounds every plan. Returns (sets at the bounding price, bound rows per price).
    """
    priced = curve.withColumn("price", F.explode(F.array(*[F.lit(float(p)) for p in prices])))
    worth = F.col("level") - (F.lit(penalty) + F.col("price")) * F.col("budget")
    best_day = priced.groupBy("date", "segment", "keyword_set_id", "price").agg(F.max(worth).alias("v"))
    per_set = best_day.groupBy("segment", "keyword_set_id", "price").agg(F.round(F.sum("v"), 6).alias("v"))
    chosen = per_set.groupBy("segment", "price").agg(
        F.max("v").alias("v"), F.min_by("keyword_set_id", F.struct(-F.col("v"), F.col("keyword_set_id"))).alias("keyword_set_id")
    )
    days = curve.select("date").distinct().agg(F.count(F.lit(1))).scalar()
    bounds = chosen.groupBy("price").agg(F.sum("v").alias("v")).select(
        "price", F.round(F.col("v") + F.col("price") * F.lit(float(cap)) * days, 6).alias("upper_bound")
    )
    at = bounds.agg(F.min_by("price", F.struct("upper_bound", "price"))).scalar()
    return chosen.filter(F.col("price") == at).select("segment", "keyword_set_id", "price"), bounds


def select_sets(
    curve: DataFrame, cap: float, step: float, prices: Sequence[float], penalty: float = 0.0001
) -> DataFrame:
    """Window plan: sets from the price sweep, daily budgets from the allocation, gap to the bound."""
    sets, bounds = price_sweep(curve, cap, prices, penalty)
    fixed = curve.join(sets.select("segment", "keyword_set_id"), ["segment", "keyword_set_id"], "left_semi")
    plan = allocate_budgets(fixed, cap, step, penalty)
    total = plan.groupBy("date").agg(F.max("objective").alias("o")).agg(F.round(F.sum("o"), 6)).scalar()
    bound = bounds.agg(F.min("upper_bound")).scalar()
    return plan.withColumns({"plan_value": total, "upper_bound": bound, "gap": F.round(bound - total, 6)})


def audit_plan(
    plan: DataFrame,
    bounds: DataFrame,
    minimums: DataFrame,
    cap: float,
    order: Sequence[str] = (),
    atol: float = 0.01,
) -> DataFrame:
    """Violations of a plan keyed by date and segment: cap, bounds, one set, order, floor."""
    p = plan.withColumn("region", T.region_of_segment())
    tol = F.lit(1e-6)

    def issue(df: DataFrame, rule: str, subject: Column, amount: Column) -> DataFrame:
        return df.select("date", F.lit(rule).alias("rule"), subject.alias("subject"), F.round(amount, 6).alias("amount"))

    daily = p.groupBy("date").agg(F.sum("daily_budget").alias("spent"))
    out = issue(daily.filter(F.col("spent") > F.lit(cap) + tol), "cap", F.lit("all"), F.col("spent"))
    limits = p.join(bounds, "segment", "left")
    outside = (F.col("daily_budget") < F.col("budget_lo") - tol) | (F.col("daily_budget") > F.col("budget_hi") + tol)
    out = out.unionByName(issue(limits.filter(outside), "bounds", F.col("segment"), F.col("daily_budget")))
    sets = p.groupBy("date", "segment").agg(F.count_distinct("keyword_set_id").alias("n"))
    out = out.unionByName(issue(sets.filter("n <> 1"), "one_set", F.col("segment"), F.col("n").cast("double")))
    floor = p.join(minimums, "segment", "left").filter(
        (T.half_even("daily_budget", 2) + F.lit(atol) < F.coalesce("min_budget", F.lit(0.0))) & (F.col("milp_pred") != 0)
    )
    out = out.unionByName(issue(floor, "floor", F.col("segment"), F.col("milp_pred")))
    if len(order) > 1:
        spend = p.groupBy("date").agg(
            *[F.sum(F.when(F.col("region") == r, F.col("daily_budget"))).alias(f"_{i}") for i, r in enumerate(order)]
        )
        for i in range(len(order) - 1):
            worse = spend.filter(F.col(f"_{i}") < F.col(f"_{i + 1}") - tol)
            out = out.unionByName(
                issue(worse, "order", F.lit(f"{order[i]} >= {order[i + 1]}"), F.col(f"_{i + 1}") - F.col(f"_{i}"))
            )
    return out


def plan_prediction_check(plan: DataFrame, predicted: DataFrame, minimums: DataFrame, tol: float, atol: float = 0.01) -> DataFrame:
    """Plan rows with the gated external prediction, its difference, and whether it is in tolerance.

    ``predicted`` holds (date, segment, raw_level) for the plan rows.
    """
    gated = apply_budget_floor(plan.join(predicted, ["date", "segment"], "left"), minimums, "raw_level", "external_model_pred", atol)
    diff = F.abs(F.col("milp_pred") - F.col("external_model_pred"))
    return gated.drop("raw_level").withColumn("abs_diff", diff).withColumn("within_tol", diff <= F.lit(tol))


def fixed_sets(mappings: DataFrame) -> DataFrame:
    """Latest saved set of each segment from (saved_at, segment, keyword_set_id) rows."""
    named = mappings.filter(F.col("keyword_set_id").isNotNull())
    return named.groupBy("segment").agg(F.max_by("keyword_set_id", F.struct("saved_at", "keyword_set_id")).alias("keyword_set_id"))
