"""Two-stage walk-forward backtest: one keyword set per segment for a window, then budgets day by day, then one comparison.

Stage 1 fits on the rows before the window, draws response curves for every known set on every day of the window and chooses sets under
the caps and the regional order. Stage 2 plans each day with a fit on the rows before it. Ridge and mean levels of all days come from the
sums of one job; other learners are fitted side by side, each writing its day's curve. All days are allocated and scored together.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.config import Config, Validation
from bidloom.functions import calendar as CAL
from bidloom.functions import text as T
from bidloom.models import day_sums as S
from bidloom.models import fit as M
from bidloom.models import response as R
from bidloom.operators import planning as O
from bidloom.operators import scoring as Q
from bidloom.operators.coupled import select_sets_coupled
from bidloom.operators.panel import day_budget_total, exact_sum, observed_min_budget, usable_rows
from bidloom.session import cut_lineage, scratch_dir

Day = datetime.date
LINEAR = ("ridge", "mean_baseline")


@dataclass
class Backtest:
    """What a run leaves: chosen sets, plan rows, plan and market rows side by side, one summary row per day."""

    sets: DataFrame
    plan: DataFrame
    comparison: DataFrame
    days: DataFrame


def window_days(start: Day, end: Day) -> list[Day]:
    return [start + datetime.timedelta(days=i) for i in range((end - start).days + 1)]


def known_sets(frame: DataFrame, start: Day, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(segment, keyword_set_id) seen before a day, and the latest features of each of these sets."""
    before = frame.filter((F.col("date") < F.lit(start)) & F.col("keyword_set_id").isNotNull())
    own = [c for c in columns if c in frame.columns]
    latest = before.groupBy("keyword_set_id").agg(F.max_by(F.struct(*own), F.struct("date", *own)).alias("f")) if own else before.select("keyword_set_id").distinct()
    return before.select("segment", "keyword_set_id").distinct(), latest.select("keyword_set_id", *[f"f.{c}" for c in own])


def budget_history(frame: DataFrame, days: Sequence[Day], segments: DataFrame, default_max: float) -> DataFrame:
    """(date, segment, min_budget, budget_hi): the span of configured budgets before each planning day."""
    spark = frame.sparkSession
    wanted = segments.withColumn("date", F.explode(F.array(*[F.lit(d) for d in days])))
    daily = frame.groupBy("segment", F.col("date").alias("_day")).agg(F.min("daily_budget").alias("_lo"), F.max("daily_budget").alias("_hi"))
    joined = wanted.join(daily, "segment", "left").withColumn("_known", F.col("_day") < F.col("date"))
    lowest, highest = F.min(F.when(F.col("_known"), F.col("_lo"))), F.max(F.when(F.col("_known"), F.col("_hi")))
    return joined.groupBy("date", "segment").agg(F.coalesce(lowest, F.lit(0.0)).alias("min_budget"), F.coalesce(highest, F.lit(default_max)).alias("budget_hi"))


def fold_spans(counts: Sequence[tuple[Day, int]], v: Validation) -> list[tuple[int, Day, Day]]:
    """(fold, last training day, last day) over days with their row counts, as the fold operators place them; 80/20 when none fits."""
    days, n = [d for d, _ in counts], len(counts)
    rows = [c for _, c in counts]
    least = max(0, v.min_train_days, -int(-n * v.min_train_fraction // 1))
    spans = []
    if n >= least + v.min_val_days:
        width = max(v.min_val_days, (n - least) // max(v.cv_folds, 1))
        for slot in range(min(v.cv_folds, max(1, (n - least) // width))):
            end = least + slot * width - 1
            last = min(end + width, n - 1)
            if end + 1 >= least and last - end >= v.min_val_days and sum(rows[: end + 1]) >= v.min_train_rows and sum(rows[end + 1 : last + 1]) >= v.min_val_rows:
                spans.append((len(spans) + 1, days[end], days[last]))
    if not spans and n:
        spans = [(1, days[min(int(n * 0.8), n - 1)], days[-1])]
    return spans


def _ridge_penalties(frame: DataFrame, config: Config, manifest: dict[str, Any], sums: S.DaySums, days: Sequence[Day], counts: Sequence[tuple[Day, int]]) -> list[float]:
    """The penalty of each day's fit: tuned on the rows before it, the folds of all days scored in one job, or as recorded."""
    if not config.model_policy.validation.tune_hyperparams:
        return [M.winner_params(frame, config, manifest, False)["ridge"].get("alpha", M.DEFAULTS["ridge"]["alpha"])] * len(days)
    alphas = [p["alpha"] for p in M.param_maps(M.GRIDS["ridge"])]
    spans = [(i, cut, end) for i, d in enumerate(days) for _, cut, end in fold_spans([c for c in counts if c[0] < d], config.model_policy.validation)]
    levels = [sums.fits([(cut, a) for a in alphas]) for _, cut, _ in spans]
    scored = S.fold_metrics(frame, sums, config.target, spans, levels)
    chosen = []
    for i in range(len(days)):
        own = [fold for (of, *_), fold in zip(spans, scored) if of == i]
        error = [sum(f[j]["rmse"] for f in own if f[j]) / max(1, sum(1 for f in own if f[j])) for j in range(len(alphas))]
        chosen.append(alphas[min(range(len(alphas)), key=lambda j: error[j])])
    return chosen


def _linear_pieces(rows: DataFrame, sums: S.DaySums, levels: dict[Day, S.Level], most: float) -> DataFrame:
    """The curves of linear levels: one piece from 0 to the greatest budget."""
    ends = {"from": 0.0, "to": most}
    out = rows.drop(R.BUDGET).withColumns({f"{e}_budget": F.lit(b) for e, b in ends.items()})
    for end, budget in ends.items():
        out = S.predict_by_day(out.withColumn(R.BUDGET, F.lit(budget)), sums, levels, f"{end}_level").drop(R.BUDGET)
    return out


CURVE = ("date", "segment", "keyword_set_id")


def _limited(curve: DataFrame, history: DataFrame, config: Config) -> DataFrame:
    """Curve points inside the historical bounds, level 0 below the observed minimum."""
    inside = curve.join(history.select("date", "segment", "budget_hi"), ["date", "segment"]).filter("budget <= budget_hi + 1e-9").drop("budget_hi")
    if not config.evaluation.apply_observed_budget_floor:
        return inside
    named = inside.withColumnRenamed("budget", "daily_budget").withColumnRenamed("level", "_raw")
    return O.apply_budget_floor(named, history, "_raw", "level", config.evaluation.budget_floor_atol).select(*CURVE, F.col("daily_budget").alias("budget"), "level")


def window_curve(frame: DataFrame, config: Config, manifest: dict[str, Any], rows: DataFrame, start: Day, step: float, most: float) -> DataFrame:
    """(date, segment, keyword_set_id, budget, level) of the window from one fit on the rows before it, without sets a tree model
    sees below 0 at budget 0."""
    model = M.fit_winner(frame, config, manifest, str(start), config.model_policy.validation.tune_hyperparams)
    curve = R.curve_on_grid(R.response_curve(model, rows, 0.0, most), CURVE, step, bool(model.members))
    if model.name in LINEAR:
        return curve
    curve = cut_lineage(curve).withColumnRenamed("budget", "daily_budget")
    return O.prune_negative_sets(curve).withColumnRenamed("daily_budget", "budget")


def daily_curves(
    frame: DataFrame, config: Config, manifest: dict[str, Any], rows: DataFrame, days: Sequence[Day], counts: Sequence[tuple[Day, int]], step: float, most: float
) -> DataFrame:
    """(date, segment, keyword_set_id, budget, level) of every day from a fit on the rows before it."""
    name = config.model_policy.optimizer_winner
    if name in LINEAR:
        sums = S.day_sums(frame, config)
        eves = [d - datetime.timedelta(days=1) for d in days]
        if name == "ridge":
            penalties = _ridge_penalties(frame, config, manifest, sums, days, counts)
            levels = sums.fits(list(zip(eves, penalties)))
        else:
            levels = sums.means(eves)
        return R.curve_on_grid(_linear_pieces(rows, sums, dict(zip(days, levels)), most), CURVE, step)
    folder = scratch_dir(frame.sparkSession, "day-curves")

    def planned(day: Day) -> None:
        model = M.fit_winner(frame, config, manifest, str(day), config.model_policy.validation.tune_hyperparams)
        pieces = R.response_curve(model, rows.filter(F.col("date") == F.lit(day)), 0.0, most)
        R.curve_on_grid(pieces, CURVE, step, bool(model.members)).write.mode("overwrite").parquet(f"{folder}/{day:%Y%m%d}")

    M.in_parallel(planned, days)
    return frame.sparkSession.read.parquet(*[f"{folder}/{d:%Y%m%d}" for d in days])


def two_stage_backtest(
    frame: DataFrame,
    config: Config,
    manifest: dict[str, Any],
    start: Day,
    end: Day,
    step: float = 10.0,
    cap: float | None = None,
    fixed: DataFrame | None = None,
    rounds: int = 30,
) -> Backtest:
    """Plan and score every day from ``start`` to ``end``.

    ``cap`` is the daily budget (the configured one by default); with ``cap=0`` each day has the total that was configured on it, and the
    first day's total holds for the choice of sets. ``fixed`` (segment, keyword_set_id) skips stage 1. Days need no rows of their own to
    be planned, only to be scored: without them their observed columns are NULL. A day with too few earlier rows stops the run.
    """
    spark, policy = frame.sparkSession, config.model_policy
    frame, days, order = cut_lineage(frame), window_days(start, end), config.constraints.regional_order
    if not days:
        raise ValueError("the window has no day")
    counts = [(r["date"], r["n"]) for r in usable_rows(frame, config.target).groupBy("date").agg(F.count("*").alias("n")).orderBy("date").collect()]
    n = sum(c for d, c in counts if d < start)
    if n < policy.validation.min_train_rows:
        raise ValueError(f"{n} rows before {start}, {policy.validation.min_train_rows} needed")
    caps = {d: float(config.constraints.daily_budget_cap if cap is None else cap) for d in days}
    if cap == 0:
        inside = frame.filter(F.col("date").between(F.lit(start), F.lit(end)))
        totals = {r["date"]: float(r["budget_total"]) for r in day_budget_total(inside, config.constraints.excluded_regions).collect()}
        absent = [str(d) for d in days if d not in totals]
        if absent:
            raise ValueError(f"no configured budget on {absent}")
        caps = totals
    most = max(caps.values())

    sets, features = known_sets(frame, start, config.static_columns())
    if fixed is not None:
        sets = fixed.select("segment", "keyword_set_id")
    segments = sets.select("segment").distinct()
    history = cut_lineage(budget_history(frame, days, segments, config.constraints.default_budget_max))
    regions = sorted({r[0] for r in segments.select(T.region_of_segment()).collect()})
    wanted = [c for c in config.context_features.get("calendar", [])]
    calendar = CAL.planning_calendar(spark, str(start), str(end), regions, config.start_dates, wanted)
    columns = [c for c in config.feature_columns() if c in frame.columns]
    rows = O.candidate_rows(sets, features, calendar, columns, str(start), str(end))
    if fixed is None:
        curve = _limited(window_curve(frame, config, manifest, rows, start, step, most), history.withColumn("date", F.col("date")), config)
        same_cap = dict.fromkeys(days, caps[start])
        chosen = select_sets_coupled(curve, same_cap, step, order, config.constraints.budget_tiebreak_penalty, rounds)
        sets = cut_lineage(chosen.select("segment", "keyword_set_id", "plan_value", "upper_bound", "gap").distinct())

    rows = cut_lineage(rows.join(sets.select("segment", "keyword_set_id"), ["segment", "keyword_set_id"], "left_semi"))
    curve = _limited(daily_curves(frame, config, manifest, rows, days, counts, step, most), history, config)
    limits = spark.createDataFrame(list(caps.items()), "date date, cap double")
    plan = cut_lineage(O.allocate_ordered(curve, most, step, order, config.constraints.budget_tiebreak_penalty, ("date",), limits))
    missing = sorted(set(days) - {r["date"] for r in plan.select("date").distinct().collect()})
    if missing:
        raise ValueError(f"no plan keeps the limits on {[str(d) for d in missing]}")

    scorer, _ = M.evaluation_model(frame, config, manifest)
    inside = frame.filter(F.col("date").between(F.lit(start), F.lit(end)))
    market = Q.market_decisions(inside, ["date", "segment"]).drop("campaign_version")
    _, known = known_sets(frame, end + datetime.timedelta(days=1), config.static_columns())
    minimums = observed_min_budget(frame, frame.select("segment").distinct())

    def scored(chosen: DataFrame, out: str) -> DataFrame:
        named = chosen.withColumns({"region": T.region_of_segment(), "is_broad_match": T.is_broad_only(T.match_part_of_segment())})
        days_of = CAL.planning_calendar(spark, str(start), str(end), sorted({*regions, *market_regions}), config.start_dates, wanted)
        full = scorer.predict(named.join(known, "keyword_set_id", "left").join(days_of, ["date", "region"], "left"), "_raw")
        if config.evaluation.apply_observed_budget_floor:
            full = O.apply_budget_floor(full, minimums, "_raw", out, config.evaluation.budget_floor_atol)
        else:
            full = full.withColumn(out, F.col("_raw"))
        return full.select("date", "segment", "daily_budget", "keyword_set_id", out)

    market_regions = {r[0] for r in market.select(T.region_of_segment()).distinct().collect()}
    comparison = cut_lineage(Q.plan_vs_actual(scored(plan, "pred_level"), scored(market, "actual_model_level"), inside, config.target))
    spent = plan.groupBy("date").agg(
        exact_sum(F.col("daily_budget")).alias("plan_budget_total"), F.count_if(F.col("daily_budget") <= 0).alias("n_segments_zero_budget")
    )
    held = M.level_metrics(scorer.predict(usable_rows(inside, config.target), "_p"), config.target, "_p", ["date"])
    held = held.select("date", F.col("r2").alias("holdout_r2"), F.col("rmse").alias("holdout_rmse"), F.col("mae").alias("holdout_mae"), F.col("n_rows").alias("n_holdout"))
    summary = limits.withColumnRenamed("cap", "total_budget").join(spent, "date").join(held, "date", "left")
    summary = summary.join(Q.row_metrics(comparison, config.target), "date", "left").withColumn("optimizer_winner", F.lit(policy.optimizer_winner))
    return Backtest(sets, plan, comparison, summary)
