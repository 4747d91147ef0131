"""Allocation on fine grids, window plans under coupled limits, response curves and the two-stage backtest against plain versions."""

import datetime
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.config import Config, Constraints, ModelPolicy, Validation
from bidloom.functions import calendar as CAL
from bidloom.models import fit as M
from bidloom.models import response as R
from bidloom.operators import coupled
from bidloom.operators import planning as O

DAY = datetime.date(2024, 1, 1)
ORDER = ("USA", "A", "B")


def cubic(regions):
    """Every triple of totals, with the ties of the allocation."""
    (f, p), (g, q), (h, r) = (O._fold(w) for w in regions)
    best = None
    for b, a, u in itertools.product(range(len(f)), repeat=3):
        if u >= a >= b and u + a + b < len(f):
            v = round(f[u] + g[a] + h[b], 9)
            if np.isfinite(v) and (best is None or (v, -(u + a + b), -u, -a, -b) > best):
                best = (v, -(u + a + b), -u, -a, -b)
    return best and (best[0], [*p[-best[2]].tolist(), *q[-best[3]].tolist(), *r[-best[4]].tolist()])


def test_order_equals_all_triples():
    rng = np.random.default_rng(1)
    for t in range(60):
        draw = lambda k: rng.integers(-3, 8, (k, 13)) * 0.5 if t % 2 else rng.random((k, 13)) * 3
        regions = [np.round(np.where(rng.random((k, 13)) < 0.1, np.nan, draw(k)), 2) for k in rng.integers(0, 3, 3)]
        assert O._best_in_order(regions) == cubic(regions)


def curve_of(spark, levels):
    rows = [(d, s, k, b, float(v)) for (d, s, k, b), v in levels.items()]
    return spark.createDataFrame(rows, "date date, segment string, keyword_set_id string, budget double, level double")


def test_fine_grid(spark):
    rng = np.random.default_rng(2)
    levels = {}
    for s in ("USA / Broad", "USA / Phrase; Exact", "A / Broad", "B / Broad"):
        slope = rng.random() * 0.2
        levels |= {(DAY, s, "k", float(u)): round(slope * np.sqrt(u) + rng.random() * 0.01, 4) for u in range(601)}
    curve = curve_of(spark, levels).cache()
    curve.count()
    O.allocate_ordered(curve, 600.0, 1.0).collect()
    began = time.perf_counter()
    plan = O.allocate_ordered(curve, 600.0, 1.0).collect()
    assert time.perf_counter() - began < 5
    assert len(plan) == 4 and sum(r.daily_budget for r in plan) == plan[0].total_budget <= 600
    free = O.allocate_budgets(curve, 600.0, 1.0).first().objective
    assert plan[0].objective <= free


def test_own_cap_of_each_day(spark):
    days = [DAY + datetime.timedelta(days=i) for i in range(3)]
    levels = {(d, s, "k", b): b * (1 + i) for d in days for i, s in enumerate(("USA / Broad", "A / Broad", "B / Broad")) for b in (0.0, 10.0, 20.0)}
    caps = spark.createDataFrame(list(zip(days, (0.0, 30.0, 45.0))), "date date, cap double")
    plan = O.allocate_ordered(curve_of(spark, levels), 60.0, 10.0, caps=caps).groupBy("date").sum("daily_budget").collect()
    assert {r[0]: r[1] for r in plan} == dict(zip(days, (0.0, 30.0, 40.0)))


def test_budgets_off_the_grid_stop(spark):
    curve = curve_of(spark, {(DAY, "USA / Broad", "k", b): 1.0 for b in (0.0, 10.0, 14.0)})
    with pytest.raises(Exception, match="off the planning grid"):
        O.allocate_budgets(curve, 20.0, 10.0).collect()


# --- set choice under coupled limits -----------------------------------------------------------


def best_by_hand(levels, caps, order, penalty, segments, sets):
    """Greatest value over all sets and budgets, day by day."""
    best = -np.inf
    for choice in itertools.product(*[sets[s] for s in segments]):
        total = 0.0
        for d, cap in caps.items():
            options = [sorted(b for (dd, s, k, b) in levels if (dd, s, k) == (d, seg, kk)) for seg, kk in zip(segments, choice)]
            top = -np.inf
            for pick in itertools.product(*options):
                spend = [sum(p for s, p in zip(segments, pick) if s.startswith(r + " /")) for r in order]
                if sum(pick) <= cap + 1e-9 and all(a >= b for a, b in zip(spend, spend[1:])):
                    top = max(top, sum(levels[d, s, k, p] - penalty * p for s, k, p in zip(segments, choice, pick)))
            total += top
        best = max(best, total)
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_coupled_choice_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    days = [DAY, DAY + datetime.timedelta(days=1)]
    segments = ["USA / Broad", "USA / Phrase; Exact", "A / Broad", "B / Broad"]
    sets = {s: ["k1", "k2", "k3"][: 2 + i % 2] for i, s in enumerate(segments)}
    levels = {}
    for d, s in itertools.product(days, segments):
        for k in sets[s]:
            height = rng.random() * 3
            for u in range(4):
                levels[d, s, k, 10.0 * u] = round(height * np.sqrt(u) + rng.random() * 0.3, 3)
    caps = dict(zip(days, (60.0, 40.0)))
    curve = curve_of(spark, levels)
    rows = coupled.select_sets_coupled(curve, caps, 10.0, ORDER, 0.001, rounds=20).collect()
    want = best_by_hand(levels, caps, ORDER, 0.001, segments, sets)
    assert rows[0].upper_bound >= want - 1e-6 and abs(rows[0].plan_value - want) < 1e-6
    assert rows[0].gap == pytest.approx(rows[0].upper_bound - rows[0].plan_value, abs=1e-5)
    plan = spark.createDataFrame(rows)
    assert len(rows) == 8 and plan.select("segment", "keyword_set_id").distinct().count() == 4
    bounds = plan.select("segment").distinct().selectExpr("segment", "0D AS budget_lo", "30D AS budget_hi")
    low = plan.select("segment").distinct().selectExpr("segment", "0D AS min_budget")
    for d in days:
        assert O.audit_plan(plan.filter(F.col("date") == d), bounds, low, caps[d], ORDER).count() == 0


def test_no_plan_keeps_the_limits(spark):
    curve = curve_of(spark, {(DAY, s, "k", 10.0): 1.0 for s in ("USA / Broad", "A / Broad")})
    with pytest.raises(ValueError, match="all limits"):
        coupled.select_sets_coupled(curve, {DAY: 10.0}, 10.0, ORDER, rounds=2)


# --- response curves -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def frame(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(120):
        for region, mt in (("USA", "Broad"), ("A", "Phrase; Exact"), ("B", "Broad")):
            b = round(float(10 + rng.random() * 50), 2)
            k = f"k{i // 40 % 2 + 1}"
            rows.append((DAY + datetime.timedelta(days=i), region, mt, f"{region} / {mt}", k, "v", b, int(mt == "Broad"), float(i % 5) + (k == "k2"), 5, 1 + 0.05 * b + float(rng.normal()) * 0.2))
    schema = (
        "date date, region string, match_types string, segment string, keyword_set_id string, campaign_version string, daily_budget double, "
        "is_broad_match int, f double, clicks long, conv_scaled_clicks double"
    )
    return CAL.with_date_parts(spark.createDataFrame(rows, schema)).withColumn("days_to_next_course_start", CAL.days_to_next("date", ["2024-06-01"])).cache()


def cfg(winner):
    return Config(
        context_features={"calendar": ["day_of_week"], "keyword_set_static": ["f"]},
        model_policy=ModelPolicy(optimizer_winner=winner, validation=Validation(holdout_days=20, tune_hyperparams=False, min_train_rows=30)),
        start_dates=("2024-06-01",),
        constraints=Constraints(daily_budget_cap=120.0),
    )


@pytest.mark.parametrize("name", ["xgboost", "random_forest", "ridge", "mean_baseline", "ensemble_ridge_xgb"])
def test_curve_is_exact_at_every_cent(spark, frame, name):
    model = M.fit_any(name, frame, cfg("ridge"), {})
    rows = frame.filter(F.col("date") == DAY).select("segment", "region", "is_broad_match", "day_of_week", "f")
    pieces = R.response_curve(model, rows, 18.0, 24.0)
    n_pieces = pieces.count() // 3
    assert (n_pieces == 1) == (name in ("ridge", "mean_baseline"))
    clip = name.startswith("ensemble")
    got = R.curve_on_grid(pieces, ["segment"], 0.01, clip).withColumn("budget", F.round("budget", 2))
    cents = F.explode(F.transform(F.sequence(F.lit(1800), F.lit(2400)), lambda c: c / 100))
    want = model.predict(rows.withColumn("daily_budget", cents), "want").select("segment", F.col("daily_budget").alias("budget"), "want")
    both = got.join(want, ["segment", "budget"], "full").toPandas()
    assert len(both) == 3 * 601 and abs(both["level"] - both["want"]).max() < 1e-9
