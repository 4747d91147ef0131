"""The two-stage backtest against fits, curves and allocations made day by day."""

import datetime
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.config import Config, Constraints, ModelPolicy, Validation
from bidloom.functions import calendar as CAL
from bidloom.models import day_sums as S
from bidloom.models import fit as M
from bidloom.operators import planning as O
from bidloom.operators import splits as V
from bidloom.plans import backtest as B

DAY = datetime.date(2024, 1, 1)
STARTS = ("2024-06-01",)


def at(i):
    return DAY + datetime.timedelta(days=i)


@pytest.fixture(scope="module")
def frame(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(120):
        for region, mt in (("USA", "Broad"), ("USA", "Phrase; Exact"), ("A", "Phrase; Exact"), ("B", "Broad")):
            b, k = float(rng.integers(1, 7) * 10), f"k{(i // 10 + len(mt)) % 2 + 1}"
            y = 1 + 0.05 * b + (k == "k2") * 0.5 + float(rng.normal()) * 0.2
            rows.append((at(i), region, mt, f"{region} / {mt}", k, "v", b, int(mt == "Broad"), 1.0 + (k == "k2"), 5, y))
    schema = (
        "date date, region string, match_types string, segment string, keyword_set_id string, campaign_version string, daily_budget double, "
        "is_broad_match int, f double, clicks long, conv_scaled_clicks double"
    )
    return CAL.with_date_parts(spark.createDataFrame(rows, schema)).withColumn("days_to_next_course_start", CAL.days_to_next("date", STARTS)).cache()


def settings(winner, tune=False, **constraints):
    return Config(
        context_features={"calendar": ["day_of_week", "days_to_next_course_start"], "keyword_set_static": ["f"]},
        model_policy=ModelPolicy(optimizer_winner=winner, validation=Validation(holdout_days=20, tune_hyperparams=tune, min_train_rows=30)),
        start_dates=STARTS,
        constraints=Constraints(daily_budget_cap=120.0, **constraints),
    )


MANIFEST = {"params": {"ridge": {"alpha": 10.0}, "random_forest": {"n_estimators": 3, "max_depth": 2, "min_samples_leaf": 10}}}


def by_hand(spark, frame, cfg, sets, day, cap):
    """The day's plan value from its own fit and every grid budget scored by the model."""
    model = M.fit_winner(frame, cfg, MANIFEST, before=str(day))
    before = frame.filter(F.col("date") < F.lit(day))
    found, features = B.known_sets(frame, at(110), ["f"])
    calendar = CAL.planning_calendar(spark, str(day), str(day), ["USA", "A", "B"], STARTS, ["day_of_week", "days_to_next_course_start"])
    rows = O.candidate_rows(found.join(sets, ["segment", "keyword_set_id"], "left_semi"), features, calendar, cfg.feature_columns(), str(day), str(day))
    grid = rows.withColumn("daily_budget", F.explode(F.array(*[F.lit(10.0 * i) for i in range(13)])))
    limits = before.groupBy("segment").agg(F.min("daily_budget").alias("min_budget"), F.max("daily_budget").alias("top"))
    gated = O.apply_budget_floor(model.predict(grid, "raw"), limits, "raw", "level").join(limits, "segment").filter("daily_budget <= top")
    curve = gated.select("date", "segment", "keyword_set_id", F.col("daily_budget").alias("budget"), "level")
    return O.allocate_ordered(curve, cap, 10.0, cfg.constraints.regional_order, 0.0001)


@pytest.mark.parametrize("winner", ["ridge", "random_forest", "mean_baseline"])
def test_days_equal_plans_made_alone(spark, frame, winner):
    cfg = settings(winner)
    run = B.two_stage_backtest(frame, cfg, MANIFEST, at(110), at(121), rounds=6)  # two days beyond the panel
    plan, days = run.plan.toPandas(), {r["date"]: r for r in run.days.collect()}
    assert sorted(days) == [at(i) for i in range(110, 122)] and len(plan) == 12 * 4
    assert run.sets.groupBy("segment").count().filter("count > 1").count() == 0 and run.sets.count() == 4
    assert (run.sets.toPandas()["gap"] >= 0).all()
    for i in (110, 115, 121):
        own = by_hand(spark, frame, cfg, run.sets, at(i), 120.0).toPandas()
        assert own["objective"].iloc[0] == pytest.approx(plan[plan["date"] == at(i)]["objective"].iloc[0], abs=1e-6)
        r = days[at(i)]
        assert r["plan_budget_total"] == pytest.approx(own["total_budget"].iloc[0])
        assert r["n_segments_zero_budget"] == (plan[plan["date"] == at(i)]["daily_budget"] <= 0).sum() and r["total_budget"] == 120.0
    history = B.budget_history(frame, [at(i) for i in range(110, 122)], run.sets.select("segment"), 500.0)
    bounds = history.groupBy("segment").agg(F.lit(0.0).alias("budget_lo"), F.min("budget_hi").alias("budget_hi"))
    audit = O.audit_plan(run.plan, bounds, history.groupBy("segment").agg(F.max("min_budget").alias("min_budget")), 120.0, ("USA", "A", "B"))
    assert audit.count() == 0
    # Days with rows are scored, days beyond the panel are only planned.
    assert all((days[at(i)]["observed_total"] is None) == (i >= 120) and (days[at(i)]["holdout_r2"] is None) == (i >= 120) for i in range(110, 122))
    scorer, _ = M.evaluation_model(frame, cfg, MANIFEST)
    held = M.level_metrics(scorer.predict(frame.filter(F.col("date") == F.lit(at(111))), "p"), cfg.target, "p").first()
    if held["r2"] is not None:
        assert days[at(111)]["holdout_r2"] == pytest.approx(held["r2"]) and days[at(111)]["holdout_rmse"] == pytest.approx(held["rmse"])


def test_configured_budgets_and_fixed_sets(spark, frame):
    cfg = settings("ridge")
    fixed = spark.createDataFrame([(s, "k1") for s in ("USA / Broad", "USA / Phrase; Exact", "A / Phrase; Exact", "B / Broad")], "segment string, keyword_set_id string")
    run = B.two_stage_backtest(frame, cfg, MANIFEST, at(112), at(114), cap=0, fixed=fixed)
    totals = {r[0]: r[1] for r in frame.groupBy("date").sum("daily_budget").collect()}
    for r in run.days.collect():
        assert r["total_budget"] == totals[r["date"]] >= r["plan_budget_total"]
    assert {r[0] for r in run.plan.select("keyword_set_id").distinct().collect()} == {"k1"}
    with pytest.raises(ValueError, match="no configured budget"):
        B.two_stage_backtest(frame, cfg, MANIFEST, at(118), at(120), cap=0, fixed=fixed)


def test_too_few_rows_stop(frame):
    with pytest.raises(ValueError, match="rows before"):
        B.two_stage_backtest(frame, settings("ridge"), MANIFEST, at(5), at(8))
    with pytest.raises(ValueError, match="no parameters"):
        B.two_stage_backtest(frame, settings("ridge"), {}, at(110), at(111))


def test_penalties_of_all_days_in_one_job(frame):
    cfg = settings("ridge", tune=True)
    counts = [(r[0], r[1]) for r in frame.groupBy("date").count().orderBy("date").collect()]
    days = [at(70), at(100), at(119)]
    got = B._ridge_penalties(frame, cfg, {}, S.day_sums(frame, cfg), days, counts)
    assert got == [M.tune("ridge", frame.filter(F.col("date") < F.lit(d)), cfg)[0]["alpha"] for d in days]


@pytest.mark.parametrize("v", [Validation(), Validation(cv_folds=5, min_val_days=7), Validation(min_train_fraction=0.9), Validation(min_train_rows=10**6), Validation(min_train_days=100)])
def test_fold_spans(frame, v):
    for i in (119, 60, 43, 9):
        rows = frame.filter(F.col("date") <= F.lit(at(i)))
        counts = [(r[0], r[1]) for r in rows.groupBy("date").count().orderBy("date").collect()]
        assert B.fold_spans(counts, v) == M.Folds(rows, replace(settings("ridge"), model_policy=ModelPolicy(validation=v))).spans, i
