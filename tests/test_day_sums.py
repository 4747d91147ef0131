"""Ridge fits from day sums against fits on each slice alone."""

import datetime
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.config import Config, ModelPolicy, Validation
from bidloom.models import day_sums as S
from bidloom.models import design as D
from bidloom.models import fit as M
from bidloom.operators import splits as V

DAY = datetime.date(2024, 1, 1)
BASE = Config(context_features={"calendar": ["day_of_week"], "keyword_set_static": ["f", "g"]})


def settings(half_life=None, **policy):
    return replace(BASE, model_policy=ModelPolicy(validation=Validation(recency_half_life_days=half_life), **policy))


@pytest.fixture(scope="module")
def frame(spark):
    rng, rows = np.random.default_rng(0), []
    for i in range(160):
        for region, mt in (("USA", "Broad"), ("A", "Phrase; Exact"), ("B", "Broad"))[: 3 if i > 90 else 2]:  # B comes late
            b = float(10 + (i * 7) % 50)
            f = None if i % 11 == 0 else 1e4 + float(rng.normal()) * 10
            g = 3.0 if i < 120 else float(rng.normal())  # does not vary at first
            y = None if i % 17 == 0 else 1 + 0.05 * b + float(rng.normal())
            rows.append((DAY + datetime.timedelta(days=i), region, mt, f"{region} / {mt}", b, int(mt == "Broad"), ["Mon", "Tue"][i % 2], f, g, y))
    schema = "date date, region string, match_types string, segment string, daily_budget double, is_broad_match int, day_of_week string, f double, g double, conv_scaled_clicks double"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.mark.parametrize("half_life", [None, 20.0])
def test_fits_equal_those_of_each_slice(frame, half_life):
    cfg = settings(half_life)
    sums = S.day_sums(frame, cfg)
    cuts = [DAY + datetime.timedelta(days=d) for d in (60, 100, 140)]
    levels = dict(zip(cuts, sums.fits([(c, 10.0) for c in cuts])))
    for cut, level in levels.items():
        rows = frame.filter(F.col("date") <= F.lit(cut))
        alone = M.fit("ridge", rows, cfg, {"alpha": 10.0})
        both = S.predict_by_day(alone.predict(frame, "want").withColumn("date", F.lit(cut)), sums, {cut: level}, "got")
        named = D.linear_columns(alone.encoding, scaled=True)
        table = both.select("got", "want", *[v.alias(f"x_{i}") for i, v in enumerate(named.values())]).toPandas()
        assert abs(table["got"] - table["want"]).max() < 1e-6  # the solver's own precision
        used = V.recency_weights(M.usable_rows(rows, cfg.target), half_life)
        own = used.select(F.col(cfg.target).alias("y"), "weight", *[v.alias(f"x_{i}") for i, v in enumerate(named.values())]).toPandas()
        x, y, w = own.filter(like="x_").to_numpy(), own["y"].to_numpy(), own["weight"].to_numpy()
        xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
        beta = np.linalg.solve((x - xm).T @ (w[:, None] * (x - xm)) + 10.0 * np.eye(x.shape[1]), (x - xm).T @ (w * (y - ym)))
        assert abs(table["got"] - (ym + (table.filter(like="x_").to_numpy() - xm) @ beta)).max() < 1e-9
    assert sums.rows_before()[cuts[0]] == frame.filter((F.col("date") < F.lit(cuts[0])) & F.col("conv_scaled_clicks").isNotNull()).count()


def test_folds_of_all_penalties(frame):
    cfg = settings(30.0)
    folds = M.folds_of(frame, cfg)
    alphas = [1.0, 10.0, 100.0]
    got = M.validate_ridge(folds, alphas)
    for alpha, cv in zip(alphas, got):
        per_fold = []
        for _, rows, val in folds:
            scored = M.fit("ridge", rows, cfg, {"alpha": alpha}).predict(M.usable_rows(val, cfg.target), "p")
            per_fold.append(M.level_metrics(scored, cfg.target, "p").first())
        for key, of in (("cv_rmse_levels", "rmse"), ("cv_r2_levels", "r2"), ("cv_mae_levels", "mae")):
            assert math.isclose(cv[key], sum(r[of] for r in per_fold) / len(per_fold), rel_tol=1e-6), (alpha, key)
        assert cv["cv_n_folds"] == len(folds) == 3
    best, cv = M.tune("ridge", frame, cfg, {"alpha": alphas}, folds)
    assert cv == min(got, key=lambda m: m["cv_rmse_levels"]) and best["alpha"] == alphas[got.index(cv)]


def test_other_learners_side_by_side(frame):
    cfg = settings()
    folds = M.folds_of(frame, cfg)
    settings_ = M.param_maps({"n_estimators": [3], "max_depth": [2, 3], "min_samples_leaf": [10]})
    got = M.validate_all("random_forest", cfg, settings_, folds)
    assert got == [M.cross_validate("random_forest", frame, cfg, p, folds) for p in settings_]
    with pytest.raises(M.FoldError, match="fold 1 of 3 failed for nope"):
        M.validate_all("nope", cfg, [{}], folds)


def test_winner_parameters(frame):
    """Tuned on the slice, or as recorded; without a record it is an error."""
    cfg = settings(optimizer_winner="ridge")
    cut = str(DAY + datetime.timedelta(days=120))
    tuned = M.fit_winner(frame, cfg, {}, before=cut, tune_on_slice=True)
    rows = frame.filter(F.col("date") < F.to_date(F.lit(cut)))
    assert tuned.params["alpha"] == M.tune("ridge", rows, cfg)[0]["alpha"]
    assert M.fit_winner(frame, cfg, {"params": {"ridge": {"alpha": 7.0}}}, before=cut).params["alpha"] == 7.0
    for name in ("ridge", "ensemble_ridge_xgb"):
        with pytest.raises(ValueError, match="no parameters"):
            M.fit_winner(frame, settings(optimizer_winner=name), {"params": {"xgboost": {}}}, before=cut)
    with pytest.raises(ValueError, match="does not support"):
        M.fit_winner(frame, settings(optimizer_winner="ensemble"), {}, tune_on_slice=True)
    M.fit_winner(frame, settings(optimizer_winner="mean_baseline"), {})
