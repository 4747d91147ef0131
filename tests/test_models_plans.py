import datetime
import itertools
import json
import os

import numpy as np
import pytest

from bidloom.config import Config, Validation, load_config
from bidloom.models import design as D
from bidloom.models import fit as M
from bidloom.operators import panel as P
from bidloom.operators import planning as O
from bidloom.operators import scoring as Q
from bidloom.operators import semantics as E
from bidloom.operators import splits as V
from bidloom.sources import feeds, files


def panel(spark, n=200):
    day = datetime.date(2024, 1, 1)
    rows = []
    rng = np.random.default_rng(0)
    for i in range(n):
        for region, mt in (("USA", "Broad"), ("A", "Phrase; Exact")):
            b = float(10 + (i * 7) % 50)
            rows.append((day + datetime.timedelta(days=i), region, mt, f"{region} / {mt}", b, int(mt == "Broad"), ["Mon", "Tue"][i % 2], float(i % 5), 1 + 0.05 * b + rng.normal()))
    return spark.createDataFrame(rows, "date date, region string, match_types string, segment string, daily_budget double, is_broad_match int, day_of_week string, f double, conv_scaled_clicks double")


CFG = Config(context_features={"calendar": ["day_of_week"], "keyword_set_static": ["f"]})


def test_config_layers():
    cfg = load_config({"constraints": {"daily_budget_cap": 10.0}}, {"start_dates": ["2024-01-01"], "model_policy": {"validation": {"cv_folds": 5}}})
    assert cfg.constraints.daily_budget_cap == 10.0 and cfg.model_policy.validation.cv_folds == 5 and cfg.start_dates == ("2024-01-01",)
    with pytest.raises(KeyError):
        load_config({"nope": 1})


def test_ridge_equals_closed_form(spark):
    df = panel(spark)
    cfg = load_config({"context_features": CFG.context_features, "model_policy": {"validation": {"recency_half_life_days": 60.0}}})
    cfg = type(cfg)(**{**cfg.__dict__, "context_features": CFG.context_features})
    model = M.fit("ridge", df, cfg, {"alpha": 10.0})
    rows = V.recency_weights(df, 60.0).select("*", *[v.alias(f"x_{c}") for c, v in D.linear_columns(model.encoding, True).items()]).toPandas()
    x = rows[[c for c in rows if c.startswith("x_")]].to_numpy()
    y, w = rows["conv_scaled_clicks"].to_numpy(), rows["weight"].to_numpy()
    xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - xm, y - ym
    beta = np.linalg.solve(xc.T @ (w[:, None] * xc) + 10.0 * np.eye(x.shape[1]), xc.T @ (w * yc))
    assert np.allclose(model.model.coefficients.toArray(), beta, atol=1e-8)
    assert np.isclose(model.model.intercept, ym - xm @ beta)


def test_folds(spark):
    days = V.fold_days(panel(spark), Validation(min_train_rows=1, min_val_rows=1)).toPandas()
    assert sorted(days["fold"].unique()) == [1, 2, 3]
    for _, fold in days.groupby("fold"):
        train, val = fold[fold.role == "train"]["date"], fold[fold.role == "val"]["date"]
        assert train.max() < val.min() and len(val) >= 21 and len(train) >= 100
    assert V.fold_days(panel(spark, 30), Validation()).count() == 0
    assert V.fallback_days(panel(spark, 10)).filter("role = 'train'").count() == 9


def test_tournament_small(spark):
    result = M.run_tournament(panel(spark), CFG, ["mean_baseline", "ridge"], {"ridge": {"alpha": [1.0, 10.0]}})
    assert result.winner == "ridge" and result.params["ridge"]["alpha"] in (1.0, 10.0)
    assert M.inverse_error_weights({"a": 1.0, "b": 3.0}, ["a", "b"]) == [0.75, 0.25]


def brute(curves, units, step, penalty, order=None):
    best = None
    names = sorted(curves)
    for pick in itertools.product(*[sorted(curves[n]) for n in names]):
        if sum(pick) > units:
            continue
        if order:
            spend = [sum(p for n, p in zip(names, pick) if n.startswith(r + " /")) for r in order]
            if any(spend[i] < spend[i + 1] for i in range(len(spend) - 1)):
                continue
        v = sum(curves[n][p] - penalty * p * step for n, p in zip(names, pick))
        if best is None or v > best + 1e-9:
            best = v
    return best


@pytest.mark.parametrize("ordered", [False, True])
def test_allocation_equals_brute_force(spark, ordered):
    rng = np.random.default_rng(5)
    day = datetime.date(2024, 1, 1)
    curves = {s: {u: float(np.round(rng.random() * 3 - 0.5, 2)) if u else 0.0 for u in range(5)} for s in ("USA / Broad", "A / Broad", "B / Broad")}
    rows = [(day, s, "k", u * 10.0, v) for s, c in curves.items() for u, v in c.items()]
    df = spark.createDataFrame(rows, "date date, segment string, keyword_set_id string, budget double, level double")
    fn = O.allocate_ordered if ordered else O.allocate_budgets
    plan = fn(df, 80.0, 10.0, penalty=0.001).collect()
    assert np.isclose(plan[0].objective, brute(curves, 8, 10.0, 0.001, ("USA", "A", "B") if ordered else None))
    assert sum(r.daily_budget for r in plan) == plan[0].total_budget <= 80.0
    assert all(np.isclose(r.milp_pred, curves[r.segment][int(r.daily_budget // 10)]) for r in plan)


def test_bound_is_above_plan(spark):
    rng = np.random.default_rng(7)
    rows = [(datetime.date(2024, 1, d), s, k, b * 10.0, float(np.sqrt(b) * rng.random())) for d in (1, 2) for s in ("USA / Broad", "A / Broad") for k in "kl" for b in range(5)]
    df = spark.createDataFrame(rows, "date date, segment string, keyword_set_id string, budget double, level double")
    row = O.select_sets(df, 50.0, 10.0, [0.0, 0.01, 0.05], 0.0001).first()
    assert row.gap >= -1e-6


def test_floor(spark):
    df = spark.createDataFrame([("s", 13.519999999, -1.0), ("s", 13.5, 2.0), ("t", 0.0, 3.0)], "segment string, daily_budget double, level double")
    low = spark.createDataFrame([("s", 13.52)], "segment string, min_budget double")
    got = {(r.segment, r.daily_budget): r.g for r in O.apply_budget_floor(df, low, "level", "g").collect()}
    assert got == {("s", 13.519999999): -1.0, ("s", 13.5): 0.0, ("t", 0.0): 3.0}


def test_rates_guard(spark):
    bad = spark.createDataFrame([("USA", "Broad", 0, 1.0)], "region string, match_types string, clicks int, all_conv double")
    with pytest.raises(Exception, match="zero clicks"):
        P.segment_rates(bad).collect()


def test_greedy_dispersion_equals_plain_loop(spark):
    rng = np.random.default_rng(3)
    vecs = {f"k{i:02d}": (lambda v: v / np.linalg.norm(v))(rng.normal(size=8)) for i in range(30)}

    def disp(words):
        m = np.stack([vecs[w] for w in words])
        c = m.mean(axis=0)
        return float(np.mean(1 - (m @ c) / (np.linalg.norm(m, axis=1) * np.linalg.norm(c) + 1e-12)))

    want = [min(vecs)]
    while len(want) < 6:
        want.append(max((w for w in sorted(vecs) if w not in want), key=lambda w: disp(want + [w])))
    df = spark.createDataFrame([("p", k, [float(x) for x in v]) for k, v in vecs.items()], "pool string, keyword string, embedding array<double>")
    got = [r.keyword for r in sorted(E.top_by_dispersion(df, ["pool"], 6).collect(), key=lambda r: r.pos)]
    assert got == want
    mean = {r.keyword: r.mean_distance for r in E.mean_distance_to_pool(df, ["pool"], block_rows=7).collect()}
    for k, v in vecs.items():
        assert np.isclose(mean[k], np.mean([np.linalg.norm(v - o) for n, o in vecs.items() if n != k]), atol=1e-6)


# Published daily results of a 14-day run and the summary they must give.
DAYS = """3.880266882479191,2.764080762863159,400.81
3.787399150431156,2.7322484850883484,398.34
3.787399150431156,2.7322484850883484,398.34
3.7421708181500435,2.7322484850883484,398.34
3.5109830126166344,2.4885559678077698,398.34
3.739954926073551,2.6778836846351624,400.81
3.880808688700199,2.751116454601288,400.81
3.880266882479191,2.764080762863159,400.81
3.8325184360146523,2.7322484850883484,400.81
3.731240339577198,2.7322484850883484,380.13
3.6630410999059677,2.7322484850883484,410.71
3.5560232624411583,2.4885559678077698,405.59
3.739954926073551,2.6778836846351624,400.81
3.880808688700199,2.751116454601288,400.81"""


def test_published_backtest_summary(spark):
    rows = [(datetime.date(2026, 5, 12) + datetime.timedelta(days=i), *map(float, line.split(",")), 367.27) for i, line in enumerate(DAYS.splitlines())]
    df = spark.createDataFrame(rows, "day date, pred_level_total double, actual_model_level_total double, opt_budget_total double, act_budget_total double")
    model, actual = sorted(Q.performance_summary(df, "conv_scaled_clicks").collect(), key=lambda r: r.scenario, reverse=True)
    want = (3.75806, 0.03143, 399.67571, 1.74613, 0.0094028, 39.34678, 28.04854)
    got = (model.conversions, model.conversions_se, model.budget, model.budget_se, model.conversions_per_dollar, model.improvement_conversions_pct, model.improvement_conversions_per_dollar_pct)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
    assert np.isclose(actual.conversions, 2.69691, atol=1e-4) and actual.improvement_conversions_pct is None


def test_plan_folder_and_planner_export(spark, tmp_path):
    for day, cols in (("20240102", "segment,daily_budget,row_kind\nUSA / Broad,5,plan\n"), ("20240103", "row_kind,segment,pred_level\nplan,A / Broad,2.5\n")):
        os.makedirs(tmp_path / "plans" / day)
        (tmp_path / "plans" / day / "plan_vs_actual.csv").write_text(cols)
    (tmp_path / "plans" / "20240103" / "plan_vs_actual_weekly.csv").write_text("segment,pred_level\nB / Broad,1\n")
    got = {(str(r.date), r.segment, r.period, r.daily_budget, r.pred_level) for r in files.collect_plan_vs_actual(spark, str(tmp_path)).collect()}
    assert got == {("2024-01-02", "USA / Broad", "day", 5.0, None), ("2024-01-03", "A / Broad", "day", None, 2.5), ("2024-01-03", "B / Broad", "week", None, 1.0)}
    (tmp_path / "Saved Keyword Stats 1.csv").write_text("Keyword\tSearches: Dec 2023\tSearches: Mar 2024\tSearches: Feb 2024\tCompetition (indexed value)\tTop of page bid (low range)\nBig Idea\t1\t1,200\t7\t45%\t$3.10\n", encoding="utf-16")
    row = feeds.tidy_planner_stats(feeds.read_planner_export(spark, str(tmp_path))).first()
    assert (row.keyword, row.last_month_searches, row.competition_index, row.bid_low) == ("big idea", 1200.0, 45.0, 3.10)


def test_idempotent_append(spark):
    old = spark.createDataFrame([("2024-01-01", 1.0)], "score_date string, v double")
    new = spark.createDataFrame([("2024-01-01", 9.0), ("2024-01-02", 2.0)], "score_date string, v double")
    assert sorted(map(tuple, Q.append_metrics(old, new).collect())) == [("2024-01-01", 1.0), ("2024-01-02", 2.0)]
    assert sorted(map(tuple, Q.append_metrics(old, new, overwrite=True).collect())) == [("2024-01-01", 9.0), ("2024-01-02", 2.0)]
