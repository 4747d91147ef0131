"""Queries over models, backtests and stream jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.catalog import roles as R
from bidloom.catalog.planning_scores import COMP, DAILY_SQL, TARGET, scoped
from bidloom.catalog.registry import query
from bidloom.catalog.selections import FRAME_SQL, config, modeling_frame, rounded
from bidloom.config import load_config
from bidloom.functions import text as T
from bidloom.models import artifacts, design as D, fit as M
from bidloom.operators import history as H
from bidloom.operators import panel as P
from bidloom.operators import scoring as Q
from bidloom.operators import splits as V
from bidloom.session import cut_lineage, scratch_dir, stored_table
from bidloom.streaming import jobs


def frame(spark, sf):
    return cut_lineage(modeling_frame(spark, sf))


def _cfg():
    return load_config({"start_dates": list(R.STARTS)})


@query("s13_modeling_artifacts")
def s13(spark, sf):
    cfg = _cfg()
    rows = frame(spark, sf)
    paths = artifacts.save_modeling_artifacts(*V.train_holdout(rows, cfg.model_policy.validation.holdout_days), cfg, scratch_dir(spark, "features"))
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path)
        part = df.groupBy().agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m1_tree_design")
def m1(spark, sf):
    cfg, rows = _cfg(), frame(spark, sf)
    enc = D.learn_encoding(P.usable_rows(rows, TARGET), cfg.feature_columns())
    return rows.select("date", "segment", "campaign_version", *[F.round(v, 6).alias(f"x_{c}") for c, v in D.tree_columns(enc).items()])


M2_COLS = ["region_A", "region_B", "region_USA", "is_broad_match", "daily_budget", "embed_course_sim_mean", "budget_x_region_A", "budget_x_is_broad_match", "day_of_week_Monday"]


@query("m2_linear_design", f"""WITH {FRAME_SQL}, mo AS (SELECT avg(daily_budget) AS mb, stddev_pop(daily_budget) AS sb, avg(coalesce(embed_course_sim_mean, 0)) AS me, stddev_pop(coalesce(embed_course_sim_mean, 0)) AS se FROM frame)
SELECT date, campaign_version, CAST(region = 'A' AS DOUBLE) AS "x_region_A", CAST(region = 'B' AS DOUBLE) AS "x_region_B", CAST(region = 'USA' AS DOUBLE) AS "x_region_USA", CAST(is_broad_match AS DOUBLE) AS x_is_broad_match,
 round((daily_budget - mb) / sb, 6) AS x_daily_budget, round((coalesce(embed_course_sim_mean, 0) - me) / se, 5) AS x_embed_course_sim_mean, round(CASE WHEN region = 'A' THEN (daily_budget - mb) / sb ELSE 0 END, 6) AS "x_budget_x_region_A",
 round(CASE WHEN is_broad_match = 1 THEN (daily_budget - mb) / sb ELSE 0 END, 6) AS x_budget_x_is_broad_match, CAST(day_of_week = 'Monday' AS DOUBLE) AS "x_day_of_week_Monday" FROM frame, mo""")
def m2(spark, sf):
    cfg, rows = _cfg(), frame(spark, sf)
    enc = D.learn_encoding(P.usable_rows(rows, TARGET), cfg.feature_columns())
    cols = D.linear_columns(enc, scaled=True)
    digits = {"embed_course_sim_mean": 5}
    return rows.select("date", "campaign_version", *[(F.round(cols[c], digits.get(c, 6)) + 0.0).alias(f"x_{c}") for c in M2_COLS])


def _predicted(name):
    def run(spark, sf):
        cfg, rows = _cfg(), frame(spark, sf)
        model = M.fit(name, rows, cfg)
        return model.predict(P.usable_rows(rows, TARGET), "predicted").select("date", "segment", "campaign_version", F.round("predicted", 6).alias("predicted"))
    return run


query("m3_ridge")(_predicted("ridge"))
query("m4_random_forest")(_predicted("random_forest"))
query("m5_boosted_trees")(_predicted("xgboost"))


@query("m6_mean_baseline", f"WITH {FRAME_SQL} SELECT date, campaign_version, round((SELECT avg({TARGET}) FROM frame), 6) AS predicted FROM frame")
def m6(spark, sf):
    rows = frame(spark, sf)
    model = M.fit("mean_baseline", rows, _cfg())
    return model.predict(rows, "predicted").select("date", "campaign_version", F.round("predicted", 6).alias("predicted"))


@query("m7_ensemble_blend", """
SELECT date, campaign_version, round(greatest((0.25 * (daily_budget / 100 - 3) + 0.75 * (clicks / 50 - 1)) / 1.0, 0), 6) AS blended FROM segment_panel""")
def m7(spark, sf):
    rows = R.segment_panel(spark, sf)
    out = M.blend([F.col("daily_budget") / 100 - 3, F.col("clicks") / 50 - 1], [0.25, 0.75])
    return rows.select("date", "campaign_version", F.round(out, 6).alias("blended"))


@query("m8_level_metrics", f"""
WITH sc AS (SELECT segment, {TARGET} AS y, greatest(daily_budget / 100 - 2.4, 0) AS p FROM segment_panel WHERE region <> 'C' AND match_types IN ('Broad', 'Phrase; Exact'))
SELECT segment, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 5) AS r2, round(avg(abs(y - p)), 6) AS mae, CAST(count(*) AS BIGINT) AS n_rows FROM sc GROUP BY 1""")
def m8(spark, sf):
    rows = scoped(spark, sf).withColumn("p", F.col("daily_budget") / 100 - 2.4)
    return rounded(rounded(M.level_metrics(rows, TARGET, "p", ["segment"]), 6, "rmse", "mae"), 5, "r2")


@query("m9_cross_validation")
def m9(spark, sf):
    cfg, rows = _cfg(), frame(spark, sf)
    cv = M.cross_validate("ridge", rows, cfg)
    base = M.cross_validate("mean_baseline", rows, cfg)
    return spark.createDataFrame([("ridge", *map(float, cv.values())), ("mean_baseline", *map(float, base.values()))],
                                 "model string, rmse double, r2 double, mae double, n_folds double")


@query("m10_grid_search")
def m10(spark, sf):
    params, cv = M.tune("ridge", frame(spark, sf), _cfg())
    return spark.createDataFrame([("ridge", float(params["alpha"]), float(cv["cv_rmse_levels"]))], "model string, alpha double, rmse double")


@query("m11_tournament")
def m11(spark, sf):
    result = M.run_tournament(modeling_frame(spark, sf), _cfg(), ["mean_baseline", *_cfg().model_policy.candidates])
    return M.metrics_frame(spark, result).withColumn("is_winner", F.col("model") == result.winner)


@query("m12_winner_refit")
def m12(spark, sf):
    rows = frame(spark, sf)
    cfg = load_config({"model_policy": {"optimizer_winner": "ridge"}})
    model = M.fit_winner(rows, cfg, {"params": {"ridge": {"alpha": 10.0}}}, before="2001-01-01")
    return model.predict(rows.filter("date >= DATE '2001-01-01'"), "predicted").select("date", "segment", F.round("predicted", 6).alias("predicted"))


def _templates(rows):
    return rows.groupBy("segment").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "segment"]), F.struct("date", "campaign_version")).alias("r")).select("segment", "r.*")


@query("m13_response_terms")
def m13(spark, sf):
    cfg, rows = _cfg(), frame(spark, sf)
    model = M.fit("ridge", rows, cfg)
    terms = M.response_terms(model, cut_lineage(_templates(rows)), cfg.context_features["calendar"])
    return rounded(terms, 6, "level_at_zero", "budget_slope", "calendar_offset")


@query("m13_set_lift")
def m13b(spark, sf):
    cfg, rows = _cfg(), frame(spark, sf)
    model = M.fit("ridge", rows, cfg)
    sets = rows.select("segment", "keyword_set_id", *cfg.static_columns()).distinct()
    return rounded(M.set_lift(model, cut_lineage(_templates(rows)), sets, cfg.static_columns()), 6, "lift")


@query("m14_feature_effects")
def m14(spark, sf):
    cfg, rows = _cfg(), frame(spark, sf)
    model = M.fit("xgboost", rows, cfg)
    return rounded(M.feature_effects(model, P.usable_rows(rows, TARGET), ["daily_budget", *cfg.feature_columns()]), 6, "effect")


@query("m15_manifest")
def m15(spark, sf):
    cfg = load_config({"model_policy": {"optimizer_winner": "ridge"}})
    result = M.run_tournament(modeling_frame(spark, sf), cfg)
    path = scratch_dir(spark, "models")
    M.save_manifest(spark, path, result)
    manifest = M.load_manifest(spark, path)
    return spark.createDataFrame([(manifest["winner"], n, float(e)) for n, e in manifest["cv_rmse"].items()], "winner string, model string, rmse double")


@query("m16_evaluation_model")
def m16(spark, sf):
    cfg = load_config({"model_policy": {"optimizer_winner": "ridge"}})
    rows = frame(spark, sf)
    model, check = M.evaluation_model(rows, cfg, {"params": {"ridge": {"alpha": 10.0}}})
    return model.predict(rows, "level").groupBy("segment").agg(F.round(F.avg("level"), 6).alias("mean_level"), F.lit(float(check["holdout_rmse_levels"])).alias("holdout_rmse"))


@query("m17_fit_report")
def m17(spark, sf):
    model = M.fit("ridge", frame(spark, sf), _cfg())
    return rounded(M.ridge_terms(spark, model), 9, "value")


@query("m12_tuned_refit")
def m12t(spark, sf):
    """The planning model tuned and fitted on the rows before a day, and its levels from then on."""
    rows = frame(spark, sf)
    cfg = load_config({"model_policy": {"optimizer_winner": "ridge"}})
    model = M.fit_winner(rows, cfg, {}, before="2001-01-01", tune_on_slice=True)
    return model.predict(rows.filter("date >= DATE '2001-01-01'"), "predicted").select(
        "date", "segment", F.round("predicted", 6).alias("predicted"), F.lit(model.params["alpha"]).alias("alpha"))


@query("o2_model_curve")
def o2m(spark, sf):
    """Pieces of the boosted trees' response for every known set on the days after the panel."""
    from datetime import timedelta

    from bidloom.functions import calendar as CAL
    from bidloom.models.response import response_curve
    from bidloom.operators import planning as O
    from bidloom.plans.backtest import known_sets
    cfg, rows = _cfg(), frame(spark, sf)
    last = rows.agg(F.max("date")).first()[0]
    start, end = last + timedelta(days=1), last + timedelta(days=14)
    sets, features = known_sets(rows, start, cfg.static_columns())
    calendar = CAL.planning_calendar(spark, str(start), str(end), list(cfg.constraints.regional_order), cfg.start_dates, cfg.context_features["calendar"])
    wanted = O.candidate_rows(sets, features, calendar, [c for c in cfg.feature_columns() if c in rows.columns], str(start), str(end))
    curve = response_curve(M.fit("xgboost", rows, cfg), wanted, 0.0, cfg.constraints.daily_budget_cap)
    return rounded(curve.select("date", "segment", "keyword_set_id", "from_budget", "to_budget", F.col("from_level").alias("level")), 6, "level")


def _backtest(spark, sf, winner, cap):
    """Every day of the holdout window, planned by fits on the rows before it."""
    from datetime import timedelta

    from bidloom.plans.backtest import two_stage_backtest
    rows = frame(spark, sf)
    cfg = load_config({"start_dates": list(R.STARTS), "model_policy": {"optimizer_winner": winner}})
    last = rows.agg(F.max("date")).first()[0]
    start = last - timedelta(days=cfg.model_policy.validation.holdout_days - 1)
    return two_stage_backtest(rows, cfg, {"params": {"ridge": {"alpha": 10.0}}}, start, last, step=20.0, cap=cap)


@query("o10_walk_forward")
def o10(spark, sf):
    return _backtest(spark, sf, "ridge", 0).days


# --- streams -------------------------------------------------------------------------------


@query("r1_streaming_panel", """
SELECT date, campaign, region, CAST(sum(clicks) AS BIGINT) AS clicks, round(sum(cost), 6) AS cost, round(sum(all_conv), 6) AS all_conv FROM kw_day GROUP BY ALL""")
def r1(spark, sf):
    """The report arrives in the order of its days, but every 50th row comes at the end, too late for most days."""
    folder, out = scratch_dir(spark, "report-in"), scratch_dir(spark, "report-days")
    text = R.kw_raw(spark, sf).drop("feed")
    rows = text.select(*[F.col(c).cast("string").alias(c) for c in text.columns])
    last = (F.pmod(F.xxhash64(*rows.columns), F.lit(50)) == 0) | F.col("date").isNull()
    # written once, by arrival; an arrival is as many files as the cluster reads side by side, and one batch of the stream
    arrival = F.when(last, F.lit("late")).otherwise(F.concat(F.lit("y"), F.substring("date", 1, 4)))
    given, files = scratch_dir(spark, "report-rows"), spark.sparkContext.defaultParallelism
    rows.withColumn("arrival", arrival).write.partitionBy("arrival").parquet(given)
    rows = spark.read.schema(rows.schema.add("arrival", "string")).parquet(given)
    for name in sorted((r[0] for r in rows.select("arrival").distinct().collect()), key=lambda a: (a == "late", a)):
        rows.filter(F.col("arrival") == name).drop("arrival").repartition(files).write.mode("append").parquet(folder)
    stream = jobs.report_stream(spark, folder, fmt="parquet", files_per_trigger=files)
    jobs.start(jobs.streaming_campaign_days(stream), jobs.upsert_days(out), scratch_dir(spark, "ckpt")).awaitTermination()
    report = stored_table(P.clean_report(rows.drop("arrival")).select(*jobs.DAY_KEYS, "clicks", "cost", "all_conv"), "report")
    missed = cut_lineage(jobs.missed_days(spark.read.parquet(out), report))
    jobs.reconcile(out, missed, report)
    return rounded(spark.read.parquet(out).drop("month", "n_rows"), 6, "cost", "all_conv")


@query("r2_streaming_metrics", f"""WITH {COMP}, {DAILY_SQL} SELECT day AS score_date, round(pl, 6) AS pred_level_total, round(obs, 6) AS observed_total FROM dt""")
def r2(spark, sf):
    from bidloom.catalog.planning_scores import comparison
    folder, out = scratch_dir(spark, "metrics-in"), scratch_dir(spark, "metrics")
    rows = rounded(Q.daily_totals(comparison(spark, sf), TARGET), 6, "pred_level_total", "observed_total").select(
        F.trunc("day", "year").alias("y"), "day", "pred_level_total", "observed_total")
    rows.drop("y").write.parquet(f"{folder}/a")
    rows.drop("y").filter("year(day) = 2000").write.parquet(f"{folder}/b")
    stream = spark.readStream.schema(rows.drop("y").schema).option("recursiveFileLookup", True).parquet(folder)
    jobs.start(stream, jobs.append_once(out, "day"), scratch_dir(spark, "ckpt"), "append").awaitTermination()
    return spark.read.parquet(out).select(F.col("day").alias("score_date"), "pred_level_total", "observed_total")


@query("r3_streaming_state", """
WITH b AS (SELECT owner, arg_max(daily_budget, -ord) AS daily_budget FROM budget_ev GROUP BY 1), s AS (SELECT owner, arg_max(status, -ord) AS status FROM status_ev GROUP BY 1),
k AS (SELECT owner, negative, match_type, keyword, arg_max(action, -ord) AS action FROM kw_ev GROUP BY ALL),
n AS (SELECT owner, count(*) FILTER (WHERE NOT negative AND action = 'add') AS p, count(*) FILTER (WHERE negative AND action = 'add') AS m FROM k GROUP BY 1)
SELECT o.owner, b.daily_budget, s.status, CAST(coalesce(n.p, 0) AS BIGINT) AS n_keywords, CAST(coalesce(n.m, 0) AS BIGINT) AS n_negative_keywords
FROM (SELECT DISTINCT owner FROM named_ev) o LEFT JOIN b USING (owner) LEFT JOIN s USING (owner) LEFT JOIN n USING (owner)""")
def r3(spark, sf):
    acts = cut_lineage(R.change_actions(spark, sf))  # stored once: every event kind reads the log
    events = H.state_events(acts, H.read_names(acts))
    folder, out = scratch_dir(spark, "events-in"), scratch_dir(spark, "states")
    # as many files as the cluster writes side by side, whatever the number of pieces the log was read in
    events.repartition(2 * spark.sparkContext.defaultParallelism).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(folder)
    conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)
        jobs.start(jobs.streaming_campaign_state(stream), write, scratch_dir(spark, "ckpt")).awaitTermination()
    finally:
        if conf is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", conf)
    rows = spark.read.parquet(out)
    return rows.groupBy("owner").agg(F.max_by(F.struct("daily_budget", "status", "n_keywords", "n_negative_keywords"), "epoch").alias("r")).select("owner", "r.*")


@query("c7_staleness")
def c7(spark, sf):
    from bidloom.operators.candidates import outputs_current
    given, made = scratch_dir(spark, "given"), scratch_dir(spark, "made")
    R.table(spark, sf, "part").write.parquet(given)
    R.campaign_summary(spark, sf).write.parquet(made)
    state = [("made_after_input", outputs_current(spark, [given], [made])), ("input_after_made", outputs_current(spark, [made], [given])),
             ("missing_output", outputs_current(spark, [given], [made, f"{made}-absent"]))]
    return spark.createDataFrame(state, "check string, current boolean")
