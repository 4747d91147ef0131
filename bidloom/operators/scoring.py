"""Plan-versus-actual scoring, daily roll-ups, run summaries and monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.functions.grouped import first_per_key
from bidloom.operators.joins import guard_all_matched
from bidloom.operators.splits import day_range, missing_days

# Regions of the share report, prediction columns in order of preference.
REGIONS = ("USA", "A", "B")
PREDICTION_COLUMNS = ("milp_pred", "external_model_pred")


# --- actual decisions ----------------------------------------------------------------------


def smallest_mode(c: str) -> Column:
    """Most frequent value, the smallest of equals."""
    return F.mode(c, True)


def market_decisions(day_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median configured budget, most used keyword set and version per group of market rows.

    A group of one day and segment or region holds that day's campaigns only.
    """
    if "daily_budget" not in day_rows.columns:
        raise ValueError("scoring needs the configured daily_budget, not the observed cost")
    aggs = [F.median("daily_budget").alias("daily_budget"), smallest_mode("keyword_set_id").alias("keyword_set_id"),
            F.count("daily_budget").alias("_known")]
    if "campaign_version" in day_rows.columns:
        aggs.append(smallest_mode("campaign_version").alias("campaign_version"))
    out = day_rows.groupBy(*keys).agg(*aggs)
    return guard_all_matched(out, F.col("_known") > 0, "daily_budget is missing for a whole group").drop("_known")


def observed(day_rows: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    return day_rows.groupBy(*keys).agg(
        F.sum(target).alias(f"observed_{target}"), F.sum("clicks").alias("observed_clicks")
    )


def prediction_column(plan: DataFrame) -> str:
    """The preferred prediction column that holds a value."""
    present = [c for c in PREDICTION_COLUMNS if c in plan.columns]
    if present:
        counts = plan.agg(*[F.count(T.to_double(c)).alias(c) for c in present]).first()
        for c in present:
            if counts[c]:
                return c
    raise ValueError("the plan has no filled prediction column")


def with_regional_actuals(plan: DataFrame, day_rows: DataFrame, target: str, date: Sequence[str] = ("date",)) -> DataFrame:
    """Plan rows with their region's median budget, most used set and observed totals of the day."""
    keys = [*date, "region"]
    regional = day_rows if "region" in day_rows.columns else day_rows.withColumn("region", T.region_of_segment())
    decisions = market_decisions(regional, keys).select(
        *keys, F.col("daily_budget").alias("actual_budget"), F.col("keyword_set_id").alias("actual_keyword_set_id")
    )
    seen = observed(regional, target, keys)
    rows = plan if "region" in plan.columns else plan.withColumn("region", T.region_of_segment())
    return rows.join(decisions, keys, "left").join(seen, keys, "left")


def saved_plan_vs_actual(plan: DataFrame, day_rows: DataFrame, target: str) -> DataFrame:
    """Saved plans of many days against the panel, without a model: one job for all days."""
    source = prediction_column(plan)
    rows = plan.withColumns(
        {"row_kind": F.lit("plan"), "plan_pred_source": F.lit(source), "pred_level": T.to_double(source)}
    )
    return with_regional_actuals(rows, day_rows, target)


def plan_vs_actual(plan_scored: DataFrame, market_scored: DataFrame, day_rows: DataFrame, target: str) -> DataFrame:
    """Tagged union of plan rows and market rows.

    ``plan_scored`` has (date, segment, daily_budget, keyword_set_id, pred_level);
    ``market_scored`` has (date, segment, daily_budget, keyword_set_id, actual_model_level).
    """
    plan = with_regional_actuals(plan_scored.withColumn("row_kind", F.lit("plan")), day_rows, target)
    market = (
        market_scored.withColumns(
            {
                "row_kind": F.lit("market"),
                "region": T.region_of_segment(),
                "campaign_budget": F.col("daily_budget"),
                "actual_budget": F.col("daily_budget"),
                "actual_keyword_set_id": F.col("keyword_set_id"),
            }
        ).join(observed(day_rows, target, ["date", "segment"]), ["date", "segment"], "left")
    )
    return plan.unionByName(market, allowMissingColumns=True)


# --- metrics -------------------------------------------------------------------------------


def comparison_metrics(comp: DataFrame, target: str, keys: Sequence[str] = ("date",)) -> DataFrame:
    """RMSE, mean error, totals, bias percent, mean observed, nRMSE and R2 of plan rows per group."""
    obs, pred = F.col(f"observed_{target}"), F.col("pred_level")
    rows = comp.filter(F.col("row_kind") == "plan") if "row_kind" in comp.columns else comp
    rows = rows.filter(pred.isNotNull() & ~F.isnan(pred) & obs.isNotNull())
    e = pred - obs
    sums = rows.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse_pred_vs_observed"),
        F.avg(e).alias("mean_error"),
        F.sum(pred).alias("pred_total"),
        F.sum(obs).alias("observed_total"),
        F.avg(obs).alias("mean_observed_target"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(obs).alias("_var"),
        F.count(obs).alias("_n"),
    )
    total, mean = F.col("observed_total"), F.col("mean_observed_target")
    return sums.withColumns(
        {
            "total_bias_pct": F.when(total != 0, (F.col("pred_total") - total) / total * 100.0),
            "nrmse": F.when(mean != 0, F.col("rmse_pred_vs_observed") / mean),
            "r2_pred_vs_observed": F.when((F.col("_n") > 1) & (F.col("_var") > 0), 1 - F.col("_sse") / (F.col("_var") * F.col("_n"))),
        }
    ).drop("_sse", "_var", "_n")


def monitoring_rows(comp: DataFrame, target: str) -> DataFrame:
    """One monitoring row per scored day of saved plans."""
    totals = comp.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.max("plan_pred_source").alias("plan_pred_source"),
        F.sum("pred_level").alias("pred_level_total"),
        F.sum("actual_budget").alias("act_budget_total"),
    )
    metrics = comparison_metrics(comp, target)
    return totals.join(metrics, "date", "left").withColumn("target", F.lit(target)).withColumnRenamed("date", "score_date")


def daily_totals(comp: DataFrame, target: str) -> DataFrame:
    """Day roll-up of plan and market rows, taking plan rows' totals where a day has no market rows."""
    plan, market = F.col("row_kind") == "plan", F.col("row_kind") == "market"
    obs = f"observed_{target}"
    raw = comp.groupBy(F.col("date").alias("day")).agg(
        F.count_if(plan).alias("_plan"),
        F.count_if(market).alias("_market"),
        F.count(F.lit(1)).alias("_all"),
        F.sum(F.when(plan, F.col("pred_level"))).alias("_pred"),
        F.sum(F.when(market, F.col("actual_model_level"))).alias("_level_market"),
        F.sum("actual_model_level").alias("_level_all"),
        F.sum(F.when(plan, F.col("daily_budget"))).alias("_opt"),
        F.sum(F.when(market, F.col("daily_budget"))).alias("_act_market"),
        F.sum("actual_budget").alias("_act_all"),
        F.sum(F.when(market, F.col(obs))).alias("_obs_market"),
        F.sum(obs).alias("_obs_all"),
    )
    has_market = F.col("_market") > 0
    zero = F.lit(0.0)

    def either(m: str, a: str) -> Column:
        return F.coalesce(F.when(has_market, F.col(m)).otherwise(F.col(a)), zero)

    return raw.select(
        "day",
        F.when(F.col("_plan") > 0, F.col("_plan")).otherwise(F.col("_all")).alias("n_segments"),
        F.coalesce("_pred", zero).alias("pred_level_total"),
        either("_level_market", "_level_all").alias("actual_model_level_total"),
        F.coalesce("_opt", zero).alias("opt_budget_total"),
        either("_act_market", "_act_all").alias("act_budget_total"),
        either("_obs_market", "_obs_all").alias("observed_total"),
    )


def row_metrics(comp: DataFrame, target: str) -> DataFrame:
    """Backtest summary row per day: roll-up plus plan-row metrics."""
    totals = daily_totals(comp, target).withColumnsRenamed({"day": "date", "observed_total": "market_observed_total"})
    return totals.join(comparison_metrics(comp, target), "date", "left")


def weekly_scores(daily: DataFrame, target: str, weeks: DataFrame) -> DataFrame:
    """Constant weekly plan summed per segment over the scored days of its week."""
    return daily.join(weeks, "date").groupBy("week_start", "segment").agg(
        F.sum("pred_level").alias("pred_level"),
        F.sum("actual_model_level").alias("actual_model_level"),
        F.sum(f"observed_{target}").alias(f"observed_{target}"),
        F.sum("observed_clicks").alias("observed_clicks"),
        F.count("date").alias("n_days"),
    )


# --- run summaries -------------------------------------------------------------------------


def performance_summary(daily: DataFrame, target: str) -> DataFrame:
    """Model and Actual rows: mean and standard error, conversions per dollar, improvement percent."""
    days = first_per_key(daily, ["day"], ["day"])
    pairs = {"conv_m": "pred_level_total", "conv_a": "actual_model_level_total", "bud_m": "opt_budget_total", "bud_a": "act_budget_total"}
    aggs = [F.count(F.lit(1)).alias("n_days")]
    for name, c in pairs.items():
        v = T.to_double(c)
        aggs.append(F.coalesce(F.avg(v), F.lit(0.0)).alias(name))
        aggs.append(F.when(F.count(v) > 1, F.stddev_samp(v) / F.sqrt(F.count(v))).otherwise(F.lit(0.0)).alias(f"{name}_se"))
    one = days.agg(*aggs)
    per = lambda s: F.when(F.col(f"bud_{s}") > 0, F.col(f"conv_{s}") / F.col(f"bud_{s}")).otherwise(F.lit(0.0))
    gain = lambda m, a: F.when(a != 0, (m - a) / F.abs(a) * 100.0)
    none = F.lit(None).cast("double")

    def row(label: str, s: str) -> Column:
        model = s == "m"
        return F.struct(
            F.lit(label).alias("scenario"),
            F.lit(target).alias("target"),
            F.col("n_days").alias("n_days"),
            F.col(f"conv_{s}").alias("conversions"),
            F.col(f"conv_{s}_se").alias("conversions_se"),
            F.col(f"bud_{s}").alias("budget"),
            F.col(f"bud_{s}_se").alias("budget_se"),
            per(s).alias("conversions_per_dollar"),
            (gain(F.col("conv_m"), F.col("conv_a")) if model else none).alias("improvement_conversions_pct"),
            (gain(per("m"), per("a")) if model else none).alias("improvement_conversions_per_dollar_pct"),
        )

    return one.filter("n_days > 0").select(F.explode(F.array(row("Model", "m"), row("Actual", "a"))).alias("r")).select("r.*")


def regional_shares(comp: DataFrame, target: str, regions: Sequence[str] = REGIONS) -> DataFrame:
    """Regional shares of spend, predicted level and observed target for plan and market rows."""
    rows = comp if "region" in comp.columns else comp.withColumn("region", T.region_of_segment())
    level = F.when(F.col("row_kind") == "plan", F.col("pred_level")).otherwise(F.col("actual_model_level"))
    obs = F.when(F.col("row_kind") == "market", F.col(f"observed_{target}"))
    sums = rows.groupBy("row_kind", "region").agg(
        F.sum("daily_budget").alias("b"), F.sum(level).alias("l"), F.sum(obs).alias("o")
    )
    seen = sums.groupBy().agg(F.sum("o").alias("_o"), *[F.sum(F.when(F.col("region") == r, F.col("o"))).alias(f"_o_{r}") for r in regions])
    seen_row = F.struct(*[F.col(c) for c in seen.columns])
    observed_all = seen.select(seen_row).scalar()
    pick = lambda c, r: F.coalesce(F.sum(F.when(F.col("region") == r, F.col(c))), F.lit(0.0))
    whole = sums.groupBy("row_kind").agg(
        F.sum("b").alias("tb"), F.sum("l").alias("tl"),
        *[pick("b", r).alias(f"b_{r}") for r in regions], *[pick("l", r).alias(f"l_{r}") for r in regions],
    ).withColumn("_seen", observed_all)
    zero = F.lit(0.0)
    out = {"scenario": F.when(F.col("row_kind") == "plan", "Model").otherwise("Actual")}
    for r in regions:
        out[f"spend_{r}"] = F.when(F.col("tb") > 0, F.col(f"b_{r}") / F.col("tb")).otherwise(zero)
        out[f"conversions_{r}"] = F.when(F.col("tl") != 0, F.col(f"l_{r}") / F.col("tl")).otherwise(zero)
        out[f"observed_{r}"] = F.when(F.col("_seen._o") > 0, F.coalesce(F.col(f"_seen._o_{r}"), zero) / F.col("_seen._o")).otherwise(zero)
    return whole.select(*[v.alias(k) for k, v in out.items()])


def analyze_run(spark: SparkSession, comp: DataFrame, target: str, start: str, end: str) -> dict[str, DataFrame]:
    """Evaluation, summary with missing days, and regional shares of a backtest run."""
    daily = daily_totals(comp, target)
    gaps = missing_days(spark, start, end, daily.select(F.col("day").alias("date")))
    listed = gaps.groupBy().agg(
        F.count(F.lit(1)).alias("n_missing_days"),
        F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ", ").alias("missing_days"),
    )
    summary = performance_summary(daily, target).withColumn("_m", listed.select(F.struct("n_missing_days", "missing_days")).scalar())
    summary = summary.select("*", "_m.n_missing_days", "_m.missing_days").drop("_m")
    return {"evaluation_results": daily, "backtest_summary": summary, "regional_breakdown": regional_shares(comp, target)}


# --- monitoring ----------------------------------------------------------------------------


def unscored_days(spark: SparkSession, today: str, lookback: int, plans: DataFrame, metrics: DataFrame | None) -> DataFrame:
    """Days from ``lookback`` days ago to yesterday that have a plan and no metrics row yet."""
    last = F.date_sub(F.to_date(F.lit(today)), 1)
    first = F.date_sub(last, max(lookback, 1) - 1)
    days = day_range(spark, first, last).join(plans.select("date").distinct(), "date", "left_semi")
    if metrics is None:
        return days
    return days.join(metrics.select(F.col("score_date").alias("date")), "date", "left_anti")


def append_metrics(existing: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Metrics with at most one row per day: kept days win unless overwriting."""
    if overwrite:
        kept = existing.join(new.select("score_date").distinct(), "score_date", "left_anti")
        return kept.unionByName(new, allowMissingColumns=True)
    fresh = new.join(existing.select("score_date").distinct(), "score_date", "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def report_line(metrics: DataFrame) -> DataFrame:
    """One text line per scored day."""

    def number(c: str, digits: int, signed: bool = False) -> Column:
        pattern = f"%{'+' if signed else ''}.{digits}f"
        return F.when(F.col(c).isNotNull(), F.format_string(pattern, F.col(c))).otherwise(F.lit("n/a"))

    bias = F.when(F.col("total_bias_pct").isNotNull(), F.concat(number("total_bias_pct", 1, True), F.lit("%"))).otherwise(F.lit("n/a"))
    source = F.when(F.coalesce("plan_pred_source", F.lit("")) != "", F.concat(F.lit(", pred_source="), "plan_pred_source")).otherwise(F.lit(""))
    return metrics.select(
        "score_date",
        F.concat(
            F.lit("[monitoring] "), F.col("score_date").cast("string"), F.lit(": observed="), number("observed_total", 1),
            F.lit(", pred="), number("pred_total", 1), F.lit(", bias="), bias, F.lit(", RMSE="), number("rmse_pred_vs_observed", 1),
            F.lit(", nRMSE="), number("nrmse", 2), F.lit(", segments="), F.col("n_segments").cast("string"), source,
        ).alias("line"),
    )


def rolling_line(summary: DataFrame) -> DataFrame:
    """The rolling summary as one line; windows without values are left out."""
    bias = F.when(F.col("mean_bias_pct").isNotNull(), F.format_string("%+.1f%%", "mean_bias_pct")).otherwise("n/a")
    nrmse = F.when(F.col("mean_nrmse").isNotNull(), F.format_string("%.2f", "mean_nrmse")).otherwise("n/a")
    part = F.concat(F.col("window").cast("string"), F.lit("d rolling bias="), bias, F.lit(", nRMSE="), nrmse)
    shown = summary.filter("mean_bias_pct IS NOT NULL OR mean_nrmse IS NOT NULL")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("window", part.alias("p")))), lambda x: x["p"])
    return shown.groupBy().agg(parts.alias("p")).filter(F.size("p") > 0).select(
        F.concat(F.lit("[monitoring] "), F.array_join("p", "; ")).alias("line")
    )
