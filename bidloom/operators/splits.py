"""Holdout, expanding-window folds, recency weights and calendar windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.config import Validation


def holdout_flag(df: DataFrame, holdout_days: int, date: str = "date") -> DataFrame:
    """Flag rows later than the last date minus the holdout days."""
    last = df.agg(F.max(date)).scalar()
    return df.withColumn("is_holdout", F.col(date) > F.date_sub(last, holdout_days))


def train_holdout(df: DataFrame, holdout_days: int, date: str = "date") -> tuple[DataFrame, DataFrame]:
    flagged = holdout_flag(df, holdout_days, date)
    return flagged.filter(~F.col("is_holdout")).drop("is_holdout"), flagged.filter("is_holdout").drop("is_holdout")


def refit_rows(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """All rows for the final fit."""
    return train.unionByName(holdout)


def _days(df: DataFrame, date: str) -> DataFrame:
    """Distinct days with row counts and positions; one row per calendar day."""
    whole = Window.partitionBy()
    return (
        df.groupBy(F.col(date).alias("date"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("idx", F.row_number().over(whole.orderBy("date")) - 1)
        .withColumn("n_dates", F.count(F.lit(1)).over(whole))
    )


def fold_days(df: DataFrame, v: Validation = Validation(), date: str = "date") -> DataFrame:
    """(fold, role, date): expanding training days and the validation days that follow.

    Fold bounds are arithmetic on the day position. Folds that miss a day or row floor are dropped
    and the rest renumbered from 1; too short a panel gives no rows.
    """
    days = _days(df, date)
    n = F.col("n_dates")
    floor = F.greatest(F.lit(max(0, v.min_train_days)), F.ceil(n * F.lit(float(v.min_train_fraction))))
    sized = (
        days.withColumn("min_train", floor.cast("int"))
        .filter(n >= F.col("min_train") + v.min_val_days)
        .withColumn("usable", n - F.col("min_train"))
        .withColumn("n_val", F.greatest(F.lit(v.min_val_days), F.floor(F.col("usable") / max(v.cv_folds, 1))))
        .withColumn("n_eff", F.least(F.lit(v.cv_folds), F.greatest(F.lit(1), F.floor(F.col("usable") / F.col("n_val")))))
    )
    slots = sized.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(v.cv_folds, 1) - 1)))).filter("slot < n_eff")
    end = F.col("min_train") + F.col("slot") * F.col("n_val") - 1
    val_end = F.least(end + F.col("n_val"), n - 1)
    role = F.when(F.col("idx") <= end, F.lit("train")).when(F.col("idx") <= val_end, F.lit("val"))
    placed = slots.withColumn("role", role).filter(F.col("role").isNotNull())
    passing = (
        placed.groupBy("slot").agg(
            F.count_if(F.col("role") == "train").alias("train_days"),
            F.count_if(F.col("role") == "val").alias("val_days"),
            F.sum(F.when(F.col("role") == "train", F.col("n_rows")).otherwise(0)).alias("train_rows"),
            F.sum(F.when(F.col("role") == "val", F.col("n_rows")).otherwise(0)).alias("val_rows"),
            F.first("min_train").alias("min_train"),
        )
        .filter(
            (F.col("train_days") >= F.col("min_train"))
            & (F.col("val_days") >= v.min_val_days)
            & (F.col("train_rows") >= v.min_train_rows)
            & (F.col("val_rows") >= v.min_val_rows)
        )
        .select("slot", F.row_number().over(Window.partitionBy().orderBy("slot")).alias("fold"))
    )
    return placed.join(passing, "slot").select("fold", "role", "date")


def fallback_days(df: DataFrame, date: str = "date") -> DataFrame:
    """Single fold: days up to position int(0.8 n) train, later days validate."""
    cut = F.floor(F.col("n_dates") * 0.8)
    role = F.when(F.col("idx") <= cut, F.lit("train")).otherwise(F.lit("val"))
    return _days(df, date).select(F.lit(1).alias("fold"), role.alias("role"), "date")


def fold_rows(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows with their fold and role; a row appears once per fold that uses its day."""
    return df.join(days, "date")


def fold_schedule(rows: DataFrame) -> DataFrame:
    """Date span, days and rows of each fold part."""
    return rows.groupBy("fold", "role").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("date").alias("n_days"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def recency_weights(df: DataFrame, half_life_days: float | None, date: str = "date", name: str = "weight") -> DataFrame:
    """exp(-age / half life) scaled to mean 1; weight 1 without a half life.

    The mean is a combined aggregate, not a window over the whole frame.
    """
    if half_life_days is None or half_life_days <= 0:
        return df.withColumn(name, F.lit(1.0))
    last = df.agg(F.max(date)).scalar()
    raw = F.exp(-F.datediff(last, F.col(date)) / F.lit(float(half_life_days)))
    weighed = df.withColumn("_w", raw)
    return weighed.withColumn(name, F.col("_w") / weighed.agg(F.avg("_w")).scalar()).drop("_w")


def walk_forward_totals(df: DataFrame, target: str, date: str = "date") -> DataFrame:
    """Rows and target available before each day, as a running total over day sums."""
    before = Window.partitionBy().orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    daily = df.groupBy(F.col(date).alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("y"))
    return daily.select(
        "date",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum("y").over(before), F.lit(0.0)).alias("train_target"),
    )


def rolling_means(daily: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Means of bias, nRMSE and RMSE over the last n scored rows, per scored day and window."""
    columns = {"total_bias_pct": "mean_bias_pct", "nrmse": "mean_nrmse", "rmse_pred_vs_observed": "mean_rmse"}
    out = None
    for n in windows:
        w = Window.partitionBy().orderBy("score_date").rowsBetween(-(n - 1), 0)
        part = daily.select(
            "score_date",
            F.lit(n).alias("window"),
            F.count(F.lit(1)).over(w).alias("n_days"),
            *[F.avg(F.col(c).try_cast("double")).over(w).alias(name) for c, name in columns.items()],
        )
        out = part if out is None else out.unionByName(part)
    return out


def rolling_summary(daily: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """The rolling means as of the last scored day."""
    means = rolling_means(daily.filter(F.col("score_date").isNotNull()), windows)
    return means.groupBy("window").agg(F.max_by(F.struct(*means.columns), "score_date").alias("r")).select("r.*")


def day_range(spark: SparkSession, start: str | Column, end: str | Column, name: str = "date") -> DataFrame:
    lo = F.to_date(F.lit(start)) if isinstance(start, str) else start
    hi = F.to_date(F.lit(end)) if isinstance(end, str) else end
    return spark.range(1).select(F.explode(F.sequence(lo, hi)).alias(name))


def missing_days(spark: SparkSession, start: str, end: str, observed: DataFrame, name: str = "date") -> DataFrame:
    """Days of the window without an observation."""
    return day_range(spark, start, end, name).join(observed.select(name).distinct(), name, "left_anti")


def missing_days_of(start: str, end: str, observed: DataFrame, keys: list[str], name: str = "date") -> DataFrame:
    """(keys, day) of the window's days without an observation of each key; the days are listed inside the keys' rows."""
    window = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    seen = observed.groupBy(*keys).agg(F.collect_set(name).alias("_seen"))
    return seen.select(*keys, F.explode(F.array_except(window, "_seen")).alias(name))


def week_starts(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Mondays inside the window, plus the opening day when it is not a Monday."""
    day = F.date_trunc("week", F.col("date")).cast("date")
    opening = F.to_date(F.lit(start))
    return day_range(spark, start, end).select(F.greatest(day, opening).alias("week_start")).distinct()


def week_dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(week_start, date): the seven days from each week start, clipped to the window."""
    starts = week_starts(spark, start, end)
    last = F.least(F.date_add("week_start", 6), F.to_date(F.lit(end)))
    return starts.select("week_start", F.explode(F.sequence(F.col("week_start"), last)).alias("date"))
