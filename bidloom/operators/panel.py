"""Report cleaning, campaign-day panel, rates and budget summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.functions.grouped import exact_sum
from bidloom.operators.joins import guard_all_matched, interval_join
from bidloom.session import cut_lineage

# Column order of the clean keyword-day report and its required input columns.
REPORT_COLUMNS = (
    "date", "region", "keyword", "campaign", "match_type",
    "clicks", "cost", "all_conv", "currency_code", "first_page_cpc",
)
REPORT_REQUIRED = ("date", "keyword", "campaign", "match_type", "clicks", "cost")
SUMMARY_REQUIRED = ("campaign_version", "campaign", "start_date", "end_date", "daily_budget", "match_types")


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required column(s): {', '.join(missing)}")


def readable_date(name: str, what: str) -> Column:
    """The day of a date column; blank is NULL, and text that is no date stops the job."""
    day = F.col(name).try_cast("date")
    bad = day.isNull() & (F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "")
    message = F.concat(F.lit(f"{what} has an unreadable {name}: "), F.col(name).cast("string"))
    return F.when(bad, F.raise_error(message).cast("date")).otherwise(day)


def clean_report(raw: DataFrame) -> DataFrame:
    """Canonical keyword-day rows: cleaned text, derived region, coerced numbers.

    Cleaning a clean report changes nothing. One narrow projection, no shuffle.
    """
    require_columns(raw, REPORT_REQUIRED, "keyword-day report")
    optional = {
        "all_conv": F.lit(0.0),
        "currency_code": F.lit(None).cast("string"),
        "first_page_cpc": F.lit(None).cast("double"),
    }
    df = raw.withColumns({c: v for c, v in optional.items() if c not in raw.columns})
    # cleaned first in its own projection: the region reads it several times
    df = df.withColumn("campaign", T.clean_campaign("campaign"))
    return df.select(
        readable_date("date", "keyword-day report").alias("date"),
        T.region_of_campaign("campaign").alias("region"),
        T.clean_keyword("keyword").alias("keyword"),
        "campaign",
        T.clean_match_type("match_type").alias("match_type"),
        F.coalesce(T.to_long("clicks"), F.lit(0).cast("bigint")).alias("clicks"),
        T.to_double("cost").alias("cost"),
        F.coalesce(T.to_double("all_conv"), F.lit(0.0)).alias("all_conv"),
        F.col("currency_code").cast("string").alias("currency_code"),
        T.to_double("first_page_cpc").alias("first_page_cpc"),
    )


def text_totals(raw: DataFrame) -> DataFrame:
    """Raw report rows added up by their texts: what consumers that group by text need, cleaned once per text instead of once per row.

    ``cost`` and ``all_conv`` are exact sums of the cleaned amounts. Columns that differ from row to row, ``date`` among them, are NULL.
    """
    require_columns(raw, REPORT_REQUIRED, "keyword-day report")
    summed = raw.groupBy("campaign", "match_type", "keyword").agg(
        F.sum(F.coalesce(T.to_long("clicks"), F.lit(0).cast("bigint"))).alias("clicks"),
        exact_sum(T.to_double("cost")).alias("cost"),
        exact_sum(F.coalesce(T.to_double("all_conv"), F.lit(0.0))).alias("all_conv"),
    )
    return summed.withColumn("date", F.lit(None).cast("date"))


def clean_summary(raw: DataFrame) -> DataFrame:
    """Campaign versions with typed dates and budget; an unreadable end date is open."""
    require_columns(raw, SUMMARY_REQUIRED, "campaign summary")
    return raw.withColumns(
        {
            "campaign": T.clean_campaign("campaign"),
            "start_date": readable_date("start_date", "campaign summary"),
            "end_date": F.col("end_date").try_cast("date"),
            "daily_budget": T.to_double("daily_budget"),
        }
    )


def with_region(summary: DataFrame) -> DataFrame:
    """Derive the region of a summary that does not carry one."""
    if "region" in summary.columns:
        return summary
    return summary.withColumn("region", T.region_of_campaign("campaign"))


def active_days(report: DataFrame) -> DataFrame:
    """Rows of (date, campaign) days whose total cost is positive.

    The day totals are combined before the shuffle and semi-joined back, so no task sorts a hot
    campaign the way a window sum would.
    """
    totals = (
        report.groupBy("date", "campaign")
        .agg(exact_sum(F.col("cost")).alias("_day_cost"))
        .filter(F.col("_day_cost") > 0)
        .select(F.col("date").alias("_d"), F.col("campaign").alias("_c"))
    )
    same = F.col("date").eqNullSafe(F.col("_d")) & F.col("campaign").eqNullSafe(F.col("_c"))
    return report.join(totals, same, "left_semi")


def campaign_days(report: DataFrame) -> DataFrame:
    """Clicks, cost and conversions per active (date, campaign, region).

    Rows of a day are all kept or all dropped, so the active-day test runs on the aggregate:
    one combining shuffle of the report, then a test on campaign-day rows.
    """
    from pyspark.sql import Window

    day = Window.partitionBy("date", "campaign")
    return (
        report.groupBy("date", "campaign", "region")
        .agg(
            F.sum("clicks").alias("clicks"),
            exact_sum(F.col("cost")).alias("cost"),
            exact_sum(F.col("all_conv")).alias("all_conv"),
        )
        .withColumn("_day_cost", F.sum("cost").over(day))
        .filter(F.col("_day_cost") > 0)
        .drop("_day_cost")
    )


def attach_versions(days: DataFrame, summary: DataFrame) -> DataFrame:
    """Campaign-days with every version valid that day; days without a version are dropped."""
    dim = summary.select("campaign", "campaign_version", "start_date", "end_date", "daily_budget", "match_types")
    return interval_join(days, dim, ["campaign"]).drop("start_date", "end_date")


def campaign_day_panel(report: DataFrame, summary: DataFrame) -> DataFrame:
    """The modelling panel: active campaign-days joined to their budget versions, rounded.

    The campaign-days are stored first. They are a tiny share of the report, and the version join
    reads them twice (for the last month and for the rows), so the report itself is scanned once.
    """
    days = cut_lineage(campaign_days(report))
    return attach_versions(days, summary).select(
        "date",
        "campaign_version",
        "region",
        "daily_budget",
        "match_types",
        "clicks",
        T.half_even("cost", 2).alias("cost"),
        T.half_even(F.coalesce("all_conv", F.lit(0.0)), 4).alias("all_conv"),
    )


def add_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", T.segment())


def add_match_indicator(df: DataFrame) -> DataFrame:
    """Broad-only flag; region and match types come from the segment when absent."""
    out = df
    if "match_types" not in out.columns:
        out = out.withColumn("match_types", T.match_part_of_segment())
    if "region" not in out.columns:
        out = out.withColumn("region", T.region_of_segment())
    return out.withColumn("is_broad_match", T.is_broad_only("match_types"))


# --- rates and targets ---------------------------------------------------------------------


def segment_rates(panel: DataFrame) -> DataFrame:
    """Conversions per click by (region, match_types) over the whole panel.

    A NULL input or a segment without clicks stops the job.
    """
    require_columns(panel, ("region", "match_types", "clicks", "all_conv"), "panel")
    clicks, conv = T.to_double("clicks"), T.to_double("all_conv")
    bad = F.count_if(clicks.isNull() | conv.isNull())
    rates = (
        panel.filter(F.col("region").isNotNull() & F.col("match_types").isNotNull())
        .groupBy("region", "match_types")
        .agg(F.sum(clicks).alias("seg_clicks"), exact_sum(conv).alias("seg_conv"), bad.alias("_bad"))
    )
    rates = guard_all_matched(rates, F.col("_bad") == 0, "panel has non-numeric clicks or all_conv values")
    rates = guard_all_matched(rates, F.col("seg_clicks") > 0, "rate undefined for a segment with zero clicks")
    return rates.select(
        "region", "match_types", "seg_clicks", "seg_conv",
        (F.col("seg_conv") / F.col("seg_clicks")).alias("conv_per_click"),
    )


def scaled_target(panel: DataFrame, rates: DataFrame, name: str = "conv_scaled_clicks") -> DataFrame:
    """Clicks times the fixed segment rate; segments without a rate use the mean rate.

    Without a conversions column the target is plain clicks.
    """
    clicks = F.coalesce(T.to_double("clicks"), F.lit(0.0)) if "clicks" in panel.columns else F.lit(0.0)
    out = panel.withColumn("clicks", clicks)
    if "all_conv" not in panel.columns:
        return out.withColumn(name, F.col("clicks"))
    fallback = rates.agg(F.coalesce(F.avg("conv_per_click"), F.lit(0.0))).scalar()
    rate = F.coalesce(F.col("conv_per_click"), fallback)
    return (
        out.join(rates.select("region", "match_types", "conv_per_click"), ["region", "match_types"], "left")
        .withColumn(name, F.col("clicks") * rate)
        .drop("conv_per_click")
    )


def attach_set_ids(panel: DataFrame, summary: DataFrame) -> DataFrame:
    """Keyword set of each version."""
    if "keyword_set_id" not in summary.columns:
        return panel
    pairs = summary.select("campaign_version", "keyword_set_id").distinct()
    return panel.drop("keyword_set_id").join(pairs, "campaign_version", "left")


# --- scopes --------------------------------------------------------------------------------


def training_scope(df: DataFrame, excluded: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Drop excluded regions and match-type configurations outside the allowed list."""
    out = df
    if excluded:
        out = out.filter(~T.region_of_segment().isin(*excluded))
    if allowed:
        label = F.col("match_types") if "match_types" in df.columns else T.match_part_of_segment()
        out = out.filter(label.isin(*allowed))
    return out


def lookback(df: DataFrame, days: int | None, date: str = "date") -> DataFrame:
    """Rows dated on or after the last date minus ``days``."""
    if not days or days <= 0:
        return df
    last = df.agg(F.max(date)).scalar()
    return df.filter(F.col(date) >= F.date_sub(last, days))


def before_date(df: DataFrame, day: str | Column, date: str = "date") -> DataFrame:
    """Rows strictly before the day: the walk-forward slice."""
    limit = F.to_date(F.lit(day)) if isinstance(day, str) else day
    return df.filter(F.col(date) < limit)


def usable_rows(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target, "daily_budget", "region"])


def observed_keywords(report: DataFrame, min_clicks: int = 1) -> DataFrame:
    """Distinct cleaned keywords with clicks, sorted."""
    rows = report.filter(F.col("keyword").isNotNull())
    if min_clicks > 0 and "clicks" in report.columns:
        rows = rows.filter(F.coalesce(T.to_double("clicks"), F.lit(0.0)) > 0)
    return rows.select(T.clean_keyword("keyword").alias("keyword")).filter("keyword <> ''").distinct().orderBy("keyword")


# --- budget summaries ----------------------------------------------------------------------


def budget_bounds(panel: DataFrame, segments: DataFrame, default_max: float = 500.0) -> DataFrame:
    """(0, historical maximum) per wanted segment; the default maximum without history."""
    top = panel.groupBy("segment").agg(F.max("daily_budget").alias("_max"))
    return segments.join(top, "segment", "left").select(
        "segment", F.lit(0.0).alias("budget_lo"), F.coalesce("_max", F.lit(default_max)).alias("budget_hi")
    )


def observed_min_budget(panel: DataFrame, segments: DataFrame) -> DataFrame:
    """Smallest historical budget per wanted segment, 0 without history."""
    low = panel.groupBy("segment").agg(F.min("daily_budget").alias("_min"))
    return segments.join(low, "segment", "left").select(
        "segment", F.coalesce("_min", F.lit(0.0)).alias("min_budget")
    )


def day_budget_total(panel: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Configured budget summed per day; a day whose budgets are all missing stops the job."""
    rows = panel if "region" in panel.columns else panel.withColumn("region", T.region_of_segment())
    if excluded:
        rows = rows.filter(~F.coalesce(F.col("region"), F.lit("")).isin(*excluded))
    totals = rows.groupBy("date").agg(
        exact_sum(T.to_double("daily_budget")).alias("budget_total"),
        F.count("daily_budget").alias("_known"),
    )
    return guard_all_matched(totals, F.col("_known") > 0, "daily_budget missing on a day").drop("_known")


def level_upper_bound(
    panel: DataFrame, segments: DataFrame, target: str, cap: float | None = None
) -> DataFrame:
    """1.25 times the largest target of a segment, at least 1, at most the cap."""
    top = panel.groupBy("segment").agg(F.max(F.coalesce(T.to_double(target), F.lit(0.0))).alias("_max"))
    bound = F.greatest(F.coalesce(F.col("_max"), F.lit(0.0)) * 1.25, F.lit(1.0))
    if cap is not None:
        bound = F.greatest(F.least(bound, F.lit(float(cap))), F.lit(1e-6))
    return segments.join(top, "segment", "left").select("segment", bound.alias("level_ub"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Rows, days and segments of a frame for the fit report."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("date").alias("n_days"),
        F.count_distinct("segment").alias("n_segments"),
    )
