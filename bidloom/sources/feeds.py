"""Report feeds, planner exports, allowlist and embedding cache."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.functions.grouped import exact_sum, first_per_key, number_rows, with_rank

# Report key, served match types, planner column labels, month abbreviations.
REPORT_KEY = ("date", "keyword", "campaign", "match_type")
SERVED_MATCH_TYPES = ("EXACT", "PHRASE", "BROAD")
KEYWORD_LABEL = "Keyword"
SEARCHES_LABEL = "Searches:"
COMPETITION_LABEL = "Competition (indexed value)"
BID_LOW_LABEL = "Top of page bid (low range)"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
STATS_COLUMNS = ("last_month_searches", "competition_index", "bid_low")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Report CSV as text columns; types are decided by the cleaning step, not by inference."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def served(rows: DataFrame, start: str, end: str, metric: str) -> DataFrame:
    """Report rows a feed asks for: search campaigns, served match types, positive metric, date range.

    All tests are plain column predicates, so they reach a columnar scan.
    """
    return rows.filter(
        F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        & ~F.col("campaign").like("EXCLUDE%")
        & ~F.col("campaign").like("%Experiment%")
        & (F.col("channel") == "SEARCH")
        & F.col("match_type").isin(*SERVED_MATCH_TYPES)
        & (F.col(metric) > 0)
    )


def micros(c: str | Column) -> Column:
    """Micro units to currency, rounded half-even to cents."""
    return F.bround(T.col(c).cast("decimal(20,0)") / F.lit(1000000), 2).cast("double")


def conversion_totals(conversions: DataFrame, actions: Sequence[str] = ()) -> DataFrame:
    """Conversions summed per report key, over the wanted conversion actions."""
    rows = conversions.filter(F.col("action").isin(*actions)) if actions else conversions
    return (
        rows.withColumn("match_type", T.clean_match_type("match_type"))
        .groupBy(*REPORT_KEY)
        .agg(exact_sum(F.col("all_conversions")).alias("all_conv"))
    )


def merge_feeds(clicks: DataFrame, conversions: DataFrame, actions: Sequence[str] = ()) -> DataFrame:
    """One keyword-day report from the click feed and the conversion feed.

    Keys seen by one feed only get zero clicks and cost, or zero conversions.
    """
    spend = (
        clicks.withColumn("match_type", T.clean_match_type("match_type"))
        .groupBy(*REPORT_KEY)
        .agg(
            F.sum("clicks").cast("bigint").alias("clicks"),
            micros(F.sum("cost_micros")).alias("cost"),
            F.max("currency_code").alias("currency_code"),
            micros(F.max(F.when(F.col("first_page_cpc_micros") > 0, F.col("first_page_cpc_micros")))).alias("first_page_cpc"),
        )
    )
    totals = conversion_totals(conversions, actions)
    return spend.join(totals, list(REPORT_KEY), "full_outer").select(
        *REPORT_KEY,
        F.coalesce("clicks", F.lit(0)).cast("bigint").alias("clicks"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.round(F.coalesce("all_conv", F.lit(0.0)), 2).alias("all_conv"),
        F.coalesce("currency_code", F.lit("")).alias("currency_code"),
        "first_page_cpc",
    )


def latest_events(events: DataFrame, actor: str, start: str, end: str, limit: int = 10000) -> DataFrame:
    """Newest change events of one actor in a time range; a distributed top-n."""
    return (
        events.filter((F.col("actor") == actor) & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
        .orderBy(F.col("ts").desc(), F.col("event_id").desc())
        .limit(limit)
    )


# --- keyword planner -----------------------------------------------------------------------


def newest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """Path of the most recently modified file of a folder, judged by file metadata."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    row = files.select("path", "modificationTime").orderBy(F.col("modificationTime").desc(), "path").first()
    return row["path"] if row else None


def read_planner_export(spark: SparkSession, folder: str, pattern: str = "Saved Keyword* Stats*.csv") -> DataFrame | None:
    """Newest tab-separated planner export; UTF-8 first, then UTF-16."""
    path = newest_file(spark, folder, pattern)
    if path is None:
        return None
    for encoding in ("UTF-8", "UTF-16"):
        # multi-line parsing decodes the whole file, which two-byte encodings need
        reader = spark.read.option("header", True).option("sep", "\t").option("encoding", encoding)
        df = reader.option("multiLine", encoding != "UTF-8").csv(path)
        df = df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])
        if KEYWORD_LABEL in df.columns:
            return df.withColumn("row_no", F.monotonically_increasing_id())
    return None


def latest_searches_column(columns: Sequence[str]) -> str | None:
    """The searches column of the latest month by (year, month), later position on a tie."""

    def age(item: tuple[int, str]) -> tuple[int, int, int]:
        position, label = item
        hit = re.search(r"([A-Za-z]{3})?[A-Za-z]*\s*(\d{4})$", label)
        if not hit:
            return (0, 0, position)
        month = (hit.group(1) or "").title()
        return (int(hit.group(2)), MONTHS.index(month) + 1 if month in MONTHS else 0, position)

    found = [(i, c) for i, c in enumerate(columns) if c.startswith(SEARCHES_LABEL)]
    return max(found, key=age)[1] if found else None


def tidy_planner_stats(wide: DataFrame, row_order: str = "row_no") -> DataFrame:
    """(keyword, searches of the latest month, competition, low bid); first row per keyword wins."""

    def number(label: str | None, drop: str) -> Column:
        if label is None or label not in wide.columns:
            return F.lit(None).cast("double")
        return T.to_double(F.regexp_replace(F.col(f"`{label}`"), drop, ""))

    stats = wide.select(
        T.clean_keyword(KEYWORD_LABEL).alias("keyword"),
        number(latest_searches_column(wide.columns), ",").alias("last_month_searches"),
        number(COMPETITION_LABEL, "%").alias("competition_index"),
        number(BID_LOW_LABEL, "[$,]").alias("bid_low"),
        F.col(row_order).alias("_row"),
    )
    return first_per_key(stats, ["keyword"], ["_row"]).drop("_row")


# --- allowlist and embeddings --------------------------------------------------------------


def ordered_allowlist(rows: DataFrame) -> DataFrame:
    """(keyword, priority) from (keyword, enrollments, row_no) rows.

    Most enrollments first, then text, when any enrollment is positive; file order otherwise.
    Repeated keywords keep their best place.
    """
    cleaned = rows.select(
        T.clean_keyword("keyword").alias("keyword"),
        F.coalesce(T.to_double(F.replace(F.col("enrollments").cast("string"), F.lit(","), F.lit(""))), F.lit(0.0)).alias("enrollments"),
        F.col("row_no").cast("double").alias("row_no"),
    ).filter("keyword <> ''")
    ranked = cleaned.agg(F.max("enrollments") > 0).scalar()
    places = cleaned.groupBy("keyword").agg(
        F.max("enrollments").alias("enrollments"), F.min("row_no").alias("row_no")
    ).withColumn("score", F.when(ranked, F.col("enrollments")).otherwise(-F.col("row_no")))
    best = with_rank(places, [], "score", "rank")
    within = number_rows(best, ["rank"], F.substring("keyword", 1, 2), [F.col("keyword")], "place")
    return within.select("keyword", (F.col("rank") + F.col("place") - 1).cast("int").alias("priority"))


def cached_embeddings(requested: DataFrame, cache: DataFrame, model_name: str) -> tuple[DataFrame, DataFrame]:
    """(cached vectors of the requested keywords, requested keywords without a vector).

    ``requested`` has a ``keyword`` column; keys compare lower-cased and trimmed.
    """
    key = F.lower(T.strip("keyword"))
    wanted = requested.select(key.alias("keyword")).filter("keyword <> ''").distinct()
    known = cache.filter(F.col("model_name") == model_name).withColumn("keyword", key)
    return known.join(wanted, "keyword", "left_semi"), wanted.join(known, "keyword", "left_anti")
