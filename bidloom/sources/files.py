"""File sinks, dated plan folders, display layout and the embedded change payload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import text as T

# Columns of a saved plan-versus-actual file.
PLAN_ACTUAL_SCHEMA = (
    "date string, period string, segment string, region string, row_kind string, daily_budget double, "
    "keyword_set_id string, pred_level double, actual_model_level double, actual_budget double, "
    "actual_keyword_set_id string, observed_conv_scaled_clicks double, observed_clicks double"
)
PLAN_SCHEMA = "segment string, region string, daily_budget double, keyword_set_id string, opt_date string"


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Header CSV with a fixed column order; parent folders are created by the writer."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``; rows gather per partition before writing."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )


def publish_panel(panel: DataFrame, summary: DataFrame, path: str, summary_path: str | None = None) -> None:
    """Panel partitioned by month, and optionally the cleaned version table."""
    write_partitions(panel.withColumn("month", F.trunc("date", "MM")), path, "month")
    if summary_path:
        summary.write.mode("overwrite").parquet(summary_path)


# --- plan folders --------------------------------------------------------------------------


def read_csv_by_name(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    """CSV files below ``root`` matched by column name, since each file may carry other columns.

    One scan reads the lines. A file's header is its first line that is not blank, whatever it holds; joined back on the path, it
    says which cell is which column. Quoted cells may hold commas, a record is one line. Columns a file lacks are NULL.
    """
    wanted = spark.createDataFrame([], schema).schema
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
        .select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))
        .withColumn("value", F.ltrim(F.col("value"), F.lit("\ufeff")))
        .filter(F.trim("value") != "")
        .withColumn("line", F.monotonically_increasing_id())
    )
    # Lines of one block come from one task in file order; the first block with lines holds the header.
    heads = lines.groupBy("source_file").agg(F.min_by("value", F.struct("block", "line")).alias("head"))
    names = F.transform(csv_cells("head"), lambda x: F.trim(x))
    rows = lines.join(heads.select("source_file", "head", names.alias("names")), "source_file").filter(F.col("value") != F.col("head"))
    rows = rows.select("source_file", "names", csv_cells("value").alias("cells"))
    at = {f.name: F.get("cells", F.array_position("names", f.name).cast("int") - 1) for f in wanted.fields}
    return rows.select(*[F.nullif(at[f.name], F.lit("")).try_cast(f.dataType).alias(f.name) for f in wanted.fields], "source_file")


def csv_cells(line: str) -> Column:
    """Cells of one CSV line, with quotes taken off."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col(line)), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(cells, lambda c: F.when(c.startswith('"') & (F.length(c) > 1), plain(c)).otherwise(c))


def collect_plan_vs_actual(spark: SparkSession, run_dir: str, glob: str = "plan_vs_actual*.csv") -> DataFrame:
    """All saved plan-versus-actual rows of a run, with day and period taken from the path."""
    df = read_csv_by_name(spark, f"{run_dir}/plans", glob, PLAN_ACTUAL_SCHEMA)
    day = F.regexp_extract("source_file", r"/(?:\w+=)?(\d{8})/[^/]*$", 1)
    weekly = F.regexp_extract("source_file", r"([^/]*)$", 1).contains("weekly")
    return df.withColumns(
        {
            "date": F.coalesce(F.col("date").try_cast("date"), F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date")),
            "period": F.coalesce("period", F.when(weekly, F.lit("week")).otherwise(F.lit("day"))),
            "source_file": F.regexp_extract("source_file", r"(plans/.*)$", 1),
        }
    )


def collect_plans(spark: SparkSession, run_dir: str, glob: str = "campaign_plan*.csv") -> DataFrame:
    """Saved plans of a run; the day is the plan's own date, else its folder's."""
    df = read_csv_by_name(spark, f"{run_dir}/plans", glob, PLAN_SCHEMA)
    day = F.regexp_extract("source_file", r"/(?:\w+=)?(\d{8})/[^/]*$", 1)
    return df.withColumn("date", F.coalesce(F.col("opt_date").try_cast("date"), F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date")))


def plan_days(plans: DataFrame) -> DataFrame:
    """Per-day plan totals: segments, planned budget, segments planned at zero."""
    budget = F.coalesce("daily_budget", F.lit(0.0))
    return plans.groupBy(F.col("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(budget).alias("opt_budget_total"),
        F.count_if(budget <= 0).alias("n_segments_zero_budget"),
    )


def evaluation_source(candidates: Sequence[DataFrame | None]) -> DataFrame | None:
    """The first available, non-empty frame: daily summary, weekly summary, then plan days."""
    for df in candidates:
        if df is not None and not df.isEmpty():
            return df
    return None


# --- display -------------------------------------------------------------------------------


def display_layout(sets: DataFrame) -> DataFrame:
    """One row per list position of a set: Broad, Phrase, Exact side by side, padded with ''."""
    lists = {mt: T.sorted_distinct(T.split_list(c)) for mt, c in T.LIST_COLUMNS.items()}
    zipped = F.arrays_zip(*[v.alias(mt) for mt, v in lists.items()])
    rows = sets.select("keyword_set_id", F.posexplode(zipped).alias("pos", "row"))
    return rows.select(
        "keyword_set_id", "pos", *[F.coalesce(F.col(f"row.{mt}"), F.lit("")).alias(mt) for mt in T.MATCH_TYPES]
    )


def display_index(candidates: DataFrame) -> DataFrame:
    source = F.col("source") if "source" in candidates.columns else F.lit("")
    return candidates.select(
        "segment", "keyword_set_id", source.alias("source"), F.concat("keyword_set_id", F.lit(".csv")).alias("display_file")
    )


def stale_displays(written: DataFrame, keep: DataFrame) -> DataFrame:
    """Ids with a written display that are no longer wanted."""
    return written.select("keyword_set_id").distinct().join(keep, "keyword_set_id", "left_anti")


def export_displays(sets: DataFrame, path: str) -> None:
    """One folder per set; a full overwrite removes displays of dropped sets."""
    display_layout(sets).repartition("keyword_set_id").sortWithinPartitions("pos").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).option("header", True).partitionBy("keyword_set_id").csv(path)


# --- change payload ------------------------------------------------------------------------

# The page assignment that holds the payload, and the payload's numbered fields.
PAYLOAD = r"(?s)change_history_data\['CHANGE_HISTORY_TABLE'\]\s*=\s*'((?:\\.|[^'])*)';"
PAYLOAD_SCHEMA = (
    "struct<`1`:array<struct<`8`:struct<`2`:string>,`9`:array<struct<`1`:string,`2`:struct<`3`:string>,"
    "`5`:array<struct<`1`:array<string>,`2`:struct<`3`:string>>>>>>>>"
)
SLASH_MARK = "\u0001"


def unescape_literal(c: Column) -> Column:
    """Value of a single-quoted script literal, through the JSON string form.

    Escaped backslashes are set aside first; hex escapes become Unicode escapes and bare double
    quotes are escaped, after which the text is a JSON string.
    """
    s = F.replace(c, F.lit("\\\\"), F.lit(SLASH_MARK))
    s = F.regexp_replace(s, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")
    s = F.regexp_replace(s, r"\\(['/])", "$1")
    s = F.regexp_replace(s, r'(?<!\\)"', r'\\"')
    s = F.replace(s, F.lit(SLASH_MARK), F.lit("\\\\"))
    return F.get_json_object(F.concat(F.lit('{"v":"'), s, F.lit('"}')), "$.v")


def payload_actions(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Change actions of saved pages: one row per action, newest first by ``order``.

    Pages are independent rows; nothing is shuffled.
    """
    literal = F.regexp_extract(html, PAYLOAD, 1)
    outer = unescape_literal(literal)
    table = F.from_json(F.get_json_object(outer, "$['2']"), PAYLOAD_SCHEMA)
    rows = pages.filter(literal != "").select(key, F.posexplode(table["1"]).alias("row_no", "row"))
    actions = rows.select(
        key, "row_no", F.coalesce(F.col("row.`8`.`2`"), F.lit("")).alias("date_text"), F.posexplode("row.`9`").alias("action_no", "a")
    )
    campaign = F.coalesce(F.col("a.`2`.`3`"), F.lit(""))
    details = F.flatten(
        F.transform(
            F.coalesce(F.col("a.`5`"), F.array().cast("array<struct<`1`:array<string>,`2`:struct<`3`:string>>>")),
            lambda d: F.transform(
                F.filter(
                    F.transform(F.coalesce(d["1"], F.array().cast("array<string>")), lambda t: T.squeeze(t)),
                    lambda t: t != "",
                ),
                lambda t: F.struct(
                    F.when(F.coalesce(d["2"]["3"], F.lit("")) != "", d["2"]["3"]).otherwise(campaign).alias("campaign"),
                    t.alias("text"),
                ),
            ),
        )
    )
    return actions.select(
        key,
        (F.col("row_no") * 1000 + F.col("action_no")).cast("bigint").alias("order"),
        "date_text",
        T.change_date("date_text").alias("date"),
        F.coalesce(F.col("a.`1`"), F.lit("")).alias("summary"),
        campaign.alias("campaign"),
        details.alias("details"),
    )
