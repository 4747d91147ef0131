"""Stream jobs over arriving report files and change events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from bidloom.functions.grouped import exact_sum
from bidloom.operators.panel import clean_report
from bidloom.session import cut_lineage

REPORT_SCHEMA = (
    "date string, keyword string, campaign string, match_type string, clicks string, cost string, "
    "all_conv string, currency_code string, first_page_cpc string"
)
EVENT_SCHEMA = "tick long, date date, owner string, set_budget string, set_status string, negative boolean, match_type string, keyword string, action string"
STATE_SCHEMA = "owner string, tick long, daily_budget string, status string, n_keywords long, n_negative_keywords long"


def report_stream(spark: SparkSession, folder: str, schema: str = REPORT_SCHEMA, fmt: str = "csv", files_per_trigger: int = 1000) -> DataFrame:
    """Arriving report files as cleaned rows."""
    raw = (
        spark.readStream.format(fmt).schema(schema).option("header", True)
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return clean_report(raw)


def streaming_campaign_days(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Campaign-day totals that follow the report as it arrives.

    Rows up to ``late`` behind the newest day update their day, and state holds one small row per campaign-day
    that is still open. Older rows are left out here: :func:`missed_days` finds the days they belong to and
    :func:`reconcile` puts the batch totals there. ``n_rows`` counts the rows that were taken.
    """
    stamped = rows.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    whole = F.rint(F.col("cost") * 1000000).cast("bigint")
    return (
        stamped.groupBy(F.window("ts", "1 day").alias("w"), "campaign", "region")
        .agg(
            F.sum("clicks").alias("clicks"),
            (F.sum(whole) / F.lit(1000000.0)).alias("cost"),
            (F.sum(F.rint(F.col("all_conv") * 1000000).cast("bigint")) / F.lit(1000000.0)).alias("all_conv"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .select(F.col("w.start").cast("date").alias("date"), "campaign", "region", "clicks", "cost", "all_conv", "n_rows")
    )


DAY_KEYS = ("date", "campaign", "region")


def missed_days(streamed: DataFrame, report: DataFrame) -> DataFrame:
    """(date, campaign, region, n_missed): campaign-days of the clean report of which the stream left out rows."""
    counts = report.filter("date IS NOT NULL").groupBy(*DAY_KEYS).agg(F.count(F.lit(1)).alias("n_missed"))
    taken = streamed.select(*DAY_KEYS, (-F.col("n_rows")).alias("n_missed"))
    return counts.unionByName(taken).groupBy(*DAY_KEYS).agg(F.sum("n_missed").alias("n_missed")).filter("n_missed > 0")


def reconcile(path: str, missed: DataFrame, report: DataFrame) -> None:
    """Put the batch totals of the missed campaign-days in place; running it again changes nothing."""
    renamed = missed.select(*[F.col(k).alias(f"_{k}") for k in DAY_KEYS])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in DAY_KEYS]
    rows = report.join(renamed, same, "left_semi")
    totals = rows.groupBy(*DAY_KEYS).agg(
        F.sum("clicks").alias("clicks"), exact_sum(F.col("cost")).alias("cost"), exact_sum(F.col("all_conv")).alias("all_conv"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    upsert_days(path)(cut_lineage(totals), -1)


def upsert_days(path: str, keys: tuple[str, ...] = DAY_KEYS, date: str = "date") -> Callable[[DataFrame, int], None]:
    """Batch writer that replaces the month partitions an update touches.

    A retried batch rewrites the same rows, so the table is the same after a failure.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("month", F.trunc(date, "MM"))
        months = fresh.select("month").distinct()
        try:
            current = spark.read.parquet(path)
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
            current = None
        if current is not None:
            same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
            kept = current.join(months, "month", "left_semi").alias("c").join(fresh.alias("f"), same, "left_anti")
            # read and written in one folder: settle the merged rows first
            fresh = cut_lineage(fresh.unionByName(kept.select(*fresh.columns)))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)

    return write


def append_once(path: str, key: str = "score_date") -> Callable[[DataFrame, int], None]:
    """Batch writer for daily metrics: a day's row is replaced, never doubled.

    Of several rows of a day the greatest by their columns in order stays, whatever the partitioning.
    """
    writer = upsert_days(path, (key,), key)

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c != key]
        rows = batch.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*").select(*batch.columns)
        writer(rows, epoch)

    return write


def start(df: DataFrame, writer: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process everything available, then stop; the next run continues from the checkpoint."""
    return (
        df.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def newest_rows(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of a piece that can count: the newest of all, of each value and of each word; the later one among equal ticks."""
    part = part.sort_values("tick", kind="stable")
    words = part[part["keyword"].notna()].drop_duplicates(["negative", "match_type", "keyword"], keep="last")
    values = [part[part[c].notna()].tail(1) for c in ("set_budget", "set_status")]
    return part[part.index.isin(pd.concat([words, *values, part.tail(1)]).index)]


class CampaignState(StatefulProcessor):
    """Current budget, status and active keywords of one campaign.

    Budget and status are single values with the tick they were set at. Keywords live in a map state
    keyed by (sign, match type, keyword), so a large campaign is never held as one object, and an
    older event never overrides a newer one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "tick long, budget_tick long, daily_budget string, status_tick long, status string")
        self.counts = handle.getValueState("counts", "positive long, negative long")
        self.words = handle.getMapState("words", "negative boolean, match_type string, keyword string", "tick long, active boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        tick, b_tick, budget, s_tick, status = self.latest.get() if self.latest.exists() else (None, None, None, None, None)
        plus, minus = self.counts.get() if self.counts.exists() else (0, 0)
        # The newest row of each value and word of the batch is all that can count, so state is read once for each of them.
        batch = pd.concat([newest_rows(part) for part in rows]).sort_values("tick", kind="stable")
        newest = int(batch["tick"].iloc[-1])
        tick = newest if tick is None else max(tick, newest)
        budgets, statuses = batch[batch["set_budget"].notna()], batch[batch["set_status"].notna()]
        if len(budgets) and (b_tick is None or budgets["tick"].iloc[-1] >= b_tick):
            b_tick, budget = int(budgets["tick"].iloc[-1]), budgets["set_budget"].iloc[-1]
        if len(statuses) and (s_tick is None or statuses["tick"].iloc[-1] >= s_tick):
            s_tick, status = int(statuses["tick"].iloc[-1]), statuses["set_status"].iloc[-1]
        changes = batch[batch["keyword"].notna()].drop_duplicates(["negative", "match_type", "keyword"], keep="last")
        for negative, match_type, keyword, at, action in changes[["negative", "match_type", "keyword", "tick", "action"]].itertuples(index=False):
            word = (bool(negative), match_type, keyword)
            old = self.words.getValue(word) if self.words.containsKey(word) else None
            if old is None or at >= old[0]:
                active = action == "add"
                change = int(active) - int(bool(old[1]) if old is not None else False)
                if word[0]:
                    minus += change
                else:
                    plus += change
                self.words.updateValue(word, (int(at), active))
        self.latest.update((tick, b_tick, budget, s_tick, status))
        self.counts.update((plus, minus))
        yield pd.DataFrame(
            {"owner": [key[0]], "tick": [tick], "daily_budget": [budget], "status": [status], "n_keywords": [plus], "n_negative_keywords": [minus]}
        )

    def close(self) -> None:
        pass


def streaming_campaign_state(events: DataFrame) -> DataFrame:
    """State row per campaign and batch from the stream of change events."""
    return events.groupBy("owner").transformWithStateInPandas(
        statefulProcessor=CampaignState(), outputStructType=STATE_SCHEMA, outputMode="Update", timeMode="None"
    )
