"""Late rows, state that ends, and appends that replace, over files that arrive in several triggers."""

import datetime

from pyspark.sql import functions as F

from bidloom.operators.panel import clean_report
from bidloom.session import scratch_dir
from bidloom.streaming import jobs

DAY = datetime.date(2024, 1, 1)


def line(i, clicks, campaign="USA - Search"):
    day = DAY + datetime.timedelta(days=i)
    return (str(day), "word", campaign, "Broad", str(clicks), f"{clicks}.25", "1.5", "USD", None)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, jobs.REPORT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_left_out_counted_and_reconciled(spark):
    folder, out, marks = (scratch_dir(spark, n) for n in ("in", "out", "ckpt"))
    batches = [
        [line(i, 1) for i in range(40)],
        [line(i, 10) for i in (36, 45, 60)],  # day 36 lies within seven days of day 39
        [line(2, 100), line(2, 7, "A - Search"), line(58, 1000), line(61, 1)],  # day 2 is closed, day 58 is not
    ]
    sizes = []
    for rows in batches:
        arrive(spark, folder, rows)
        stream = jobs.report_stream(spark, folder, fmt="parquet", files_per_trigger=1)
        query = jobs.start(jobs.streaming_campaign_days(stream), jobs.upsert_days(out), marks)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    # 46 campaign-days arrived; closed ones have left the state.
    assert sizes[-1] < 20, sizes

    report = clean_report(spark.read.schema(jobs.REPORT_SCHEMA).parquet(folder))
    streamed = {(r["date"], r["campaign"]): r["clicks"] for r in spark.read.parquet(out).collect()}
    at = lambda i: DAY + datetime.timedelta(days=i)
    assert streamed[at(36), "USA - Search"] == 11 and streamed[at(58), "USA - Search"] == 1000
    assert streamed[at(2), "USA - Search"] == 1 and (at(2), "A - Search") not in streamed
    missed = jobs.missed_days(spark.read.parquet(out), report)
    assert sorted((r["date"], r["campaign"], r["n_missed"]) for r in missed.collect()) == [(at(2), "A - Search", 1), (at(2), "USA - Search", 1)]
    want = report.groupBy(*jobs.DAY_KEYS).agg(F.sum("clicks"), F.sum("cost"), F.sum("all_conv"), F.count("*")).collect()
    for _ in range(2):  # a second run changes nothing
        jobs.reconcile(out, missed, report)
        got = spark.read.parquet(out).select(*jobs.DAY_KEYS, "clicks", "cost", "all_conv", "n_rows").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        missed = jobs.missed_days(spark.read.parquet(out), report)
    assert missed.count() == 0


def test_days_are_appended_once(spark):
    out = scratch_dir(spark, "metrics")
    write = jobs.append_once(out, "day")
    rows = lambda *v: spark.createDataFrame([(DAY + datetime.timedelta(days=i), x, y) for i, x, y in v], "day date, x double, y double")
    write(rows((0, 1.0, 2.0), (0, 1.0, 5.0), (40, 3.0, 1.0)), 0)
    write(rows((0, 1.0, 2.0), (0, 1.0, 5.0), (40, 3.0, 1.0)), 0)  # retried
    write(rows((40, 2.0, 9.0), (41, 0.0, 0.0)), 1)
    got = sorted((r["day"].day, r["x"], r["y"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1.0, 5.0), (10, 2.0, 9.0), (11, 0.0, 0.0)]


def test_newest_rows_keep_what_counts():
    import pandas as pd

    from bidloom.streaming.jobs import newest_rows
    rows = pd.DataFrame(
        [(5, "1", None, None, None, None, None), (7, "2", None, None, None, None, None), (7, "3", None, None, None, None, None), (6, None, "active", None, None, None, None),
         (1, None, None, False, "Exact", "w", "add"), (4, None, None, False, "Exact", "w", "remove"), (9, None, None, True, "Exact", "w", "add")],
        columns=["tick", "set_budget", "set_status", "negative", "match_type", "keyword", "action"])
    left = newest_rows(rows)
    assert sorted(left["tick"]) == [4, 6, 7, 9]
    assert left[left["set_budget"].notna()]["set_budget"].tolist() == ["3"]
