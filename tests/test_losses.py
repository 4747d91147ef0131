"""Rows that must not vanish: NULL keys and days, wide or foreign plan files, many sets, reused names."""

import datetime

import pytest
from pyspark.sql import functions as F

from bidloom.functions import grouped as G
from bidloom.models import fit as M
from bidloom.operators import history as H
from bidloom.operators import joins as J
from bidloom.operators import panel as P
from bidloom.sources import files


def test_null_keys_scores_and_days_stay(spark):
    rows = [("a", 1.0, 1), (None, 2.0, 2), (None, 3.0, 3), ("a", None, 4)]
    ranked = G.with_rank(spark.createDataFrame(rows, "g string, v double, i int"), ["g"], "v", "r").collect()
    assert {r.i: r.r for r in ranked} == {1: 1, 2: 2, 3: 1, 4: None}
    day = datetime.date(2024, 1, 1)
    rows = [(None, None, 1, "x"), (None, day, 2, None), ("a", None, 3, "y"), ("a", day, 4, None), ("a", day, 5, "z")]
    df = spark.createDataFrame(rows, "g string, d date, i int, v string")
    assert {r.i: r.x for r in G.carry(df, ["g"], "d", ["i"], {"x": "v"}).collect()} == {1: "x", 2: "x", 3: "y", 4: "y", 5: "z"}
    assert {r.i: r.x for r in G.following(df, ["g"], "d", ["i"], "i", "x").collect()} == {1: 2, 2: None, 3: 4, 4: 5, 5: None}
    probes = df.select("g", "d", "i")
    history = spark.createDataFrame([("a", day, 1, "h")], "g string, d date, o int, h string")
    assert {r.i: r.h for r in J.asof_backward(probes, history, ["g"], "d", ["o"], ["h"]).collect()} == {1: None, 2: None, 3: None, 4: "h", 5: "h"}


def test_plan_files_of_any_width_and_header(spark, tmp_path):
    wide = [f"x{i}" for i in range(70)]
    (tmp_path / "a.csv").write_text("note,segment,daily_budget\n\"a, \"\"b\"\"\",s1,1.5\nn,s2,\n")
    (tmp_path / "b.csv").write_text(",".join([*wide, "segment", '"daily_budget"']) + "\n" + ",".join([*["v"] * 70, '"s, 3"', "7"]) + "\n")
    (tmp_path / "c.csv").write_text("segment\ns4\n")
    got = files.read_csv_by_name(spark, str(tmp_path), "*.csv", "segment string, daily_budget double").collect()
    assert sorted((r.segment, r.daily_budget) for r in got) == [("s, 3", 7.0), ("s1", 1.5), ("s2", None), ("s4", None)]


def names(spark, rows):
    return spark.createDataFrame([(o, None, a, b) for o, a, b in rows], "`order` long, date date, previous_name string, current_name string")


def name_then(spark, moves, campaign, order):
    spans = H.name_intervals(names(spark, moves)).filter(F.col("campaign") == campaign).collect()
    return next((s.name for s in spans if order > s.newer and (s.older is None or order <= s.older)), campaign)


def test_reused_and_returned_names(spark):
    moves = [(5, "B", "A"), (7, "D", "B"), (8, "E", "B")]
    assert [name_then(spark, moves, "A", o) for o in (5, 6, 8, 9)] == ["A", "B", "D", "D"]
    back = [(9, "A", "B"), (4, "B", "A")]  # from A to B, later back to A
    assert [name_then(spark, back, "A", o) for o in (3, 5, 10)] == ["A", "B", "A"]
    assert {r.campaign: r.canonical for r in H.canonical_names(names(spark, back)).collect()} == {"A": "A", "B": "A"}
    long = [(200 - i, f"n{i}", f"n{i + 1}") for i in range(150)]
    assert name_then(spark, long, "n150", 1000) == "n0"


def test_ten_thousand_sets_keep_their_ids(spark):
    lists = {c: F.lit("") for c in H.LIST_FIELDS}
    versions = spark.range(1, 10_012).select(F.col("id").cast("int").alias("campaign_version")).withColumns(lists)
    versions = versions.withColumn("broad_keywords", F.concat(F.lit("w"), F.col("campaign_version")))
    keyed, sets = H.assign_set_ids(versions)
    assert keyed.select("keyword_set_id").distinct().count() == 10_011
    assert {r.keyword_set_id for r in keyed.filter("campaign_version in (7, 1000, 10000)").collect()} == {"ks_0007", "ks_1000", "ks_10000"}


def test_unreadable_dates_stop_the_job(spark):
    report = spark.createDataFrame([("soon", "k", "c", "EXACT", 1, 1.0)], "date string, keyword string, campaign string, match_type string, clicks int, cost double")
    with pytest.raises(Exception, match="unreadable date"):
        P.clean_report(report).collect()
    assert P.clean_report(report.withColumn("date", F.lit(" "))).first().date is None


def test_zero_is_a_metric():
    from bidloom.config import Config

    assert M._first_known(0.0, 5.0) == 0.0 and M._first_known(None, 0.0) == 0.0
    assert Config is not None
