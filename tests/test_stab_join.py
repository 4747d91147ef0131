"""Spans met through the interval tree against all pairs, and the keys they meet on."""

import random

import pytest
from pyspark.sql import functions as F

from bidloom.operators.joins import stab_join


def drawn(seed, wide):
    rng = random.Random(seed)
    points = [(rng.choice("aaab") if rng.random() > 0.05 else None, i, rng.randrange(wide) - wide // 3) for i in range(150)] + [("a", 150, None)]
    spans = []
    for i in range(120):
        low = rng.randrange(-wide // 2, wide)
        high = rng.choice((None, low, low + 1, low + rng.randrange(wide), low + rng.randrange(5)))
        spans.append((rng.choice("aab"), i, low, high))
    return points, spans + [("a", 120, -10 * wide, 10 * wide)]


@pytest.mark.parametrize("seed,wide,bits,parts", [(1, 50, 14, 64), (2, 10**12, 14, 64), (3, 10**6, 4, 1), (4, 300, 3, 64), (5, 1, 14, 64), (6, 10**15, 10, 4)])
def test_pairs_equal_all_pairs(spark, seed, wide, bits, parts):
    points, spans = drawn(seed, wide)
    left = spark.createDataFrame(points, "owner string, p int, at long")
    right = spark.createDataFrame(spans, "owner string, s int, low long, high long")
    got = [(r["p"], r["s"]) for r in stab_join(left, right, ["owner"], "at", "low", "high", bits, parts).collect()]
    want = {(p, s) for o, p, at in points for w, s, low, high in spans if o is not None and o == w and at is not None and low <= at and (high is None or at < high)}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_owner_meets_in_many_places(spark):
    left = spark.range(4000).selectExpr("'a' AS owner", "id AS at")
    right = spark.createDataFrame([("a", 0, None), ("a", 10, 3000)], "owner string, low long, high long")
    met = stab_join(left, right, ["owner"], "at", "low", "high")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_node" in plan and met.count() == 4000 + 2990
    # A span over everything is listed once for each of the largest nodes.
    held = met.groupBy("low", "high").agg(F.count("*").alias("n")).collect()
    assert {(r["low"], r["n"]) for r in held} == {(0, 4000), (10, 2990)}


def test_nothing_to_meet(spark):
    left = spark.createDataFrame([], "owner string, at long")
    right = spark.createDataFrame([("a", 0, None)], "owner string, low long, high long")
    assert stab_join(left, right, ["owner"], "at", "low", "high").count() == 0
