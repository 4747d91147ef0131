import datetime
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from bidloom.functions import grouped as G
from bidloom.operators import joins as J


def sample(seed=1, n=400):
    rnd = random.Random(seed)
    # one hot group with a third or more of all rows, many ties, negatives and zeros
    return [(rnd.choice("hhhab"), float(rnd.choice([0, 0, rnd.gauss(0, 5), rnd.random() * 1e6, -2.5])), i) for i in range(n)]


def test_rank_matches_pandas(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "g string, v double, i long")
    pdf = pd.DataFrame(rows, columns=["g", "v", "i"])
    for down in (True, False):
        got = {r.i: r.r for r in G.with_rank(df, ["g"], "v", "r", down).collect()}
        want = pdf.groupby("g")["v"].rank(method="min", ascending=not down).astype(int)
        assert got == dict(zip(pdf["i"], want))


def test_percentile_matches_numpy(spark):
    rows = sample(2)
    df = spark.createDataFrame(rows, "g string, v double, i long")
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r.g: r.p for r in G.percentile(df, ["g"], "v", q, "p").collect()}
        for g, vals in pd.DataFrame(rows, columns=["g", "v", "i"]).groupby("g")["v"]:
            assert np.isclose(got[g], np.percentile(vals, q * 100))


def test_carry_and_following(spark):
    rnd = random.Random(3)
    day = datetime.date(2024, 1, 1)
    rows = [(rnd.choice("hha"), day + datetime.timedelta(days=rnd.randrange(6)), i, rnd.choice([None, None, str(i)])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, d date, i long, v string")
    fwd = {r.i: r.x for r in G.carry(df, ["g"], "d", ["i"], {"x": "v"}).collect()}
    bwd = {r.i: r.x for r in G.carry(df, ["g"], "d", ["i"], {"x": "v"}, backward=True).collect()}
    nxt = {r.i: r.x for r in G.following(df, ["g"], "d", ["i"], "i", "x").collect()}
    for g in "ha":
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        last = None
        for pos, r in enumerate(ordered):
            last = r[3] or last
            assert fwd[r[2]] == last
            assert nxt[r[2]] == (ordered[pos + 1][2] if pos + 1 < len(ordered) else None)
        last = None
        for r in reversed(ordered):
            last = r[3] or last
            assert bwd[r[2]] == last


def test_number_rows(spark):
    words = [(w,) for w in ("b", "ab", "aa", "c", "ca", "b1")]
    got = G.number_rows(spark.createDataFrame(words, "w string"), [], F.substring("w", 1, 1), [F.col("w")], "n").collect()
    assert {r.w: r.n for r in got} == {w: i + 1 for i, w in enumerate(sorted(x for (x,) in words))}


def test_interval_join_half_open(spark):
    d = lambda m, n: datetime.date(2024, m, n)
    facts = spark.createDataFrame([("c", d(1, 1)), ("c", d(2, 10)), ("c", d(3, 1)), ("x", d(3, 1))], "k string, date date")
    dims = spark.createDataFrame([("c", "v1", d(1, 1), d(2, 10)), ("c", "v2", d(2, 10), None), ("c", "v3", d(3, 1), d(3, 1)), ("c", "v4", d(2, 1), d(4, 1))],
                                 "k string, v string, start_date date, end_date date")
    got = sorted((r.date, r.v) for r in J.interval_join(facts, dims, ["k"]).collect())
    assert got == [(d(1, 1), "v1"), (d(2, 10), "v2"), (d(2, 10), "v4"), (d(3, 1), "v2"), (d(3, 1), "v4")]


def test_override_merge(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ext = spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    assert sorted(map(tuple, J.override_merge(base, ext, "id").collect())) == [("a", 1), ("b", 9), ("c", 3)]
