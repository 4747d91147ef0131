"""Windows that belong to places, documents without ids, and windows of one hash over many partitions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from bidloom.llm import repeats


@pytest.mark.parametrize("distinct", [5, 10**9])
def test_every_window_belongs_to_one_place(distinct):
    rng = np.random.default_rng(3)
    passage, window, key = 50, 42, 8
    for n in (50, 51, 90, 300):
        keys = rng.integers(0, distinct, n - key + 1)
        at = repeats.selected_places(keys, window)
        low, high = repeats.own_windows(keys, at, passage, window)
        owned = sorted(p + r - passage for p, a, b in zip(at, low, high) for r in range(max(a, 0), b + 1) if 0 <= p + r - passage <= n - passage)
        assert owned == list(range(n - passage + 1))


def test_documents_without_ids(spark):
    rng = random.Random(8)
    shared = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    text = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))
    rows = [(None, f"{text()} {shared} {text()}"), (3, f"{text()} {text()} {shared}"), (None, text()), (5, text() + text())]
    got = repeats.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["begin"], r["end"]) for r in got} == {(None, 30, 90), (3, 60, 120)}


def test_windows_of_one_hash_over_partitions(spark):
    rows = [(7 if i % 3 else i, i, i) for i in range(400)]
    found = spark.createDataFrame([(w, d, b) for w, d, b in rows], "window long, doc_id long, begin int").repartition(9)
    spans = repeats._window_spans(found, 50).collect()
    want = {(d, b) for w, d, b in rows if sum(x[0] == w for x in rows) > 1}
    assert {(r["doc_id"], r["begin"]) for r in spans} == want and all(r["partner"] != r["doc_id"] and r["end"] == r["begin"] + 50 for r in spans)
    alone = spark.createDataFrame([(1, 2, 3)], "window long, doc_id long, begin int")
    assert repeats._window_spans(alone, 50).count() == 0


def _line_documents(n):
    """Documents around one line of 45 words, which chance words on both sides make a passage of, and copies of the first."""
    rng = random.Random(5)
    line = " ".join(f"w{i}" for i in range(45))
    side = lambda: " ".join(f"s{rng.randrange(3)}" for _ in range(4))
    far = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))
    texts = [f"{far()} {side()} {line} {side()} {far()}" for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[0]) for i in range(n)]


def test_hot_keys_meet_in_parts(spark):
    rows = _line_documents(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in repeats.find_repeats(docs, hot=5).collect()}
    assert got == {tuple(r) for r in repeats.find_repeats(docs, hot=10**9).collect()}
    words = {i: t.split() for i, t in rows}
    seen = {}
    for i, w in words.items():
        for b in range(len(w) - 49):
            seen.setdefault(tuple(w[b : b + 50]), set()).add((i, b + 50))
    want = {(i, b) for places in seen.values() if len(places) > 1 for i, e in places for b in range(e - 50, e)}
    assert {(r[0], b) for r in got for b in range(r[1], r[2])} == want
    places = repeats.suffix_places(docs, 50, 8, 42)
    counted = places.groupBy("key").count()
    often = repeats.hot_keys(counted, 5)
    spread = repeats.dealt(places, often, repeats.F.xxhash64("doc_id", "pos")).join(repeats.in_all_parts(counted, often), ["key", "part"], "left_semi")
    assert spread.count() == places.count()
    most = counted.agg({"count": "max"}).first()[0]
    assert most >= 60 and spread.groupBy("key", "part").count().agg({"count": "max"}).first()[0] < most / 3


def test_copies_are_one_row_where_ranges_are_looked_up(spark):
    words = bytes(200)
    rows = [(i, 60, 1, 10, 40, words, words, 7, i) for i in range(50)] + [(50, 60, 1, 10, 40, words[::-1], bytes([1]) * 200, 8, 50)]
    schema = "doc_id long, pos int, key long, low int, high int, right binary, left binary, words long, number long"
    ranges = spark.createDataFrame([(1, 20, 22)], "key long, `from` int, `to` int")
    often = spark.createDataFrame([(1, 4)], "key long, parts int")
    found = repeats.windows(spark.createDataFrame(rows, schema), ranges, often, 50).collect()
    assert sorted((r["doc_id"], r["begin"]) for r in found) == [(d, b) for d in (0, 50) for b in (30, 31, 32)]
