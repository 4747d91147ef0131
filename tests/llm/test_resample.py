"""Interning of spans, and importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from bidloom.llm import interning, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans_of(texts):
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends


@pytest.mark.parametrize("clash", ["none", "all", "some"])
def test_interning(clash):
    rng = random.Random(4)
    texts = [rng.randbytes(rng.choice((1, 3, 4, 7, 8, 9, 15, 16, 31, 32, 33, 400))) for _ in range(600)]
    texts = texts + texts[::-1] + [texts[0]] * 300
    data, starts, ends = spans_of(texts)
    assert interning.xxhash64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(t) for t in texts]
    assert interning.crc32(data, starts, ends).tolist() == [zlib.crc32(t) for t in texts]
    # Keys that clash make different spans meet at one place; their bytes tell them apart.
    keys = {"none": None, "all": np.zeros(len(texts), np.uint64), "some": np.array([len(t) % 5 for t in texts], np.uint64)}[clash]
    table = interning.intern_spans(data, starts, ends, 10_000, keys)
    count = Counter(texts)
    assert len(table.first) == len(count)
    for i, t in enumerate(texts):
        slot = table.slot[i]
        assert texts[table.first[slot]] == t and table.count[slot] == count[t] and table.bucket[slot] == zlib.crc32(t) % 10_000


def test_interning_nothing():
    none = np.zeros(0, np.int64)
    assert len(interning.intern_spans(np.zeros(0, np.uint8), none, none, 7).slot) == 0


def plain(rows, items, most, buckets, percent, least):
    def features(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    known = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in known for b in f), Counter(b for x in items for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, n, f in known:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return sorted([(*r, None) for r in out], key=str), [(*r, i + 1) for i, r in enumerate(drawn)]


@pytest.mark.parametrize("most,percent", [(1, 10), (3, 40)])
def test_resample(spark, corpus, monkeypatch, most, percent):
    monkeypatch.setattr(resample, "BLOCK_WORDS", 16)  # long texts go through many blocks
    docs, rows = corpus
    rows = [(r[0], r[1]) for r in rows]
    items = [rows[25][1], "stone river glass paper é 9to5", None, "", rows[91][1]]
    target = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "1 AS n", "2 AS rank", "3 AS doc_id")
    got = [tuple(r) for r in resample.resample(docs, target, percent=percent, most_words=most, buckets=997).collect()]
    want, drawn = plain(rows, items, most, 997, percent, 20)
    assert sorted(((*r[:5], None) for r in got), key=str) == want
    assert sorted((r for r in got if r[5] is not None), key=lambda r: r[5]) == drawn
    taken = resample.draw(docs, target, percent=percent, most_words=most, buckets=997)
    assert taken.columns == docs.columns and {r["doc_id"] for r in taken.collect()} == {r[0] for r in drawn}


def test_nulls_ties_and_empty_tables(spark, nothing):
    same = "a b c d e f g h i j k l m n o p q r s t u v"
    rows = [(None, same), (None, same), (5, same), (5, same), (7, None), (8, " - "), (9, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [same]
    target = spark.createDataFrame([(1, same)], "item_id long, text string")
    got = [tuple(r) for r in resample.resample(docs, target, percent=75).collect()]
    want, drawn = plain(rows, items, 1, 10_000, 75, 20)
    assert sorted(((*r[:5], None) for r in got), key=str) == want
    assert sorted((r for r in got if r[5] is not None), key=lambda r: r[5]) == drawn and len(drawn) == 3
    assert resample.resample(nothing, target).count() == 0
    bare = [tuple(r)[:5] for r in resample.resample(docs, target.filter("false")).collect()]
    assert sorted(((*r, None) for r in bare), key=str) == plain(rows, [], 1, 10_000, 10, 20)[0]


def test_text_ids(spark):
    docs = spark.createDataFrame([("x1", "one two"), ("x2", "two")], "doc_id string, text string")
    got = resample.resample(docs, docs.select("text"), least_words=1, percent=100)
    assert sorted(r["doc_id"] for r in got.collect()) == ["x1", "x2"] and {r["rank"] for r in got.collect()} == {1, 2}
