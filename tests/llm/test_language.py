"""Language mixtures against a plain version with every set of languages, and on held-out documents."""

from __future__ import annotations

import itertools
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from bidloom.llm import language

SOUNDS = {"aa": ("ka", "to", "mi", "sun"), "bb": ("schl", "ung", "ei", "öt"), "cc": ("éa", "que", "ment", "to"), "dd": ("đa", "ngu", "yên", "mi")}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng, rows = random.Random(11), []
    for i in range(300):
        lang = rng.choice("aaaaabbcd") * 2
        text = sentence(rng, lang, rng.choice((1, 2, 5, 40, 200)))
        if i % 10 == 0:
            text += ". " + sentence(rng, "bb" if lang == "aa" else "aa", 30)
        rows.append((i, text.upper() if i % 13 == 0 else text, lang if i % 17 else None))
    odd = [None, "", " 12 -- 3!", "é", "日本語", "áb", "İstanbul ẞ", "ka " * 20_000 + sentence(rng, "cc", 4000), "\U0001d4d0"]
    rows += [(300 + i, t, "cc" if i % 2 else None) for i, t in enumerate(odd)]
    return rows + [(5, *rows[5][1:]), (None, "tomi sunka", "aa"), (None, None, None)]


def plain_grams(text):
    kind = lambda c: unicodedata.category(c)[0] in "LM"
    text = "\n" + (text or "").lower() + "\n"
    shown = [ord(c) if kind(c) else 0 for c in text]
    words = []
    for i, c in enumerate(shown):
        if c:
            words += [(c << 42) | (shown[i - 1] << 21) | shown[i + 1], c]
    mixed = language.mix64(np.array(words, np.uint64)) >> np.uint64(48) if words else []
    return Counter(int(b) for b in mixed)


def plain(rows):
    """(model, per row: all sets with their penalised likelihood) by long expectation-maximisation."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str("" if i is None else i).encode()) % 3 != 1:
            counts[lang].update(plain_grams(text))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    chance = lambda g, x: (counts[x][g] + language.SMOOTHING) / (total[x] + language.SMOOTHING * language.BUCKETS)
    worth = []
    for _, text, _ in rows:
        grams = plain_grams(text)
        p = np.array([[chance(g, x) for x in langs] for g in grams]).reshape(-1, len(langs))
        n, sets = np.array(list(grams.values()), float), {}
        for k in range(1, len(langs) + 1):
            for s in itertools.combinations(range(len(langs)), k):
                share = np.full(k, 1 / k)
                for _ in range(300 if k > 1 and len(n) else 0):
                    share = (n[:, None] * p[:, s] * share / (p[:, s] @ share)[:, None]).sum(axis=0) / n.sum()
                sets[s] = (float((n * np.log(p[:, s] @ share)).sum()) - language.PENALTY * math.log1p(n.sum()) * (k - 1), share)
        worth.append(sets)
    return langs, worth


def test_mixtures(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS shares", "'x' AS lang_pred")
    got = language.predict(frame.repartition(4)).collect()
    assert len(got) == len(rows)
    langs, worth = plain(rows)
    assert langs == sorted(SOUNDS)
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append(r)
    several = 0
    for (i, text, _), sets in zip(rows, worth):
        letters = any(unicodedata.category(c)[0] == "L" for c in text or "")
        # Rows of one id are told apart by whether they have a language.
        r = next(r for r in found[i] if (r["lang_pred"] != "und") == letters)
        assert r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 3 == 1)
        if not letters:
            assert (r["lang_pred"], r["score"], r["shares"]) == ("und", 0.0, [])
            continue
        chosen = tuple(langs.index(s["lang"]) for s in r["shares"])
        n = sum(plain_grams(text).values())
        best = max(w for w, _ in sets.values())
        assert sets[chosen][0] >= best - 2 * language.CLOSE * language.PENALTY * math.log1p(n), (i, text[:50])
        assert np.allclose([s["share"] for s in r["shares"]], sets[chosen][1], atol=0.05)
        top = max(r["shares"], key=lambda s: s["share"])
        assert (r["lang_pred"], r["score"]) == (top["lang"], top["share"]) and abs(sum(s["share"] for s in r["shares"]) - 1) < 1e-6
        several += len(chosen) > 1
    assert several >= 20


def test_held_out_accuracy(spark, rows):
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows[:300], "doc_id long, text string, lang string")).collect()}
    # Every tenth text goes on in another language for longer than many are.
    held = [(i, t, x) for i, t, x in rows[:300] if x and i % 10 and got[i]["held_out"] and len(t) >= 20]
    assert len(held) > 40 and sum(got[i]["lang_pred"] == x for i, _, x in held) >= 0.95 * len(held)


def test_language_is_no_input(spark, rows):
    """What is predicted for a held-out document does not change with its language, id of the same side or other columns."""
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    other = [r if r not in held else (r[0], r[1], "zz") for r in rows[:300]]
    one, two = (
        {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language.predict(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()}
        for x in (rows[:300], other)
    )
    assert one == two


def test_long_texts_are_gathered(monkeypatch):
    rng = random.Random(2)
    texts = [sentence(rng, "cc", 500), "", sentence(rng, "aa", 3), sentence(rng, "bb", 900)]
    column = pa.array(texts)
    for limit in (1, 1 << 9, 1 << 30):
        monkeypatch.setattr(language, "LONG", limit)
        [g] = language.grams(column)
        for i, t in enumerate(texts):
            of = slice(g.first[i], g.first[i + 1])
            counted = Counter()
            for b, n in zip(g.bucket[of].tolist(), g.count[of].tolist()):
                counted[b] += n
            assert counted == plain_grams(t)


def test_nothing_to_learn(spark, nothing):
    assert language.predict(nothing).count() == 0
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language.predict(docs).collect()] == [("und", 0.0)] * 2
