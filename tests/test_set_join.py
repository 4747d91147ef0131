"""The set-similarity join and version changes against all pairs."""

import random

import pytest

from bidloom.operators import set_join as J


def drawn(seed):
    rng = random.Random(seed)
    words = [f"w{i:03d}" for i in range(60)]
    base = [rng.sample(words, rng.randrange(1, 20)) for _ in range(12)]
    sets = {}
    for i in range(90):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        sets[f"s{i:02d}"] = {*own, "common"} if rng.random() < 0.7 else set(own)
    return sets


@pytest.mark.parametrize("seed,least", [(1, 0.5), (2, 0.8), (3, 0.05), (4, 1.0), (5, 0.34)])
def test_pairs_equal_all_pairs(spark, seed, least):
    sets = drawn(seed)
    rows = [(s, w) for s, own in sets.items() for w in own]
    owned, contents = J.set_contents(spark.createDataFrame(rows + rows[:20], "keyword_set_id string, keyword string"))
    lead = {}
    for s in sorted(sets):
        lead.setdefault(frozenset(sets[s]), s)
    assert {r[0]: r[1] for r in owned.collect()} == {s: lead[frozenset(w)] for s, w in sets.items()}
    names = sorted(lead.values())
    want = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if shared >= least * union - 1e-9:
                want[a, b] = (shared, union)
    similar = J.similar_contents(contents, least)
    assert {(r["a"], r["b"]): (r["shared"], r["n_union"]) for r in similar.collect()} == want
    met = J.candidate_pairs(J.prefixes(contents, least), least).count()
    assert len(want) <= met <= len(names) * (len(names) - 1) // 2


def test_version_changes(spark):
    sets = [("k1", "x"), ("k1", "y"), ("k2", "y"), ("k2", "z"), ("k3", "x"), ("k3", "y")]
    versions = [("c", 1, "k1", 1), ("c", 2, "k2", 2), ("c", 3, "k3", 3), ("c", 4, "k1", 4), ("c", 5, "none", 5), ("d", 6, "k1", 1)]
    got = J.version_changes(
        spark.createDataFrame(versions, "campaign string, campaign_version int, keyword_set_id string, start_date int"),
        spark.createDataFrame(sets, "keyword_set_id string, keyword string"),
    ).orderBy("campaign_version").collect()
    assert [(r[1], r[2], r["n_shared"], r["jaccard"], r["shared_keywords"], r["added_keywords"], r["dropped_keywords"]) for r in got] == [
        (2, 1, 1, 1 / 3, "y", "z", "x"), (3, 2, 1, 1 / 3, "y", "x", "z"), (4, 3, 2, 1.0, "x; y", "", ""), (5, 4, 0, 0.0, "", "", "x; y"),
    ]
