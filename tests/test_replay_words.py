import random

from bidloom.operators import history as H

SPANS = "owner string, negative boolean, match_type string, keyword string, from_tick long, to_tick long"


def test_word_arrays_equal_brute_force_over_many_cells(spark):
    draw = random.Random(7)
    spans = []
    for owner in "ab":
        for sign in (False, True):
            for kind in ("Broad", "Phrase", "Exact"):
                for word in range(6):
                    at = draw.randrange(20)
                    while at < 400:
                        end = at + draw.randrange(1, 150)
                        spans.append((owner, sign, kind, f"w{word}", at, None if end > 380 else end))
                        at = end + draw.randrange(1, 40)
    spans.append((None, False, "Broad", "lost", 0, None))
    points = [(o, draw.randrange(400) if draw.random() < 0.9 else None, i) for i in range(300) for o in ("a", "b", None)]
    left = spark.createDataFrame(points, "owner string, tick long, i long")
    cell = H.replay_cells(left, cell_rows=16)
    got = H.shown_words(left, spark.createDataFrame(spans, SPANS), cell, H.WORD_FIELDS).collect()
    assert len(got) == len(points)
    for r in got:
        for name, (sign, kind) in H.WORD_FIELDS.items():
            want = sorted(k for o, s, m, k, a, b in spans if o is not None and o == r.owner and r.tick is not None and s == sign and m == kind
                          and a <= r.tick and (b is None or r.tick < b))
            assert r[name] == want


def test_members_are_one_row_per_snapshot_and_sign(spark):
    heads = spark.createDataFrame([("a", "c", 5), ("a", "c", 5), ("a", "c", 0)], "owner string, campaign string, tick long")
    spans = spark.createDataFrame([("a", False, "Exact", "x", 3, None), ("a", False, "Broad", "x", 1, 9), ("a", True, "Broad", "n", 5, 6)], SPANS)
    got = {(r.tick, r.negative): (r.n_keywords, r.keywords) for r in H.snapshot_members(heads, spans).collect()}
    assert got == {(5, False): (4, ["x"] * 4), (5, True): (2, ["n", "n"])}
