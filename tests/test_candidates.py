"""Ids of new sets beside sets that already have numbered ids."""

from bidloom.operators import candidates as C


def test_numbers_go_past_those_in_use(spark):
    existing = ["synthetic_A_Broad_x_1", "synthetic_A_Broad_x_2", "synthetic_A_Broad_x_03", "synthetic_B_Broad_x_4", "Brand#1", "synthetic_A_Broad_x_", None, "7"]
    rows = [("A / Broad", 1, "synthetic_A_Broad_x_"), ("A / Broad", 2, "synthetic_A_Broad_y_"), ("B / Broad", 1, "synthetic_B_Broad_x_"), ("B / Broad", 2, "synthetic_B_Broad_x_")]
    got = C.numbers_past(
        spark.createDataFrame(rows, "segment string, n int, base string"), ["segment", "n"], spark.createDataFrame([(x,) for x in existing], "keyword_set_id string")
    ).collect()
    # 3 is free for the first base ("03" is another id), 4 for the second; the third must pass 4, which its base has in use.
    assert sorted(map(tuple, got)) == [("A / Broad", 1, 3), ("A / Broad", 2, 4), ("B / Broad", 1, 5), ("B / Broad", 2, 6)]


def test_new_sets_beside_existing_ones(spark):
    synthetic = [(s, s[0], "Broad", f, 10, "Broad", w) for s in ("A / Broad", "B / Broad") for f, words in (("allowlist", "xy"), ("semantic", "yz")) for w in words]
    rows = spark.createDataFrame(synthetic, "segment string, region string, match_types string, family string, n int, match_type string, keyword string")
    none = spark.createDataFrame([], "keyword_set_id string, region string, segment string, match_type string, keyword string")
    plain = {(r["segment"], r["family"]): r["keyword_set_id"] for r in C.number_synthetic_sets(rows, none, none).collect()}
    assert plain["A / Broad", "allowlist"].endswith("_1") and plain["B / Broad", "semantic"].endswith("_4")
    old = spark.createDataFrame([(plain["A / Broad", "semantic"],)], "keyword_set_id string")
    past = {(r["segment"], r["family"]): r["keyword_set_id"] for r in C.number_synthetic_sets(rows, none, none, existing=old).collect()}
    assert [past[k].rsplit("_", 1)[1] for k in sorted(past)] == ["1", "3", "4", "5"] and not set(past.values()) & {plain["A / Broad", "semantic"]}
    assert {r["keyword_set_id"] for r in C.number_synthetic_sets(rows, none, none, existing=old.filter("false")).collect()} == set(plain.values())
