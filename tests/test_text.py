import datetime

from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.operators import keyword_sets as K
from bidloom.operators import panel as P


def one(spark, values, **cols):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.asDict() for r in df.select("x", *[c.alias(n) for n, c in cols.items()]).collect()]


def test_keyword_clean(spark):
    rows = one(spark, [' +Systems  "Thinking" ', "[it's]", None, "naïve", "a  b"], k=T.clean_keyword("x"), s=T.clean_keyword("x", strict=True))
    assert [r["k"] for r in rows] == ["systems thinking", "its", "", "naïve", "a b"]
    assert [r["s"] for r in rows] == ["systems thinking", "its", None, None, "a b"]


def test_region(spark):
    names = ["X - USA - Broad", "X - A/B - Broad", "X - C(y)", "HOUSEHOLD - B", "X - AB - Z", "X - B - USA", "A", None, "X -  A  - y"]
    assert [r["r"] for r in one(spark, names, r=T.region_of_campaign("x"))] == ["USA", "A", "C", "USA", None, "B", "A", None, "A"]


def test_match_types(spark):
    rows = one(spark, ["Broad", "Phrase; Exact", "broad;EXACT", "", None, "Broad; broad"], t=F.array_join(T.parse_match_types("x"), ","), b=T.is_broad_only("x"))
    assert [(r["t"], r["b"]) for r in rows] == [("Broad", 1), ("Phrase,Exact", 0), ("Broad,Exact", 0), ("", 0), ("", 0), ("Broad", 1)]
    assert one(spark, ["EXACT_MATCH", "phrase;exact"], m=T.clean_match_type("x"))[1]["m"] == "Phrase;Exact"


def test_lists(spark):
    rows = one(spark, ["b; a\n; a ", None], j=T.join_list(T.split_list("x")))
    assert [r["j"] for r in rows] == ["a; b", ""]


def test_change_text(spark):
    text = "expand_more Course - X: Budget amount changed from $1,200.50 to US$1,300"
    row = one(spark, [text], a=T.last_amount("x"), p=T.previous_amount("x"), c=T.budget_campaign("x"))[0]
    assert (row["a"], row["p"], row["c"]) == ("1300", "1200.50", "Course - X")
    assert one(spark, ["21 Apr 2026, 14:01:16"], d=T.change_date("x"))[0]["d"] == datetime.date(2026, 4, 21)


def test_keyword_detail(spark):
    d = T.keyword_detail("x")
    rows = one(spark, ["-[Big Idea]", '"x y": more', "plain: z", "1 keyword added now", ""], k=d["keyword"], m=d["match_type"], n=d["negative"])
    assert [(r["k"], r["m"], r["n"]) for r in rows] == [("big idea", "Exact", True), ("x y", "Phrase", False), ("plain", "Broad", False), (None,) * 3, (None,) * 3]


def test_report_cleaning_is_idempotent(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", '+A "b"', "X - USA - Broad [old]", "EXACT_MATCH", "3.0", "n/a", None), ("2024-01-03", "z", "X - B", "broad", "bad", "1.5", "2")],
        "date string, keyword string, campaign string, match_type string, clicks string, cost string, all_conv string")
    once = P.clean_report(raw)
    assert once.collect() == P.clean_report(once).collect()
    first = once.collect()[0]
    assert (first.region, first.clicks, first.cost, first.all_conv) == ("USA", 3, None, 0.0)


def test_set_keywords_fallback(spark):
    sets = spark.createDataFrame([("s1", "", " ", None, "p; q"), ("s2", "b; a", "a", "c", "ignored")],
                                 "keyword_set_id string, broad_keywords string, phrase_keywords string, exact_keywords string, positive_keywords string")
    got = {r[0]: r[1] for r in sets.select("keyword_set_id", F.array_join(K.set_keywords(sets.columns), ",")).collect()}
    assert got == {"s1": "p,q", "s2": "a,b,c"}
