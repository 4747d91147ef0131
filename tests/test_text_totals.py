from pyspark.sql import functions as F

from bidloom.operators import candidates as C
from bidloom.operators import panel as P

RAW = "date string, keyword string, campaign string, match_type string, clicks string, cost string, all_conv string"


def test_totals_by_text_clean_to_the_same_words(spark):
    rows = [("2024-01-01", k, c, m, "1", cost, conv)
            for k, cost, conv in (("+red shoe", "0.1", "0.2"), ('"Red  shoe"', "x", "0.7"), (None, None, None), ("[hat]", "3", "1"))
            for c in ("Course - Run 1 - Search - A - Exact [old]", "Course - Run 1 - Search - A - Exact", "nowhere", None)
            for m in ("EXACT", "BROAD_MATCH", None) for _ in range(3)]
    raw = spark.createDataFrame(rows, RAW)
    totals = P.text_totals(raw)
    assert totals.count() < raw.count() / 2
    whole, few = (C.word_totals(P.clean_report(df)) for df in (raw, totals))
    read = lambda df: sorted(map(str, df.collect()))
    assert read(few) == read(whole)
    known = lambda df: sorted(map(str, df.groupBy("region", "match_type", "keyword").agg((F.count("region") > 0).alias("k")).collect()))
    assert known(P.clean_report(totals)) == known(P.clean_report(raw))
