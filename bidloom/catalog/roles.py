"""Domain views over the given tables: reports, versions, keyword sets, change log, plans.

Each view is a deterministic DataFrame; ``roles_sql`` states the same view in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions import text as T
from bidloom.operators import panel as P
from bidloom.session import cut_lineage

# Start dates named by the calendar queries.
STARTS = (
    "1995-01-02", "1995-04-03", "1995-10-02", "1996-01-01", "1996-04-01", "1996-10-07",
    "1997-01-06", "1997-04-07", "1997-10-06", "1998-01-05", "1998-04-06", "1998-10-05",
    "1999-01-04", "1999-04-05", "1999-10-04", "2000-01-03", "2000-04-03", "2000-10-02",
    "2001-01-01", "2001-04-02", "2001-10-01",
)
FIRST_YEAR, LAST_YEAR = 1995, 2002
ANCHOR_IDS = (0, 1, 2, 3)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def kw_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword-day report rows as a feed would deliver them."""
    line, orders, cust = (table(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    nation, region, part = (table(spark, sf, n) for n in ("nation", "region", "part"))
    area = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    # the region of an order first: the report rows, by far the most, then move for two joins only
    placed = (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .join(area, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "r_name")
    )
    rows = line.join(placed, line.l_orderkey == placed.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    region_label = (
        F.when(F.col("r_name") == "AMERICA", "USA").when(F.col("r_name") == "EUROPE", "A")
        .when(F.col("r_name") == "ASIA", "B").when(F.col("r_name") == "AFRICA", "C").otherwise("Other")
    )
    kind = F.when(F.col("l_returnflag") == "R", "Broad").when(F.col("l_returnflag") == "A", "Phrase").otherwise("Exact")
    keyword = (
        F.when(kind == "Broad", F.concat(F.lit("+"), F.replace("p_name", F.lit(" "), F.lit(" +"))))
        .when(kind == "Phrase", F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
        .otherwise(F.concat(F.lit("["), F.col("p_name"), F.lit("]")))
    )
    return rows.select(
        F.col("l_shipdate").cast("date").alias("date"),
        keyword.alias("keyword"),
        F.concat(F.lit("Course - Run 1 - Search - "), region_label, F.lit(" - "), kind, F.lit(" [old]")).alias("campaign"),
        F.upper(kind).alias("match_type"),
        F.col("l_quantity").alias("clicks"),
        (F.floor(F.col("l_extendedprice") * F.col("l_tax")) / 100).alias("cost"),
        (F.round(F.col("l_quantity") * F.col("l_discount"), 2)).alias("all_conv"),
        F.lit("USD").alias("currency_code"),
        (F.col("p_size") / 10.0).alias("first_page_cpc"),
        F.col("l_linestatus").alias("feed"),
    )


def kw_day(spark: SparkSession, sf: str) -> DataFrame:
    return P.clean_report(kw_raw(spark, sf).drop("feed"))


def kw_words(spark: SparkSession, sf: str) -> DataFrame:
    """Clean report with one row per raw text, for consumers that group by region, match type and keyword."""
    return P.clean_report(P.text_totals(kw_raw(spark, sf).drop("feed")))


def campaign_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Budget versions: one per region, match type and order quarter."""
    orders, cust, nation, region = (table(spark, sf, n) for n in ("orders", "customer", "nation", "region"))
    quarter = F.trunc(F.col("o_orderdate").cast("date"), "quarter")
    base = (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        .groupBy("r_name", "r_regionkey", quarter.alias("start_date"))
        .agg(F.round(F.avg("o_totalprice") / 1000, 2).alias("_budget"))
    )
    from pyspark.sql import Window

    q = (F.year("start_date") - 1990) * 4 + F.quarter("start_date")
    label = (
        F.when(F.col("r_name") == "AMERICA", "USA").when(F.col("r_name") == "EUROPE", "A")
        .when(F.col("r_name") == "ASIA", "B").when(F.col("r_name") == "AFRICA", "C").otherwise("Other")
    )
    # quarters per region are bounded by the calendar
    ends = base.withColumn("end_date", F.lead("start_date").over(Window.partitionBy("r_name").orderBy("start_date")))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(mt).alias("mt"), F.lit(cfg).alias("cfg")) for k, mt, cfg in
                      ((0, "Broad", "Broad"), (1, "Phrase", "Phrase; Exact"), (2, "Exact", "Exact"))])
    # a stored dimension, as in production: several joins read it
    return cut_lineage(ends.withColumn("x", F.explode(kinds)).select(
        (F.col("r_regionkey") * 10000 + q * 10 + F.col("x.k")).cast("bigint").alias("campaign_version"),
        F.concat(F.lit("Brand#"), (1 + (q * 3 + F.col("x.k") + F.col("r_regionkey") * 7) % 25).cast("string")).alias("keyword_set_id"),
        F.concat(F.lit("Course - Run 1 - Search - "), label, F.lit(" - "), F.col("x.mt")).alias("campaign"),
        "start_date",
        "end_date",
        F.round(F.col("_budget") + 10 * F.col("x.k"), 2).alias("daily_budget"),
        F.col("x.cfg").alias("match_types"),
    ))


def panel(spark: SparkSession, sf: str, versions: DataFrame | None = None) -> DataFrame:
    """The stored campaign-day panel; later steps read it, never the report again."""
    return cut_lineage(P.campaign_day_panel(kw_day(spark, sf), campaign_summary(spark, sf) if versions is None else versions))


def segment_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Panel rows with region, segment, keyword set and scaled target."""
    versions = campaign_summary(spark, sf)
    days = panel(spark, sf, versions).filter(F.col("region").isNotNull())
    out = P.scaled_target(days, P.segment_rates(days))
    return P.attach_set_ids(P.add_segment(out), versions)


def set_members(spark: SparkSession, sf: str) -> DataFrame:
    """Long bridge (keyword_set_id, match_type, keyword) of the given keyword sets."""
    part = table(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "Broad").when(F.col("p_partkey") % 3 == 1, "Phrase").otherwise("Exact")
    return part.select(
        F.col("p_brand").alias("keyword_set_id"), kind.alias("match_type"), T.clean_keyword("p_name").alias("keyword")
    ).distinct()


def keyword_sets_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Set table with uncleaned text lists per match type."""
    part = table(spark, sf, "part")
    raw = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("+"), F.col("p_name")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(' "'), F.upper("p_name"), F.lit('" ')))
        .otherwise(F.concat(F.lit("["), F.col("p_name"), F.lit("]")))
    )
    kind = F.when(F.col("p_partkey") % 3 == 0, "Broad").when(F.col("p_partkey") % 3 == 1, "Phrase").otherwise("Exact")

    def listed(mt: str) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(kind == mt, raw))), ";\n").alias(T.LIST_COLUMNS[mt])

    return part.groupBy(F.col("p_brand").alias("keyword_set_id")).agg(*[listed(mt) for mt in T.MATCH_TYPES])


def planner_stats(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return part.groupBy(T.clean_keyword("p_name").alias("keyword")).agg(
        F.sum("p_size").cast("double").alias("last_month_searches"),
        F.avg("p_size").alias("competition_index"),
        F.min("p_retailprice").alias("bid_low"),
    )


def planner_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Planner export: text cells, one searches column per month, repeated keywords."""
    part = table(spark, sf, "part").groupBy("p_name").agg(
        F.sum("p_size").alias("s"), F.max("p_size").alias("m"), F.min("p_retailprice").alias("r"), F.min("p_partkey").alias("k")
    )
    dup = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    return part.select("*", dup).select(
        (F.col("k") * 2 + F.col("copy")).alias("row_no"),
        F.when(F.col("copy") == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("Keyword"),
        F.format_number(F.col("s") * 10 + F.col("copy"), 0).alias("Searches: Dec 2023"),
        F.format_number(F.col("s") * 100 + F.col("copy"), 0).alias("Searches: Mar 2024"),
        F.when(F.col("s") % 7 == 0, F.lit("--")).otherwise(F.format_number(F.col("s") * 3, 0)).alias("Searches: Feb 2024"),
        F.concat(F.col("m").cast("string"), F.lit("%")).alias("Competition (indexed value)"),
        F.concat(F.lit("$"), F.format_number(F.col("r"), 2)).alias("Top of page bid (low range)"),
    )


def allowlist_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Enrollment rows: keyword text, enrollments, file order."""
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("row_no")).filter("row_no % 5 <> 0")
    lines = (
        line.groupBy("l_partkey").count().join(part, F.col("l_partkey") == part.p_partkey)
        .groupBy("p_name").agg(F.sum("count").alias("enrollments"))
    )
    # stored, like the uploaded list it stands for
    return cut_lineage(names.join(lines, "p_name", "left").select(
        F.upper("p_name").alias("keyword"), F.coalesce("enrollments", F.lit(0)).alias("enrollments"), "row_no"
    ))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vector rows as pool members: keyword text, pool (label), vector."""
    emb = table(spark, sf, "embeddings")
    return emb.select(
        F.format_string("kw%05d", "vec_id").alias("keyword"),
        F.col("label").alias("pool"),
        F.col("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).filter(F.col("vec_id").isin(*ANCHOR_IDS))


def vector_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Bridge of vector sets: set per (pool, vec_id mod 3), match type by vec_id mod 2 and 5."""
    kind = F.when(F.col("vec_id") % 5 == 0, "Broad").when(F.col("vec_id") % 2 == 0, "Phrase").otherwise("Exact")
    return vectors(spark, sf).select(
        F.concat_ws("_", F.lit("set"), F.col("pool"), F.col("vec_id") % 3).alias("keyword_set_id"),
        kind.alias("match_type"),
        "keyword",
    )


def keyword_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vector of each report keyword: the vector numbered by the keyword's first part key."""
    names = table(spark, sf, "part").groupBy(T.clean_keyword("p_name").alias("keyword")).agg(F.min("p_partkey").alias("vec_id"))
    return names.join(vectors(spark, sf).select("vec_id", "embedding"), "vec_id").select("keyword", "embedding")


# --- change log ----------------------------------------------------------------------------

MICROS_END = 4102444800000000


def change_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Change-log rows (order, date, summary, campaign, details); order grows with age."""
    ev = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    slot = F.col("user_id") % 12
    shown = F.when(slot == 9, 8).when(slot.isin(10, 11), 0).otherwise(slot)
    campaign = F.concat(F.lit("Course - Search - c"), shown.cast("string"))
    k = F.get_json_object("props", "$.k").cast("int")
    word = F.concat(F.lit("k"), k.cast("string"), F.lit(" word"))
    written = (
        F.when(k % 3 == 0, F.concat(F.lit("["), word, F.lit("]")))
        .when(k % 3 == 1, F.concat(F.lit('"'), word, F.lit('"')))
        .otherwise(word)
    )
    negative = F.col("event_id") % 7 == 0
    kind = F.col("event_type")
    plus = F.when(negative, F.lit("1 negative keyword added")).otherwise(F.lit("1 keyword added"))
    minus = F.when(negative, F.lit("1 negative keyword removed")).otherwise(F.lit("1 keyword removed"))
    summary = (
        F.when(kind == "purchase", F.lit("Budget amount changed"))
        .when(kind == "signup", plus)
        .when(kind == "error", minus)
        .when(kind == "click", F.lit("1 campaign active"))
        .otherwise(F.lit("1 campaign paused"))
    )
    money = F.format_string("%.2f", F.floor(F.col("value") * 100) / 100)
    before = F.format_string("%.2f", F.floor(F.col("value") * 90) / 100)
    detail = (
        F.when(kind == "purchase", F.concat(campaign, F.lit(": Budget amount changed from $"), before, F.lit(" to $"), money))
        .when(kind.isin("signup", "error"), F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), written))
        .when(kind == "click", F.lit("Status changed from paused to active"))
        .otherwise(F.lit("Status changed from active to paused"))
    )
    return ev.select(
        (F.lit(MICROS_END) - F.unix_micros(ts)).alias("order"),
        ts.cast("date").alias("date"),
        summary.alias("summary"),
        campaign.alias("campaign"),
        F.array(F.struct(campaign.alias("campaign"), detail.alias("text"))).alias("details"),
    ).unionByName(rename_actions(ev))


def rename_actions(events: DataFrame) -> DataFrame:
    """Three renames at fixed shares of the log's time span: c9 to c8, c10 to c11, c11 to c0."""
    span = events.agg(
        F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("lo"),
        F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("hi"),
    )
    rows = F.array(*[
        F.struct(F.lit(at).alias("at"), F.lit(a).alias("old"), F.lit(b).alias("new"))
        for at, a, b in ((5, "c9", "c8"), (6, "c10", "c11"), (8, "c11", "c0"))
    ])
    when = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * F.col("r.at") / 10)
    name = lambda c: F.concat(F.lit("Course - Search - "), c)
    return span.withColumn("r", F.explode(rows)).select(
        (F.lit(MICROS_END) - when).cast("bigint").alias("order"),
        F.timestamp_micros(when).cast("date").alias("date"),
        F.lit("Campaign name changed").alias("summary"),
        name(F.col("r.new")).alias("campaign"),
        F.array(F.struct(
            name(F.col("r.new")).alias("campaign"),
            F.concat(F.lit("Campaign name changed from "), name(F.col("r.old")), F.lit(" to "), name(F.col("r.new"))).alias("text"),
        )).alias("details"),
    )


def change_kw_index(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword-day rows of the change-log campaigns, over days around the log's span."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    day = F.date_add(F.to_date(F.lit("2023-12-25")), (F.dayofyear(F.col("l_shipdate").cast("date")) % 45).cast("int"))
    kind = F.when(F.col("l_returnflag") == "R", "Broad").when(F.col("l_returnflag") == "A", "Phrase").otherwise("Exact")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.concat(F.lit("Course - Search - c"), (F.col("l_suppkey") % 12).cast("string")).alias("campaign"),
        day.alias("date"),
        T.clean_keyword("p_name").alias("keyword"),
        kind.alias("match_type"),
    )
