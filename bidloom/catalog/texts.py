"""Queries over text, calendar and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.catalog import roles as R
from bidloom.catalog.registry import query
from bidloom.catalog.roles_sql import STARTS_SQL, clean_kw, strip
from bidloom.functions import calendar as C
from bidloom.functions import text as T
from bidloom.operators import keyword_sets as K
from bidloom.operators import panel as P


@query("p1_keyword_clean", f"""
SELECT doc_id, {clean_kw('text')} AS keyword,
  CASE WHEN regexp_full_match({clean_kw('text')}, '[a-z0-9 ]+') THEN {clean_kw('text')} END AS strict_keyword FROM documents
UNION ALL SELECT -1 - p_partkey, {clean_kw("' +' || upper(p_name) || ' [' || p_type || '] '")},
  {clean_kw("' +' || upper(p_name) || ' [' || p_type || '] '")} FROM part""")
def p1(spark, sf):
    docs = R.table(spark, sf, "documents").select("doc_id", "text")
    part = R.table(spark, sf, "part")
    names = part.select((-1 - F.col("p_partkey")).alias("doc_id"),
                        F.concat(F.lit(" +"), F.upper("p_name"), F.lit(" ["), "p_type", F.lit("] ")).alias("text"))
    return docs.unionByName(names).select(
        "doc_id", T.clean_keyword("text").alias("keyword"), T.clean_keyword("text", strict=True).alias("strict_keyword"))


@query("p2_campaign_clean", """
SELECT DISTINCT campaign AS raw, 'Course - Run 1 - Search - ' || split_part(campaign, ' - ', 4) || ' - ' ||
  split_part(split_part(campaign, ' - ', 5), ' ', 1) AS campaign FROM kw_raw""")
def p2(spark, sf):
    return R.kw_raw(spark, sf).select(F.col("campaign").alias("raw"), T.clean_campaign("campaign").alias("campaign")).distinct()


@query("p3_region", r"""
SELECT name, list_filter(list_transform(list_transform(string_split(name, '-'), lambda x: trim(x)), lambda p: CASE WHEN contains(p, 'US') THEN 'USA'
  WHEN p IN ('A', 'B', 'C') THEN p WHEN regexp_matches(p, '^[ABC][ /(]') THEN p[1] END), lambda r: r IS NOT NULL)[1] AS region
FROM (SELECT DISTINCT 'Course - ' || c_mktsegment || ' - ' || n_name || ' - ' || ['A', 'B/x', 'C(y)', 'A z', 'AB', 'USA'][c_custkey % 6 + 1] AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def p3(spark, sf):
    cust, nation = R.table(spark, sf, "customer"), R.table(spark, sf, "nation")
    tails = F.array(*[F.lit(x) for x in ("A", "B/x", "C(y)", "A z", "AB", "USA")])
    name = F.concat_ws(" - ", F.lit("Course"), "c_mktsegment", "n_name", F.get(tails, (F.col("c_custkey") % 6).cast("int")))
    return cust.join(nation, F.col("c_nationkey") == nation.n_nationkey).select(name.alias("name")).distinct().withColumn(
        "region", T.region_of_campaign("name"))


@query("p4_match_type", r"""
SELECT raw, array_to_string(list_transform(string_split(raw, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS match_type
FROM (SELECT DISTINCT o_orderstatus || upper(p_type) || '_' || l_returnflag || 'x_MATCH' AS raw
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""")
def p4(spark, sf):
    line, orders, part = (R.table(spark, sf, n) for n in ("lineitem", "orders", "part"))
    raw = F.concat("o_orderstatus", F.upper("p_type"), F.lit("_"), "l_returnflag", F.lit("x_MATCH"))
    return (
        line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
        .select(raw.alias("raw")).distinct().withColumn("match_type", T.clean_match_type("raw"))
    )


@query("p5_numeric_coercion", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS clicks,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_tax END AS cost FROM lineitem""")
def p5(spark, sf):
    line = R.table(spark, sf, "lineitem")
    clicks = F.when(F.col("l_linenumber") == 3, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    cost = F.when(F.col("l_linenumber") == 5, F.lit("NaN")).otherwise(F.col("l_tax").cast("string"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey",
                       F.coalesce(T.to_long(clicks), F.lit(0).cast("bigint")).alias("clicks"), T.to_double(cost).alias("cost"))


LISTS = "SELECT doc_id, replace(text, '.', ';') AS raw FROM documents"


def _lists(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit(";")).alias("raw"))


SPLIT = f"list_filter(list_transform(regexp_split_to_array(raw, '[;\\n]'), lambda x: {strip('x')}), lambda s: s <> '')"


@query("p6_list_split", f"""
SELECT doc_id, CAST(len(parts) AS INTEGER) AS n, array_to_string(parts, '|') AS joined FROM (SELECT doc_id, {SPLIT} AS parts FROM ({LISTS}))""")
def p6(spark, sf):
    return _lists(spark, sf).withColumn("parts", T.split_list("raw")).select(
        "doc_id", F.size("parts").alias("n"), F.array_join("parts", "|").alias("joined"))


@query("p7_list_join", f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(parts)), '; ') AS joined FROM (SELECT doc_id, {SPLIT} AS parts FROM ({LISTS}))""")
def p7(spark, sf):
    return _lists(spark, sf).select("doc_id", T.join_list(T.split_list("raw")).alias("joined"))


@query("p8_clean_sets", "SELECT keyword_set_id, broad_keywords, phrase_keywords, exact_keywords FROM sets_wide")
def p8(spark, sf):
    return K.clean_sets(R.keyword_sets_raw(spark, sf))


@query("p9_positive_list", "SELECT keyword_set_id, positive_keywords FROM sets_wide")
def p9(spark, sf):
    return K.with_positive(K.clean_sets(R.keyword_sets_raw(spark, sf))).select("keyword_set_id", "positive_keywords")


@query("p10_set_keywords", """
SELECT keyword_set_id, positive_keywords AS keywords, CAST(len(string_split(positive_keywords, '; ')) AS INTEGER) AS num_unique_keywords FROM sets_wide""")
def p10(spark, sf):
    sets = K.clean_sets(R.keyword_sets_raw(spark, sf))
    kws = K.set_keywords(sets.columns)
    return sets.select("keyword_set_id", F.array_join(kws, "; ").alias("keywords"), F.size(kws).alias("num_unique_keywords"))


@query("p11_fingerprint", """
SELECT keyword_set_id, sha256(replace(positive_keywords, '; ', chr(1))) AS fingerprint FROM sets_wide""")
def p11(spark, sf):
    sets = K.clean_sets(R.keyword_sets_raw(spark, sf))
    return sets.select("keyword_set_id", T.fingerprint(K.set_keywords(sets.columns)).alias("fingerprint"))


@query("p12_segment_parts", """
SELECT DISTINCT region || ' / ' || match_types AS segment, region, match_types, CAST(match_types = 'Broad' AS INTEGER) AS is_broad_match
FROM panel WHERE region IS NOT NULL""")
def p12(spark, sf):
    seg = P.add_segment(R.panel(spark, sf).filter("region IS NOT NULL")).select("segment").distinct()
    return P.add_match_indicator(seg).select("segment", "region", "match_types", "is_broad_match")


@query("p13_match_types", r"""
SELECT label, array_to_string(list_distinct(t), ',') AS types, CAST(list_distinct(t) = ['Broad'] AS INTEGER) AS is_broad FROM (
  SELECT label, list_transform(list_filter(regexp_split_to_array(replace(label, ';', ' '), '\s+'), lambda s: s <> ''),
    lambda s: upper(s[1]) || lower(s[2:])) AS t FROM (
    SELECT DISTINCT ['broad', 'Phrase; EXACT', 'Broad;exact phrase', ' BROAD ', ''][p_partkey % 5 + 1] || CASE WHEN p_size > 40 THEN '; exact' ELSE '' END AS label FROM part))
WHERE len(list_distinct(t)) <= 1 OR TRUE""".replace("array_to_string(list_distinct(t), ',')", "array_to_string(list_sort(list_distinct(t)), ',')"))
def p13(spark, sf):
    heads = F.array(*[F.lit(x) for x in ("broad", "Phrase; EXACT", "Broad;exact phrase", " BROAD ", "")])
    part = R.table(spark, sf, "part")
    label = F.concat(F.get(heads, (F.col("p_partkey") % 5).cast("int")), F.when(F.col("p_size") > 40, F.lit("; exact")).otherwise(F.lit("")))
    return part.select(label.alias("label")).distinct().select(
        "label", F.array_join(F.array_sort(T.parse_match_types("label")), ",").alias("types"), T.is_broad_only("label").alias("is_broad"))


DAYS = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem"
SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) < 6 THEN 'Spring' WHEN month(date) < 9 THEN 'Summer' ELSE 'Fall' END"


def _days(spark, sf):
    return R.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()


@query("p14_calendar", f"""
SELECT date, dayname(date) AS day_of_week, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, {SEASON} AS season, strftime(date, '%b') AS month FROM ({DAYS})""")
def p14(spark, sf):
    return C.with_date_parts(_days(spark, sf)).select("date", "day_of_week", "is_weekend", "season", "month")


@query("p15_month_cycle", f"""
SELECT date, round(sin(2 * pi() * (month(date) - 1) / 12), 9) AS month_sin, round(cos(2 * pi() * (month(date) - 1) / 12), 9) AS month_cos FROM ({DAYS})""")
def p15(spark, sf):
    return C.with_date_parts(_days(spark, sf)).select(
        "date", (F.round("month_sin", 9) + 0.0).alias("month_sin"), (F.round("month_cos", 9) + 0.0).alias("month_cos"))


HOLIDAYS = """
WITH y AS (SELECT unnest(range(1995, 2003)) AS y),
nth AS (SELECT y, m, k, n, make_date(CAST(y AS INTEGER), m, 1) + CAST((k - isodow(make_date(CAST(y AS INTEGER), m, 1)) + 7) % 7 + 7 * (n - 1) AS INTEGER) AS d, c
  FROM y, (VALUES (1, 1, 3, 'US'), (2, 1, 3, 'US'), (9, 1, 1, 'US'), (10, 1, 2, 'US'), (11, 4, 4, 'US'), (9, 1, 1, 'CA'), (10, 1, 2, 'CA')) t(m, k, n, c)),
fx AS (SELECT make_date(CAST(y AS INTEGER), m, dd) AS d, c FROM y, (VALUES (1, 1, 'US'), (7, 4, 'US'), (11, 11, 'US'), (12, 25, 'US'),
  (1, 1, 'CA'), (7, 1, 'CA'), (12, 25, 'CA')) t(m, dd, c)),
obs AS (SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 END AS d, c FROM fx WHERE c = 'US'),
mem AS (SELECT make_date(CAST(y AS INTEGER), 5, 31) - CAST(isodow(make_date(CAST(y AS INTEGER), 5, 31)) - 1 AS INTEGER) AS d, 'US' AS c FROM y),
vic AS (SELECT make_date(CAST(y AS INTEGER), 5, 24) - CAST(isodow(make_date(CAST(y AS INTEGER), 5, 24)) - 1 AS INTEGER) AS d, 'CA' AS c FROM y),
gf AS (SELECT unnest([DATE '1995-04-14', DATE '1996-04-05', DATE '1997-03-28', DATE '1998-04-10', DATE '1999-04-02', DATE '2000-04-21',
  DATE '2001-04-13', DATE '2002-03-29']) AS d, 'CA' AS c),
hol AS (SELECT DISTINCT d, c FROM (SELECT d, c FROM nth UNION ALL SELECT d, c FROM fx UNION ALL SELECT d, c FROM obs UNION ALL SELECT d, c FROM mem
  UNION ALL SELECT d, c FROM vic UNION ALL SELECT d, c FROM gf) WHERE d IS NOT NULL)"""


@query("p16_public_holidays", HOLIDAYS + f"""
SELECT date, region, CAST(EXISTS (SELECT 1 FROM hol WHERE d = date AND c = CASE region WHEN 'Canada' THEN 'CA' ELSE 'US' END) AS INTEGER) AS is_public_holiday
FROM ({DAYS}), (SELECT unnest(['USA', 'Canada', 'A']) AS region)""")
def p16(spark, sf):
    days = _days(spark, sf).withColumn("region", F.explode(F.array(F.lit("USA"), F.lit("Canada"), F.lit("A"))))
    return C.with_holiday_flag(days, R.FIRST_YEAR, R.LAST_YEAR)


@query("p17_days_to_next", f"""
SELECT date, CAST(list_min(list_filter(list_transform([{STARTS_SQL}], lambda s: s - date), lambda g: g >= 0)) AS DOUBLE) AS days_to_next FROM ({DAYS})""")
def p17(spark, sf):
    return _days(spark, sf).select("date", C.days_to_next("date", R.STARTS).alias("days_to_next"))


@query("p18_planning_calendar", HOLIDAYS + f"""
SELECT date, region, dayname(date) AS day_of_week, {SEASON} AS season,
  CAST(list_min(list_filter(list_transform([{STARTS_SQL}], lambda s: s - date), lambda g: g >= 0)) AS DOUBLE) AS days_to_next_course_start,
  CAST(EXISTS (SELECT 1 FROM hol WHERE d = date AND c = 'US') AS INTEGER) AS is_public_holiday
FROM ({DAYS}), (SELECT DISTINCT region FROM panel WHERE region IS NOT NULL)""")
def p18(spark, sf):
    regions = R.panel(spark, sf).filter("region IS NOT NULL").groupBy().agg(F.array_sort(F.collect_set("region")).alias("r"))
    grid = _days(spark, sf).withColumn("region", F.explode(regions.select("r").scalar()))
    return C.with_calendar(grid, R.FIRST_YEAR, R.LAST_YEAR, R.STARTS).select(
        "date", "region", "day_of_week", "season", "days_to_next_course_start", "is_public_holiday")


@query("p19_cent_rounding", """
SELECT l_orderkey, l_linenumber, l_partkey, (h // 1000 + CASE WHEN h % 1000 > 500 OR (h % 1000 = 500 AND (h // 1000) % 2 = 1) THEN 1 ELSE 0 END) / 100 AS cents
FROM (SELECT *, CAST(l_quantity AS BIGINT) * 12500 + l_linenumber * 125 AS h FROM lineitem)""")
def p19(spark, sf):
    line = R.table(spark, sf, "lineitem")
    units = F.col("l_quantity").cast("bigint") * 12500 + F.col("l_linenumber") * 125
    return line.select("l_orderkey", "l_linenumber", "l_partkey",
                       T.half_even(units.cast("decimal(20,0)") / F.lit(100000), 2).cast("double").alias("cents"))


@query("p20_zero_fill", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type FROM events""")
def p20(spark, sf):
    from bidloom.models import design as D
    ev = R.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("event_type"))
    return D.zero_fill(ev, ["value", "event_type", "absent"])


@query("p21_change_text", """
SELECT event_id, b AS last_amount, a AS previous_amount, 'Course - Search - c' || slot AS campaign,
  CAST(ts AS DATE) AS date FROM (SELECT *, printf('%.2f', floor(value * 9000) / 100) AS a, printf('%.2f', floor(value * 10000) / 100) AS b FROM ev) WHERE event_type = 'purchase'""")
def p21(spark, sf):
    ev = R.table(spark, sf, "events").filter("event_type = 'purchase'")
    money = lambda c: F.format_number(F.floor(c) / 100, 2)
    detail = F.concat(F.lit("expand_more Course - Search - c"), (F.col("user_id") % 12).cast("string"),
                      F.lit(": Budget amount changed from US$"), money(F.col("value") * 9000), F.lit(" to "), money(F.col("value") * 10000), F.lit(" USD"))
    shown = F.date_format(F.col("ts").cast("timestamp"), "d MMM yyyy, HH:mm:ss")
    return ev.select("event_id", T.last_amount(detail).alias("last_amount"), T.previous_amount(detail).alias("previous_amount"),
                     T.budget_campaign(detail).alias("campaign"), T.change_date(shown).alias("date"))


@query("p22_keyword_detail", """
SELECT event_id, 'k' || k || ' word' AS keyword, CASE k % 3 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Phrase' ELSE 'Broad' END AS match_type, negative,
  CASE WHEN NOT negative THEN CASE event_type WHEN 'signup' THEN 'add' ELSE 'remove' END END AS status,
  CASE WHEN negative THEN CASE event_type WHEN 'signup' THEN 'add' ELSE 'remove' END END AS negative_status,
  CASE event_id % 4 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Phrase' WHEN 2 THEN 'Broad' END AS summary_type
FROM ev WHERE event_type IN ('signup', 'error')""")
def p22(spark, sf):
    ev = R.table(spark, sf, "events").filter("event_type IN ('signup', 'error')")
    k = F.get_json_object("props", "$.k").cast("int")
    word = F.concat(F.lit("+K"), k.cast("string"), F.lit("  Word"))
    body = F.when(k % 3 == 0, F.concat(F.lit("["), word, F.lit("]: x"))).when(k % 3 == 1, F.concat(F.lit('"'), word, F.lit('"'))).otherwise(F.concat(word, F.lit(": y")))
    neg = F.col("event_id") % 7 == 0
    detail = F.concat(F.lit("expand_more "), F.when(neg, F.lit("-")).otherwise(F.lit("")), body)
    kind = F.get(F.array(*[F.lit(x) for x in ("exact match ", "phrase match ", "broad match ", "")]), (F.col("event_id") % 4).cast("int"))
    summary = F.concat(F.lit("1 "), F.when(neg, F.lit("negative ")).otherwise(F.lit("")), kind, F.lit("keyword "),
                       F.when(F.col("event_type") == "signup", "enabled").otherwise("paused"))
    d = T.keyword_detail(detail)
    return ev.select("event_id", d["keyword"].alias("keyword"), d["match_type"].alias("match_type"), d["negative"].alias("negative"),
                     T.keyword_status(summary).alias("status"), T.keyword_status(summary, negative=True).alias("negative_status"),
                     T.summary_match_type(summary).alias("summary_type"))


@query("p23_campaign_predicates", """
SELECT name, regexp_matches(trim(name, ' '), '^[0-9]+ campaigns?$') AS aggregate_label, c AS search_campaign, t AS trimmed FROM (
 SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN '12 campaigns' WHEN 1 THEN ' "Search ' || c_mktsegment || '?" ' WHEN 2 THEN 'Search Experiment ' || c_mktsegment ELSE c_mktsegment END AS name,
  c_custkey % 4 = 1 AS c, CASE c_custkey % 4 WHEN 0 THEN '12 campaigns' WHEN 1 THEN 'Search ' || c_mktsegment WHEN 2 THEN 'Search Experiment ' || c_mktsegment ELSE c_mktsegment END AS t FROM customer)""")
def p23(spark, sf):
    n = F.col("c_custkey") % 4
    name = (F.when(n == 0, F.lit("12 campaigns")).when(n == 1, F.concat(F.lit(' "Search '), "c_mktsegment", F.lit('?" ')))
            .when(n == 2, F.concat(F.lit("Search Experiment "), "c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return R.table(spark, sf, "customer").select(name.alias("name")).distinct().select(
        "name", T.is_aggregate_campaign("name").alias("aggregate_label"), T.is_search_campaign("name").alias("search_campaign"),
        T.trim_campaign("name").alias("trimmed"))


@query("p24_names", """
SELECT n_name, r_name, 'Course - ' || n_name || ' - Phrase; ' || r_name || ' - Experiment' AS campaign_name,
 'Ad Group - Course - ' || n_name || ' - Phrase; ' || r_name || ' - Experiment' AS ad_group_name,
 'Budget - Course - ' || n_name || ' - Phrase; ' || r_name || ' - Experiment' AS budget_name, 'PHRASE|' || upper(r_name) AS types
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def p24(spark, sf):
    nation, region = R.table(spark, sf, "nation"), R.table(spark, sf, "region")
    label = F.concat(F.lit("Phrase; "), F.initcap("r_name"))
    raw = F.concat(F.lit("Phrase; "), "r_name")
    args = (F.lit("Course"), F.col("n_name"), raw)
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_name", "r_name", T.campaign_name(*args).alias("campaign_name"), T.ad_group_name(*args).alias("ad_group_name"),
        T.budget_name(*args).alias("budget_name"), F.array_join(T.match_types_of_label(label), "|").alias("types"))
