"""Queries over reports, versions and the panel: scans, filters, joins, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.catalog import roles as R
from bidloom.catalog.registry import query
from bidloom.catalog.roles_sql import ROLES
from bidloom.functions import text as T
from bidloom.operators import joins as J
from bidloom.operators import panel as P
from bidloom.session import scratch_dir
from bidloom.sources import feeds, files

CHANNEL = "CASE l_linestatus WHEN 'F' THEN 'SEARCH' ELSE 'DISPLAY' END"


@query("s1_clean_report", """
SELECT date, region, keyword, campaign, match_type, clicks, round(cost, 6) AS cost, all_conv, currency_code, first_page_cpc
FROM kw_day""")
def s1(spark, sf):
    return R.kw_day(spark, sf).withColumn("cost", F.round("cost", 6))


@query("s2_clean_summary", """
SELECT campaign_version, keyword_set_id, campaign, start_date,
  CASE WHEN campaign_version % 10 = 1 THEN NULL ELSE end_date END AS end_date,
  CASE WHEN campaign_version % 10 = 2 THEN NULL ELSE daily_budget END AS daily_budget, match_types
FROM campaign_summary""")
def s2(spark, sf):
    kind = F.col("campaign_version") % 10
    text = R.campaign_summary(spark, sf).withColumns({
        "campaign": F.concat(F.lit(" "), F.col("campaign"), F.lit(" [v1]")),
        "start_date": F.col("start_date").cast("string"),
        "end_date": F.when(kind == 1, F.lit("open")).otherwise(F.col("end_date").cast("string")),
        "daily_budget": F.when(kind == 2, F.lit("n/a")).otherwise(F.col("daily_budget").cast("string")),
    })
    return P.clean_summary(text)


@query("s3_planner_stats", """
SELECT p_name AS keyword, CAST(sum(p_size) * 100 AS DOUBLE) AS last_month_searches,
  CAST(max(p_size) AS DOUBLE) AS competition_index, min(p_retailprice) AS bid_low FROM part GROUP BY 1""")
def s3(spark, sf):
    return feeds.tidy_planner_stats(R.planner_wide(spark, sf))


@query("s4_allowlist", "SELECT * FROM allowlist")
def s4(spark, sf):
    return feeds.ordered_allowlist(R.allowlist_raw(spark, sf))


@query("s5_embedding_cache", """
SELECT p.keyword, v.vec_id IS NULL AS missing, v.vec_id
FROM (SELECT printf('kw%05d', p_partkey) AS keyword FROM part) p LEFT JOIN vectors v USING (keyword)""")
def s5(spark, sf):
    wanted = R.table(spark, sf, "part").select(F.upper(F.format_string(" kw%05d ", "p_partkey")).alias("keyword"))
    cache = R.vectors(spark, sf).withColumn("model_name", F.lit("given"))
    hits, missing = feeds.cached_embeddings(wanted, cache, "given")
    return hits.select("keyword", F.lit(False).alias("missing"), "vec_id").unionByName(
        missing.select("keyword", F.lit(True).alias("missing"), F.lit(None).cast("bigint").alias("vec_id"))
    )


def _feeds(spark, sf):
    line = R.table(spark, sf, "lineitem")
    raw = R.kw_raw(spark, sf)
    base = raw.withColumns({
        "cost_micros": F.round(F.col("cost") * 1000000).cast("bigint") + F.col("clicks").cast("bigint") * 1000,
        "first_page_cpc_micros": F.round(F.col("first_page_cpc") * 1000000).cast("bigint"),
    })
    clicks = base.filter("feed = 'F'")
    conversions = base.filter("feed = 'O'").select(
        "date", "keyword", "campaign", "match_type", F.col("all_conv").alias("all_conversions"),
        F.when(F.col("clicks") % 2 == 0, "Purchase").otherwise("Visit").alias("action"),
    )
    return clicks, conversions


@query("s6_merge_feeds", """
WITH c AS (SELECT date, keyword, campaign, match_type, CAST(sum(clicks) AS BIGINT) AS clicks,
    CAST(sum(CAST(round(cost * 1000000) AS BIGINT) + CAST(clicks AS BIGINT) * 1000) AS BIGINT) AS m, max(first_page_cpc) AS f
  FROM kw_raw WHERE feed = 'F' GROUP BY ALL),
v AS (SELECT date, keyword, campaign, match_type, sum(all_conv) AS all_conv FROM kw_raw
  WHERE feed = 'O' AND CAST(clicks AS BIGINT) % 2 = 0 GROUP BY ALL)
SELECT date, keyword, campaign, upper(match_type[1]) || lower(match_type[2:]) AS match_type, coalesce(clicks, 0) AS clicks,
  coalesce((m // 10000 + CASE WHEN m % 10000 > 5000 OR (m % 10000 = 5000 AND (m // 10000) % 2 = 1) THEN 1 ELSE 0 END) / 100, 0) AS cost,
  round(coalesce(all_conv, 0), 2) AS all_conv, CASE WHEN m IS NULL THEN '' ELSE 'USD' END AS currency_code,
  f AS first_page_cpc
FROM c FULL JOIN v USING (date, keyword, campaign, match_type)""")
def s6(spark, sf):
    return feeds.merge_feeds(*_feeds(spark, sf), actions=["Purchase"])


@query("s7_feed_predicates", f"""
SELECT date, keyword, campaign, match_type, clicks FROM (
  SELECT *, CASE feed WHEN 'F' THEN 'SEARCH' ELSE 'DISPLAY' END AS channel,
    CASE WHEN campaign LIKE '%Other%' THEN 'EXCLUDE ' || campaign WHEN campaign LIKE '%- C -%' THEN campaign || ' Experiment' ELSE campaign END AS shown
  FROM kw_raw)
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND shown NOT LIKE 'EXCLUDE%' AND shown NOT LIKE '%Experiment%'
  AND channel = 'SEARCH' AND match_type IN ('EXACT', 'PHRASE', 'BROAD') AND clicks > 0""")
def s7(spark, sf):
    raw = R.kw_raw(spark, sf).withColumns({
        "channel": F.when(F.col("feed") == "F", "SEARCH").otherwise("DISPLAY"),
        "campaign": F.when(F.col("campaign").contains("Other"), F.concat(F.lit("EXCLUDE "), "campaign"))
        .when(F.col("campaign").contains("- C -"), F.concat("campaign", F.lit(" Experiment"))).otherwise(F.col("campaign")),
    })
    return feeds.served(raw, "1996-01-01", "1998-12-31", "clicks").select("date", "keyword", "campaign", "match_type", "clicks")


@query("s8_latest_events", """
SELECT event_id, ts, user_id FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
ORDER BY ts DESC, event_id DESC LIMIT 10000""")
def s8(spark, sf):
    ev = R.table(spark, sf, "events").withColumnRenamed("event_type", "actor")
    return feeds.latest_events(ev, "click", "2024-01-05", "2024-01-25").select("event_id", "ts", "user_id")


PANEL_SQL = "SELECT date, campaign_version, region, daily_budget, match_types, clicks, cost, all_conv FROM panel"


@query("s9_panel_sink", PANEL_SQL)
def s9(spark, sf):
    path = scratch_dir(spark, "panel")
    files.publish_panel(R.panel(spark, sf), R.campaign_summary(spark, sf), path)
    return spark.read.parquet(path).drop("month")


PLAN_SEGMENTS = """
SELECT date, segment, min(daily_budget) AS daily_budget, min(keyword_set_id) AS keyword_set_id,
  sum(conv_scaled_clicks) AS observed, sum(clicks) AS observed_clicks FROM segment_panel GROUP BY date, segment"""


def daily_plan(spark, sf):
    """A saved plan per day: each segment's smallest budget and set of that day."""
    return R.segment_panel(spark, sf).groupBy("date", "segment").agg(
        F.min("daily_budget").alias("daily_budget"), F.min("keyword_set_id").alias("keyword_set_id")
    )




@query("s10_plan_folder_scan", """
SELECT day AS date, CAST(count(*) AS BIGINT) AS n_rows, round(sum(daily_budget), 6) AS budget, 'day' AS period FROM (
  SELECT date_trunc('month', date)::DATE AS day, segment, min(daily_budget) AS daily_budget FROM segment_panel GROUP BY ALL)
GROUP BY day""")
def s10(spark, sf):
    month = F.trunc("date", "MM")
    plans = R.segment_panel(spark, sf).groupBy(month.alias("m"), "segment").agg(F.min("daily_budget").alias("daily_budget"))
    path = scratch_dir(spark, "run")
    # one folder per month: gather its few rows before writing
    out = plans.select(F.date_format("m", "yyyyMMdd").alias("d"), "segment", "daily_budget").repartition("d")
    out.write.option("header", True).partitionBy("d").csv(f"{path}/plans")
    back = files.collect_plan_vs_actual(spark, path, glob="*.csv")
    return back.groupBy("date", "period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("daily_budget"), 6).alias("budget")
    )


@query("s11_plan_days", """
SELECT date AS day, CAST(count(*) AS BIGINT) AS n_segments, round(sum(b), 6) AS opt_budget_total,
  CAST(count(*) FILTER (WHERE b <= 0) AS BIGINT) AS n_segments_zero_budget
FROM (SELECT date, CASE WHEN segment LIKE 'B%' THEN 0 ELSE min(daily_budget) END AS b FROM segment_panel GROUP BY date, segment)
GROUP BY date""")
def s11(spark, sf):
    plan = daily_plan(spark, sf).withColumn("daily_budget", F.when(~F.col("segment").startswith("B"), F.col("daily_budget")))
    out = files.plan_days(files.evaluation_source([None, plan]))
    return out.withColumn("opt_budget_total", F.round("opt_budget_total", 6))


@query("s12_set_display", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY keyword_set_id, match_type ORDER BY keyword) - 1 AS pos FROM set_members)
SELECT keyword_set_id, CAST(pos AS INTEGER) AS pos, coalesce(max(keyword) FILTER (WHERE match_type = 'Broad'), '') AS "Broad",
  coalesce(max(keyword) FILTER (WHERE match_type = 'Phrase'), '') AS "Phrase",
  coalesce(max(keyword) FILTER (WHERE match_type = 'Exact'), '') AS "Exact" FROM n GROUP BY ALL""")
def s12(spark, sf):
    from bidloom.operators import keyword_sets as K
    return files.display_layout(K.clean_sets(R.keyword_sets_raw(spark, sf)))


@query("s14_change_payload", r"""
SELECT page_id, CAST(r * 1000 + a AS BIGINT) AS "order", (1 + page_id % 28) || ' Apr 2026, 14:01:16' AS date_text,
  make_date(2026, 4, CAST(1 + page_id % 28 AS INTEGER)) AS date, CASE a WHEN 0 THEN 'Budget amount "changed"' ELSE '1 keyword added' END AS summary,
  'It''s ' || url AS campaign, CASE a WHEN 0 THEN 'other\path|It''s ' || url || ': x y' ELSE 'It''s ' || url || ': [k' || r || ']' END AS details
FROM pages, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS a)""")
def s14(spark, sf):
    pages = R.table(spark, sf, "pages")
    camp = F.concat(F.lit("It's "), F.col("url"))
    day = F.concat((1 + F.col("page_id") % 28).cast("string"), F.lit(" Apr 2026, 14:01:16"))

    def obj(**kv):
        return F.struct(*[v.alias(k[1:]) for k, v in kv.items()])

    def row(r):
        first = obj(_1=F.lit('Budget amount "changed"'), _2=obj(_3=camp), _5=F.array(
            obj(_1=F.array(F.lit(" ")), _2=obj(_3=F.lit("other\\path"))), obj(_1=F.array(F.lit("x   y")), _2=obj(_3=F.lit("")))))
        second = obj(_1=F.lit("1 keyword added"), _2=obj(_3=camp), _5=F.array(obj(_1=F.array(F.lit(f"[k{r}]")), _2=obj(_3=F.lit("")))))
        return obj(_8=obj(_2=day), _9=F.array(first, second))

    inner = F.to_json(obj(_1=F.array(row(0), row(1))))
    js = F.to_json(F.struct(inner.alias("2")))
    js = F.replace(F.replace(F.replace(js, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("/"), F.lit("\\/"))
    js = F.replace(js, F.lit("{"), F.lit("\\x7b"))
    html = F.concat("html", F.lit("<script>change_history_data['CHANGE_HISTORY_TABLE'] = '"), js, F.lit("';</script>"))
    acts = files.payload_actions(pages.withColumn("html", html), "page_id")
    text = F.array_join(F.transform("details", lambda d: F.concat(d["campaign"], F.lit(": "), d["text"])), ";")
    text = F.when(F.col("summary").startswith("Budget"), F.concat(F.lit("other\\path|"), text)).otherwise(text)
    return acts.withColumn("details", text)


# --- filters -------------------------------------------------------------------------------


@query("f1_active_days", """
SELECT date, campaign, region, keyword, match_type, clicks, round(cost, 6) AS cost FROM active_kw""")
def f1(spark, sf):
    return P.active_days(R.kw_day(spark, sf)).select(
        "date", "campaign", "region", "keyword", "match_type", "clicks", F.round("cost", 6).alias("cost"))


SCOPED = """SELECT date, segment, daily_budget, campaign_version FROM segment_panel
WHERE region <> 'C' AND match_types IN ('Broad', 'Phrase; Exact')"""


@query("f2_training_scope", SCOPED)
def f2(spark, sf):
    out = P.training_scope(R.segment_panel(spark, sf), ["C"], ["Broad", "Phrase; Exact"])
    return out.select("date", "segment", "daily_budget", "campaign_version")


@query("f3_lookback", """
SELECT date, segment, campaign_version, clicks FROM segment_panel WHERE date >= (SELECT max(date) FROM segment_panel) - 120""")
def f3(spark, sf):
    return P.lookback(R.segment_panel(spark, sf), 120).select("date", "segment", "campaign_version", "clicks")


@query("f4_before_date", "SELECT date, campaign_version, clicks FROM panel WHERE date < DATE '1998-06-01'")
def f4(spark, sf):
    return P.before_date(R.panel(spark, sf), "1998-06-01").select("date", "campaign_version", "clicks")


@query("f5_allowlist_sets", """
SELECT keyword_set_id,
  coalesce(string_agg(keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Broad'), '') AS broad_keywords,
  coalesce(string_agg(keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Phrase'), '') AS phrase_keywords,
  coalesce(string_agg(keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Exact'), '') AS exact_keywords,
  string_agg(DISTINCT keyword, '; ' ORDER BY keyword) AS positive_keywords
FROM set_members WHERE keyword IN (SELECT keyword FROM allowlist) GROUP BY keyword_set_id""")
def f5(spark, sf):
    from bidloom.operators import keyword_sets as K
    kept = K.allowed_members(R.set_members(spark, sf), s4(spark, sf))
    return K.member_lists(kept)


@query("f6_observed_keywords", "SELECT DISTINCT keyword FROM kw_day WHERE clicks > 0 AND keyword <> ''")
def f6(spark, sf):
    return P.observed_keywords(R.kw_raw(spark, sf))


@query("f7_usable_rows", """
SELECT date, campaign_version, daily_budget, all_conv FROM panel WHERE region IS NOT NULL AND all_conv > 0""")
def f7(spark, sf):
    rows = R.panel(spark, sf).withColumn("target", F.when(F.col("all_conv") > 0, F.col("all_conv")))
    return P.usable_rows(rows, "target").select("date", "campaign_version", "daily_budget", "all_conv")


F8_SQL = """
WITH wanted AS (SELECT DISTINCT keyword_set_id AS ad_group, upper(match_type) AS match_type, keyword FROM set_members),
have AS (SELECT DISTINCT p_brand AS ad_group, upper(p_name) AS keyword, ['BROAD', 'PHRASE', 'EXACT'][p_partkey % 3 + 1] AS match_type
  FROM part WHERE p_size > 10),
new AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.ad_group = w.ad_group
  AND lower(h.keyword) = lower(w.keyword) AND h.match_type = w.match_type)),
num AS (SELECT *, CAST(row_number() OVER (ORDER BY ad_group, match_type, keyword) AS INTEGER) AS n FROM new)
SELECT 'add' AS change, ad_group, match_type, keyword, n FROM num WHERE n <= 500
UNION ALL SELECT 'remove', h.ad_group, h.match_type, lower(h.keyword), NULL FROM have h LEFT JOIN
  (SELECT * FROM wanted WHERE ad_group <> 'Brand#3') w
  ON h.ad_group = w.ad_group AND lower(h.keyword) = w.keyword AND h.match_type = w.match_type WHERE w.keyword IS NULL"""


@query("f8_keyword_changes", F8_SQL)
def f8(spark, sf):
    from bidloom.operators import keyword_sets as K
    wanted = R.set_members(spark, sf).select(F.col("keyword_set_id").alias("ad_group"), F.upper("match_type").alias("match_type"), "keyword")
    part = R.table(spark, sf, "part").filter("p_size > 10")
    kind = F.when(F.col("p_partkey") % 3 == 0, "BROAD").when(F.col("p_partkey") % 3 == 1, "PHRASE").otherwise("EXACT")
    have = part.select(F.col("p_brand").alias("ad_group"), kind.alias("match_type"), F.upper("p_name").alias("keyword"))
    adds = K.keywords_to_add(wanted, have, limit=500)
    drops = K.keywords_to_remove(wanted.filter("ad_group <> 'Brand#3'"), have)
    return adds.withColumn("change", F.lit("add")).unionByName(
        drops.withColumns({"change": F.lit("remove"), "n": F.lit(None).cast("int")}))


# --- joins ---------------------------------------------------------------------------------


@query("j1_interval_join", """
SELECT d.date, d.campaign, s.campaign_version, s.daily_budget, d.clicks FROM campaign_days d JOIN campaign_summary s
 ON d.campaign = s.campaign AND d.date >= s.start_date AND (s.end_date IS NULL OR d.date < s.end_date)""")
def j1(spark, sf):
    days = P.campaign_days(R.kw_day(spark, sf))
    return P.attach_versions(days, R.campaign_summary(spark, sf)).select("date", "campaign", "campaign_version", "daily_budget", "clicks")


@query("j2_asof_backward", """
SELECT p.event_id, p.slot, b.event_id AS budget_event, b.value AS budget FROM ev p
ASOF LEFT JOIN (SELECT slot, day, event_id, value FROM ev WHERE event_type = 'purchase'
  QUALIFY row_number() OVER (PARTITION BY slot, day ORDER BY event_id DESC) = 1) b
ON p.slot = b.slot AND p.day >= b.day WHERE p.event_type = 'click'""")
def j2(spark, sf):
    ev = _slots(spark, sf)
    probes = ev.filter("event_type = 'click'").select("event_id", "slot", "day")
    history = ev.filter("event_type = 'purchase'").select(
        "slot", "day", F.col("event_id").alias("budget_event"), F.col("value").alias("budget"))
    return J.asof_backward(probes, history, ["slot"], "day", ["budget_event"], ["budget_event", "budget"]).drop("day")


def _slots(spark, sf):
    ev = R.table(spark, sf, "events")
    return ev.select("event_id", "event_type", "value", "ts", (F.col("user_id") % 12).alias("slot"), F.col("ts").cast("date").alias("day"))


@query("j3_asof_forward", """
WITH d AS (SELECT DISTINCT slot, day FROM ev WHERE event_type = 'purchase' AND value > 200),
p AS (SELECT DISTINCT slot, day FROM ev)
SELECT p.slot, p.day, min(d.day) AS next_day FROM p LEFT JOIN d ON d.slot = p.slot AND d.day > p.day GROUP BY ALL""")
def j3(spark, sf):
    from bidloom.operators import history as H
    ev = _slots(spark, sf)
    changes = ev.filter("event_type = 'purchase' AND value > 200").select("slot", "day").distinct()
    return H.next_change_day(ev.select("slot", "day").distinct(), changes, ["slot"], "day", "next_day")


@query("j4_dimension_joins", """
SELECT date, campaign_version, segment, keyword_set_id, round(conv_scaled_clicks, 6) AS conv_scaled_clicks FROM segment_panel""")
def j4(spark, sf):
    return R.segment_panel(spark, sf).select(
        "date", "campaign_version", "segment", "keyword_set_id", F.round("conv_scaled_clicks", 6).alias("conv_scaled_clicks"))


@query("j5_walk_forward", """
SELECT d.date, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS train_rows, round(coalesce(sum(e.y), 0), 6) AS train_target
FROM (SELECT DISTINCT date FROM segment_panel) d LEFT JOIN
  (SELECT date, count(*) AS n, sum(conv_scaled_clicks) AS y FROM segment_panel GROUP BY date) e ON e.date < d.date GROUP BY d.date""")
def j5(spark, sf):
    from bidloom.operators import splits as V
    out = V.walk_forward_totals(R.segment_panel(spark, sf), "conv_scaled_clicks")
    return out.withColumn("train_target", F.round("train_target", 6))


GRID = "SELECT unnest(range(0, 310, 10)) AS b"


@query("j6_decision_grid", f"""
SELECT s.segment, s.keyword_set_id, CAST(d.date AS DATE) AS date, CAST(g.b AS DOUBLE) AS daily_budget
FROM (SELECT DISTINCT segment, keyword_set_id FROM segment_panel) s,
 (SELECT unnest(generate_series(DATE '2001-10-01', DATE '2001-10-14', INTERVAL 1 DAY)) AS date) d, ({GRID}) g""")
def j6(spark, sf):
    from bidloom.operators import planning as O
    candidates = R.segment_panel(spark, sf).select("segment", "keyword_set_id").distinct()
    return O.decision_grid(candidates, "2001-10-01", "2001-10-14", [10.0 * i for i in range(31)])


@query("j7_semi_anti", """
SELECT keyword, TRUE AS allowed FROM (SELECT DISTINCT keyword FROM kw_day) WHERE keyword IN (SELECT keyword FROM allowlist)
UNION ALL SELECT keyword, FALSE FROM (SELECT DISTINCT keyword FROM kw_day) WHERE keyword NOT IN (SELECT keyword FROM allowlist)""")
def j7(spark, sf):
    seen = R.kw_day(spark, sf).select("keyword").distinct()
    allow = s4(spark, sf).select("keyword")
    return seen.join(allow, "keyword", "left_semi").withColumn("allowed", F.lit(True)).unionByName(
        seen.join(allow, "keyword", "left_anti").withColumn("allowed", F.lit(False)))


@query("j8_feed_outer_join", """
WITH c AS (SELECT date, keyword, campaign, match_type, sum(clicks) AS clicks FROM kw_raw WHERE feed = 'F' GROUP BY ALL),
v AS (SELECT date, keyword, campaign, match_type, sum(all_conv) AS all_conv FROM kw_raw WHERE feed = 'O' GROUP BY ALL)
SELECT CASE WHEN clicks IS NULL THEN 'conversions' WHEN all_conv IS NULL THEN 'clicks' ELSE 'both' END AS side,
  CAST(count(*) AS BIGINT) AS n_keys, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, round(coalesce(sum(all_conv), 0), 2) AS all_conv
FROM c FULL JOIN v USING (date, keyword, campaign, match_type) GROUP BY 1""")
def j8(spark, sf):
    clicks, conversions = _feeds(spark, sf)
    c = clicks.groupBy(*feeds.REPORT_KEY).agg(F.sum("clicks").alias("clicks"))
    v = conversions.groupBy(*feeds.REPORT_KEY).agg(F.sum("all_conversions").alias("all_conv"))
    side = F.when(F.col("clicks").isNull(), "conversions").when(F.col("all_conv").isNull(), "clicks").otherwise("both")
    return c.join(v, list(feeds.REPORT_KEY), "full_outer").groupBy(side.alias("side")).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum("clicks"), F.lit(0)).cast("bigint").alias("clicks"),
        F.round(F.coalesce(F.sum("all_conv"), F.lit(0.0)), 2).alias("all_conv"))


@query("j9_override_merge", """
SELECT keyword_set_id, 'base' AS origin, positive_keywords FROM sets_wide WHERE CAST(substr(keyword_set_id, 7) AS INTEGER) <= 15
  AND CAST(substr(keyword_set_id, 7) AS INTEGER) <> 7
UNION ALL SELECT keyword_set_id, 'extended', upper(positive_keywords) FROM sets_wide
  WHERE CAST(substr(keyword_set_id, 7) AS INTEGER) > 15 OR keyword_set_id = 'Brand#7'""")
def j9(spark, sf):
    from bidloom.operators import keyword_sets as K
    sets = K.member_lists(R.set_members(spark, sf)).select("keyword_set_id", "positive_keywords")
    no = F.substring_index("keyword_set_id", "#", -1).cast("int")
    base = sets.filter(no <= 15).withColumn("origin", F.lit("base"))
    ext = sets.filter((no > 15) | (no == 7)).select("keyword_set_id", F.upper("positive_keywords").alias("positive_keywords"), F.lit("extended").alias("origin"))
    return J.override_merge(base, ext, "keyword_set_id")


@query("j10_set_overlap", """
WITH n AS (SELECT keyword_set_id, count(*) AS n FROM set_keywords GROUP BY 1)
SELECT a.keyword_set_id AS set_a, b.keyword_set_id AS set_b, CAST(count(*) AS BIGINT) AS shared,
  CAST(any_value(x.n + y.n) - count(*) AS BIGINT) AS n_union, round(count(*) / (any_value(x.n + y.n) - count(*)), 4) AS jaccard
FROM set_keywords a JOIN set_keywords b ON a.keyword = b.keyword AND a.keyword_set_id < b.keyword_set_id
JOIN n x ON x.keyword_set_id = a.keyword_set_id JOIN n y ON y.keyword_set_id = b.keyword_set_id GROUP BY ALL""")
def j10(spark, sf):
    from bidloom.operators import keyword_sets as K
    out = K.set_overlaps(R.set_members(spark, sf).select("keyword_set_id", "keyword").distinct())
    return out.select("set_a", "set_b", "shared", "n_union", F.round("jaccard", 4).alias("jaccard"))


@query("j10_similar_sets", """
WITH n AS (SELECT keyword_set_id, count(*) AS n FROM set_keywords GROUP BY 1),
c AS (SELECT keyword_set_id, min(keyword_set_id) OVER (PARTITION BY words) AS content FROM (SELECT keyword_set_id, string_agg(keyword, '|' ORDER BY keyword) AS words FROM set_keywords GROUP BY 1)),
o AS (SELECT a.keyword_set_id AS a, b.keyword_set_id AS b, count(*) AS shared FROM set_keywords a JOIN set_keywords b ON a.keyword = b.keyword AND a.keyword_set_id < b.keyword_set_id GROUP BY ALL)
SELECT a, b, CAST(shared AS BIGINT) AS shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM o JOIN n x ON x.keyword_set_id = a JOIN n y ON y.keyword_set_id = b
WHERE a IN (SELECT content FROM c) AND b IN (SELECT content FROM c) AND 100 * shared >= 5 * (x.n + y.n - shared)""")
def j10s(spark, sf):
    from bidloom.operators import set_join as J
    _, contents = J.set_contents(R.set_members(spark, sf).select("keyword_set_id", "keyword").distinct())
    return J.similar_contents(contents, 0.05).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


SPEC_SQL = """
SELECT b AS region, mt AS match_type, 'Course - ' || b || ' - ' || mt || ' - Experiment' AS campaign_name,
 'Ad Group - Course - ' || b || ' - ' || mt || ' - Experiment' AS ad_group_name,
 'Budget - Course - ' || b || ' - ' || mt || ' - Experiment' AS budget_name, n AS n_countries
FROM (SELECT r_name AS b, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1),
 (SELECT unnest(['Broad', 'Phrase; Exact']) AS mt)"""


@query("j11_campaign_specs", SPEC_SQL)
def j11(spark, sf):
    from bidloom.operators import keyword_sets as K
    nation, region = R.table(spark, sf, "nation"), R.table(spark, sf, "region")
    regions = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy(F.col("r_name").alias("region")).agg(
        F.count(F.lit(1)).alias("n_countries"))
    return K.campaign_specs(regions, ["Broad", "Phrase; Exact"], "Course")


@query("j12_plan_rows", """
WITH c AS (SELECT segment, keyword_set_id, max(campaign_version) AS template FROM segment_panel GROUP BY ALL)
SELECT p.date, p.segment, p.keyword_set_id, p.daily_budget, c.template FROM
  (SELECT date, segment, min(daily_budget) AS daily_budget, min(keyword_set_id) AS keyword_set_id FROM segment_panel GROUP BY ALL) p
  JOIN c USING (segment, keyword_set_id)""")
def j12(spark, sf):
    from bidloom.operators import planning as O
    rows = R.segment_panel(spark, sf).groupBy("segment", "keyword_set_id").agg(F.max("campaign_version").alias("template"), F.lit(0.0).alias("daily_budget"))
    return O.rows_at_plan_budgets(daily_plan(spark, sf), rows).select("date", "segment", "keyword_set_id", "daily_budget", "template")


# --- aggregates ----------------------------------------------------------------------------


@query("a1_campaign_day_panel", PANEL_SQL)
def a1(spark, sf):
    return R.panel(spark, sf)


@query("a2_segment_rates", """
SELECT region, match_types, seg_clicks, round(seg_conv, 6) AS seg_conv, round(conv_per_click, 9) AS conv_per_click FROM rates""")
def a2(spark, sf):
    rates = P.segment_rates(R.panel(spark, sf).filter("region IS NOT NULL"))
    return rates.withColumns({"seg_conv": F.round("seg_conv", 6), "conv_per_click": F.round("conv_per_click", 9)})


@query("a3_scaled_target", """
SELECT date, campaign_version, region, match_types, clicks, all_conv, round(conv_scaled_clicks, 6) AS conv_scaled_clicks
FROM segment_panel""")
def a3(spark, sf):
    days = R.panel(spark, sf).filter(F.col("region").isNotNull())
    return P.scaled_target(days, P.segment_rates(days)).select(
        "date", "campaign_version", "region", "match_types", "clicks", "all_conv",
        F.round("conv_scaled_clicks", 6).alias("conv_scaled_clicks"))


@query("a4_conversion_totals", """
SELECT date, keyword, campaign, upper(match_type[1]) || lower(match_type[2:]) AS match_type, round(sum(all_conv), 6) AS all_conv
FROM kw_raw WHERE feed = 'O' GROUP BY ALL""")
def a4(spark, sf):
    return feeds.conversion_totals(_feeds(spark, sf)[1]).withColumn("all_conv", F.round("all_conv", 6))


SEGMENTS = "(SELECT DISTINCT segment FROM segment_panel UNION ALL SELECT 'Nowhere / Broad')"


def _segments(spark, sf, panel):
    return panel.select("segment").distinct().unionByName(spark.sql("SELECT 'Nowhere / Broad' AS segment"))


@query("a8_budget_bounds", f"""
SELECT segment, CAST(0 AS DOUBLE) AS budget_lo, coalesce(max(daily_budget), 500) AS budget_hi FROM {SEGMENTS}
LEFT JOIN segment_panel USING (segment) GROUP BY 1""")
def a8(spark, sf):
    panel = R.segment_panel(spark, sf)
    return P.budget_bounds(panel, _segments(spark, sf, panel))


@query("a9_observed_min_budget", f"""
SELECT segment, coalesce(min(daily_budget), 0) AS min_budget FROM {SEGMENTS} LEFT JOIN segment_panel USING (segment) GROUP BY 1""")
def a9(spark, sf):
    panel = R.segment_panel(spark, sf)
    return P.observed_min_budget(panel, _segments(spark, sf, panel))


@query("a10_day_budget_total", """
SELECT date, round(sum(daily_budget), 6) AS budget_total FROM panel WHERE coalesce(region, '') <> 'C' GROUP BY date""")
def a10(spark, sf):
    return P.day_budget_total(R.panel(spark, sf), ["C"]).withColumn("budget_total", F.round("budget_total", 6))


@query("a11_level_bound", f"""
SELECT segment, round(least(greatest(1.25 * coalesce(max(conv_scaled_clicks), 0), 1), 9), 6) AS level_ub
FROM {SEGMENTS} LEFT JOIN segment_panel USING (segment) GROUP BY 1""")
def a11(spark, sf):
    panel = R.segment_panel(spark, sf)
    out = P.level_upper_bound(panel, _segments(spark, sf, panel), "conv_scaled_clicks", cap=9.0)
    return out.withColumn("level_ub", F.round("level_ub", 6))


@query("a17_distinct_counts", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT date) AS BIGINT) AS n_days,
  CAST(count(DISTINCT segment) AS BIGINT) AS n_segments FROM segment_panel""")
def a17(spark, sf):
    return P.distinct_counts(R.segment_panel(spark, sf))
