"""Queries over the change log: events, replay, intervals, keyword-set ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.catalog import roles as R
from bidloom.catalog.registry import query
from bidloom.functions import text as T
from bidloom.functions.grouped import following
from bidloom.operators import history as H
from bidloom.session import cut_lineage, stored_table


def _log(spark, sf):
    acts = cut_lineage(R.change_actions(spark, sf))  # stored once: every event kind reads the log
    return acts, H.read_names(acts)


@query("h1_keyword_events", """
SELECT ord AS "order", day AS date, campaign, keyword, match_type, action, negative FROM kw_ev""")
def h1(spark, sf):
    acts, moves = _log(spark, sf)
    cols = ["order", "date", "campaign", "keyword", "match_type", "action"]
    return H.keyword_events(acts, moves).select(*cols, F.lit(False).alias("negative")).unionByName(
        H.keyword_events(acts, moves, negative=True).select(*cols, F.lit(True).alias("negative")))


@query("h2_budget_events", """
SELECT ord AS "order", day AS date, 'Course - Search - ' || CASE WHEN slot = 9 THEN 'c8' WHEN slot IN (10, 11) THEN 'c0' ELSE 'c' || slot END AS campaign,
  printf('%.2f', floor(value * 100) / 100) AS daily_budget, printf('%.2f', floor(value * 90) / 100) AS previous_budget
FROM ev WHERE event_type = 'purchase'""")
def h2(spark, sf):
    acts, moves = _log(spark, sf)
    return H.budget_events(acts, moves).drop("summary")


@query("h3_status_events", 'SELECT ord AS "order", day AS date, campaign, status FROM status_ev')
def h3(spark, sf):
    acts, moves = _log(spark, sf)
    return H.status_events(acts, moves).drop("summary")


@query("h4_names_over_time", """
SELECT ord AS "order", day AS date, campaign, owner, event_type AS kind FROM named_ev""")
def h4(spark, sf):
    ev = R.table(spark, sf, "events")
    acts, moves = _log(spark, sf)
    slot = F.col("user_id") % 12
    shown = F.when(slot == 9, 8).when(slot.isin(10, 11), 0).otherwise(slot)
    ts = F.col("ts").cast("timestamp")
    rows = ev.select((F.lit(R.MICROS_END) - F.unix_micros(ts)).alias("order"), ts.cast("date").alias("date"),
                     F.concat(F.lit("Course - Search - c"), shown.cast("string")).alias("campaign"), F.col("event_type").alias("kind"))
    return H.with_canonical(H.with_name_then(rows, moves), moves)


@query("h5_change_texts", """
SELECT ord AS "order", day AS date, campaign, string_agg(DISTINCT CASE WHEN negative THEN 'negative_' ELSE '' END || lower(match_type) || '_keyword_' || action, ';') AS change_type,
  '1 ' || lower(any_value(match_type)) || CASE WHEN any_value(negative) THEN ' negative' ELSE '' END || ' keyword ' || CASE any_value(action) WHEN 'add' THEN 'added/enabled' ELSE 'removed/paused' END AS change_summary
FROM kw_ev GROUP BY ord, day, campaign, negative""")
def h5(spark, sf):
    acts, moves = _log(spark, sf)
    return H.describe_keyword_changes(H.keyword_events(acts, moves)).unionByName(
        H.describe_keyword_changes(H.keyword_events(acts, moves, True), True))


# Replay position and heads, stated separately from the DataFrame form.
HEADS = """
heads AS (
  SELECT DISTINCT ord, day, campaign, owner, -ord * 4 + CASE WHEN negative THEN 1 ELSE 0 END AS tick, CAST(NULL AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS s FROM kw_ev
  UNION ALL SELECT ord, day, CASE WHEN owner LIKE '%c8' THEN owner WHEN owner LIKE '%c0' THEN owner ELSE campaign END, owner, -ord * 4 + 2, daily_budget, NULL FROM budget_ev
  UNION ALL SELECT ord, day, campaign, owner, -ord * 4 + 3, NULL, status FROM status_ev),
state AS (SELECT h.*, b.b AS daily_budget, s.s AS status FROM heads h
  ASOF LEFT JOIN (SELECT owner, tick, b FROM heads WHERE b IS NOT NULL) b ON b.owner = h.owner AND h.tick >= b.tick
  ASOF LEFT JOIN (SELECT owner, tick, s FROM heads WHERE s IS NOT NULL) s ON s.owner = h.owner AND h.tick >= s.tick),
ended AS (SELECT *, lead(day) OVER (PARTITION BY campaign ORDER BY day, ord, tick % 4) AS nxt FROM state),
snaps AS (SELECT e.ord, e.day, e.campaign, e.owner, e.tick, e.daily_budget, e.status,
  coalesce(e.nxt, (SELECT max(r.day) FROM renames r WHERE r.previous_name = e.campaign),
   (SELECT min(c.day) FROM cd c WHERE c.campaign = e.campaign AND c.day > e.day)) AS end_date FROM ended e)"""
CHANGE_DAYS = "cd AS (SELECT campaign, day FROM change_days)"


@query("h6_state_budget_status", f"""WITH {CHANGE_DAYS}, {HEADS}
SELECT ord AS "order", day AS date, campaign, owner, tick, daily_budget, status, end_date FROM snaps""")
def h6(spark, sf):
    heads, _ = H.snapshot_heads(*_log(spark, sf))
    return heads.select("order", "date", "campaign", "owner", "tick", "daily_budget", "status", "end_date")


WORDS = """
words AS (SELECT DISTINCT owner, negative, match_type, keyword FROM kw_ev),
kt AS (SELECT owner, negative, match_type, keyword, -ord * 4 + CASE WHEN negative THEN 1 ELSE 0 END AS tick, action FROM kw_ev),
shown AS (SELECT h.owner, h.campaign, h.tick, w.negative, w.match_type, w.keyword FROM heads h JOIN words w ON w.owner = h.owner
  ASOF JOIN kt e ON e.owner = w.owner AND e.negative = w.negative AND e.match_type = w.match_type AND e.keyword = w.keyword AND h.tick >= e.tick
  WHERE e.action = 'add' OR e.tick = h.tick)"""


@query("h6_state_keywords", f"""WITH {CHANGE_DAYS}, {HEADS}, {WORDS}
SELECT campaign, tick, negative, CAST(count(*) AS BIGINT) AS n_keywords, string_agg(keyword, ';' ORDER BY keyword) AS keywords FROM shown GROUP BY ALL""")
def h6k(spark, sf):
    heads, spans = H.snapshot_heads(*_log(spark, sf))
    return H.snapshot_members(heads, spans).withColumn("keywords", F.array_join("keywords", ";"))


FILL = """
own AS (SELECT owner, campaign, tick, string_agg(keyword, '; ' ORDER BY keyword) AS kw FROM (SELECT DISTINCT owner, campaign, tick, keyword FROM shown WHERE NOT negative) GROUP BY ALL),
filled AS (SELECT h.*, coalesce(o.kw,
    first_value(o.kw IGNORE NULLS) OVER (PARTITION BY h.owner ORDER BY h.day, h.ord, h.campaign, h.tick % 4 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(o.kw IGNORE NULLS) OVER (PARTITION BY h.owner ORDER BY h.day, h.ord, h.campaign, h.tick % 4 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS unique_keywords
  FROM snaps h LEFT JOIN own o ON o.owner = h.owner AND o.campaign = h.campaign AND o.tick = h.tick)"""


@query("w9_fill_empty_sets", f"""WITH {CHANGE_DAYS}, {HEADS}, {WORDS}, {FILL}
SELECT ord AS "order", campaign, tick, coalesce(unique_keywords, '') AS unique_keywords FROM filled""")
def w9(spark, sf):
    return H.campaign_snapshots(*_log(spark, sf)).select("order", "campaign", "tick", "unique_keywords")


@query("h7_filled_snapshots", f"""WITH {CHANGE_DAYS}, {HEADS}, {WORDS}, {FILL}
SELECT campaign, CAST(count(*) AS BIGINT) AS n_snapshots, CAST(count(*) FILTER (WHERE unique_keywords IS NULL) AS BIGINT) AS n_empty,
 CAST(sum(len(string_split(unique_keywords, '; '))) AS BIGINT) AS n_words FROM filled GROUP BY campaign""")
def h7(spark, sf):
    snaps = H.campaign_snapshots(*_log(spark, sf))
    words = F.size(T.split_list("unique_keywords"))
    return snaps.groupBy("campaign").agg(
        F.count(F.lit(1)).alias("n_snapshots"), F.count_if(words == 0).alias("n_empty"), F.sum(words).cast("bigint").alias("n_words"))


COVER = """
span AS (SELECT campaign, CASE WHEN campaign LIKE '%c9' THEN 'Course - Search - c8' WHEN campaign LIKE '%c10' OR campaign LIKE '%c11' THEN 'Course - Search - c0' ELSE campaign END AS owner,
   min(date) AS lo, max(date) + 1 AS hi FROM kw_index GROUP BY campaign),
st AS (SELECT DISTINCT campaign, owner, start_date, hi FROM (
  SELECT campaign, owner, lo AS start_date, hi FROM span
  UNION ALL SELECT p.campaign, p.owner, s.day, p.hi FROM span p JOIN snaps s ON s.owner = p.owner AND s.day > p.lo AND s.day < p.hi)),
win AS (SELECT campaign, owner, start_date, coalesce(lead(start_date) OVER (PARTITION BY campaign ORDER BY start_date), hi) AS stop,
  lead(start_date) OVER (PARTITION BY campaign ORDER BY start_date) AS end_date FROM st),
obs AS (SELECT w.campaign, w.start_date, count(*) AS n, string_agg(DISTINCT keyword, '; ' ORDER BY keyword) AS uniq,
  coalesce(string_agg(DISTINCT keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Broad'), '') AS br,
  coalesce(string_agg(DISTINCT keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Phrase'), '') AS ph,
  coalesce(string_agg(DISTINCT keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Exact'), '') AS ex
  FROM win w JOIN kw_index k ON k.campaign = w.campaign AND k.date >= w.start_date AND k.date < w.stop GROUP BY ALL),
lastsnap AS (SELECT owner, day, daily_budget, status, tick, ord FROM snaps QUALIFY row_number() OVER (PARTITION BY owner, day ORDER BY ord DESC, tick DESC) = 1),
prev AS (SELECT owner, day, arg_min(previous_budget, ord) AS pb FROM budget_ev GROUP BY ALL),
kinds AS (SELECT owner, day, string_agg(DISTINCT t, ';' ORDER BY t) AS kinds FROM (
   SELECT owner, day, CASE WHEN negative THEN 'negative_' ELSE '' END || lower(match_type) || '_keyword_' || action AS t FROM kw_ev
   UNION ALL SELECT owner, day, 'daily_budget' FROM budget_ev UNION ALL SELECT owner, day, 'campaign_' || status FROM status_ev) GROUP BY ALL),
cov AS (SELECT w.campaign, w.owner, w.start_date, w.end_date, o.n AS raw_report_row_count, o.uniq, o.br, o.ph, o.ex, coalesce(l.status, '') AS status, l.tick AS log_tick,
  coalesce(l.daily_budget, (SELECT arg_min(p.pb, p.day) FROM prev p WHERE p.owner = w.owner AND p.day >= w.start_date AND p.day <= w.stop)) AS daily_budget,
  coalesce(k.kinds, 'raw_keyword_coverage') AS change_type
 FROM win w JOIN obs o USING (campaign, start_date) ASOF LEFT JOIN lastsnap l ON l.owner = w.owner AND w.start_date >= l.day
 LEFT JOIN kinds k ON k.owner = w.owner AND k.day = w.start_date),
cover AS (SELECT *, CAST(row_number() OVER (ORDER BY campaign, start_date) AS INTEGER) AS campaign_version FROM cov WHERE daily_budget IS NOT NULL)"""


def _coverage(spark, sf):
    # the snapshots feed five joins: written once, by columns, as most of them read no list
    acts, names = _log(spark, sf)
    snaps = stored_table(H.campaign_snapshots(acts, names), "snapshots")
    return H.number_versions(H.coverage_summary(R.change_kw_index(spark, sf), snaps, names))


@query("h8_coverage_versions", f"""WITH {CHANGE_DAYS}, {HEADS}, {COVER}
SELECT campaign_version, campaign, start_date, end_date, status, change_type, daily_budget, CAST(raw_report_row_count AS BIGINT) AS raw_report_row_count,
  uniq AS unique_keywords FROM cover""")
def h8(spark, sf):
    return _coverage(spark, sf).select(
        "campaign_version", "campaign", "start_date", "end_date", "status", "change_type", "daily_budget", "raw_report_row_count", "unique_keywords")


@query("w10_budget_runs", f"""WITH {CHANGE_DAYS}, {HEADS}, {COVER},
flagged AS (SELECT *, CASE WHEN campaign_version % 3 <> 0 THEN change_type ELSE 'daily_budget' END AS ct FROM cover),
runs AS (SELECT *, sum(CASE WHEN ct <> 'daily_budget' THEN 1 ELSE 0 END) OVER (PARTITION BY campaign ORDER BY start_date) AS run FROM flagged),
w AS (SELECT campaign, run, unnest(string_split(uniq, '; ')) AS kw FROM runs),
j AS (SELECT campaign, run, string_agg(DISTINCT kw, '; ' ORDER BY kw) AS unique_keywords FROM w GROUP BY ALL)
SELECT r.campaign_version, r.campaign, r.ct AS change_type, j.unique_keywords FROM runs r JOIN j USING (campaign, run)""")
def w10(spark, sf):
    rows = _coverage(spark, sf).withColumn(
        "change_type", F.when(F.col("campaign_version") % 3 == 0, "daily_budget").otherwise(F.col("change_type")))
    return H.union_budget_runs(rows).select("campaign_version", "campaign", "change_type", "unique_keywords")


@query("h10_set_ids", """
WITH v AS (SELECT campaign_version, keyword_set_id AS b, broad_keywords, phrase_keywords FROM campaign_summary JOIN sets_wide USING (keyword_set_id)),
f AS (SELECT b, min(campaign_version) AS f FROM v GROUP BY b), n AS (SELECT b, row_number() OVER (ORDER BY f) AS n FROM f)
SELECT v.campaign_version, printf('ks_%04d', n) AS keyword_set_id, u.used AS used_by FROM v JOIN n USING (b)
JOIN (SELECT b, string_agg(campaign_version, '; ' ORDER BY campaign_version) AS used FROM v GROUP BY b) u USING (b)""")
def h10(spark, sf):
    keyed, sets = H.assign_set_ids(_versions(spark, sf))
    return keyed.select("campaign_version", "keyword_set_id").join(
        sets.select("keyword_set_id", F.col("used_by_campaign_versions").alias("used_by")), "keyword_set_id")


def _versions(spark, sf):
    from bidloom.operators import keyword_sets as K
    lists = K.member_lists(R.set_members(spark, sf)).withColumnRenamed("positive_keywords", "unique_keywords")
    none = {c: F.lit("") for c in ("negative_broad_keywords", "negative_phrase_keywords", "negative_exact_keywords", "negative_keywords")}
    return R.campaign_summary(spark, sf).join(lists, "keyword_set_id").drop("keyword_set_id").withColumns(none)


@query("h9_version_overlap", """
WITH n AS (SELECT keyword_set_id, count(*) AS n FROM set_keywords GROUP BY 1),
o AS (SELECT a.keyword_set_id AS a, b.keyword_set_id AS b, count(*) AS shared FROM set_keywords a JOIN set_keywords b USING (keyword) GROUP BY ALL)
SELECT x.campaign_version AS version_a, y.campaign_version AS version_b, CAST(nx.n AS BIGINT) AS n_a, CAST(ny.n AS BIGINT) AS n_b, CAST(o.shared AS BIGINT) AS shared,
 round(o.shared / (nx.n + ny.n - o.shared), 4) AS jaccard, round(o.shared / nx.n, 4) AS overlap_a, round(o.shared / ny.n, 4) AS overlap_b
FROM campaign_summary x JOIN campaign_summary y ON x.campaign_version < y.campaign_version AND x.campaign = y.campaign
JOIN o ON o.a = x.keyword_set_id AND o.b = y.keyword_set_id JOIN n nx ON nx.keyword_set_id = x.keyword_set_id JOIN n ny ON ny.keyword_set_id = y.keyword_set_id""")
def h9(spark, sf):
    from bidloom.operators import keyword_sets as K
    versions = R.campaign_summary(spark, sf).select("campaign_version", "campaign", "keyword_set_id")
    return K.version_overlaps(versions, R.set_members(spark, sf).select("keyword_set_id", "keyword").distinct()).select(
        "version_a", "version_b", "n_a", "n_b", "shared", *[F.round(c, 4).alias(c) for c in ("jaccard", "overlap_a", "overlap_b")])


@query("h9_version_changes", """
WITH v AS (SELECT campaign, campaign_version, keyword_set_id, lag(campaign_version) OVER w AS previous_version, lag(keyword_set_id) OVER w AS was
  FROM campaign_summary WINDOW w AS (PARTITION BY campaign ORDER BY start_date, campaign_version)),
l AS (SELECT keyword_set_id, list(DISTINCT keyword) AS words FROM set_keywords GROUP BY 1),
j AS (SELECT v.*, coalesce(a.words, []) AS now, coalesce(b.words, []) AS old FROM v LEFT JOIN l a ON a.keyword_set_id = v.keyword_set_id LEFT JOIN l b ON b.keyword_set_id = v.was WHERE previous_version IS NOT NULL),
s AS (SELECT *, list_sort(list_filter(now, lambda x: list_contains(old, x))) AS kept_words, list_sort(list_filter(now, lambda x: NOT list_contains(old, x))) AS fresh, list_sort(list_filter(old, lambda x: NOT list_contains(now, x))) AS gone FROM j)
SELECT campaign_version, previous_version, CAST(len(now) AS INTEGER) AS n_now, CAST(len(old) AS INTEGER) AS n_before, CAST(len(kept_words) AS INTEGER) AS n_shared,
 round(len(kept_words) / (len(kept_words) + len(fresh) + len(gone)), 6) AS jaccard, array_to_string(kept_words, '; ') AS shared_keywords, array_to_string(fresh, '; ') AS added_keywords, array_to_string(gone, '; ') AS dropped_keywords FROM s""")
def h9c(spark, sf):
    from bidloom.operators import set_join as J
    versions = R.campaign_summary(spark, sf).select("campaign_version", "campaign", "keyword_set_id", "start_date")
    out = J.version_changes(versions, R.set_members(spark, sf).select("keyword_set_id", "keyword").distinct())
    return out.drop("campaign").withColumn("jaccard", F.round("jaccard", 6))


@query("h11_keyword_audit", """
WITH v AS (SELECT campaign_version, campaign, start_date, end_date, keyword_set_id FROM campaign_summary),
r AS (SELECT campaign_version, keyword FROM v JOIN active_kw k ON k.campaign = v.campaign AND k.date >= v.start_date AND (v.end_date IS NULL OR k.date < v.end_date) GROUP BY ALL),
l AS (SELECT campaign_version, keyword FROM v JOIN set_keywords USING (keyword_set_id))
SELECT v.keyword_set_id, v.campaign_version, v.campaign,
 coalesce((SELECT string_agg(keyword, '; ' ORDER BY keyword) FROM r WHERE r.campaign_version = v.campaign_version), '') AS raw_unique_keywords,
 coalesce((SELECT string_agg(r.keyword, '; ' ORDER BY r.keyword) FROM r LEFT JOIN l ON l.campaign_version = r.campaign_version AND l.keyword = r.keyword
   WHERE r.campaign_version = v.campaign_version AND l.keyword IS NULL), '') AS raw_keywords_not_in_change_history,
 coalesce((SELECT string_agg(l.keyword, '; ' ORDER BY l.keyword) FROM l LEFT JOIN r ON l.campaign_version = r.campaign_version AND l.keyword = r.keyword
   WHERE l.campaign_version = v.campaign_version AND r.keyword IS NULL), '') AS change_history_keywords_not_in_raw
FROM v""")
def h11(spark, sf):
    from bidloom.operators import panel as P
    summary = _versions(spark, sf)
    ids = R.campaign_summary(spark, sf).select("campaign_version", "keyword_set_id")
    index = H.keyword_day_index(P.active_days(R.kw_day(spark, sf)))
    rows = H.enrich_with_report(summary, index).join(ids, "campaign_version")
    return H.audit_rows(rows).drop("change_history_unique_keywords", "start_date", "end_date")


@query("h12_change_dates", "SELECT campaign, day AS date FROM change_days")
def h12(spark, sf):
    acts, moves = _log(spark, sf)
    return H.change_dates(acts, moves)


@query("a16_window_keywords", """
SELECT s.campaign_version, CAST(count(*) AS BIGINT) AS raw_report_row_count, string_agg(DISTINCT keyword, '; ' ORDER BY keyword) AS unique_keywords
FROM campaign_summary s JOIN kw_day k ON k.campaign = s.campaign AND k.date >= s.start_date AND (s.end_date IS NULL OR k.date < s.end_date) GROUP BY 1""")
def a16(spark, sf):
    versions = R.campaign_summary(spark, sf).select("campaign", "start_date", "end_date", "campaign_version")
    words = H.daily_words(H.keyword_day_index(R.kw_day(spark, sf)))
    return H.window_words(words, versions.drop("campaign_version")).join(
        versions.select("campaign", "start_date", "campaign_version"), ["campaign", "start_date"]).select(
        "campaign_version", "raw_report_row_count", "unique_keywords")


@query("w6_final_budget", """
SELECT day AS date, slot, arg_max(value, ts) AS value FROM ev WHERE event_type = 'purchase' GROUP BY ALL""")
def w6(spark, sf):
    ev = R.table(spark, sf, "events").filter("event_type = 'purchase'")
    rows = ev.select((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("order"), F.col("ts").cast("date").alias("date"),
                     (F.col("user_id") % 12).alias("campaign"), "value")
    return H.final_per_day(rows).select("date", F.col("campaign").alias("slot"), "value")


@query("w7_dedupe_actions", """
SELECT min(ord) AS "order", day AS date, slot, k, event_type FROM ev GROUP BY day, slot, k, event_type""")
def w7(spark, sf):
    ev = R.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    acts = ev.select(
        (F.lit(R.MICROS_END) - F.unix_micros(ts)).alias("order"), ts.cast("date").alias("date"), ts.cast("date").cast("string").alias("date_text"),
        F.concat(F.lit("c"), (F.col("user_id") % 12).cast("string")).alias("campaign"), F.col("event_type").alias("summary"),
        F.array(F.struct(F.lit("").alias("campaign"), F.concat(F.lit(" k "), k.cast("string")).alias("text"))).alias("details"))
    out = H.dedupe_actions(acts)
    return out.select("order", "date", F.substring("campaign", 2, 9).cast("bigint").alias("slot"),
                      F.regexp_extract(F.col("details")[0]["text"], r"(\d+)", 1).cast("int").alias("k"), F.col("summary").alias("event_type"))


@query("w8_interval_ends", """
SELECT event_id, lead(day) OVER (PARTITION BY slot ORDER BY day, event_id) AS end_date FROM ev""")
def w8(spark, sf):
    ev = R.table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"), (F.col("user_id") % 12).alias("slot"))
    return following(ev, ["slot"], "day", ["event_id"], "day", "end_date").select("event_id", "end_date")


@query("u3_keyword_differences", """
WITH r AS (SELECT DISTINCT region, keyword FROM kw_day WHERE match_type = 'Broad' AND region IS NOT NULL),
l AS (SELECT DISTINCT region, keyword FROM kw_day WHERE match_type = 'Exact' AND region IS NOT NULL)
SELECT region, keyword, 'raw_only' AS side FROM (SELECT * FROM r EXCEPT SELECT * FROM l)
UNION ALL SELECT region, keyword, 'log_only' FROM (SELECT * FROM l EXCEPT SELECT * FROM r)""")
def u3(spark, sf):
    from bidloom.operators import keyword_sets as K
    seen = cut_lineage(R.kw_words(spark, sf).groupBy("region", "match_type", "keyword").agg(F.count("region").alias("_known")).filter("_known > 0").drop("_known"))
    pick = lambda mt: seen.filter(F.col("match_type") == mt).select("region", "keyword")
    return K.keyword_differences(pick("Broad"), pick("Exact"), ["region"])


@query("u4_set_similarity", """
WITH n AS (SELECT keyword_set_id, count(*) AS n FROM set_keywords GROUP BY 1)
SELECT a.keyword_set_id AS set_a, b.keyword_set_id AS set_b, round(count(*) / any_value(x.n), 4) AS overlap_a, round(count(*) / any_value(y.n), 4) AS overlap_b
FROM set_keywords a JOIN set_keywords b ON a.keyword = b.keyword AND a.keyword_set_id < b.keyword_set_id
JOIN n x ON x.keyword_set_id = a.keyword_set_id JOIN n y ON y.keyword_set_id = b.keyword_set_id GROUP BY ALL""")
def u4(spark, sf):
    from bidloom.operators import keyword_sets as K
    out = K.set_overlaps(R.set_members(spark, sf).select("keyword_set_id", "keyword").distinct())
    return out.select("set_a", "set_b", F.round("overlap_a", 4).alias("overlap_a"), F.round("overlap_b", 4).alias("overlap_b"))
