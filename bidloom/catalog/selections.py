"""Queries over keyword features, rankings and candidate sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.catalog import roles as R
from bidloom.catalog.registry import query
from bidloom.functions import text as T
from bidloom.functions.grouped import with_rank
from bidloom.operators import candidates as C
from bidloom.operators import features as FE
from bidloom.operators import keyword_sets as K
from bidloom.operators import panel as P
from bidloom.operators import semantics as E
from bidloom.session import cut_lineage
from bidloom.sources import feeds


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


STAT = """round(avg({c}), 6) AS {c}_mean, round(CASE WHEN count({c}) > 1 THEN stddev_pop({c}) END, 6) AS {c}_std, round(quantile_cont({c}, 0.9), 6) AS {c}_p90"""
STATS_SQL = ", ".join(STAT.format(c=c) for c in K.STATS)
STAT_COLS = [f"{s}_{a}" for s in K.STATS for a in ("mean", "std", "p90")]


@query("a5_set_planner_stats", f"SELECT keyword_set_id, {STATS_SQL} FROM set_keywords JOIN planner_stats USING (keyword) GROUP BY 1")
def a5(spark, sf):
    return rounded(K.set_planner_features(R.set_members(spark, sf), R.planner_stats(spark, sf)), 6, *STAT_COLS)


A6_SQL = ", ".join(
    f"""round(avg({c}) FILTER (WHERE match_type = '{mt}'), 6) AS {mt.lower()}_{c}_mean,
 round(CASE WHEN count(*) FILTER (WHERE match_type = '{mt}') > 1 THEN stddev_pop({c}) FILTER (WHERE match_type = '{mt}') END, 6) AS {mt.lower()}_{c}_std,
 round(quantile_cont({c}, 0.9) FILTER (WHERE match_type = '{mt}'), 6) AS {mt.lower()}_{c}_p90"""
    for mt in T.MATCH_TYPES for c in K.STATS)


@query("a6_match_type_planner_stats", f"SELECT keyword_set_id, {A6_SQL} FROM set_members JOIN planner_stats USING (keyword) GROUP BY 1")
def a6(spark, sf):
    cols = [f"{mt.lower()}_{c}" for mt in T.MATCH_TYPES for c in STAT_COLS]
    return rounded(K.match_type_planner_features(R.set_members(spark, sf), R.planner_stats(spark, sf)), 6, *cols)


@query("a7_match_type_counts", """
SELECT keyword_set_id, b AS n_broad, p AS n_phrase, e AS n_exact, round(b / (b + p + e), 6) AS share_broad, round(p / (b + p + e), 6) AS share_phrase,
 round(e / (b + p + e), 6) AS share_exact FROM (SELECT keyword_set_id, CAST(count(*) FILTER (WHERE match_type = 'Broad') AS INTEGER) AS b,
  CAST(count(*) FILTER (WHERE match_type = 'Phrase') AS INTEGER) AS p, CAST(count(*) FILTER (WHERE match_type = 'Exact') AS INTEGER) AS e FROM set_members GROUP BY 1)""")
def a7(spark, sf):
    return rounded(K.match_type_counts(K.clean_sets(R.keyword_sets_raw(spark, sf))), 6, "share_broad", "share_phrase", "share_exact")


@query("a15_target_set_size", """
WITH s AS (SELECT DISTINCT CASE WHEN campaign LIKE '%- USA -%' THEN 'USA' WHEN campaign LIKE '%- A -%' THEN 'A' WHEN campaign LIKE '%- B -%' THEN 'B' ELSE 'C' END || ' / ' || match_types AS segment, keyword_set_id
  FROM campaign_summary WHERE campaign NOT LIKE '%Other%'), n AS (SELECT keyword_set_id, count(*) AS n FROM set_keywords GROUP BY 1)
SELECT segment, CAST(greatest(5, least(floor(median(n)), 40)) AS INTEGER) AS set_size FROM s JOIN n USING (keyword_set_id) GROUP BY 1""")
def a15(spark, sf):
    summary = P.with_region(R.campaign_summary(spark, sf)).filter("region IS NOT NULL")
    return C.target_set_size(summary, R.set_members(spark, sf), 40, 30)


# --- ranking -------------------------------------------------------------------------------

SCORES = """
scores AS (SELECT region, match_type, keyword, sum(all_conv) AS volume, sum(cost) AS cost FROM kw_day
  WHERE region IS NOT NULL AND keyword IN (SELECT keyword FROM allowlist) GROUP BY ALL HAVING sum(all_conv) > 0.000001),
eff AS (SELECT region, match_type, keyword, round(volume, 6) AS volume, round(round(volume, 6) / greatest(round(cost, 6), 0.01), 12) AS efficiency FROM scores)"""


@query("w1_rank", f"""WITH {SCORES} SELECT region, match_type, keyword, CAST(rank() OVER (PARTITION BY region, match_type ORDER BY volume DESC) AS INTEGER) AS rank_high,
 CAST(rank() OVER (PARTITION BY region, match_type ORDER BY volume) AS INTEGER) AS rank_low FROM eff""")
def w1(spark, sf):
    scores = C.performance_scores(R.kw_words(spark, sf), feeds.ordered_allowlist(R.allowlist_raw(spark, sf)))
    scores = cut_lineage(scores)
    both = with_rank(with_rank(scores, C.POOL, "volume", "rank_high"), C.POOL, "volume", "rank_low", descending=False)
    return both.select(*C.POOL, "keyword", "rank_high", "rank_low")


@query("w2_rank_sum", """
WITH c AS (SELECT label, vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY a DESC) + rank() OVER (PARTITION BY label ORDER BY b DESC) AS s FROM c)
SELECT label, vec_id, CAST(s AS INTEGER) AS rank_sum, CAST(row_number() OVER (PARTITION BY label ORDER BY s, vec_id) AS INTEGER) AS pos FROM r
QUALIFY row_number() OVER (PARTITION BY label ORDER BY s, vec_id) <= 20""")
def w2(spark, sf):
    from bidloom.functions.grouped import top_per_group
    emb = R.table(spark, sf, "embeddings")
    rows = emb.select("label", "vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    out = top_per_group(C.rank_sum(rows, ["label"], "a", "b"), ["label"], [F.col("rank_sum"), F.col("vec_id")], 20, "pos")
    return out.select("label", "vec_id", "rank_sum", "pos")


TOPCONV = f"""{SCORES},
ranked AS (SELECT *, rank() OVER (PARTITION BY region, match_type ORDER BY volume DESC) + rank() OVER (PARTITION BY region, match_type ORDER BY efficiency DESC) AS s FROM eff),
tc AS (SELECT region, match_type, 'top_conv' AS family, keyword, row_number() OVER (PARTITION BY region, match_type ORDER BY s, keyword) AS pos FROM ranked)"""


@query("w3_top_performance", f"""WITH {TOPCONV} SELECT region, match_type, keyword, CAST(pos AS INTEGER) AS pos FROM tc WHERE pos <= 20""")
def w3(spark, sf):
    scores = C.performance_scores(R.kw_words(spark, sf), feeds.ordered_allowlist(R.allowlist_raw(spark, sf)))
    return C.top_by_performance(scores, 20).select(*C.POOL, "keyword", "pos")


POOLS = """
pool AS (SELECT DISTINCT region, match_type, keyword FROM kw_day WHERE region IS NOT NULL AND keyword IN (SELECT keyword FROM allowlist))"""
PAD = """
slots AS (SELECT DISTINCT p.region, p.match_type, f.family FROM pool p, (SELECT DISTINCT family FROM rk) f),
padded AS (SELECT region, match_type, family, keyword, row_number() OVER (PARTITION BY region, match_type, family ORDER BY tier, place) AS pos, tier FROM (
  SELECT region, match_type, family, keyword, 0 AS tier, pos AS place FROM rk WHERE pos <= 40
  UNION ALL SELECT s.region, s.match_type, s.family, a.keyword, 1, a.priority FROM slots s, allowlist a
   WHERE NOT EXISTS (SELECT 1 FROM rk r WHERE r.pos <= 40 AND r.region = s.region AND r.match_type = s.match_type AND r.family = s.family AND r.keyword = a.keyword)))"""


@query("w4_padded_lists", f"""WITH {TOPCONV}, {POOLS}, rk AS (SELECT * FROM tc WHERE pos <= 5), {PAD}
SELECT region, match_type, family, keyword, CAST(pos AS INTEGER) AS pos, tier FROM padded WHERE pos <= 40""")
def w4(spark, sf):
    allow = feeds.ordered_allowlist(R.allowlist_raw(spark, sf))
    day = cut_lineage(C.word_totals(R.kw_words(spark, sf)))
    ranked = C.top_by_performance(C.performance_scores(day, allow), 5).withColumn("family", F.lit("top_conv"))
    return C.pad_lists(ranked, C.pool_keywords(day, allow), ["top_conv"], allow, 40)


@query("w5_allowlist_order", f"""WITH {POOLS} SELECT region, match_type, keyword, CAST(row_number() OVER (PARTITION BY region, match_type ORDER BY priority) AS INTEGER) AS pos
FROM pool JOIN allowlist USING (keyword) QUALIFY row_number() OVER (PARTITION BY region, match_type ORDER BY priority) <= 20""")
def w5(spark, sf):
    allow = feeds.ordered_allowlist(R.allowlist_raw(spark, sf))
    return C.top_by_priority(C.pool_keywords(R.kw_words(spark, sf), allow), allow, 20).select(*C.POOL, "keyword", "pos")


# --- embeddings ----------------------------------------------------------------------------


@query("e1_anchor_similarity", """
SELECT keyword_set_id, round(avg(sim), 6) AS course_sim_mean, round(quantile_cont(sim, 0.9), 6) AS course_sim_p90
FROM vector_sets JOIN anchor_sims USING (keyword) GROUP BY 1""")
def e1(spark, sf):
    f = E.set_semantics(R.vector_sets(spark, sf), R.vectors(spark, sf), R.anchors(spark, sf))
    return f.select("keyword_set_id", F.round("embed_course_sim_mean", 6).alias("course_sim_mean"), F.round("embed_course_sim_p90", 6).alias("course_sim_p90"))


COHESION = """
m AS (SELECT s.keyword_set_id, s.match_type, s.keyword, v.embedding FROM vector_sets s JOIN vectors v USING (keyword))"""


@query("e2_cohesion", f"""WITH {COHESION}
SELECT a.keyword_set_id, round(avg(list_cosine_similarity(a.embedding, b.embedding)), 6) AS cohesion
FROM m a JOIN m b ON a.keyword_set_id = b.keyword_set_id AND a.keyword < b.keyword GROUP BY 1""")
def e2(spark, sf):
    f = E.set_semantics(R.vector_sets(spark, sf), R.vectors(spark, sf), R.anchors(spark, sf))
    return f.select("keyword_set_id", F.round("embed_cohesion", 6).alias("cohesion"))


CENTROID = """
cen AS (SELECT {k}, list(x ORDER BY i) AS c FROM (SELECT {k}, i, avg(embedding[i]) AS x FROM m, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY ALL)"""


@query("e3_dispersion", f"""WITH {COHESION}, {CENTROID.format(k='keyword_set_id')}
SELECT keyword_set_id, round(avg(1 - list_dot_product(embedding, c) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(c, c)) + 1e-12)), 6) AS dispersion
FROM m JOIN cen USING (keyword_set_id) GROUP BY 1""")
def e3(spark, sf):
    f = E.set_semantics(R.vector_sets(spark, sf), R.vectors(spark, sf), R.anchors(spark, sf))
    return f.select("keyword_set_id", F.round("embed_dispersion", 6).alias("dispersion"))


MT_CELLS = ", ".join(
    f"max(round({stat}, 6)) FILTER (WHERE match_type = '{mt}') AS embed_{stat}_{mt.lower()}"
    for mt in T.MATCH_TYPES for stat in ("cohesion", "dispersion", "course_sim_mean", "course_sim_p90"))
MT_STATS = f"""{COHESION}, {CENTROID.format(k='keyword_set_id, match_type')},
coh AS (SELECT a.keyword_set_id, a.match_type, avg(list_cosine_similarity(a.embedding, b.embedding)) AS cohesion
  FROM m a JOIN m b ON a.keyword_set_id = b.keyword_set_id AND a.match_type = b.match_type AND a.keyword < b.keyword GROUP BY ALL),
dis AS (SELECT keyword_set_id, match_type, CASE WHEN count(*) > 1 THEN avg(1 - list_dot_product(embedding, c) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(c, c)) + 1e-12)) END AS dispersion
  FROM m JOIN cen USING (keyword_set_id, match_type) GROUP BY ALL),
sims AS (SELECT keyword_set_id, match_type, avg(sim) AS course_sim_mean, quantile_cont(sim, 0.9) AS course_sim_p90 FROM vector_sets JOIN anchor_sims USING (keyword) GROUP BY ALL),
mt AS (SELECT * FROM sims LEFT JOIN coh USING (keyword_set_id, match_type) LEFT JOIN dis USING (keyword_set_id, match_type))"""
MT_COLS = [f"embed_{stat}_{mt.lower()}" for mt in T.MATCH_TYPES for stat in ("cohesion", "dispersion", "course_sim_mean", "course_sim_p90")]


@query("e4_match_type_semantics", f"WITH {MT_STATS} SELECT keyword_set_id, {MT_CELLS} FROM mt GROUP BY 1")
def e4(spark, sf):
    return rounded(E.match_type_semantics(R.vector_sets(spark, sf), R.vectors(spark, sf), R.anchors(spark, sf)), 6, *MT_COLS)


@query("e5_top_similarity", """
SELECT pool, keyword, CAST(row_number() OVER (PARTITION BY pool ORDER BY round(sim, 9) DESC, keyword) AS INTEGER) AS pos FROM vectors JOIN anchor_sims USING (keyword)
QUALIFY row_number() OVER (PARTITION BY pool ORDER BY round(sim, 9) DESC, keyword) <= 15""")
def e5(spark, sf):
    pool = E.with_anchor_similarity(R.vectors(spark, sf), R.anchors(spark, sf)).withColumn("sim", F.round("sim", 9))
    return E.top_by_similarity(pool, ["pool"], 15).select("pool", "keyword", "pos")


DIST = """
dist AS (SELECT a.pool, a.keyword, coalesce(round(avg(list_distance(a.embedding, b.embedding)), 9), 0) AS d
  FROM vectors a LEFT JOIN vectors b ON a.pool = b.pool AND a.keyword <> b.keyword GROUP BY ALL)"""


@query("e6_composite", f"""WITH {DIST},
r AS (SELECT pool, keyword, d, rank() OVER (PARTITION BY pool ORDER BY sim DESC) + rank() OVER (PARTITION BY pool ORDER BY round(d, 7) DESC) AS s FROM dist JOIN anchor_sims USING (keyword))
SELECT pool, keyword, round(d, 6) AS mean_distance, CAST(s AS INTEGER) AS rank_sum, CAST(row_number() OVER (PARTITION BY pool ORDER BY s, keyword) AS INTEGER) AS pos FROM r
QUALIFY row_number() OVER (PARTITION BY pool ORDER BY s, keyword) <= 15""")
def e6(spark, sf):
    pool = E.with_anchor_similarity(R.vectors(spark, sf), R.anchors(spark, sf))
    out = E.top_by_composite(pool, ["pool"], 15, block_rows=64)
    return out.select("pool", "keyword", F.round("mean_distance", 6).alias("mean_distance"), "rank_sum", "pos")


def greedy_sql(name: str, source: str, keys: str, n: int) -> str:
    """Recursive table (keys, keyword, pos, words, s, u): each step adds the keyword that leaves the list's dispersion largest."""
    on = ", ".join(f"g.{k}" for k in keys.split(", "))
    total, unit = "list_transform(list_zip(g.s, v.embedding), lambda z: z[1] + z[2])", "list_transform(list_zip(g.u, v.embedding), lambda z: z[1] + z[2] / greatest(sqrt(list_dot_product(v.embedding, v.embedding)), 1e-12::DOUBLE))"
    return f"""
{name} AS (
  SELECT {keys}, min(keyword) AS keyword, 1 AS pos, [min(keyword)] AS words, arg_min(embedding, keyword) AS s,
    list_transform(arg_min(embedding, keyword), lambda x: x / greatest(sqrt(list_dot_product(arg_min(embedding, keyword), arg_min(embedding, keyword))), 1e-12::DOUBLE)) AS u
  FROM {source} GROUP BY {keys}
  UNION ALL
  SELECT {keys}, keyword, pos, words, s, u FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY 1 - list_dot_product(u, s) / pos / (pos * (sqrt(list_dot_product(s, s)) / pos + 1e-12::DOUBLE)) DESC, keyword) AS r
    FROM (
      SELECT {on}, v.keyword, g.pos + 1 AS pos, list_append(g.words, v.keyword) AS words, {total} AS s, {unit} AS u
      FROM {name} g JOIN {source} v USING ({keys}) WHERE g.pos < {n} AND NOT list_contains(g.words, v.keyword)))
  WHERE r = 1)"""


@query("e7_greedy_dispersion", f"WITH RECURSIVE {greedy_sql('gd', 'vectors', 'pool', 10)} SELECT pool, keyword, CAST(pos AS INTEGER) AS pos FROM gd")
def e7(spark, sf):
    return E.top_by_dispersion(R.vectors(spark, sf), ["pool"], 10)


E8_COLS = ["embed_cohesion", "embed_dispersion", "embed_course_sim_mean", "embed_course_sim_p90", *STAT_COLS, "share_broad", "share_phrase", "share_exact",
           *[f"{mt.lower()}_{c}" for mt in T.MATCH_TYPES for c in STAT_COLS], *MT_COLS]
FEATURE_SQL = f"""
fx AS (SELECT keyword_set_id, match_type, keyword FROM set_members),
m AS (SELECT f.keyword_set_id, f.match_type, f.keyword, v.embedding FROM fx f JOIN keyword_vectors v USING (keyword)),
mu AS (SELECT DISTINCT keyword_set_id, keyword, embedding FROM m),
{CENTROID.format(k='keyword_set_id, match_type')},
cu AS (SELECT keyword_set_id, list(x ORDER BY i) AS c FROM (SELECT keyword_set_id, i, avg(embedding[i]) AS x FROM mu, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY ALL),
coh AS (SELECT a.keyword_set_id, a.match_type, avg(list_cosine_similarity(a.embedding, b.embedding)) AS cohesion
  FROM m a JOIN m b ON a.keyword_set_id = b.keyword_set_id AND a.match_type = b.match_type AND a.keyword < b.keyword GROUP BY ALL),
cohu AS (SELECT a.keyword_set_id, avg(list_cosine_similarity(a.embedding, b.embedding)) AS embed_cohesion FROM mu a JOIN mu b ON a.keyword_set_id = b.keyword_set_id AND a.keyword < b.keyword GROUP BY ALL),
dis AS (SELECT keyword_set_id, match_type, CASE WHEN count(*) > 1 THEN avg(1 - list_dot_product(embedding, c) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(c, c)) + 1e-12)) END AS dispersion
  FROM m JOIN cen USING (keyword_set_id, match_type) GROUP BY ALL),
disu AS (SELECT keyword_set_id, avg(1 - list_dot_product(embedding, c) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(c, c)) + 1e-12)) AS embed_dispersion FROM mu JOIN cu USING (keyword_set_id) GROUP BY ALL),
sims AS (SELECT keyword_set_id, match_type, avg(sim) AS course_sim_mean, quantile_cont(sim, 0.9) AS course_sim_p90 FROM fx JOIN kv_sims USING (keyword) GROUP BY ALL),
simu AS (SELECT keyword_set_id, avg(sim) AS embed_course_sim_mean, quantile_cont(sim, 0.9) AS embed_course_sim_p90 FROM set_keywords JOIN kv_sims USING (keyword) GROUP BY ALL),
mt AS (SELECT * FROM sims LEFT JOIN coh USING (keyword_set_id, match_type) LEFT JOIN dis USING (keyword_set_id, match_type)),
mtw AS (SELECT keyword_set_id, {MT_CELLS} FROM mt GROUP BY 1),
pl AS (SELECT keyword_set_id, {STATS_SQL} FROM set_keywords JOIN planner_stats USING (keyword) GROUP BY 1),
plm AS (SELECT keyword_set_id, {A6_SQL} FROM set_members JOIN planner_stats USING (keyword) GROUP BY 1),
cnt AS (SELECT keyword_set_id, count(DISTINCT keyword) AS num_unique_keywords, count(*) FILTER (WHERE match_type = 'Broad') AS n_broad,
  count(*) FILTER (WHERE match_type = 'Phrase') AS n_phrase, count(*) FILTER (WHERE match_type = 'Exact') AS n_exact FROM set_members GROUP BY 1),
feat AS (SELECT cnt.*, num_unique_keywords AS n_positive, round(n_broad / (n_broad + n_phrase + n_exact), 6) AS share_broad, round(n_phrase / (n_broad + n_phrase + n_exact), 6) AS share_phrase,
  round(n_exact / (n_broad + n_phrase + n_exact), 6) AS share_exact, round(embed_cohesion, 6) AS embed_cohesion, round(embed_dispersion, 6) AS embed_dispersion,
  round(embed_course_sim_mean, 6) AS embed_course_sim_mean, round(embed_course_sim_p90, 6) AS embed_course_sim_p90,
  pl.* EXCLUDE (keyword_set_id), plm.* EXCLUDE (keyword_set_id), mtw.* EXCLUDE (keyword_set_id)
 FROM cnt LEFT JOIN cohu USING (keyword_set_id) LEFT JOIN disu USING (keyword_set_id) LEFT JOIN simu USING (keyword_set_id)
 LEFT JOIN pl USING (keyword_set_id) LEFT JOIN plm USING (keyword_set_id) LEFT JOIN mtw USING (keyword_set_id))"""


def set_features(spark, sf):
    return FE.set_feature_table(R.set_members(spark, sf), R.planner_stats(spark, sf), R.keyword_vectors(spark, sf), R.anchors(spark, sf))


@query("e8_set_features", f"WITH {FEATURE_SQL} SELECT * FROM feat")
def e8(spark, sf):
    return rounded(set_features(spark, sf), 6, *E8_COLS)


def config():
    from bidloom.config import Config
    return Config(start_dates=R.STARTS)


def modeling_frame(spark, sf):
    """The modelling frame of the given tables; features are stored, the rest is one plan."""
    summary = R.campaign_summary(spark, sf)
    panel = R.panel(spark, sf)
    rates = P.segment_rates(panel.filter("region IS NOT NULL"))
    feats = cut_lineage(rounded(set_features(spark, sf), 6, *E8_COLS))
    return FE.modeling_frame(panel, summary, feats, rates, config(), R.FIRST_YEAR, R.LAST_YEAR)


FRAME_SQL = f"""{FEATURE_SQL},
frame AS (SELECT date, campaign_version, region, match_types, segment, p.keyword_set_id, daily_budget, clicks, all_conv, conv_scaled_clicks,
 CAST(match_types = 'Broad' AS INTEGER) AS is_broad_match, dayname(date) AS day_of_week,
 CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) < 6 THEN 'Spring' WHEN month(date) < 9 THEN 'Summer' ELSE 'Fall' END AS season,
 f.embed_course_sim_mean, f.num_unique_keywords, f.last_month_searches_mean, f.competition_index_mean, f.embed_dispersion_broad, f.embed_dispersion_phrase, f.embed_dispersion_exact
FROM segment_panel p LEFT JOIN feat f ON f.keyword_set_id = p.keyword_set_id WHERE region <> 'C' AND match_types IN ('Broad', 'Phrase; Exact'))"""
FRAME_COLS = ["date", "campaign_version", "region", "match_types", "segment", "keyword_set_id", "daily_budget", "clicks", "all_conv", "is_broad_match",
              "day_of_week", "season", "embed_course_sim_mean", "num_unique_keywords", "last_month_searches_mean", "competition_index_mean",
              "embed_dispersion_broad", "embed_dispersion_phrase", "embed_dispersion_exact"]


@query("e9_modeling_frame", f"WITH {FRAME_SQL} SELECT {', '.join(FRAME_COLS)}, round(conv_scaled_clicks, 6) AS conv_scaled_clicks FROM frame")
def e9(spark, sf):
    return modeling_frame(spark, sf).select(*FRAME_COLS, F.round("conv_scaled_clicks", 6).alias("conv_scaled_clicks"))


# --- candidates ----------------------------------------------------------------------------


def scoped_summary(spark, sf):
    return P.with_region(R.campaign_summary(spark, sf)).filter(
        "region IS NOT NULL AND region <> 'C' AND match_types IN ('Broad', 'Phrase; Exact')")


SEGS = """
ss AS (SELECT CASE WHEN campaign LIKE '%- USA -%' THEN 'USA' WHEN campaign LIKE '%- A -%' THEN 'A' ELSE 'B' END AS region, match_types, keyword_set_id
  FROM campaign_summary WHERE campaign NOT LIKE '%Other%' AND campaign NOT LIKE '%- C -%' AND match_types IN ('Broad', 'Phrase; Exact')),
segs AS (SELECT DISTINCT region || ' / ' || match_types AS segment, region, match_types FROM ss),
sp AS (SELECT *, unnest(string_split(match_types, '; ')) AS match_type FROM segs)"""


@query("c1_pools", f"""WITH {POOLS}, {SEGS} SELECT segment, region, match_type, keyword FROM sp JOIN pool USING (region, match_type)""")
def c1(spark, sf):
    pools = C.segment_pools(C.segments_of(scoped_summary(spark, sf)))
    kws = C.pool_keywords(R.kw_words(spark, sf), feeds.ordered_allowlist(R.allowlist_raw(spark, sf)))
    return pools.join(kws, C.POOL).select("segment", "region", "match_type", "keyword")


HIST = """
hist AS (SELECT DISTINCT region || ' / ' || match_types AS segment, region, match_types, keyword_set_id FROM ss
  WHERE keyword_set_id IN (SELECT keyword_set_id FROM set_keywords WHERE keyword IN (SELECT keyword FROM allowlist)))"""


@query("c2_historical", f"WITH {SEGS}, {HIST} SELECT *, 'historical' AS source FROM hist")
def c2(spark, sf):
    allowed = K.allowed_members(R.set_members(spark, sf), feeds.ordered_allowlist(R.allowlist_raw(spark, sf)))
    return C.historical_candidates(scoped_summary(spark, sf), allowed)


LISTS_SQL = f"""{TOPCONV}, {POOLS}, {SEGS},
wp AS (SELECT DISTINCT p.region, p.match_type, p.keyword FROM pool p JOIN sp USING (region, match_type)),
kv AS (SELECT w.region, w.match_type, w.keyword, k.sim, v.embedding FROM wp w JOIN kv_sims k USING (keyword) JOIN keyword_vectors v USING (keyword)),
kd AS (SELECT a.region, a.match_type, a.keyword, any_value(a.sim) AS sim, coalesce(round(avg(list_distance(a.embedding, b.embedding)), 9), 0) AS d
  FROM kv a LEFT JOIN kv b ON a.region = b.region AND a.match_type = b.match_type AND a.keyword <> b.keyword GROUP BY ALL),
kw AS (SELECT region, match_type, keyword, embedding FROM kv),
{greedy_sql('gk', 'kw', 'region, match_type', 40)},
kr AS (SELECT *, rank() OVER (PARTITION BY region, match_type ORDER BY sim DESC) + rank() OVER (PARTITION BY region, match_type ORDER BY round(d, 7) DESC) AS s FROM kd),
rk AS (SELECT region, match_type, family, keyword, pos FROM tc WHERE (region, match_type) IN (SELECT region, match_type FROM sp)
  UNION ALL SELECT region, match_type, 'allowlist', keyword, row_number() OVER (PARTITION BY region, match_type ORDER BY priority) FROM wp JOIN allowlist USING (keyword)
  UNION ALL SELECT region, match_type, 'semantic', keyword, row_number() OVER (PARTITION BY region, match_type ORDER BY sim DESC, keyword) FROM kv
  UNION ALL SELECT region, match_type, 'dispersion', keyword, pos FROM gk
  UNION ALL SELECT region, match_type, 'composite', keyword, row_number() OVER (PARTITION BY region, match_type ORDER BY s, keyword) FROM kr),
{PAD.replace('FROM pool p,', 'FROM sp p,')},
syn AS (SELECT s.segment, s.region, s.match_types, p.family, c.n, s.match_type, p.keyword FROM sp s JOIN padded p USING (region, match_type), (SELECT unnest([10, 20, 40]) AS n) c WHERE p.pos <= c.n)"""


def _lists(spark, sf, families=C.FAMILIES):
    allow = cut_lineage(feeds.ordered_allowlist(R.allowlist_raw(spark, sf)))
    pools = C.segment_pools(C.segments_of(scoped_summary(spark, sf)))
    day = R.kw_words(spark, sf)
    return pools, C.pool_lists(day, allow, R.keyword_vectors(spark, sf), R.anchors(spark, sf), pools, 40, families)


@query("c3_synthetic_lists", f"WITH RECURSIVE {LISTS_SQL} SELECT segment, family, n, match_type, keyword FROM syn")
def c3(spark, sf):
    pools, lists = _lists(spark, sf)
    return C.synthetic_members(pools, lists, [10, 20, 40]).select("segment", "family", "n", "match_type", "keyword")


@query("c3_dispersion_lists", f"WITH RECURSIVE {LISTS_SQL} SELECT segment, family, n, match_type, keyword FROM syn WHERE family = 'dispersion'")
def c3d(spark, sf):
    pools, lists = _lists(spark, sf, ["dispersion"])
    return C.synthetic_members(pools, lists, [10, 20, 40]).select("segment", "family", "n", "match_type", "keyword")


IDS_SQL = f"""{LISTS_SQL}, {HIST},
fps AS (SELECT segment, region, match_types, family, n, list_position(['allowlist', 'top_conv', 'semantic', 'dispersion', 'composite'], family) - 1 AS f,
   string_agg(DISTINCT keyword, '|' ORDER BY keyword) AS fp FROM syn GROUP BY ALL),
kept AS (SELECT * FROM fps QUALIFY family = 'allowlist' OR row_number() OVER (PARTITION BY segment, n, fp, family = 'allowlist' ORDER BY f) = 1),
hfp AS (SELECT keyword_set_id, string_agg(keyword, '|' ORDER BY keyword) AS fp FROM set_keywords WHERE keyword IN (SELECT keyword FROM allowlist) GROUP BY 1),
known AS (SELECT r.region, h.fp, min(h.keyword_set_id) AS known_id FROM hfp h JOIN (SELECT keyword_set_id, arg_min(region, segment) AS region FROM hist GROUP BY 1) r USING (keyword_set_id) GROUP BY ALL),
pl AS (SELECT k.*, known_id, known_id IS NULL AND row_number() OVER (PARTITION BY k.region, k.fp ORDER BY segment, n, f) = 1 AS is_new FROM kept k LEFT JOIN known USING (region, fp)),
nu AS (SELECT *, sum(CAST(is_new AS INTEGER)) OVER (ORDER BY segment, n, f) AS i FROM pl),
emitted AS (SELECT segment, region, match_types, family, n, f, is_new, 'synthetic_' || family || '_n' || n AS source,
   coalesce(known_id, max(CASE WHEN is_new THEN 'synthetic_' || replace(segment, ' / ', '_') || '_' || family || '_n' || n || '_' || i END) OVER (PARTITION BY region, fp)) AS keyword_set_id FROM nu),
cand AS (SELECT segment, region, match_types, keyword_set_id, source FROM (SELECT segment, region, match_types, keyword_set_id, 'historical' AS source, 0 AS n, 0 AS f FROM hist
   UNION ALL SELECT segment, region, match_types, keyword_set_id, source, n, f FROM emitted) QUALIFY row_number() OVER (PARTITION BY segment, keyword_set_id ORDER BY n, f) = 1)"""


def _build(spark, sf):
    allow = cut_lineage(feeds.ordered_allowlist(R.allowlist_raw(spark, sf)))
    return (*C.build_candidates(scoped_summary(spark, sf), R.kw_words(spark, sf), R.set_members(spark, sf), allow,
                                R.keyword_vectors(spark, sf), R.anchors(spark, sf)), allow)


@query("c4_candidate_ids", f"WITH RECURSIVE {IDS_SQL} SELECT segment, region, match_types, keyword_set_id, source FROM cand")
def c4(spark, sf):
    return _build(spark, sf)[0]


@query("u2_candidate_union", f"WITH RECURSIVE {IDS_SQL} SELECT source, CAST(count(*) AS BIGINT) AS n FROM cand GROUP BY 1")
def u2(spark, sf):
    return _build(spark, sf)[0].groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("p25_synthetic_ids", f"""WITH RECURSIVE {IDS_SQL} SELECT keyword_set_id FROM emitted WHERE is_new""")
def p25(spark, sf):
    cands, extended, _ = _build(spark, sf)
    made = extended.filter(F.col("keyword_set_id").startswith("synthetic_")).select("keyword_set_id")
    return C.unused_index(spark, R.keyword_sets_raw(spark, sf), made)


@query("c5_extended_sets", f"""WITH RECURSIVE {IDS_SQL},
em AS (SELECT e.keyword_set_id, s.match_type, s.keyword FROM syn s JOIN emitted e USING (segment, family, n) WHERE e.is_new
  UNION ALL SELECT keyword_set_id, match_type, keyword FROM set_members WHERE keyword IN (SELECT keyword FROM allowlist))
SELECT keyword_set_id, coalesce(string_agg(DISTINCT keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Broad'), '') AS broad_keywords,
 coalesce(string_agg(DISTINCT keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Phrase'), '') AS phrase_keywords,
 coalesce(string_agg(DISTINCT keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Exact'), '') AS exact_keywords,
 string_agg(DISTINCT keyword, '; ' ORDER BY keyword) AS positive_keywords FROM em GROUP BY 1""")
def c5(spark, sf):
    return _build(spark, sf)[1]


@query("c6_verification", f"""WITH RECURSIVE {IDS_SQL}
SELECT 'missing_source' AS issue, g.segment AS subject, g.source AS detail FROM (SELECT DISTINCT segment, 'synthetic_' || fam || '_n' || n AS source FROM cand,
   (SELECT unnest(['top_conv', 'allowlist']) AS fam), (SELECT unnest([10, 20, 40]) AS n)) g
 WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.segment = g.segment AND c.source = g.source)
UNION ALL SELECT DISTINCT 'off_allowlist', s.keyword_set_id, s.match_type || ': ' || s.keyword FROM set_members s WHERE s.keyword NOT IN (SELECT keyword FROM allowlist)
 AND s.keyword_set_id IN (SELECT keyword_set_id FROM cand) AND s.keyword_set_id IN ('Brand#1', 'Brand#2')
UNION ALL SELECT DISTINCT 'missing_set', keyword_set_id, '' FROM cand WHERE keyword_set_id = 'Brand#4'""")
def c6(spark, sf):
    cands, extended, allow = _build(spark, sf)
    # two sets get their unfiltered lists back and one set is removed, so every rule has work
    raw = K.member_lists(R.set_members(spark, sf)).filter("keyword_set_id IN ('Brand#1', 'Brand#2')")
    broken = extended.filter("keyword_set_id NOT IN ('Brand#1', 'Brand#2', 'Brand#4')").unionByName(raw)
    return C.verify_candidates(cands, broken, allow)
