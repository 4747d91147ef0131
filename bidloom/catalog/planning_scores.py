"""Queries over splits, planning, scoring and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidloom.catalog import roles as R
from bidloom.catalog.registry import query
from bidloom.catalog.selections import FEATURE_SQL, set_features, rounded, E8_COLS, scoped_summary
from bidloom.config import Validation
from bidloom.functions import calendar as CAL
from bidloom.functions import text as T
from bidloom.operators import panel as P
from bidloom.operators import planning as O
from bidloom.operators import scoring as Q
from bidloom.operators import splits as V
from bidloom.session import cut_lineage

TARGET = "conv_scaled_clicks"
SCOPE = "region <> 'C' AND match_types IN ('Broad', 'Phrase; Exact')"


def scoped(spark, sf):
    return P.training_scope(R.segment_panel(spark, sf), ["C"], ["Broad", "Phrase; Exact"])


SCOPED_SQL = f"sc AS (SELECT * FROM segment_panel WHERE {SCOPE})"


@query("v1_holdout", f"WITH {SCOPED_SQL} SELECT date, segment, campaign_version, date > (SELECT max(date) FROM sc) - 75 AS is_holdout FROM sc")
def v1(spark, sf):
    return V.holdout_flag(scoped(spark, sf), 75).select("date", "segment", "campaign_version", "is_holdout")


FOLDS = f"""{SCOPED_SQL},
dd AS (SELECT date, count(*) AS n, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS nd FROM sc GROUP BY date),
par AS (SELECT nd, CAST(ceil(nd * 0.5) AS BIGINT) AS mt, greatest(21, (nd - CAST(ceil(nd * 0.5) AS BIGINT)) // 3) AS nv FROM dd LIMIT 1),
fd AS (SELECT f + 1 AS fold, CASE WHEN i <= mt + f * nv - 1 THEN 'train' ELSE 'val' END AS role, date, n FROM dd, par p, (SELECT unnest([0, 1, 2]) AS f)
  WHERE i <= least(mt + f * nv - 1 + nv, p.nd - 1) AND f < greatest(1, (p.nd - mt) // nv))"""


@query("v2_fold_days", f"WITH {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, role, date FROM fd")
def v2(spark, sf):
    return V.fold_days(scoped(spark, sf), Validation())


@query("v3_fallback_split", f"WITH {FOLDS} SELECT 1 AS fold, CASE WHEN i <= floor(nd * 0.8) THEN 'train' ELSE 'val' END AS role, date FROM dd")
def v3(spark, sf):
    return V.fallback_days(scoped(spark, sf))


@query("v4_fold_schedule", f"""WITH {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, role, min(date) AS first_date, max(date) AS last_date,
 CAST(count(*) AS BIGINT) AS n_days, CAST(sum(n) AS BIGINT) AS n_rows FROM fd GROUP BY ALL""")
def v4(spark, sf):
    rows = scoped(spark, sf)
    return V.fold_schedule(V.fold_rows(rows, V.fold_days(rows, Validation())))


@query("u5_refit_union", f"WITH {SCOPED_SQL} SELECT date, segment, campaign_version FROM sc")
def u5(spark, sf):
    return V.refit_rows(*V.train_holdout(scoped(spark, sf).select("date", "segment", "campaign_version"), 75))


@query("w12_recency_weights", f"""WITH {SCOPED_SQL}, w AS (SELECT *, exp(-((SELECT max(date) FROM sc) - date) / 90.0) AS w FROM sc)
SELECT date, segment, campaign_version, round(w / (SELECT avg(w) FROM w), 9) AS weight FROM w""")
def w12(spark, sf):
    out = V.recency_weights(scoped(spark, sf), 90.0)
    return out.select("date", "segment", "campaign_version", F.round("weight", 9).alias("weight"))


@query("w13_top_terms", """
SELECT term, value FROM (SELECT p_name AS term, round(avg(p_size) - 25, 6) AS value FROM part GROUP BY 1) ORDER BY abs(value) DESC, term LIMIT 6""")
def w13(spark, sf):
    from bidloom.models.fit import top_terms
    part = R.table(spark, sf, "part")
    return top_terms(part.groupBy(F.col("p_name").alias("term")).agg(F.round(F.avg("p_size") - 25, 6).alias("value")))


def span(df, date="date"):
    """First and last day of a table, as text."""
    lo, hi = df.agg(F.min(date), F.max(date)).first()
    return str(lo), str(hi)


@query("w14_missing_days", """
WITH o AS (SELECT min(date) AS lo, max(date) AS hi FROM segment_panel),
d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM o)
SELECT segment, date FROM (SELECT DISTINCT segment FROM segment_panel) s CROSS JOIN d
WHERE NOT EXISTS (SELECT 1 FROM segment_panel p WHERE p.date = d.date AND p.segment IS NOT DISTINCT FROM s.segment)""")
def w14(spark, sf):
    rows = cut_lineage(R.segment_panel(spark, sf).select("segment", "date").distinct())
    return V.missing_days_of(*span(rows), rows, ["segment"])


@query("w15_week_dates", """
WITH o AS (SELECT min(date) AS lo, max(date) AS hi FROM panel),
w AS (SELECT DISTINCT greatest(CAST(date_trunc('week', d) AS DATE), lo) AS week_start, hi FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d, lo, hi FROM o)),
d AS (SELECT week_start, CAST(unnest(generate_series(week_start, least(week_start + 6, hi), INTERVAL 1 DAY)) AS DATE) AS date FROM w)
SELECT week_start, date, CAST(count(p.date) AS BIGINT) AS n_rows FROM d LEFT JOIN panel p USING (date) GROUP BY ALL""")
def w15(spark, sf):
    panel = R.panel(spark, sf)
    counts = cut_lineage(panel.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows")))
    return V.week_dates(spark, *span(counts)).join(counts, "date", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


# --- response curve ------------------------------------------------------------------------

STEP, CAP, PENALTY = 20.0, 600.0, 0.0001
BUDGETS = [STEP * i for i in range(16)]
PLAN_START, PLAN_END = "2001-10-01", "2001-10-14"
PRICES = [0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.008, 0.012, 0.02]

CURVE_SQL = f"""{SCOPED_SQL},
cf AS (SELECT segment, round(avg({TARGET}) / 40, 6) AS a, round(avg({TARGET}) / sqrt(avg(daily_budget)), 6) AS b, min(daily_budget) AS lo, max(daily_budget) AS hi FROM sc GROUP BY 1),
st AS (SELECT DISTINCT segment, keyword_set_id, CAST(substr(keyword_set_id, 7) AS INTEGER) AS k FROM sc),
pd AS (SELECT CAST(unnest(generate_series(DATE '{PLAN_START}', DATE '{PLAN_END}', INTERVAL 1 DAY)) AS DATE) AS date),
bg AS (SELECT unnest([{', '.join(str(b) for b in BUDGETS)}])::DOUBLE AS budget),
cv AS (SELECT date, segment, keyword_set_id, budget, floor((a * ((k % 7) - 1) * 10 + b * sqrt(budget) * (1 + (k % 5) / 20.0::DOUBLE) * (1 + isodow(date) / 50.0::DOUBLE)) * 10) / 10 AS level
  FROM st JOIN cf USING (segment), pd, bg)"""


def coefficients(rows):
    mean = F.avg(TARGET)
    return rows.groupBy("segment").agg(
        F.round(mean / 40, 6).alias("a"), F.round(mean / F.sqrt(F.avg("daily_budget")), 6).alias("b"))


def curve(spark, sf):
    """Stepped square-root response of each (segment, set) on the planning days and grid budgets."""
    rows = scoped(spark, sf)
    cf = coefficients(rows)
    sets = rows.select("segment", "keyword_set_id").distinct().join(cf, "segment")
    grid = O.decision_grid(sets, PLAN_START, PLAN_END, BUDGETS).withColumnRenamed("daily_budget", "budget")
    k = F.substring("keyword_set_id", 7, 9).cast("int")
    dow = F.weekday("date") + 1
    level = F.col("a") * ((k % 7) - 1) * 10 + F.col("b") * F.sqrt("budget") * (1 + (k % 5) / F.lit(20.0)) * (1 + dow / F.lit(50.0))
    return grid.select("date", "segment", "keyword_set_id", "budget", (F.floor(level * 10) / 10).alias("level"))


@query("o1_candidate_rows", f"""WITH {FEATURE_SQL}, {CURVE_SQL}
SELECT s.segment, s.keyword_set_id, date, split_part(segment, ' / ', 1) AS region, CAST(split_part(segment, ' / ', 2) = 'Broad' AS INTEGER) AS is_broad_match, 0::DOUBLE AS daily_budget,
 dayname(date) AS day_of_week, 'Fall' AS season, embed_course_sim_mean, num_unique_keywords, last_month_searches_mean, competition_index_mean, embed_dispersion_broad
FROM st s CROSS JOIN pd LEFT JOIN feat f ON f.keyword_set_id = s.keyword_set_id""")
def o1(spark, sf):
    rows = scoped(spark, sf)
    cols = ["day_of_week", "season", "embed_course_sim_mean", "num_unique_keywords", "last_month_searches_mean", "competition_index_mean", "embed_dispersion_broad"]
    feats = rounded(set_features(spark, sf), 6, *E8_COLS)
    cal = CAL.planning_calendar(spark, PLAN_START, PLAN_END, ["USA", "A", "B"], R.STARTS)
    out = O.candidate_rows(rows, feats, cal, cols, PLAN_START, PLAN_END)
    return out.select("segment", "keyword_set_id", "date", "region", "is_broad_match", "daily_budget", *cols)


@query("o2_response_curve", f"WITH {CURVE_SQL} SELECT * FROM cv")
def o2(spark, sf):
    return curve(spark, sf)


@query("o3_budget_floor", f"""WITH {CURVE_SQL} SELECT date, segment, keyword_set_id, budget, CASE WHEN round_even(budget + 0.004, 2) + 0.01 < lo THEN 0 ELSE level END AS gated FROM cv JOIN cf USING (segment)""")
def o3(spark, sf):
    rows = scoped(spark, sf)
    low = P.observed_min_budget(rows, rows.select("segment").distinct())
    out = O.apply_budget_floor(curve(spark, sf).withColumn("daily_budget", F.col("budget") + 0.004), low, "level", "gated")
    return out.select("date", "segment", "keyword_set_id", "budget", "gated")


PRUNED_SQL = f"""{CURVE_SQL},
pr AS (SELECT * FROM cv WHERE (segment, keyword_set_id) IN (SELECT (segment, keyword_set_id) FROM cv WHERE budget = 0 GROUP BY segment, keyword_set_id HAVING min(level) >= 0))"""


@query("o4_pruned_sets", f"WITH {PRUNED_SQL} SELECT DISTINCT segment, keyword_set_id FROM pr")
def o4(spark, sf):
    rows = curve(spark, sf).withColumnRenamed("budget", "daily_budget")
    return O.prune_negative_sets(rows).select("segment", "keyword_set_id").distinct()


def fold_sql(source: str, segments: list[str], units: int, prefix: str) -> str:
    """Chain of joins that adds one segment at a time; each step keeps the best value per total."""
    out = [f"{prefix}0 AS (SELECT DISTINCT date, 0 AS s, 0::DOUBLE AS v, CAST([] AS INTEGER[]) AS picks FROM {source})"]
    for i, seg in enumerate(segments):
        out.append(f"""{prefix}{i + 1} AS (SELECT date, s, v, picks FROM (
  SELECT f.date, f.s + c.u AS s, round(f.v + c.w, 9) AS v, list_append(f.picks, c.u) AS picks, row_number() OVER (PARTITION BY f.date, f.s + c.u ORDER BY round(f.v + c.w, 9) DESC, c.u) AS r
  FROM {prefix}{i} f JOIN (SELECT date, CAST(round(budget / {STEP}) AS INTEGER) AS u, round(level - {PENALTY}::DOUBLE * budget, 9) AS w FROM {source} WHERE segment = '{seg}') c USING (date)
  WHERE f.s + c.u <= {units}) WHERE r = 1)""")
    return ",\n".join(out)


SIX = [f"{r} / {m}" for r in ("A", "B", "USA") for m in ("Broad", "Phrase; Exact")]
UNITS = int(CAP / STEP)
FIXED_SQL = f"""{PRUNED_SQL},
fs AS (SELECT segment, min(keyword_set_id) AS keyword_set_id FROM pr GROUP BY 1),
fc AS (SELECT pr.* FROM pr JOIN fs USING (segment, keyword_set_id)),
{fold_sql('fc', SIX, UNITS, 'g')},
opt AS (SELECT date, s, v, picks FROM g6 QUALIFY row_number() OVER (PARTITION BY date ORDER BY v DESC, s) = 1)"""
SIX_SQL = "[" + ", ".join(f"'{s}'" for s in SIX) + "]"


def fixed_curve(spark, sf):
    pruned = O.prune_negative_sets(cut_lineage(curve(spark, sf)).withColumnRenamed("budget", "daily_budget"))
    pruned = pruned.withColumnRenamed("daily_budget", "budget")
    sets = pruned.groupBy("segment").agg(F.min("keyword_set_id").alias("keyword_set_id"))
    return pruned.join(sets, ["segment", "keyword_set_id"], "left_semi")


@query("o5_daily_allocation", f"""WITH {FIXED_SQL},
pk AS (SELECT date, s, v, i, {SIX_SQL}[i] AS segment, picks[i] AS u FROM opt, (SELECT unnest(range(1, 7)) AS i))
SELECT p.date, p.segment, c.keyword_set_id, p.u * {STEP}::DOUBLE AS daily_budget, round(c.level, 6) AS milp_pred, p.s * {STEP}::DOUBLE AS total_budget, round(p.v, 6) AS objective
FROM pk p JOIN fc c ON c.date = p.date AND c.segment = p.segment AND CAST(round(c.budget / {STEP}) AS INTEGER) = p.u""")
def o5(spark, sf):
    return rounded(O.allocate_budgets(fixed_curve(spark, sf), CAP, STEP, PENALTY), 6, "milp_pred", "objective")


SWEEP = f"""{PRUNED_SQL},
pv AS (SELECT date, segment, keyword_set_id, price, max(level - ({PENALTY}::DOUBLE + price) * budget) AS v FROM pr, (SELECT unnest([{', '.join(str(p) for p in PRICES)}])::DOUBLE AS price) GROUP BY ALL),
ps AS (SELECT segment, keyword_set_id, price, round(sum(v), 6) AS v FROM pv GROUP BY ALL),
ch AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY segment, price ORDER BY v DESC, keyword_set_id) = 1),
bd AS (SELECT price, round(sum(v) + price * {CAP}::DOUBLE * 14, 6) AS upper_bound FROM ch GROUP BY 1),
win AS (SELECT segment, keyword_set_id FROM ch WHERE price = (SELECT price FROM bd ORDER BY upper_bound, price LIMIT 1))"""


@query("o6_window_sets", f"""WITH {SWEEP}, wc AS (SELECT pr.* FROM pr JOIN win USING (segment, keyword_set_id)),
{fold_sql('wc', SIX, UNITS, 'h')},
opt AS (SELECT date, s, v, picks FROM h6 QUALIFY row_number() OVER (PARTITION BY date ORDER BY v DESC, s) = 1),
pk AS (SELECT date, {SIX_SQL}[i] AS segment, picks[i] AS u FROM opt, (SELECT unnest(range(1, 7)) AS i))
SELECT p.date, p.segment, w.keyword_set_id, p.u * {STEP}::DOUBLE AS daily_budget, (SELECT round(sum(v), 6) FROM opt) AS plan_value, (SELECT min(upper_bound) FROM bd) AS upper_bound
FROM pk p JOIN win w USING (segment)""")
def o6(spark, sf):
    pruned = O.prune_negative_sets(cut_lineage(curve(spark, sf)).withColumnRenamed("budget", "daily_budget")).withColumnRenamed("daily_budget", "budget")
    return O.select_sets(cut_lineage(pruned), CAP, STEP, PRICES, PENALTY).select(
        "date", "segment", "keyword_set_id", "daily_budget", "plan_value", "upper_bound")


@query("o6_coupled_sets")
def o6c(spark, sf):
    """Sets and budgets of the window under the cap of each day and the regional order, with the gap to the bound."""
    from bidloom.operators.coupled import select_sets_coupled
    pruned = O.prune_negative_sets(cut_lineage(curve(spark, sf)).withColumnRenamed("budget", "daily_budget")).withColumnRenamed("daily_budget", "budget")
    days = [r["date"] for r in pruned.select("date").distinct().collect()]
    return select_sets_coupled(pruned, dict.fromkeys(days, CAP), STEP, penalty=PENALTY).select(
        "date", "segment", "keyword_set_id", "daily_budget", "plan_value", "upper_bound", "gap")


def region_fold(r: str) -> str:
    return fold_sql("fc", [f"{r} / Broad", f"{r} / Phrase; Exact"], UNITS, r.lower())


@query("o7_regional_order", f"""WITH {FIXED_SQL}, {region_fold('USA')}, {region_fold('A')}, {region_fold('B')},
best AS (SELECT u.date, u.s AS su, a.s AS sa, b.s AS sb, round(u.v + a.v + b.v, 9) AS v FROM usa2 u JOIN a2 a ON a.date = u.date AND u.s >= a.s JOIN b2 b ON b.date = u.date AND a.s >= b.s
  WHERE u.s + a.s + b.s <= {UNITS} QUALIFY row_number() OVER (PARTITION BY u.date ORDER BY round(u.v + a.v + b.v, 9) DESC, u.s + a.s + b.s, u.s, a.s, b.s) = 1)
SELECT date, su * {STEP}::DOUBLE AS usa_budget, sa * {STEP}::DOUBLE AS a_budget, sb * {STEP}::DOUBLE AS b_budget, round(v, 6) AS objective FROM best""")
def o7(spark, sf):
    plan = O.allocate_ordered(fixed_curve(spark, sf), CAP, STEP, ("USA", "A", "B"), PENALTY).withColumn("region", T.region_of_segment())
    spend = lambda r: F.sum(F.when(F.col("region") == r, F.col("daily_budget")))
    return plan.groupBy("date").agg(spend("USA").alias("usa_budget"), spend("A").alias("a_budget"), spend("B").alias("b_budget"),
                                    F.round(F.max("objective"), 6).alias("objective"))


DAYPLAN = f"""{SCOPED_SQL},
dp AS (SELECT date, segment, min(daily_budget) AS daily_budget, min(keyword_set_id) AS keyword_set_id, round(sum({TARGET}) * 1.1 + 0.5, 6) AS milp_pred FROM sc GROUP BY ALL)"""


def day_plan(rows):
    return rows.groupBy("date", "segment").agg(
        F.min("daily_budget").alias("daily_budget"), F.min("keyword_set_id").alias("keyword_set_id"),
        F.round(F.sum(TARGET) * 1.1 + 0.5, 6).alias("milp_pred"))


@query("o8_plan_audit", f"""WITH {DAYPLAN}, x AS (SELECT *, split_part(segment, ' / ', 1) AS region FROM dp),
bo AS (SELECT segment, max(daily_budget) - 5 AS hi, min(daily_budget) + 20 AS lo FROM sc GROUP BY 1),
sp AS (SELECT date, sum(daily_budget) FILTER (WHERE region = 'USA') AS u, sum(daily_budget) FILTER (WHERE region = 'A') AS a, sum(daily_budget) FILTER (WHERE region = 'B') AS b FROM x GROUP BY 1)
SELECT date, 'cap' AS rule, 'all' AS subject, round(sum(daily_budget), 6) AS amount FROM x GROUP BY date HAVING sum(daily_budget) > 900.000001
UNION ALL SELECT date, 'bounds', segment, round(daily_budget, 6) FROM x JOIN bo USING (segment) WHERE daily_budget > hi + 0.000001
UNION ALL SELECT date, 'floor', segment, milp_pred FROM x JOIN bo USING (segment) WHERE round(daily_budget, 2) + 0.01 < lo AND milp_pred <> 0
UNION ALL SELECT date, 'order', 'USA >= A', round(a - u, 6) FROM sp WHERE u < a - 0.000001
UNION ALL SELECT date, 'order', 'A >= B', round(b - a, 6) FROM sp WHERE a < b - 0.000001""")
def o8(spark, sf):
    rows = scoped(spark, sf)
    plan = day_plan(rows)
    bounds = rows.groupBy("segment").agg(F.lit(0.0).alias("budget_lo"), (F.max("daily_budget") - 5).alias("budget_hi"))
    low = rows.groupBy("segment").agg((F.min("daily_budget") + 20).alias("min_budget"))
    return O.audit_plan(plan, bounds, low, 900.0, ("USA", "A", "B"))


@query("o9_prediction_check", f"""WITH {DAYPLAN}, lo AS (SELECT segment, min(daily_budget) + 20 AS lo FROM sc GROUP BY 1)
SELECT date, segment, CASE WHEN round(daily_budget, 2) + 0.01 < lo THEN 0 ELSE round(milp_pred * 1.01, 8) END AS external_model_pred,
 abs(milp_pred - CASE WHEN round(daily_budget, 2) + 0.01 < lo THEN 0 ELSE round(milp_pred * 1.01, 8) END) <= 0.05 AS within_tol FROM dp JOIN lo USING (segment)""")
def o9(spark, sf):
    rows = scoped(spark, sf)
    plan = day_plan(rows)
    predicted = plan.select("date", "segment", F.round(F.col("milp_pred") * 1.01, 8).alias("raw_level"))
    low = rows.groupBy("segment").agg((F.min("daily_budget") + 20).alias("min_budget"))
    return O.plan_prediction_check(plan, predicted, low, 0.05).select("date", "segment", "external_model_pred", "within_tol")


@query("o11_fixed_sets", """
SELECT segment, arg_max(keyword_set_id, (date, keyword_set_id)) AS keyword_set_id FROM segment_panel GROUP BY 1""")
def o11(spark, sf):
    return O.fixed_sets(R.segment_panel(spark, sf).select(F.col("date").alias("saved_at"), "segment", "keyword_set_id"))


# --- scoring -------------------------------------------------------------------------------

DECISIONS = """
md AS (SELECT {keys}, median(daily_budget) AS daily_budget FROM segment_panel WHERE region <> 'C' AND match_types IN ('Broad', 'Phrase; Exact') GROUP BY {keys}),
ks AS (SELECT {keys}, keyword_set_id FROM (SELECT {keys}, keyword_set_id, count(*) AS n FROM segment_panel WHERE region <> 'C' AND match_types IN ('Broad', 'Phrase; Exact') GROUP BY {keys}, keyword_set_id)
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, keyword_set_id) = 1)"""


@query("a12_market_decisions", f"WITH {DECISIONS.format(keys='date, region')} SELECT date, region, round(md.daily_budget, 6) AS daily_budget, keyword_set_id FROM md JOIN ks USING (date, region)")
def a12(spark, sf):
    return Q.market_decisions(scoped(spark, sf), ["date", "region"]).select("date", "region", F.round("daily_budget", 6).alias("daily_budget"), "keyword_set_id")


@query("a13_observed_totals", f"""WITH {SCOPED_SQL} SELECT date, region, round(sum({TARGET}), 6) AS observed_conv_scaled_clicks, sum(clicks) AS observed_clicks FROM sc GROUP BY ALL""")
def a13(spark, sf):
    by_segment = Q.observed(scoped(spark, sf), TARGET, ["date", "segment"]).withColumn("region", T.region_of_segment())
    return by_segment.groupBy("date", "region").agg(
        F.round(F.sum(f"observed_{TARGET}"), 6).alias(f"observed_{TARGET}"), F.sum("observed_clicks").alias("observed_clicks"))


def comparison(spark, sf):
    """Plan and market rows of every day, scored by a fixed linear rule."""
    rows = cut_lineage(scoped(spark, sf))
    plan = day_plan(rows).withColumn("pred_level", F.col("milp_pred")).drop("milp_pred")
    market = Q.market_decisions(rows, ["date", "segment"]).drop("campaign_version").withColumn(
        "actual_model_level", F.round(F.col("daily_budget") / 100, 6))
    return Q.plan_vs_actual(plan, market, rows, TARGET)


COMP = f"""{DAYPLAN}, {DECISIONS.format(keys='date, region').replace('md AS', 'rmd AS').replace('ks AS', 'rks AS')},
{DECISIONS.format(keys='date, segment')},
robs AS (SELECT date, region, sum({TARGET}) AS o, sum(clicks) AS c FROM sc GROUP BY ALL), sobs AS (SELECT date, segment, sum({TARGET}) AS o, sum(clicks) AS c FROM sc GROUP BY ALL),
comp AS (SELECT p.date, p.segment, split_part(p.segment, ' / ', 1) AS region, 'plan' AS row_kind, p.daily_budget, p.keyword_set_id, p.milp_pred AS pred_level, NULL::DOUBLE AS actual_model_level,
   m.daily_budget AS actual_budget, k.keyword_set_id AS actual_keyword_set_id, o.o AS observed_conv_scaled_clicks, o.c AS observed_clicks
  FROM dp p JOIN rmd m ON m.date = p.date AND m.region = split_part(p.segment, ' / ', 1) JOIN rks k ON k.date = p.date AND k.region = split_part(p.segment, ' / ', 1)
  JOIN robs o ON o.date = p.date AND o.region = split_part(p.segment, ' / ', 1)
 UNION ALL SELECT m.date, m.segment, split_part(m.segment, ' / ', 1), 'market', m.daily_budget, k.keyword_set_id, NULL, round(m.daily_budget / 100, 6), m.daily_budget, k.keyword_set_id, o.o, o.c
  FROM md m JOIN ks k USING (date, segment) JOIN sobs o USING (date, segment))"""
COMP_COLS = ["date", "segment", "region", "row_kind", "daily_budget", "keyword_set_id", "pred_level", "actual_model_level", "actual_budget", "actual_keyword_set_id", "observed_clicks"]


@query("q1_plan_vs_actual", f"WITH {COMP} SELECT {', '.join(COMP_COLS)}, round(observed_conv_scaled_clicks, 6) AS observed_conv_scaled_clicks FROM comp")
def q1(spark, sf):
    return comparison(spark, sf).select(*COMP_COLS, F.round(f"observed_{TARGET}", 6).alias(f"observed_{TARGET}"))


@query("u1_tagged_union", f"WITH {COMP} SELECT row_kind, CAST(count(*) AS BIGINT) AS n, CAST(count(pred_level) AS BIGINT) AS n_pred, CAST(count(actual_model_level) AS BIGINT) AS n_level FROM comp GROUP BY 1")
def u1(spark, sf):
    return comparison(spark, sf).groupBy("row_kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("pred_level").alias("n_pred"), F.count("actual_model_level").alias("n_level"))


def saved(spark, sf):
    rows = cut_lineage(scoped(spark, sf))
    return Q.saved_plan_vs_actual(day_plan(rows), rows, TARGET)


@query("q2_saved_plan", f"""WITH {COMP} SELECT date, segment, region, daily_budget, 'milp_pred' AS plan_pred_source, pred_level, actual_budget, actual_keyword_set_id,
 round(observed_conv_scaled_clicks, 6) AS observed_conv_scaled_clicks FROM comp WHERE row_kind = 'plan'""")
def q2(spark, sf):
    return saved(spark, sf).select("date", "segment", "region", "daily_budget", "plan_pred_source", "pred_level", "actual_budget", "actual_keyword_set_id",
                                   F.round(f"observed_{TARGET}", 6).alias(f"observed_{TARGET}"))


METRIC_SQL = f"""
pm AS (SELECT date, observed_{TARGET} AS o, pred_level AS p, pred_level - observed_{TARGET} AS e FROM comp WHERE row_kind = 'plan'),
met AS (SELECT date, sqrt(avg(e * e)) AS rmse, avg(e) AS me, sum(p) AS pt, sum(o) AS ot, avg(o) AS mo, CASE WHEN count(*) > 1 AND var_pop(o) > 0 THEN 1 - sum(e * e) / (var_pop(o) * count(*)) END AS r2 FROM pm GROUP BY 1)"""
MET_COLS = "round(rmse, 6) AS rmse_pred_vs_observed, round(me, 6) AS mean_error, round(pt, 6) AS pred_total, round(ot, 6) AS observed_total, round(mo, 6) AS mean_observed_target, round((pt - ot) / ot * 100, 5) AS total_bias_pct, round(rmse / mo, 5) AS nrmse"
R6 = ("rmse_pred_vs_observed", "mean_error", "pred_total", "observed_total", "mean_observed_target")


def _tidy(df):
    return rounded(rounded(df, 6, *R6), 5, "total_bias_pct", "nrmse").drop("r2_pred_vs_observed")


@query("q3_comparison_metrics", f"WITH {COMP}, {METRIC_SQL} SELECT date, {MET_COLS} FROM met")
def q3(spark, sf):
    return _tidy(Q.comparison_metrics(comparison(spark, sf), TARGET))


@query("q4_daily_rollup", f"""WITH {COMP}, {METRIC_SQL} SELECT date, {MET_COLS.replace('AS observed_total', 'AS observed_total')}, t.* EXCLUDE (d) FROM met JOIN (
 SELECT date AS d, CAST(count(*) FILTER (WHERE row_kind = 'plan') AS BIGINT) AS n_segments, round(sum(actual_model_level), 6) AS actual_model_level_total, round(sum(daily_budget) FILTER (WHERE row_kind = 'market'), 6) AS act_budget_total FROM comp GROUP BY 1) t ON t.d = date""")
def q4(spark, sf):
    out = Q.row_metrics(comparison(spark, sf), TARGET)
    return rounded(_tidy(out), 6, "actual_model_level_total", "act_budget_total").drop("pred_level_total", "opt_budget_total", "market_observed_total")


@query("q5_weekly_scores", f"""WITH {COMP}, o AS (SELECT min(date) AS lo, max(date) AS hi FROM comp),
wk AS (SELECT DISTINCT greatest(CAST(date_trunc('week', d) AS DATE), lo) AS week_start, hi FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d, lo, hi FROM o)),
wd AS (SELECT week_start, CAST(unnest(generate_series(week_start, least(week_start + 6, hi), INTERVAL 1 DAY)) AS DATE) AS date FROM wk)
SELECT week_start, segment, round(sum(pred_level), 6) AS pred_level, round(sum(actual_model_level), 6) AS actual_model_level,
 round(sum(observed_{TARGET}), 6) AS observed_{TARGET}, sum(observed_clicks) AS observed_clicks, CAST(count(*) AS BIGINT) AS n_days FROM comp JOIN wd USING (date) GROUP BY 1, 2""")
def q5(spark, sf):
    daily = cut_lineage(comparison(spark, sf))
    weeks = V.week_dates(spark, *span(daily))
    return rounded(Q.weekly_scores(daily, TARGET, weeks), 6, "pred_level", "actual_model_level", f"observed_{TARGET}")


DAILY_SQL = f"""
dt AS (SELECT date AS day, count(*) FILTER (WHERE row_kind = 'plan') AS n_segments, sum(pred_level) AS pl, sum(actual_model_level) AS al,
  sum(daily_budget) FILTER (WHERE row_kind = 'plan') AS ob, sum(daily_budget) FILTER (WHERE row_kind = 'market') AS ab, sum(observed_{TARGET}) FILTER (WHERE row_kind = 'market') AS obs FROM comp GROUP BY 1)"""


@query("a14_day_rollup", f"""WITH {COMP}, {DAILY_SQL} SELECT day, CAST(n_segments AS BIGINT) AS n_segments, round(pl, 6) AS pred_level_total, round(al, 6) AS actual_model_level_total,
 round(ob, 6) AS opt_budget_total, round(ab, 6) AS act_budget_total, round(obs, 6) AS observed_total FROM dt""")
def a14(spark, sf):
    return rounded(Q.daily_totals(comparison(spark, sf), TARGET), 6, "pred_level_total", "actual_model_level_total", "opt_budget_total", "act_budget_total", "observed_total")


SUMMARY_SQL = f"""
sm AS (SELECT count(*) AS n, avg(pl) AS pm, avg(al) AS am, avg(ob) AS om, avg(ab) AS bm, stddev_samp(pl) / sqrt(count(*)) AS ps, stddev_samp(al) / sqrt(count(*)) AS als,
  stddev_samp(ob) / sqrt(count(*)) AS os, stddev_samp(ab) / sqrt(count(*)) AS bs FROM dt),
summ AS (SELECT 'Model' AS scenario, '{TARGET}' AS target, CAST(n AS BIGINT) AS n_days, round(pm, 6) AS conversions, round(ps, 6) AS conversions_se, round(om, 6) AS budget, round(os, 6) AS budget_se,
  round(pm / om, 8) AS conversions_per_dollar, round((pm - am) / am * 100, 5) AS improvement_conversions_pct, round((pm / om - am / bm) / (am / bm) * 100, 5) AS improvement_conversions_per_dollar_pct FROM sm
 UNION ALL SELECT 'Actual', '{TARGET}', n, round(am, 6), round(als, 6), round(bm, 6), round(bs, 6), round(am / bm, 8), NULL, NULL FROM sm)"""


def _summary(df):
    out = rounded(df, 6, "conversions", "conversions_se", "budget", "budget_se")
    return rounded(rounded(out, 8, "conversions_per_dollar"), 5, "improvement_conversions_pct", "improvement_conversions_per_dollar_pct")


@query("q6_backtest_summary", f"WITH {COMP}, {DAILY_SQL}, {SUMMARY_SQL} SELECT * FROM summ")
def q6(spark, sf):
    return _summary(Q.performance_summary(Q.daily_totals(comparison(spark, sf), TARGET), TARGET))


SHARE_SQL = f"""SELECT CASE row_kind WHEN 'plan' THEN 'Model' ELSE 'Actual' END AS scenario, """ + ", ".join(
    f"""round(sum(daily_budget) FILTER (WHERE region = '{r}') / sum(daily_budget), 6) AS "spend_{r}", round(sum(coalesce(pred_level, actual_model_level)) FILTER (WHERE region = '{r}') / sum(coalesce(pred_level, actual_model_level)), 6) AS "conversions_{r}",
 (SELECT round(sum(observed_{TARGET}) FILTER (WHERE region = '{r}') / sum(observed_{TARGET}), 6) FROM comp WHERE row_kind = 'market') AS "observed_{r}" """
    for r in Q.REGIONS) + " FROM comp GROUP BY row_kind"


@query("q7_regional_shares", f"WITH {COMP} {SHARE_SQL}")
def q7(spark, sf):
    cols = [f"{k}_{r}" for r in Q.REGIONS for k in ("spend", "conversions", "observed")]
    return rounded(Q.regional_shares(comparison(spark, sf), TARGET), 6, *cols)


@query("q8_run_analysis", f"""WITH {COMP}, {DAILY_SQL}, {SUMMARY_SQL},
ms AS (SELECT count(*) AS n, string_agg(strftime(d, '%Y-%m-%d'), ', ' ORDER BY d) AS l FROM (SELECT unnest(generate_series(DATE '2000-01-01', DATE '2000-03-31', INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT day FROM dt))
SELECT summ.*, CAST(ms.n AS BIGINT) AS n_missing_days, coalesce(ms.l, '') AS missing_days FROM summ, ms""")
def q8(spark, sf):
    return _summary(Q.analyze_run(spark, comparison(spark, sf), TARGET, "2000-01-01", "2000-03-31")["backtest_summary"])


@query("q9_unscored_days", f"""WITH {DAYPLAN} SELECT DISTINCT date FROM dp WHERE date BETWEEN DATE '2001-10-01' - 400 AND DATE '2001-09-30' AND date NOT IN (SELECT date FROM dp WHERE day(date) % 3 = 0)""")
def q9(spark, sf):
    plans = day_plan(scoped(spark, sf)).select("date").distinct()
    done = plans.filter("day(date) % 3 = 0").withColumnRenamed("date", "score_date")
    return Q.unscored_days(spark, "2001-10-01", 400, plans, done)


@query("q10_monitoring_rows", f"""WITH {COMP}, {METRIC_SQL} SELECT date AS score_date, {MET_COLS}, t.* EXCLUDE (d), '{TARGET}' AS target, 'milp_pred' AS plan_pred_source FROM met JOIN (
 SELECT date AS d, CAST(count(*) AS BIGINT) AS n_segments, round(sum(pred_level), 6) AS pred_level_total, round(sum(actual_budget), 6) AS act_budget_total FROM comp WHERE row_kind = 'plan' GROUP BY 1) t ON t.d = date""")
def q10(spark, sf):
    return rounded(_tidy(Q.monitoring_rows(saved(spark, sf), TARGET)), 6, "pred_level_total", "act_budget_total")


@query("q11_append_metrics", f"""WITH {COMP}, {METRIC_SQL} SELECT date AS score_date, CASE WHEN year(date) < 2000 THEN 'old' ELSE 'new' END AS batch, round(rmse, 6) AS rmse FROM met""")
def q11(spark, sf):
    rows = cut_lineage(Q.monitoring_rows(saved(spark, sf), TARGET).select("score_date", F.round("rmse_pred_vs_observed", 6).alias("rmse")))
    old = rows.filter("year(score_date) < 2000").withColumn("batch", F.lit("old"))
    return Q.append_metrics(old, rows.withColumn("batch", F.lit("new")))


@query("q12_report_lines", f"""WITH {COMP}, {METRIC_SQL} SELECT date AS score_date, '[monitoring] ' || strftime(date, '%Y-%m-%d') || ': observed=' || printf('%.1f', floor(ot) / 10 * 10) || ', pred=' || printf('%.1f', floor(pt)) ||
 ', bias=n/a, RMSE=' || printf('%.1f', floor(rmse)) || ', nRMSE=n/a, segments=' || (SELECT count(*) FROM dp WHERE dp.date = met.date) || ', pred_source=milp_pred' AS line FROM met""")
def q12(spark, sf):
    rows = Q.monitoring_rows(saved(spark, sf), TARGET)
    none = F.lit(None).cast("double")
    whole = {c: F.floor(F.round(c, 9)).cast("double") for c in ("observed_total", "pred_total", "rmse_pred_vs_observed")}
    return Q.report_line(rows.withColumns({**whole, "total_bias_pct": none, "nrmse": none}))


@query("w11_rolling_means", f"""WITH {COMP}, {METRIC_SQL}, w AS (SELECT date, (pt - ot) / ot * 100 AS b, rmse / mo AS n, rmse AS r FROM met)
SELECT date AS score_date, 7 AS window, CAST(count(*) OVER s AS BIGINT) AS n_days, round(avg(b) OVER s, 5) AS mean_bias_pct, round(avg(n) OVER s, 5) AS mean_nrmse, round(avg(r) OVER s, 5) AS mean_rmse FROM w WINDOW s AS (ORDER BY date ROWS 6 PRECEDING)
UNION ALL SELECT date, 30, CAST(count(*) OVER s AS BIGINT), round(avg(b) OVER s, 5), round(avg(n) OVER s, 5), round(avg(r) OVER s, 5) FROM w WINDOW s AS (ORDER BY date ROWS 29 PRECEDING)""")
def w11(spark, sf):
    daily = Q.monitoring_rows(saved(spark, sf), TARGET)
    return rounded(V.rolling_means(cut_lineage(daily)), 5, "mean_bias_pct", "mean_nrmse", "mean_rmse")
