"""The domain views of ``roles`` in SQL, composed into WITH clauses on demand."""

from __future__ import annotations

import re

from bidloom.catalog.roles import ANCHOR_IDS, MICROS_END, STARTS

WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean_kw(x: str) -> str:
    inner = f"translate(coalesce({x}, ''), '''\"+[]', '')"
    return f"lower(trim(regexp_replace({inner}, '[{WS}]+', ' ', 'g')))"


def fill(name: str, value: str) -> str:
    return f"coalesce({name}, {value})"


def seg_region(x: str) -> str:
    return f"split_part({x}, ' / ', 1)"


REGION_CASE = """CASE r_name WHEN 'AMERICA' THEN 'USA' WHEN 'EUROPE' THEN 'A' WHEN 'ASIA' THEN 'B'
 WHEN 'AFRICA' THEN 'C' ELSE 'Other' END"""
KIND_CASE = "CASE l_returnflag WHEN 'R' THEN 'Broad' WHEN 'A' THEN 'Phrase' ELSE 'Exact' END"
PART_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'Broad' WHEN 1 THEN 'Phrase' ELSE 'Exact' END"
STARTS_SQL = ", ".join(f"DATE '{s}'" for s in STARTS)
ANCHORS_SQL = ", ".join(str(a) for a in ANCHOR_IDS)

ROLES: dict[str, str] = {
    "kw_raw": f"""
SELECT CAST(l_shipdate AS DATE) AS date,
  CASE l_returnflag WHEN 'R' THEN '+' || replace(p_name, ' ', ' +') WHEN 'A' THEN '"' || p_name || '"'
    ELSE '[' || p_name || ']' END AS keyword,
  'Course - Run 1 - Search - ' || {REGION_CASE} || ' - ' || {KIND_CASE} || ' [old]' AS campaign,
  upper({KIND_CASE}) AS match_type, l_quantity AS clicks,
  floor(l_extendedprice * l_tax) / 100 AS cost, round(l_quantity * l_discount, 2) AS all_conv,
  'USD' AS currency_code, p_size / 10.0::DOUBLE AS first_page_cpc, l_linestatus AS feed
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey""",
    "kw_day": f"""
SELECT date,
  CASE split_part(campaign, ' - ', 4) WHEN 'Other' THEN NULL ELSE split_part(campaign, ' - ', 4) END AS region,
  {clean_kw('keyword')} AS keyword, trim(replace(campaign, '[old]', '')) AS campaign,
  upper(match_type[1]) || lower(match_type[2:]) AS match_type, CAST(clicks AS BIGINT) AS clicks,
  cost, all_conv, currency_code, first_page_cpc
FROM kw_raw""",
    "quarters": """
SELECT r_name, r_regionkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start_date,
  round(avg(o_totalprice) / 1000, 2) AS budget
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "campaign_summary": f"""
SELECT CAST(r_regionkey * 10000 + q * 10 + k AS BIGINT) AS campaign_version,
  'Brand#' || (1 + (q * 3 + k + r_regionkey * 7) % 25) AS keyword_set_id,
  'Course - Run 1 - Search - ' || {REGION_CASE} || ' - ' || ['Broad', 'Phrase', 'Exact'][k + 1] AS campaign,
  start_date, end_date, round(budget + 10 * k, 2) AS daily_budget,
  ['Broad', 'Phrase; Exact', 'Exact'][k + 1] AS match_types
FROM (SELECT *, (year(start_date) - 1990) * 4 + quarter(start_date) AS q,
        lead(start_date) OVER (PARTITION BY r_name ORDER BY start_date) AS end_date FROM quarters),
     (SELECT unnest([0, 1, 2]) AS k)""",
    "active_kw": """
SELECT * FROM kw_day QUALIFY sum(cost) OVER (PARTITION BY date, campaign) > 0.000001""",
    "campaign_days": """
SELECT date, campaign, region, CAST(sum(clicks) AS BIGINT) AS clicks, sum(cost) AS cost, sum(all_conv) AS all_conv
FROM active_kw GROUP BY ALL""",
    "panel": """
SELECT date, campaign_version, region, daily_budget, match_types, clicks,
  round(cost, 2) AS cost, round(coalesce(all_conv, 0), 4) AS all_conv
FROM campaign_days d JOIN campaign_summary s ON d.campaign = s.campaign AND d.date >= s.start_date
  AND (s.end_date IS NULL OR d.date < s.end_date)""",
    "rates": """
SELECT region, match_types, CAST(sum(clicks) AS DOUBLE) AS seg_clicks, sum(all_conv) AS seg_conv,
  sum(all_conv) / sum(clicks) AS conv_per_click
FROM panel WHERE region IS NOT NULL GROUP BY ALL""",
    "segment_panel": """
SELECT p.date, p.campaign_version, p.region, p.daily_budget, p.match_types, CAST(p.clicks AS DOUBLE) AS clicks,
  p.cost, p.all_conv, p.clicks * coalesce(r.conv_per_click, (SELECT avg(conv_per_click) FROM rates)) AS conv_scaled_clicks,
  p.region || ' / ' || p.match_types AS segment, s.keyword_set_id
FROM panel p LEFT JOIN rates r USING (region, match_types)
LEFT JOIN campaign_summary s ON p.campaign_version = s.campaign_version WHERE p.region IS NOT NULL""",
    "set_members": f"""
SELECT DISTINCT p_brand AS keyword_set_id, {PART_KIND} AS match_type, lower(p_name) AS keyword FROM part""",
    "set_keywords": """SELECT DISTINCT keyword_set_id, keyword FROM set_members""",
    "sets_wide": """
SELECT keyword_set_id,
  coalesce(string_agg(keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Broad'), '') AS broad_keywords,
  coalesce(string_agg(keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Phrase'), '') AS phrase_keywords,
  coalesce(string_agg(keyword, '; ' ORDER BY keyword) FILTER (WHERE match_type = 'Exact'), '') AS exact_keywords,
  string_agg(DISTINCT keyword, '; ' ORDER BY keyword) AS positive_keywords
FROM set_members GROUP BY keyword_set_id""",
    "planner_stats": """
SELECT lower(p_name) AS keyword, CAST(sum(p_size) AS DOUBLE) AS last_month_searches, avg(p_size) AS competition_index,
  min(p_retailprice) AS bid_low FROM part GROUP BY 1""",
    "allowlist": """
SELECT keyword, CAST(row_number() OVER (ORDER BY enrollments DESC, keyword) AS INTEGER) AS priority FROM (
  SELECT lower(p_name) AS keyword, count(l_partkey) AS enrollments FROM part LEFT JOIN lineitem ON l_partkey = p_partkey
  GROUP BY 1 HAVING min(p_partkey) % 5 <> 0)""",
    "vectors": """
SELECT printf('kw%05d', vec_id) AS keyword, label AS pool, vec_id, embedding::DOUBLE[] AS embedding FROM embeddings""",
    "anchors": f"SELECT * FROM vectors WHERE vec_id IN ({ANCHORS_SQL})",
    "anchor_sims": """
SELECT v.keyword, max(list_dot_product(v.embedding, a.embedding)) AS sim
FROM vectors v, anchors a GROUP BY v.keyword""",
    "vector_sets": """
SELECT 'set_' || pool || '_' || (vec_id % 3) AS keyword_set_id,
  CASE WHEN vec_id % 5 = 0 THEN 'Broad' WHEN vec_id % 2 = 0 THEN 'Phrase' ELSE 'Exact' END AS match_type, keyword
FROM vectors""",
    "keyword_vectors": """
SELECT n.keyword, v.embedding FROM (SELECT lower(p_name) AS keyword, min(p_partkey) AS k FROM part GROUP BY 1) n
JOIN vectors v ON v.vec_id = n.k""",
    "kv_sims": """
SELECT v.keyword, max(list_dot_product(v.embedding, a.embedding)) AS sim
FROM keyword_vectors v, anchors a GROUP BY v.keyword""",
    "ev": f"""
SELECT *, {MICROS_END} - epoch_us(ts) AS ord, CAST(ts AS DATE) AS day, user_id % 12 AS slot,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 7 = 0 AS negative FROM events""",
    "renames": f"""
SELECT {MICROS_END} - moved AS ord, CAST(make_timestamp(moved) AS DATE) AS day, 'Course - Search - ' || old AS previous_name,
  'Course - Search - ' || new AS current_name
FROM (SELECT lo + CAST(floor((hi - lo) * share / 10) AS BIGINT) AS moved, old, new
  FROM (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
  (VALUES (5, 'c9', 'c8'), (6, 'c10', 'c11'), (8, 'c11', 'c0')) t(share, old, new))""",
    "named_ev": """
SELECT ev.*, 'Course - Search - ' || CASE
    WHEN slot IN (8, 9) THEN CASE WHEN ord > (SELECT ord FROM renames WHERE current_name LIKE '%c8') THEN 'c9' ELSE 'c8' END
    WHEN slot IN (0, 10, 11) THEN CASE
      WHEN ord > (SELECT ord FROM renames WHERE current_name LIKE '%c11') THEN 'c10'
      WHEN ord > (SELECT ord FROM renames WHERE current_name LIKE '%c0') THEN 'c11' ELSE 'c0' END
    ELSE 'c' || slot END AS campaign,
  'Course - Search - ' || CASE WHEN slot IN (8, 9) THEN 'c8' WHEN slot IN (0, 10, 11) THEN 'c0' ELSE 'c' || slot END AS owner
FROM ev""",
    "kw_ev": """
SELECT ord, day, campaign, owner, negative, CASE k % 3 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Phrase' ELSE 'Broad' END AS match_type,
  'k' || k || ' word' AS keyword, CASE event_type WHEN 'signup' THEN 'add' ELSE 'remove' END AS action
FROM named_ev WHERE event_type IN ('signup', 'error')""",
    "budget_ev": """
SELECT ord, day, campaign, owner, printf('%.2f', floor(value * 100) / 100) AS daily_budget,
  printf('%.2f', floor(value * 90) / 100) AS previous_budget
FROM named_ev WHERE event_type = 'purchase'""",
    "status_ev": """
SELECT ord, day, campaign, owner, CASE event_type WHEN 'click' THEN 'active' ELSE 'paused' END AS status
FROM named_ev WHERE event_type IN ('click', 'view')""",
    "change_days": """
SELECT DISTINCT campaign, day FROM named_ev UNION SELECT current_name, day FROM renames""",
    "kw_index": f"""
SELECT 'Course - Search - c' || (l_suppkey % 12) AS campaign,
  CAST(DATE '2023-12-25' + CAST(dayofyear(l_shipdate) % 45 AS INTEGER) AS DATE) AS date, lower(p_name) AS keyword,
  {KIND_CASE} AS match_type
FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def compose(sql: str) -> str:
    """Prefix a statement with every role view it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in ROLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(ROLES[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({ROLES[n].strip()})" for n in needed)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"^WITH(\s+RECURSIVE)?\s+", "", body, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{body}"
    return f"WITH {head}\n{body}"
