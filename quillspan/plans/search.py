"""Queries over search rows, keywords, actions and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspan.functions.numbers import half_up_sql as R
from quillspan.operators import search as S
from quillspan.sources import sinks
from quillspan.sources.fixtures import oracle, view

TODAY = dt.date(2024, 1, 31)
NOW = "dt > DATE '2024-01-21' AND dt <= DATE '2024-01-28'"
BEFORE = "dt > DATE '2024-01-14' AND dt <= DATE '2024-01-21'"


def _best(name: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT site_id, query, page, position, impressions, clicks, event_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id, query ORDER BY position, event_id) AS rn FROM fx_search WHERE {where}) WHERE rn = 1)"


CHANGES = f", {_best('cur', NOW)}, {_best('prv', BEFORE)}, chg AS (SELECT cur.*, prv.position AS previous_position FROM cur LEFT JOIN prv USING (site_id, query))"
BUCKETS = (
    "count(*) FILTER (current_position <= 3) AS top_3, count(*) FILTER (current_position > 3 AND current_position <= 10) AS top_4_10, "
    "count(*) FILTER (current_position > 10 AND current_position <= 20) AS top_11_20, count(*) FILTER (current_position > 20 AND current_position <= 50) AS top_21_50, count(*) FILTER (current_position > 50) AS beyond_50"
)
MEANS = f"{R('avg(current_position)', 1)} AS avg_position, {R('avg(previous_position)', 1)} AS prev_avg_position, coalesce({R('avg(previous_position) - avg(current_position)', 1)}, 0.0) AS position_delta"
CANDIDATES = CHANGES + """
, base AS (SELECT chg.*, CASE WHEN k.search_volume > 0 THEN k.search_volume ELSE chg.impressions END AS volume, chg.position - chg.previous_position AS loss
           FROM chg LEFT JOIN fx_keywords k ON chg.site_id = k.site_id AND chg.query = k.keyword)
, opt AS (SELECT 'optimize' AS action_type, site_id, query AS keyword, page, position AS current_position, previous_position, impressions, volume AS search_volume, volume * loss AS impact_score, 0.04::DOUBLE AS estimated_api_cost FROM base WHERE loss >= 3)
, cre AS (SELECT 'create' AS action_type, site_id, query AS keyword, page, position AS current_position, previous_position, impressions, volume AS search_volume, volume * (position / 10.0::DOUBLE) AS impact_score, 0.03::DOUBLE AS estimated_api_cost FROM base b
          WHERE position > 20 AND impressions > 50 AND NOT EXISTS (SELECT 1 FROM opt WHERE opt.site_id = b.site_id AND opt.keyword = b.query))
, cand AS (SELECT * FROM opt UNION ALL SELECT * FROM cre)
, dv AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY site_id ORDER BY impact_score DESC, keyword) AS rank FROM
         (SELECT *, row_number() OVER (PARTITION BY site_id, page ORDER BY impact_score DESC, keyword) AS n FROM cand) WHERE n <= 3)
"""


def _v(name):
    return lambda spark, d: view(spark, d, name)


_search, _kw, _sites, _pages, _actions = map(_v, ("fx_search", "fx_keywords", "fx_sites", "fx_pages", "fx_actions"))


def _best_in(s, d, offset=0):
    return S.best_page(S.rows_in_window(_search(s, d), TODAY, 7, offset))


def _merge(s, d):
    """A second sync: the snapshot that the earlier window left, then the current one."""
    older, newer = _best_in(s, d, 7), _best_in(s, d)
    snapshot = older.filter("event_id % 3 <> 0").select("site_id", F.col("query").alias("keyword"), F.col("position").alias("current_position"), F.lit(None).cast("double").alias("previous_position"), F.col("position").alias("best_position"), "impressions", "clicks")
    return sinks.merge_keywords(snapshot, newer, older.filter("event_id % 2 = 0"))


def _lookup(s, d):
    rows = _best_in(s, d).withColumn("page", F.when(F.col("event_id") % 3 == 0, F.concat("page", F.lit("/"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("/other"), "page")).otherwise(F.col("page")))
    return S.page_lookup(rows, _pages(s, d)).select("site_id", "query", "page", "page_id")


def _enriched(s, d):
    volumes = view(s, d, "part").select(
        F.concat_ws("-", F.element_at(F.array(*map(F.lit, ["click", "view", "error", "signup", "purchase"])), (F.col("p_partkey") % 5 + 1).cast("int")), (F.col("p_partkey") % 23).cast("string")).alias("keyword"),
        "p_partkey", F.col("p_size").cast("bigint").alias("search_volume"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).alias("keyword_difficulty"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_size") / 2.0).alias("competition_index"),
        F.element_at(F.array(*map(F.lit, ["low", "MEDIUM", "High", "none"])), (F.col("p_partkey") % 4 + 1).cast("int")).alias("competition"),
    )
    one = volumes.groupBy("keyword").agg(F.max_by(F.struct("search_volume", "keyword_difficulty", "competition_index", "competition"), "p_partkey").alias("v")).select("keyword", "v.*")
    return S.enrich_volumes(_kw(s, d), one).select("site_id", "keyword", "search_volume", "difficulty")


ENRICHED_SQL = oracle("fx_keywords", """
, vol AS (SELECT keyword, max_by(v, p_partkey) AS v FROM (
  SELECT p_partkey, concat(['click', 'view', 'error', 'signup', 'purchase'][p_partkey % 5 + 1], '-', CAST(p_partkey % 23 AS STRING)) AS keyword,
         {'vol': p_size::BIGINT, 'diff': coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END, CASE WHEN p_partkey % 3 = 1 THEN p_size / 2.0::DOUBLE END, [25.0, 50.0, 85.0, NULL][p_partkey % 4 + 1]::DOUBLE)} AS v FROM part) GROUP BY keyword)
SELECT k.site_id, k.keyword, coalesce(v.vol, k.search_volume) AS search_volume, v.diff AS difficulty FROM fx_keywords k LEFT JOIN vol USING (keyword)""")  # fmt: skip


QUERIES = {
    "search_drops": lambda s, d: S.drops(_search(s, d), TODAY),
    "search_best_page": lambda s, d: S.best_page(_search(s, d)),
    "search_page_queries": lambda s, d: S.page_queries(_search(s, d), "/p/7").select("site_id", "query", F.col("dt").cast("string").alias("dt"), "position", "impressions", "clicks", "event_id"),
    "search_page_lookup": _lookup,
    "search_opportunities": lambda s, d: S.opportunities(_kw(s, d)),
    "search_keyword_drops": lambda s, d: S.keyword_drops(_kw(s, d)).select("site_id", "keyword", "current_position", "previous_position", "loss"),
    "search_global_top_opps": lambda s, d: S.top_opportunities(_kw(s, d), _sites(s, d)),
    "search_buckets": lambda s, d: S.buckets(_kw(s, d)),
    "search_buckets_cumulative": lambda s, d: S.cumulative_buckets(_kw(s, d)),
    "search_overview": lambda s, d: S.overview(_sites(s, d), _pages(s, d), _actions(s, d), _kw(s, d)),
    "search_site_cards": lambda s, d: S.site_cards(_sites(s, d), _pages(s, d), _actions(s, d), _kw(s, d)),
    "search_keyword_list": lambda s, d: S.keyword_list(_kw(s, d), "position", 500),
    "search_keyword_list_by_volume": lambda s, d: S.keyword_list(_kw(s, d), "volume", 100).select("site_id", "keyword", "search_volume", "delta"),
    "search_enriched_keywords": _enriched,
    "search_actions_ranked": lambda s, d: S.diversify(S.candidate_actions(_search(s, d), _kw(s, d), TODAY)),
    "search_actions_new": lambda s, d: S.new_actions(S.candidate_actions(_search(s, d), _kw(s, d), TODAY), _actions(s, d)).select("site_id", "keyword", "action_type", "impact_score"),
    "search_scan_totals": lambda s, d: S.scan_totals(_search(s, d), _kw(s, d), TODAY),
    "search_keyword_merge": _merge,
    "search_history_rows": lambda s, d: sinks.history_rows(_best_in(s, d), F.lit("2024-01-28")),
    "search_history_change": lambda s, d: S.history_changes(_search(s, d)).withColumn("recorded_at", F.col("recorded_at").cast("string")),
    "search_indexed_pages": lambda s, d: S.indexed_pages(_search(s, d), None, TODAY).select("site_id", "indexed_pages"),
    "known_keywords": lambda s, d: S.known_keywords(_search(s, d), "query"),
    "rank_summary": lambda s, d: S.rank_summary(_search(s, d)),
    "budget": lambda s, d: S.budget(_actions(s, d)),
    "action_queue": lambda s, d: S.action_queue(_actions(s, d), _sites(s, d)),
    "action_history": lambda s, d: S.action_history(_actions(s, d)),
    "refresh_candidates": lambda s, d: S.refresh_candidates(_pages(s, d), _actions(s, d)),
}

_TOP = """row_number() OVER (PARTITION BY site_id ORDER BY {order}, keyword) AS r"""

ORACLES = {
    "search_drops": oracle("fx_search", CHANGES + "SELECT site_id, query, page, position AS current_position, previous_position, position - previous_position AS delta, impressions FROM chg WHERE position - previous_position >= 3"),
    "search_best_page": oracle("fx_search", f", {_best('b')} SELECT * FROM b"),
    "search_page_queries": oracle("fx_search", "SELECT site_id, query, CAST(dt AS STRING) AS dt, position, impressions, clicks, event_id FROM fx_search WHERE page = '/p/7' ORDER BY impressions DESC, event_id LIMIT 100"),
    "search_page_lookup": oracle("fx_search fx_pages", f", {_best('b', NOW)}" + """
, r AS (SELECT site_id, query, CASE event_id % 3 WHEN 0 THEN page || '/' WHEN 1 THEN '/other' || page ELSE page END AS page FROM b)
, u AS (SELECT site_id, rtrim(url, '/') AS url, min(page_id) AS page_id FROM fx_pages GROUP BY ALL)
, g AS (SELECT site_id, list_last(string_split(rtrim(url, '/'), '/')) AS slug, min(page_id) AS page_id FROM fx_pages GROUP BY ALL)
SELECT r.site_id, r.query, r.page, coalesce(u.page_id, g.page_id) AS page_id FROM r LEFT JOIN u ON r.site_id = u.site_id AND rtrim(r.page, '/') = u.url
LEFT JOIN g ON r.site_id = g.site_id AND list_last(string_split(rtrim(r.page, '/'), '/')) = g.slug"""),
    "search_opportunities": oracle("fx_keywords", f"SELECT site_id, keyword, impressions, current_position, {R('impressions * (current_position / 10.0::DOUBLE)', 1)} AS opportunity_score FROM fx_keywords WHERE impressions > 20 AND current_position > 10"),
    "search_keyword_drops": oracle("fx_keywords", "SELECT site_id, keyword, current_position, previous_position, current_position - previous_position AS loss FROM fx_keywords WHERE current_position - previous_position >= 3"),
    "search_global_top_opps": oracle("fx_keywords fx_sites", "SELECT site_id, name AS site_name, keyword, impressions, current_position FROM fx_keywords JOIN fx_sites USING (site_id) WHERE impressions > 20 AND current_position > 10 ORDER BY impressions DESC, site_id, keyword LIMIT 5"),
    "search_buckets": oracle("fx_keywords", f"SELECT {BUCKETS}, count(current_position) AS total FROM fx_keywords"),
    "search_buckets_cumulative": oracle("fx_keywords", "SELECT site_id, " + ", ".join(f"count(*) FILTER (current_position <= {n}) AS top_{n}" for n in (3, 10, 20, 50)) + ", count(*) FILTER (current_position > 50) AS beyond_50, count(current_position) AS total FROM fx_keywords GROUP BY site_id"),
    "search_overview": oracle("fx_sites fx_pages fx_actions fx_keywords", f"""
SELECT (SELECT count(*) FROM fx_sites WHERE is_active) AS total_sites, (SELECT count(*) FROM fx_pages WHERE status = 'published') AS total_pages,
  (SELECT count(*) FROM fx_actions WHERE status = 'pending') AS pending_actions, (SELECT count(*) FROM fx_actions WHERE status = 'pending' AND action_type = 'optimize') AS pending_optimizations,
  (SELECT count(*) FROM fx_actions WHERE status = 'pending' AND action_type IN ('create', 'geoloc')) AS pending_creations, count(current_position) AS total_keywords, {MEANS}, {BUCKETS} FROM fx_keywords"""),
    "search_site_cards": oracle("fx_sites fx_pages fx_actions fx_keywords", f"""
, k AS (SELECT site_id, count(*) AS total_keywords, {MEANS}, {BUCKETS} FROM fx_keywords GROUP BY site_id)
, o AS (SELECT site_id, string_agg(keyword || ':' || impressions || ':' || current_position::BIGINT, '|' ORDER BY r) AS top_opportunities FROM
        (SELECT *, {_TOP.format(order='impressions DESC')} FROM fx_keywords WHERE impressions > 10 AND current_position > 10) WHERE r <= 10 GROUP BY site_id)
, l AS (SELECT site_id, string_agg(keyword || ':' || previous_position::BIGINT || ':' || current_position::BIGINT || ':' || delta::BIGINT, '|' ORDER BY r) AS top_drops FROM
        (SELECT *, {_TOP.format(order='delta DESC')} FROM (SELECT *, current_position - previous_position AS delta FROM fx_keywords) WHERE delta >= 3) WHERE r <= 10 GROUP BY site_id)
SELECT s.site_id, s.name, coalesce(p.n, 0) AS total_pages, coalesce(a.n, 0) AS pending_actions, coalesce(total_keywords, 0) AS total_keywords, avg_position, prev_avg_position, coalesce(position_delta, 0.0) AS position_delta,
  coalesce(top_3, 0) AS top_3, coalesce(top_4_10, 0) AS top_4_10, coalesce(top_11_20, 0) AS top_11_20, coalesce(top_opportunities, '') AS top_opportunities, coalesce(top_drops, '') AS top_drops
FROM fx_sites s LEFT JOIN (SELECT site_id, count(*) FILTER (status = 'published') AS n FROM fx_pages GROUP BY 1) p USING (site_id) LEFT JOIN (SELECT site_id, count(*) FILTER (status = 'pending') AS n FROM fx_actions GROUP BY 1) a USING (site_id)
LEFT JOIN k USING (site_id) LEFT JOIN o USING (site_id) LEFT JOIN l USING (site_id) WHERE is_active"""),
    "search_keyword_list": oracle("fx_keywords", f"SELECT *, CASE WHEN current_position IS NOT NULL AND previous_position IS NOT NULL THEN {R('previous_position - current_position', 1)} END AS delta FROM fx_keywords ORDER BY current_position ASC NULLS LAST, site_id, keyword LIMIT 500"),
    "search_keyword_list_by_volume": oracle("fx_keywords", f"SELECT site_id, keyword, search_volume, CASE WHEN current_position IS NOT NULL AND previous_position IS NOT NULL THEN {R('previous_position - current_position', 1)} END AS delta FROM fx_keywords ORDER BY search_volume DESC NULLS FIRST, site_id, keyword LIMIT 100"),
    "search_enriched_keywords": ENRICHED_SQL,
    "search_actions_ranked": oracle("fx_search fx_keywords", CANDIDATES + "SELECT * FROM dv WHERE rank <= 50"),
    "search_actions_new": oracle("fx_search fx_keywords fx_actions", CANDIDATES + "SELECT site_id, keyword, action_type, impact_score FROM (SELECT *, row_number() OVER (PARTITION BY site_id, keyword ORDER BY impact_score DESC, action_type) AS n FROM cand) c WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM fx_actions a WHERE a.status = 'pending' AND a.site_id = c.site_id AND a.keyword = c.keyword)"),
    "search_scan_totals": oracle("fx_search fx_keywords", CANDIDATES + """
, f AS (SELECT site_id, count(*) FILTER (action_type = 'optimize') AS o, count(*) FILTER (action_type = 'create') AS c FROM dv WHERE rank <= 50 GROUP BY 1)
, j AS (SELECT site_id, n, coalesce(o, 0) AS o, coalesce(c, 0) AS c FROM (SELECT site_id, count(*) AS n FROM cur GROUP BY 1) LEFT JOIN f USING (site_id))
SELECT site_id, sum(n)::BIGINT AS keywords_synced, sum(o)::BIGINT AS optimizations, sum(c)::BIGINT AS new_content FROM j GROUP BY ROLLUP (site_id)"""),
    "search_keyword_merge": oracle("fx_search", f", {_best('cur', NOW)}, {_best('old_', BEFORE)}" + """
, snap AS (SELECT * FROM old_ WHERE event_id % 3 <> 0), prv AS (SELECT * FROM old_ WHERE event_id % 2 = 0)
, b AS (SELECT coalesce(s.site_id, c.site_id) AS site_id, coalesce(s.query, c.query) AS keyword, s.query IS NOT NULL AS known, c.query IS NOT NULL AS synced, s.position AS sp, c.position AS cp, s.impressions AS si, c.impressions AS ci, s.clicks AS sc, c.clicks AS cc
        FROM snap s FULL JOIN cur c ON s.site_id = c.site_id AND s.query = c.query)
SELECT b.site_id, b.keyword, coalesce(cp, sp) AS current_position, CASE WHEN NOT synced THEN NULL WHEN known THEN coalesce(p.position, sp) ELSE p.position END AS previous_position,
  least(sp, cp) AS best_position, coalesce(ci, si) AS impressions, coalesce(cc, sc) AS clicks
FROM b LEFT JOIN prv p ON b.site_id = p.site_id AND b.keyword = p.query"""),
    "search_history_rows": oracle("fx_search", f", {_best('cur', NOW)} SELECT site_id, query AS keyword, position, impressions, clicks, '2024-01-28' AS recorded_date FROM cur"),
    "search_history_change": oracle("fx_search", """
, day_ AS (SELECT site_id, query AS keyword, dt AS recorded_at, min(position) AS position FROM fx_search GROUP BY ALL)
SELECT site_id, keyword, CAST(recorded_at AS STRING) AS recorded_at, position, position - lag(position) OVER w AS change, min(position) OVER w AS best_position FROM day_ WINDOW w AS (PARTITION BY site_id, keyword ORDER BY recorded_at)"""),
    "search_indexed_pages": oracle("fx_search", "SELECT site_id, count(DISTINCT page) AS indexed_pages FROM fx_search WHERE dt > DATE '2023-12-31' AND dt <= DATE '2024-01-28' GROUP BY site_id"),
    "known_keywords": oracle("fx_search", "SELECT DISTINCT trim(query) AS keyword FROM fx_search WHERE trim(query) <> '' ORDER BY 1 LIMIT 100"),
    "rank_summary": oracle("fx_search", f", {_best('b')}, r AS (SELECT *, CASE WHEN position <= 50 THEN position END AS rank_ FROM b) SELECT site_id, count(*) AS tracked, count(rank_) AS ranked, count(*) FILTER (rank_ IS NULL) AS not_ranked, count(*) FILTER (rank_ <= 3) AS top3, count(*) FILTER (rank_ <= 10) AS top10, {R('avg(rank_)', 1)} AS avg_rank FROM r GROUP BY site_id"),
    "budget": oracle("fx_actions", f"""
, b AS (SELECT action_type, coalesce(sum(actual_api_cost) FILTER (status = 'done'), 0) AS spent, coalesce(sum(estimated_api_cost) FILTER (status IN ('pending', 'validated', 'executing')), 0) AS waiting, count(*) FILTER (status = 'done') AS actions_done FROM fx_actions GROUP BY ROLLUP (action_type))
SELECT action_type, {R('spent', 4)} AS actual_spent, {R('waiting', 2)} AS estimated_pending, {R('spent + waiting', 2)} AS projected_total, actions_done, CASE WHEN actions_done = 0 THEN 0.0 ELSE coalesce({R('spent / nullif(actions_done, 0)', 5)}, 0.0) END AS avg_cost_per_action FROM b"""),
    "action_queue": oracle("fx_actions fx_sites", "SELECT action_id, a.site_id, coalesce(name, '') AS site_name, keyword, action_type, status, impact_score FROM (SELECT * FROM fx_actions WHERE status IN ('pending', 'validated', 'executing', 'failed') ORDER BY impact_score DESC NULLS FIRST, action_id LIMIT 100) a LEFT JOIN fx_sites s USING (site_id)"),
    "action_history": oracle("fx_actions", "SELECT action_id, site_id, keyword, action_type, status, strftime(executed_at, '%Y-%m-%d') AS executed_on FROM fx_actions WHERE status IN ('done', 'failed') ORDER BY executed_at DESC NULLS FIRST, action_id LIMIT 50"),
    "refresh_candidates": oracle("fx_pages fx_actions", """
, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY updated_at ASC NULLS FIRST, created_at, page_id) AS r FROM fx_pages WHERE cms_id IS NOT NULL) WHERE r <= 10)
, f AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY r) AS rank FROM o WHERE NOT EXISTS (SELECT 1 FROM fx_actions a WHERE a.site_id = o.site_id AND a.page_id = o.page_id AND a.status IN ('pending', 'validated', 'executing')))
SELECT site_id, page_id, url, rank, 'optimize' AS action_type, 10.0::DOUBLE AS impact_score, 0.04::DOUBLE AS estimated_api_cost FROM f WHERE rank <= 5"""),
}
