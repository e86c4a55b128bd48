"""Queries on feeds, policies and scorecards; their JSON and robots texts are made by Spark from the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import urls as U
from quillspan.functions.numbers import half_up_sql as R
from quillspan.operators import visibility as V
from quillspan.plans.audit import HEAD, METRICS
from quillspan.sources import json as J
from quillspan.sources.fixtures import oracle, view

DOMAIN = "site3.example.org"


def _serp(s, d):
    """One result page per query: each site's best position is an organic item, every third item is another kind."""
    rows = view(s, d, "fx_search").groupBy("query", "site_id").agg(F.min("position").cast("int").alias("rank"))
    host = F.concat(F.when(F.col("site_id") % 2 == 0, "www.").otherwise(""), F.lit("site"), F.col("site_id").cast("string"), F.lit(".example.org"))
    kind = F.when((F.col("site_id") + F.col("rank")) % 3 == 0, "ai_overview").otherwise("organic")
    item = F.struct(kind.alias("type"), F.col("rank").alias("rank_group"), F.col("rank").alias("rank_absolute"), host.alias("domain"), F.concat(F.lit("https://"), host, F.lit("/x")).alias("url"), F.lit("t").alias("title"), F.lit("d").alias("description"))
    pages = rows.groupBy("query").agg(F.sort_array(F.collect_list(item)).alias("items"))
    result = F.array(F.struct(F.col("query").alias("keyword"), "items"))
    return pages.select(F.to_json(F.struct(F.array(F.struct(result.alias("result"))).alias("tasks"))).alias("json"))


def _feed(s, d):
    """Conversations as a mention feed: each answer cites two pages and names a brand."""
    a = view(s, d, "conversations").filter("role = 'assistant'")
    pages = F.array(*(F.struct(F.concat(F.lit("h"), (F.col("conv_id") % m).cast("string"), F.lit(".example.org")).alias("domain"), F.concat(F.lit("https://h"), (F.col("conv_id") % m).cast("string"), F.lit(".example.org/p"), (F.col("turn") % 3).cast("string")).alias("url")) for m in (5, 7)))
    brand = F.array(F.struct(F.concat(F.lit("brand"), (F.col("conv_id") % 11).cast("string")).alias("title"), F.concat(F.lit("c"), (F.col("conv_id") % 2).cast("string")).alias("category")))
    item = F.struct(F.concat(F.lit("q"), "conv_id").alias("question"), F.col("text").alias("answer"), F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("platform"), (F.col("conv_id") % 100).cast("int").alias("ai_search_volume"), pages.alias("sources"), brand.alias("brand_entities"))
    result = F.array(F.struct(F.array(item).alias("items")))
    return a.select(F.to_json(F.struct(F.array(F.struct(result.alias("result"))).alias("tasks"))).alias("json"))


def _items(s, d):
    return V.mention_items(_feed(s, d))


def _robots(s, d):
    """A robots file per host of the pages, by the length of its name."""
    hosts = view(s, d, "pages").select(U.host(F.col("url")).alias("host")).distinct()
    n = F.length("host") % 4
    body = F.when(n == 0, "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private").when(n == 1, "User-agent: *\nDisallow: /\n").when(n == 2, "# open\nUser-agent: Googlebot\nDisallow:\nSitemap: https://a.example/s.xml")
    return hosts.select("host", body.alias("robots"))


def _facts(s, d):
    return V.page_facts(view(s, d, "pages"), V.crawler_policy(_robots(s, d)))


def _features(s, d):
    return view(s, d, "orders").select(F.col("o_orderkey").alias("keyword"), F.concat_ws(", ", (F.col("o_orderkey") % 60).cast("string"), (F.col("o_custkey") % 60).cast("string")).alias("features"))


def _nested(s, d):
    """Conversations as JSON of several levels, slashes escaped, with wanted keys at different depths and strings that stand in lists."""
    item = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), F.array(F.struct(F.struct(F.concat(F.lit("https://h.example.org/"), F.col("turn").cast("string")).alias("link"), F.col("role").alias("role")).alias("source"))).alias("refs"), F.array("role").alias("list"), F.struct(F.when(F.col("turn") % 2 == 1, F.col("text")).alias("answer")).alias("deep"))
    rows = view(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct("items", F.lit(1).alias("url"))).alias("result"))).alias("tasks"), F.lit("T").alias("title")))
    return rows.select("conv_id", F.replace(body, F.lit("/"), F.lit("\\/")).alias("body"))


QUERIES = {
    "json_collected": lambda s, d: J.collect_strings(_nested(s, d), "conv_id", "body").select("conv_id", "kind", "value"),
    "serp_rank": lambda s, d: V.domain_rank(V.serp_items(_serp(s, d)), DOMAIN),
    "overview_presence": lambda s, d: V.overview_presence(_serp(s, d), DOMAIN),
    "overview_share": lambda s, d: V.overview_share(_features(s, d)),
    "mention_rows": lambda s, d: V.shape_mentions(_items(s, d), "h3.example.org").select("question", F.md5("preview").alias("preview_md5"), "platform", "volume", "cited", "n_sources", "n_brands"),
    "brand_entities": lambda s, d: V.brand_entities(_items(s, d)),
    "cocited_domains": lambda s, d: V.cocited_domains(_items(s, d), "h3.example.org"),
    "mentions_by_platform": lambda s, d: V.mentions_by_platform(_items(s, d)),
    "top_cited_pages": lambda s, d: V.top_cited_pages(_items(s, d), "h3.example.org"),
    "domain_report": lambda s, d: V.domain_report(_items(s, d), "h3.example.org"),
    "crawler_policy": lambda s, d: V.crawler_policy(_robots(s, d)),
    "platform_readiness": lambda s, d: V.readiness(_facts(s, d)),
    "geo_composite": lambda s, d: V.composite(_facts(s, d)),
    "recommendations": lambda s, d: V.recommendations(_facts(s, d)),
    "schema_score": lambda s, d: V.extract.json_ld(view(s, d, "pages")).select("page_id", "blocks", "schema_score", F.array_join("types", ",").alias("types")),
}

_ITEM = "CASE WHEN (site_id + rank) % 3 = 0 THEN 'ai_overview' ELSE 'organic' END AS type, CASE WHEN site_id % 2 = 0 THEN 'www.' ELSE '' END || 'site' || site_id || '.example.org' AS domain"
SERP = f", it AS (SELECT query AS keyword, rank, {_ITEM}, 'https://' || CASE WHEN site_id % 2 = 0 THEN 'www.' ELSE '' END || 'site' || site_id || '.example.org/x' AS url, site_id FROM (SELECT query, site_id, min(position)::INT AS rank FROM fx_search GROUP BY ALL))"
FEED = "WITH a AS (SELECT * FROM conversations WHERE role = 'assistant'), src AS (SELECT conv_id, turn, m, 'h' || (conv_id % m) || '.example.org' AS domain, 'https://h' || (conv_id % m) || '.example.org/p' || (turn % 3) AS url FROM a, (VALUES (5), (7)) x(m))"
POLICY = "WITH h AS (SELECT DISTINCT " + U.host_sql("url") + " AS host FROM pages), ag(crawler) AS (VALUES " + ", ".join(f"('{c}')" for c in V.CRAWLERS) + """)
, pol AS (SELECT host, crawler, CASE length(host) % 4 WHEN 3 THEN 'unknown' WHEN 1 THEN 'blocked' WHEN 0 THEN CASE WHEN crawler IN ('GPTBot', 'CCBot') THEN 'blocked' ELSE 'allowed' END ELSE 'allowed' END AS status,
  CASE length(host) % 4 WHEN 0 THEN crawler IN ('GPTBot', 'CCBot') WHEN 2 THEN crawler = 'Googlebot' ELSE FALSE END AS in_robots FROM h, ag)"""
# the pages carry no JSON-LD, open-graph tags, framework marks or headers, so those checks are false here
FACTS = POLICY + f"""
, mx AS (WITH q AS (SELECT 1) {METRICS}), hx AS (WITH q AS (SELECT 1) {HEAD} SELECT * FROM head)
, al AS (SELECT host, list(crawler) FILTER (status = 'allowed') AS allowed, list(crawler) FILTER (status = 'blocked') AS blocked FROM pol GROUP BY host)
, fa AS (SELECT mx.*, title_len, meta_description <> '' AS described, canonical <> '' AS canon, html_lang, h2 + h3 + h4 + h5 + h6 AS heads, starts_with(hx.url, 'https://') AS https, len(regexp_extract_all(pages.html, '(?i)<p[\\s>]')) > 3 AS ssr,
  coalesce(allowed, []) AS allowed, coalesce(blocked, []) AS blocked FROM mx JOIN hx USING (page_id) JOIN pages USING (page_id) LEFT JOIN al ON al.host = {U.host_sql('hx.url')})"""
_sum = lambda *pairs: "least(" + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in pairs) + ", 100)"
_bot = lambda c: f"list_contains(allowed, '{c}')"
CARDS = {
    "google_aio": _sum(("words >= 800", 12), ("heads >= 3", 10), ("lists >= 1", 8), ("citability >= 20", 10), ("https", 5), (_bot("Googlebot"), 10), ("canon", 5)),
    "chatgpt": _sum((_bot("GPTBot"), 20), (_bot("ChatGPT-User"), 5), ("citable_blocks >= 5", 15), ("citable_blocks >= 10", 10), ("described", 10), ("external_links >= 2", 8), ("words >= 500", 7)),
    "perplexity": _sum((_bot("PerplexityBot"), 20), ("citable_blocks >= 3", 12), ("citable_blocks >= 8", 8), ("words >= 1000", 12), ("lists >= 2", 10), ("external_links >= 1", 10), ("external_links >= 3", 5), ("ssr", 10), ("https", 5)),
    "gemini": _sum((_bot("Google-Extended"), 18), ("images_alt >= 2", 10), ("heads >= 4", 8), ("words >= 800", 7), ("https", 5), ("internal_links >= 3", 8)),
    "bing_copilot": _sum((_bot("Bingbot"), 18), ("described", 15), ("title_len BETWEEN 10 AND 65", 10), ("words >= 500", 8), ("heads >= 3", 8), ("https", 8), ("canon", 7)),
}
COMPOSITE = f"""
, cp AS (SELECT page_id, least(citability * 2.5::DOUBLE, 100.0::DOUBLE) AS raw, least(CASE WHEN words >= 1500 THEN 30 WHEN words >= 800 THEN 20 WHEN words >= 300 THEN 10 ELSE 0 END + {_sum(('heads >= 3', 20), ('lists >= 1', 15), ('images_alt >= 1', 15), ('external_links >= 1', 10), ('avg_paragraph_words <= 40', 10))}, 100) AS content_quality,
  {_sum(('https', 25), ('ssr', 25), ('described', 15), ('title_len > 0', 10), ('canon', 10), ("html_lang <> ''", 5))} AS technical, floor(len(allowed) * 100.0::DOUBLE / {len(V.CRAWLERS)})::BIGINT AS crawler_access, 0 AS schema,
  floor(({' + '.join(CARDS.values())}) / 5.0::DOUBLE)::BIGINT AS platform_readiness FROM fa)
SELECT page_id, content_quality, technical, crawler_access, schema, platform_readiness, floor(raw * 0.25::DOUBLE + content_quality * 0.20::DOUBLE + technical * 0.15::DOUBLE + crawler_access * 0.15::DOUBLE + schema * 0.10::DOUBLE + platform_readiness * 0.15::DOUBLE + 1e-9::DOUBLE)::INT AS geo_score, floor(raw)::INT AS citability FROM cp"""
ADVICE = (
    ("NOT https", "critical", "technical", "serve the site over https"), ("NOT ssr", "critical", "technical", "render content on the server"), ("len(blocked) > 0", "critical", "crawlers", "unblock crawlers in robots.txt"),
    ("TRUE", "high", "schema", "add an organization with sameAs"), ("words < 800", "high", "content", "write more than 800 words"), ("citability < 15", "high", "content", "add paragraphs of 20-60 words that answer questions"),
    ("TRUE", "medium", "files", "publish llms.txt"), ("lists = 0", "medium", "content", "add lists"), ("images_alt < images", "medium", "content", "describe images"), ("TRUE", "medium", "schema", "add an article"), ("TRUE", "medium", "schema", "add breadcrumbs"),
)
ORACLES = {
    "json_collected": "SELECT conv_id, 'text' AS kind, text AS value FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, 'url', 'https://h.example.org/' || turn FROM conversations UNION ALL SELECT DISTINCT conv_id, 'text', 'T' FROM conversations",
    "platform_readiness": FACTS + " " + " UNION ALL ".join(f"SELECT page_id, '{p}' AS platform, {e} AS score FROM fa" for p, e in CARDS.items()),
    "geo_composite": FACTS + COMPOSITE,
    "recommendations": FACTS + " " + " UNION ALL ".join(f"SELECT page_id, '{p}' AS priority, '{c}' AS category, '{a}' AS advice FROM fa WHERE {w}" for w, p, c, a in ADVICE),
    "serp_rank": oracle("fx_search", SERP + """, o AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY rank, url) AS n FROM it WHERE type = 'organic')
SELECT keyword, min(CASE WHEN site_id = 3 THEN rank END) AS rank, min(CASE WHEN site_id = 3 THEN url END) AS url, string_agg(CASE WHEN n <= 3 THEN domain END, ',' ORDER BY n) AS top_domains FROM o GROUP BY keyword"""),
    "overview_presence": oracle("fx_search", SERP + "SELECT keyword, bool_or(type = 'ai_overview') AS present, bool_or(type = 'ai_overview' AND site_id = 3) AS cited FROM it GROUP BY keyword"),
    "overview_share": f"SELECT count(*) AS keywords, count(*) FILTER (o_orderkey % 60 = 51 OR o_custkey % 60 = 51) AS with_overview, {R('count(*) FILTER (o_orderkey % 60 = 51 OR o_custkey % 60 = 51) * 100.0::DOUBLE / count(*)', 1)} AS share FROM orders",
    "mention_rows": "SELECT 'q' || conv_id AS question, md5(substring(text, 1, 200)) AS preview_md5, 'p' || (conv_id % 3) AS platform, conv_id % 100 AS volume, conv_id % 5 = 3 OR conv_id % 7 = 3 AS cited, 2 AS n_sources, 1 AS n_brands FROM conversations WHERE role = 'assistant'",
    "brand_entities": "SELECT 'brand' || (conv_id % 11) AS title, count(*) AS n, min('c' || (conv_id % 2)) AS category FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "cocited_domains": FEED + " SELECT domain, count(*) AS n, domain = 'h3.example.org' AS own FROM src GROUP BY 1 ORDER BY n DESC, domain LIMIT 30",
    "mentions_by_platform": f"WITH p AS (SELECT 'p' || (conv_id % 3) AS platform, count(*) AS mentions, sum(conv_id % 100)::BIGINT AS volume FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT *, {R('mentions * 100.0::DOUBLE / sum(mentions) OVER ()', 1)} AS share FROM p",
    "domain_report": """WITH a AS (SELECT *, conv_id % 5 = 3 OR conv_id % 7 = 3 AS cited FROM conversations WHERE role = 'assistant')
, t AS (SELECT count(*) AS mentions, count(*) FILTER (cited) AS citations, count(DISTINCT conv_id % 3) AS platforms, count(DISTINCT turn % 3) FILTER (cited) AS pages FROM a)
SELECT 'h3.example.org' AS domain, *, NULL::DOUBLE AS readiness, least(100, floor(CASE WHEN mentions >= 500 THEN 40 WHEN mentions >= 100 THEN 30 WHEN mentions >= 50 THEN 20 WHEN mentions >= 10 THEN 10 WHEN mentions >= 1 THEN 5 ELSE 0 END
  + CASE WHEN citations >= 50 THEN 20 WHEN citations >= 20 THEN 15 WHEN citations >= 5 THEN 10 WHEN citations >= 1 THEN 5 ELSE 0 END + least(platforms * 2.5::DOUBLE, 10) + CASE WHEN pages >= 10 THEN 10 WHEN pages >= 5 THEN 7 WHEN pages >= 1 THEN 3 ELSE 0 END))::INT AS visibility FROM t""",
    "top_cited_pages": FEED + " SELECT url, count(*) AS n FROM src WHERE domain = 'h3.example.org' GROUP BY 1 ORDER BY n DESC, url LIMIT 20",
    "crawler_policy": POLICY + " SELECT * FROM pol",
    "schema_score": "SELECT page_id, 0 AS blocks, 0 AS schema_score, '' AS types FROM pages WHERE NOT contains(html, 'ld+json')",
}
