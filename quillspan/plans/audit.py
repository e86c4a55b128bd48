"""Queries over raw pages and documents: extraction, audit, language."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import urls as U
from quillspan.functions.numbers import half_up_sql as R
from quillspan.operators import audit as A
from quillspan.operators import extract as X
from quillspan.operators import indexation as I
from quillspan.sources.fixtures import oracle, view
from quillspan.workspace import spread


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first(pattern: str, x: str = "html") -> str:
    return f"regexp_extract({x}, {lit(pattern)}, 1)"


def every(pattern: str, group: int = 1, x: str = "html") -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {group})"


def attr(tag: str, name: str) -> str:
    return first(rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", tag)


def meta(name: str) -> str:
    value = attr(f"list_filter({every(X.META_TAG)}, lambda t: lower({attr('t', 'name')}) = '{name}')[1]", "content")
    for entity, char in X.ENTITIES.items():
        value = f"replace({value}, '{entity}', {lit(char)})"
    return f"coalesce(trim({value}), '')"


CANONICAL = attr(f"list_filter({every(X.LINK_TAG)}, lambda t: contains(lower({attr('t', 'rel')}), 'canonical'))[1]", "href")
HEAD = f"""
, p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages)
, hd AS (SELECT page_id, url, 200 AS status, 'text/html' AS content_type, {X.tight_sql(first(X.TITLE))} AS title, {meta('description')} AS meta_description,
  CASE WHEN coalesce({CANONICAL}, '') <> '' THEN {U.join_sql('url', f'trim({CANONICAL})')} ELSE '' END AS canonical, lower({meta('robots')}) AS meta_robots, trim({first(X.LANG)}) AS html_lang FROM p)
, head AS (SELECT *, length(title) AS title_len, length(meta_description) AS desc_len, NOT contains(meta_robots, 'noindex') AS indexable FROM hd)
, hp AS (SELECT page_id, list_transform(list_zip({every(X.HEADING, 1)}, {every(X.HEADING, 2)}), lambda z: {{'level': CAST(z[1] AS INT), 'text': {X.tight_sql('z[2]')}}}) AS pairs FROM p)
, heads AS (SELECT page_id, coalesce(list_filter(pairs, lambda q: q.level = 1)[1].text, '') AS h1, len(list_filter(pairs, lambda q: q.level = 1)) AS h1_count, len(list_filter(pairs, lambda q: q.level = 2)) AS h2_count, len(list_filter(pairs, lambda q: q.level = 3)) AS h3_count,
  list_filter(pairs, lambda q: q.text <> '') AS outline FROM hp)
, vt AS (SELECT page_id, {X.visible_text_sql('html')} AS t FROM p)
, txt AS (SELECT page_id, t AS text, CAST(len(regexp_extract_all(lower(t), '{T.WORD}')) AS BIGINT) AS word_count FROM vt)
"""
FOLD_WORDS = "list_distinct(list_filter(regexp_extract_all({}, '[a-z0-9]+'), lambda w: length(w) > 2))"
AUDIT = HEAD + f"""
, au AS (SELECT head.*, h1, h1_count, h2_count, h3_count, text, word_count, {FOLD_WORDS.format(T.fold_sql('title'))} AS tw, {FOLD_WORDS.format(T.fold_sql('h1'))} AS hw FROM head JOIN heads USING (page_id) JOIN txt USING (page_id))
, mt AS (SELECT *, len(tw) > 0 AND coalesce(len(list_intersect(tw, hw)) / nullif(len(hw), 0)::DOUBLE >= 0.5, FALSE) AS title_h1_match FROM au)
, iss AS (SELECT *, list_filter([CASE WHEN title = '' THEN 'title_missing' END, CASE WHEN title_len > 65 THEN 'title_long' END, CASE WHEN title <> '' AND title_len < 20 THEN 'title_short' END,
  CASE WHEN meta_description = '' THEN 'description_missing' END, CASE WHEN desc_len > 160 THEN 'description_long' END, CASE WHEN h1 = '' THEN 'h1_missing' END, CASE WHEN h1_count > 1 THEN 'h1_multiple' END,
  CASE WHEN h1 <> '' AND NOT title_h1_match THEN 'title_h1_mismatch' END, CASE WHEN NOT indexable THEN 'noindex' END, CASE WHEN word_count < 250 THEN 'thin_content' END, CASE WHEN html_lang = '' THEN 'lang_missing' END], lambda x: x IS NOT NULL) AS issues FROM mt)
, sc AS (SELECT *, greatest(0, least(100, 100 - coalesce(list_sum(list_transform(issues, lambda i: map({{{', '.join(f"'{k}': {v}" for k, v in A.PENALTIES.items())}}})[i])), 0) + CASE WHEN word_count >= 800 THEN 5 ELSE 0 END))::INT AS score FROM iss)
""".replace("map({", "MAP {").replace("})[i]", "}[i]")
_hit = lambda words, stop: f"len(list_filter({words}, lambda w: w IN ({', '.join(lit(x) for x in stop.split())})))"
VOTES = f", w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}') AS ws FROM documents), v AS (SELECT doc_id, len(ws) AS n, " + ", ".join(f"{_hit('ws', v)} AS h_{k}" for k, v in A.STOP_WORDS.items()) + " FROM w)"
BEST = f"greatest({', '.join(f'h_{k}' for k in A.STOP_WORDS)})"
LINKS = f"""
, p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages)
, z AS (SELECT page_id, url, unnest(list_zip({every(X.ANCHOR, 1)}, {every(X.ANCHOR, 2)}, {every(X.ANCHOR_TAG, 1)}, range(len({every(X.ANCHOR, 1)})))) AS a FROM p)
, d AS (SELECT page_id, url, a[4]::INT AS pos, trim(a[1]) AS raw, a[2] AS label, a[3] AS tag FROM z)
"""
_DECODE = "raw"
for _e, _c in X.ENTITIES.items():
    _DECODE = f"replace({_DECODE}, '{_e}', {lit(_c)})"
LINKS += f"""
, e AS (SELECT page_id, url, pos, trim({_DECODE}) AS href, substring({X.tight_sql('label')}, 1, 80) AS anchor, lower({attr('tag', 'rel')}) AS rel FROM d)
, r AS (SELECT page_id, url, pos, {U.clean_sql(U.join_sql('url', 'href'))} AS dst, anchor, rel FROM e WHERE NOT regexp_matches(href, '{X.SKIPPED_HREF}'))
, lk AS (SELECT page_id, url, pos, dst, anchor, rel, {U.host_sql('url')} = {U.host_sql('dst')} AS internal FROM r WHERE regexp_matches(dst, '^https?://') AND NOT regexp_matches(dst, '{U.ASSET}'))
"""
METRICS = f"""
, p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
, m AS (SELECT page_id, CAST(len(regexp_extract_all(lower({X.visible_text_sql('html')}), '{T.WORD}')) AS BIGINT) AS words, {', '.join(f"len(regexp_extract_all(html, '(?i)<h{k}[ >]')) AS h{k}" for k in range(1, 7))},
  list_filter(list_transform({every(X.PARAGRAPH)}, lambda x: {X.plain_sql('x')}), lambda x: x <> '') AS ps, len(regexp_extract_all(html, '(?i)<[uo]l[\\s>]')) AS lists, len(regexp_extract_all(html, '(?i)<img[\\s>]')) AS images,
  len(regexp_extract_all(html, {lit(r"(?is)<img\s[^>]*alt\s*=\s*[\"'][^\"']")})) AS images_alt, {every(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']")} AS hrefs FROM p)
, c AS (SELECT *, len(ps) AS paragraphs, list_transform(ps, lambda x: len(regexp_extract_all(lower(x), '{T.WORD}'))) AS per FROM m)
SELECT page_id, words, h1, h2, h3, h4, h5, h6, lists, images, images_alt, len(list_filter(hrefs, lambda x: starts_with(x, 'http'))) AS external_links, len(list_filter(hrefs, lambda x: NOT starts_with(x, 'http'))) AS internal_links, paragraphs,
  len(list_filter(ps, lambda x: len(regexp_extract_all(lower(x), '{T.WORD}')) BETWEEN 20 AND 60 AND regexp_matches(x, '[.:?]'))) AS citable_blocks,
  coalesce({R('list_sum(per) / nullif(paragraphs, 0)::DOUBLE', 1)}, 0.0) AS avg_paragraph_words,
  coalesce(floor(len(list_filter(ps, lambda x: len(regexp_extract_all(lower(x), '{T.WORD}')) BETWEEN 20 AND 60 AND regexp_matches(x, '[.:?]'))) * 100.0::DOUBLE / nullif(paragraphs, 0) + 0.5::DOUBLE), 0)::BIGINT AS citability FROM c"""


def _decoded(x: str) -> str:
    """Entities of the tables' pages, also one cut off at its end."""
    return f"regexp_replace(replace(replace(replace(replace(replace({x}, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"


def _text(x: str) -> str:
    bare = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return f"trim(regexp_replace({_decoded(bare)}, '\\s+', ' ', 'g'))"


# The tables' pages are regular: paragraphs begin with <p> and end at </p>, the next one or the article's end.
_CUT = "regexp_replace(t, '(?s)(?:</p>|</article>).*$', '')"
PARTS = f"""WITH pt AS (SELECT page_id, url, html, regexp_extract_all(html, '#([0-9a-fA-F]{{6}}|[0-9a-fA-F]{{3}})\\b', 1) AS cs,
  list_transform(string_split(html, '<p>')[2:], lambda t: {_text(_CUT)}) AS ps, list_transform({every('(?s)<li>(.*?)</li>')}, lambda t: {_text('t')}) AS items FROM pages)"""


def _pages(s, d):
    return view(s, d, "pages")


def _audited(s, d):
    return A.page_scores(A.issues(A.page_table(_pages(s, d))))


_joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["level"], x["text"])), "|")

QUERIES = {
    "page_head": lambda s, d: X.head(_pages(s, d)),
    "page_outline": lambda s, d: X.headings(_pages(s, d)).withColumn("outline", _joined("outline")),
    "page_text": lambda s, d: X.page_text(_pages(s, d)),
    "page_main_text": lambda s, d: X.main_text(_pages(s, d)),
    "page_blocks": lambda s, d: X.outline(_pages(s, d)).select("page_id", F.size("paragraphs").alias("n_paragraphs"), F.array_join("paragraphs", "|").alias("paragraphs"), F.array_join("list_items", "|").alias("list_items")),
    "page_links": lambda s, d: X.links(_pages(s, d)),
    "page_link_counts": lambda s, d: X.link_counts(_pages(s, d)),
    "page_trust": lambda s, d: X.trust_signals(_pages(s, d)),
    "page_technical": lambda s, d: X.technical(_pages(s, d)).select("page_id", F.to_json("meta").alias("meta"), F.size("og").alias("n_og"), F.array_join("frameworks", ",").alias("frameworks"), "server_rendered"),
    "page_content_metrics": lambda s, d: X.content_metrics(_pages(s, d)),
    "page_profile": lambda s, d: X.profile(_pages(s, d)).select("page_id", *(F.array_join(c, "|").alias(c) for c in ("h1s", "h2s", "h3s", "nav_labels", "colours", "features", "paragraphs"))),
    "page_skim": lambda s, d: X.skim(_pages(s, d)).withColumn("h2s", F.array_join("h2s", "|")),
    "page_stripped": lambda s, d: _pages(s, d).select("page_id", X.strip_markup(F.coalesce("html", F.lit(""))).alias("text")),
    "page_slugs": lambda s, d: _pages(s, d).select("page_id", U.host(F.col("url")).alias("host"), U.slug(F.col("url")).alias("slug"), U.path_language(F.col("url"), "?").alias("language")),
    "page_issues": lambda s, d: A.issues(A.page_table(_pages(s, d))).select("page_id", F.array_join("issues", ",").alias("issues")),
    "page_scores": lambda s, d: _audited(s, d).select("page_id", "score", "word_count"),
    "page_report_first": lambda s, d: A.truncate_report(_audited(s, d), 100).select("page_id", "score"),
    "site_score": lambda s, d: A.site_score(_audited(s, d), 64.0),
    "crawl_summary": lambda s, d: A.crawl_summary(_audited(s, d)),
    "language_histogram": lambda s, d: A.language_histogram(X.head(_pages(s, d))),
    "title_h1_match": lambda s, d: X.head(_pages(s, d)).join(X.headings(_pages(s, d)), "page_id").select("page_id", A.title_h1_match(F.col("title"), F.col("h1")).alias("matches")),
    "url_list": lambda s, d: A.url_list(_pages(s, d)),
    "language_detect": lambda s, d: A.detect_language(spread(view(s, d, "documents"))).select("doc_id", "language"),
    "document_slugs": lambda s, d: view(s, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug")),
    "document_folded": lambda s, d: view(s, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"), T.short_key(F.col("text")).alias("short_key"), T.word_count(F.col("text")).alias("n_words"), F.size(T.wide_words(F.col("text"))).alias("n_wide_words")),
    "index_rate_by_language": lambda s, d: I.rate_by_language(view(s, d, "fx_coverage")),
    "index_classes": lambda s, d: I.classes(view(s, d, "fx_coverage")),
    "index_recommendation": lambda s, d: I.recommendation(view(s, d, "fx_coverage")),
}

_count = lambda n: f"count(*) FILTER (list_contains(issues, '{n}')) AS {n}"
COVER = f"""
, f AS (SELECT *, regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/([a-z]{{2}})(?:/|$)', 1) AS code FROM fx_coverage)
, k AS (SELECT *, CASE WHEN indexed THEN 'indexed' WHEN contains(lower(coverage_state), 'soft 404') THEN 'enrich' WHEN contains(lower(coverage_state), '404') OR contains(lower(coverage_state), 'not found') OR verdict = 'ERROR' THEN 'prune'
   WHEN contains(lower(coverage_state), 'crawled') THEN 'enrich' WHEN contains(lower(coverage_state), 'discovered') OR contains(lower(coverage_state), 'unknown') OR coverage_state = '' THEN 'resubmit' ELSE 'enrich' END AS class FROM f)
"""
ORACLES = {
    "page_head": oracle("", "WITH q AS (SELECT 1)" + HEAD + "SELECT * FROM head"),
    "page_outline": oracle("", "WITH q AS (SELECT 1)" + HEAD + "SELECT page_id, h1, h1_count, h2_count, h3_count, array_to_string(list_transform(outline, lambda x: x.level || ':' || x.text), '|') AS outline FROM heads"),
    "page_text": "WITH q AS (SELECT 1)" + HEAD + "SELECT * FROM txt",
    "page_links": "WITH q AS (SELECT 1)" + LINKS + "SELECT * FROM lk",
    "page_link_counts": "WITH q AS (SELECT 1)" + LINKS + "SELECT page_id, count(DISTINCT dst) FILTER (internal) AS internal_links, count(*) FILTER (NOT internal) AS external_links FROM lk GROUP BY page_id",
    "page_content_metrics": "WITH q AS (SELECT 1)" + METRICS,
    "page_main_text": f"WITH a AS (SELECT page_id, regexp_replace({first('(?is)<article>(.*?)</article>')}, '(?i)<(?:h1|p)>', chr(1), 'g') AS x FROM pages), "
    "b AS (SELECT page_id, list_transform(string_split(x, chr(1)), lambda t: trim(regexp_replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'))) AS ts FROM a) "
    "SELECT page_id, array_to_string(list_filter(ts, lambda t: length(t) > 2), chr(10) || chr(10)) AS main_text FROM b",
    "page_trust": f"WITH p AS (SELECT page_id, url, lower(coalesce(html, '')) AS html FROM pages) SELECT page_id, {', '.join(f'regexp_matches(html, {lit(x)}) AS {c}' for c, x in X.TRUST.items())}, "
    f"len(list_distinct(list_filter(list_transform({every(X.ABSOLUTE_HREF)}, lambda x: {U.host_sql('x')}), lambda x: x <> {U.host_sql('url')})))::INT AS external_hosts FROM p",
    "page_stripped": "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages",
    "page_blocks": f"{PARTS} SELECT page_id, len(list_filter(ps, lambda t: length(t) > 40))::INT AS n_paragraphs, array_to_string(list_filter(ps, lambda t: length(t) > 40), '|') AS paragraphs, array_to_string(list_filter(items, lambda t: length(t) > 10), '|') AS list_items FROM pt",
    "page_skim": f"{PARTS} SELECT page_id, {_text(first('(?s)<title>(.*?)</title>'))} AS title, {_text(first('(?s)<h1>(.*?)</h1>'))} AS h1, '' AS h2s, array_to_string(list_filter(list_transform(string_split("
    "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)>.*?</(?:script|style)>|<!--.*?-->', '', 'g'), '(?s)<(?:nav|footer)>.*?</(?:nav|footer)>', '', 'g'), '<[^>]*>', chr(1), 'g'), chr(1)), "
    f"lambda t: trim({_decoded('t')})), lambda t: t <> ''), chr(10)) AS text FROM pt",
    "page_profile": f"{PARTS}, la AS (SELECT page_id, list_filter(list_transform({every('(?s)<a href=.(?:/[^#?<>]*).>(.*?)</a>')}, lambda t: {_text('t')}), lambda t: length(t) BETWEEN 3 AND 39) AS ls FROM pt)"
    ", lr AS (SELECT page_id, x, min(i) AS i FROM (SELECT page_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM la) GROUP BY ALL), lj AS (SELECT page_id, string_agg(x, '|' ORDER BY i) AS nav_labels FROM lr GROUP BY 1)"
    ", cr AS (SELECT page_id, c, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, min(i)) AS r FROM (SELECT page_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM pt) GROUP BY page_id, c)"
    f", cj AS (SELECT page_id, string_agg('#' || c, '|' ORDER BY r) AS colours FROM cr WHERE r <= {X.TOP_COLOURS} GROUP BY 1)"
    f" SELECT page_id, {_text(first('(?s)<h1>(.*?)</h1>'))} AS h1s, '' AS h2s, '' AS h3s, coalesce(nav_labels, '') AS nav_labels, coalesce(colours, '') AS colours, "
    f"array_to_string(list_filter([{', '.join(lit(w) for w in X.FEATURE_WORDS)}], lambda w: contains(lower(html), w)), '|') AS features, array_to_string(list_filter(ps, lambda t: length(t) > 60), '|') AS paragraphs FROM pt LEFT JOIN lj USING (page_id) LEFT JOIN cj USING (page_id)",
    "page_technical": f"WITH f AS (SELECT page_id, list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(html), {lit(m)}) THEN {lit(n)} END' for n, m in X.FRAMEWORKS.items())}], lambda x: x IS NOT NULL) AS fs, len(regexp_extract_all(html, '(?i)<p[\\s>]')) AS n FROM pages) "
    f"SELECT page_id, '{{}}' AS meta, 0 AS n_og, array_to_string(fs, ',') AS frameworks, len(list_intersect(fs, [{', '.join(map(lit, X.RENDERED))}])) > 0 OR n > 3 AS server_rendered FROM f",
    "page_issues": "WITH q AS (SELECT 1)" + AUDIT + "SELECT page_id, array_to_string(issues, ',') AS issues FROM iss",
    "page_scores": "WITH q AS (SELECT 1)" + AUDIT + "SELECT page_id, score, word_count FROM sc",
    "page_report_first": "WITH q AS (SELECT 1)" + AUDIT + "SELECT page_id, score FROM sc ORDER BY len(issues) > 0 DESC, page_id LIMIT 100",
    "site_score": "WITH q AS (SELECT 1)" + AUDIT + f", s AS (SELECT count(*) AS pages, {R('avg(score)', 1)} AS mean_page_score, floor(0.7::DOUBLE * avg(score) + 0.3::DOUBLE * 64.0::DOUBLE + 0.5::DOUBLE)::INT AS site_score FROM sc) SELECT *, CASE WHEN site_score >= 80 THEN 'good' WHEN site_score >= 60 THEN 'fair' ELSE 'poor' END AS verdict FROM s",
    "crawl_summary": "WITH q AS (SELECT 1)" + AUDIT + "SELECT count(*) AS total, count(*) AS html_pages, count(*) FILTER (indexable) AS indexable, count(*) FILTER (len(issues) > 0) AS with_issues, " + ", ".join(_count(n) for n in ("http_error", "noindex", "title_missing", "title_long", "title_short", "description_missing", "h1_missing", "h1_multiple", "title_h1_mismatch", "thin_content", "lang_missing")) + f", {R('avg(word_count)', 1)} AS avg_words FROM sc",
    "language_histogram": "WITH q AS (SELECT 1)" + HEAD + ", g AS (SELECT coalesce(nullif(lower(html_lang), ''), '?') AS language, count(*) AS pages FROM head GROUP BY 1) SELECT *, count(*) FILTER (language <> '?') OVER () > 1 AS multilingual FROM g",
    "title_h1_match": "WITH q AS (SELECT 1)" + AUDIT + "SELECT page_id, title_h1_match AS matches FROM mt",
    "url_list": "SELECT DISTINCT trim(url) AS url FROM pages WHERE starts_with(trim(url), 'http') ORDER BY 1 LIMIT 50",
    "page_slugs": f"SELECT page_id, {U.host_sql('url')} AS host, regexp_replace(list_last(string_split({U.clean_sql('''regexp_replace(url, '\\?.*$', '')''')}, '/')), '\\.(html?|php|aspx)$', '') AS slug, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]{{2}})(?:[/?#]|$)', 1) IN ('fr', 'en', 'es', 'de', 'it', 'pt', 'nl') THEN regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]{{2}})(?:[/?#]|$)', 1) ELSE '?' END AS language FROM pages",
    "language_detect": "WITH q AS (SELECT 1)" + VOTES + f" SELECT doc_id, CASE WHEN n < 20 OR {BEST} < greatest(3.0, n * 0.02::DOUBLE) THEN '' " + " ".join(f"WHEN {BEST} = h_{k} THEN '{k}'" for k in A.STOP_WORDS) + " END AS language FROM v",
    "document_slugs": f"SELECT p_partkey, {T.slugify_sql('p_name')} AS slug FROM part",
    "document_folded": f"SELECT doc_id, md5({T.fold_sql('text')}) AS folded_md5, substring(md5(coalesce(text, '')), 1, 12) AS short_key, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}')) AS BIGINT) AS n_words, len(regexp_extract_all(lower(coalesce(text, '')), {lit(T.WIDE_WORD)})) AS n_wide_words FROM documents",
    "index_rate_by_language": oracle("fx_coverage", COVER + f", g AS (SELECT CASE WHEN code IN ('fr', 'en', 'es', 'de', 'it', 'pt', 'nl') THEN code ELSE 'main' END AS language, indexed FROM f) SELECT language, count(*) AS total, count(*) FILTER (indexed) AS indexed, {R('count(*) FILTER (indexed) * 100.0::DOUBLE / count(*)', 1)} AS rate FROM g GROUP BY ROLLUP (language)"),
    "index_classes": oracle("fx_coverage", COVER + "SELECT class, coverage_state, count(*) AS pages FROM k GROUP BY ALL"),
    "index_recommendation": oracle("fx_coverage", COVER + """
, n AS (SELECT count(*) FILTER (class <> 'indexed') AS missing, count(*) FILTER (class = 'resubmit') AS resubmit, count(*) FILTER (class = 'enrich') AS enrich, count(*) FILTER (class = 'prune') AS prune FROM k)
SELECT *, CASE WHEN missing = 0 THEN 'none' WHEN enrich * 3 >= missing THEN 'enrich' WHEN resubmit * 3 >= missing THEN 'resubmit' WHEN prune * 3 >= missing THEN 'prune' ELSE 'mixed' END AS recommendation FROM n"""),
}
