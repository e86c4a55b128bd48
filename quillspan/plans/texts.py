"""Queries on similarity, repetition, places and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import urls as U
from quillspan.functions.numbers import half_up_sql as R
from quillspan.operators import audit
from quillspan.operators import geo as G
from quillspan.operators import minhash as M
from quillspan.operators import similarity as S
from quillspan.operators import visibility as V
from quillspan.sources import sinks
from quillspan.sources.fixtures import oracle, view
from quillspan.workspace import spread


def _docs(s, d):
    return spread(view(s, d, "documents"))


def _titles(s, d):
    """First line of each document as its title."""
    return _docs(s, d).select("doc_id", "source", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"))


def _places(s, d):
    return view(s, d, "fx_places")


def _urls(s, d):
    return _places(s, d).select(F.col("department").alias("segment"), F.concat(F.lit("https://example.org/"), "slug").alias("loc"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("population") % 365).alias("lastmod"))


STOP = sorted({w for words in audit.STOP_WORDS.values() for w in words.split()})
KEYWORDS, LANGS = ["plombier", "serrurier"], ["fr", "en"]

QUERIES = {
    "near_duplicates": lambda s, d: S.best_partner(_docs(s, d)),
    "near_duplicates_lsh": lambda s, d: M.lsh_partner(_docs(s, d)).select("doc_id", "class_id", (F.col("similarity") > 0).alias("similar")),
    "title_near_duplicates": lambda s, d: S.title_pairs(_titles(s, d), "doc_id", "title"),
    "title_groups": lambda s, d: S.title_groups(_titles(s, d).withColumn("city", F.lit(None).cast("string")), STOP, url="doc_id"),
    "title_similarity": lambda s, d: S.title_similarity(_titles(s, d), "source", "doc_id", "title"),
    "uniqueness": lambda s, d: S.uniqueness(_docs(s, d), "source"),
    "word_repetition": lambda s, d: S.repetition(_docs(s, d), 1),
    "fourgram_repetition": lambda s, d: S.repetition(_docs(s, d), 4),
    "burst_share": lambda s, d: S.burst(view(s, d, "fx_search"), "site_id", F.col("dt")),
    "places_filter": lambda s, d: G.places(_places(s, d), regions=["EUROPE", "ASIA"], min_population=2000).select("place_id", "name", "department", "region", "population"),
    "departments": lambda s, d: G.departments(_places(s, d)),
    "dept_directory": lambda s, d: G.directory(_places(s, d)),
    "region_departments": lambda s, d: G.regions(_places(s, d)),
    "places_and_departments": lambda s, d: G.with_departments(_places(s, d)),
    "nearest_places": lambda s, d: G.nearest(_places(s, d)),
    "keyword_plan": lambda s, d: G.expansion_plan(_places(s, d), KEYWORDS, LANGS),
    "linguistic_variants": lambda s, d: G.linguistic_variants(view(s, d, "pages")).withColumn("languages", F.array_join("languages", ",")),
    "sitemap_index": lambda s, d: sinks.sitemap_index(_urls(s, d)).withColumn("lastmod", F.col("lastmod").cast("string")),
    "answer_mentions": lambda s, d: V.mentions(V.answers(view(s, d, "conversations")), "Anthe", "ereti.example.com"),
    "answer_summary": lambda s, d: V.answer_summary(V.mentions(V.answers(view(s, d, "conversations")), "Anthe", "ereti.example.com")),
    "question_grid": lambda s, d: V.question_grid(view(s, d, "conversations")),
}

SETS = f"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}') AS ws FROM documents)
, s AS (SELECT doc_id, source, list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM w)
"""
TITLE = "WITH t AS (SELECT doc_id, source, list_sort(list_distinct(regexp_extract_all(" + T.fold_sql("split_part(coalesce(text, ''), chr(10), 1)") + ", '[a-z0-9]+'))) AS ws FROM documents), f AS (SELECT * FROM t WHERE len(ws) > 0)"
HAVERSINE = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2))))"
_needle = "CASE WHEN contains(low, 'anthe') THEN 'anthe' WHEN contains(low, 'ereti.example.com') THEN 'ereti.example.com' WHEN contains(low, 'ereti') THEN 'ereti' END"
MENTIONS = f"""
WITH a AS (SELECT conv_id, turn, conv_id % 4 AS platform, text, lower(text) AS low FROM conversations WHERE role = 'assistant')
, n AS (SELECT *, {_needle} AS needle FROM a), p AS (SELECT *, instr(low, needle) AS pos_ FROM n)
, q AS (SELECT *, greatest(pos_ - 80, 1) AS b, least(pos_ + length(needle) + 120 - 1, length(text)) AS e FROM p)
, mn AS (SELECT conv_id, turn, platform, needle IS NOT NULL AS mentioned, needle AS matched, CASE WHEN pos_ > 0 THEN (CASE WHEN b > 1 THEN '…' ELSE '' END) || substring(text, b, e - b + 1) || (CASE WHEN e < length(text) THEN '…' ELSE '' END) END AS snippet FROM q)
"""
ORACLES = {
    "near_duplicates": SETS + f"""
, f AS (SELECT doc_id, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0), c AS (SELECT *, min(doc_id) OVER (PARTITION BY sh) AS class_id FROM f)
, c2 AS (SELECT *, min(CASE WHEN doc_id <> class_id THEN doc_id END) OVER (PARTITION BY sh) AS second, count(*) OVER (PARTITION BY sh) AS members FROM c)
, x AS (SELECT doc_id, n, unnest(sh) AS h FROM c2 WHERE doc_id = class_id)
, j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS j FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE >= 0.8)
, bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS r FROM j) WHERE r = 1)
, lk AS (SELECT j.a, sum(h.members) AS near FROM j JOIN c2 h ON h.doc_id = j.b GROUP BY j.a)
SELECT doc_id, CASE WHEN second IS NOT NULL THEN CASE WHEN doc_id = class_id THEN second ELSE class_id END ELSE bst.b END AS partner, CASE WHEN second IS NOT NULL THEN 100 ELSE {R('coalesce(bst.j, 0.0) * 100.0::DOUBLE')}::INT END AS similarity, class_id, (members - 1 + coalesce(lk.near, 0))::BIGINT AS n_links
FROM c2 LEFT JOIN bst ON bst.a = class_id LEFT JOIN lk ON lk.a = class_id UNION ALL SELECT doc_id, NULL, 0, doc_id, 0 FROM s WHERE len(sh) = 0 OR sh IS NULL""",
    # which texts have a partner is found whole on the tables that it is checked on; which of several is shown may differ
    "near_duplicates_lsh": SETS + """
, f AS (SELECT doc_id, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0), c AS (SELECT *, min(doc_id) OVER (PARTITION BY sh) AS class_id, count(*) OVER (PARTITION BY sh) AS members FROM f)
, x AS (SELECT doc_id, n, unnest(sh) AS h FROM c WHERE doc_id = class_id)
, j AS (SELECT DISTINCT a.doc_id AS a FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE >= 0.8)
SELECT doc_id, class_id, members > 1 OR class_id IN (SELECT a FROM j) AS similar FROM c UNION ALL SELECT doc_id, doc_id, false FROM s WHERE len(sh) = 0 OR sh IS NULL""",
    "title_near_duplicates": TITLE + f"""
, c AS (SELECT *, min(doc_id) OVER (PARTITION BY ws) AS class_id FROM f), h AS (SELECT * FROM c WHERE doc_id = class_id)
, x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM h)
, j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS j FROM x a JOIN x b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, {R('j', 4)} AS similarity FROM j WHERE j >= 0.85 UNION ALL SELECT class_id, doc_id, 1.0 FROM c WHERE doc_id <> class_id""",
    "title_groups": TITLE.replace("WITH t AS", "WITH RECURSIVE t AS") + f"""
, k AS (SELECT doc_id, list_filter(ws, lambda w: length(w) > 2 AND w NOT IN ({', '.join("'" + w.replace("'", "''") + "'" for w in STOP)})) AS ws FROM f), v AS MATERIALIZED (SELECT * FROM k WHERE len(ws) > 0)
, later AS (SELECT a.doc_id, list(b.doc_id) AS dup FROM v a JOIN v b ON a.doc_id < b.doc_id AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE >= 0.85 GROUP BY 1)
, nb AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM later)
, g AS (SELECT 0::BIGINT AS r, NULL::BIGINT AS head, []::BIGINT[] AS seen UNION ALL SELECT nb.r, CASE WHEN list_contains(seen, doc_id) THEN NULL ELSE doc_id END, CASE WHEN list_contains(seen, doc_id) THEN seen ELSE list_concat(seen, dup) END FROM g JOIN nb ON nb.r = g.r + 1)
SELECT head AS first_url, substr(array_to_string(ws, ' '), 1, 50) AS key, len(dup) + 1 AS pages FROM g JOIN nb ON nb.doc_id = head JOIN v ON v.doc_id = head""",
    "title_similarity": TITLE + f"""
, r AS (SELECT source AS site, ws, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM f), p AS (SELECT a.site, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::DOUBLE AS j FROM r a JOIN r b ON a.site = b.site AND a.r < b.r)
SELECT site, count(*) AS pairs, {R('avg(j)', 4)} AS mean_jaccard FROM p GROUP BY site""",
    "uniqueness": SETS + f"""
, l AS (SELECT source, sh, lag(sh) OVER (PARTITION BY source ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM s)
, j AS (SELECT source, coalesce(len(list_intersect(sh, b)) / nullif(len(list_distinct(list_concat(sh, b))), 0)::DOUBLE, 0) AS j FROM l WHERE r > 1)
SELECT source, count(*) AS pairs, {R('100.0::DOUBLE * (1.0::DOUBLE - avg(j))', 1)} AS uniqueness FROM j GROUP BY source""",
    "word_repetition": f"WITH g AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{T.WIDE_WORD.replace(chr(39), chr(39) * 2)}'), lambda x: length(x) >= 5)) AS gram FROM documents), c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM c) WHERE rank <= 3",
    "fourgram_repetition": f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{T.WIDE_WORD.replace(chr(39), chr(39) * 2)}') AS ws FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) AS gram FROM w), c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM c) WHERE rank <= 3",
    "burst_share": oracle("fx_search", f", d AS (SELECT site_id AS site, dt, count(*) AS n FROM fx_search GROUP BY ALL) SELECT site, count(*) AS days, sum(n)::BIGINT AS total, {R('max(n) / sum(n)::DOUBLE', 4)} AS burst_share FROM d GROUP BY site"),
    "places_filter": oracle("fx_places", "SELECT place_id, name, department, region, population FROM fx_places WHERE region IN ('EUROPE', 'ASIA') AND population >= 2000"),
    "departments": oracle("fx_places", "SELECT department, min(region) AS region, count(*) AS places, sum(population)::BIGINT AS population, arg_max(name, population * 1000000000 - place_id) AS chief_place, arg_max(lat, population * 1000000000 - place_id) AS lat, arg_max(lng, population * 1000000000 - place_id) AS lng FROM fx_places GROUP BY department").replace("population * 1000000000", "population::HUGEINT * 1000000000"),
    "dept_directory": oracle("fx_places", "SELECT department, count(*) AS places, string_agg(name, '|' ORDER BY name) AS names FROM fx_places GROUP BY department"),
    "region_departments": oracle("fx_places", "SELECT region, string_agg(DISTINCT department, ',' ORDER BY department) AS departments FROM fx_places GROUP BY region"),
    "places_and_departments": oracle("fx_places", "SELECT 'place' AS level, slug AS code, name, population::BIGINT AS population, lat, lng FROM fx_places UNION ALL SELECT 'department', department, department, sum(population)::BIGINT, arg_max(lat, population::HUGEINT * 1000000000 - place_id), arg_max(lng, population::HUGEINT * 1000000000 - place_id) FROM fx_places GROUP BY department"),
    "nearest_places": oracle("fx_places", f", k AS (SELECT a.place_id, b.place_id AS neighbour, {HAVERSINE} AS km FROM fx_places a JOIN fx_places b ON a.place_id <> b.place_id) SELECT place_id, neighbour, {R('km', 1)} AS km, rank FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY km, neighbour) AS rank FROM k) WHERE rank <= 5"),
    "keyword_plan": oracle("fx_places", f"SELECT place_id, keyword, language, keyword || ' à ' || name || ' (' || department || ', ' || region || ')' AS title, CASE language WHEN 'fr' THEN '' ELSE language || '/' END || {T.slugify_sql('''keyword || ' ' || name''')} AS slug, 0.03::DOUBLE AS estimated_cost FROM fx_places, (VALUES ('plombier'), ('serrurier')) k(keyword), (VALUES ('fr'), ('en')) l(language)"),
    "linguistic_variants": "WITH p AS (SELECT regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), l AS (SELECT path, regexp_extract(path, '^/(fr|en|es|de|it|pt|nl)(?:/|$)', 1) AS language FROM p), c AS (SELECT language, regexp_replace(CASE WHEN language = '' THEN path ELSE substring(path, 4) END, '^/+|/+$', '', 'g') AS core FROM l) SELECT core, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(*) AS pages FROM c GROUP BY core",
    "sitemap_index": oracle("fx_places", "SELECT department AS segment, count(*) AS n_urls, CAST(max(DATE '2024-01-01' + population % 365) AS STRING) AS lastmod FROM fx_places GROUP BY department"),
    "answer_mentions": MENTIONS + "SELECT * FROM mn",
    "answer_summary": MENTIONS + f"SELECT platform, count(*) AS asked, count(*) FILTER (mentioned) AS mentioned, {R('count(*) FILTER (mentioned) * 100.0::DOUBLE / count(*)', 1)} AS mention_rate FROM mn GROUP BY platform",
    "question_grid": "WITH q AS (SELECT DISTINCT conv_id FROM conversations), g AS (SELECT conv_id, platform FROM q, (VALUES (0), (1), (2), (3)) p(platform)), a AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT g.conv_id, g.platform, coalesce(CASE WHEN g.conv_id % 4 = g.platform THEN a.n END, 0) AS answers FROM g LEFT JOIN a USING (conv_id)",
}
