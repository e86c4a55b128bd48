"""Queries over the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.numbers import half_up_sql as R
from quillspan.operators import graph as G
from quillspan.sources.fixtures import oracle, view

HOME = 0
ROUNDS = 50


def _nodes(s, d):
    return view(s, d, "fx_nodes")


def _anchors(s, d):
    return view(s, d, "fx_links")


def _edges(s, d):
    return G.edges(_nodes(s, d), _anchors(s, d))


def _metrics(s, d, **parts):
    return G.metrics(_nodes(s, d), _anchors(s, d), HOME, ROUNDS, settle=True, **parts)


QUERIES = {
    "graph_inlinks": lambda s, d: G.inlinks(_nodes(s, d), _edges(s, d)),
    "graph_pagerank": lambda s, d: G.pagerank(_nodes(s, d), _edges(s, d), ROUNDS, settle=True).select("url", "pagerank"),
    "graph_depth": lambda s, d: G.click_depth(_nodes(s, d), _edges(s, d), HOME),
    "graph_report": lambda s, d: _metrics(s, d).select("url", "inlinks", "internal_out", "pagerank", F.coalesce("depth", F.lit(-1)).alias("depth"), G.node_type(HOME).alias("node_type")),
    "graph_orphans": lambda s, d: G.orphans(_metrics(s, d, rank=False), HOME),
    "graph_node_types": lambda s, d: _metrics(s, d, rank=False, depth=False).groupBy(G.node_type(HOME).alias("node_type")).agg(F.count("*").alias("pages")),
    "graph_top_linked": lambda s, d: G.top_linked(_metrics(s, d, depth=False)),
    "graph_sinks": lambda s, d: G.sinks(_metrics(s, d, depth=False), HOME),
    "graph_generic_anchors": lambda s, d: G.generic_anchors(_nodes(s, d), _anchors(s, d).withColumn("anchor", F.when(F.col("anchor") == "5-LOW", "Cliquez ici").when(F.col("anchor") == "3-MEDIUM", "Découvrir").otherwise(F.col("anchor")))).select("src", "dst", "anchor", "pos"),
    "graph_anchor_audit": lambda s, d: G.over_optimised(_nodes(s, d), _anchors(s, d), 3, 0.6),
    "graph_clusters": lambda s, d: G.clusters(_nodes(s, d)).withColumn("cities", F.array_join("cities", ",")),
    "graph_silos": lambda s, d: G.silos(_nodes(s, d), _edges(s, d)),
    "graph_cannibalisation": lambda s, d: G.cannibalisation(_nodes(s, d)),
    "graph_suggestions": lambda s, d: G.suggestions(_metrics(s, d), _edges(s, d), HOME),
    "graph_health": lambda s, d: G.health(_metrics(s, d, rank=False), _nodes(s, d), _anchors(s, d), G.silos(_nodes(s, d), _edges(s, d)), HOME),
}

EDGES = ", e AS MATERIALIZED (SELECT DISTINCT src, dst FROM fx_links WHERE NOT nofollow AND src <> dst AND dst IN (SELECT url FROM fx_nodes) AND src IN (SELECT url FROM fx_nodes))"
IN = ", inl AS (SELECT n.url, count(e.src) AS inlinks FROM fx_nodes n LEFT JOIN e ON e.dst = n.url GROUP BY n.url)"
_steps = "".join(
    f", r{i} AS MATERIALIZED (SELECT b.url, 0.15::DOUBLE / b.n + 0.85::DOUBLE * (SELECT coalesce(sum(p.raw), 0) FROM r{i - 1} p JOIN bn q USING (url) WHERE q.degree IS NULL) / b.n + 0.85::DOUBLE * coalesce(f.flow, 0) AS raw FROM bn b LEFT JOIN "
    f"(SELECT e.dst, sum(p.raw / q.degree) AS flow FROM e JOIN r{i - 1} p ON p.url = e.src JOIN bn q ON q.url = e.src GROUP BY e.dst) f ON f.dst = b.url)"
    for i in range(1, ROUNDS + 1)
)
RANK = (
    EDGES + ", bn AS MATERIALIZED (SELECT n.url, g.degree, (SELECT count(*) FROM fx_nodes)::DOUBLE AS n FROM fx_nodes n LEFT JOIN (SELECT src, count(*) AS degree FROM e GROUP BY src) g ON g.src = n.url), r0 AS MATERIALIZED (SELECT url, 1.0::DOUBLE / n AS raw FROM bn)"
    + _steps + f", pr AS MATERIALIZED (SELECT url, {R(f'raw / (SELECT max(raw) FROM r{ROUNDS}) * 100.0::DOUBLE', 1)} AS pagerank FROM r{ROUNDS})"
)
DEPTH = f", bfs AS (SELECT url, 0 AS depth FROM fx_nodes WHERE url = {HOME} UNION SELECT e.dst, b.depth + 1 FROM bfs b JOIN e ON e.src = b.url WHERE b.depth < 60), dp AS MATERIALIZED (SELECT n.url, min(b.depth) AS depth FROM fx_nodes n LEFT JOIN bfs b USING (url) GROUP BY n.url)"
METRICS = RANK + IN + DEPTH + """
, m AS MATERIALIZED (SELECT n.*, inlinks, coalesce(f.c, 0) AS followed_out, coalesce(o.c, 0) AS internal_out, pagerank, depth FROM fx_nodes n JOIN inl USING (url) JOIN pr USING (url) JOIN dp USING (url)
  LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY 1) f ON f.src = n.url LEFT JOIN (SELECT src, count(DISTINCT dst) AS c FROM fx_links GROUP BY 1) o ON o.src = n.url)"""  # fmt: skip
TYPE = f"CASE WHEN url = {HOME} THEN 'home' WHEN internal_out = 0 AND inlinks >= 2 THEN 'sink' WHEN internal_out >= 15 AND inlinks >= 1 THEN 'hub' WHEN inlinks = 0 THEN 'source' ELSE 'normal' END"
SILOS = f"""
, mem AS (SELECT url, cluster FROM fx_nodes WHERE cluster IS NOT NULL AND city <> ''), sz AS (SELECT cluster, count(*) AS pages FROM mem GROUP BY 1 HAVING count(*) >= 3)
, into_ AS (SELECT e.src, e.dst, m1.cluster FROM e JOIN mem m1 ON m1.url = e.dst), intra AS (SELECT i.cluster, count(*) AS n FROM into_ i JOIN mem m2 ON m2.url = i.src AND m2.cluster = i.cluster GROUP BY 1)
, cov AS (SELECT cluster, src, count(*) AS covered FROM into_ GROUP BY 1, 2), hub AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY covered DESC, src) AS r FROM cov) WHERE r = 1)
, si AS (SELECT sz.cluster, pages, {R('coalesce(intra.n, 0) / (pages * (pages - 1))::DOUBLE', 3)} AS density, CASE WHEN coalesce(covered, 0) / pages::DOUBLE >= 0.5 THEN src END AS hub, {R('coalesce(covered, 0) / pages::DOUBLE * 100.0::DOUBLE')}::INT AS hub_coverage
  FROM sz LEFT JOIN intra USING (cluster) LEFT JOIN hub USING (cluster))
, silo AS (SELECT *, CASE WHEN density >= 0.15 THEN 'strong' WHEN density >= 0.05 THEN 'medium' ELSE 'weak' END AS cohesion FROM si)"""
_KEYS = [", ".join(["language", *c]) for _, c in G.RELEVANCE]
_SCORE = "CASE level " + " ".join(f"WHEN {k} THEN {r}::DOUBLE" for k, (r, _) in enumerate(G.RELEVANCE)) + " END"
_lists = lambda rel, cols: " UNION ALL ".join(f"SELECT {cols}, {k} AS level, concat_ws('/', {key}) AS key FROM {rel} WHERE concat_ws('/', {key}) IS NOT NULL" for k, key in enumerate(_KEYS))
#: More rounds than the assignment takes on the tables it is checked on; a round without open targets changes nothing.
ASSIGN_ROUNDS = 14


def _assign_round(k: int) -> str:
    """Round k over the targets without a row in won0 .. won(k-1) and the places left after them."""
    done = " UNION ALL ".join(f"SELECT * FROM won{i}" for i in range(k)) or "SELECT NULL::BIGINT AS target, NULL::BIGINT AS donor, 0 AS level WHERE false"
    return f""", done{k} AS MATERIALIZED ({done}), open{k} AS MATERIALIZED (SELECT d.donor, 8 - count(w.target) AS left_ FROM donors d LEFT JOIN done{k} w ON w.donor = d.donor GROUP BY d.donor HAVING count(w.target) < 8)
, ask{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY level, key ORDER BY need DESC, target) AS p FROM tl WHERE target NOT IN (SELECT target FROM done{k}))
, pl{k} AS MATERIALIZED (SELECT dl.*, left_, sum(left_) OVER (PARTITION BY level, key ORDER BY strength DESC, dl.donor) AS upto, row_number() OVER (PARTITION BY level, key ORDER BY strength DESC, dl.donor) AS nth FROM dl JOIN open{k} USING (donor))
, of{k} AS MATERIALIZED (SELECT a.target, q.donor, level, q.strength * {_SCORE} AS score, a.need FROM ask{k} a JOIN pl{k} q USING (level, key) WHERE a.p > q.upto - q.left_ AND a.p <= q.upto AND q.donor <> a.target AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = q.donor AND e.dst = a.target))
, st{k} AS MATERIALIZED (SELECT a.target, arg_min(q.donor, q.nth) AS donor, 3 AS level, max(q.strength) * 0.3::DOUBLE AS score, any_value(a.need) AS need FROM ask{k} a JOIN pl{k} q USING (level, key)
  WHERE level = 3 AND a.target NOT IN (SELECT target FROM of{k}) AND q.donor <> a.target AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = q.donor AND e.dst = a.target) GROUP BY a.target)
, be{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, level, donor) AS r FROM (SELECT * FROM of{k} UNION ALL SELECT * FROM st{k})) WHERE r = 1)
, won{k} AS MATERIALIZED (SELECT target, donor, level FROM (SELECT b.*, left_, row_number() OVER (PARTITION BY donor ORDER BY need DESC, target) AS n FROM be{k} b JOIN open{k} USING (donor)) WHERE n <= left_)"""


SUGGEST = METRICS + f"""
, donors AS MATERIALIZED (SELECT url AS donor, cluster, city, language, pagerank / (followed_out + 1) AS power, pagerank / (followed_out + 1) / (1 + coalesce(depth, 0) / 3.0::DOUBLE) AS strength FROM m)
, want AS MATERIALIZED (SELECT *, url AS target, word_count / (SELECT max(word_count) FROM m)::DOUBLE * (1 - pagerank / 100.0::DOUBLE) * (1 + coalesce(depth, 0) / 4.0::DOUBLE + CASE WHEN inlinks = 0 OR depth IS NULL THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) AS need
  FROM m WHERE url <> {HOME} AND (inlinks = 0 OR depth IS NULL OR depth >= 4 OR (inlinks <= 2 AND word_count >= 300)))
, tl AS MATERIALIZED ({_lists('want', 'target, need')}), dl AS MATERIALIZED ({_lists('donors', 'donor, strength')})
{''.join(map(_assign_round, range(ASSIGN_ROUNDS)))}
, given AS ({' UNION ALL '.join(f'SELECT * FROM won{k}' for k in range(ASSIGN_ROUNDS))})
, picked AS (SELECT target, g.donor, power, {_SCORE} AS relevance FROM given g JOIN donors d ON d.donor = g.donor
  UNION ALL SELECT w.url, h.donor, h.power, CASE WHEN w.language <> h.language THEN 0.0::DOUBLE ELSE 0.3::DOUBLE + CASE WHEN w.cluster = h.cluster THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN w.city = h.city AND w.city <> '' THEN 0.2::DOUBLE ELSE 0 END END
  FROM want w JOIN donors h ON h.donor = {HOME} WHERE w.url NOT IN (SELECT target FROM given) AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = h.donor AND e.dst = w.url))
, kept AS MATERIALIZED (SELECT p.donor, p.target, {R("need * power * greatest(relevance, 0.1::DOUBLE) * 100.0::DOUBLE", 1)} AS impact,
  CASE WHEN inlinks = 0 THEN 'orphan' WHEN depth IS NULL THEN 'unreachable' WHEN depth >= 4 THEN 'deep' ELSE 'potential' END AS reason FROM picked p JOIN want w ON w.url = p.target)
, cnt AS (SELECT count(*) AS c FROM kept), rk AS (SELECT impact, row_number() OVER (ORDER BY impact DESC) AS r FROM kept)
, hi AS (SELECT (SELECT max(impact) FROM rk WHERE r = (SELECT CASE WHEN c > 5 THEN greatest(1, c // 5) ELSE 1 END FROM cnt)) AS hi, (SELECT max(impact) FROM rk WHERE r = (SELECT greatest(1, c // 2) FROM cnt)) AS mid)
SELECT donor, target, impact, reason, CASE WHEN impact >= hi THEN 'high' WHEN impact >= mid THEN 'medium' ELSE 'low' END AS priority FROM kept, hi ORDER BY impact DESC, target LIMIT 150"""

BOTH = "fx_nodes fx_links"
GENERIC = "(" + ", ".join("'" + a + "'" for a in G.GENERIC_ANCHORS) + ")"
ORACLES = {
    "graph_inlinks": oracle(BOTH, EDGES + IN + "SELECT * FROM inl"),
    "graph_pagerank": oracle(BOTH, RANK + "SELECT * FROM pr"),
    "graph_depth": oracle(BOTH, EDGES + DEPTH + "SELECT * FROM dp"),
    "graph_report": oracle(BOTH, METRICS + f"SELECT url, inlinks, internal_out, pagerank, coalesce(depth, -1) AS depth, {TYPE} AS node_type FROM m"),
    "graph_orphans": oracle(BOTH, METRICS + f", f AS (SELECT url, inlinks = 0 AND url <> {HOME} AS orphan, depth IS NULL AND url <> {HOME} AS unreachable, coalesce(depth, 0) >= 4 AS deep FROM m) SELECT * FROM f WHERE orphan OR unreachable OR deep"),
    "graph_node_types": oracle(BOTH, METRICS + f"SELECT {TYPE} AS node_type, count(*) AS pages FROM m GROUP BY 1"),
    "graph_top_linked": oracle(BOTH, METRICS + "SELECT url, inlinks, pagerank, city FROM m ORDER BY pagerank DESC, inlinks DESC, url LIMIT 20"),
    "graph_sinks": oracle(BOTH, METRICS + f"SELECT url, pagerank FROM m WHERE {TYPE} = 'sink' ORDER BY pagerank DESC, url LIMIT 15"),
    "graph_generic_anchors": oracle(BOTH, f", a AS (SELECT src, dst, CASE anchor WHEN '5-LOW' THEN 'Cliquez ici' WHEN '3-MEDIUM' THEN 'Découvrir' ELSE anchor END AS anchor, pos FROM fx_links) SELECT * FROM a WHERE dst IN (SELECT url FROM fx_nodes) AND {T.fold_sql('anchor')} IN {GENERIC}"),
    "graph_anchor_audit": oracle(BOTH, f"""
, c AS (SELECT dst, {T.fold_sql('anchor')} AS anchor, count(*) AS n FROM fx_links WHERE dst IN (SELECT url FROM fx_nodes) GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY dst) AS total, row_number() OVER (PARTITION BY dst ORDER BY n DESC, anchor DESC) AS r FROM c)
SELECT dst, anchor, {R('n / total::DOUBLE * 100.0::DOUBLE')}::INT AS ratio, total::BIGINT AS total FROM b WHERE r = 1 AND total >= 3 AND n / total::DOUBLE >= 0.6 AND anchor <> ''"""),
    "graph_clusters": oracle(BOTH, "SELECT cluster, count(*) AS pages, string_agg(DISTINCT city, ',' ORDER BY city) AS cities FROM fx_nodes WHERE cluster IS NOT NULL AND city <> '' GROUP BY cluster"),
    "graph_silos": oracle(BOTH, EDGES + SILOS + "SELECT * FROM silo"),
    "graph_cannibalisation": oracle(BOTH, "SELECT cluster, city, count(*) AS pages, min(url) AS first_url FROM fx_nodes WHERE cluster IS NOT NULL AND city <> '' GROUP BY ALL HAVING count(*) > 1"),
    "graph_suggestions": oracle(BOTH, SUGGEST),
    "graph_health": oracle(BOTH, METRICS + SILOS + f"""
, q AS (SELECT count(*) AS n, count(*) FILTER (depth <= 3) AS shallow, count(*) FILTER (inlinks = 0 AND url <> {HOME}) AS orphans FROM m), a AS (SELECT count(*) AS anchors, count(*) FILTER (dst IN (SELECT url FROM fx_nodes) AND {T.fold_sql('anchor')} IN {GENERIC}) AS generic FROM fx_links)
, s AS (SELECT count(*) AS silos, count(*) FILTER (cohesion <> 'weak') AS cohesive FROM silo)
, p AS (SELECT {R('shallow * 100.0::DOUBLE / n')}::INT AS depth_pct, {R('(n - orphans) * 100.0::DOUBLE / n')}::INT AS linked_pct, {R('(anchors - generic) * 100.0::DOUBLE / anchors')}::INT AS anchor_pct, CASE WHEN silos = 0 THEN 100 ELSE {R('cohesive * 100.0::DOUBLE / silos')}::INT END AS silo_pct FROM q, a, s)
, z AS (SELECT *, {R('(depth_pct + linked_pct + anchor_pct + silo_pct) / 4.0::DOUBLE')}::INT AS score FROM p)
SELECT *, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'fair' ELSE 'to improve' END AS verdict FROM z"""),
}
