"""The views that the analytics queries start from, derived from the input tables.

One SQL text serves both engines: braces name the tables a view reads, which
Spark replaces by DataFrames and the oracle by table or view names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillspan.workspace import table

VIEWS = {
    "fx_search": """
SELECT user_id % 10 AS site_id, event_id, concat(event_type, '-', CAST(event_id % 23 AS STRING)) AS query,
       concat('/p/', CAST(event_id % 25 AS STRING)) AS page, CAST(ts AS DATE) AS dt, ts,
       CAST((event_id * 31) % 60 + 1 AS DOUBLE) AS position, event_id % 90 + 1 AS impressions, event_id % 9 AS clicks
FROM {events}""",
    "fx_keywords": """
SELECT site_id, query AS keyword,
       min(CASE WHEN dt >= DATE '2024-01-16' THEN position END) AS current_position,
       min(CASE WHEN dt < DATE '2024-01-16' THEN position END) AS previous_position,
       min(position) AS best_position,
       CAST(sum(CASE WHEN dt >= DATE '2024-01-16' THEN impressions ELSE 0 END) AS BIGINT) AS impressions,
       CAST(sum(CASE WHEN dt >= DATE '2024-01-16' THEN clicks ELSE 0 END) AS BIGINT) AS clicks,
       count(*) * 10 AS search_volume
FROM {fx_search} GROUP BY site_id, query""",
    "fx_sites": "SELECT s_suppkey AS site_id, s_name AS name, s_suppkey % 7 <> 0 AS is_active FROM {supplier} WHERE s_suppkey < 10",
    "fx_pages": """
SELECT o_orderkey AS page_id, o_custkey % 10 AS site_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS cms_id,
       concat('/p/', CAST(o_orderkey % 25 AS STRING)) AS url,
       CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'updated' ELSE 'pending' END AS status,
       o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS updated_at
FROM {orders} WHERE o_orderkey % 10 = 0""",
    "fx_actions": """
SELECT o_orderkey AS action_id, o_custkey % 10 AS site_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 10 END AS page_id,
       concat(CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'purchase' END, '-', CAST(o_orderkey % 23 AS STRING)) AS keyword,
       CASE o_orderkey % 3 WHEN 0 THEN 'optimize' WHEN 1 THEN 'create' ELSE 'geoloc' END AS action_type,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'validated' END END AS status,
       o_totalprice / 100 AS impact_score, CAST(0.04 AS DOUBLE) AS estimated_api_cost,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice / 1000000 END AS actual_api_cost, o_orderdate AS executed_at
FROM {orders} WHERE o_orderkey % 7 = 0""",
    "fx_nodes": """
SELECT c_custkey AS url, CAST(floor(abs(c_acctbal)) AS INT) % 1200 AS word_count, c_nationkey AS cluster, c_mktsegment AS city,
       CASE WHEN c_custkey % 11 = 0 THEN 'en' ELSE 'fr' END AS language
FROM {customer}""",
    "fx_links": """
SELECT o_custkey AS src, (o_orderkey * 7 + 3) % (SELECT count(*) FROM {customer}) AS dst, o_orderpriority AS anchor,
       o_orderpriority = '1-URGENT' AS nofollow, o_orderkey AS pos
FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 100000""",
    "fx_places": """
SELECT c_custkey AS place_id, c_name AS name, lower(c_name) AS slug, CAST(c_nationkey AS STRING) AS department, r_name AS region,
       CAST(floor(abs(c_acctbal)) AS INT) AS population,
       42 + CAST(c_custkey * 37 % 900 AS DOUBLE) / 100 AS lat, -5 + CAST(c_custkey * 53 % 1300 AS DOUBLE) / 100 AS lng
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "fx_coverage": """
SELECT url, page_id % 3 = 0 AS indexed,
       CASE WHEN page_id % 3 = 0 THEN 'PASS' WHEN page_id % 7 = 0 THEN 'ERROR' ELSE 'NEUTRAL' END AS verdict,
       CASE WHEN page_id % 3 = 0 THEN 'submitted and indexed'
            ELSE CASE page_id % 5 WHEN 0 THEN 'discovered - currently not indexed' WHEN 1 THEN 'crawled - currently not indexed'
                 WHEN 2 THEN 'soft 404' WHEN 3 THEN '' ELSE 'not found (404)' END END AS coverage_state
FROM {pages}""",
}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or an input table of that name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs(VIEWS[name])})


def oracle(views: str, body: str) -> str:
    """DuckDB SQL: ``body`` after the CTEs of ``views`` and those they read; body may go on with ', name AS (...)'."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in needs(VIEWS[name]):
                add(n)
            order.append(name)

    for v in views.split():
        add(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].format(**{n: n for n in needs(VIEWS[v])})})" for v in order)
    return f"WITH RECURSIVE {ctes}\n{body}" if ctes else body
