"""Index coverage: rates by language, classes of missing pages, what to do about them.

Coverage rows: (url, indexed, verdict, coverage_state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import urls as U
from quillspan.functions.numbers import half_up


def rate_by_language(coverage: DataFrame) -> DataFrame:
    """Pages, indexed pages and rate by language of the first path segment ('main' without one), and in total (language null)."""
    rows = coverage.withColumn("language", U.path_language(F.col("url"), "main"))
    n, hit = F.count("*"), F.count_if("indexed")
    return rows.rollup("language").agg(n.alias("total"), hit.alias("indexed"), half_up(hit * 100.0 / n, 1).alias("rate")).orderBy(F.desc("total"))


def classify():
    """indexed, resubmit, enrich or prune; soft 404 is told apart before other 404 states."""
    state = F.lower(F.coalesce("coverage_state", F.lit("")))
    has = lambda s: state.contains(s)
    return (
        F.when(F.col("indexed"), "indexed").when(has("soft 404"), "enrich").when(has("404") | has("not found") | (F.col("verdict") == "ERROR"), "prune")
        .when(has("crawled"), "enrich").when(has("discovered") | has("unknown") | (state == ""), "resubmit").otherwise("enrich")
    )


def classes(coverage: DataFrame) -> DataFrame:
    return coverage.withColumn("class", classify()).groupBy("class", "coverage_state").agg(F.count("*").alias("pages"))


def recommendation(coverage: DataFrame) -> DataFrame:
    """One row of counts and the class that makes up a third of the missing pages, in order of what helps most."""
    c = F.col("class")
    counts = coverage.withColumn("class", classify()).agg(F.count_if(c != "indexed").alias("missing"), *(F.count_if(c == k).alias(k) for k in ("resubmit", "enrich", "prune")))
    large = lambda k: F.col(k) * 3 >= F.col("missing")
    return counts.withColumn("recommendation", F.when(F.col("missing") == 0, "none").when(large("enrich"), "enrich").when(large("resubmit"), "resubmit").when(large("prune"), "prune").otherwise("mixed"))
