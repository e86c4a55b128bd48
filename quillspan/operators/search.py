"""Search-performance analytics: positions, drops, opportunities, actions and budgets.

Search rows: (site_id, query, page, dt, position, impressions, clicks, event_id).
Keyword rows: (site_id, keyword, current_position, previous_position, ...).
Null positions are left out of averages and comparisons, never read as zero.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import half_up

OPEN_STATUSES = ("pending", "validated", "executing", "failed")
WAITING_STATUSES = ("pending", "validated", "executing")
LAG_DAYS = 3


# --- windows and best rows -------------------------------------------------------------
def date_window(today: dt.date, days: int, offset: int = 0) -> tuple[dt.date, dt.date]:
    """(after, until]: figures arrive three days late; ``offset`` shifts the window back."""
    until = today - dt.timedelta(days=LAG_DAYS + offset)
    return until - dt.timedelta(days=days), until


def rows_in_window(rows: DataFrame, today: dt.date, days: int = 7, offset: int = 0) -> DataFrame:
    """The date bounds are literals, so partitions and row groups outside are not read."""
    after, until = date_window(today, days, offset)
    return rows.filter((F.col("dt") > F.lit(after)) & (F.col("dt") <= F.lit(until)))


def page_queries(rows: DataFrame, page: str, limit: int = 100) -> DataFrame:
    """Query rows of one page, most impressions first."""
    return rows.filter(F.col("page") == page).orderBy(F.desc("impressions"), "event_id").limit(limit)


def best_page(rows: DataFrame) -> DataFrame:
    """Best row of each (site, query): lowest position, then the earliest row. One aggregation, no window sort."""
    first = F.min_by(F.struct("page", "position", "impressions", "clicks", "event_id"), F.struct("position", "event_id"))
    return rows.groupBy("site_id", "query").agg(first.alias("b")).select("site_id", "query", "b.page", "b.position", "b.impressions", "b.clicks", "b.event_id")


def position_changes(rows: DataFrame, today: dt.date, days: int = 7) -> DataFrame:
    """Current best row of each query with the best position of the window before, if any."""
    now = best_page(rows_in_window(rows, today, days))
    before = best_page(rows_in_window(rows, today, days, days)).select("site_id", "query", F.col("position").alias("previous_position"))
    return now.join(before, ["site_id", "query"], "left")


def drops(rows: DataFrame, today: dt.date, least: float = 3.0) -> DataFrame:
    """Queries that lost at least ``least`` positions, largest loss first."""
    lost = F.col("position") - F.col("previous_position")
    return (
        position_changes(rows, today).withColumn("delta", lost).filter(F.col("delta") >= least)
        .select("site_id", "query", "page", F.col("position").alias("current_position"), "previous_position", "delta", "impressions")
        .orderBy(F.desc("delta"), "site_id", "query")
    )


# --- keyword tables --------------------------------------------------------------------
def opportunities(keywords: DataFrame, min_impressions: int = 20, beyond: float = 10.0) -> DataFrame:
    score = half_up(F.col("impressions") * (F.col("current_position") / 10.0), 1)
    return (
        keywords.filter((F.col("impressions") > min_impressions) & (F.col("current_position") > beyond))
        .select("site_id", "keyword", "impressions", "current_position", score.alias("opportunity_score"))
        .orderBy(F.desc("impressions"), "site_id", "keyword")
    )


def keyword_drops(keywords: DataFrame, least: float = 3.0) -> DataFrame:
    delta = F.col("current_position") - F.col("previous_position")
    return keywords.filter(delta >= least).withColumn("loss", delta).orderBy(F.desc("loss"), "site_id", "keyword")


def top_opportunities(keywords: DataFrame, sites: DataFrame, n: int = 5) -> DataFrame:
    """The n largest over all sites, with the site's name."""
    found = keywords.filter((F.col("impressions") > 20) & (F.col("current_position") > 10))
    return found.join(sites.select("site_id", "name"), "site_id").select("site_id", F.col("name").alias("site_name"), "keyword", "impressions", "current_position").orderBy(F.desc("impressions"), "site_id", "keyword").limit(n)


BUCKETS = ((0, 3, "top_3"), (3, 10, "top_4_10"), (10, 20, "top_11_20"), (20, 50, "top_21_50"), (50, None, "beyond_50"))


def _bucket_counts():
    p = F.col("current_position")
    return [F.count_if((p > lo) & (p <= hi) if hi else p > lo).alias(name) for lo, hi, name in BUCKETS]


def buckets(keywords: DataFrame) -> DataFrame:
    """One row, each keyword with a position in exactly one bucket."""
    return keywords.agg(*_bucket_counts(), F.count("current_position").alias("total"))


def cumulative_buckets(keywords: DataFrame) -> DataFrame:
    p = F.col("current_position")
    counts = [F.count_if(p <= n).alias(f"top_{n}") for n in (3, 10, 20, 50)]
    return keywords.groupBy("site_id").agg(*counts, F.count_if(p > 50).alias("beyond_50"), F.count("current_position").alias("total"))


def mean_positions():
    """Means over their own non-null rows: current and previous come from different keywords. The change needs both."""
    now, before = F.avg("current_position"), F.avg("previous_position")
    return [half_up(now, 1).alias("avg_position"), half_up(before, 1).alias("prev_avg_position"), F.coalesce(half_up(before - now, 1), F.lit(0.0)).alias("position_delta")]


def overview(sites: DataFrame, pages: DataFrame, actions: DataFrame, keywords: DataFrame) -> DataFrame:
    """The dashboard's totals: one pass per table, joined as single rows."""
    pending = F.col("status") == "pending"
    parts = [
        sites.agg(F.count_if("is_active").alias("total_sites")),
        pages.agg(F.count_if(F.col("status") == "published").alias("total_pages")),
        actions.agg(
            F.count_if(pending).alias("pending_actions"),
            F.count_if(pending & (F.col("action_type") == "optimize")).alias("pending_optimizations"),
            F.count_if(pending & F.col("action_type").isin("create", "geoloc")).alias("pending_creations"),
        ),
        keywords.agg(F.count("current_position").alias("total_keywords"), *mean_positions(), *_bucket_counts()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def _top_list(rows: DataFrame, order, fields, name: str, n: int = 10) -> DataFrame:
    """Per site one row per keyword, then the first n as text lines in order."""
    by_keyword = Window.partitionBy("site_id", "keyword").orderBy(*order)
    by_site = Window.partitionBy("site_id").orderBy(*order)
    ranked = rows.withColumn("_k", F.row_number().over(by_keyword)).filter("_k = 1").withColumn("_r", F.row_number().over(by_site)).filter(F.col("_r") <= n)
    line = F.concat_ws(":", "keyword", *fields)
    listed = F.array_sort(F.collect_list(F.struct("_r", line.alias("line"))))
    return ranked.groupBy("site_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "|").alias(name))


def site_cards(sites: DataFrame, pages: DataFrame, actions: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every active site with its totals, means, first three buckets and its top lists.

    Four aggregations by site and left joins, whatever the number of sites.
    """
    whole = lambda c: F.col(c).cast("bigint")
    by_page = pages.groupBy("site_id").agg(F.count_if(F.col("status") == "published").alias("total_pages"))
    by_action = actions.groupBy("site_id").agg(F.count_if(F.col("status") == "pending").alias("pending_actions"))
    by_keyword = keywords.groupBy("site_id").agg(F.count("*").alias("total_keywords"), *mean_positions(), *_bucket_counts()[:3])
    chances = keywords.filter((F.col("impressions") > 10) & (F.col("current_position") > 10))
    top = _top_list(chances, [F.desc("impressions"), "keyword"], ["impressions", whole("current_position")], "top_opportunities")
    losses = keywords.withColumn("delta", F.col("current_position") - F.col("previous_position")).filter("delta >= 3")
    lost = _top_list(losses, [F.desc("delta"), "keyword"], [whole("previous_position"), whole("current_position"), whole("delta")], "top_drops")
    out = sites.filter("is_active").select("site_id", "name")
    for part in (by_page, by_action, by_keyword, top, lost):
        out = out.join(part, "site_id", "left")
    zero = ("total_pages", "pending_actions", "total_keywords", "top_3", "top_4_10", "top_11_20")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {c: F.coalesce(c, F.lit("")) for c in ("top_opportunities", "top_drops")} | {"position_delta": F.coalesce("position_delta", F.lit(0.0))})


def keyword_list(keywords: DataFrame, sort: str = "position", limit: int = 100) -> DataFrame:
    """Keyword rows with the change, in one of three orders; null positions come last, null volumes first."""
    delta = F.when(F.col("current_position").isNotNull() & F.col("previous_position").isNotNull(), half_up(F.col("previous_position") - F.col("current_position"), 1))
    order = {"position": F.asc_nulls_last("current_position"), "volume": F.desc_nulls_first("search_volume"), "impressions": F.desc_nulls_first("impressions")}[sort]
    return keywords.withColumn("delta", delta).orderBy(order, "site_id", "keyword").limit(max(1, min(limit, 500)))


def known_keywords(rows: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """Distinct trimmed keywords that are not empty, at most ``limit`` in order (a cap of what one run may ask for)."""
    return rows.select(F.trim(F.col(column)).alias("keyword")).filter("keyword <> ''").distinct().orderBy("keyword").limit(limit)


def rank_summary(rows: DataFrame) -> DataFrame:
    """Per site: keywords tracked, with and without a rank of at most 50, top 3 and top 10, mean rank."""
    best = best_page(rows).withColumn("rank", F.when(F.col("position") <= 50, F.col("position")))
    return best.groupBy("site_id").agg(
        F.count("*").alias("tracked"), F.count("rank").alias("ranked"), F.count_if(F.col("rank").isNull()).alias("not_ranked"),
        F.count_if(F.col("rank") <= 3).alias("top3"), F.count_if(F.col("rank") <= 10).alias("top10"), half_up(F.avg("rank"), 1).alias("avg_rank"),
    )


def history_changes(rows: DataFrame) -> DataFrame:
    """Position of each (site, keyword) by day, the change from the record before, and the best so far."""
    daily = rows.groupBy("site_id", F.col("query").alias("keyword"), F.col("dt").alias("recorded_at")).agg(F.min("position").alias("position"))
    w = Window.partitionBy("site_id", "keyword").orderBy("recorded_at")
    return daily.withColumn("change", F.col("position") - F.lag("position").over(w)).withColumn("best_position", F.min("position").over(w))


def indexed_pages(rows: DataFrame, sitemaps: DataFrame | None, today: dt.date, days: int = 28) -> DataFrame:
    """Per site: pages indexed by the sitemaps' contents, else distinct pages seen in the window.

    ``sitemaps``: (site_id, contents ARRAY<STRUCT<submitted, indexed>>) or None.
    """
    seen = rows_in_window(rows, today, days).groupBy("site_id").agg(F.countDistinct("page").alias("pages_seen"))
    if sitemaps is None:
        return seen.select("site_id", F.lit(None).cast("bigint").alias("submitted"), F.col("pages_seen").alias("indexed_pages"))
    sums = sitemaps.select("site_id", F.inline("contents")).groupBy("site_id").agg(F.sum("submitted").alias("submitted"), F.sum("indexed").alias("indexed"))
    both = seen.join(sums, "site_id", "full")
    return both.select("site_id", F.coalesce("submitted", F.lit(0)).alias("submitted"), F.coalesce(F.nullif("indexed", F.lit(0)), "pages_seen").alias("indexed_pages"))


# --- enrichment ------------------------------------------------------------------------
COMPETITION = {"LOW": 25.0, "MEDIUM": 50.0, "HIGH": 85.0}


def enrich_volumes(keywords: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volume and difficulty by keyword; difficulty is the first of its three sources that is there.

    ``volumes``: (keyword, search_volume, keyword_difficulty, competition_index, competition).
    """
    label = F.create_map(*(F.lit(x) for kv in COMPETITION.items() for x in kv))
    got = volumes.select("keyword", F.col("search_volume").alias("new_volume"), F.coalesce("keyword_difficulty", "competition_index", F.try_element_at(label, F.upper("competition"))).alias("new_difficulty"))
    joined = keywords.join(got, "keyword", "left")
    old = F.col("difficulty") if "difficulty" in keywords.columns else F.lit(None).cast("double")
    return joined.withColumn("search_volume", F.coalesce("new_volume", "search_volume")).withColumn("difficulty", F.coalesce("new_difficulty", old)).drop("new_volume", "new_difficulty")


def volume_or_impressions(volume, impressions):
    """The search volume where it is positive, else impressions."""
    return F.when(volume > 0, volume).otherwise(impressions)


def page_lookup(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id of each row's page: by URL without a final slash, else by last path segment; two equi joins, no OR join.

    Several pages of one URL or slug: the smallest id.
    """
    bare = lambda c: F.rtrim(c, F.lit("/"))
    slug = lambda c: F.element_at(F.split(bare(c), "/"), -1)
    by_url = pages.groupBy("site_id", bare(F.col("url")).alias("_url")).agg(F.min("page_id").alias("_by_url"))
    by_slug = pages.groupBy("site_id", slug(F.col("url")).alias("_slug")).agg(F.min("page_id").alias("_by_slug"))
    keyed = rows.withColumn("_url", bare(F.col("page"))).withColumn("_slug", slug(F.col("page")))
    return keyed.join(by_url, ["site_id", "_url"], "left").join(by_slug, ["site_id", "_slug"], "left").withColumn("page_id", F.coalesce("_by_url", "_by_slug")).drop("_url", "_slug", "_by_url", "_by_slug")


# --- actions ---------------------------------------------------------------------------
def candidate_actions(rows: DataFrame, keywords: DataFrame, today: dt.date) -> DataFrame:
    """Optimise candidates (drops of 3 or more) and create candidates (position over 20, over 50 impressions), the
    second without the queries of the first; impact from volume or impressions."""
    changes = position_changes(rows, today).join(keywords.select("site_id", F.col("keyword").alias("query"), "search_volume"), ["site_id", "query"], "left")
    volume = volume_or_impressions(F.col("search_volume"), F.col("impressions"))
    base = changes.withColumn("volume", volume).withColumn("loss", F.col("position") - F.col("previous_position"))
    common = ["site_id", F.col("query").alias("keyword"), "page", F.col("position").alias("current_position"), "previous_position", "impressions", F.col("volume").alias("search_volume")]
    optimise = base.filter("loss >= 3").select(F.lit("optimize").alias("action_type"), *common, (F.col("volume") * F.col("loss")).alias("impact_score"), F.lit(0.04).alias("estimated_api_cost"))
    create = base.filter("position > 20 AND impressions > 50").select(F.lit("create").alias("action_type"), *common, (F.col("volume") * (F.col("position") / 10.0)).alias("impact_score"), F.lit(0.03).alias("estimated_api_cost"))
    create = create.join(optimise.select("site_id", "keyword"), ["site_id", "keyword"], "left_anti").select(*optimise.columns)
    return optimise.unionByName(create)


def diversify(actions: DataFrame, per_page: int = 3, per_site: int = 50, page_of_creates: bool = True) -> DataFrame:
    """By impact at most ``per_page`` actions of a page, then the first ``per_site`` of a site.

    Without ``page_of_creates`` all create actions of a site count as one page.
    """
    page = F.col("page") if page_of_creates else F.when(F.col("action_type") == "optimize", F.col("page")).otherwise(F.lit(""))
    by_page = Window.partitionBy("site_id", "_page").orderBy(F.desc("impact_score"), "keyword")
    by_site = Window.partitionBy("site_id").orderBy(F.desc("impact_score"), "keyword")
    return actions.withColumn("_page", page).withColumn("_n", F.row_number().over(by_page)).filter(F.col("_n") <= per_page).withColumn("rank", F.row_number().over(by_site)).filter(F.col("rank") <= per_site).drop("_page", "_n")


def new_actions(candidates: DataFrame, actions: DataFrame) -> DataFrame:
    """Candidates whose (site, keyword) has no pending action; of equal keywords the one of highest impact."""
    pending = actions.filter(F.col("status") == "pending").select("site_id", "keyword").distinct()
    w = Window.partitionBy("site_id", "keyword").orderBy(F.desc("impact_score"), "action_type")
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(pending, ["site_id", "keyword"], "left_anti")


def action_queue(actions: DataFrame, sites: DataFrame, status: str | None = None, site_id: int | None = None, limit: int = 100) -> DataFrame:
    """Actions of a status, else all open ones, by impact; site names left blank where unknown."""
    rows = actions.filter(F.col("status") == status) if status else actions.filter(F.col("status").isin(*OPEN_STATUSES))
    if site_id is not None:
        rows = rows.filter(F.col("site_id") == site_id)
    top = rows.orderBy(F.desc_nulls_first("impact_score"), "action_id").limit(min(limit, 100))
    return top.join(sites.select("site_id", "name"), "site_id", "left").select("action_id", "site_id", F.coalesce("name", F.lit("")).alias("site_name"), "keyword", "action_type", "status", "impact_score")


def action_history(actions: DataFrame, limit: int = 50) -> DataFrame:
    return actions.filter(F.col("status").isin("done", "failed")).orderBy(F.desc_nulls_first("executed_at"), "action_id").limit(limit).select("action_id", "site_id", "keyword", "action_type", "status", F.date_format("executed_at", "yyyy-MM-dd").alias("executed_on"))


def refresh_candidates(pages: DataFrame, actions: DataFrame, n: int = 5) -> DataFrame:
    """Per site the n oldest pages with a CMS id among the 2n oldest that have no open action; impact 10."""
    n = max(1, min(n, 25))
    w = Window.partitionBy("site_id").orderBy(F.asc_nulls_first("updated_at"), F.asc("created_at"), "page_id")
    oldest = pages.filter(F.col("cms_id").isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * n)
    blocked = actions.filter(F.col("status").isin(*WAITING_STATUSES) & F.col("page_id").isNotNull()).select("site_id", "page_id").distinct()
    free = oldest.join(blocked, ["site_id", "page_id"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy("_r")))
    return free.filter(F.col("rank") <= n).select("site_id", "page_id", "url", "rank", F.lit("optimize").alias("action_type"), F.lit(10.0).alias("impact_score"), F.lit(0.04).alias("estimated_api_cost"))


def budget(actions: DataFrame) -> DataFrame:
    """Spent, pending and projected cost, in total (action_type null) and by type: one rollup."""
    done = F.col("status") == "done"
    spent = F.coalesce(F.sum(F.when(done, F.col("actual_api_cost"))), F.lit(0.0))
    pending = F.coalesce(F.sum(F.when(F.col("status").isin(*WAITING_STATUSES), F.col("estimated_api_cost"))), F.lit(0.0))
    n_done = F.count_if(done)
    return actions.rollup("action_type").agg(
        half_up(spent, 4).alias("actual_spent"), half_up(pending, 2).alias("estimated_pending"), half_up(spent + pending, 2).alias("projected_total"),
        n_done.alias("actions_done"), F.coalesce(half_up(F.try_divide(spent, n_done), 5), F.lit(0.0)).alias("avg_cost_per_action"),
    )


def scan_totals(rows: DataFrame, keywords: DataFrame, today: dt.date) -> DataFrame:
    """What a scan of all sites finds, per site and in total (site_id null); all sites in one job."""
    actions = diversify(candidate_actions(rows, keywords, today))
    synced = best_page(rows_in_window(rows, today)).groupBy("site_id").agg(F.count("*").alias("keywords_synced"))
    found = actions.groupBy("site_id").agg(F.count_if(F.col("action_type") == "optimize").alias("optimizations"), F.count_if(F.col("action_type") == "create").alias("new_content"))
    joined = synced.join(found, "site_id", "left").fillna(0, ["optimizations", "new_content"])
    return joined.rollup("site_id").agg(F.sum("keywords_synced").alias("keywords_synced"), F.sum("optimizations").alias("optimizations"), F.sum("new_content").alias("new_content"))
