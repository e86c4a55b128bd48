"""Writers and merges: keyword snapshot, history, actions, reports, sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_keywords(snapshot: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """The keyword snapshot after a sync.

    snapshot: (site_id, keyword, current_position, previous_position,
    best_position, impressions, clicks); current and previous: best rows
    (site_id, query, position, impressions, clicks).  Keywords not in
    ``current`` stay as they are.  A known keyword takes the previous window's
    position, else its own last one; a new keyword only the window's.
    """
    now = current.select("site_id", F.col("query").alias("keyword"), F.col("position").alias("new_position"), F.col("impressions").alias("new_impressions"), F.col("clicks").alias("new_clicks"))
    before = previous.select("site_id", F.col("query").alias("keyword"), F.col("position").alias("before"))
    old = snapshot.select("site_id", "keyword", "current_position", "previous_position", "best_position", "impressions", "clicks", F.lit(True).alias("known"))
    both = old.join(now, ["site_id", "keyword"], "full").join(before, ["site_id", "keyword"], "left")
    synced = F.col("new_position").isNotNull()
    return both.select(
        "site_id", "keyword",
        F.coalesce("new_position", "current_position").alias("current_position"),
        F.when(~synced, F.col("previous_position")).when(F.col("known"), F.coalesce("before", "current_position", "previous_position")).otherwise(F.col("before")).alias("previous_position"),
        F.least("best_position", "new_position").alias("best_position"),
        F.coalesce("new_impressions", "impressions").alias("impressions"),
        F.coalesce("new_clicks", "clicks").alias("clicks"),
    )


FILE_ROWS = 5_000_000
#: Entries that one sitemap file may hold by the sitemap protocol.
SITEMAP_URLS = 50_000


def history_rows(current: DataFrame, recorded) -> DataFrame:
    """One history row for each synced keyword; ``recorded`` is a date column or literal."""
    return current.select("site_id", F.col("query").alias("keyword"), "position", "impressions", "clicks", recorded.alias("recorded_date"))


def append_history(rows: DataFrame, path: str) -> None:
    """Append, one folder per day, so that a day's rows are read alone; a large day is cut into several tasks and files."""
    rows.hint("rebalance", "recorded_date").write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy("recorded_date").parquet(path)


def append_actions(candidates: DataFrame, path: str) -> None:
    candidates.write.mode("append").parquet(path)


def write_report(pages: DataFrame, linking: DataFrame, suggestions: DataFrame, cannibal: DataFrame, silos: DataFrame, path: str, fmt: str = "parquet") -> dict[str, str]:
    """The crawl report as five datasets; flags become yes or no and unreachable depth -1 in the linking sheet."""
    yes_no = lambda c: F.when(F.col(c), "yes").otherwise("no")
    flags = [f.name for f in linking.schema if f.dataType.simpleString() == "boolean"]
    linking = linking.withColumns({c: yes_no(c) for c in flags})
    if "depth" in linking.columns:
        linking = linking.withColumn("depth", F.coalesce("depth", F.lit(-1)))
    out = {}
    for name, df in (("pages", pages), ("linking", linking), ("suggestions", suggestions), ("cannibalisation", cannibal), ("silos", silos)):
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        flat = df.withColumns({c: F.to_json(c) for c in nested}) if fmt == "csv" else df
        flat.write.mode("overwrite").option("header", "true").format(fmt).save(f"{path}/{name}")
        out[name] = f"{path}/{name}"
    return out


def url_entry(loc, lastmod):
    """One <url> element; a missing date leaves <lastmod> out."""
    safe = F.replace(F.replace(loc, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<url><loc>"), safe, F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format(lastmod, "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))


def sitemap_index(urls: DataFrame) -> DataFrame:
    """(segment, n_urls, lastmod): the index over the segments of (segment, loc, lastmod)."""
    return urls.groupBy("segment").agg(F.count("*").alias("n_urls"), F.max("lastmod").alias("lastmod"))


def write_sitemaps(urls: DataFrame, path: str) -> DataFrame:
    """Text files of at most SITEMAP_URLS <url> entries, one folder per segment; returns the index rows."""
    entries = urls.select("segment", url_entry(F.col("loc"), F.col("lastmod")).alias("value")).hint("rebalance", "segment")
    entries.write.mode("overwrite").option("maxRecordsPerFile", SITEMAP_URLS).partitionBy("segment").text(path)
    return sitemap_index(urls)


def update_sites(sites: DataFrame, scans: DataFrame) -> DataFrame:
    """Sites with indexed_pages and last_scan_at of the scan; others unchanged."""
    got = scans.select("site_id", F.col("indexed_pages").alias("_pages"), F.col("scanned_at").alias("_at"))
    keep = lambda c, kind: F.col(c) if c in sites.columns else F.lit(None).cast(kind)
    return sites.join(got, "site_id", "left").withColumn("indexed_pages", F.coalesce("_pages", keep("indexed_pages", "bigint"))).withColumn("last_scan_at", F.coalesce("_at", keep("last_scan_at", "timestamp"))).drop("_pages", "_at")


def add_missing_columns(table: DataFrame, wanted: str) -> DataFrame:
    """``table`` with every column of the DDL ``wanted`` that it lacks, as nulls."""
    empty = table.sparkSession.createDataFrame([], wanted)
    return table.unionByName(empty, allowMissingColumns=True)
