"""Readers of landed files: gazetteer, city dictionary, feeds, reports, sitemaps, robots, usage logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.numbers import safe_float, safe_int, token_cost
from quillspan.workspace import materialize

# Positions in the headerless place file.
PLACE_COLUMNS = {1: "department", 2: "slug", 5: "name", 8: "postal_code", 14: "population", 19: "lng", 20: "lat"}


def entity(spark: SparkSession, path: str, drop: tuple[str, ...] = ("password", "token", "secret", "app_password", "token_json")) -> DataFrame:
    """An entity table; columns that hold credentials are left out at the scan."""
    df = spark.read.parquet(path)
    return df.select(*(c for c in df.columns if not any(c.lower().endswith(d) for d in drop)))


def places_csv(spark: SparkSession, path: str, regions: dict[str, str], departments: list[str] | None = None, wanted_regions: list[str] | None = None, min_population: int = 0) -> DataFrame:
    """Places from the positional file: first postal code of a list, malformed rows skipped, region by department."""
    width = max(PLACE_COLUMNS) + 1
    raw = spark.read.schema(", ".join(f"_c{i} string" for i in range(width))).csv(path, mode="PERMISSIVE")
    c = {name: F.col(f"_c{i}") for i, name in PLACE_COLUMNS.items()}
    rows = raw.select(
        c["department"].alias("department"), c["slug"].alias("slug"), c["name"].alias("name"), F.split(c["postal_code"], "-")[0].alias("postal_code"),
        c["population"].try_cast("int").alias("population"), c["lat"].try_cast("double").alias("lat"), c["lng"].try_cast("double").alias("lng"),
    )
    rows = rows.filter("name <> '' AND population IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL").filter(F.col("population") >= min_population)
    if departments:
        rows = rows.filter(F.col("department").isin(*departments))
    table = spark.createDataFrame(list(regions.items()) or [("", "")], "department string, region string")
    out = rows.join(F.broadcast(table), "department", "left").withColumn("region", F.coalesce("region", F.lit("")))
    if wanted_regions:
        out = out.filter(F.col("region").isin(*wanted_regions))
    return out.orderBy(F.desc("population"), "slug")


def city_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(slug, city) of the positional file; slugs of at least four letters, the first row of a slug wins."""
    raw = spark.read.schema(", ".join(f"_c{i} string" for i in range(6))).csv(path)
    rows = raw.select(F.col("_c2").alias("slug"), F.col("_c5").alias("city"), F.monotonically_increasing_id().alias("at")).filter(F.length("slug") >= 4)
    return rows.groupBy("slug").agg(F.min_by("city", "at").alias("city"))


SEARCH_ROW = "keys array<string>, position double, impressions bigint, clicks bigint, ctr double, dt date"


def search_rows(spark: SparkSession, path: str) -> DataFrame:
    """Landed search-analytics rows; rows with fewer than two keys are dropped."""
    rows = spark.read.schema(SEARCH_ROW).json(path).filter(F.size("keys") >= 2)
    return rows.select(F.col("keys")[0].alias("query"), F.col("keys")[1].alias("page"), "position", F.coalesce("impressions", F.lit(0)).alias("impressions"), F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("ctr", F.lit(0.0)).alias("ctr"), "dt")


# Long and short header names of the ;-separated report.
REPORT_COLUMNS = {"keyword": ("Keyword", "Ph"), "position": ("Position", "Po"), "volume": ("Search Volume", "Nq"), "cpc": ("CPC", "Cp"), "url": ("Url", "Ur"), "traffic": ("Traffic (%)", "Tr"), "features": ("SERP Features", "Fk")}
REPORT_WHOLE = ("position", "volume")
REPORT_DECIMAL = ("cpc", "traffic")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of a report under either header; malformed rows are dropped, unreadable numbers are 0."""
    raw = spark.read.option("sep", ";").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    have = set(raw.columns)
    pick = lambda names: F.coalesce(*(F.col(f"`{n}`") for n in names if n in have)) if have & set(names) else F.lit(None).cast("string")
    cols = {k: pick(v) for k, v in REPORT_COLUMNS.items()}
    return raw.select(*((safe_int(c) if k in REPORT_WHOLE else safe_float(c) if k in REPORT_DECIMAL else c).alias(k) for k, c in cols.items()))


# Long and short header names of the overview, competitor and backlink reports.
OVERVIEW_COLUMNS = {"domain": ("Domain", "Dn"), "rank": ("Rank", "Rk"), "keywords": ("Organic Keywords", "Or"), "traffic": ("Organic Traffic", "Ot"), "cost": ("Organic Cost", "Oc")}
COMPETITOR_COLUMNS = {"domain": ("Domain", "Dn"), "relevance": ("Competitor Relevance", "Cr"), "common": ("Common Keywords", "Np"), "keywords": ("Organic Keywords", "Or"), "traffic": ("Organic Traffic", "Ot")}
BACKLINK_COLUMNS = {"authority": ("ascore",), "total": ("total",), "domains": ("domains_num",), "follows": ("follows_num",)}


def read_typed_report(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], text: tuple[str, ...] = ("domain",), decimal: tuple[str, ...] = ("cost", "relevance")) -> DataFrame:
    """Any of the other reports: whole numbers but for the text and decimal columns, 0 where unreadable."""
    raw = spark.read.option("sep", ";").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    have = set(raw.columns)
    pick = lambda names: F.coalesce(*(F.col(f"`{n}`") for n in names if n in have)) if have & set(names) else F.lit(None).cast("string")
    return raw.select(*((pick(v) if k in text else safe_float(pick(v)) if k in decimal else safe_int(pick(v))).alias(k) for k, v in columns.items()))


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    """(sitemap, loc, lastmod) of each <url> in (sitemap, body); an index hands on to the children present in the table."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    rows = bodies.select("sitemap", F.explode(blocks).alias("b"))
    return rows.select("sitemap", F.regexp_extract("b", r"(?s)<loc>\s*(.*?)\s*</loc>", 1).alias("loc"), F.nullif(F.regexp_extract("b", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1), F.lit("")).alias("lastmod")).filter("loc <> ''")


def sitemap_children(bodies: DataFrame) -> DataFrame:
    """(sitemap, child) of index documents."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<sitemap>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1))
    return bodies.select("sitemap", F.explode(blocks).alias("child"))


def sitemap_tree(bodies: DataFrame, root: str) -> DataFrame:
    """URLs of a root sitemap: its own and those of all indexes below it, however deep; an index that names one seen before is not read again."""
    children = materialize(sitemap_children(bodies).filter("child <> ''").distinct(), "sitemap-children")
    seen = new = bodies.sparkSession.createDataFrame([(root,)], "sitemap string")
    while not new.isEmpty():
        below = children.join(new, "sitemap").select(F.col("child").alias("sitemap")).distinct()
        new = materialize(below.join(seen, "sitemap", "left_anti"), "sitemap-new")
        seen = materialize(seen.unionByName(new), "sitemap-seen")
    return sitemap_urls(bodies.join(seen, "sitemap", "left_semi")).dropDuplicates(["loc"])


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host, sitemap) named by robots files."""
    return robots.select("host", F.explode(F.regexp_extract_all(F.coalesce("robots", F.lit("")), F.lit(r"(?i)sitemap:\s*(\S+)"), F.lit(1))).alias("sitemap")).distinct()


def usage_costs(usage: DataFrame, prices: dict[str, tuple[float, float]], currency: float = 1.0) -> DataFrame:
    """Cost of (model, in_tokens, out_tokens) rows by model; unknown models cost null."""
    cost = token_cost(F.col("model"), F.col("in_tokens"), F.col("out_tokens"), prices, currency)
    return usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.round(F.sum(cost), 6).alias("cost"))


def quality_verdicts(rows: DataFrame) -> DataFrame:
    """Per variant of (variant, score, issues): mean, minimum, weak count, first distinct issues."""
    return rows.groupBy("variant").agg(
        F.round(F.avg("score"), 1).alias("avg_score"), F.min("score").alias("min_score"), F.count_if(F.col("score") < 60).alias("weak"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))), 1, 8).alias("issues"),
    )


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the latest by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
