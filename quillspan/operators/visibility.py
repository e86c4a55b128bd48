"""Answer-engine visibility: mentions, citations, search results, crawler policy, readiness scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import urls as U
from quillspan.functions.numbers import half_up, ladder
from quillspan.operators import extract

# Crawlers of answer and search engines.
CRAWLERS = (
    "GPTBot", "ChatGPT-User", "OAI-SearchBot", "ClaudeBot", "anthropic-ai", "PerplexityBot", "Bytespider", "CCBot", "Google-Extended", "Googlebot", "Bingbot", "FacebookBot", "Applebot-Extended", "cohere-ai",
)


# --- answers ---------------------------------------------------------------------------
def answers(conversations: DataFrame, platforms: int = 4) -> DataFrame:
    """Assistant turns as answers of a platform."""
    return conversations.filter("role = 'assistant'").select("conv_id", "turn", (F.col("conv_id") % platforms).alias("platform"), "text")


def needles(brand: str, domain: str) -> list[str]:
    """Brand, domain and the domain's first label, each of at least three characters, in order."""
    dom = domain.lower().split("://")[-1].split("/")[0].removeprefix("www.")
    return [n for n in dict.fromkeys((brand.strip().lower(), dom, dom.split(".")[0])) if len(n) >= 3]


def mentions(rows: DataFrame, brand: str, domain: str) -> DataFrame:
    """Each answer with the first needle it holds and the text around it."""
    low, hit = F.lower("text"), None
    for n in needles(brand, domain):
        hit = (F if hit is None else hit).when(low.contains(n), F.lit(n))
    return rows.withColumn("matched", hit).select("conv_id", "turn", "platform", F.col("matched").isNotNull().alias("mentioned"), "matched", T.snippet(F.col("text"), F.col("matched")).alias("snippet"))


def answer_summary(found: DataFrame) -> DataFrame:
    n, m = F.count("*"), F.count_if("mentioned")
    return found.groupBy("platform").agg(n.alias("asked"), m.alias("mentioned"), half_up(m * 100.0 / n, 1).alias("mention_rate"))


def question_grid(conversations: DataFrame, platforms: int = 4) -> DataFrame:
    """Every question with every platform, and how many answers that platform gave."""
    grid = conversations.select("conv_id").distinct().crossJoin(F.broadcast(conversations.sparkSession.range(platforms).select(F.col("id").alias("platform"))))
    given = answers(conversations, platforms).groupBy("conv_id", "platform").agg(F.count("*").alias("answers"))
    return grid.join(given, ["conv_id", "platform"], "left").fillna(0, ["answers"])


def citations(rows: DataFrame, domain: str, most: int = 8) -> DataFrame:
    """``rows`` (with ``urls``) plus whether the domain or a host below it is cited, and the distinct source hosts."""
    hosts = F.array_distinct(F.filter(F.transform("urls", U.host), lambda h: h != ""))
    return rows.withColumn("cited", F.exists("urls", lambda u: U.domain_matches(F.lit(domain), u))).withColumn("sources", F.slice(hosts, 1, most))


# --- feeds -----------------------------------------------------------------------------
SERP_SCHEMA = "struct<tasks:array<struct<result:array<struct<keyword:string,items:array<struct<type:string,rank_group:int,rank_absolute:int,domain:string,url:string,title:string,description:string>>>>>>>"
PAA_SCHEMA = "struct<tasks:array<struct<result:array<struct<keyword:string,items:array<struct<type:string,items:array<struct<title:string>>>>>>>>>"
MENTION_SCHEMA = "struct<tasks:array<struct<result:array<struct<items:array<struct<question:string,answer:string,platform:string,ai_search_volume:int,sources:array<struct<domain:string,url:string>>,brand_entities:array<struct<title:string,category:string>>>>>>>>>"


def _items(rows: DataFrame, column: str, schema: str, *keep: str) -> DataFrame:
    """One row per item of a feed's nested result lists; nulls anywhere above leave no row."""
    tasks = rows.select(*keep, F.from_json(column, schema).alias("j")).select(*keep, F.explode("j.tasks").alias("t"))
    results = tasks.select(*keep, F.explode("t.result").alias("r"))
    return results.select(*keep, "r", F.posexplode("r.items").alias("pos", "item"))


def serp_items(rows: DataFrame, column: str = "json") -> DataFrame:
    """(keyword, rank, domain, url, title) of organic results."""
    found = _items(rows, column, SERP_SCHEMA).filter("item.type = 'organic'")
    return found.select(F.col("r.keyword").alias("keyword"), F.coalesce("item.rank_group", "item.rank_absolute").alias("rank"), F.col("item.domain").alias("domain"), F.col("item.url").alias("url"), F.col("item.title").alias("title"))


def domain_rank(items: DataFrame, domain: str, top: int = 3) -> DataFrame:
    """Per keyword: rank and URL of the domain's first result (the host or one below it), and the first hosts."""
    own = U.domain_matches(F.lit(domain), F.coalesce("url", "domain"))
    w = Window.partitionBy("keyword").orderBy("rank", "url")
    ranked = items.withColumn("_n", F.row_number().over(w))
    return ranked.groupBy("keyword").agg(
        F.min(F.when(own, F.col("rank"))).alias("rank"), F.min_by(F.when(own, F.col("url")), F.when(own, F.col("_n"))).alias("url"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= top, F.struct("_n", "domain")))), lambda s: s["domain"]), ",").alias("top_domains"),
    )


def people_also_ask(rows: DataFrame, column: str = "json") -> DataFrame:
    """(keyword, question, pos): distinct trimmed questions in order of first sight."""
    found = _items(rows, column, PAA_SCHEMA).select(F.col("r.keyword").alias("keyword"), "pos", F.posexplode("item.items").alias("q", "item"))
    each = found.select("keyword", F.struct("pos", "q").alias("at"), F.trim("item.title").alias("question")).filter("question <> ''")
    first = each.groupBy("keyword", "question").agg(F.min("at").alias("at"))
    return first.select("keyword", "question", F.row_number().over(Window.partitionBy("keyword").orderBy("at")).alias("pos"))


def mention_items(rows: DataFrame, column: str = "json") -> DataFrame:
    """(question, answer, platform, volume, sources, brands) of a mention feed."""
    found = _items(rows, column, MENTION_SCHEMA)
    return found.select("item.question", "item.answer", F.coalesce("item.platform", F.lit("unknown")).alias("platform"), F.coalesce("item.ai_search_volume", F.lit(0)).alias("volume"), F.coalesce("item.sources", F.array()).alias("sources"), F.coalesce("item.brand_entities", F.array()).alias("brands"))


def shape_mentions(items: DataFrame, domain: str) -> DataFrame:
    return items.select("question", F.substring("answer", 1, 200).alias("preview"), "platform", "volume", F.exists("sources", lambda s: U.domain_matches(F.lit(domain), s["url"])).alias("cited"), F.size("sources").alias("n_sources"), F.size("brands").alias("n_brands"))


def brand_entities(items: DataFrame) -> DataFrame:
    """Brands by count; the category is that of the first mention that has one (smallest on ties)."""
    return items.select(F.explode("brands").alias("b")).groupBy(F.col("b.title").alias("title")).agg(F.count("*").alias("n"), F.min("b.category").alias("category")).orderBy(F.desc("n"), "title")


def cocited_domains(items: DataFrame, domain: str, n: int = 30) -> DataFrame:
    """Domains cited along with ours, most frequent first, and whether they are ours."""
    hosts = items.select(F.explode("sources").alias("s")).select(U.host(F.coalesce("s.domain", "s.url")).alias("domain")).filter("domain <> ''")
    return hosts.groupBy("domain").agg(F.count("*").alias("n")).withColumn("own", U.domain_matches(F.lit(domain), F.col("domain"))).orderBy(F.desc("n"), "domain").limit(n)


def mentions_by_platform(items: DataFrame) -> DataFrame:
    """Mentions, volume and share of all mentions by platform; no mentions, no rows (never a made-up one)."""
    counts = items.groupBy("platform").agg(F.count("*").alias("mentions"), F.sum("volume").alias("volume"))
    return counts.withColumn("share", half_up(F.col("mentions") * 100.0 / F.sum("mentions").over(Window.partitionBy(F.lit(0))), 1))


def top_cited_pages(items: DataFrame, domain: str, n: int = 20) -> DataFrame:
    urls = items.select(F.explode("sources").alias("s")).select(U.clean(F.col("s.url")).alias("url")).filter(U.domain_matches(F.lit(domain), F.col("url")))
    return urls.groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(n)


OVERVIEW_FEATURE = "51"


def overview_share(keywords: DataFrame) -> DataFrame:
    """(keywords, with_overview, share %): keywords whose feature code list holds the overview's code."""
    codes = F.transform(F.split(F.coalesce("features", F.lit("")), ","), lambda x: F.trim(x))
    hit = F.count_if(F.array_contains(codes, OVERVIEW_FEATURE))
    return keywords.agg(F.count("*").alias("keywords"), hit.alias("with_overview"), F.coalesce(half_up(F.try_divide(hit * 100.0, F.count("*")), 1), F.lit(0.0)).alias("share"))


def overview_presence(rows: DataFrame, domain: str, column: str = "json") -> DataFrame:
    """Per keyword: is there an overview, does it cite the domain."""
    found = _items(rows, column, SERP_SCHEMA).select(F.col("r.keyword").alias("keyword"), "item")
    over = F.col("item.type") == "ai_overview"
    return found.groupBy("keyword").agg(F.bool_or(over).alias("present"), F.bool_or(over & F.coalesce(U.domain_matches(F.lit(domain), F.col("item.url")), F.lit(False))).alias("cited"))


# --- crawler policy --------------------------------------------------------------------
def crawler_policy(robots: DataFrame) -> DataFrame:
    """(host, crawler, status, in_robots) for each host and known crawler; ``robots``: (host, robots or null).

    Consecutive user-agent lines share the rules below them; only ``Disallow: /``
    blocks; * stands for crawlers that are not named; no file: unknown.
    """
    agents = robots.sparkSession.createDataFrame([(c, c.lower()) for c in CRAWLERS], "crawler string, agent string")
    lines = robots.filter("robots IS NOT NULL").select("host", F.posexplode(F.split("robots", r"\r?\n")).alias("n", "line"))
    parsed = lines.select("host", "n", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:\s*([^#]*)", 1)).alias("value")).filter("key IN ('user-agent', 'disallow', 'allow')")
    order = Window.partitionBy("host").orderBy("n")
    is_agent = F.col("key") == "user-agent"
    starts = (is_agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")).cast("int")
    blocks = parsed.withColumn("starts", starts).withColumn("block", F.sum("starts").over(order))
    names = blocks.filter(is_agent).select("host", "block", F.lower("value").alias("agent")).distinct()
    closed = blocks.filter("key = 'disallow' AND value = '/'").select("host", "block").distinct().withColumn("closed", F.lit(True))
    rules = names.join(closed, ["host", "block"], "left").groupBy("host", "agent").agg(F.coalesce(F.bool_or("closed"), F.lit(False)).alias("closed"))
    grid = robots.select("host", F.col("robots").isNotNull().alias("has_file")).crossJoin(F.broadcast(agents))
    everyone = rules.filter("agent = '*'").select("host", F.col("closed").alias("all_closed"))
    rows = grid.join(rules, ["host", "agent"], "left").join(everyone, "host", "left")
    blocked = F.coalesce("closed", "all_closed", F.lit(False))
    return rows.select("host", "crawler", F.when(~F.col("has_file"), "unknown").when(blocked, "blocked").otherwise("allowed").alias("status"), F.col("closed").isNotNull().alias("in_robots"))


def llms_txt(hosts: DataFrame, files: DataFrame) -> DataFrame:
    """(host, exists, length, preview) from (host, body) rows of found files."""
    got = hosts.select("host").distinct().join(files.select("host", "body"), "host", "left")
    return got.select("host", F.col("body").isNotNull().alias("exists"), F.coalesce(F.length("body"), F.lit(0)).alias("length"), F.substring(F.coalesce("body", F.lit("")), 1, 2000).alias("preview"))


# --- readiness -------------------------------------------------------------------------
def page_facts(pages: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """One row per page with all that scorecards read: metrics, head fields, schema flags, allowed crawlers."""
    metrics = extract.content_metrics(pages)
    head = extract.head(pages).select("page_id", "url", "title_len", "meta_description", "canonical", "html_lang")
    tech = extract.technical(pages).select("page_id", "server_rendered", (F.size("og") > 0).alias("has_og"), F.array_contains("security_headers", "strict-transport-security").alias("hsts"), F.array_contains("security_headers", "content-security-policy").alias("csp"))
    schema = extract.json_ld(pages).drop("types")
    facts = metrics.join(head, "page_id").join(tech, "page_id").join(schema, "page_id")
    facts = facts.withColumn("https", F.col("url").startswith("https://")).withColumn("host", U.host(F.col("url"))).withColumn("has_person", F.lit(False)).withColumn("llms_txt", F.lit(False))
    if policy is None:
        return facts.withColumn("allowed", F.array().cast("array<string>")).withColumn("blocked", F.array().cast("array<string>"))
    lists = policy.groupBy("host").agg(*(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("crawler")))).alias(s) for s in ("allowed", "blocked")))
    empty = F.array().cast("array<string>")
    return facts.join(lists, "host", "left").withColumn("allowed", F.coalesce("allowed", empty)).withColumn("blocked", F.coalesce("blocked", empty))


def _ok(crawler: str) -> Column:
    return F.array_contains("allowed", crawler)


def scorecards() -> dict[str, list[tuple[str, Column, int]]]:
    """Checks and points by platform."""
    words, heads, lists = F.col("words"), F.col("h2") + F.col("h3") + F.col("h4") + F.col("h5") + F.col("h6"), F.col("lists")
    cites, ratio, out, inner, alts = F.col("citable_blocks"), F.col("citability"), F.col("external_links"), F.col("internal_links"), F.col("images_alt")
    described, canon = F.col("meta_description") != "", F.col("canonical") != ""
    flag = F.col
    return {
        "google_aio": [
            ("organization", flag("has_organization"), 15), ("article", flag("has_article"), 10), ("faq", flag("has_faq"), 10), ("breadcrumb", flag("has_breadcrumb"), 5), ("words_800", words >= 800, 12),
            ("headings_3", heads >= 3, 10), ("lists", lists >= 1, 8), ("citability_20", ratio >= 20, 10), ("https", flag("https"), 5), ("Googlebot", _ok("Googlebot"), 10), ("canonical", canon, 5),
        ],
        "chatgpt": [
            ("GPTBot", _ok("GPTBot"), 20), ("ChatGPT-User", _ok("ChatGPT-User"), 5), ("citable_5", cites >= 5, 15), ("citable_10", cites >= 10, 10), ("description", described, 10),
            ("external_2", out >= 2, 8), ("same_as", flag("has_same_as"), 10), ("words_500", words >= 500, 7), ("person", flag("has_person"), 8), ("speakable", flag("has_speakable"), 7),
        ],
        "perplexity": [
            ("PerplexityBot", _ok("PerplexityBot"), 20), ("citable_3", cites >= 3, 12), ("citable_8", cites >= 8, 8), ("words_1000", words >= 1000, 12), ("lists_2", lists >= 2, 10),
            ("external_1", out >= 1, 10), ("external_3", out >= 3, 5), ("schema", flag("blocks") >= 1, 8), ("server_rendered", flag("server_rendered"), 10), ("https", flag("https"), 5),
        ],
        "gemini": [
            ("Google-Extended", _ok("Google-Extended"), 18), ("organization", flag("has_organization"), 15), ("same_as", flag("has_same_as"), 12), ("person", flag("has_person"), 10), ("images_alt_2", alts >= 2, 10),
            ("headings_4", heads >= 4, 8), ("words_800", words >= 800, 7), ("https", flag("https"), 5), ("internal_3", inner >= 3, 8), ("llms_txt", flag("llms_txt"), 7),
        ],
        "bing_copilot": [
            ("Bingbot", _ok("Bingbot"), 18), ("description", described, 15), ("title_10_65", flag("title_len").between(10, 65), 10), ("organization", flag("has_organization"), 12), ("words_500", words >= 500, 8),
            ("headings_3", heads >= 3, 8), ("https", flag("https"), 8), ("hsts", flag("hsts"), 6), ("open_graph", flag("has_og"), 8), ("canonical", canon, 7),
        ],
    }


def readiness_checks(facts: DataFrame) -> DataFrame:
    """Long form: (page_id, platform, label, passed, points)."""
    rows = [F.struct(F.lit(p).alias("platform"), F.lit(label).alias("label"), F.coalesce(c, F.lit(False)).alias("passed"), F.lit(n).alias("points")) for p, checks in scorecards().items() for label, c, n in checks]
    return facts.select("page_id", F.inline(F.array(*rows)))


def readiness(facts: DataFrame) -> DataFrame:
    """(page_id, platform, score): points of passed checks, at most 100."""
    return readiness_checks(facts).groupBy("page_id", "platform").agg(F.least(F.sum(F.when(F.col("passed"), F.col("points")).otherwise(0)), F.lit(100)).cast("int").alias("score"))


def _points(*pairs: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for condition, n in pairs:
        out = out + F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    return F.least(out, F.lit(100))


def platform_columns() -> dict[str, Column]:
    return {p: _points(*((c, n) for _, c, n in checks)) for p, checks in scorecards().items()}


def composite(facts: DataFrame) -> DataFrame:
    """Component scores of each page and their weighted sum; parts are cut to whole numbers like the sum."""
    rows = facts.withColumns({f"p_{k}": v for k, v in platform_columns().items()})
    heads = F.col("h2") + F.col("h3") + F.col("h4") + F.col("h5") + F.col("h6")
    words = ladder(F.col("words"), [(1500, 30), (800, 20), (300, 10)], 0)
    content = F.least(words + _points((heads >= 3, 20), (F.col("lists") >= 1, 15), (F.col("images_alt") >= 1, 15), (F.col("external_links") >= 1, 10), (F.col("avg_paragraph_words") <= 40, 10)), F.lit(100))
    tech = _points((F.col("https"), 25), (F.col("server_rendered"), 25), (F.col("meta_description") != "", 15), (F.col("title_len") > 0, 10), (F.col("canonical") != "", 10), (F.col("html_lang") != "", 5), (F.col("hsts"), 5), (F.col("csp"), 5))
    platform = F.floor(sum((F.col(f"p_{k}") for k in scorecards()), F.lit(0)) / float(len(scorecards())))
    rows = rows.select(
        "page_id", F.least(F.col("citability") * 2.5, F.lit(100.0)).alias("citability_raw"), content.alias("content_quality"), tech.alias("technical"),
        F.floor(F.size("allowed") * 100.0 / len(CRAWLERS)).alias("crawler_access"), F.col("schema_score").alias("schema"), platform.alias("platform_readiness"),
    )
    total = F.col("citability_raw") * 0.25 + F.col("content_quality") * 0.20 + F.col("technical") * 0.15 + F.col("crawler_access") * 0.15 + F.col("schema") * 0.10 + F.col("platform_readiness") * 0.15
    # a tiny allowance keeps whole sums whole before they are cut
    return rows.withColumn("geo_score", F.floor(total + 1e-9).cast("int")).withColumn("citability", F.floor("citability_raw").cast("int")).drop("citability_raw")


def recommendations(facts: DataFrame) -> DataFrame:
    """(page_id, priority, category, advice) by rule."""
    rule = lambda when, priority, category, advice: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), F.lit(advice).alias("advice")))
    rules = [
        rule(~F.col("https"), "critical", "technical", "serve the site over https"),
        rule(~F.col("server_rendered"), "critical", "technical", "render content on the server"),
        rule(F.size("blocked") > 0, "critical", "crawlers", "unblock crawlers in robots.txt"),
        rule(~F.col("has_organization") & ~F.col("has_same_as"), "high", "schema", "add an organization with sameAs"),
        rule(F.col("words") < 800, "high", "content", "write more than 800 words"),
        rule(F.col("citability") < 15, "high", "content", "add paragraphs of 20-60 words that answer questions"),
        rule(~F.col("llms_txt"), "medium", "files", "publish llms.txt"),
        rule(F.col("lists") == 0, "medium", "content", "add lists"),
        rule(F.col("images_alt") < F.col("images"), "medium", "content", "describe images"),
        rule(~F.col("has_article"), "medium", "schema", "add an article"),
        rule(~F.col("has_breadcrumb"), "medium", "schema", "add breadcrumbs"),
    ]
    return facts.select("page_id", F.inline(F.array_compact(F.array(*rules))))


def visibility_score(rows: DataFrame) -> DataFrame:
    """``rows`` (mentions, citations, platforms, pages, readiness) with ``visibility`` of 0-100."""
    volume = ladder(F.col("mentions"), [(500, 40), (100, 30), (50, 20), (10, 10), (1, 5)], 0)
    cited = ladder(F.col("citations"), [(50, 20), (20, 15), (5, 10), (1, 5)], 0)
    pages = ladder(F.col("pages"), [(10, 10), (5, 7), (1, 3)], 0)
    total = volume + cited + F.least(F.col("platforms") * 2.5, F.lit(10.0)) + pages + F.coalesce("readiness", F.lit(0.0)) * 0.2
    return rows.withColumn("visibility", F.least(F.floor(total + 1e-9), F.lit(100)).cast("int"))


def domain_report(items: DataFrame, domain: str, facts: DataFrame | None = None) -> DataFrame:
    """One row: totals of a domain's mentions and citations with readiness and the visibility score."""
    shaped = shape_mentions(items, domain)
    one = shaped.agg(F.count("*").alias("mentions"), F.count_if("cited").alias("citations"), F.countDistinct("platform").alias("platforms"))
    pages = top_cited_pages(items, domain, 1_000_000).agg(F.count("*").alias("pages"))
    out = one.crossJoin(pages)
    if facts is not None:
        out = out.crossJoin(readiness(facts).agg(F.avg("score").alias("readiness")))
    else:
        out = out.withColumn("readiness", F.lit(None).cast("double"))
    return visibility_score(out.withColumn("domain", F.lit(domain)))
