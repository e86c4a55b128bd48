"""Site audit: language, city, hreflang, issues and scores of extracted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import urls as U
from quillspan.functions.numbers import half_up
from quillspan.operators import extract

# Frequent words by language, in the order that breaks ties.
STOP_WORDS = {
    "fr": "le la les de des un une et est vous nous pour dans avec sur que qui notre votre plus à",
    "en": "the and of to in for you we our your with is are this that on at by from more",
    "es": "el la los las de un una y es para con que su nuestro por más en se como del",
    "de": "der die das und ist für sie wir unser mit von auf den im ein eine zu auch als mehr",
    "it": "il la di un una e che per con non sono nostro vostro più come questo in del dei gli",
    "pt": "o a os as de um uma e que para com não nosso por mais em do da como seu",
    "nl": "de het een van en is voor met op wij onze uw dat die aan te in zijn meer ook",
}
# Points that an issue costs.
PENALTIES = {
    "http_error": 100, "noindex": 40, "title_missing": 18, "title_long": 5, "title_short": 5, "description_missing": 12, "description_long": 4, "h1_missing": 12, "h1_multiple": 6,
    "title_h1_mismatch": 4, "thin_content": 15, "near_duplicate": 20, "city_not_in_title": 8, "city_not_in_h1": 5, "lang_missing": 3, "hreflang": 6,
}


def language_votes(text: Column) -> dict[str, Column]:
    words = T.words(text)
    return {"n": F.size(words)} | {k: _hits(words, v.split()) for k, v in STOP_WORDS.items()}


def _hits(words: Column, stop: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*stop)))


def detect_language(rows: DataFrame, text: str = "text", html_lang: str | None = None) -> DataFrame:
    """``rows`` with ``language``: the declared two-letter code, else the language of most frequent words.

    At least 20 words, and hits of at least 3 and 2 % of all words; ties go to the first language listed.
    """
    votes = language_votes(F.col(text))
    out = rows.withColumn("_n", votes.pop("n")).withColumns({f"_{k}": v for k, v in votes.items()})
    best = F.greatest(*(F.col(f"_{k}") for k in votes))
    guess = F.when((F.col("_n") < 20) | (best < F.greatest(F.lit(3.0), F.col("_n") * 0.02)), F.lit(""))
    for k in votes:
        guess = guess.when(F.col(f"_{k}") == best, F.lit(k))
    if html_lang:
        code = F.element_at(F.split(F.lower(F.trim(F.col(html_lang))), "[-_]"), 1)
        guess = F.when((F.coalesce(F.col(html_lang), F.lit("")) != "") & (F.length(code) == 2), code).otherwise(guess)
    return out.withColumn("language", guess).drop("_n", *(f"_{k}" for k in votes))


def title_h1_match(title: Column, h1: Column) -> Column:
    """At least half of the h1's words over two letters are in the title."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(T.fold(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))
    t, h = words(title), words(h1)
    return (F.size(t) > 0) & F.coalesce(F.try_divide(F.size(F.array_intersect(t, h)), F.size(h)) >= 0.5, F.lit(False))


def detect_city(pages: DataFrame, cities: DataFrame) -> DataFrame:
    """(page_id, city): the longest, then leftmost, known slug among 3- to 1-grams of URL, then h1, then title words.

    ``cities``: (slug, city), slugs of at least four letters; one hash join on the gram.
    """
    dictionary = cities.filter(F.length("slug") >= 4).groupBy("slug").agg(F.min("city").alias("city"))
    tokens = lambda c: F.filter(F.split(T.fold(c), "[^a-z0-9]+"), lambda w: w != "")
    grams = lambda c, rank: F.flatten(F.array(*(F.transform(T.windows(tokens(c), n), lambda g, i: F.struct(F.lit(rank).alias("rank"), F.lit(-n).alias("size"), i.alias("pos"), F.replace(g, F.lit(" "), F.lit("-")).alias("slug"))) for n in (3, 2, 1))))
    rows = pages.select("page_id", F.explode(F.concat(grams(U.path(F.col("url")), 0), grams(F.col("h1"), 1), grams(F.col("title"), 2))).alias("g")).select("page_id", "g.*").filter(F.length("slug") >= 4)
    return rows.join(dictionary, "slug").groupBy("page_id").agg(F.min_by("city", F.struct("rank", "size", "pos")).alias("city"))


def hreflang_issues(pages: DataFrame, tags: DataFrame) -> DataFrame:
    """(url, message): no x-default, or a known alternate that does not declare the page back (the smallest one is named)."""
    norm = lambda c: U.clean(F.col(c))
    known = pages.select(norm("url").alias("u")).distinct()
    declared = tags.filter("hreflang <> 'x-default'").select(norm("url").alias("u"), norm("href").alias("target")).distinct()
    default = tags.filter("hreflang = 'x-default'").select(norm("url").alias("u")).distinct().withColumn("has_default", F.lit(True))
    other = declared.filter("u <> target").join(known.select(F.col("u").alias("target")), "target", "left_semi")
    back = declared.select(F.col("u").alias("target"), F.col("target").alias("u"))
    one_way = other.join(back, ["u", "target"], "left_anti").groupBy("u").agg(F.min("target").alias("first_one_way"))
    rows = declared.select("u").distinct().join(default, "u", "left").join(one_way, "u", "left")
    message = F.concat_ws(" ; ", F.when(F.col("has_default").isNull(), "x-default missing"), F.when(F.col("first_one_way").isNotNull(), F.concat(F.lit("not reciprocal ("), U.slug(F.col("first_one_way")), F.lit(")"))))
    return rows.select(F.col("u").alias("url"), message.alias("hreflang_issue")).filter("hreflang_issue <> ''")


def page_table(pages: DataFrame) -> DataFrame:
    """Head, headings and text of each page; the parts are joined on page_id, which must be unique."""
    base = extract.with_defaults(pages)
    parts = (extract.head(base), extract.headings(base).drop("outline"), extract.page_text(base))
    return parts[0].join(parts[1], "page_id").join(parts[2], "page_id")


def issues(pages: DataFrame) -> DataFrame:
    """``pages`` with the array ``issues``; an HTTP error is the only issue of its page, other types have none.

    Reads status, content_type, title, title_len, meta_description, desc_len, h1, h1_count, indexable, word_count,
    html_lang and, where present, max_similarity, city and hreflang_issue.
    """
    has = set(pages.columns)
    opt = lambda c, default: F.coalesce(F.col(c), default) if c in has else default
    city = opt("city", F.lit(""))
    rules = {
        "title_missing": F.col("title") == "",
        "title_long": F.col("title_len") > 65,
        "title_short": (F.col("title") != "") & (F.col("title_len") < 20),
        "description_missing": F.col("meta_description") == "",
        "description_long": F.col("desc_len") > 160,
        "h1_missing": F.col("h1") == "",
        "h1_multiple": F.col("h1_count") > 1,
        "title_h1_mismatch": (F.col("h1") != "") & ~title_h1_match(F.col("title"), F.col("h1")),
        "noindex": ~F.col("indexable"),
        "thin_content": F.col("word_count") < 250,
        "near_duplicate": opt("max_similarity", F.lit(0)) >= 90,
        "city_not_in_title": (city != "") & ~T.fold(F.col("title")).contains(T.fold(city)),
        "city_not_in_h1": (city != "") & ~T.fold(F.col("h1")).contains(T.fold(city)),
        "lang_missing": F.col("html_lang") == "",
        "hreflang": opt("hreflang_issue", F.lit("")) != "",
    }
    listed = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    none = F.array().cast("array<string>")
    return pages.withColumn("issues", F.when(F.col("status") >= 400, F.array(F.lit("http_error"))).when(F.col("content_type") != "text/html", none).otherwise(listed))


def page_scores(pages: DataFrame) -> DataFrame:
    """``pages`` with ``score``: 100 less penalties; less for no in-links, unreachable or deep pages, more for 800 words."""
    has = set(pages.columns)
    cost = sum((F.when(F.array_contains("issues", k), F.lit(v)).otherwise(F.lit(0)) for k, v in PENALTIES.items()), F.lit(0))
    if "inlinks" in has:
        cost = cost + F.when(F.coalesce("inlinks", F.lit(0)) == 0, 10).otherwise(0)
    if "depth" in has:
        cost = cost + F.when(F.col("depth").isNull(), 8).when(F.col("depth") >= 4, 5).otherwise(0)
    gain = F.when(F.col("word_count") >= 800, 5).otherwise(0)
    score = F.when(F.col("status") >= 400, 0).when(F.col("content_type") != "text/html", 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - cost + gain)))
    return pages.withColumn("score", score.cast("int"))


def verdict(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor")


def site_score(scored: DataFrame, link_health: float | None = None) -> DataFrame:
    """One row: mean page score, blended 70:30 with the link health where it is known."""
    mean = F.avg("score")
    blended = mean if link_health is None else 0.7 * mean + 0.3 * F.lit(float(link_health))
    return scored.agg(F.count("*").alias("pages"), half_up(mean, 1).alias("mean_page_score"), half_up(blended).cast("int").alias("site_score")).withColumn("verdict", verdict(F.col("site_score")))


def crawl_summary(pages: DataFrame) -> DataFrame:
    """Totals and conditional counts over audited pages: one aggregation."""
    has = lambda name: F.count_if(F.array_contains("issues", name)).alias(name)
    html = (F.col("content_type") == "text/html") & (F.col("status") < 400)
    return pages.agg(
        F.count("*").alias("total"), F.count_if(html).alias("html_pages"), F.count_if(F.col("indexable")).alias("indexable"), F.count_if(F.size("issues") > 0).alias("with_issues"),
        *(has(n) for n in ("http_error", "noindex", "title_missing", "title_long", "title_short", "description_missing", "h1_missing", "h1_multiple", "title_h1_mismatch", "thin_content", "lang_missing")),
        half_up(F.avg("word_count"), 1).alias("avg_words"),
    )


def language_histogram(pages: DataFrame, language: str = "html_lang") -> DataFrame:
    """(language, pages, multilingual): '?' where none is known; multilingual when two or more are."""
    key = F.coalesce(F.nullif(F.lower(F.col(language)), F.lit("")), F.lit("?"))
    counts = pages.groupBy(key.alias("language")).agg(F.count("*").alias("pages"))
    known = F.count_if(F.col("language") != "?").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("multilingual", known > 1)


def truncate_report(pages: DataFrame, limit: int) -> DataFrame:
    """The first pages, those with issues before those without."""
    return pages.orderBy(F.desc(F.size("issues") > 0), "page_id").limit(limit)


def url_list(rows: DataFrame, column: str = "url", limit: int = 50) -> DataFrame:
    """Trimmed distinct URLs that start with http, at most ``limit`` in order."""
    return rows.select(F.trim(F.col(column)).alias("url")).filter(F.col("url").startswith("http")).distinct().orderBy("url").limit(limit)


def indexable_html(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("content_type") == "text/html") & (F.col("status") < 400) & F.col("indexable"))


def comparable(pages: DataFrame) -> DataFrame:
    """Pages whose text takes part in similarity: no error and more than 50 words."""
    return pages.filter((F.col("status") < 400) & (F.col("text") != "") & (F.col("word_count") > 50))
