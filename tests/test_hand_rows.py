"""Markup, feeds and files that the generated tables lack, in a few rows each."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillspan.functions import numbers as N
from quillspan.functions import text as T
from quillspan.functions import urls as U
from quillspan.operators import audit, extract, geo, graph, indexation, search, similarity, stylometry, visibility
from quillspan.sources import json as J
from quillspan.sources import readers, sinks


def one(df):
    return df.collect()[0]


def page(spark, html, url="https://www.a.fr/service-paris", n=1):
    return spark.createDataFrame([(n, url, html)], "page_id long, url string, html string")


HTML = """<!doctype html><html lang="fr-FR"><head><title>Plombier &amp; Paris</title><meta name="description" content="Un texte"><meta content="noindex, follow" name="ROBOTS">
<link rel="canonical" href="/x"><link rel="alternate" hreflang="en" href="/en/x"><link rel="alternate" hreflang="x-default" href="/x">
<meta property="og:title" content="T"><script type="application/ld+json">{"@graph": [{"@type": "Organization", "sameAs": ["u"]}, {"@type": ["Article", "Thing"], "speakable": 1}]}</script>
<script type="application/ld+json">{broken</script></head><body><nav><a href="/n">Nav</a></nav><h1>Plombier</h1><h2>A?</h2><h3>Question un</h3><p>Oui tout à fait.</p><h3>Question deux</h3><p>Non.</p>
<p>%s</p><ul><li>un élément assez long</li></ul><img src="a.png" alt="b"><img src="c.png"><a href="rel/page/#frag" rel="nofollow">Lire</a><a href="//cdn.a.fr/y/">C</a><a href="http://b.com/z">Z</a>
<a href="mailto:x@y.z">m</a><a href="/f.pdf">pdf</a><a href="https://a.fr/w/"><img src="q.png"></a><footer>bas</footer></body></html>""" % " ".join(["mot"] * 25 + ["fin."])


def test_head_headings_and_hreflang(spark):
    p = page(spark, HTML)
    h = one(extract.head(p))
    assert (h.title, h.meta_description, h.canonical, h.meta_robots, h.html_lang, h.indexable) == ("Plombier & Paris", "Un texte", "https://www.a.fr/x", "noindex, follow", "fr-FR", False)
    heads = one(extract.headings(p))
    assert (heads.h1, heads.h1_count, heads.h2_count, heads.h3_count, [tuple(o) for o in heads.outline][:2]) == ("Plombier", 1, 1, 2, [(1, "Plombier"), (2, "A?")])
    assert {(r.hreflang, r.href) for r in extract.hreflangs(p).collect()} == {("en", "https://www.a.fr/en/x"), ("x-default", "https://www.a.fr/x")}
    assert [(r.question, r.answer) for r in extract.faq_pairs(p).collect()] == [("Question un", "Oui tout à fait."), ("Question deux", f"Non. {' '.join(['mot'] * 25)} fin. un élément assez long Lire C Z m pdf bas")]


def test_links(spark):
    got = {(r.dst, r.anchor, r.rel, r.internal) for r in extract.links(page(spark, HTML)).collect()}
    assert got == {("https://www.a.fr/n", "Nav", "", True), ("https://www.a.fr/rel/page", "Lire", "nofollow", True), ("https://cdn.a.fr/y", "C", "", False), ("http://b.com/z", "Z", "", False), ("https://a.fr/w", "", "", True)}


def test_json_ld_and_technical(spark):
    j = one(extract.json_ld(page(spark, HTML)))
    assert (j.blocks, j.types, j.has_organization, j.has_article, j.has_same_as, j.has_speakable, j.has_faq, j.schema_score) == (1, ["Article", "Organization", "Thing"], True, True, True, True, False, 70)
    t = one(extract.technical(page(spark, HTML)))
    assert t.og == {"og:title": "T"} and not t.server_rendered
    m = one(extract.content_metrics(page(spark, HTML)))
    assert (m.h1, m.h3, m.lists, m.images, m.images_alt, m.citable_blocks) == (1, 2, 1, 3, 1, 1)


def test_missing_html_has_no_fields(spark):
    p = page(spark, None)
    assert one(extract.head(p)).title == "" and one(extract.page_text(p)).word_count == 0
    assert extract.links(p).count() == 0 and one(extract.content_metrics(p)).citability == 0


def test_issues_and_scores(spark):
    rows = [("t" * 70, "", "A", 2, True, 100, "fr", 200, "text/html"), ("Plombier Paris centre", "d" * 170, "Autre chose", 1, False, 900, "", 200, "text/html"), ("", "", "", 0, True, 0, "", 500, "text/html"), ("", "", "", 0, True, 0, "", 200, "image/png")]
    df = spark.createDataFrame(rows, "title string, meta_description string, h1 string, h1_count int, indexable boolean, word_count int, html_lang string, status int, content_type string").withColumns({"title_len": F.length("title"), "desc_len": F.length("meta_description")})
    got = [(sorted(r.issues), r.score) for r in audit.page_scores(audit.issues(df)).collect()]
    assert got == [
        (sorted(["title_long", "description_missing", "h1_multiple", "title_h1_mismatch", "thin_content"]), 100 - 5 - 12 - 6 - 4 - 15),
        (sorted(["description_long", "title_h1_mismatch", "noindex", "lang_missing"]), 100 - 4 - 4 - 40 - 3 + 5),
        (["http_error"], 0), ([], 100),
    ]
    linked = audit.page_scores(audit.issues(df).limit(1).withColumn("inlinks", F.lit(0)).withColumn("depth", F.lit(None).cast("int")))
    assert one(linked).score == 58 - 18


def test_hreflang_issues(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    tags = spark.createDataFrame([("a", "en", "b"), ("a", "x-default", "a"), ("b", "fr", "a"), ("c", "fr", "a"), ("c", "de", "unknown"), ("a", "fr", "a")], "url string, hreflang string, href string")
    assert {(r.url, r.hreflang_issue) for r in audit.hreflang_issues(pages, tags).collect()} == {("b", "x-default missing"), ("c", "x-default missing ; not reciprocal (a)")}


def test_city_and_language(spark):
    pages = spark.createDataFrame([(1, "https://a.fr/plombier-saint-denis", "Lyon", ""), (2, "https://a.fr/x", "À Lyon ici", ""), (3, "https://a.fr/y", "", "rien")], "page_id long, url string, h1 string, title string")
    cities = spark.createDataFrame([("saint-denis", "Saint-Denis"), ("denis", "Denis"), ("lyon", "Lyon"), ("ici", "Ici")], "slug string, city string")
    assert {(r.page_id, r.city) for r in audit.detect_city(pages, cities).collect()} == {(1, "Saint-Denis"), (2, "Lyon")}
    texts = spark.createDataFrame([("the and of to in " * 6, ""), ("le la les de des " * 6, ""), ("zzz " * 30, ""), ("the " * 5, ""), ("x", "pt-BR")], "text string, lang string")
    assert [r.language for r in audit.detect_language(texts, "text", "lang").collect()] == ["en", "fr", "", "", "pt"]


def test_text_and_number_functions(spark):
    row = lambda *c: one(spark.range(1).select(*c))
    assert tuple(row(T.fold(F.lit(" Été ŒÇ! ")), T.slugify(F.lit("L'Été  à_Paris--")), T.word_count(F.lit("d'été 12 À")))) == ("ete c!", "lete-a-paris", 4)
    assert row(T.sentences(F.lit("Un. Deux!  Trois… x")))[0] == ["Un.", "Deux!", "Trois…"]
    assert row(F.size(T.shingles(F.lit("a b c d e f"))), F.size(T.shingles(F.lit("a b"))))[:] == (2, 0)
    assert row(T.occurrences(F.lit("aaaa"), "aa"), T.punctuation_entropy(F.lit("a.b,")), T.punctuation_entropy(F.lit("ab")))[:] == (2, 1.0, 0.0)
    assert row(J.json_in_prose(F.lit('so ```json\n{"a": 1}\n``` x'), "a int"))[0].a == 1
    assert row(J.json_in_prose(F.lit('so {"a": 2} x'), "a int"))[0].a == 2 and row(J.json_in_prose(F.lit("none {"), "a int"))[0] is None
    assert row(T.json_texts(F.lit('{"x": {"url": "u1", "l": [{"link": "u2"}]}}'), ("url", "link")))[0] == ["u1", "u2"]
    assert row(N.ramp(F.lit(0.5), 0, 1), N.ramp(F.lit(0.2), 0, 1, True), N.ramp(F.lit(0.7), 1.2, 0.2), N.ramp(F.lit(1), 2, 2))[:] == (50.0, 80.0, 50.0, 0.0)
    assert row(N.safe_int(F.lit("12.9")), N.safe_int(F.lit("x")), N.safe_float(F.lit("1.005x")), N.rating(F.lit("9")), N.rating(F.lit("q")))[:] == (12, 0, 0.0, 5.0, 5.0)
    assert abs(row(N.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(45.764), F.lit(4.8357)))[0] - 391.5) < 1
    assert row(U.host(F.lit("HTTPS://www.A.fr:80/x?y")), U.host(F.lit("a.fr/z")), U.slug(F.lit("https://a.fr/x/Page.php?q#f")))[:] == ("a.fr", "a.fr", "Page")
    assert row(U.service_base(F.lit("plombier-paris-urgent"), F.lit("paris")), U.service_base(F.lit("x"), F.lit("paris")))[:] == ("plombier-urgent", "")
    assert row(U.language_code(F.lit("PT-br")), U.language_code(F.lit("xx")), U.language_code(F.lit(None).cast("string")))[:] == ("pt", "fr", "fr")
    assert row(U.domain_matches(F.lit("a.fr"), F.lit("https://ba.fr/")), U.domain_matches(F.lit("a.fr"), F.lit("https://m.a.fr/")))[:] == (False, True)
    assert len(row(U.alternates(F.lit("x"), F.array(F.lit(""), F.lit("en")), "https://a.fr"))[0]) == 3
    assert row(T.snippet(F.lit("x" * 200 + "needle" + "y" * 300), F.lit("needle")))[0] == "…" + "x" * 80 + "needle" + "y" * 120 + "…"
    assert row(graph.suggested_anchor(F.lit("x" * 80), F.lit("Titre | b"), F.lit("Paris")), graph.suggested_anchor(F.lit(None).cast("string"), F.lit(""), F.lit("Paris")))[:] == ("Titre", "Paris")


ROBOTS = "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: ClaudeBot\nDisallow: /private\n\nUser-agent: *\nDisallow: /tmp"


def test_crawler_policy_and_robots(spark):
    robots = spark.createDataFrame([("a", ROBOTS), ("b", "User-agent: *\nDisallow: / # all\nSitemap: https://b/s.xml"), ("c", None)], "host string, robots string")
    got = {(r.host, r.crawler): (r.status, r.in_robots) for r in visibility.crawler_policy(robots).collect()}
    assert len(got) == 3 * len(visibility.CRAWLERS)
    assert got["a", "GPTBot"] == got["a", "CCBot"] == ("blocked", True) and got["a", "ClaudeBot"] == ("allowed", True) and got["a", "Bingbot"] == ("allowed", False)
    assert got["b", "GPTBot"] == ("blocked", False) and got["c", "GPTBot"] == ("unknown", False)
    assert [r.sitemap for r in readers.robots_sitemaps(robots).collect()] == ["https://b/s.xml"]
    files = spark.createDataFrame([("a", "hello")], "host string, body string")
    assert {(r.host, r.exists, r.length) for r in visibility.llms_txt(robots, files).collect()} == {("a", True, 5), ("b", False, 0), ("c", False, 0)}


def feed(items, keyword=None):
    return json.dumps({"tasks": [{"result": [{"keyword": keyword, "items": items}]}, {"result": None}]})


def test_feeds(spark):
    serp = [feed([{"type": "paid", "rank_group": 1, "url": "https://a.fr"}, {"type": "organic", "rank_group": 1, "domain": "ba.fr", "url": "https://ba.fr/"}, {"type": "organic", "rank_absolute": 4, "domain": "www.a.fr", "url": "https://www.a.fr/p"}, {"type": "ai_overview", "url": "https://a.fr/q"}], "k")]
    rows = spark.createDataFrame([(s,) for s in [*serp, "broken", None]], "json string")
    r = one(visibility.domain_rank(visibility.serp_items(rows), "a.fr"))
    assert (r.keyword, r["rank"], r.url, r.top_domains) == ("k", 4, "https://www.a.fr/p", "ba.fr,www.a.fr")
    assert tuple(one(visibility.overview_presence(rows, "a.fr"))) == ("k", True, True)
    paa = spark.createDataFrame([(feed([{"type": "p", "items": [{"title": " Q1 "}, {"title": "Q2"}]}, {"type": "p", "items": [{"title": "Q1"}, {"title": ""}]}], "k"),)], "json string")
    assert sorted((r.pos, r.question) for r in visibility.people_also_ask(paa).collect()) == [(1, "Q1"), (2, "Q2")]
    mention = spark.createDataFrame([(feed([{"question": "q", "answer": "a" * 300, "platform": "p1", "ai_search_volume": 7, "sources": [{"domain": "a.fr", "url": "https://a.fr/x/"}], "brand_entities": [{"title": "B", "category": "c"}]}, {"question": "r", "answer": "z"}]),)], "json string")
    items = visibility.mention_items(mention)
    shaped = {r.question: r for r in visibility.shape_mentions(items, "a.fr").collect()}
    assert (len(shaped["q"].preview), shaped["q"].cited, shaped["q"].n_brands, shaped["r"].platform, shaped["r"].n_sources) == (200, True, 1, "unknown", 0)
    assert [tuple(r) for r in visibility.brand_entities(items).collect()] == [("B", 1, "c")]
    report = one(visibility.domain_report(items, "a.fr"))
    assert (report.mentions, report.citations, report.platforms, report.pages, report.visibility) == (2, 1, 2, 1, 5 + 5 + 5 + 3)
    assert one(visibility.overview_share(spark.createDataFrame([("51, 9",), ("510",), (None,)], "features string"))).share == 33.3


def test_scorecards(spark):
    p = page(spark, HTML)
    policy = visibility.crawler_policy(spark.createDataFrame([("a.fr", "User-agent: GPTBot\nDisallow: /")], "host string, robots string"))
    facts = visibility.page_facts(p, policy)
    scores = {r.platform: r.score for r in visibility.readiness(facts).collect()}
    assert scores["google_aio"] == 15 + 10 + 10 + 8 + 10 + 5 + 10 + 5 and scores["chatgpt"] == 5 + 10 + 8 + 10 + 7
    c = one(visibility.composite(facts))
    assert c.crawler_access == 92 and c.schema == 70 and 0 <= c.geo_score <= 100
    assert ("critical", "crawlers") in {(r.priority, r.category) for r in visibility.recommendations(facts).collect()}


def test_readers(spark, tmp_path):
    cells = lambda **kw: ",".join(kw.get(f"c{i}", "") for i in range(21))
    good = cells(c1="75", c2="paris", c5="Paris", c8="75001-75002", c14="2000000", c19="2.35", c20="48.85")
    small = cells(c1="69", c2="oul", c5="Oul", c8="69100", c14="200", c19="4.8", c20="45.7")
    (tmp_path / "p.csv").write_text("\n".join([good, small, cells(c1="75", c2="bad", c5="Bad", c14="x")]))
    rows = readers.places_csv(spark, str(tmp_path / "p.csv"), {"75": "IDF"}).collect()
    assert [(r.slug, r.postal_code, r.region) for r in rows] == [("paris", "75001", "IDF"), ("oul", "69100", "")]
    assert [tuple(r) for r in readers.city_dictionary(spark, str(tmp_path / "p.csv")).collect()] == [("paris", "Paris")]
    (tmp_path / "r1.csv").write_text("Keyword;Position;Search Volume;CPC\nk1;3;100;1.239\nshort;1\nk2;x;;\n")
    (tmp_path / "r2.csv").write_text("Ph;Po;Nq;Cp;Fk\nk3;2;10;0.5;51, 9\n")
    assert {(r.keyword, r.position, r.volume, r.cpc) for r in readers.read_report(spark, str(tmp_path / "r1.csv")).collect()} >= {("k1", 3, 100, 1.24), ("k2", 0, 0, 0.0)}
    assert one(readers.read_report(spark, str(tmp_path / "r2.csv"))).features == "51, 9"
    (tmp_path / "s.json").write_text('{"keys": ["q", "p"], "position": 1.5, "dt": "2024-01-01"}\n{"keys": ["q"]}\n')
    assert [(r["query"], r.clicks) for r in readers.search_rows(spark, str(tmp_path / "s.json")).collect()] == [("q", 0)]
    maps = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>c</loc></sitemap></sitemapindex>"), ("c", "<url><loc> u1 </loc><lastmod>2024-01-02</lastmod></url><url><loc>u2</loc></url>"), ("other", "<url><loc>u3</loc></url>")], "sitemap string, body string")
    assert {(r.loc, r.lastmod) for r in readers.sitemap_tree(maps, "i").collect()} == {("u1", "2024-01-02"), ("u2", None)}
    usage = spark.createDataFrame([("m", 1_000_000, 500_000), ("x", 1, 1)], "model string, in_tokens long, out_tokens long")
    assert {(r.model, r.cost) for r in readers.usage_costs(usage, {"m": (3.0, 15.0)}).collect()} == {("m", 10.5), ("x", None)}


def test_sinks(spark, tmp_path):
    urls = spark.createDataFrame([("75", "https://a/x&y", dt.date(2024, 1, 2)), ("75", "https://a/z", None), ("69", "https://a/w", dt.date(2024, 1, 1))], "segment string, loc string, lastmod date")
    index = {r.segment: (r.n_urls, r.lastmod) for r in sinks.write_sitemaps(urls, str(tmp_path / "maps")).collect()}
    assert index == {"75": (2, dt.date(2024, 1, 2)), "69": (1, dt.date(2024, 1, 1))}
    assert "<url><loc>https://a/x&amp;y</loc><lastmod>2024-01-02</lastmod></url>" in {r.value for r in spark.read.text(str(tmp_path / "maps/segment=75")).collect()}
    cur = spark.createDataFrame([(1, "k", 2.0, 5, 1)], "site_id long, query string, position double, impressions long, clicks long")
    sinks.append_history(sinks.history_rows(cur, F.lit("2024-01-01")), str(tmp_path / "h"))
    sinks.append_history(sinks.history_rows(cur, F.lit("2024-01-02")), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    some = spark.createDataFrame([(1, True, None, ["a"])], "url long, orphan boolean, depth int, cities array<string>")
    paths = sinks.write_report(some, some, some, some, some, str(tmp_path / "rep"), "csv")
    assert one(spark.read.option("header", True).csv(paths["linking"])).orphan == "yes" and one(spark.read.option("header", True).csv(paths["linking"])).depth == "-1"
    assert sinks.add_missing_columns(some, "url long, extra string").columns == ["url", "orphan", "depth", "cities", "extra"]
    sites = spark.createDataFrame([(1,), (2,)], "site_id long")
    scans = spark.createDataFrame([(1, 9, dt.datetime(2024, 1, 1))], "site_id long, indexed_pages long, scanned_at timestamp")
    assert {(r.site_id, r.indexed_pages) for r in sinks.update_sites(sites, scans).collect()} == {(1, 9), (2, None)}


def test_keyword_merge_replays_to_the_same_rows(spark):
    snap = spark.createDataFrame([(1, "old", 5.0, 4.0, 3.0, 1, 1), (1, "both", 8.0, None, 6.0, 1, 1)], "site_id long, keyword string, current_position double, previous_position double, best_position double, impressions long, clicks long")
    cur = spark.createDataFrame([(1, "both", 7.0, 2, 2), (1, "new", 9.0, 3, 3)], "site_id long, query string, position double, impressions long, clicks long")
    prev = spark.createDataFrame([(1, "new", 4.0)], "site_id long, query string, position double")
    got = {r.keyword: (r.current_position, r.previous_position, r.best_position) for r in sinks.merge_keywords(snap, cur, prev).collect()}
    assert got == {"old": (5.0, 4.0, 3.0), "both": (7.0, 8.0, 6.0), "new": (9.0, 4.0, 9.0)}


def test_coverage_classes(spark):
    states = [("discovered - x", "N"), ("crawled - x", "N"), ("soft 404", "N"), ("not found (404)", "N"), ("odd", "ERROR"), ("", "N"), ("unknown to us", "N"), ("strange", "N")]
    df = spark.createDataFrame([("u", False, v, s) for s, v in states] + [("u", True, "PASS", "ok")], "url string, indexed boolean, verdict string, coverage_state string")
    got = [r["class"] for r in df.withColumn("class", indexation.classify()).collect()]
    assert got == ["resubmit", "enrich", "enrich", "prune", "prune", "resubmit", "resubmit", "enrich", "indexed"]


def test_graph_properties(spark, sf_dir):
    nodes = spark.createDataFrame([(u, 100) for u in "abcd"], "url string, word_count int")
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    ranks = {r.url: (r.raw, r.pagerank) for r in graph.pagerank(nodes, links).collect()}
    assert abs(sum(r for r, _ in ranks.values()) - 1) < 1e-9 and max(p for _, p in ranks.values()) == 100.0
    assert {(r.url, r.depth) for r in graph.click_depth(nodes, links, "a/").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", None)}
    assert graph.pagerank(nodes.limit(0), links.limit(0)).count() == 0


def test_linking_report_is_whole(spark):
    nodes = spark.createDataFrame([(u, 100 * u, u % 2, "v", "fr") for u in range(8)], "url long, word_count int, cluster int, city string, language string")
    anchors = spark.createDataFrame([(u, (u + 1) % 6, "ici" if u % 2 else "x", False, u) for u in range(6)], "src long, dst long, anchor string, nofollow boolean, pos long")
    out = graph.report(nodes, anchors, 0, 20)
    assert {r.url for r in out["orphans"].collect()} == {6, 7} and {r.url for r in out["deep"].collect()} == {4, 5}
    assert out["pages"].count() == 8 and out["generic_anchors"].count() == 3 and out["silos"].count() == 2
    assert {6, 7} <= {r.target for r in out["suggestions"].collect()} and out["health"].count() == 1


def test_home_page_is_the_last_donor(spark):
    """Targets whose donors all link them, or of unknown language, get the home page; targets it links already get none."""
    cell = lambda url, lang, inlinks: (url, "c", "x", lang, 50.0, 1, 1, inlinks, 400)
    m = [(0, None, None, "fr", 100.0, 3, 0, 5, 300), cell(1, "fr", 9), cell(2, "fr", 1), cell(3, None, 0), cell(4, None, 0), *(cell(10 + i, None, 0) for i in range(12))]
    nodes = spark.createDataFrame(m, "url long, cluster string, city string, language string, pagerank double, followed_out long, depth int, inlinks long, word_count long")
    links = spark.createDataFrame([(1, 2), (0, 4)], "src long, dst long")
    got = {r.target: r.donor for r in graph.suggestions(nodes, links, 0).collect()}
    assert got == {2: 0, 3: 0, **{10 + i: 0 for i in range(12)}}


def test_search_windows_do_not_overlap():
    today = dt.date(2024, 1, 31)
    assert search.date_window(today, 7) == (dt.date(2024, 1, 21), dt.date(2024, 1, 28))
    assert search.date_window(today, 7, 7)[1] == search.date_window(today, 7)[0]


def test_diversify_flag(spark):
    rows = spark.createDataFrame([(1, f"k{i}", None, "create", float(i)) for i in range(6)], "site_id long, keyword string, page string, action_type string, impact_score double").withColumn("page", F.col("keyword"))
    assert search.diversify(rows).count() == 6 and search.diversify(rows, page_of_creates=False).count() == 3


def test_similarity_is_symmetric_and_finds_near_copies(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = spark.createDataFrame([(1, base), (2, base + " tail"), (3, base), (4, "other words here only once"), (5, ""), (6, None)], "doc_id long, text string")
    got = {r.doc_id: (r.partner, r.similarity) for r in similarity.best_partner(rows).collect()}
    assert got == {1: (3, 100), 3: (1, 100), 2: (1, 99), 4: (None, 0), 5: (None, 0), 6: (None, 0)}


def test_links_between_groups_of_copies_are_counted(spark):
    """Two groups of copies near each other: every link shows in the counts, copies or not; against all pairs."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)] * 3 + [" ".join(base + ["tail"])] * 2 + [" ".join(["head"] + base)] + ["other words here only once", "", None]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)} for t in texts]
    want = {i: (min([j for j, b in enumerate(sets, 1) if a and b == a], default=i), sum(j != i and bool(a & b) and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets, 1))) for i, a in enumerate(sets, 1)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in similarity.best_partner(rows).collect()} == want
    assert want[1] == (1, 5) and want[5] == (4, 5) and want[6] == (6, 5)


def test_uniqueness_across_runs(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "g", " ".join(f"w{(i // 2) * 10 + j}" for j in range(8))) for i in range(9)], "doc_id long, source string, text string")
    whole = one(similarity.uniqueness(rows, "source"))
    monkeypatch.setattr(similarity, "RUN", 2)
    assert one(similarity.uniqueness(rows, "source")) == whole and whole.pairs == 8
    assert one(similarity.uniqueness(rows, "source", samples=3)).pairs == 3


def test_nearest_without_neighbours(spark):
    df = spark.createDataFrame([(1, 48.0, 2.0), (2, -40.0, 170.0)], "place_id long, lat double, lng double")
    assert {(r.place_id, r.neighbour) for r in geo.nearest(df).collect()} == {(1, 2), (2, 1)}


def test_nearest_at_the_date_line_the_poles_and_equal_coordinates(spark):
    """Against all pairs: the 180th meridian, both poles, a crowd at one point, far islands."""
    import math
    import random

    rng = random.Random(3)
    at = [(rng.uniform(-2, 2), rng.choice([179.99, -179.99, 180.0, -180.0]) + rng.uniform(-0.005, 0.005)) for _ in range(20)]
    at += [(rng.choice([89.9, -89.9]) + rng.uniform(-0.1, 0.1), rng.uniform(-180, 180)) for _ in range(20)] + [(48.0, 2.0)] * 12 + [(rng.uniform(-60, 60), rng.uniform(-180, 180)) for _ in range(40)]

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    got = geo.nearest(spark.createDataFrame([(i, *p) for i, p in enumerate(at)] + [(999, None, 1.0)], "place_id long, lat double, lng double"))
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    want = {(i, r + 1): round(d, 4) for i, a in enumerate(at) for r, d in enumerate(sorted(km(a, b) for j, b in enumerate(at) if j != i)[:5])}
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(r["km"] - want[r["place_id"], r["rank"]]) <= 0.0501 for r in rows)
    crowd = range(40, 52)
    assert all([r["neighbour"] for r in sorted(rows, key=lambda r: r["rank"]) if r["place_id"] == i] == [j for j in crowd if j != i][:5] for i in crowd)


def test_style_scores_stay_in_range(spark):
    text = "De plus, il est important de noter que tout va bien. " * 30
    rows = spark.createDataFrame([(1, text), (2, "short text"), (3, None)], "doc_id long, text string")
    r = stylometry.text_scores(rows).collect()
    assert [x.doc_id for x in r] == [1] and 0 <= r[0].score <= 100 and r[0].fam_b == 28.6
    assert {x.doc_id: x.word_count for x in stylometry.rejected(rows).collect()} == {2: 2, 3: 0}  # null: no words
    assert stylometry.evidence(stylometry.sentence_labels(rows)).count() == 6


@pytest.mark.parametrize("k", [3, 8])
def test_systematic_sample(spark, k):
    df = spark.range(50).selectExpr("id AS doc_id", "'s' AS source")
    assert stylometry.systematic_sample(df, "source", "doc_id", k).count() == k
