"""Small operators, each on rows with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import audit, extract, visibility
from quillspan.sources import readers, sinks


def test_entity_scan_leaves_credentials_out(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x", "y", "z")], "id int, name string, app_password string, api_token string, Secret string").write.parquet(str(tmp_path / "sites"))
    got = readers.entity(spark, str(tmp_path / "sites"))
    assert got.columns == ["id", "name"] and [tuple(r) for r in got.collect()] == [(1, "a")]


def test_actions_are_appended(spark, tmp_path):
    path = str(tmp_path / "actions")
    for n in (1, 2):
        sinks.append_actions(spark.createDataFrame([(n, "fix")], "site_id int, action string"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "fix"), (2, "fix")]


def test_light_view_drops_nested_columns(spark):
    report = spark.createDataFrame([(1, "u", "<p>", "t", [1])], "page_id int, url string, html string, text string, outline array<int>")
    assert extract.light_view(report).columns == ["page_id", "url"]


def test_detail_view_of_one_url(spark):
    html = '<h1>Un</h1><h2>Deux</h2><a href="/x">X</a><a href="/y" rel="nofollow">Y</a>'
    pages = spark.createDataFrame([(1, "https://a.fr/", html), (2, "https://a.fr/b", "<h1>B</h1>")], "page_id long, url string, html string")
    (row,) = extract.detail_view(pages, "https://a.fr/").collect()
    assert row.page_id == 1 and [(a.dst, a.anchor) for a in row.anchors_out] == [("https://a.fr/x", "X"), ("https://a.fr/y", "Y")]
    assert extract.detail_view(pages, "https://a.fr/none").count() == 0


def test_comparable_pages(spark):
    rows = [(1, 200, "t", 51), (2, 200, "t", 50), (3, 404, "t", 90), (4, 200, "", 90), (5, None, "t", 90), (6, 399, None, 90)]
    pages = spark.createDataFrame(rows, "page_id int, status int, text string, word_count int")
    assert [r.page_id for r in audit.comparable(pages).collect()] == [1]


def test_iso_day_and_short_key(spark):
    rows = spark.createDataFrame([("2024-03-05T23:59:59Z",), (None,)], "at string")
    assert [r.d for r in rows.select(T.iso_day(F.col("at")).alias("d")).collect()] == [dt.date(2024, 3, 5), None]
    keys = [r.k for r in spark.createDataFrame([("hello",), ("",), (None,)], "s string").select(T.short_key(F.col("s")).alias("k")).collect()]
    # the first 12 hex digits of the MD5 of "hello" and of nothing
    assert keys == ["5d41402abc4b", "d41d8cd98f00", "d41d8cd98f00"]


def test_variant_quality(spark):
    rows = [("a", 50.0, ["x", "y"]), ("a", 60.0, ["y"]), ("a", 71.0, []), ("b", 90.0, [f"i{k}" for k in range(10)])]
    got = {r.variant: tuple(r)[1:] for r in readers.quality_verdicts(spark.createDataFrame(rows, "variant string, score double, issues array<string>")).collect()}
    assert got == {"a": (60.3, 50.0, 1, ["x", "y"]), "b": (90.0, 90.0, 0, [f"i{k}" for k in range(8)])}


@pytest.mark.parametrize("given, want", [
    ((0, 0, 0, 0, None), 0), ((1, 1, 1, 1, None), 15), ((9, 4, 1, 4, 0.0), 15), ((10, 5, 2, 5, 10.0), 34), ((50, 20, 3, 9, 50.0), 59), ((100, 50, 4, 10, 100.0), 90), ((500, 50, 9, 10, 100.0), 100),
])
def test_visibility_score(spark, given, want):
    """Bands of mentions 5-10-20-30-40 and citations 5-10-15-20, 2.5 a platform to 10, pages 3-7-10, a fifth of readiness."""
    rows = spark.createDataFrame([given], "mentions long, citations long, platforms long, pages long, readiness double")
    assert visibility.visibility_score(rows).collect()[0].visibility == want


def test_typed_reports(spark, tmp_path):
    def read(name, body, columns):
        (tmp_path / name).write_text(body)
        return [tuple(r) for r in readers.read_typed_report(spark, str(tmp_path / name), columns).collect()]

    assert read("o.csv", "Domain;Rank;Organic Keywords;Organic Traffic;Organic Cost\na.fr;12;340;x;56.789\n", readers.OVERVIEW_COLUMNS) == [("a.fr", 12, 340, 0, 56.79)]
    assert read("c.csv", "Dn;Cr;Np;Or;Ot\nb.fr;0.256;7;80;9.9\n", readers.COMPETITOR_COLUMNS) == [("b.fr", 0.26, 7, 80, 9)]
    assert read("b.csv", "ascore;total;domains_num\n31;4000;210\n", readers.BACKLINK_COLUMNS) == [(31, 4000, 210, 0)]


def test_unfinished_references_stay_in_visible_text(spark):
    page = "<html><head><title>x</title></head><body>a &amp b &amp; c &#233; d &#233 e &nosuch; f</body></html>"
    rows = spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")
    assert extract.page_text(rows).first()["text"] == "a &amp b & c é d &#233 e &nosuch; f"


def test_capitals_with_marks_count_in_lists_of_three(spark):
    from quillspan.operators import stylometry

    words = " ".join(f"mot{k}" for k in range(90))
    rows = spark.createDataFrame([(1, f"Été, Île et Âme {words}. ÉTÉ, ÎLE ET ÂME.")], "doc_id long, text string")
    assert stylometry.prepared(rows).first()["triples"] == 2
    assert stylometry.sentence_labels(rows).agg({"score": "min"}).first()[0] == 12


def test_repetition_moves_texts_not_grams(spark):
    from quillspan.operators import similarity

    rows = spark.createDataFrame([(1, "aa bb cc aa bb cc"), (1, "aa bb cc"), (2, None)], "doc_id long, text string")
    grams = similarity.repetition(rows, 2)
    assert sorted(map(tuple, grams.select("doc_id", "gram", "n").collect())) == [(1, "aa bb", 3), (1, "bb cc", 3)]
    plan = grams._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


#: Headings cut within a reference, as the tables' titles are.
CUT = '<html><head><title>a &quot</title></head><body><article><h1>a &quot</h1><h2>b &amp</h2><p>c &lt and &copy but &quot; &#39; &amp;quot;</p></article></body></html>'


def cut_page(spark):
    return spark.createDataFrame([(1, "http://a.example/", CUT)], "page_id long, url string, html string")


def test_cut_references_stay_in_a_skim(spark):
    got = extract.skim(cut_page(spark)).first()
    assert (got["title"], got["h1"], got["h2s"]) == ("a &quot", "a &quot", ["b &"])
    assert got["text"] == "a &quot\na &quot\nb &\nc &lt and &copy but \" ' &quot;"


def test_cut_references_stay_in_the_main_text(spark):
    assert extract.main_text(cut_page(spark)).first()["main_text"] == "a &quot\n\n## b &\n\nc &lt and &copy but \" ' &quot;"


def test_words_of_a_page_are_those_of_its_sql(spark, tmp_path):
    """A cut reference is a word of page_quality's SQL."""
    from quillspan.plans import catalogue

    from .oracle import connect, same

    page = CUT.replace("<p>", f"<p>{' '.join(f'word{k % 97} of line {k}.' for k in range(120))} ").replace("&lt and &copy but &quot; &#39; &amp;quot;", "&quot; d")
    spark.createDataFrame([(1, "http://a.example/", page.replace("<h2>b &amp</h2>", ""))], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_main_text", "page_quality"):
        same(con, catalogue.QUERIES[name](spark, str(tmp_path)), catalogue.ORACLES[name])


def test_cut_references_stay_in_a_profile(spark):
    got = extract.profile(cut_page(spark)).first()
    assert (got["h1s"], got["h2s"]) == (["a &quot"], ["b &"])
