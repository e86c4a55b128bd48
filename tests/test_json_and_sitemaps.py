"""JSON of unknown shape, objects in prose, sitemap indexes at any depth, languages of whole texts."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import audit
from quillspan.sources import json as J
from quillspan.sources import readers


def plain(node, out):
    if isinstance(node, dict):
        for k, v in node.items():
            kind = next((kind for kind, names in J.COLLECTED.items() if k in names), None)
            if isinstance(v, str) and kind:
                out.append((kind, v))
            elif not isinstance(v, str):
                plain(v, out)
    elif isinstance(node, list):
        for x in node:
            plain(x, out)
    return out


BODIES = [
    '{"url": "https:\\/\\/a.fr\\/x", "answer": "l\\u00e9 \\"quote\\"\\n", "text": {"text": "deep", "n": 1}, "list": ["text", {"snippet": "s", "link": null}]}',
    '[{"a": [[{"title": "t"}, {"title": 5}, {"title": ["x"]}]]}, "text"]',
    '{"a": ' * 40 + '{"content": "bottom"}' + "}" * 40,
    '{"text": "the \\"url\\": \\"no\\" inside"}',
    "not json", "", None, "null", '"text"', "{}", '{"text": ""}',
]


def test_collected_strings(spark):
    rows = [(k, b) for k, b in enumerate(BODIES)] + [(0, BODIES[0])]
    got = J.collect_strings(spark.createDataFrame(rows, "k int, b string"), "k", "b")
    want = []
    for k, b in rows:
        try:
            want += [(k, *x) for x in plain(json.loads(b or ""), [])]
        except ValueError:
            pass
    assert sorted((r["k"], r["kind"], r["value"]) for r in got.collect()) == sorted(want)
    assert J.collect_strings(spark.createDataFrame([], "k int, b string"), "k", "b").count() == 0
    texts = spark.createDataFrame([(BODIES[0],), (BODIES[3],)], "b string").select(T.json_texts(F.col("b"), ("url", "link"))).collect()
    assert [r[0] for r in texts] == [["https://a.fr/x"], []]


@pytest.mark.parametrize(
    ("prose", "want"),
    [
        ('stray { before {"a": 1} after', 1), ('{"a": 2} and a stray } or { after', 2), ('says {"b": "a } in a string \\" {", "a": 3}', 3), ('```json\n{"a": 4}\n``` and {"a": 5}', 4),
        ('```json\n{"a": broken}\n``` then {"a": 6}', 6), ('{not: json} {"a": {"x": {}}} {"a": 7}', None), ("none {", None), ("", None), (None, None), ("{" * 3000 + '{"a": 8}', 8), ('{"a":' * 2000, None),
    ],
)
def test_object_in_prose(spark, prose, want):
    got = spark.createDataFrame([(prose,)], "t string").select(J.json_in_prose(F.col("t"), "a int").alias("o")).first()["o"]
    assert (got["a"] if got is not None else None) == want


def test_sitemap_indexes_below_indexes(spark):
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc> {n} </loc></sitemap>" for n in names) + "</sitemapindex>"
    leaf = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    rows = [("root", index("a", "b", "gone")), ("a", index("c", "root")), ("b", leaf("u1", "u2")), ("c", index("d", "c")), ("d", leaf("u2", "u3")), ("other", leaf("u9")), ("e", None)]
    maps = spark.createDataFrame(rows, "sitemap string, body string")
    assert {r["loc"] for r in readers.sitemap_tree(maps, "root").collect()} == {"u1", "u2", "u3"}
    assert {r["loc"] for r in readers.sitemap_tree(maps, "d").collect()} == {"u2", "u3"} and readers.sitemap_tree(maps, "none").count() == 0


def test_language_of_the_whole_text(spark):
    text = "the of and to " * 400 + "le la les des une est vous " * 1000
    docs = spark.createDataFrame([(1, text), (2, "le la les des " * 6), (3, None), (4, "x " * 5000 + "the and of")], "doc_id int, text string")
    assert {r["doc_id"]: r["language"] for r in audit.detect_language(docs).collect()} == {1: "fr", 2: "fr", 3: "", 4: ""}
