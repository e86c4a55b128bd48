"""The HTML reader and the page queries over it against an independent parser on the standard library's."""

import json
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from quillspan.functions.html_tree import parse
from quillspan.operators import extract
from quillspan.plans import catalogue

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = set("address article aside blockquote div dl dt dd fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())


class Node:
    def __init__(self, name, parent, attrs=()):
        self.name, self.parent, self.attrs, self.parts = name, parent, dict(attrs), []

    def walk(self):
        for x in self.parts:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def pieces(self, hidden=()):
        for x in self.parts:
            if isinstance(x, str):
                yield x
            elif x.name not in hidden:
                yield from x.pieces(hidden)

    def text(self, hidden=()):
        return " ".join(s.strip() for s in self.pieces(hidden) if s.strip())

    def plain(self, hidden=()):
        return squeeze("".join(self.pieces(hidden)))

    def inside(self, names):
        x = self
        while x is not None and x.name not in names:
            x = x.parent
        return x is not None

    def all(self, *names):
        return [x for x in self.walk() if x.name in names]


class Reader(HTMLParser):
    """A tree with the implied ends of p and li, and end tags that leave the open blocks outside them alone."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", None)
        self.feed(html)
        self.close()

    def up_to(self, name, stop):
        x = self.at
        while x.name and x.name != name and x.name not in stop:
            x = x.parent
        if x.name == name:
            self.at = x.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self.up_to("p", ("td", "table"))
        if tag == "li":
            self.up_to("li", ("ul", "ol", "td"))
        if tag in ("td", "tr"):
            self.up_to("td", ("table",))
        if tag == "tr":
            self.up_to("tr", ("table",))
        node = Node(tag, self.at, attrs)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        stops = () if tag in ("table", "ul", "ol") else ("td", "ul", "ol") if tag == "li" else ("td", "table")
        if tag in ("b", "i", "a", "em", "strong", "span"):
            stops = ENDS_P | {"td", "body"}
        self.up_to(tag, stops)

    def handle_data(self, data):
        self.at.parts.append(data)


def squeeze(s):
    return " ".join(s.replace("\xa0", " ").split())


def tree(html):
    return Reader(html or "").root


def main_text(root):
    hidden = extract.NO_MAIN_TEXT
    seen = [x for x in root.walk() if not x.inside(hidden)]
    top = next((x for name in ("main", "article", "body") for x in seen if x.name == name), root)
    blocks = [x for x in top.all("h1", "h2", "h3", "h4", "p", "li") if not x.inside(hidden) and len(x.text(hidden)) > 2]
    return "\n\n".join(("## " if x.name in ("h2", "h3", "h4") else "") + x.text(hidden) for x in blocks)


def visible(root):
    return squeeze(" ".join(s.strip() for s in root.pieces((*extract.HIDDEN_BLOCKS, "title")) if s.strip()))


def colours(html):
    return ["#" + c for c, _ in Counter(re.findall(r"#([0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b", html)).most_common(8)]


def labels(root, url):
    base = "/".join(url.split("/")[:3])
    out = [a.plain() for a in root.all("a") if re.fullmatch(r"[^\"'#?]{2,80}", a.attrs.get("href") or "") and (a.attrs["href"].startswith("/") or base in a.attrs["href"])]
    return list(dict.fromkeys(t for t in out if 2 < len(t) < 40))


def row(page):
    html, root = page["html"] or "", tree(page["html"])
    kept = lambda *names, least=0: [t for t in (x.plain() for x in root.all(*names)) if len(t) > least]
    skim = "\n".join(s.strip() for s in root.pieces(extract.NO_SKIM) if s.strip())
    title, h1 = root.all("title"), root.all("h1")
    return {
        "page_main_text": {"main_text": main_text(root)},
        "page_text": {"text": visible(root), "word_count": len(re.findall(r"[a-zà-ÿ0-9]+", visible(root).lower()))},
        "page_blocks": {"n_paragraphs": len(kept("p", least=40)), "paragraphs": "|".join(kept("p", least=40)), "list_items": "|".join(kept("li", least=10))},
        "page_skim": {"title": title[0].plain() if title else "", "h1": h1[0].plain() if h1 else "", "h2s": "|".join(x.plain() for x in root.all("h2")), "text": skim},
        "page_profile": {
            "h1s": "|".join(kept("h1")), "h2s": "|".join(kept("h2")), "h3s": "|".join(kept("h3")), "nav_labels": "|".join(labels(root, page["url"])), "colours": "|".join(colours(html)),
            "features": "|".join(w for w in extract.FEATURE_WORDS if w in html.lower()), "paragraphs": "|".join(kept("p", least=60)),
        },
    }


NASTY = [
    None,
    "",
    "just text &amp; <b>bold</b>",
    "<main><article><p>First one</p></article><aside>ASIDE promo<p>more promo</p></aside><article><p>Second one</p></article></main>",
    "<article><p>Only this</p></article><aside><p>ASIDE promo</p></aside><article><p>not that</p></article>",
    "<body><nav>OUTER <nav>inner</nav> OUTER NAV REST</nav><p>Open one<p>Open two<div>Block</div><form><p>form text</p></form></body>",
    "<ul><li>one item long enough<li>two item long enough<ul><li>nested item long</ul><li>three</ul><p>ok<p>no",
    "<h1>T&eacute;te  <i>a</i>b</h1><h2></h2><h2>Deux</h2><h4> Quatre </h4><p>x</p><header><h1>In the header</h1><p>hidden text</p></header>",
    "<script>if (a < b) document.write('<p>no</p>')</script><style>p > a {color: #ABCDEF}</style><!-- <p>comment</p> --><p style='color:#abc'>A paragraph of more than sixty characters, so that the profile shows it too.</p>",
    '<a href="/contact">Contact us</a><a href="/contact">Contact us</a><a href="http://h.fr/x">Own</a><a href="http://else.org/">Other</a><a href="/q?x=1">Query</a><a href="#top">Top</a><a>No address</a><nav><a href="/y">Why &lt;b&gt;</a></nav>',
    "<table><tr><td><p>cell one<td>cell two</table><p>after the table, a text over forty characters, yes</p>",
    "<p>unclosed <b>bold <p>next paragraph</b> goes on</p></div></p><br/>tail",
]


def hand_pages(spark):
    rows = [(k, "http://h.fr/a/b", h) for k, h in enumerate(NASTY)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def wanted(spark, sf_dir):
    pages = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    return {p["page_id"]: row(p) for p in pages}, {k: row({"url": "http://h.fr/a/b", "html": h}) for k, h in enumerate(NASTY)}


@pytest.mark.parametrize("name", ["page_main_text", "page_text", "page_blocks", "page_skim", "page_profile"])
def test_page_queries(spark, sf_dir, monkeypatch, wanted, name):
    from quillspan.plans import audit

    for k, want in enumerate(wanted):
        if k:
            pages = hand_pages(spark)
            monkeypatch.setattr(audit, "_pages", lambda s, d: pages)
        got = {r["page_id"]: r.asDict() for r in catalogue.QUERIES[name](spark, sf_dir).collect()}
        assert set(got) == set(want)
        for i, r in got.items():
            r.pop("page_id")
            assert r == want[i][name], (i, name)


def test_technical_against_a_plain_reading(spark, sf_dir):
    rows = [("<meta name=A content='1'><meta name=a content=''>", None), ('<meta name="A" content="1"><META property="og:title" content="t"><meta name="a" content="2"><meta name="b" content="">', "next"), ("<p>" * 4, None), ("x" * 9000 + "wp-content", "wordpress")]
    pages = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extract.technical(pages).collect()}
    assert got[1]["meta"] == {"a": "2", "og:title": "t"} and got[1]["og"] == {"og:title": "t"}
    assert [got[k]["server_rendered"] for k in range(4)] == [False, False, True, True] and got[3]["frameworks"] == ["wordpress"]
    assert extract.technical(pages, 5000).filter("page_id = 3").first()["frameworks"] == []
    for r in catalogue.QUERIES["page_technical"](spark, sf_dir).collect():
        assert json.loads(r["meta"]) == {} and r["n_og"] == 0


def test_numbers_of_elements():
    t = parse("<div><p>a<p>b<ul><li>c<li>d</ul></div><table><tr><td>e<td>f<tr><td>g</table>")
    assert t.name[1:] == ["div", "p", "p", "ul", "li", "li", "table", "tr", "td", "td", "tr", "td"]
    assert t.last == [12, 6, 2, 3, 6, 5, 6, 12, 10, 9, 10, 12, 12]
    assert t.depth[1:] == [1, 2, 2, 2, 3, 3, 1, 2, 3, 3, 2, 3]
    assert [t.text(i, "|") for i in (1, 4, 7)] == ["a|b|c|d", "c|d", "e|f|g"]
    assert t.attrs(1) == {} and parse("<a HREF='x&amp;y' b c=d b=2>").attrs(1) == {"href": "x&y", "b": "", "c": "d"}


def test_deep_and_broken_markup():
    deep = parse("<div>" * 5000 + "<p>x</p>" + "</div>" * 5000 + "<p>after</p>")
    assert max(deep.depth) <= 513 and deep.parent[-1] == 0 and deep.text(len(deep.name) - 1, "") == "after"
    assert parse("<p>a</p><!-- open <p>b</p>").text(0, " ") == "a"
    assert parse("1 < 2 <3 <p title='>'>x</p").text(0, " ") == "1 < 2 <3 x"
    assert parse("<textarea><p>&amp;</textarea><title><b>t</title>").text(0, " ") == "<p>& <b>t"


def test_many_questions(spark):
    html = "".join(f"<h3>Q{k}</h3><p>A{k}</p>" for k in range(10_050))
    got = extract.faq_pairs(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert got.count() == 10_050 and got.filter("pos = 0").first()["question"] == "Q0"


def test_batches_leave_the_reader_in_groups(spark, monkeypatch):
    from quillspan.sources import html as H

    assert list(H.groups([5, 5, 20, 1, 0, 9], 10)) == [(0, 2), (2, 1), (3, 3)]
    assert list(H.groups([])) == []
    pages = spark.createDataFrame([(k, None if k % 7 == 0 else f"<p>{'x' * 3000}{k}</p>") for k in range(1000)], "page_id long, html string").coalesce(1)
    got = {r["page_id"]: (r["runs"], len(r["elements"])) for r in H.read_elements(pages, ("p",)).collect()}
    assert got == {k: ([], 0) if k % 7 == 0 else (["x" * 3000 + str(k)], 1) for k in range(1000)}
