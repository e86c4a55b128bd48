"""Fill-in-middle, the Merkle manifest and main text against plain versions, odd rows included."""

import hashlib
import html
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillspan.llm import fim, html_density, merkle

from .helpers import SCHEMA, frame, odd_texts, with_clashes

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_outline_on_random_texts_with_shared_passages():
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdefgh Z.é\n😀<") for _ in range(rng.randrange(1, 9000))) for _ in range(12)] + ["a" * 20_000, "." * 9_000]
    chunks = fim.Chunks(30_000)
    for _ in range(250):
        text = "".join(rng.choice(passages) for _ in range(rng.randrange(0, 4)))
        outline, tokens = fim.Outline(text, chunks), TOKEN.findall(text)
        assert outline.n == len(tokens)
        for k in [0, len(tokens), *(rng.randrange(len(tokens) + 1) for _ in range(6))]:
            assert outline.place(k) == sum(map(len, tokens[:k]))
    assert chunks.hits > 100 and chunks.held <= 30_000


def test_chunks_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr("builtins.hash", lambda _: 7)
    chunks = fim.Chunks()
    assert chunks.summary(fim.code_points("ab c")) == (3, True, True)
    assert chunks.summary(fim.code_points("1.")) == (2, False, False)
    assert chunks.summary(fim.code_points("ab c")) == (3, True, True) and chunks.held == 4


def test_chunk_borders_follow_the_content():
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefghij klm") for _ in range(60_000))
    pieces = lambda t: {t[a:b] for a, b in zip([0, *fim.chunk_ends(fim.code_points(t))], fim.chunk_ends(fim.code_points(t)))}
    assert len(pieces("some other start " + body) & pieces(body)) > 0.8 * len(pieces(body))


def test_fim_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = fim.op11_fim(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_fim(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r)[1:5] == want[:4] and r["output_sha256"] == sha(want[4]) and r["restored_sha256"] == sha(texts[r["doc_id"]])


def test_fim_odd_rows(spark):
    texts = [*odd_texts(), "x <M> y", "<P>", "ab" * 30_000, "é1 b" * 9000]
    docs = with_clashes(frame(spark, texts)).withColumn("form", F.lit(1)).withColumn("output", F.lit(1))
    docs = docs.unionByName(docs.filter("doc_id in (3, 5)")).unionByName(docs.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    got = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = [(i, *plain_fim(i, t), t or "") for i, t in [*enumerate(texts), (3, texts[3]), (5, texts[5]), (None, texts[6])]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    forms = {r["form"] for r in fim.fill_in_middle(docs, rate=100, spm=100).filter("doc_id in (3, 5)").collect()}
    assert forms == {"spm"} and fim.fill_in_middle(docs.limit(0)).count() == 0


def plain_tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text). Result rows as op13 has them."""
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(put, r)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, plain_tree([leaf(r) for r in own])
    top = plain_tree([trees[g][1][-1][0] for g in langs])
    out = []
    for g, lang in enumerate(langs):
        own, levels = trees[lang]
        for slot, r in enumerate(own):
            path = []
            for tree, s in ((levels, slot), (top, g)):
                for nodes in tree[:-1]:
                    path.append((s % 2, nodes[s ^ 1] if s ^ 1 < len(nodes) else None))
                    s //= 2
            changed = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf(r)
            for side, other in path:
                node = sha(node if other is None else other + node if side else node + other)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], sha("".join(o for _, o in path if o)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def held(df):
    hexed = lambda c: F.lower(F.hex(c))
    rows = merkle.manifest(df).select("doc_id", hexed("leaf"), hexed("subroot"), hexed("root"), F.sha2(F.concat_ws("", F.transform("proof", hexed)), 256), hexed("folded_root"), F.col("folded_root") == F.col("root"))
    return sorted(map(tuple, rows.collect()), key=repr)


def test_merkle_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, merkle.op13_merkle(spark, sf_dir).collect()), key=repr) == plain_manifest(rows)


CASES = {
    "one row": [(5, "s", "en", 3, "abc")],
    "a language each": [(k, None, f"l{k}", k, "t") for k in range(7)],
    "ids far apart, at both ends, and in one word": [(i, "s", "en", 1, "x") for i in (-(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, 1 << 40, 62, 1, -64)] + [(7, "é", "ü", (1 << 63) - 1, "ü")],
    "null and equal ids": [(None, "s", "en", k % 3, f"t{k % 4}") for k in range(40)] + [(9, None, None, None, None)] * 5 + [(9, "s", "en", 1, f"v{k % 6}") for k in range(30)] + [(k, "s", "en", 1, "w") for k in range(20)] + [(None, None, "", None, "")],
    "more than one array": [(k * 3, "s", "en" if k % 400 else None, k, f"t{k}") for k in range(1300)],
}


@pytest.mark.parametrize("name", CASES)
def test_merkle_rows(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    for c in ("g", "n", "slot", "node", "word", "bits", "path", "w", "bit"):
        df = df.withColumn(c, F.lit(1))
    assert held(df) == plain_manifest(rows)


def test_merkle_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proof_and_change():
    nodes = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    top, below = merkle.reduce_array(nodes, 4)
    for k, node in enumerate(nodes):
        assert merkle.fold(node, merkle.path_in(below, k)) == top
        assert merkle.fold(nodes[k - 1], merkle.path_in(below, k)) != top


def test_pages_query(spark, sf_dir):
    """The pages hold their article between its tags, in paragraphs of which some are not closed."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = html_density.op12_main_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inside))).split())
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), pages[r["page_id"]]["url"])


LONG = "A paragraph with words enough to count as text of an article, as one would write it."
PAGES = [
    (None, ""),
    ("", ""),
    ("  \n ", ""),
    ("hello <b>wor</b>ld &amp; co&nbsp;ltd &lt;x&gt; &#233;&hellip;", "hello world & co ltd <x> é…"),
    ("<nav>menu</nav><footer>end</footer><script>var x = '<p>no</p>'</script>", ""),
    # no article element: the content part by its sum, the title before it, nothing of bars, notices, forms and readers
    (f"<body><header><h1>Site</h1></header><div class='sidebar'><p>{LONG}</p></div><h1>Title</h1><div id=content><p>{LONG}</p><p>{LONG} <a href=x>More</a>.</p><ul><li>one<li>two</ul>"
     f"<div class='comments-area'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div><div id='cookie-notice'>We use cookies.</div><form><p>{LONG}</p></form><div>© 2024 somebody</div></body>",
     f"Title {LONG} {LONG} More. one two"),
    # an article shorter than what stands around it
    (f"<body><div class='ad'>{LONG}</div><article><h1>T</h1><p>Short.</p></article><aside>{LONG}</aside><footer>{LONG}</footer></body>", "T Short."),
    # readers' articles, a header of the article, a link-rich paragraph of it
    (f"<main><article><header><h1>T</h1><nav>x</nav></header><p>{LONG}</p><p><a href=a>see</a> <a href=b>also</a></p></article></main><section id='comments'><article><p>{LONG * 9}</p></article></section>", f"T {LONG} see also"),
    # unclosed and nested blocks, comments, line breaks, a menu in a menu
    ("<article><p>one<p>two<br>three<!-- <p>no</p> --><ul><li>a<ul><li>b</ul><li>c</ul><nav>m<nav>n</nav>rest</nav><p>f<i>o</i>o</article>", "one two three a b c foo"),
    ("<div class='page no-sidebar has-ads'><p>" + LONG + "</p></div>", LONG),
    (f"<form id=aspnet><div id=top><a href=1>Home</a> <a href=2>Shop</a></div><div><h1>T</h1><p>{LONG}</p><input name=q></div></form>", f"T {LONG}"),
    ("<article>a < b and c &unknown; d &amp", "a < b and c &unknown; d &"),
]


def test_pages_by_hand(spark):
    rows = [(k, None if k == 3 else f"u{k}", h) for k, (h, _) in enumerate(PAGES)] + [(None, "u", PAGES[6][0]), (6, "u6", PAGES[6][0])]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("n_chars", F.lit(1)).withColumn("text", F.lit("x"))
    got = sorted(map(tuple, html_density.extract(pages).collect()), key=repr)
    want = [(k, None if k == 3 else f"u{k}", w) for k, (_, w) in enumerate(PAGES)] + [(None, "u", PAGES[6][1]), (6, "u6", PAGES[6][1])]
    assert got == sorted(want, key=repr)
    assert html_density.extract(pages.limit(0)).count() == 0


def test_long_and_deep_pages():
    assert html_density.main_text("<div>" * 50_000 + "x" + "</div>" * 50_000 + "<footer>no</footer>") == "x"
    assert html_density.main_text("<article>" + "<p>word " * 50_000) == " ".join(["word"] * 50_000)
    assert html_density.main_text("<a \"" * 50_000) == "" == html_density.main_text("<script>" + "<!-- " * 50_000)


def test_densities_against_the_formula():
    """Composite density and sums of a small page, computed element by element from the definition."""
    import math

    from quillspan.functions.html_tree import parse

    tree = parse("<body><div><p>abcdefghij <a>klm</a><p>nopq</div><div><a>rs</a><a>tu</a></div></body>")
    kids = {i: [j for j in range(len(tree.name)) if tree.parent[j] == i] for i in range(len(tree.name))}
    own = {i: sum(len("".join(t.split())) for at, t, _ in tree.runs if at == i) for i in kids}
    below = lambda i: [x for j in kids[i] for x in (j, *below(j))]
    under_link = lambda i: tree.name[i] == "a"
    chars = lambda i: own[i] + sum(own[j] for j in below(i))
    links = lambda i: sum(own[j] for j in (i, *below(i)) if under_link(j))
    body = tree.name.index("body")

    def density(c, lc, t, lt):
        base = math.log(math.log(c / max(c - lc, 1) * max(lc, 1) + links(body) / chars(body) * c + math.e))
        return c / max(t, 1) * math.log(max(1, c / max(lc, 1) * max(t, 1) / max(lt, 1))) / base if c else 0.0

    whole = {i: density(chars(i), links(i), len(below(i)), sum(under_link(j) for j in below(i))) for i in kids}
    sums = {i: sum(whole[j] for j in kids[i]) + density(own[i], own[i] if under_link(i) else 0, 0, 0) for i in kids}
    import numpy as np

    got = html_density.densities(tree, np.zeros(len(tree.name), bool))
    assert np.allclose(got[0], [whole[i] for i in range(len(tree.name))]) and np.allclose(got[1], [sums[i] for i in range(len(tree.name))])
