"""Main text of web pages by composite text density.

Every element of the page's tree gets a density: characters per tag, adjusted by
how many of the characters and tags are links.  The sum of its children's
densities names the element that holds the article: the one with the largest
sum.  The lowest density on the path from it up to the body is the threshold;
elements that reach it, each replaced by the largest sum inside it, are content
too.  If an ``article`` (or ``main``) element holds the selected one, all of it
is content, so that short or link-rich paragraphs of an article stay.

Before densities are computed, what never is article goes out of the tree:
scripts, styles, forms, menus, asides, footers, page headers, and elements whose
role, class or id says advert, notice, sidebar, comments and the like.  A header
that stands in an article and holds a heading stays.

Rows: one per row of the input, whatever repeats.  Null and empty markup, and
pages without text, give the empty text; a null id or url stays null.  Only
(page_id, url, html) are read, so further columns of any name do no harm.  A
page is worked on alone, in time and memory linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillspan.functions.html_tree import BLOCKS, Tree, parse
from quillspan.workspace import spread, table

# Elements, roles and words of class or id that mark what is no article.
NOISE_TAGS = frozenset("script style noscript template iframe object embed svg math nav aside footer dialog menu button select textarea input head title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentlists disqus respond reply replies".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored promo promos promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "sidebar sidebars rail widget widgets menu menus nav navs navbar navigation topnav breadcrumb breadcrumbs pagination pager toolbar "
    "footer masthead share sharing social related recommended recommendations outbrain taboola skip login".split()
)
#: Before one of the words above: the element is said to be without it, or only to make room for it.
NEGATIONS = frozenset("no not has have with without hide".split())
ARTICLE_ROLES = frozenset("main article".split())
FOOTER_STARTS = ("©", "copyright ", "(c) ")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROTECTED = frozenset(["html", "body", "main", "article"])


def _words(value: str) -> list[str]:
    """Words of a class or id, cut at anything but letters and digits and before capitals."""
    out, word = [], ""
    for c in value:
        if not c.isalnum() or (c.isupper() and word and not word[-1].isupper()):
            out.append(word.lower())
            word = ""
        if c.isalnum():
            word += c
    return [w for w in [*out, word.lower()] if w]


def _says(words: list[str], marks: frozenset) -> bool:
    return any(w in marks and not (k and words[k - 1] in NEGATIONS) for k, w in enumerate(words))


@lru_cache(4096)
def _signs(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether attributes speak of comments, of other noise, of a header, of the article."""
    probe = Tree()
    probe.attributes[0] = attributes
    attrs = probe.attrs(0)
    words = _words(attrs.get("class", "") + " " + attrs.get("id", ""))
    role = attrs.get("role", "").lower()
    article = role in ARTICLE_ROLES or attrs.get("itemprop", "").lower() == "articlebody"
    return _says(words, COMMENT_WORDS), role in NOISE_ROLES or _says(words, NOISE_WORDS), _says(words, frozenset(["header"])), article


def _spread_down(tree: Tree, flags: np.ndarray) -> np.ndarray:
    """Flags of elements handed to all elements inside them."""
    end = -1
    for i in np.flatnonzero(flags).tolist():
        if i > end:
            end = tree.last[i]
            flags[i : end + 1] = True
    return flags


def noise(tree: Tree) -> np.ndarray:
    """For each element, whether it is, or lies in, something that never is article."""
    n = len(tree.name)
    own = np.zeros(n, bool)
    holder = np.zeros(n, bool)  # article or main, unless it is a reader's comment
    suspect, headers, forms = [], [], []
    for i in range(1, n):
        name = tree.name[i]
        if name in NOISE_TAGS:
            own[i] = True
            continue
        comment = marked = header = article = False
        if tree.attributes[i]:
            comment, marked, header, article = _signs(tree.attributes[i])
            if name in PROTECTED:
                comment, marked, header = comment and name not in ("html", "body"), False, False
        if comment:
            own[i] = True
        else:
            holder[i] = article or name in ARTICLE_ROLES
            if marked:
                suspect.append(i)
        if header or name == "header":
            headers.append(i)
        elif name == "form":
            forms.append(i)
    last = np.asarray(tree.last)
    inside = lambda flags, i: bool(flags[i + 1 : last[i] + 1].any())
    heading = np.array([x in HEADINGS for x in tree.name])
    first = np.array([x == "h1" for x in tree.name])
    for i in suspect:
        own[i] = not inside(holder, i)
    for i in headers:
        own[i] |= not (inside(holder, i) or (_holder_of(tree, holder, i) is not None and inside(heading, i)))
    for i in forms:  # some pages wrap everything in a form
        own[i] |= not (inside(holder, i) or inside(first, i))
    return _spread_down(tree, own)


def _holder_of(tree: Tree, holder: np.ndarray, i: int) -> int | None:
    """The innermost article or main around element i, or i itself; an article is preferred to the main around it."""
    while i > 0:
        if holder[i]:
            return i
        i = tree.parent[i]
    return None


def densities(tree: Tree, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(composite density, sum of the children's densities, whether it is a list of links) of each element; elements marked in ``out`` count nothing."""
    n = len(tree.name)
    last, parent = np.asarray(tree.last), np.asarray(tree.parent)
    link = _spread_down(tree, np.array([x == "a" for x in tree.name])) & ~out
    own = np.zeros(n)
    for at, text, _ in tree.runs:
        if not out[at]:
            own[at] += len("".join(text.split()))

    def inside(x):  # sums over each element's interval of numbers
        s = np.concatenate([[0.0], np.cumsum(x)])
        return s[last + 1] - s[:-1]

    tags = inside((~out).astype(float)) - (~out)
    chars, link_chars, link_tags = inside(own), inside(own * link), inside(link.astype(float)) - link
    body = next((i for i in range(1, n) if tree.name[i] == "body"), 0)
    ratio = link_chars[body] / max(chars[body], 1.0)
    one = lambda x: np.maximum(x, 1.0)

    def composite(c, lc, t, lt):
        empty = c == 0
        c = one(c)
        base = np.log(np.log(c / one(c - lc) * one(lc) + ratio * c + np.e))
        return np.where(empty, 0.0, c / one(t) * np.log(one(c / one(lc) * one(t) / one(lt))) / base)

    density = composite(chars, link_chars, tags, link_tags)
    sums = composite(own, own * link, np.zeros(n), np.zeros(n))  # an element's own text is a child without tags
    np.add.at(sums, parent[1:], density[1:])
    return density, sums, (link_tags >= 2) & (link_chars >= 0.8 * chars)


def select(tree: Tree, out: np.ndarray) -> np.ndarray:
    """For each element, whether its own text is content."""
    n = len(tree.name)
    keep = np.zeros(n, bool)
    density, sums, links = densities(tree, out)
    body = next((i for i in range(1, n) if tree.name[i] == "body"), 0)
    lo, hi = body, tree.last[body]
    best = lo + int(np.argmax(sums[lo : hi + 1]))
    if sums[best] <= 0:  # nothing, or nothing but links
        return ~out
    holder = np.array([x in ARTICLE_ROLES or bool(a) and _signs(a)[3] for x, a in zip(tree.name, tree.attributes)]) & ~out
    root = _holder_of(tree, holder, best)
    if root is None and holder.any() and tree.name[best] in ("", "body", "html"):
        # the body's sum is the largest where the article is short: the holder of most of the densities
        inside = np.flatnonzero(holder)
        root = int(inside[np.argmax(sums[inside])])
    if root is not None:
        keep[root : tree.last[root] + 1] = True
        return keep & ~out
    threshold, i = density[best], best
    while i > 0 and i != tree.parent[body]:
        threshold = min(threshold, density[i])
        i = tree.parent[i]
    keep[best : tree.last[best] + 1] = True
    if best <= body:  # a page without a part for its article: all but lists of links and the footer
        for i in _children(tree, body):
            if links[i] or tree.text(i, " ").lower().startswith(FOOTER_STARTS):
                keep[i : tree.last[i] + 1] = False
        return keep & ~out
    # others that reach the threshold: from the outside in, each stands for the largest sum inside it
    i = body + 1
    while i <= hi:
        if keep[i]:
            i = tree.last[i] + 1
        elif density[i] >= threshold and not i <= best <= tree.last[i] and not tree.text(i, " ").lower().startswith(FOOTER_STARTS):
            top = i + int(np.argmax(sums[i : tree.last[i] + 1]))
            keep[top : tree.last[top] + 1] = True
            i += 1
        else:
            i += 1
    # headings right before content on the way up belong to it
    i = best
    while i > body:
        siblings = [j for j in _children(tree, tree.parent[i]) if j < i]
        for j in reversed(siblings):
            if tree.name[j] not in HEADINGS:
                break
            keep[j : tree.last[j] + 1] = True
        i = tree.parent[i]
    return keep & ~out


def _children(tree: Tree, i: int) -> list[int]:
    out, j = [], i + 1
    while j <= tree.last[i]:
        out.append(j)
        j = tree.last[j] + 1
    return out


def main_text(html: str | None) -> str:
    """The article of one page: blocks in page order, white space as single spaces."""
    tree = parse(html)
    keep = select(tree, noise(tree))
    breaks = [k for k, name in enumerate(tree.name) if name in BLOCKS or name == "br"]
    ends = sorted({tree.last[k] for k in breaks if tree.name[k] != "br"})
    parts: list[str] = []
    b = e = 0
    block_of: dict[int, int] = {}

    def block(i: int) -> int:
        """The innermost block around element i."""
        path = []
        while i > 0 and i not in block_of and tree.name[i] not in BLOCKS:
            path.append(i)
            i = tree.parent[i]
        found = block_of.get(i, i)
        for j in path:
            block_of[j] = found
        return found

    before = -1
    for at, text, order in tree.runs:
        moved = False
        while b < len(breaks) and breaks[b] <= order:  # a block or line break has started since
            b, moved = b + 1, True
        while e < len(ends) and ends[e] < order:
            e, moved = e + 1, True
        here = block(at)
        if moved or here != before:
            parts.append(" ")
        before = here
        if keep[at]:
            parts.append(text)
    return " ".join("".join(parts).split())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``."""

    def work(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = spread(pages.select("page_id", "url", pages["html"].cast("string").alias("html")))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages")).selectExpr("page_id", "url", "text", "cast(length(text) as bigint) as n_chars")
