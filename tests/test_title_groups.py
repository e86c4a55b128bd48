"""Groups of nearly equal titles against page by page comparison."""

import random

from quillspan.operators import audit, graph, similarity

STOP = {w for words in audit.STOP_WORDS.values() for w in words.split()}
COLUMNS = "url string, title string, cluster string, city string"


def by_hand(pages):
    """Page by page in order of url: who is in no group yet heads one of the later pages at 0.85 or more."""
    held, places = set(), {}
    for url, _, cluster, city in pages:
        if cluster is not None and city:
            places.setdefault((cluster, city), set()).add(url)
    for urls in places.values():
        if len(urls) > 1:
            held |= urls
    words = {u: {w for w in (t or "").lower().split() if len(w) > 2 and w not in STOP and w != (c or "").lower()} for u, t, _, c in pages if u is not None}
    order, out = sorted(u for u in words if words[u]), set()
    for i, u in enumerate(order):
        near = [v for v in order[i + 1 :] if len(words[u] & words[v]) / len(words[u] | words[v]) >= 0.85]
        if near and u not in held:
            out.add((u, " ".join(sorted(words[u]))[:50], len(near) + 1))
            held |= {u, *near}
    return out


def test_same_titles_page_by_page(spark):
    rng, pages = random.Random(7), []
    pool = "depannage serrurerie ouverture porte blindee volet roulant vitrerie urgence nuit artisan agree devis gratuit rapide fiable proche ancien".split()
    bases = [rng.sample(pool, 12) for _ in range(6)]
    for i in range(220):
        title = list(rng.choice(bases))
        # swaps of one word make chains in which neighbours of neighbours are not near
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            title[rng.randrange(12)] = rng.choice(pool)
        city = rng.choice(["paris", "lyon", "", None])
        pages.append((f"u{rng.randrange(10**6):06d}", " ".join([*title, city or "", "de", "les"]), rng.choice(["a", "b", None, None, None]), city))
    pages += [("v1", None, None, None), ("v2", "", None, ""), ("v3", "de la", None, "paris")]
    got = graph.same_titles(spark.createDataFrame(pages, COLUMNS)).collect()
    want = by_hand(pages)
    assert len(want) > 5 and {tuple(r) for r in got} == want


def test_title_groups_of_odd_rows(spark):
    rows = [(None, "porte blindee", None, None), ("b", "porte blindee", None, None), ("b", "porte blindee", None, None), ("c", "blindee porte", None, None)]
    pages = spark.createDataFrame(rows, COLUMNS)
    assert [tuple(r) for r in similarity.title_groups(pages, []).collect()] == [("b", "blindee porte", 2)]
    assert similarity.title_groups(pages, [], pages.filter("url = 'b'").select("url")).count() == 0
    assert similarity.title_groups(pages.filter("false"), []).count() == 0
