"""Donors of link suggestions against a plain simulation of the rounds, and what the assignment promises."""

import random
from collections import Counter

from quillspan.operators import graph as G

PAGE = "url long, {} double, language string, cluster string, city string"


def plain(want, donors, links, per_donor=8):
    """The same rounds with lists and dictionaries."""
    def lists(row):
        _, _, language, cluster, city = row
        if not language:
            return
        for level, shared in enumerate(((cluster, city), (cluster,), (city,), ())):
            if all(shared):
                yield level, (level, language, *shared)

    relevance = (1.0, 0.8, 0.5, 0.3)
    left = {d[0]: per_donor for d in donors}
    got = {}
    while True:
        places, stuck_order = {}, {}
        for d in sorted(donors, key=lambda d: (-d[1], d[0])):
            for level, key in lists(d):
                if left[d[0]] > 0:
                    places.setdefault(key, []).extend([d] * left[d[0]])
                    stuck_order.setdefault(key, []).append(d)
        asks, queue = {}, Counter()
        for t in sorted((t for t in want if t[0] not in got), key=lambda t: (-t[1], t[0])):
            fine = lambda d, t=t: d[0] != t[0] and (d[0], t[0]) not in links
            offers = []
            for level, key in lists(t):
                p, queue[key] = queue[key], queue[key] + 1
                row = places.get(key, [])
                if p < len(row) and fine(row[p]):
                    offers.append((-row[p][1] * relevance[level], level, row[p][0]))
            if not offers and t[2]:
                first = next((d for d in stuck_order.get((3, t[2]), []) if fine(d)), None)
                if first:
                    offers.append((-first[1] * 0.3, 3, first[0]))
            if offers:
                _, level, donor = min(offers)
                asks.setdefault(donor, []).append((t[0], level))
        if not asks:
            return {(t, *d) for t, d in got.items()}
        for donor, who in asks.items():  # in order of need already
            for t, level in who[: left[donor]]:
                got[t] = (donor, level)
            left[donor] -= min(left[donor], len(who))


def case(seed, targets, pages, edges, clusters=3, languages=("fr", "fr", "en")):
    rng = random.Random(seed)
    rows = [(k, rng.choice([0.0, 1.0, 2.0, rng.random()]), rng.choice(languages), rng.choice([None, "", *(f"c{x}" for x in range(clusters))]), rng.choice([None, "", "lyon", "nice"])) for k in range(pages)]
    want = [(r[0], rng.choice([1.0, 3.0, rng.random()]), *r[2:]) for r in rng.sample(rows, targets)]
    return want, rows, {(rng.randrange(pages), rng.randrange(pages)) for _ in range(edges)}


CASES = {
    "two hundred targets of one group": ([(k, 1.0 + k % 7, "fr", "c", "lyon") for k in range(200)], [(1000 + k, float(k % 5), "fr", "c", "lyon") for k in range(26)], {(1000 + k % 26, k) for k in range(0, 200, 3)}),
    "more targets than places": ([(k, float(k), "fr", "c", "x") for k in range(40)], [(100 + k, 1.0, "fr", "c" if k else None, "x") for k in range(3)], set()),
    "only the page itself, or linked": ([(1, 1.0, "fr", None, None), (2, 2.0, "fr", "c", ""), (3, 1.0, "en", "c", "x"), (4, 9.0, None, "c", "x")], [(1, 5.0, "fr", None, None), (3, 1.0, "en", "c", "x")], {(1, 2)}),
    "most donors link already": ([(k, 1.0, "fr", None, None) for k in range(5)], [(100 + k, 50.0 - k, "fr", None, None) for k in range(50)], {(100 + d, t) for t in range(5) for d in range(50) if d not in (t, 47)}),
    "mixed": case(1, 60, 90, 400),
    "few donors": case(2, 30, 30, 300, 1, ("fr",)),
    "languages unknown": case(3, 40, 60, 100, 2, ("fr", None, "")),
}


def together():
    """All cases as one site: pages and languages of a case are its own."""
    want, donors, links = [], [], set()
    for k, (w, d, e) in enumerate(CASES.values()):
        move = lambda r, k=k: (r[0] + 10_000 * k, r[1], r[2] and f"{k}{r[2]}", *r[3:])
        want += map(move, w)
        donors += map(move, d)
        links |= {(a + 10_000 * k, b + 10_000 * k) for a, b in e}
    return want, donors, links


def test_donors(spark):
    want, donors, links = together()
    frames = spark.createDataFrame(want, PAGE.format("need")), spark.createDataFrame(donors, PAGE.format("strength")), spark.createDataFrame(sorted(links), "src long, dst long")
    got = {tuple(r) for r in G.assign_donors(*frames).collect()}
    for k, name in enumerate(CASES):
        own = {(t - 10_000 * k, d - 10_000 * k, level) for t, d, level in got if t // 10_000 == k}
        assert own == plain(*CASES[name]), name
    used = Counter(d for _, d, _ in got)
    served = {t for t, _, _ in got}
    assert max(used.values()) <= 8 and len(served) == len(got)
    for t in want:  # who has none: no donor of the language has a place, is another page, and does not link to it
        if t[2] and t[0] not in served:
            assert not [d for d in donors if d[2] == t[2] and used[d[0]] < 8 and d[0] != t[0] and (d[0], t[0]) not in links]


def test_places_in_lists_of_several_spans(spark, monkeypatch):
    monkeypatch.setattr(G, "SPAN_BITS", 2)
    want, donors, links = CASES["few donors"]
    frames = spark.createDataFrame(want, PAGE.format("need")), spark.createDataFrame(donors, PAGE.format("strength")), spark.createDataFrame(sorted(links), "src long, dst long")
    assert {tuple(r) for r in G.assign_donors(*frames).collect()} == plain(want, donors, links)


def test_later_rounds_look_up_only_what_is_asked(spark, monkeypatch):
    want = [(k, 1.0 + k, "fr", "c", "lyon") for k in range(30)]
    donors = [(100 + k, 9.0 if k < 2 else 1.0, "fr", "c", "lyon") for k in range(3000)]
    links = {(100, 29), (101, 29)}
    written = []
    keep = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label: written.append(keep(df, label)) or written[-1])
    frames = spark.createDataFrame(want, PAGE.format("need")), spark.createDataFrame(donors, PAGE.format("strength")), spark.createDataFrame(sorted(links), "src long, dst long")
    assert {tuple(r) for r in G.assign_donors(*frames).collect()} == plain(want, donors, links)
    assert max(df.count() for df in written) < 500
