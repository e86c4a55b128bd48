"""Nearest places where many share few coordinates, or all lie in one small area."""

import math
import random

from quillspan.operators import geo


def _written(monkeypatch):
    """Counts the rows of every table that the search writes."""
    counts = []
    write = geo.materialize

    def counted(df, label="stage"):
        out = write(df, label)
        counts.append((label, out.count()))
        return out

    monkeypatch.setattr(geo, "materialize", counted)
    return counts


def test_places_of_one_position_look_around_once(spark, monkeypatch):
    """2,000 places at 20 positions: the search keeps six rows a position and side, and each place gets its own five."""
    counts = _written(monkeypatch)
    at = [(45 + k / 10, 2 + (k * 7 % 20) / 10) for k in range(20)]
    places = [(i, *at[i % 20]) for i in range(2000)]
    rows = geo.nearest(spark.createDataFrame(places, "place_id long, lat double, lng double").repartition(4)).collect()
    assert max(n for label, n in counts if label == "nearest-top") <= 20 * 6
    got = {i: [] for i in range(2000)}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["place_id"]].append((r["rank"], r["neighbour"], r["km"]))
    for i in range(2000):
        assert got[i] == [(n + 1, j, 0.0) for n, j in enumerate([j for j in range(i % 20, 2000, 20) if j != i][:5])]


def test_dense_area_starts_with_small_cubes(spark):
    """3,000 positions within a few kilometres, against all pairs."""
    rng = random.Random(2)
    at = [(48 + rng.random() / 50, 2 + rng.random() / 50) for _ in range(3000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "place_id long, lat double, lng double")

    def km(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    got = {(r["place_id"], r["rank"]): r["neighbour"] for r in geo.nearest(df).collect()}
    assert len(got) == 15000
    for i in range(0, 3000, 150):
        want = sorted((km(at[i], b), j) for j, b in enumerate(at) if j != i)[:5]
        assert [got[i, r] for r in range(1, 6)] == [j for _, j in want]
