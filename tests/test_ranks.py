"""Places in groups against sorting them, and the systematic sample over them."""

import random

from pyspark.sql import functions as F

from quillspan.operators import ranks, stylometry


def test_places(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(50)) for k in range(900)]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(5)
    got = {r["k"]: r["pos"] for r in ranks.ranked(df, ["g"], F.desc("v"), F.col("k")).collect()}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))
    assert ranks.ranked(df.limit(0), ["g"], F.col("k")).count() == 0


def test_sample(spark):
    rows = [(k, "hot" if k % 3 else None if k % 2 else f"s{k % 7}") for k in range(400)]
    got = stylometry.systematic_sample(spark.createDataFrame(rows, "doc_id long, source string"), "source", "doc_id", 8)
    want = []
    for g in {s for _, s in rows}:
        own = sorted(k for k, s in rows if s == g)
        want += [(k, g) for k in own[:: max(1, len(own) // 8)][:8]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
