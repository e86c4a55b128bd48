"""MinHash partners: recall against all pairs, linear work on clusters of near copies, odd rows."""

import random

import numpy as np

from quillspan.operators import minhash, similarity
from quillspan.functions import text as T
from pyspark.sql import functions as F


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, base, changes):
    out = list(base)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def test_recall_at_the_threshold(spark):
    """Planted pairs around 0.8, short texts too: of the texts that have a partner, nearly all are found, and none other."""
    rng = random.Random(5)
    rows = []
    for k in range(600):
        base = words(rng, rng.choice([12, 40, 150, 400]))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(rng, base, max(1, len(base) // 48)) if rng.random() < 0.8 else base[: len(base) * 5 // 6]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    exact = {r["doc_id"]: (r["partner"], r["similarity"]) for r in similarity.best_partner(docs).collect() if r["partner"] is not None}
    found = {r["doc_id"]: (r["partner"], r["similarity"]) for r in minhash.lsh_partner(docs).collect() if r["partner"] is not None}
    assert set(found) <= set(exact) and all(found[i] == exact[i] for i in found)
    near = [i for i in exact if exact[i][1] < 84]
    assert len(near) > 80 and len(found) >= 0.99 * len(exact) and sum(i in found for i in near) >= 0.95 * len(near)


def test_linear_on_near_copies(spark):
    """5,000 texts within a few words of one another: compared pairs follow the texts, not their square, and everyone has a partner."""
    rng = random.Random(6)
    base = words(rng, 120)
    rows = [(k, " ".join(edited(rng, base, 1))) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    heads = docs.select(F.col("doc_id").alias("c"), F.sort_array(T.shingles(F.col("text"), 5)).alias("shingles"))
    links, compared = minhash.lsh_links(heads.dropDuplicates(["shingles"]))
    assert compared <= 10 * 5000 and links.count() <= 10 * 5000
    linked = {i for r in links.collect() for i in (r["a"], r["b"])}
    assert len(linked) == heads.select("shingles").distinct().count()


def test_clusters_in_one_bucket_are_told_apart(spark, monkeypatch):
    """With one band of one minimum unlike texts share buckets; those that the representative refuses choose again."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    rng = random.Random(7)
    shared = words(rng, 40)
    bases = [shared + words(rng, 60) for _ in range(6)]
    rows = [(100 * k + j, " ".join(edited(rng, base, 1))) for k, base in enumerate(bases) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.lsh_partner(docs, bands=24, per_band=1).collect()
    assert all(r["partner"] is not None and r["partner"] // 100 == r["doc_id"] // 100 and r["similarity"] >= 80 for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b c d e f"), (5, "a b c d e f"), (6, "A b c, d e f"), (7, "q r s t u v"), (7, "q r s t u v")]
    got = sorted((tuple(r) for r in minhash.lsh_partner(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(1, None, 0, 1), (2, None, 0, 2), (3, None, 0, 3), (4, 5, 100, 4), (5, 4, 100, 4), (6, 4, 100, 4), (7, None, 0, 7), (7, None, 0, 7)]
    assert minhash.lsh_partner(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    pool = rng.integers(-(1 << 62), 1 << 62, 1500)
    a, b = minhash.signatures([pool[:1000], pool[500:]], 4000, 1)
    assert abs((a == b).mean() - 1 / 3) < 0.03


def test_rounds_follow_the_logarithm_of_a_bucket(spark, monkeypatch):
    """100 unlike texts in the same buckets: one representative a round would take 84 rounds."""
    written = []
    write = minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, label: written.append(label) or write(df, label))
    heads = spark.createDataFrame([(k, [-1, *range(1 + 2 * k, 3 + 2 * k)]) for k in range(100)], "c long, shingles array<long>")
    monkeypatch.setattr(minhash, "_buckets", lambda heads, bands, rows: heads.select("c", F.lit(0).alias("band"), F.lit(0).cast("long").alias("bucket")))
    links, compared = minhash.lsh_links(heads)
    assert links.count() == 0 and compared == 100 * 99 // 2
    assert written.count("minhash-compared") <= 6


def test_exact_partners_are_written_once_and_compared_by_place(spark, monkeypatch):
    """Texts that share only a shingle early in their order have no room for 0.8: none is compared; sets are cut once."""
    written = {}
    write = similarity.materialize

    def kept(df, label):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(similarity, "materialize", kept)
    rng = random.Random(8)
    base = words(rng, 60)
    rows = [(k, " ".join(edited(rng, base, 1))) for k in range(30)] + [(100 + k, " ".join(words(rng, 60))) for k in range(30)]
    got = {r["doc_id"]: r for r in similarity.best_partner(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {"partner-sets", "partner-classes", "partner-prefixes", "partner-scored"} <= set(written)

    def shingles(text):
        ws = text.split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

    sets = {k: shingles(t) for k, t in rows}
    for k in sets:
        links = sum(len(sets[k] & sets[j]) / len(sets[k] | sets[j]) >= 0.8 for j in sets if j != k)
        assert got[k]["n_links"] == links
    assert all(got[k]["partner"] is None for k in range(100, 130)) and written["partner-scored"].count() == sum(r["n_links"] for r in got.values()) // 2
