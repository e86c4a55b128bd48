"""Near-duplicate stage of the pipeline against brute-force Jaccard."""

import random

import pytest

from .helpers import frame, jaccard_groups, odd_texts, prose


def edited(text, rng, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("boilerplate", ["", " this line stands in every single text of this table and means nothing at all"])
def test_stage_joins_edited_copies(spark, boilerplate):
    import corpus_pipeline

    rng = random.Random(11)
    base = [prose(s, 200) for s in range(12)]
    texts = [edited(t, rng, n) + boilerplate for t in base for n in (0, 1, 2, 3, 4, 5, 6, 8)] + odd_texts()
    hot = prose(99, 150)
    texts += [edited(hot, rng, rng.randrange(1, 6)) for _ in range(60)]
    want = jaccard_groups(texts)
    assert 12 < len(set(want)) < len(texts) - 60
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, texts), "").collect()}
    assert got == set(want)


def test_small_chunks_and_nulls_and_equal_ids(spark, monkeypatch):
    """Clusters and shards cut into chunks; one id with two texts, equal rows, and rows without an id."""
    from quillspan.llm import simhash_dedup

    monkeypatch.setattr(simhash_dedup, "CLUSTER_SHINGLES", 700)
    rng = random.Random(5)
    hot = prose(99, 100)
    texts = [edited(hot, rng, rng.randrange(1, 7)) for _ in range(60)] + [edited(prose(7, 120), rng, 2) for _ in range(10)]
    rows = list(enumerate(texts)) + [(3, prose(50, 80)), (3, prose(50, 80)), (None, hot), (None, hot), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for g, i in zip(jaccard_groups(texts), range(len(texts))) if g == i}
    kept = [tuple(r) for r in simhash_dedup.keep_one(docs).collect()]
    assert sorted(i for i, t in kept if i is not None and t != prose(50, 80)) == sorted(want)
    assert kept.count((3, prose(50, 80))) == 1 and kept.count((None, hot)) == 2


def test_stage_on_the_tables(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = {rows[g]["doc_id"] for g in jaccard_groups([r["text"] for r in rows])}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == want


@pytest.mark.parametrize("rounds", [1, 3])
def test_large_clusters_make_rows_in_proportion(spark, monkeypatch, rounds):
    """Near copies in many chunks: only those that no hub takes are dealt to every chunk, and the groups are those of brute force."""
    from pyspark.sql import functions as F

    from quillspan.llm import simhash_dedup

    monkeypatch.setattr(simhash_dedup, "CLUSTER_SHINGLES", 3_000)
    monkeypatch.setattr(simhash_dedup, "RETIRE_ROUNDS", rounds)
    rng = random.Random(15)
    hot = prose(98, 60)
    texts = [edited(hot, rng, 1) for _ in range(300)] + [edited(hot, rng, rng.randrange(2, 9)) for _ in range(80)]
    rows = []
    real = simhash_dedup._large_cluster_links

    def watched(held, sizes, *args):
        rows.append((held.count(), sizes.agg(F.max("chunks")).first()[0]))
        return real(held, sizes, *args)

    monkeypatch.setattr(simhash_dedup, "_large_cluster_links", watched)
    docs = frame(spark, texts)
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(docs).collect()}
    assert kept == {i for i, g in enumerate(jaccard_groups(texts)) if i == g}
    assert rows and rows[0][0] > 250 and rows[0][1] > 5  # one large cluster of several chunks


def test_members_near_a_hub_retire(spark):
    from quillspan.llm import simhash_dedup

    rng = random.Random(3)
    sets = [(k, 1, 40, 0, sorted({*range(40)} - {rng.randrange(40)} | {1000 + k})) for k in range(50)] + [(100 + k, 1, 40, 0, [5000 + 50 * k + j for j in range(40)]) for k in range(5)]
    held = spark.createDataFrame(sets, "node long, root long, n int, fp long, shingles array<int>")
    got = simhash_dedup._near_hubs(held, 0.8).collect()
    assert len(got) == 49 and len({r["u"] for r in got}) == 49 and len({r["v"] for r in got}) == 1 and all(r["u"] < 100 and r["v"] < 100 for r in got)
