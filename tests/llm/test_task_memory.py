"""What tasks keep in memory while they count shingles, and how much of a table reaches them at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspan import workspace
from quillspan.llm import decontaminate, docstats, quality_rules, shingles, simhash_dedup


def test_counted_like_unique():
    rng = np.random.default_rng(1)
    for n, kinds in ((0, 1), (1, 1), (2, 1), (3, 1), (50, 5), (5000, 2000)):
        h = rng.integers(-kinds, kinds, n)
        values, times = np.unique(h, return_counts=True)
        for least in (1, 2, 3):
            got = shingles.counted(h.copy(), least)
            assert [x.tolist() for x in got] == [values[times >= least].tolist(), times[times >= least].tolist()]


def test_texts_of_a_batch_in_pieces():
    column = pa.array(["a", None, "é"] * 300).slice(1)
    assert list(docstats.each_text(column)) == docstats.texts_as_bytes(column)


def test_a_run_is_held_once(monkeypatch):
    monkeypatch.setattr(shingles, "_RUN", 1 << 19)
    texts = pa.array([" ".join(f"w{(k * 7919 + j * j) % 5003}" for j in range(4000)) for k in range(150)])
    tracemalloc.start()
    found = list(shingles._counter(5, 3)([pa.RecordBatch.from_arrays([texts], names=["text"])]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found
    held = 8 * shingles._RUN
    assert peak < held + 12_000_000, peak


def test_texts_reach_python_in_bounded_batches(spark, monkeypatch):
    """3,000 texts of 4 KB in one partition: 12 MB, far fewer rows than Spark puts into a batch."""

    def sizes(columns):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (b.num_rows, b.nbytes, *[0] * (columns - 2))], names=names[:columns])

        return run

    names = quality_rules.STATS_DDL.replace(" long", "").split(", ")
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 820).alias("text"))
    monkeypatch.setattr(quality_rules, "_measure", sizes(len(names)))
    monkeypatch.setattr(simhash_dedup, "_fingerprints", lambda width: lambda batches: (b.rename_columns(["doc_id", "fp"]) for b in sizes(2)(batches)))
    try:
        for bound in (None, 1 << 20):  # the second is the session's own, which holds
            spark.conf.unset(workspace.BATCH_BOUND)
            if bound:
                spark.conf.set(workspace.BATCH_BOUND, str(bound))
            for build in (quality_rules.rule_table, simhash_dedup.fingerprint_table):
                rows = [tuple(r)[:2] for r in build(docs).collect()]
                assert sum(n for n, _ in rows) == 3000
                assert max(size for _, size in rows) <= 1.1 * (bound or workspace.BATCH_BYTES)
    finally:
        spark.conf.unset(workspace.BATCH_BOUND)


def test_filters_bound_their_batches(spark):
    """keep, keep_one and drop_leaks hand whole rows to Python; what they keep does not hang on how rows are cut."""
    docs = spark.createDataFrame([(k, " ".join(f"w{(k // 2 * 31 + j * j) % 97}" for j in range(80))) for k in range(40)], "doc_id long, text string").coalesce(1)
    items = docs.filter("doc_id = 7").select(F.col("doc_id").alias("item_id"), "text")
    for work in (quality_rules.keep, simhash_dedup.keep_one, lambda d: decontaminate.drop_leaks(d, items)):
        kept = []
        for bound in ("2k", None):
            spark.conf.unset(workspace.BATCH_BOUND)
            if bound:
                spark.conf.set(workspace.BATCH_BOUND, bound)
            kept.append(sorted(r["doc_id"] for r in work(docs).collect()))
            assert workspace.BATCH_BOUND in spark.conf.getAll
        assert kept[0] == kept[1]
    spark.conf.unset(workspace.BATCH_BOUND)
