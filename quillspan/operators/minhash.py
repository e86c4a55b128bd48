"""Near-equal texts by MinHash signatures in banded buckets.

A signature has ``bands`` x ``rows`` minima of hashed shingles; texts that agree
in all minima of a band share a bucket.  A bucket is not joined with itself:
every round its members meet its representatives (the members first in an order
of hashes that all buckets use, so that the buckets of one cluster mostly agree
on them), and whole shingle sets decide.  Who is near enough to one is linked to
it and leaves the bucket, the rest choose again; buckets of at most ``SMALL``
members are settled by all their pairs.  So a cluster of m near copies makes
about m compared pairs a band instead of m squared.  The first round has one
representative a bucket and each later one ``MORE`` times as many, so rounds
follow the logarithm of a bucket whose members are unlike, not its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.numbers import half_up
from quillspan.workspace import materialize

#: 16 bands of 5: a pair at 0.8 shares a bucket with a chance of 0.998, one at 0.5 with 0.40, one at 0.3 with 0.04.
BANDS, ROWS = 16, 5
SMALL = 16
#: Factor by which a bucket's representatives grow from round to round.
MORE = 4
_PRIME = (1 << 31) - 1


def signatures(shingles: list[np.ndarray], bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """Bucket numbers (sets x bands) of sets of 64-bit shingle hashes."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, _PRIME, (2, bands * rows), np.uint64)
    mix = rng.integers(1, 1 << 62, rows, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(shingles), bands), np.int64)
    for i, s in enumerate(shingles):
        x = np.asarray(s).astype(np.int64).view(np.uint64)
        x = (x ^ (x >> np.uint64(32))) % np.uint64(_PRIME)
        low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(x), 4096):
            low = np.minimum(low, ((x[k : k + 4096, None] * a + b) % np.uint64(_PRIME)).min(axis=0))
        out[i] = ((low.reshape(bands, rows) + np.uint64(1)) * mix).sum(axis=1).view(np.int64)
    return out


def _buckets(heads: DataFrame, bands: int, rows: int) -> DataFrame:
    """(c, band, bucket) of each class (c, shingles)."""

    def work(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column("shingles")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            numbers = signatures([values[a:b] for a, b in zip(offsets, offsets[1:])], bands, rows)
            ids = batch.column("c").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))), pa.array(numbers.ravel())], ["c", "band", "bucket"])

    return heads.select("c", "shingles").mapInArrow(work, "c long, band int, bucket long")


def lsh_links(heads: DataFrame, least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, int]:
    """((a, b, jaccard) of compared classes at ``least`` or more, how many pairs were compared); heads: (c, shingles), sets not empty."""
    sets = heads.select("c", "shingles", F.size("shingles").alias("n"))
    cell = ["band", "bucket"]
    held = _buckets(heads, bands, rows)
    crowded = lambda df: df.join(df.groupBy(*cell).agg(F.count("*").alias("members")).filter("members > 1"), cell)
    open_ = materialize(crowded(materialize(held, "minhash-buckets")), "minhash-open")
    scored, compared, many_first = None, 0, 1

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs if scored is None else pairs.join(scored.select("a", "b"), ["a", "b"], "left_anti")
        left, right = sets.select(F.col("c").alias("a"), F.col("shingles").alias("s"), F.col("n").alias("m")), sets.select(F.col("c").alias("b"), F.col("shingles").alias("t"), "n")
        return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", F.when((F.col("m") >= F.col("n") * least) & (F.col("n") >= F.col("m") * least), T.jaccard(F.col("s"), F.col("t"))).otherwise(0.0).alias("jaccard")), "minhash-compared")

    by_hash = Window.partitionBy(*cell).orderBy(F.xxhash64("c"), "c")
    while not open_.isEmpty():
        few = open_.filter(F.col("members") <= SMALL).select("c", *cell)
        many = open_.filter(F.col("members") > SMALL).select("c", *cell)
        first = many.withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= many_first).select(F.col("c").alias("first"), *cell)
        met = materialize(many.join(first, cell), "minhash-met")
        pairs = few.join(few.withColumnRenamed("c", "d"), cell).filter("c < d").select(F.col("c").alias("a"), F.col("d").alias("b"))
        pairs = pairs.unionByName(met.filter("c <> first").select(F.least("c", "first").alias("a"), F.greatest("c", "first").alias("b"))).distinct()
        new = verified(pairs)
        compared += new.count()
        scored = new if scored is None else scored.unionByName(new)
        near = scored.filter(F.col("jaccard") >= least)
        linked = near.select(F.col("a").alias("c"), F.col("b").alias("first")).unionByName(near.select(F.col("b").alias("c"), F.col("a").alias("first")))
        # representatives have met all others of their bucket; who is linked to one leaves it too
        gone = met.join(linked, ["c", "first"], "left_semi").unionByName(met.filter("c = first")).select("c", *cell).distinct()
        open_ = materialize(crowded(many.join(gone, ["c", *cell], "left_anti")), "minhash-open")
        many_first *= MORE
    return (heads.sparkSession.createDataFrame([], "a long, b long, jaccard double") if scored is None else scored.filter(F.col("jaccard") >= least)), compared


def lsh_partner(rows: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, least: float = 0.8, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(key, partner, similarity %, class_id): for each text the one most like it of those it was compared with.

    The approximate, linear form of ``similarity.best_partner``: a text with a
    partner at ``least`` is found with a chance of 1 - (1 - s^rows)^bands, and
    what is found has its exact similarity.  Equal shingle sets are one class
    (similarity 100 with its smallest other member); ``class_id`` is its
    smallest key.  Texts too short for shingles, and null texts, have no
    partner.  ``key`` is a whole number; rows of one key are one text.
    """
    sets = materialize(rows.select(F.col(key).cast("long").alias("key"), F.sort_array(T.shingles(F.col(text), n)).alias("shingles")).withColumn("digest", F.when(F.size("shingles") > 0, F.xxhash64("shingles"))), "minhash-sets")
    classed = sets.filter("digest IS NOT NULL")
    copies = materialize(classed.groupBy("digest").agg(F.min("key").alias("c"), F.min_by("shingles", "key").alias("shingles"), F.countDistinct("key").alias("members")), "minhash-classes")
    second = classed.join(copies.filter("members > 1").select("digest", "c"), "digest").filter("key <> c").groupBy("digest").agg(F.min("key").alias("second"))
    links, _ = lsh_links(copies.select("c", "shingles"), least, bands, per_band)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    best = both.groupBy(F.col("a").alias("c")).agg(F.min_by(F.struct(F.col("b").alias("partner"), "jaccard"), F.struct(-F.col("jaccard"), F.col("b"))).alias("x")).select("c", "x.*")
    verdict = copies.select("digest", "c").join(second, "digest", "left").join(best, "c", "left")
    found = sets.select("key", "digest").join(verdict, "digest", "left")
    own = F.when(F.col("second").isNotNull(), F.when(F.col("key") == F.col("c"), F.col("second")).otherwise(F.col("c"))).otherwise(F.col("partner"))
    similarity = F.when(F.col("second").isNotNull(), 100).otherwise(half_up(F.coalesce("jaccard", F.lit(0.0)) * 100.0)).cast("int")
    return found.select(F.col("key").alias(key), own.alias("partner"), similarity.alias("similarity"), F.coalesce("c", "key").alias("class_id"))
