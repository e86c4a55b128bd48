"""Sharding by longest processing time.

Documents with equal texts stay together.  Their groups, sorted by size, go to
the least-loaded shard through a heap.  That sequential rule is kept parallel
in two rounds: groups of at least ``1/LARGE_SHARE`` of an even shard (so at
most ``LARGE_SHARE * shards`` of them) are placed on the driver; all others
are dealt by the hash of their text over buckets of about ``BUCKET_GROUPS``
groups, and each bucket runs the same heap over its own groups, starting from
its share of the loads so far.  A bucket ends within one small group of even,
so the sum over buckets does too.

Null texts weigh like empty ones and are one group with them.  Ids may repeat;
slots number all rows.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.workspace import materialize, table

SHARDS = 24
OVERHEAD = 8
LARGE_SHARE = 200
BUCKET_GROUPS = 20_000
SLOT_ROWS = 50_000


def place(sizes, loads: list[float]) -> list[int]:
    """Shard of each size, taken in the given order; ``loads`` is updated. Ties go to the lower shard."""
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, s = heap[0]
        out.append(s)
        loads[s] = load + size
        heapq.heapreplace(heap, (loads[s], s))
    return out


def _bucket_filler(loads: list[float], buckets: int):
    """Partitions hold whole buckets, sorted by (bucket, size descending, key)."""

    def run(batches):
        current, heap = None, []
        for batch in batches:
            shards = []
            for bucket, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != current:
                    current, heap = bucket, [(load / buckets, (s + bucket) % len(loads), s) for s, load in enumerate(loads)]
                    heapq.heapify(heap)
                load, tie, s = heap[0]
                shards.append(s)
                heapq.heapreplace(heap, (load + size, tie, s))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(shards, pa.int32())], names=["group_key", "shard"])

    return run


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): near-equal bytes per shard, equal texts together, slots gapless from 0."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("group_key"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    n_groups, total, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    threshold = max(1, total // (shards * LARGE_SHARE))
    # at most shards * LARGE_SHARE groups can be this large
    large = groups.filter(F.col("bytes") > threshold).orderBy(F.desc("bytes"), "group_key").select("group_key", "bytes").collect()
    loads = [0.0] * shards
    placed = place([r["bytes"] for r in large], loads)
    spark = docs.sparkSession
    first = spark.createDataFrame([(bytes(r["group_key"]), s) for r, s in zip(large, placed)], "group_key binary, shard int")
    buckets = max(1, -(-n_groups // bucket_groups))
    small = (
        groups.filter(F.col("bytes") <= threshold)
        .select(F.pmod(F.xxhash64("group_key"), F.lit(buckets)).cast("int").alias("bucket"), F.col("bytes"), "group_key")
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", F.desc("bytes"), "group_key")
        .select("bucket", "bytes", "group_key")
        .mapInArrow(_bucket_filler(loads, buckets), "group_key binary, shard int")
    )
    # the few large groups are broadcast: a text that a third of all rows share stays where its rows are
    first = F.broadcast(first)
    held = rows.join(first, "group_key").unionByName(rows.join(first, "group_key", "left_anti").join(small, "group_key"))
    placed_rows = materialize(held.select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    # slots: a salt by id splits every shard, however many of its rows are copies of one text
    salts = max(1, -(-n_rows // SLOT_ROWS))
    salted = placed_rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size")
    return (
        salted.withColumn("rank", F.row_number().over(rank))
        .join(offsets, ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))
    )


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents under the law of near-equal bytes."""
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
