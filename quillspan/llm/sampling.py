"""Bounded samples by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARE = 3


def smallest_hashes(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows of smallest hash of ``key``; reads ``df`` twice, so hand in a written table.

    The count first bounds the hash, so that each task hands the driver only
    its part of about ``SPARE * rows`` candidates and not ``rows`` of its own.
    """
    hashed = df.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 1))
    n = df.count()
    if n > SPARE * rows:
        near = hashed.filter(F.col("_u") < int(2**63 * (SPARE * rows / n)))
        # few ids with many rows each could leave too little below the bound
        hashed = near if near.count() >= rows else hashed
    return hashed.orderBy("_u", key).limit(rows).drop("_u")
