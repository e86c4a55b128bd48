"""Places of rows in large groups, found by ranges instead of one sort per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.workspace import materialize


def ranked(rows: DataFrame, group: list[str], *order: Column, label: str = "ranks") -> DataFrame:
    """``rows`` with ``pos``, from 0, their place by ``order`` among the rows of their group; null is a group of its own.

    Ranges of all groups together are sorted apart and the rows before each are
    counted, so one group that holds most rows is many tasks.  ``order`` should
    tell rows of a group apart; rows that it does not are in any order.
    """
    ranged = materialize(rows.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()), f"{label}-ranges")
    own = ranged.withColumn("own", F.row_number().over(Window.partitionBy("part", *group).orderBy(*order)))
    counts = ranged.groupBy(*group, "part").agg(F.count("*").alias("c"))
    starts = counts.withColumn("start", F.sum("c").over(Window.partitionBy(*group).orderBy("part")) - F.col("c"))
    starts = starts.select(*(F.col(g).alias(f"of_{g}") for g in group), F.col("part").alias("of_part"), "start")
    same = reduce(lambda a, g: a & own[g].eqNullSafe(starts[f"of_{g}"]), group, own["part"] == starts["of_part"])
    return materialize(own.join(starts, same).withColumn("pos", F.col("start") + F.col("own") - 1).select(*rows.columns, "pos"), f"{label}-order")
