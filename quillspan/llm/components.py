"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations to the smallest neighbour and two joins, so a
node with very many neighbours is one row per task before the shuffle, and the
join splits its partition.  Rounds grow with the logarithm of the component
size; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.workspace import materialize


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """``neighbours`` holds (u, v) seen from u; joins each node's minimum to its larger (or smaller) neighbours."""
    smallest = neighbours.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("k", "m").alias("m"))
    side = neighbours.filter("v > u" if large else "v < u").join(smallest, F.col("u") == F.col("k"))
    linked = side.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(smallest.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node reachable. Null ends are dropped."""
    now = materialize(edges.select("u", "v").filter("u <> v").distinct(), "cc-edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both, True), "cc-large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = materialize(_star(down, False), "cc-small")
        state = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
