"""Rounds of PageRank and of the search for depths leave the edges where they lie, and give what a plain loop gives."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import graph as G
from quillspan.workspace import bucketed, materialize


def case(seed, n=60, m=220):
    rng = random.Random(seed)
    return list(range(n)), sorted({(rng.randrange(n), rng.randrange(n - 10)) for _ in range(m)} - {(k, k) for k in range(n)})


def frames(spark, nodes, links):
    return spark.createDataFrame([(k,) for k in nodes], "url long"), spark.createDataFrame(links, "src long, dst long")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def executed(df):
    """Lines of the plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def test_a_round_shuffles_ranks_and_sums_but_no_edges(spark, no_broadcast):
    nodes, links = frames(spark, *case(1))
    degrees = links.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = bucketed(links.join(degrees, "src"), "src", "t-edges")
    base = bucketed(nodes.withColumn("dangling", F.lit(False)), "url", "t-nodes")
    ranks = materialize(base.select("url", F.lit(1 / 60).alias("raw")), "t-ranks")
    lines = executed(G._rank_round(weighted, base, ranks, 0.1, 0.85))
    assert sum("Bucketed: true" in x for x in lines if "FileScan" in x) == 2
    # above the scan of the edges the first shuffle is that of partial sums by target
    edge = next(i for i, x in enumerate(lines) if "FileScan" in x and "degree#" in x)
    above = next(x for x in reversed(lines[:edge]) if "Exchange" in x or "Join" in x)
    assert "Join" in above


def test_a_level_shuffles_no_edges(spark, no_broadcast):
    nodes, links = frames(spark, *case(2))
    held = bucketed(links, "src", "t-bfs")
    level = materialize(nodes.filter("url < 3"), "t-level")
    lines = executed(G._reached(held, level))
    edge = next(i for i, x in enumerate(lines) if "FileScan" in x and "dst#" in x)
    above = next(x for x in reversed(lines[:edge]) if "Exchange" in x or "Join" in x)
    assert "Bucketed: true" in lines[edge] and "Join" in above


@pytest.mark.parametrize("seed", [1, 2])
def test_results_without_broadcasts(spark, no_broadcast, seed):
    nodes, links = case(seed)
    frame, edges = frames(spark, nodes, links)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    out = {k: [d for s, d in links if s == k] for k in nodes}
    for _ in range(50):
        loose = sum(rank[k] for k in nodes if not out[k])
        new = {k: 0.15 / len(nodes) + 0.85 * (loose / len(nodes) + sum(rank[s] / len(out[s]) for s, d in links if d == k)) for k in nodes}
        change, rank = sum(abs(new[k] - rank[k]) for k in nodes), new
        if change < 1e-7:
            break
    got = {r["url"]: r["raw"] for r in G.pagerank(frame, edges).collect()}
    assert all(abs(got[k] - rank[k]) < 1e-9 for k in nodes)
    depth, level = {0: 0}, [0]
    while level:
        level = sorted({d for s in level for d in out[s]} - depth.keys())
        depth |= {k: max(depth.values()) + 1 for k in level}
    assert {r["url"]: r["depth"] for r in G.click_depth(frame, edges, 0).collect()} == {k: depth.get(k) for k in nodes}


def test_settled_ranks_round_as_after_all_rounds(spark):
    """A loose tolerance stops early; settled ranks round as those of all rounds do."""
    nodes, links = frames(spark, *case(3))
    rounded = lambda **how: {r["url"]: r["pagerank"] for r in G.pagerank(nodes, links, 40, **how).collect()}
    every = rounded(tolerance=0.0)
    assert rounded(tolerance=0.05) != every
    assert rounded(tolerance=0.05, settle=True) == every


def test_buckets_follow_the_graph_and_ranks_lie_in_them(spark, no_broadcast, monkeypatch):
    """A small graph is one bucket whatever the shuffle partitions; with several buckets a round moves no ranks."""
    made = []
    write = G.bucketed
    monkeypatch.setattr(G, "bucketed", lambda df, column, label, n=None, **how: made.append((label, n, write(df, column, label, n, **how))) or made[-1][2])
    nodes, links = frames(spark, *case(4))
    whole = {r["url"]: r["raw"] for r in G.pagerank(nodes, links, 3).collect()}
    assert {n for _, n, _ in made} == {1}
    made.clear()
    monkeypatch.setattr(G, "BUCKET_ROWS", 70)
    cut = {r["url"]: r["raw"] for r in G.pagerank(nodes, links, 3).collect()}
    assert all(abs(cut[k] - whole[k]) < 1e-12 for k in whole) and len(cut) == 60
    assert {n for _, n, _ in made} == {-(-links.count() // 70)}
    table = {label: df for label, _, df in made}
    lines = executed(G._rank_round(table["pr-edges"], table["pr-nodes"], table["pr-ranks"].select("url", "raw"), 0.1, 0.85))
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "raw#" in x)
    assert sum("Bucketed: true" in x for x in lines if "FileScan" in x) >= 3 and "Join" in next(x for x in reversed(lines[:scan]) if "Exchange" in x or "Join" in x)
