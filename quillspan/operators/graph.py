"""Link-graph analytics over node and anchor tables.

nodes: (url, word_count, cluster, city, language, ...); anchors: (src, dst,
anchor, nofollow, pos).  Iterations write their small state to the shared
folder each round, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.numbers import half_up
from quillspan.operators.audit import STOP_WORDS
from quillspan.operators.ranks import ranked
from quillspan.operators.similarity import title_groups
from quillspan.workspace import bucketed, few, fresh_path, materialize

# Anchors that say nothing about their target.
GENERIC_ANCHORS = ("cliquez ici", "cliquer ici", "ici", "en savoir plus", "lire la suite", "lire plus", "plus", "voir plus", "read more", "en savoir +", "decouvrir", "voir", "ce lien", "lien", "click here", "")
DAMPING = 0.85
#: Edges or nodes of a bucket that a round of PageRank works on in one task.
BUCKET_ROWS = 100_000


def edges(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct followed links between two different known pages."""
    known = nodes.select(F.col("url").alias("dst")).distinct()
    sources = nodes.select(F.col("url").alias("src")).distinct()
    return anchors.filter(~F.col("nofollow") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct().join(known, "dst", "left_semi").join(sources, "src", "left_semi").select("src", "dst")


def inlinks(nodes: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("inlinks"))
    return nodes.select("url").join(counts, "url", "left").select("url", F.coalesce("inlinks", F.lit(0)).alias("inlinks"))


def pagerank(nodes: DataFrame, links: DataFrame, rounds: int = 50, damping: float = DAMPING, tolerance: float = 1e-7, settle: bool = False) -> DataFrame:
    """(url, raw, pagerank): power iteration, dangling mass spread evenly, stop on an L1 change under the tolerance;
    pagerank is scaled to a maximum of 100 and rounded to one decimal. No nodes: no rows.

    All pages share the L1 change, so on a large graph the tolerance alone says
    little about one of them.  With ``settle`` it stops before ``rounds`` only
    when besides the rounds left, whose changes shrink by the damping, cannot
    carry any page's pagerank over a rounding bound.
    """
    degrees = materialize(links.groupBy("src").agg(F.count("*").alias("degree")), "pr-degrees")
    base = materialize(nodes.select("url").join(degrees.withColumnRenamed("src", "url"), "url", "left").select("url", F.col("degree").isNull().alias("dangling")), "pr-all")
    n, loose = base.agg(F.count("*"), F.count_if("dangling")).first()
    if not n:
        return base.select("url", F.lit(0.0).alias("raw"), F.lit(0.0).alias("pagerank"))
    # edges, nodes and ranks lie in buckets of the page that a round looks them up by; only messages move, from the edges to the nodes
    buckets = _rank_buckets(nodes.sparkSession, max(n, degrees.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]))
    weighted = bucketed(links.join(degrees, "src"), "src", "pr-edges", buckets)
    base = bucketed(base, "url", "pr-nodes", buckets)
    ranks = base.select("url", F.lit(1.0 / n).alias("raw"))
    mass, top = loose / n, 1.0 / n
    for _ in range(rounds):
        start = (1 - damping) / n + damping * mass / n
        nxt = bucketed(_rank_round(weighted, base, ranks, start, damping), "url", "pr-ranks", buckets, lying=True)
        mass, change, top = nxt.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("raw"))), F.lit(0.0)), F.sum(F.abs(F.col("raw") - F.col("old"))), F.max("raw")).first()
        ranks = nxt.select("url", "raw")
        if change < tolerance and (not settle or _settled(ranks, n, top, change * damping / (1 - damping))):
            break
    return materialize(ranks.select("url", "raw", _scaled(top or 1.0).alias("pagerank")), "pr-result")


def _rank_buckets(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows, no more than shuffle partitions: a round of a small graph is a few tasks, not hundreds."""
    return min(-(-rows // BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _scaled(top: float) -> Column:
    return half_up(F.col("raw") / F.lit(top) * 100.0, 1)


def _settled(ranks: DataFrame, n: int, top: float, rest: float) -> bool:
    """Whether no rounded rank changes if every raw rank moves by ``rest`` at most."""
    move = 2000.0 * rest / max(top - rest, 1e-300)  # in tenths, of a rank up to 100
    if rest >= top or move * n > 1:  # some of so many pages will be that near to a bound
        return False
    tenths = F.col("raw") / F.lit(top) * 1000.0 + 0.5
    return ranks.agg(F.min(F.abs(tenths - F.rint(tenths)))).first()[0] > move


def _rank_round(weighted: DataFrame, base: DataFrame, ranks: DataFrame, start: float, damping: float) -> DataFrame:
    """(url, dangling, old, raw) after one round; of the edges only sums per target leave their place, and nothing is sorted."""
    flow = weighted.join(ranks.select(F.col("url").alias("src"), "raw").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("url")).agg(F.sum(F.col("raw") / F.col("degree")).alias("flow"))
    old = base.join(ranks.withColumnRenamed("raw", "old").hint("shuffle_hash"), "url")
    return old.join(flow.hint("shuffle_hash"), "url", "left").select("url", "dangling", "old", (F.lit(start) + F.lit(damping) * F.coalesce("flow", F.lit(0.0))).alias("raw"))


def click_depth(nodes: DataFrame, links: DataFrame, home) -> DataFrame:
    """(url, depth) by breadth-first search; null where the home page does not lead.

    ``home`` is matched without a final slash; when it is unknown the shortest
    (then smallest) URL serves.
    """
    bare = lambda c: F.regexp_replace(c.cast("string"), "/+$", "")
    start = nodes.select("url").filter(bare(F.col("url")) == str(home).rstrip("/"))
    if start.isEmpty():
        start = nodes.select("url").orderBy(F.length(F.col("url").cast("string")), "url").limit(1)
    spark = nodes.sparkSession
    # edges lie in buckets of their source; a level moves its own pages and what they reach
    links = bucketed(links, "src", "bfs-edges")
    # one folder per level below one root: what has been seen is one scan, however deep the search goes
    root = fresh_path(spark, "bfs")
    kind = nodes.select("url").schema
    start.limit(1).write.parquet(f"{root}/depth=0")
    schema = f"{kind.simpleString()[7:-1].replace(':', ' ')}, depth int"
    depth = 0
    while True:
        depth += 1
        seen = spark.read.schema(schema).parquet(root)
        level = spark.read.schema(kind).parquet(f"{root}/depth={depth - 1}")
        _reached(links, level).join(seen.select("url"), "url", "left_anti").write.parquet(f"{root}/depth={depth}")
        if spark.read.schema(kind).parquet(f"{root}/depth={depth}").isEmpty():
            return nodes.select("url").join(spark.read.schema(schema).parquet(root), "url", "left")


def _reached(links: DataFrame, level: DataFrame) -> DataFrame:
    return links.join(level.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()


def metrics(nodes: DataFrame, anchors: DataFrame, home, rounds: int = 50, rank: bool = True, depth: bool = True, settle: bool = False) -> DataFrame:
    """Nodes with inlinks, out-degree over followed links, internal_out over all links and, unless left out, pagerank and depth."""
    e = materialize(edges(nodes, anchors), "graph-edges")
    out = e.groupBy(F.col("src").alias("url")).agg(F.count("*").alias("followed_out"))
    every = anchors.groupBy(F.col("src").alias("url")).agg(F.countDistinct("dst").alias("internal_out"))
    joined = nodes
    parts = [inlinks(nodes, e), out, every]
    if rank:
        parts.append(pagerank(nodes, e, rounds, settle=settle).drop("raw"))
    if depth:
        parts.append(click_depth(nodes, e, home))
    for part in parts:
        joined = joined.join(part, "url", "left")
    return joined.fillna(0, ["inlinks", "followed_out", "internal_out", *(["pagerank"] if rank else [])])


def orphans(m: DataFrame, home) -> DataFrame:
    """(url, orphan, unreachable, deep) of the pages that are at least one of them; the home page never is."""
    away = F.col("url").cast("string") != str(home)
    flags = m.select("url", ((F.col("inlinks") == 0) & away).alias("orphan"), (F.col("depth").isNull() & away).alias("unreachable"), (F.coalesce("depth", F.lit(0)) >= 4).alias("deep"))
    return flags.filter("orphan OR unreachable OR deep")


def node_type(home) -> Column:
    return (
        F.when(F.col("url").cast("string") == str(home), "home").when((F.col("internal_out") == 0) & (F.col("inlinks") >= 2), "sink")
        .when((F.col("internal_out") >= 15) & (F.col("inlinks") >= 1), "hub").when(F.col("inlinks") == 0, "source").otherwise("normal")
    )


def top_linked(m: DataFrame, n: int = 20) -> DataFrame:
    return m.orderBy(F.desc("pagerank"), F.desc("inlinks"), "url").limit(n).select("url", "inlinks", "pagerank", "city")


def sinks(m: DataFrame, home, n: int = 15) -> DataFrame:
    return m.filter(node_type(home) == "sink").orderBy(F.desc("pagerank"), "url").limit(n).select("url", "pagerank")


def generic_anchors(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links to known pages whose anchor is blank or says nothing."""
    known = nodes.select(F.col("url").alias("dst"))
    return anchors.join(known, "dst", "left_semi").filter(T.fold(F.col("anchor")).isin(*GENERIC_ANCHORS))


def over_optimised(nodes: DataFrame, anchors: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """Targets with at least ``least`` links of which one anchor (not blank) makes up ``share``.

    Anchors are counted per (target, anchor) before anything is brought together by target.
    """
    known = nodes.select(F.col("url").alias("dst"))
    counts = anchors.join(known, "dst", "left_semi").groupBy("dst", T.fold(F.col("anchor")).alias("anchor")).agg(F.count("*").alias("n"))
    best = counts.groupBy("dst").agg(F.sum("n").alias("total"), F.max_by("anchor", F.struct("n", "anchor")).alias("top_anchor"), F.max("n").alias("top"))
    ratio = F.col("top") / F.col("total")
    return best.filter((F.col("total") >= least) & (ratio >= share) & (F.col("top_anchor") != "")).select("dst", F.col("top_anchor").alias("anchor"), half_up(ratio * 100.0).cast("int").alias("ratio"), "total")


def clusters(nodes: DataFrame) -> DataFrame:
    """(cluster, pages, cities) of pages that have both a cluster and a city."""
    rows = nodes.filter(F.col("cluster").isNotNull() & (F.coalesce("city", F.lit("")) != ""))
    return rows.groupBy("cluster").agg(F.count("*").alias("pages"), F.sort_array(F.collect_set("city")).alias("cities"))


def silos(nodes: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """Per cluster of at least ``least`` pages: density of links within, and the page that links to most of it."""
    member = nodes.filter(F.col("cluster").isNotNull() & (F.coalesce("city", F.lit("")) != "")).select("url", "cluster")
    sizes = member.groupBy("cluster").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    into = links.join(member.select(F.col("url").alias("dst"), F.col("cluster")), "dst")
    intra = into.join(member.select(F.col("url").alias("src"), F.col("cluster").alias("own")), "src").filter("own = cluster").groupBy("cluster").agg(F.count("*").alias("intra"))
    cover = into.groupBy("cluster", "src").agg(F.count("*").alias("covered"))
    hub = cover.groupBy("cluster").agg(F.max("covered").alias("covered"), F.min_by("src", F.struct(-F.col("covered"), "src")).alias("hub"))
    rows = sizes.join(intra, "cluster", "left").join(hub, "cluster", "left").fillna(0, ["intra", "covered"])
    density = half_up(F.col("intra") / (F.col("pages") * (F.col("pages") - 1)), 3)
    share = F.col("covered") / F.col("pages")
    rows = rows.withColumn("density", density).withColumn("hub", F.when(share >= 0.5, F.col("hub"))).withColumn("hub_coverage", half_up(share * 100.0).cast("int"))
    return rows.select("cluster", "pages", "density", "hub", "hub_coverage", F.when(F.col("density") >= 0.15, "strong").when(F.col("density") >= 0.05, "medium").otherwise("weak").alias("cohesion"))


def cannibalisation(nodes: DataFrame) -> DataFrame:
    """Groups of two or more pages with the same service and city."""
    rows = nodes.filter(F.col("cluster").isNotNull() & (F.coalesce("city", F.lit("")) != ""))
    return rows.groupBy("cluster", "city").agg(F.count("*").alias("pages"), F.min("url").alias("first_url")).filter("pages > 1")


def same_titles(nodes: DataFrame) -> DataFrame:
    """Groups of pages with nearly equal titles (column ``title``), headed by pages that no service and city group holds."""
    held = nodes.filter(F.col("cluster").isNotNull() & (F.coalesce("city", F.lit("")) != "")).join(cannibalisation(nodes).select("cluster", "city"), ["cluster", "city"], "left_semi")
    return title_groups(nodes, [w for words in STOP_WORDS.values() for w in words.split()], held.select("url"))


def targets(m: DataFrame, home) -> DataFrame:
    """Pages that need links: orphans, unreachable, deep, or at most two in-links and 300 words or more."""
    away = m.filter(F.col("url").cast("string") != str(home))
    need = (F.col("inlinks") == 0) | F.col("depth").isNull() | (F.coalesce("depth", F.lit(0)) >= 4) | ((F.col("inlinks") <= 2) & (F.col("word_count") >= 300))
    return away.filter(need)


RELEVANCE = ((1.0, ("cluster", "city")), (0.8, ("cluster",)), (0.5, ("city",)), (0.3, ()))
#: Rows of a list whose running sums one task makes.
SPAN_BITS = 12


def _listed(rows: DataFrame) -> DataFrame:
    """A row for each list that a page is in: ``level`` numbers RELEVANCE, ``key`` has the values shared."""
    key = lambda shared: F.concat_ws("\u0001", *(F.col(c).cast("string") for c in ("language", *shared)))
    known = lambda shared: F.col("language").isNotNull() & (F.col("language") != "") & reduce(lambda a, c: a & F.col(c).isNotNull() & (F.col(c).cast("string") != ""), shared, F.lit(True))
    lists = [F.when(known(shared), F.struct(F.lit(k).alias("level"), key(shared).alias("key"))) for k, (_, shared) in enumerate(RELEVANCE)]
    return rows.withColumn("list", F.explode(F.array_compact(F.array(*lists)))).select("*", "list.level", "list.key").drop("list")


def _sums_before(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` (level, key, pos, ..) with the sums of ``values`` over the rows before each of its list; a task sums a span of places, spans are summed together."""
    spanned = rows.withColumns(values | {"span": F.shiftright("pos", SPAN_BITS)})
    spans = spanned.groupBy("level", "key", "span").agg(*(F.sum(v).alias(f"of_{v}") for v in values))
    earlier = Window.partitionBy("level", "key").orderBy("span")
    spans = spans.select("level", "key", "span", *((F.sum(f"of_{v}").over(earlier) - F.col(f"of_{v}")).alias(f"of_{v}") for v in values))
    within = Window.partitionBy("level", "key", "span").orderBy("pos")
    summed = spanned.withColumns({f"in_{v}": F.sum(v).over(within) - F.col(v) for v in values}).join(spans, ["level", "key", "span"])
    return summed.withColumns({v: F.col(f"in_{v}") + F.col(f"of_{v}") for v in values}).drop("span", *(f"{x}_{v}" for v in values for x in ("in", "of")))


def assign_donors(want: DataFrame, donors: DataFrame, links: DataFrame, per_donor: int = 8) -> DataFrame:
    """(target, donor, level): each target gets one donor, each donor at most ``per_donor`` targets, in rounds.

    want: (url, need, language, cluster, city); donors: (url, strength, and the same three).
    A page is in up to four lists, by what pages of a language share (level, an
    index of RELEVANCE); a target values a donor by strength times relevance.
    In each round every list deals its open places, strongest donors first, to
    its open targets, greatest need first; a target asks for the best place
    dealt to it that is not its own page or one that links to it already, and if
    there is none for the strongest open donor of its language that is neither.
    A donor gives its places to those in greatest need; who got none is dealt to
    again, and of a list only as many open donors are looked up as still ask.
    A donor is asked from four lists at most, so a fourth of the dealt
    places or more are settled a round, and a target stays without only when
    every donor of its language is full, is itself, or links to it.
    """
    t_lists = ranked(_listed(want.withColumn("target", F.col("url"))).select("target", "need", "level", "key"), ["level", "key"], F.desc("need"), F.col("target"), label="suggest")
    d_lists = ranked(_listed(donors.filter(F.col("url").isNotNull()).withColumn("donor", F.col("url"))).select("donor", "strength", "level", "key"), ["level", "key"], F.desc("strength"), F.col("donor"), label="suggest")
    relevance = F.element_at(F.array(*(F.lit(r) for r, _ in RELEVANCE)), F.col("level") + 1)
    widest = len(RELEVANCE) - 1
    taken = links.select(F.col("src").alias("donor"), F.col("dst").alias("target"))
    asking = t_lists.withColumn("p", F.col("pos").cast("long"))  # nobody is served yet
    matched = spent = full = None
    while True:
        asked = asking.groupBy("level", "key").agg(F.count("*").alias("asked"))
        lists = materialize(_reach(asked, full, F.col("asked")), "suggest-lists")
        if matched is not None and lists.isEmpty():
            return matched
        dealt = _places(d_lists, lists, spent, per_donor).filter(F.col("before") < F.col("asked")).withColumn("p", F.explode(F.expr("sequence(before, before + left - 1)")))
        offered = asking.join(dealt.select("level", "key", "p", "donor", "strength"), ["level", "key", "p"]).filter("donor <> target").join(taken, ["donor", "target"], "left_anti")
        offered = materialize(offered.select("target", "need", "donor", "level", (F.col("strength") * relevance).alias("score")), "suggest-offers")
        # no place dealt to them will do: the first of the donors in order that is neither the page nor linked to it
        stuck = materialize(asking.filter(F.col("level") == widest).join(offered.select("target").distinct(), "target", "left_anti").select("target", "need", "level", "key"), "suggest-stuck")
        if not stuck.isEmpty():
            offered = offered.unionByName(_first_fit(stuck, taken, d_lists, spent, full, per_donor))
        best = offered.groupBy("target").agg(F.max("need").alias("need"), F.min_by(F.struct("donor", "level"), F.struct(-F.col("score"), "level", "donor")).alias("b")).select("target", "need", "b.*")
        bids = best.withColumn("n", F.row_number().over(Window.partitionBy("donor").orderBy(F.desc("need"), "target"))).filter(F.col("n") <= per_donor)
        if spent is not None:
            bids = bids.join(spent, "donor", "left").filter(F.col("n") <= F.lit(per_donor) - F.coalesce("spent", F.lit(0)))
        won = materialize(bids.select("target", "donor", "level"), "suggest-won")
        if won.isEmpty():
            return won if matched is None else matched
        matched = materialize(won if matched is None else matched.unionByName(won), "suggest-matched")
        spent = materialize(matched.groupBy("donor").agg(F.count("*").alias("spent")), "suggest-spent")
        gone = few(materialize(spent.filter(F.col("spent") >= per_donor).select("donor"), "suggest-gone"))
        full = materialize(d_lists.join(gone, "donor", "left_semi").groupBy("level", "key").agg(F.count("*").alias("full")), "suggest-full")
        # only who is still without is dealt to again
        asking = materialize(_sums_before(asking.drop("p").join(won.select("target"), "target", "left_anti"), p=F.lit(1).cast("long")), "suggest-asking")


def _reach(lists: DataFrame, full: DataFrame | None, n: Column) -> DataFrame:
    """``lists`` with ``reach``: its first ``n`` open donors are among so many, as ``full`` counts those without a place."""
    if full is None:
        return lists.withColumn("reach", n)
    return lists.join(full, ["level", "key"], "left").withColumn("reach", n + F.coalesce("full", F.lit(0))).drop("full")


def _places(d_lists: DataFrame, lists: DataFrame, spent: DataFrame | None, per_donor: int) -> DataFrame:
    """Open donors among the first ``reach`` of each of ``lists`` (a written table), with the places left, the places before and their number in order."""
    rows = d_lists.join(few(lists), ["level", "key"]).filter(F.col("pos") < F.col("reach")).drop("reach")
    each = F.lit(per_donor).cast("long")
    if spent is None:
        return rows.withColumns({"left": each, "before": F.col("pos") * each, "nth": F.col("pos").cast("long")})
    rows = rows.join(spent, "donor", "left").withColumn("left", each - F.coalesce("spent", F.lit(0))).filter("left > 0").drop("spent")
    return _sums_before(rows, before=F.col("left"), nth=F.lit(1).cast("long"))


def _first_fit(stuck: DataFrame, taken: DataFrame, d_lists: DataFrame, spent: DataFrame | None, full: DataFrame | None, per_donor: int) -> DataFrame:
    """Offers to ``stuck`` pages (target, need, level, key): the first open donor of the list that is neither the page nor linked to it.

    What bars a page are its links and itself, so one donor more than these is as far as it looks.
    """
    linked = stuck.join(taken, "target").select("target", "key", "donor")
    most = linked.groupBy("key", "target").agg(F.count("*").alias("c")).groupBy("key").agg(F.max("c").alias("most"))
    lists = stuck.select("level", "key").distinct().join(most, "key", "left")
    lists = materialize(_reach(lists, full, F.coalesce("most", F.lit(0)) + 2).drop("most"), "suggest-stuck-lists")
    wide = few(materialize(_places(d_lists, lists, spent, per_donor).select("key", "donor", "nth", "strength"), "suggest-wide"))
    barred = linked.unionByName(stuck.select("target", "key", F.col("target").alias("donor"))).distinct().join(wide.drop("strength"), ["key", "donor"])
    run = barred.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("nth")) - 1).filter("nth = n").groupBy("target").agg(F.count("*").alias("skip"))
    found = stuck.join(run, "target", "left").withColumn("nth", F.coalesce("skip", F.lit(0))).join(wide, ["key", "nth"])
    return found.select("target", "need", "donor", "level", (F.col("strength") * RELEVANCE[-1][0]).alias("score"))


def suggestions(m: DataFrame, links: DataFrame, home, per_donor: int = 8, limit: int = 150) -> DataFrame:
    """The donor that each target gets, with impact, reason and priority; the ``limit`` rows of greatest impact.

    Donors are assigned by assign_donors(), targets in order of need (what a
    link would be worth whoever gives it).  A target for which no donor is left,
    or whose language is unknown, takes the home page unless that links it
    already; the home page as the last resort has no budget.
    """
    m, links = materialize(m, "suggest-nodes"), materialize(links.select("src", "dst"), "suggest-links")
    power = F.col("pagerank") / (F.col("followed_out") + 1)
    donors = m.select("url", "cluster", "city", "language", power.alias("power"), (power / (1 + F.coalesce("depth", F.lit(0)) / 3.0)).alias("strength"))
    top_words = m.agg(F.greatest(F.coalesce(F.max("word_count"), F.lit(1)), F.lit(1)).alias("top_words"))
    potential = F.col("word_count") / F.col("top_words") * (1 - F.col("pagerank") / 100.0)
    lonely = (F.col("inlinks") == 0) | F.col("depth").isNull()
    urgency = 1 + F.coalesce("depth", F.lit(0)) / 4.0 + F.when(lonely, 2.0).otherwise(0.0)
    want = materialize(targets(m, home).crossJoin(F.broadcast(top_words)).withColumn("need", potential * urgency).drop("top_words"), "suggest-targets")
    given = assign_donors(want.select("url", "need", "language", "cluster", "city"), donors.select("url", "strength", "language", "cluster", "city"), links, per_donor)
    relevance = F.element_at(F.array(*(F.lit(r) for r, _ in RELEVANCE)), F.col("level") + 1)
    chosen = given.join(donors.select(F.col("url").alias("donor"), "power"), "donor").select("target", "donor", "power", relevance.alias("relevance"))
    first = donors.filter(F.col("url").cast("string") == str(home)).select(F.col("url").alias("donor"), "power", *(F.col(c).alias(f"home_{c}") for c in ("cluster", "city", "language")))
    bare = want.join(given.select(F.col("target").alias("url")), "url", "left_anti").crossJoin(F.broadcast(first))
    bare = bare.join(links.select(F.col("src").alias("donor"), F.col("dst").alias("url")), ["donor", "url"], "left_anti")
    alike = lambda c, r: F.when((F.col(c) == F.col(f"home_{c}")) & (F.col(c) != ""), r).otherwise(0.0)
    to_home = F.when(F.col("language") != F.col("home_language"), 0.0).otherwise(0.3 + alike("cluster", 0.5) + alike("city", 0.2))
    chosen = chosen.unionByName(bare.select(F.col("url").alias("target"), "donor", "power", to_home.alias("relevance")))
    rows = chosen.join(want.withColumnRenamed("url", "target"), "target")
    impact = half_up(F.col("need") * F.col("power") * F.greatest("relevance", F.lit(0.1)) * 100.0, 1)
    reason = F.when(F.col("inlinks") == 0, "orphan").when(F.col("depth").isNull(), "unreachable").when(F.col("depth") >= 4, "deep").otherwise("potential")
    kept = materialize(rows.select("donor", "target", impact.alias("impact"), reason.alias("reason")), "suggest-kept")
    n = kept.count()
    # exact order statistics from counts per value: impacts have one decimal, so values are far fewer than rows
    values = kept.groupBy("impact").agg(F.count("*").alias("c")).withColumn("up_to", F.sum("c").over(Window.orderBy(F.desc("impact"))))
    at = lambda r: F.max(F.when(F.col("up_to") >= r, F.col("impact")))
    cut = values.agg(at(max(1, n // 5) if n > 5 else 1).alias("hi"), at(max(1, n // 2)).alias("mid"))
    return (
        kept.orderBy(F.desc("impact"), "target").limit(limit).crossJoin(F.broadcast(cut))
        .select("donor", "target", "impact", "reason", F.when(F.col("impact") >= F.col("hi"), "high").when(F.col("impact") >= F.col("mid"), "medium").otherwise("low").alias("priority"))
    )


def suggested_anchor(h1: Column, title: Column, city: Column, default: str = "this page") -> Column:
    """The h1 if it has at most 70 characters, else the title before | or -, else the city."""
    short = F.substring(F.trim(F.element_at(F.split(F.coalesce(title, F.lit("")), r"[|-]"), 1)), 1, 70)
    h = F.trim(F.coalesce(h1, F.lit("")))
    return F.when((h != "") & (F.length(h) <= 70), h).when(short != "", short).otherwise(F.coalesce(F.nullif(F.trim(city), F.lit("")), F.lit(default)))


def health(m: DataFrame, nodes: DataFrame, anchors: DataFrame, silo_rows: DataFrame, home) -> DataFrame:
    """Mean of four percentages: at most three clicks deep (home counts), not orphaned, telling anchors, cohesive silos."""
    pct = lambda part, whole: half_up(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))).cast("int")
    depth = m.agg(F.count("*").alias("n"), F.count_if(F.col("depth") <= 3).alias("shallow"), F.count_if((F.col("inlinks") == 0) & (F.col("url").cast("string") != str(home))).alias("orphans"))
    total = anchors.agg(F.count("*").alias("anchors"))
    bad = generic_anchors(nodes, anchors).agg(F.count("*").alias("generic"))
    silo = silo_rows.agg(F.count("*").alias("silos"), F.count_if(F.col("cohesion") != "weak").alias("cohesive"))
    one = depth.crossJoin(total).crossJoin(bad).crossJoin(silo)
    parts = one.select(
        pct(F.col("shallow"), F.col("n")).alias("depth_pct"), pct(F.col("n") - F.col("orphans"), F.col("n")).alias("linked_pct"),
        F.when(F.col("anchors") == 0, 100).otherwise(pct(F.col("anchors") - F.col("generic"), F.col("anchors"))).alias("anchor_pct"),
        F.when(F.col("silos") == 0, 100).otherwise(pct(F.col("cohesive"), F.col("silos"))).alias("silo_pct"),
    )
    score = half_up((F.col("depth_pct") + F.col("linked_pct") + F.col("anchor_pct") + F.col("silo_pct")) / 4.0).cast("int")
    return parts.withColumn("score", score).withColumn("verdict", F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "fair").otherwise("to improve"))


# How many rows of each list a report shows.
CAPS = {"deep": 40, "sinks": 15, "top_linked": 20, "cannibalisation": 60, "generic_anchors": 40, "over_optimised": 20, "suggestions": 150}


def report(nodes: DataFrame, anchors: DataFrame, home, rounds: int = 50) -> dict[str, DataFrame]:
    """The whole linking report: node metrics and types, and the lists cut to their caps in a fixed order; same_titles where nodes have titles."""
    links = materialize(edges(nodes, anchors), "report-edges")
    m = materialize(metrics(nodes, anchors, home, rounds), "report-metrics")
    silo_rows = silos(nodes, links)
    weak = orphans(m, home)
    titles = {"same_titles": same_titles(nodes).orderBy(F.desc("pages"), "first_url").limit(CAPS["cannibalisation"])} if "title" in nodes.columns else {}
    return titles | {
        "pages": m.withColumn("node_type", node_type(home)),
        "orphans": weak.filter("orphan").select("url"),
        "unreachable": weak.filter("unreachable").select("url"),
        "deep": m.filter("depth >= 4").select("url", "depth").orderBy(F.desc("depth"), "url").limit(CAPS["deep"]),
        "sinks": sinks(m, home, CAPS["sinks"]),
        "top_linked": top_linked(m, CAPS["top_linked"]),
        "clusters": clusters(nodes),
        "silos": silo_rows,
        "cannibalisation": cannibalisation(nodes).orderBy(F.desc("pages"), "cluster", "city").limit(CAPS["cannibalisation"]),
        "generic_anchors": generic_anchors(nodes, anchors).orderBy("src", "dst").limit(CAPS["generic_anchors"]),
        "over_optimised": over_optimised(nodes, anchors).orderBy(F.desc("total"), "dst").limit(CAPS["over_optimised"]),
        "suggestions": suggestions(m, links, home, limit=CAPS["suggestions"]),
        "health": health(m, nodes, anchors, silo_rows, home),
    }
