"""SimHash near-duplicates through BK-trees.

Each text becomes a 64-bit fingerprint of its word shingles.  A shard's
fingerprints go into a BK-tree (children keyed by their Hamming distance to the
parent) and queries follow only the edges within the radius.  Two ways:

``near_duplicates`` links fingerprints at most ``radius`` bits apart.  Of
``radius + 2`` bit blocks at least two agree, so the shards (two blocks, their
values) hold every pair.  Equal fingerprints collapse to one node.

``similar_texts`` links texts whose shingle sets have a Jaccard of ``least`` or
more; the fingerprints choose the candidates and the whole sets decide.  A pair
at 0.8 differs in 9.7 of 64 bits on average, far too many for bit blocks, so
shards are made of the rarest shingles of each set (see ``shingles``): every
pair shares one.

1. Each set meets the closest of the hubs of its shards, one drawn per shard.
   Sets within ``LOOSE`` bits of a hub form loose clusters; nothing is decided yet.
2. Each cluster's sets go into BK-trees once; pairs within ``WIDE`` bits that are
   not yet in one group are compared on the spot, and only a spanning forest of
   the links leaves the task.  So a large group of copies, similar or not quite,
   is compared where it lies and never becomes rows of pairs.  Clusters too large
   for one task meet hubs first; who is near one retires, and only the others are
   dealt to every chunk.
3. Shards that hold several clusters go into BK-trees of fingerprints; pairs
   within ``WIDE`` bits of different clusters are few, and are verified by joins.

The trees of all shards together grow with the corpus, so they are not
broadcast: a shard's tree is built in the task that its queries are shuffled
to.  Shards of more than ``CHUNK`` fingerprints are cut into chunks, and the
tree of each chunk meets the queries of every other chunk in a task of its own.
Components come from star contraction.

Null and empty texts have fingerprint zero and link like any other.  Rows
without an id have a component and are never its name; ``keep_one`` leaves them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.docstats import texts_as_bytes
from quillspan.llm.shingles import common_shingles, node_of, rarest, sets_of
from quillspan.workspace import few, in_batches, materialize, table

SEED = 42
SHINGLE = 3
RADIUS = 2
CHUNK = 2_000
#: Similarity, shingle width and candidate radius of similar_texts(); 20 bits are 3.5 standard deviations from the mean at 0.8.
LEAST = 0.8
WIDE_SHINGLE = 5
WIDE = 20
LOOSE = 16
HUB_ROUNDS = 2
#: Rounds in which members of large clusters meet a hub before they are dealt, and clusters whose hubs may be broadcast with their sets.
RETIRE_ROUNDS = 3
HUB_SETS = 5_000
#: Shingles in one chunk of a cluster.
CLUSTER_SHINGLES = 200_000
_PIECE = 1 << 16


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < width:
        return digest(joined, SEED)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*(s - 1 for s in starts[width:]), len(joined)]
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n - width + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _PIECE):
        piece = hashes[k : k + _PIECE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in texts_as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _fingerprints(width), "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                break
            at = nxt
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values at most ``radius`` away."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            own = children[at]
            if own:
                for e in range(d - radius, d + radius + 1):
                    if e in own:
                        todo.append(own[e])
        return found


def forest(left: list[int], right: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``left`` (when ``right`` is empty) or between the two lists."""
    tree = BKTree()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []

    def join(a: int, b: int) -> None:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            edges.append((a, b))

    for x in left:
        if not right:
            for k in tree.within(x, radius):
                join(x, tree.values[k])
        tree.add(x)
    for x in right:
        for k in tree.within(x, radius):
            join(x, tree.values[k])
    return edges


def _linker(radius: int):
    mask = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches):
        key, left, right = None, [], []
        out: list[tuple[int, int]] = []

        def close():
            # a cell (a, a) links a chunk within itself, a cell (a, b) only across
            if key is not None and (len(left) > 1 or right):
                out.extend(forest(left, right, radius) if left else [])

        def flush():
            u, v = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([signed(x) for x in u], pa.int64()), pa.array([signed(x) for x in v], pa.int64())], names=["u", "v"])

        for batch in batches:
            for block, value, a, b, own, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, value, a, b) != key:
                    close()
                    key, left, right = (block, value, a, b), [], []
                (left if own == a else right).append(fp & mask)
            if len(out) > 50_000:
                yield flush()
                out.clear()
        close()
        yield flush()

    return run


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): spanning edges between distinct fingerprints at most ``radius`` bits apart."""
    n = radius + 2
    bounds = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(F.shiftleft("fp", 64 - hi), 64 - hi + lo) for lo, hi in zip(bounds, bounds[1:])]
    # at most `radius` blocks differ, so two agree: with radius 2 a shard has 32 of 64 bits in common
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftleft(part[x], bounds[y + 1] - bounds[y]).bitwiseOR(part[y]).alias("value")) for i, (x, y) in enumerate(combinations(range(n), 2))))
    keyed = fps.select("fp", F.explode(blocks).alias("k")).select("fp", "k.block", "k.value")
    # shards of one fingerprint can link nothing
    shards = keyed.groupBy("block", "value").agg(F.count("*").alias("size")).filter("size > 1")
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = (
        keyed.join(shards, ["block", "value"])
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("block", "value", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("block", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")
    )
    cell = ["block", "value", "a", "b"]
    return cells.repartition(*cell).sortWithinPartitions(*cell, "fp").mapInArrow(_linker(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable over links."""
    marked = materialize(fingerprint_table(docs, id_col, text_col, width), "simhash")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    labelled = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _fingerprint_of(shingles: np.ndarray) -> int:
    """Signed fingerprint of a set of hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingles), _PIECE):
        piece = shingles[k : k + _PIECE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def _marker(shared, width: int, least: float):
    """(doc_id, text_hash, node, n, fp, prefix); the prefix of a set that the task has met before is null."""

    def run(batches):
        common, seen = shared.value, set()
        for batch in batches:
            nodes, sizes, fps, prefixes = [], [], [], []
            for s in sets_of(batch.column(2), width):
                node = node_of(s)
                nodes.append(node), sizes.append(len(s)), fps.append(_fingerprint_of(s) if len(s) else 0)
                prefixes.append(None if node in seen else rarest(s, common, least))
                seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "n", "fp", "prefix"],
            )

    return run


def _shared_only(batches):
    """Rows (h, node), sorted: those of shingles that two different nodes hold, each once."""
    last_h, last_node, held = None, None, False  # held: the last row waits for a second node
    for batch in batches:
        h, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.append((h[:1] != last_h) | (node[:1] != last_node) if last_h is not None else np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        h, node = h[fresh], node[fresh]
        if not len(h):
            continue
        if held:
            h, node = np.append(last_h, h), np.append(last_node, node)
        same = h[1:] == h[:-1]
        with_last = not held and last_h is not None and h[0] == last_h
        out = np.append(with_last, same) | np.append(same, False)
        last_h, last_node, held = h[-1], node[-1], not out[-1]
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(node[out])], names=["h", "node"])


def _whole_sets(width: int):
    """(node, shingles); 32 bits of each hash, of which 400 x 400 agree by chance once in 27,000 pairs."""

    def run(batches):
        seen = set()
        for batch in batches:
            new = {}
            for s in sets_of(batch.column(0), width):
                if (node := node_of(s)) not in seen:
                    seen.add(node)
                    new[node] = np.unique((s & 0xFFFFFFFF).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.list_(pa.int32()))], names=["node", "shingles"])

    return run


def _sets(nodes: DataFrame, rows: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """(node, n, fp, shingles) of the given nodes; their texts are read again."""
    held = materialize(nodes.join(heads.select("node", "text_hash"), "node").select("text_hash").distinct(), "similar-held")
    texts = rows.join(few(held), "text_hash", "left_semi").select("text")
    sets = in_batches(texts, _whole_sets(width), "node long, shingles array<int>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return materialize(sets.join(heads.select("node", "n", "fp"), "node"), "similar-sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have a Jaccard of at least ``least``."""
    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("us")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("vs"))
    shared = F.size(F.array_intersect("us", "vs"))
    scored = pairs.join(left, "u").join(right, "v").select("u", "v", shared.alias("shared"), (F.size("us") + F.size("vs")).alias("both"))
    return scored.filter(F.col("shared") / (F.col("both") - F.col("shared")) >= least - 1e-12).select("u", "v")


def _cluster_linker(radius: int, least: float):
    """Per cell (cluster, a, b): spanning forest of the verified links within chunk a, or between chunks a and b."""

    def linked(left, right):
        tree, entries, parent, edges = BKTree(), {}, {}, []

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def ask(fp, node, own):
            n = len(own)
            for k in tree.within(fp, radius):
                for other, theirs in entries[tree.values[k]]:
                    m = len(theirs)
                    if n < m * least - 1e-9 or m < n * least - 1e-9 or root(node) == root(other):
                        continue
                    shared = len(own & theirs)
                    if shared / (n + m - shared) >= least - 1e-12:
                        parent[root(node)] = root(other)
                        edges.append((node, other))

        def add(fp, node, own):
            if fp not in entries:
                tree.add(fp)
            entries.setdefault(fp, []).append((node, own))

        for x in left:
            if not right:
                ask(*x)
            add(*x)
        for x in right:
            ask(*x)
        return edges

    def run(batches):
        key, left, right, out = None, [], [], []

        def flush():
            found = pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
            out.clear()
            return found

        for batch in batches:
            shingles = batch.column(6)
            offsets, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            for i, (cluster, a, b, own, fp, node) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)))):
                if (cluster, a, b) != key:
                    # a cell (a, b) links only across
                    if key is not None and (key[1] == key[2] or (left and right)):
                        out.extend(linked(left, right))
                    key, left, right = (cluster, a, b), [], []
                (left if own == a else right).append((fp & (1 << 64) - 1, node, set(values[offsets[i] : offsets[i + 1]].tolist())))
            if len(out) > 50_000:
                yield flush()
        if key is not None and (key[1] == key[2] or (left and right)):
            out.extend(linked(left, right))
        yield flush()

    return run


def _group_linker(radius: int, least: float):
    """Per cell (cluster, chunk): verified links from the asking members to those of the chunk that are not in one group with them yet."""

    def run(batches):
        key, tree, entries, parent, out = None, BKTree(), {}, {}, []

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def flush():
            found = pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
            out.clear()
            return found

        for batch in batches:
            shingles = batch.column(6)
            offsets, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            for i, (cluster, cell, asks, g, fp, node) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)))):
                if (cluster, cell) != key:
                    key, tree, entries, parent = (cluster, cell), BKTree(), {}, {}
                fp, own = fp & (1 << 64) - 1, set(values[offsets[i] : offsets[i + 1]].tolist())
                if not asks:
                    if fp not in entries:
                        tree.add(fp)
                    entries.setdefault(fp, []).append((g, node, own))
                    continue
                n = len(own)
                for k in tree.within(fp, radius):
                    for other_g, other, theirs in entries[tree.values[k]]:
                        m = len(theirs)
                        if n < m * least - 1e-9 or m < n * least - 1e-9 or root(g) == root(other_g):
                            continue
                        shared = len(own & theirs)
                        if shared / (n + m - shared) >= least - 1e-12:
                            parent[root(g)] = root(other_g)
                            out.append((node, other))
            if len(out) > 50_000:
                yield flush()
        yield flush()

    return run


def _near_hubs(held: DataFrame, least: float) -> DataFrame:
    """(u, v): members of clusters and the hub of their cluster that they are near enough to, in RETIRE_ROUNDS rounds; who has found one takes no further part."""
    links = None
    open_ = held.select("node", "root")
    for k in range(RETIRE_ROUNDS):
        hubs = open_.groupBy("root").agg(F.min_by("node", F.struct(F.xxhash64("node", F.lit(k)), "node")).alias("hub"), F.count("*").alias("left")).filter("left > 1").drop("left")
        hubs = materialize(hubs.join(held.select(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("shingles").alias("hub_shingles")), "hub"), "similar-hub-sets")
        members = held if links is None else held.join(open_.select("node"), "node", "left_semi")
        met = members.join(few(hubs, HUB_SETS), "root").filter((F.col("node") != F.col("hub")) & _near_size("n", "m", least))
        shared = F.size(F.array_intersect("shingles", "hub_shingles"))
        new = met.withColumn("shared", shared).filter(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")) >= least - 1e-12).select(F.col("node").alias("u"), F.col("hub").alias("v"))
        links = materialize(new if links is None else links.unionByName(new), "similar-retired")
        settled = links.select(F.col("u").alias("node")).unionByName(hubs.select(F.col("hub").alias("node")))
        open_ = materialize(open_.join(settled.distinct(), "node", "left_anti"), "similar-open-members")
    return links


def _large_cluster_links(held: DataFrame, sizes: DataFrame, radius: int, least: float) -> DataFrame:
    """(u, v): links of clusters of several chunks.

    Members meet a hub of their cluster first; those near it are one group with
    it.  The largest group asks nothing: each other member meets every chunk
    once.  A cluster of m near copies makes m rows, not m times its chunks.
    """
    near = _near_hubs(held, least)
    g = near.select(F.col("u").alias("node"), F.col("v").alias("g"))
    grouped = held.join(g, "node", "left").withColumn("g", F.coalesce("g", "node"))
    main = grouped.groupBy("root", "g").agg(F.count("*").alias("c")).groupBy("root").agg(F.max(F.struct("c", "g")).alias("most")).select("root", F.col("most.g").alias("main"))
    placed = grouped.join(few(materialize(sizes.join(main, "root"), "similar-cluster-sizes"), HUB_SETS), "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cols = ["root", "cell", "asks", "g", "fp", "node", "shingles"]
    members = placed.withColumn("cell", F.col("own")).withColumn("asks", F.lit(False)).select(*cols)
    asking = placed.filter("g <> main").withColumn("asks", F.lit(True)).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*cols)
    found = in_batches(members.unionByName(asking).repartition("root", "cell").sortWithinPartitions("root", "cell", "asks", "node"), _group_linker(radius, least), "u long, v long")
    return near.unionByName(found)


def _cluster_links(clusters: DataFrame, sets: DataFrame, radius: int, least: float) -> DataFrame:
    """(u, v): links within each cluster; clusters: (node, root)."""
    held = materialize(clusters.join(sets, "node"), "similar-clusters")
    sizes = materialize(held.groupBy("root").agg(F.ceil(F.sum("n") / CLUSTER_SHINGLES).cast("int").alias("chunks")), "similar-cluster-sizes")
    large = sizes.filter("chunks > 1")
    small = held.join(few(large.select("root")), "root", "left_anti") if not large.isEmpty() else held
    cells = small.select("root", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("own"), "fp", "node", "shingles")
    links = in_batches(cells.repartition("root").sortWithinPartitions("root", "node"), _cluster_linker(radius, least), "u long, v long")
    if large.isEmpty():
        return links
    return links.unionByName(_large_cluster_links(materialize(held.join(few(large.select("root")), "root", "left_semi"), "similar-large"), large, radius, least))


def _bit_distance(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _near_size(a, b, least: float):
    return (F.col(a) >= F.col(b) * least - 1e-9) & (F.col(b) >= F.col(a) * least - 1e-9)


def _tree_candidates(radius: int, least: float):
    """Per cell (h, chunk): a BK-tree of its members; queries meet the members of other groups within the radius."""

    def run(batches):
        key, members, queries = None, [], []
        out: list[tuple[int, int]] = []

        def close():
            tree, entries = BKTree(), {}
            for fp, node, n, root in members:
                if fp not in entries:
                    tree.add(fp)
                entries.setdefault(fp, []).append((node, n, root))
            for fp, node, n, root in queries:
                for k in tree.within(fp, radius):
                    for other, m, o_root in entries[tree.values[k]]:
                        if o_root != root and n >= m * least - 1e-9 and m >= n * least - 1e-9:
                            out.append((min(node, other), max(node, other)))

        def flush():
            pairs = list(dict.fromkeys(out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for h, cell, asks, fp, node, n, root in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, cell) != key:
                    close()
                    key, members, queries = (h, cell), [], []
                    if len(out) > 50_000:
                        yield flush()
                (queries if asks else members).append((fp & (1 << 64) - 1, node, n, root))
        close()
        yield flush()

    return run


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the shards that hold more than one cluster, with their cluster as root."""
    grouped = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = grouped.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
    return materialize(grouped.join(materialize(mixed, "similar-mixed"), "h").select("h", "node", "n", "fp", "root"), "similar-open")


def similar_texts(docs: DataFrame, least: float = LEAST, width: int = WIDE_SHINGLE, radius: int = WIDE, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, node, component) for every row; a component's name is its smallest node."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(rows.select("text"), width))
    marked = materialize(in_batches(rows, _marker(shared, width, least), "doc_id long, text_hash long, node long, n int, fp long, prefix array<long>"), "similar-marked")
    heads = materialize(marked.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("fp").alias("fp")), "similar-heads")

    prefixes = marked.filter("prefix IS NOT NULL").select(F.explode("prefix").alias("h"), "node").repartition("h").sortWithinPartitions("h", "node")
    members = prefixes.mapInArrow(_shared_only, "h long, node long").join(heads.select("node", "n", "fp"), "node")
    members = materialize(members.select("h", "node", "n", "fp"), "similar-members")

    loose, open_ = None, members.withColumn("root", F.col("node"))
    for k in range(HUB_ROUNDS):
        drawn = F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("draw"), F.col("node").alias("hub"), F.col("n").alias("m"), F.col("fp").alias("hub_fp"), F.col("root").alias("hub_root")))
        hubs = materialize(open_.groupBy("h").agg(drawn.alias("d")).select("h", "d.hub", "d.m", "d.hub_fp", "d.hub_root"), "similar-hubs")
        met = open_.join(hubs, "h").filter((F.col("root") != F.col("hub_root")) & _near_size("n", "m", least)).withColumn("bits", _bit_distance("fp", "hub_fp")).filter(F.col("bits") <= LOOSE)
        closest = met.groupBy("node").agg(F.min(F.struct("bits", "hub")).alias("c")).select(F.col("node").alias("u"), F.col("c.hub").alias("v"))
        loose = materialize(closest if loose is None else loose.unionByName(closest), "similar-loose")
        roots = materialize(components(loose), "similar-roots")
        open_ = _with_roots(members, roots)
    sizes = open_.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("most"))
    sizes = materialize(sizes.select("h", F.ceil(F.col("size") / chunk).cast("int").alias("chunks"), F.col("most.root").alias("main")), "similar-sizes")
    # the largest group of a shard need not ask: all others ask it
    placed = open_.join(sizes, "h").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    asking = placed.filter("root <> main").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cols = ["h", "cell", "asks", "fp", "node", "n", "root"]
    cells = placed.withColumn("cell", F.col("own")).withColumn("asks", F.lit(False)).select(*cols).unionByName(asking.withColumn("asks", F.lit(True)).select(*cols))
    pairs = cells.repartition("h", "cell").sortWithinPartitions("h", "cell", "asks", "node").mapInArrow(_tree_candidates(radius, least), "u long, v long")
    rest = materialize(pairs.distinct(), "similar-rest")
    asked = roots.select("node").unionByName(rest.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    sets = _sets(asked, rows, heads, width)
    roots = components(_cluster_links(roots, sets, radius, least).unionByName(_verified(rest, sets, least)))
    named = heads.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
    return marked.select("doc_id", "text_hash", "node").join(materialize(named, "similar-named"), "node").select("doc_id", "text_hash", "node", "component")


def keep_one(docs: DataFrame, least: float = LEAST, width: int = WIDE_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts: the smallest id, then the smallest text hash; rows without an id stay.

    Ids may repeat: rows with one id and different texts are told apart by
    their text, and of equal rows one stays.
    """
    own = docs.filter(F.col(id_col).isNotNull())
    groups = materialize(similar_texts(own, least, width, id_col=id_col, text_col=text_col), "similar-groups")
    keys = groups.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    first = keys.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    judged = keys.join(first, "component").select("doc_id", "text_hash", (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays"), (F.col("times") > 1).alias("several"))
    # keys that change something: texts stay where they are while these are few
    verdicts = few(materialize(judged.filter("NOT stays OR several"), "similar-verdicts"))
    columns = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no name of the input meets one of the verdicts
    rows = own.toDF(*columns.values()).withColumns({"own_id": F.col(columns[id_col]).cast("long"), "own_hash": F.xxhash64(F.coalesce(F.col(columns[text_col]).cast("string"), F.lit("")))})
    seen = rows.join(verdicts, (F.col("own_id") == F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left").filter("stays IS NULL OR stays")
    back = [F.col(new).alias(old) for old, new in columns.items()]
    alone = seen.filter("stays IS NULL").select(*back)
    several = seen.filter("stays").dropDuplicates(["own_id", "own_hash"]).select(*back)
    return alone.unionByName(several).unionByName(docs.filter(F.col(id_col).isNull()))


def op7_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
