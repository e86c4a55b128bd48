"""Merkle manifest of a dataset: a leaf per document, a tree per language, one root over all.

Where a leaf stands is found without sorting documents.  Every language has a
bitmap of its ids in words of 64 bits, of which only those with a bit set exist
(merged by OR while it is aggregated), and a directory of how many ids precede
each word, summed over words, then over ever larger spans of words; the place of
an id is the directory's count plus the bits below it in its own word.  Places
are the keys of the reduction: slots ``BLOCK`` apart at the lowest level form an
array in one task and become one node, those nodes are slots of the next round,
until one node is left.  Going back, each array hands the siblings on every path
to the slots below it.

Order inside a language: null ids first, then ascending ids; rows of equal id by
leaf; equal rows in any order, each with a place and a proof of its own.
Languages: null first, then bytewise.  An empty table gives no rows.  Only the
five columns of ``documents`` are read, so further columns of any name do no
harm.  No language, id or array is gathered in one task beyond a fixed number of
rows: arrays have at most ``BLOCK`` slots, directories ``SPAN`` words a span, and
rows of equal id are counted in classes of their leaves before they are numbered.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.workspace import few, materialize, table

LEVELS = 9
BLOCK = 1 << LEVELS
SPAN_BITS = 14
#: Where null ids are counted: a word before any that an id has.
NULL_WORD = -(1 << 57) - 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks whose paths may be broadcast to the arrays below them.
BROADCAST_BLOCKS = 20_000


def serialized(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(serialized(columns[f]) for f in FIELDS)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, tampered): g names the language so that null sorts first; tampered is the leaf with one more in n_chars, null where nothing is tampered."""
    own = {f: docs[f] for f in FIELDS}
    more = own | {"n_chars": (docs["n_chars"].cast("decimal(20,0)") + 1).cast("decimal(20,0)")}
    chosen = (F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 7 == 0) & docs["n_chars"].isNotNull()
    return docs.select(group_of(docs["lang"]).alias("g"), docs["doc_id"].cast("long").alias("doc_id"), leaf_hash(own).alias("leaf"), F.when(chosen, leaf_hash(more)).alias("tampered"))


def group_of(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("1"), lang), F.lit("0"))


def word_of(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id, 6), F.lit(NULL_WORD))


def bit_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.bitwiseAND(63), F.lit(0)).cast("int")


def _below(bits: Column, bit: Column) -> Column:
    """The bits under one place."""
    return bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit)))


def bitmaps(docs: DataFrame) -> DataFrame:
    """(g, word, bits, n): the ids of each group as words of 64 bits, and the rows in each word."""
    ids = docs.select(group_of(docs["lang"]).alias("g"), docs["doc_id"].cast("long").alias("i"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit_of(F.col("i")))
    return ids.groupBy("g", word_of(F.col("i")).alias("word")).agg(F.bit_or(one).alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """``words`` with how many rows of the group precede each word (``before``), from sums over spans of spans of words."""
    spans, key = [words.select("g", F.col("word").alias("k0"), "n")], "k0"
    for level in (1, 2, 3):
        key = f"k{level}"
        up = spans[-1].withColumn(key, F.shiftright(f"k{level - 1}", SPAN_BITS))
        spans.append(up.groupBy("g", key).agg(F.sum("n").alias("n")))
    running = lambda df, part, order: df.withColumn("sofar", F.sum("n").over(Window.partitionBy(*part).orderBy(order)) - F.col("n"))
    top = running(spans[3], ["g"], "k3").select("g", "k3", F.col("sofar").alias("b3"))
    for level in (2, 1, 0):
        down = spans[level].withColumn(f"k{level + 1}", F.shiftright(f"k{level}", SPAN_BITS))
        inner = running(down, ["g", f"k{level + 1}"], f"k{level}")
        top = inner.join(top, ["g", f"k{level + 1}"]).select("g", f"k{level}", (F.col("sofar") + F.col(f"b{level + 1}")).alias(f"b{level}"))
    return words.join(top.select("g", F.col("k0").alias("word"), F.col("b0").alias("before")), ["g", "word"])


def placed(docs: DataFrame) -> DataFrame:
    """(g, slot, doc_id, leaf, tampered) of every row, slots from 0 in each group."""
    words = materialize(directory(materialize(bitmaps(docs), "merkle-bitmaps")), "merkle-directory")
    spots = words.select(F.col("g").alias("wg"), "word", "bits", "n", "before")
    rows = leaves(docs).withColumns({"w": word_of(F.col("doc_id")), "bit": bit_of(F.col("doc_id"))})
    rows = rows.join(few(spots), (F.col("g") == F.col("wg")) & (F.col("w") == F.col("word")))
    rank = F.col("before") + F.bit_count(_below(F.col("bits"), F.col("bit")))
    kept = ("g", rank.alias("slot"), "doc_id", "leaf", "tampered")
    if words.filter("n > bit_count(bits)").isEmpty():  # every id is its row's own
        return rows.select(*kept)
    ties = rows.filter("n > bit_count(bits)").select("g", "w", "bit", "before", "doc_id", "leaf", "tampered", F.substring(F.hex("leaf"), 1, 3).alias("b"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    ties = materialize(ties, "merkle-ties")
    # equal ids of one word: counts of classes of leaves, then of equal leaves of one file part, then rows
    classes = ties.groupBy("g", "w", "bit", "b").agg(F.count("*").alias("n"))
    classes = classes.withColumn("o1", F.sum("n").over(Window.partitionBy("g", "w").orderBy("bit", "b")) - F.col("n")).drop("n")
    equal = ties.groupBy("g", "w", "bit", "b", "leaf", "p").agg(F.count("*").alias("n"))
    equal = equal.withColumn("o2", F.sum("n").over(Window.partitionBy("g", "w", "bit", "b").orderBy("leaf", "p")) - F.col("n")).drop("n")
    own = ties.withColumn("o3", F.row_number().over(Window.partitionBy("g", "w", "bit", "leaf", "p").orderBy("m")) - 1)
    numbered = own.join(equal, ["g", "w", "bit", "b", "leaf", "p"]).join(classes, ["g", "w", "bit", "b"])
    numbered = numbered.select("g", (F.col("before") + F.col("o1") + F.col("o2") + F.col("o3")).alias("slot"), "doc_id", "leaf", "tampered")
    return rows.filter("n = bit_count(bits)").select(*kept).unionByName(numbered)


def combine(nodes: list[bytes]) -> bytes:
    return sha256(b"".join(x.hex().encode() for x in nodes)).digest()


def reduce_array(nodes: list[bytes], levels: int) -> tuple[bytes, list[list[bytes]]]:
    """The node above an array of slots, and each level's nodes below it."""
    below = []
    for _ in range(levels):
        below.append(nodes)
        nodes = [combine(nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], below


def path_in(below: list[list[bytes]], slot: int) -> list[bytes]:
    """Siblings from a slot upwards: L or R and the node, or nothing where the run is alone."""
    path = []
    for nodes in below:
        s = slot ^ 1
        path.append((b"L" if s < slot else b"R") + nodes[s] if s < len(nodes) else b"")
        slot >>= 1
    return path


def fold(node: bytes, path: list[bytes]) -> bytes:
    """The root that a node and the siblings on its way lead to."""
    for sibling in path:
        node = combine([sibling[1:], node] if sibling[:1] == b"L" else [node, sibling[1:]] if sibling else [node])
    return node


def _height(n: int, done: int) -> int:
    return min(LEVELS, max(0, (n - 1).bit_length() - done))


def arrays(nodes: DataFrame, done: int) -> DataFrame:
    """Slots (g, n, slot, node, and doc_id and tampered at the lowest level) as arrays (g, n, block, nodes, ids, tampered, parent)."""
    lowest = "doc_id" in nodes.columns

    def work(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("slot")
        g, n, block = (k.as_py() for k in key)
        own = rows.column("node").to_pylist()
        parent, _ = reduce_array(own, _height(n, done))
        ids = rows.column("doc_id").to_pylist() if lowest else None
        changed = rows.column("tampered").to_pylist() if lowest else None
        values = [[g], [n], [block], [own], [ids], [changed], [parent]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["g", "n", "block", "nodes", "ids", "tampered", "parent"])

    keyed = nodes.withColumn("block", F.shiftright("slot", LEVELS))
    return keyed.groupBy("g", "n", "block").applyInArrow(work, "g string, n long, block long, nodes array<binary>, ids array<long>, tampered array<binary>, parent binary")


def _joined(blocks: DataFrame, above: DataFrame) -> DataFrame:
    paths = above.select(F.col("g").alias("ag"), F.col("slot").alias("ablock"), "path")
    return blocks.join(few(paths, BROADCAST_BLOCKS), (F.col("g") == F.col("ag")) & (F.col("block") == F.col("ablock")))


def climb(nodes: DataFrame, most: int, done: int = 0) -> tuple[DataFrame, DataFrame]:
    """For slots (g, n, slot, node) of trees of n leaves: ((g, slot, path) to the tree's top, (g, top)).

    ``most`` is the largest n, ``done`` the levels that lie below these slots.
    """
    if (most - 1).bit_length() <= done:
        return nodes.select("g", "slot", F.array().cast("array<binary>").alias("path")), nodes.select("g", F.col("node").alias("top"))
    blocks = materialize(arrays(nodes, done), "merkle-arrays")
    above, tops = climb(blocks.select("g", "n", F.col("block").alias("slot"), F.col("parent").alias("node")), most, done + LEVELS)

    def work(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                _, below = reduce_array(r["nodes"], _height(r["n"], done))
                count = len(r["nodes"])
                slots = [(r["block"] << LEVELS) + k for k in range(count)]
                paths = [path_in(below, k) + r["path"] for k in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * count, pa.string()), pa.array(slots, pa.int64()), pa.array(paths, pa.list_(pa.binary()))], ["g", "slot", "path"])

    paths = _joined(blocks, above).select("g", "n", "block", "nodes", "path").mapInArrow(work, "g string, slot long, path array<binary>")
    return materialize(paths, "merkle-paths"), tops


def numbered_groups(groups: DataFrame) -> DataFrame:
    """``groups`` with slots from 0 in order of g: ranges of g, rows numbered in each range, ranges by their counts."""
    ranged = materialize(groups.repartitionByRange("g").sortWithinPartitions("g").withColumn("part", F.spark_partition_id()), "merkle-groups")
    own = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("g")) - 1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("c"))
    parts = parts.withColumn("start", F.sum("c").over(Window.orderBy("part")) - F.col("c"))  # a row a partition
    return own.join(F.broadcast(parts.drop("c")), "part").select(*groups.columns, (F.col("k") + F.col("start")).cast("long").alias("slot"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root) of every row, hashes as binary, proof as the siblings from leaf to root."""
    rows = materialize(placed(docs), "merkle-leaves")
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("n")), "merkle-sizes")
    stats = sizes.agg(F.max("n"), F.count("*")).first()
    most, groups = stats[0] or 1, max(stats[1], 1)
    slots = rows.join(few(sizes.select(F.col("g").alias("sg"), "n")), F.col("g") == F.col("sg")).select("g", "n", "slot", F.col("leaf").alias("node"), "doc_id", "tampered")
    blocks = materialize(arrays(slots, 0), "merkle-arrays")
    above, tops = climb(blocks.select("g", "n", F.col("block").alias("slot"), F.col("parent").alias("node")), most, LEVELS)
    ordered = materialize(numbered_groups(tops.distinct()), "merkle-subroots")
    over, root = climb(ordered.select(F.lit("").alias("g"), F.lit(groups).cast("long").alias("n"), "slot", F.col("top").alias("node")), groups)
    summit = ordered.join(few(over.select("slot", F.col("path").alias("over"))), "slot").crossJoin(F.broadcast(root.select(F.col("top").alias("root")).limit(1)))
    summit = materialize(summit.select(F.col("g").alias("rg"), F.col("top").alias("subroot"), "root", "over"), "merkle-summit")
    kinds = "doc_id long, leaf binary, subroot binary, root binary, proof array<binary>, folded_root binary"

    def work(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                _, below = reduce_array(r["nodes"], _height(r["n"], 0))
                up = r["path"] + r["over"]
                count = len(r["nodes"])
                paths = [path_in(below, k) + up for k in range(count)]
                folded = [fold(c if c is not None else leaf, path) for leaf, c, path in zip(r["nodes"], r["tampered"], paths, strict=True)]
                proofs = [[x[1:] for x in path if x] for path in paths]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], pa.int64()), pa.array(r["nodes"], pa.binary()), pa.array([r["subroot"]] * count, pa.binary()), pa.array([r["root"]] * count, pa.binary()), pa.array(proofs, pa.list_(pa.binary())), pa.array(folded, pa.binary())],
                    ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"],
                )

    joined = _joined(blocks, above).join(few(summit, BROADCAST_BLOCKS), F.col("g") == F.col("rg"))
    return joined.select("n", "nodes", "ids", "tampered", "path", "subroot", "root", "over").mapInArrow(work, kinds)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, digest of the proof and the check of a tampered copy for every document."""
    hexed = lambda c: F.lower(F.hex(c))
    rows = manifest(table(spark, sf_dir, "documents"))
    proof = F.sha2(F.concat_ws("", F.transform("proof", hexed)), 256)
    return rows.select("doc_id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), proof.alias("proof_sha256"), hexed("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::varchar) || ':' || ({c})::varchar END"


def _tree_sql(name: str, source: str) -> str:
    """Nodes (g, level, slot, node) of the trees over ``source`` (g, slot, node)."""
    return f"""{name}(g, level, slot, node) AS (
  SELECT g, 0, slot, node FROM {source}
  UNION ALL
  SELECT g, level + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, level, slot // 2
)"""


OP13_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256(concat({", ".join(map(_field_sql, FIELDS))})) AS leaf,
         CASE WHEN n_chars IS NOT NULL THEN sha256(concat({", ".join(_field_sql("n_chars + 1" if f == "n_chars" else f) for f in FIELDS)})) END AS changed,
         list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii((doc_id::varchar)[k])::bigint)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::bigint) ELSE x // 2 END)) AS crc
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, CASE WHEN xor(crc, 4294967295::bigint) % 7 = 0 AND changed IS NOT NULL THEN changed ELSE leaf END AS other
  FROM rows
), bottom AS (SELECT g, slot, leaf AS node FROM leaves), {_tree_sql("low", "bottom")},
subroots AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS slot, node, g AS own FROM (SELECT g, arg_max(node, level) AS node FROM low GROUP BY g)),
{_tree_sql("high", "(SELECT g, slot, node FROM subroots)")},
steps AS (
  SELECT l.g AS own, l.slot AS first, t.level, s.node, (l.slot >> t.level) % 2 AS side
  FROM leaves l JOIN (SELECT DISTINCT g, level FROM low) t USING (g) LEFT JOIN low s ON s.g = l.g AND s.level = t.level AND s.slot = xor(l.slot >> t.level, 1)
  WHERE t.level < (SELECT max(level) FROM low m WHERE m.g = l.g)
  UNION ALL
  SELECT l.g, l.slot, 1000 + t.level, s.node, (r.slot >> t.level) % 2
  FROM leaves l JOIN subroots r ON r.own = l.g CROSS JOIN (SELECT DISTINCT level FROM high) t LEFT JOIN high s ON s.level = t.level AND s.slot = xor(r.slot >> t.level, 1)
  WHERE t.level < (SELECT max(level) FROM high)
), ways AS (
  SELECT own, first, coalesce(string_agg(node, '' ORDER BY level), '') AS proof, list({{'node': node, 'side': side}} ORDER BY level) AS way FROM steps GROUP BY own, first
), folding(g, slot, k, node) AS (
  SELECT g, slot, 1, other FROM leaves
  UNION ALL
  SELECT f.g, f.slot, f.k + 1, sha256(CASE WHEN w.way[f.k].node IS NULL THEN f.node WHEN w.way[f.k].side = 1 THEN w.way[f.k].node || f.node ELSE f.node || w.way[f.k].node END)
  FROM folding f JOIN ways w ON w.own = f.g AND w.first = f.slot WHERE f.k <= len(w.way)
), folded AS (SELECT g, slot, arg_max(node, k) AS node FROM folding GROUP BY g, slot), top AS (SELECT arg_max(node, level) AS root FROM high)
SELECT l.doc_id, l.leaf, r.node AS subroot, root, sha256(coalesce(w.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM leaves l JOIN subroots r ON r.own = l.g JOIN folded f ON f.g = l.g AND f.slot = l.slot LEFT JOIN ways w ON w.own = l.g AND w.first = l.slot CROSS JOIN top
"""
