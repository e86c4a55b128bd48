"""Benchmark decontamination by SimHash of item-sized windows.

Words are cut at ASCII white space and lower-cased (A-Z).  For an item of n
words every window of n words of a document is a candidate that shares at least
one shingle with the item (without one the similarity is 0).  Candidate windows
get a SimHash; a multi-index over eight 8-bit blocks, each probed with up to
``RADIUS // 8`` flipped bits, returns every item fingerprint within ``RADIUS``
bits; the weighted-shingle similarity (sum of smaller over sum of larger
multiplicities) then decides.

Benchmark items come in blocks of about ``BLOCK_BYTES`` of text; each block is
one broadcast index and one scan of the documents, and is given up before the
next is built, so a large benchmark costs scans and not memory.
Items and documents with fewer words than a shingle count as one shingle; a
document shorter than an item is one window.  Null and empty items and texts
match nothing.  Equal items are all reported.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.docstats import texts_as_bytes
from quillspan.workspace import few, in_batches, materialize, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCK_BYTES = 8 << 20
GROUP_BYTES = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

HIT_DDL = "doc_id long, item_id long, similarity double, start_word int, n_words int, n_windows int"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_keys(h: np.ndarray, width: int) -> np.ndarray:
    """Keys of all runs of ``width`` words from the words' hashes."""
    n = len(h) - width + 1
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        key = key * _FACTOR + h[k : n + k]
    return key


def _bits(keys: np.ndarray) -> np.ndarray:
    """64 signs of each shingle."""
    x = (keys ^ (keys >> np.uint64(31))) * _FACTOR
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1)


def weighted_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger multiplicities of two bags (keys in ascending order, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    high = int(a[1].sum()) + int(b[1].sum()) - low
    return low / high if high else 0.0


_WITHIN = {r: np.array([[x for x in range(256) if (x ^ v).bit_count() <= r] for v in range(256)], np.uint8) for r in range(RADIUS // 8 + 1)}


class ItemIndex:
    """Fingerprints of one block of items with multi-index tables per item length, all in flat arrays.

    Beside the dictionary of words an item costs 12 bytes a shingle and, at
    radius 20, 1.2 KB of postings.
    """

    def __init__(self, items: list[tuple[int, bytes]], width: int = SHINGLE, radius: int = RADIUS):
        self.width, self.radius = width, radius
        self.codes: dict[bytes, int] = {}
        held = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                held.append((item_id, np.fromiter((self.codes.setdefault(w, len(self.codes) + 1) for w in words), np.int32, len(words))))
        self.ids = [i for i, _ in held]
        self.word_hash = np.random.default_rng(3).integers(1, 1 << 63, len(self.codes) + 1, dtype=np.uint64)
        lengths = np.array([len(w) for _, w in held], np.int32)
        self.bags, fps, by_width = [], [], defaultdict(list)
        for (_, words), n in zip(held, lengths.tolist()):
            w = min(width, n)
            keys, counts = np.unique(shingle_keys(self.word_hash[words], w), return_counts=True)
            self.bags.append((keys, counts.astype(np.int32)))
            fps.append(_pack((_bits(keys) * counts[:, None]).sum(axis=0)))
            by_width[w].append((keys, n))
        self.fps = np.array(fps, np.uint8).reshape(-1, 8)
        self.fps64 = self.fps.view(np.uint64).ravel()
        #: per shingle width: keys, and the item lengths of each as (offsets, lengths)
        self.keys, self.key_lengths = {}, {}
        for w, own in by_width.items():
            key, n = np.concatenate([k for k, _ in own]), np.concatenate([np.full(len(k), n, np.int32) for k, n in own])
            order = np.lexsort((n, key))
            key, n = key[order], n[order]
            fresh = np.append(True, (key[1:] != key[:-1]) | (n[1:] != n[:-1]))
            key, n = key[fresh], n[fresh]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            self.keys[w], self.key_lengths[w] = key[first], (np.append(first, len(key)), n)
        self.tables = {}
        near = _WITHIN[radius // 8]
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n).astype(np.int32)
            blocks = []
            for b in range(8):
                values = near[self.fps[own, b]]
                order = np.argsort(values.ravel(), kind="stable")
                blocks.append((np.repeat(own, values.shape[1])[order], np.searchsorted(values.ravel()[order], np.arange(257))))
            self.tables[n] = blocks

    def seeds(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """By shingle width, the word positions whose shingle is an item's."""
        known = (ids > 0).astype(np.int32)
        run = np.concatenate([[0], np.cumsum(known)])
        out = {}
        for width, keys in self.keys.items():
            if len(ids) < width:
                continue
            at = np.flatnonzero(run[width:] - run[:-width] == width)
            if len(at):
                key = shingle_keys(self.word_hash[ids], width)[at]
                slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                at = at[keys[slot] == key]
            if len(at):
                out[width] = at
        return out

    def near(self, length: int, fp: np.ndarray) -> list[int]:
        """Items of a length whose fingerprints are within the radius."""
        found = [order[off[v] : off[v + 1]] for (order, off), v in zip(self.tables[length], fp.tolist())]
        found = np.unique(np.concatenate(found))
        return found[np.bitwise_count(self.fps64[found] ^ fp.view(np.uint64)[0]) <= self.radius].tolist()

    def search(self, words: list[bytes], ids: np.ndarray, seeds: dict[int, list[int]], threshold: float):
        """Best window of each item: {item position: (similarity, start, length, windows over the threshold)}."""
        best: dict[int, tuple[float, int, int, int]] = {}
        starts: dict[int, set[int]] = defaultdict(set)
        n = len(words)
        h = self.word_hash[ids]
        for i in np.flatnonzero(ids == 0).tolist():  # words that no item has
            h[i] = xxhash.xxh64_intdigest(words[i], 7)
        for width, positions in seeds.items():
            offsets, lengths = self.key_lengths[width]
            slots = np.searchsorted(self.keys[width], shingle_keys(h, width)[positions])
            for p, slot in zip(positions, slots.tolist()):
                for length in lengths[offsets[slot] : offsets[slot + 1]].tolist():
                    if length >= n:
                        starts[length].add(0)
                    else:
                        starts[length].update(range(max(0, p - max(0, length - width)), min(p, n - length) + 1))
        for length, own in starts.items():
            size, width = min(length, n), min(length, n, self.width)
            per = size - width + 1
            for first, last in _runs(sorted(own)):
                keys = shingle_keys(h[first : last + size], width)
                sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(_bits(keys), axis=0)])
                fps = _pack(sums[per:] - sums[:-per])
                for k in range(last - first + 1):
                    close = self.near(length, fps[k])
                    if not close:
                        continue
                    bag = np.unique(keys[k : k + per], return_counts=True)
                    for item in close:
                        sim = weighted_similarity(self.bags[item], bag)
                        if sim >= threshold:
                            old = best.get(item)
                            count = (old[3] if old else 0) + 1
                            best[item] = (sim, first + k, size, count) if old is None or (sim, -(first + k)) > (old[0], -old[1]) else (*old[:3], count)
        return best


def _runs(values: list[int]):
    first = last = None
    for v in values:
        if last is not None and v == last + 1:
            last = v
            continue
        if last is not None:
            yield first, last
        first = last = v
    if last is not None:
        yield first, last


def _scan_batch(index: ItemIndex, texts: list[bytes], threshold: float) -> list[dict]:
    """Hits of each text; words of many texts are looked up together."""
    out: list[dict] = [{} for _ in texts]
    get = index.codes.get
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (size < GROUP_BYTES or not group):
            group.append(at)
            size += len(texts[at])
            at += 1
        words, ends, parts = [], [], []
        for i in group:
            own = words_of(texts[i])
            words.append(own)
            parts.extend([get(w, 0) for w in own])
            parts.append(0)  # no shingle crosses texts
            ends.append(len(parts))
        ids = np.array(parts, np.int64)
        found: dict[int, dict[int, list[int]]] = defaultdict(dict)
        for width, positions in index.seeds(ids).items():
            doc = np.searchsorted(ends, positions, side="right")
            for d, p in zip(doc.tolist(), positions.tolist()):
                found[d].setdefault(width, []).append(p - (ends[d - 1] if d else 0))
        for d, seeds in found.items():
            out[group[d]] = index.search(words[d], ids[ends[d - 1] if d else 0 : ends[d] - 1], seeds, threshold)
    return out


def _hit_finder(index: ItemIndex, threshold: float):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, hits in zip(batch.column(0).to_pylist(), _scan_batch(index, texts_as_bytes(batch.column(1)), threshold)):
                rows += [(doc_id, index.ids[k], *hits[k]) for k in sorted(hits)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "similarity", "start_word", "n_words", "n_windows"])

    return run


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def block_count(benchmark: DataFrame, text_col: str = "text", block_bytes: int | None = None) -> int:
    """Blocks of at most about ``block_bytes`` of text that the benchmark makes; one for an empty one."""
    total = benchmark.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(1, -(-total // (block_bytes or BLOCK_BYTES)))


def item_blocks(benchmark: DataFrame, blocks: int, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of the benchmark, one block at a time; each block's items fit the driver by its size bound."""
    items = _items(benchmark, id_col, text_col)
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield ItemIndex([(r["item_id"], r["text"].encode()) for r in own.orderBy("item_id", "text").toLocalIterator()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per (document, item) at or above the threshold, with the best (then first) window.

    A benchmark of several blocks is one scan of the documents a block.  The
    hits of a block are written and its index is given up before the next one is
    built, so driver and executors hold one block at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks, out = block_count(benchmark), None
    for index in item_blocks(benchmark, blocks):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = in_batches(rows, _shared(_hit_finder, shared, threshold), HIT_DDL)
        if blocks == 1:
            return found
        found = materialize(found, "leaks-block")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _shared(make, shared, *more):
    """make(index, ...) with the index taken from its broadcast on the executor."""

    def run(batches):
        yield from make(shared.value, *more)(batches)

    return run


def _filter(index: ItemIndex, at: int, threshold: float):
    def run(batches):
        for batch in batches:
            hits = _scan_batch(index, texts_as_bytes(batch.column(at)), threshold)
            yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns.

    With a benchmark of one block nothing shuffles.  With several, hits of all
    blocks are found first, by a hash of the text, and their rows left out.
    """
    blocks = block_count(benchmark)
    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(item_blocks(benchmark, 1)))
        return in_batches(docs, _shared(_filter, shared, docs.columns.index(text_col), threshold), docs.schema)
    hashed = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    hits = find_leaks(docs.select(hashed.alias("doc_id"), docs[text_col].cast("string").alias("text")), benchmark, threshold=threshold)
    held = materialize(hits.select(F.col("doc_id").alias("leak")).distinct(), "leaks-held")
    return docs.join(few(held), hashed == held["leak"], "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
