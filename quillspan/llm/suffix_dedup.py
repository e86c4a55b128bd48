"""Repeated long strings through run-length indexes.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else, in the same document or another, is marked.  One index over the corpus
would be one task's work, so strings are first dealt out by content:

1. Winnowing.  Each window of ``length`` bytes has an anchor, its smallest k-gram
   hash (leftmost on ties).  Equal windows have equal anchors at equal offsets.
   Consecutive windows with one anchor form a segment, known by its anchor hash
   and a digest of its bytes.  Each window lies in exactly one segment.
2. Anchors that occur once cannot repeat and go.  A segment whose (anchor,
   digest) occurs twice repeats as a whole.
3. Anchors with several different segments keep one copy of each.  Partitions
   of them are indexed: run-compressed BWT, sampled run ends, and matching
   statistics streamed from the samples mark the windows that repeat.
4. Segments of an anchor with more than ``FIT`` different ones are dealt again.
   Windows of one anchor are equal only if the anchor stands at the same offset
   in both, so a segment is cut at fixed offsets into pieces of ``LEVELS`` windows;
   the key of a piece is what all its windows have in common (369 bytes of 400 at
   32 windows).  Keys that one piece has go, keys with few different pieces are
   indexed, the rest is cut finer.  The last level has one window to a piece, and
   there equal keys are equal windows.
5. Marked windows are joined back to their texts and merged into spans.

Texts are known by a 64-bit hash, not by id: null ids, equal ids with different
texts and repeated rows all have their result.  A text of ``length`` bytes or
more that occurs in two rows is removed whole.  Null and empty texts have no
bytes; texts shorter than ``length`` keep all.  Hashes have 64 bits; within one
anchor both anchor and digest must agree.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.docstats import texts_as_bytes
from quillspan.llm.run_index import BYTE_CODE, MULTIPLIER, RunIndex, prefix_hashes, span_hash
from quillspan.workspace import materialize, table

LENGTH = 400
KGRAM = 32
#: Different segments of one key in one index: 0.8 MB of text at most.
FIT = 1_024
#: Windows in a piece when a hot key is dealt again, level by level.
LEVELS = (32, 4, 1)
#: Hot keys are broadcast up to this number; each has over ``FIT`` segments.
BROADCAST_KEYS = 100_000
PIECE = 1 << 19
INDEX_BYTES = 1 << 20
_POSITION_BITS = np.uint64(24)
_POSITION_MASK = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k symbols (k a power of two), by doubling."""
    h, step, factor = codes, 1, int(MULTIPLIER)
    while step < k:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def segments_of(buffer: bytes, doc_ends: np.ndarray, length: int = LENGTH, k: int = KGRAM):
    """(doc index, anchor, digest, start in buffer, number of windows) of each segment in concatenated texts."""
    raw = np.frombuffer(buffer, np.uint8)
    n = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none, none
    codes = BYTE_CODE[raw]
    grams = _kgram_hashes(codes, k)
    key = (grams & ~_POSITION_MASK) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(key, length - k + 1) & _POSITION_MASK).astype(np.int64)
    starts = np.arange(n)
    doc = np.searchsorted(doc_ends, starts, side="right")
    inside = starts + length <= doc_ends[np.minimum(doc, len(doc_ends) - 1)]
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    first, count = first[inside[first]], count[inside[first]]
    prefix = prefix_hashes(codes)
    digest = span_hash(prefix, first, first + count + length - 1)
    return doc[first], grams[anchor[first]].view(np.int64), digest.view(np.int64), first, count


ANCHOR_DDL = "text_hash long, anchor long, digest long, windows int, starts array<int>"


def _anchors(length: int, k: int):
    def emit(hashes, texts, shifts):
        """One concatenation; shifts: where each piece starts in its text."""
        buffer = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        doc, anchor, digest, start, count = segments_of(buffer, ends, length, k)
        start = start - (ends - [len(t) for t in texts])[doc] + np.asarray(shifts)[doc] if len(doc) else start
        order = np.lexsort((start, count, digest, anchor, doc))
        doc, anchor, digest, start, count = (x[order] for x in (doc, anchor, digest, start, count))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1]) | (count[1:] != count[:-1])
        head = np.flatnonzero(new)
        offsets = np.append(head, len(doc)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(hashes, np.uint64).view(np.int64)[doc[head]]),
                pa.array(anchor[head]),
                pa.array(digest[head]),
                pa.array(count[head].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(start.astype(np.int32))),
            ],
            names=["text_hash", "anchor", "digest", "windows", "starts"],
        )

    def run(batches):
        hashes, texts, shifts, held = [], [], [], 0
        seen: set[int] = set()
        for batch in batches:
            for text in texts_as_bytes(batch.column(0)):
                if len(text) < length:
                    continue
                h = xxhash.xxh64_intdigest(text, 42)
                if h in seen:  # a copy marks nothing that its first does not
                    continue
                seen.add(h)
                for at in range(0, len(text) - length + 1, PIECE):
                    piece = text[at : at + PIECE + length - 1]
                    hashes.append(h), texts.append(piece), shifts.append(at)
                    held += len(piece)
                    if held >= PIECE:
                        yield emit(hashes, texts, shifts)
                        hashes, texts, shifts, held = [], [], [], 0
        if hashes:
            yield emit(hashes, texts, shifts)

    return run


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def anchor_table(rows: DataFrame, length: int = LENGTH, k: int = KGRAM) -> DataFrame:
    """Segments of the distinct texts of each task; copies of a text in several tasks give equal rows."""
    return rows.select("text").mapInArrow(_anchors(length, k), ANCHOR_DDL)


PLAIN_DDL = "key long, digest long, windows int, segment binary"
CUT_DDL = f"{PLAIN_DDL}, hot boolean"


def _cutter(batches):
    """Cuts the wanted segments out of each text, once for copies that stand together."""
    names, kinds = ["key", "digest", "windows", "segment", "hot"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    seen: set[int] = set()
    for batch in batches:
        cols = [[] for _ in names]
        for h, text, wanted in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            if h in seen:
                continue
            seen.add(h)
            for w in wanted:
                for c, v in zip(cols, (w["key"], w["digest"], w["windows"], text[w["start"] : w["start"] + w["size"]], w["hot"])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


INDEXED_DDL = "key long, digest long, windows int, low int, high int"


def _indexer(length: int):
    """Rows of (low, high): window offsets of a segment that repeat. Partitions hold whole keys, sorted."""

    def emit(groups):
        """groups: [(key, {(digest, windows): bytes})], indexed together."""
        rows = [(a, d, w, s) for a, own in groups for (d, w), s in own.items()]
        if len(rows) < 2:
            return None
        index = RunIndex([r[3] for r in rows])
        hit = index.long_matches(length)
        out = [[] for _ in range(5)]
        for (key, digest, windows, _), at in zip(rows, index.starts.tolist()):
            own = hit[at : at + windows]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
                for c, v in zip(out, (key, digest, windows, low, high)):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["key", "digest", "windows", "low", "high"])

    def run(batches):
        groups, held, last = [], 0, None
        for batch in batches:
            for key, digest, windows, segment in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last:
                    if held >= INDEX_BYTES:
                        if (out := emit(groups)) is not None:
                            yield out
                        groups, held = [], 0
                    last = key
                    groups.append((key, {}))
                own = groups[-1][1]
                if (digest, windows) not in own:
                    own[digest, windows] = segment
                    held += len(segment)
        if groups and (out := emit(groups)) is not None:
            yield out

    return run


def index_segments(cut: DataFrame, length: int) -> DataFrame:
    """Windows (low, high) of the segments of ``cut`` that repeat within their key."""
    return cut.repartition("key").sortWithinPartitions("key", "digest", "windows").mapInArrow(_indexer(length), INDEXED_DDL)


PIECE_DDL = "anchor long, digest long, windows int, low int, n int, key long, content long"


def _splitter(block: int, length: int, k: int):
    """Cuts ranges of windows of each segment into pieces of ``block`` windows at fixed offsets from the anchor."""

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for anchor, digest, windows, segment, lows, counts in zip(*(c.to_pylist() for c in batch.columns)):
                codes = BYTE_CODE[np.frombuffer(segment, np.uint8)]
                # the anchor is the smallest k-gram of the segment, by the bits that segments_of() compares
                at = int(np.argmin(_kgram_hashes(codes, k) & ~_POSITION_MASK))
                prefix = prefix_hashes(codes)
                for low, count in zip(lows, counts):
                    offset = at - np.arange(low, low + count)
                    place = offset // block
                    head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                    n = np.diff(np.append(head, count))
                    first, place = low + head, place[head]
                    core = at - place * block  # start of the last window that a whole piece at this place has
                    common = span_hash(prefix, core, core - block + 1 + length)
                    # the anchor and the place are part of the key
                    salt = np.uint64(anchor & (1 << 64) - 1) * MULTIPLIER + place.astype(np.uint64) * BYTE_CODE[7] + np.uint64(block)
                    mixed = (common ^ salt) * BYTE_CODE[11]
                    mixed ^= mixed >> np.uint64(29)
                    content = span_hash(prefix, first, first + n + length - 1)
                    size = len(first)
                    for c, v in zip(cols, ([anchor] * size, [digest] * size, [windows] * size, first.tolist(), n.tolist(), mixed.view(np.int64).tolist(), content.view(np.int64).tolist())):
                        c.extend(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["anchor", "digest", "windows", "low", "n", "key", "content"])

    return run


def _slices(length: int):
    """Cuts the bytes of pieces out of their segments."""

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(4)]
            for segment, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in wanted:
                    for c, v in zip(cols, (w["key"], w["content"], w["n"], segment[w["low"] : w["low"] + w["n"] + length - 1])):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "digest", "windows", "segment"])

    return run


SEGMENT = ["anchor", "digest", "windows"]


def _dealt_again(hot: DataFrame, length: int, k: int, fit: int) -> DataFrame:
    """(anchor, digest, windows, low, high) of the windows that repeat among the segments of hot anchors; hot: (anchor, digest, windows, segment)."""
    found, level = [], hot.withColumn("lows", F.array(F.lit(0))).withColumn("counts", F.array("windows"))
    for depth, block in enumerate(LEVELS):
        pieces = materialize(level.select(*SEGMENT, "segment", "lows", "counts").mapInArrow(_splitter(block, length, k), PIECE_DDL), "repeat-pieces")
        one = F.min(F.struct(*SEGMENT, "low", "n"))
        contents = materialize(pieces.groupBy("key", "content").agg(F.count("*").alias("copies"), one.alias("at")), "repeat-piece-contents")
        keys = contents.groupBy("key").agg(F.count("*").alias("different"), F.sum("copies").alias("total")).filter("total > 1")
        known = materialize(contents.join(materialize(keys, "repeat-piece-keys"), "key"), "repeat-piece-known")
        whole = known.filter("copies > 1").select("key", "content", F.lit(0).alias("a"), F.col("at.n").alias("b"))
        last = depth == len(LEVELS) - 1
        wanted = known.filter("different > 1").filter(F.lit(False) if last else F.col("different") <= fit)
        asked = wanted.select(*(f"at.{c}" for c in SEGMENT), F.struct("key", "content", "at.n", "at.low").alias("w")).groupBy(*SEGMENT).agg(F.collect_list("w").alias("wanted"))
        cut = hot.join(asked, SEGMENT).select("segment", "wanted").mapInArrow(_slices(length), PLAIN_DDL)
        indexed = index_segments(cut, length).select("key", F.col("digest").alias("content"), F.col("low").alias("a"), F.col("high").alias("b"))
        hits = materialize(whole.unionByName(indexed), "repeat-piece-hits")
        found.append(pieces.join(hits, ["key", "content"]).select(*SEGMENT, (F.col("low") + F.col("a")).alias("low"), (F.col("low") + F.col("b")).alias("high")))
        if last:
            break
        rest = known.filter(F.col("different") > fit).select("at.*").groupBy(*SEGMENT).agg(F.collect_list(F.struct("low", "n")).alias("r"))
        rest = materialize(rest.select(*SEGMENT, F.col("r.low").alias("lows"), F.col("r.n").alias("counts")), "repeat-open")
        if rest.isEmpty():
            break
        level = hot.join(rest, SEGMENT)
    return functools.reduce(DataFrame.unionByName, found)


MARK_TYPE = "array<struct<start:int,end:int>>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = KGRAM, fit: int = FIT) -> DataFrame:
    """(doc_id, text, marks): marks are covered byte ranges, not yet merged; null where nothing repeats."""
    rows = _text_rows(docs, id_col, text_col)
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    anchors = materialize(anchor_table(rows, length, k), "repeat-anchors")
    # rows are counted by where they stand, so copies of a text count once; copied texts go whole below
    first = F.xxhash64("text_hash", F.col("starts")[0])
    final = F.xxhash64("text_hash", F.element_at("starts", -1))
    # written before it is joined: both sides of the join are then plain exchanges, whose skewed partitions can be split
    repeated = materialize(
        anchors.groupBy("anchor")
        .agg(F.min(F.least(first, final)).alias("one"), F.max(F.greatest(first, final)).alias("other"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        .filter("one <> other")
        .select("anchor", (F.col("low") != F.col("high")).alias("several")),
        "repeat-shared",
    )
    candidates = materialize(anchors.join(repeated, "anchor"), "repeat-candidates")
    at = F.min(F.struct("text_hash", F.col("starts")[0].alias("start")))
    contents = materialize(
        candidates.groupBy(*SEGMENT)
        .agg(F.min(F.least(first, final)).alias("one"), F.max(F.greatest(first, final)).alias("other"), F.first("several").alias("several"), at.alias("at"))
        .select(*SEGMENT, "several", "at", (F.col("one") != F.col("other")).alias("again")),
        "repeat-contents",
    )
    several = contents.filter("several")
    crowded = materialize(several.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > fit).select("anchor", F.lit(True).alias("hot")), "repeat-hot-anchors")
    n_crowded = crowded.count()
    marked = several.join(F.broadcast(crowded) if n_crowded <= BROADCAST_KEYS else crowded, "anchor", "left")
    asked = marked.select(
        F.col("at.text_hash").alias("text_hash"),
        F.struct(F.col("anchor").alias("key"), "digest", "windows", F.coalesce("hot", F.lit(False)).alias("hot"), F.col("at.start").alias("start"), (F.col("windows") + length - 1).alias("size")).alias("w"),
    )
    asked = materialize(asked.groupBy("text_hash").agg(F.collect_list("w").alias("wanted")), "repeat-wanted")
    texts = hashed.filter(F.octet_length("text") >= length)
    # one pass over the texts for hot anchors and others; segments are written, as both ways read them
    cut = materialize(texts.join(asked, "text_hash").select("text_hash", "text", "wanted").mapInArrow(_cutter, CUT_DDL), "repeat-segments")
    found = materialize(index_segments(cut.filter("not hot").drop("hot"), length).withColumnRenamed("key", "anchor"), "repeat-indexed")
    if n_crowded:
        hot = cut.filter("hot").select(F.col("key").alias("anchor"), "digest", "windows", "segment").dropDuplicates(SEGMENT)
        found = found.unionByName(_dealt_again(materialize(hot, "repeat-hot"), length, k, fit))
    parts = found.groupBy(*SEGMENT).agg(F.collect_list(F.struct("low", "high")).alias("parts"))
    whole = F.array(F.struct(F.lit(0).alias("low"), F.col("windows").alias("high")))
    verdict = materialize(
        contents.select(*SEGMENT, "again").join(parts, SEGMENT, "left").select(*SEGMENT, F.when(F.col("again"), whole).otherwise(F.col("parts")).alias("parts")).filter("parts is not null"),
        "repeat-verdicts",
    )
    marks = (
        candidates.join(verdict, SEGMENT)
        .select("text_hash", F.explode("starts").alias("start"), "parts")
        .select("text_hash", F.transform("parts", lambda p: F.struct((F.col("start") + p["low"]).alias("start"), (F.col("start") + p["high"] + length - 1).alias("end"))).alias("m"))
    )
    copied = hashed.select("text_hash", F.octet_length("text").alias("end")).filter(F.col("end") >= length).groupBy("text_hash", "end").count().filter("count > 1")
    copied = copied.select("text_hash", F.array(F.struct(F.lit(0).alias("start"), "end")).alias("m"))
    by_text = materialize(marks.unionByName(copied).groupBy("text_hash").agg(F.flatten(F.collect_set("m")).alias("marks")), "repeat-marks")
    return hashed.join(by_text, "text_hash", "left").select("doc_id", "text", "marks")


def merge_marks(starts, ends) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the half-open ranges."""
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    head = np.flatnonzero(new)
    return list(zip(s[head].tolist(), e[np.append(head[1:], len(s)) - 1].tolist()))


def _finisher(with_text: bool):
    def run(batches):
        for batch in batches:
            spans_out, digests, sizes, removed, kept_texts = [], [], [], [], []
            marks = batch.column(2)
            offsets, values = marks.offsets.to_numpy(), marks.values
            lows, highs = values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False)
            for i, text in enumerate(texts_as_bytes(batch.column(1))):
                a, b = int(offsets[i]), int(offsets[i + 1])
                spans = merge_marks(lows[a:b], highs[a:b]) if b > a else []
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                left = b"".join(kept)
                sizes.append(len(text)), removed.append(len(text) - len(left)), digests.append(hashlib.sha256(left).hexdigest())
                spans_out.append([{"start": s, "end": e} for s, e in spans])
                kept_texts.append(left.decode("utf-8", "ignore") if with_text else None)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_out, kind), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True, **more) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept_text); kept_text leaves out characters cut in the middle."""
    found = repeated_spans(docs, id_col, text_col, length, **more)
    return found.mapInArrow(_finisher(with_text), f"doc_id long, n_bytes long, n_removed long, spans {MARK_TYPE}, kept_sha256 string, kept_text string")


def op5_repeated_strings(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
