"""Sets of word shingles as sorted 64-bit hashes, and their rarest members.

Words are cut at ASCII white space and lower-cased (A-Z).  Two sets of
similarity ``least`` or more share a shingle among the first
``n - ceil(least n) + 1`` of each, in any order of all shingles that is the same
for both.  The order here puts shingles that many texts hold last; which those
are is counted within runs of texts and need not be exact, as every order finds
every pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.docstats import each_text
from quillspan.workspace import in_batches

SEED = 42
SHINGLE = 5
#: Shingles known as common: 16 bytes each on the driver and in each worker.
COMMON = 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_RUN = 1 << 22
_FLUSH = 1 << 20


def shingle_set(text: bytes, known: dict[bytes, int], width: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes in ascending order; ``known`` keeps word hashes. Shorter texts are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    size = min(width, len(words))
    key = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        key = key * _FACTOR + h[k : len(key) + k]
    return np.unique(key.view(np.int64))


def node_of(shingles: np.ndarray) -> int:
    """Equal for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(n * least - 1e-9) + 1 if n else 0


def sets_of(column, width: int = SHINGLE):
    """The set of each text of an Arrow column."""
    known: dict[bytes, int] = {}
    for text in each_text(column):
        yield shingle_set(text, known, width)
        if len(known) > _FLUSH:
            known.clear()


def counted(h: np.ndarray, least_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that ``h`` holds at least so often, ascending, and how often; ``h`` is sorted where it lies."""
    h.sort()
    if len(h) < least_count:
        return h[:0], np.zeros(0, np.int64)
    # a run that is long enough has its value again least_count - 1 places on
    long = np.flatnonzero(h[: len(h) - least_count + 1] == h[least_count - 1 :])
    values = h[long]
    first = np.append(True, values[1:] != values[:-1])[: len(values)]
    starts = np.flatnonzero(first)
    return values[first], np.diff(np.append(starts, len(values))) + least_count - 1


def _counter(width: int, least_count: int):
    def run(batches):
        # one array holds a run: its sets lie neither apart nor a second time
        kept, size = np.empty(_RUN, np.int64), 0

        def found():
            h, n = counted(kept[:size], least_count)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for s in sets_of(batch.column(0), width):
                if size + len(s) > len(kept):
                    kept.resize(size + len(s), refcheck=False)
                kept[size : size + len(s)] = s
                size += len(s)
                if size > _RUN:
                    yield found()
                    size = 0
        if size:
            yield found()

    return run


def common_shingles(texts: DataFrame, width: int = SHINGLE, least_count: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, counts) of the ``COMMON`` most frequent shingles of a table of one text column."""
    counted = in_batches(texts, _counter(width, least_count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "h").limit(COMMON).toPandas().sort_values("h")
    return found["h"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def rarest(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The prefix of a set in the common order."""
    hashes, counts = common
    if len(shingles) and len(hashes):
        slot = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        shingles = shingles[np.argsort(np.where(hashes[slot] == shingles, counts[slot], 0), kind="stable")]
    return shingles[: prefix_length(len(shingles), least)]
