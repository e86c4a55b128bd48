"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text alone (language, source, id and labels are
never inputs).  Trees grow level by level from gradient histograms over binned
columns and are flattened into arrays, which a vectorised numpy traversal walks
for a batch of rows at once.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash
of their id among rows whose crc32(id) mod 3 is not 1; scoring covers every
document.  Null and empty texts have all-zero statistics and get a score too.
Several labels of one id: the largest counts.  Without both classes every score
is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.docstats import SPACES, repeated_window_words, texts_as_bytes
from quillspan.llm.sampling import smallest_hashes
from quillspan.workspace import materialize, table

TRAIN_ROWS = 50_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
RIDGE = 1.0

FEATURES = (
    "log_words", "chars_per_word", "short_words", "long_words", "distinct_words", "repeat_words", "dup_lines", "words_per_line", "symbols", "pipes",
    "exclamations", "upper", "digits", "commas", "stops", "quotes", "non_ascii", "title_words", "top_word", "brackets",
)
_CLASSES = {
    "symbols": b"#*$%&<>=_~^\\", "pipes": b"|", "exclamations": b"!?", "upper": bytes(range(65, 91)), "digits": b"0123456789", "commas": b",;:", "stops": b".",
    "quotes": b"\"'", "non_ascii": bytes(range(0xC0, 0x100)), "brackets": b"()[]{}",
}


def statistics(text: bytes) -> list[float]:
    """One number per name in FEATURES."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.int32, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    size = int(lengths.sum())
    share = {k: (len(text) - len(text.translate(None, v))) / size for k, v in _CLASSES.items()}
    values = {
        "log_words": np.log1p(n), "chars_per_word": size / n, "short_words": float((lengths <= 3).mean()), "long_words": float((lengths >= 12).mean()), "distinct_words": len(counts) / n,
        "repeat_words": repeated_window_words(words) / n, "dup_lines": (len(lines) - len(set(lines))) / len(lines), "words_per_line": np.log1p(n / len(lines)),
        "title_words": sum(map(bytes.istitle, words)) / n, "top_word": max(counts.values()) / n, **share,
    }
    return [float(values[k]) for k in FEATURES]


def _measure(batches):
    for batch in batches:
        x = np.array([statistics(t) for t in texts_as_bytes(batch.column(1))], dtype=np.float32).reshape(batch.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])


STATS_DDL = "doc_id long, " + ", ".join(f"{k} float" for k in FEATURES)


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, FEATURES) over whole texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measure, STATS_DDL)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Complete trees as arrays: ``feature`` and ``edge`` of inner nodes in level order, ``leaf`` values."""
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or mean in (0.0, 1.0):
        return {"bias": float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), "feature": np.zeros((0, 0), int), "edge": np.zeros((0, 0)), "leaf": np.zeros((0, 1)), "depth": 0}
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    width = x.shape[1]
    raw = np.full(len(y), np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    out = {"bias": float(raw[0]), "feature": [], "edge": [], "leaf": [], "depth": depth}
    slots = binned + np.arange(width) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        feature, edge = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            nodes = 2**level
            flat = (at[:, None] * (width * BINS) + slots).ravel()
            size = nodes * width * BINS
            hg = np.bincount(flat, np.repeat(g, width), size).reshape(nodes, width, BINS).cumsum(axis=2)
            hh = np.bincount(flat, np.repeat(h, width), size).reshape(nodes, width, BINS).cumsum(axis=2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + RIDGE) + (tg - hg) ** 2 / (th - hh + RIDGE) - tg**2 / (th + RIDGE)
            gain[(hh < 2) | (th - hh < 2)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            cut = np.full(nodes, BINS)
            for k in range(nodes):
                if gain[k, f[k], b[k]] > 1e-6 and b[k] < len(edges[f[k]]):
                    feature[nodes - 1 + k], edge[nodes - 1 + k], cut[k] = f[k], edges[f[k]][b[k]], b[k]
            at = at * 2 + (binned[np.arange(len(y)), f[at]] > cut[at])
        lg, lh = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf = -rate * lg / (lh + RIDGE)
        raw += leaf[at]
        out["feature"].append(feature)
        out["edge"].append(edge)
        out["leaf"].append(leaf)
    return out | {k: np.array(out[k]) for k in ("feature", "edge", "leaf")}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores in (0, 1) of all rows, level by level through the flattened trees."""
    raw = np.full(len(x), model["bias"])
    rows = np.arange(len(x))
    for feature, edge, leaf in zip(model["feature"], model["edge"], model["leaf"]):
        at = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            at = 2 * at + 1 + (x[rows, feature[at]] > edge[at])
        raw += leaf[at - (len(leaf) - 1)]
    return 1 / (1 + np.exp(-raw))


def _scorer(model: dict):
    def run(batches):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predict(model, x))], names=["doc_id", "score"])

    return run


def train(stats: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    known = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).filter(~held_out())
    sample = smallest_hashes(materialize(stats.join(known, "doc_id"), "gbt-labelled"), "doc_id", rows, 13).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(float), sample["quality"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every document."""
    stats = materialize(statistics_table(docs, id_col, text_col), "gbt-stats")
    return stats.mapInArrow(_scorer(train(stats, labels)), "doc_id long, score double")


def op4_quality_gbt(spark, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
