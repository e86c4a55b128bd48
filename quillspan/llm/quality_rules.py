"""Quality rules with an isolation forest.

Rule statistics of every document are computed in one pass.  Two hard rules
reject a document outright; the others are judged together: an isolation forest
grown on a sample of the statistics gives each document an anomaly score from
its path lengths, and the score above which a document goes is calibrated on
the labelled rows.

The sample is bounded (``TREES * SAMPLE_PER_TREE`` rows, those with the smallest
hash of their id), calibration sees a histogram of all labelled rows with
``BINS`` bins, and everything else covers all documents.  Null and empty texts
have no words and fail the base rules.  Without labels no document is rejected
by its score.  Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.docstats import each_text, rule_statistics
from quillspan.llm.sampling import smallest_hashes
from quillspan.workspace import in_batches, materialize, table

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, upper_permille long"
MIN_WORDS = 50
TREES = 100
SAMPLE_PER_TREE = 256
BINS = 1000
MAX_GOOD_LOSS = 0.002
WORD_CHARS = (3.0, 10.0)
UPPER_ALLOWED = 0.1
LINES_ALLOWED = 3
REPEATS_ALLOWED = 0.3

_UPPER = bytes(range(65, 91))


def _row(text: bytes) -> tuple[int, ...]:
    stats = rule_statistics(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    return (*stats, 1000 * upper // max(1, stats[1]))


def _measure(batches):
    names = ["doc_id", *STATS, "upper_permille"]
    for batch in batches:
        rows = [_row(text) for text in each_text(batch.column(1))]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)


def rule_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics) over whole texts."""
    return in_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _measure, STATS_DDL)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features(x: np.ndarray) -> np.ndarray:
    """How far each rule's statistic lies outside what sound text shows anyway.

    Short sound texts vary most: a line that comes back, a long word, a few
    capitals.  Inside the allowances below a statistic says nothing, so the
    forest sees 0 there and the excess beyond.
    """
    n = np.maximum(x[:, 0], 1.0)
    per_word = x[:, 1] / n
    outside = np.maximum(per_word - WORD_CHARS[1], 0) + np.where(x[:, 0] > 0, np.maximum(WORD_CHARS[0] - per_word, 0), 0)
    lines = np.maximum(x[:, 3] - LINES_ALLOWED, 0) / n
    repeats = np.maximum(x[:, 4] / n - REPEATS_ALLOWED, 0)
    upper = np.maximum(x[:, 5] / 1000.0 - UPPER_ALLOWED, 0)
    return np.column_stack([outside, x[:, 2] / n, lines, repeats, upper])


def path_normaliser(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of ``n`` rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow_forest(x: np.ndarray, trees: int = TREES, per_tree: int = SAMPLE_PER_TREE, seed: int = 7) -> dict:
    """Random splits over samples, flattened into arrays: feature (-1 leaf), split, left child, path length at leaves."""
    rng = np.random.default_rng(seed)
    out = {"feature": [], "split": [], "left": [], "length": [], "root": []}

    def node(**kw) -> int:
        for k in ("feature", "split", "left", "length"):
            out[k].append(kw.get(k, 0))
        return len(out["feature"]) - 1

    size = min(per_tree, len(x))
    limit = int(np.ceil(np.log2(max(2, size))))
    for _ in range(trees if len(x) > 1 else 0):
        rows = x[rng.choice(len(x), size, replace=False)]
        root = node()
        out["root"].append(root)
        todo = [(root, rows, 0)]
        while todo:
            at, own, depth = todo.pop()
            spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(x.shape[1])
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(own) <= 1 or not len(usable):
                out["feature"][at], out["length"][at] = -1, depth + path_normaliser(len(own))
                continue
            f = int(rng.choice(usable))
            cut = own[:, f].min() + rng.random() * spread[f]
            left = node()
            node()
            out["feature"][at], out["split"][at], out["left"][at] = f, float(cut), left
            todo += [(left, own[own[:, f] < cut], depth + 1), (left + 1, own[own[:, f] >= cut], depth + 1)]
    return {k: np.array(v) for k, v in out.items()} | {"scale": path_normaliser(size) or 1.0, "depth": limit}


def anomaly_score(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path), in (0, 1); higher is stranger. No trees: 0."""
    total = np.zeros(len(x))
    if not len(forest["root"]) or not len(x):
        return total
    rows = np.arange(len(x))
    for root in forest["root"]:
        at = np.full(len(x), root)
        for _ in range(forest["depth"]):
            f = forest["feature"][at]
            go = f >= 0
            if not go.any():
                break
            right = x[rows, np.maximum(f, 0)] >= forest["split"][at]
            at = np.where(go, forest["left"][at] + right, at)
        total += forest["length"][at]
    return 2.0 ** (-(total / len(forest["root"])) / forest["scale"])


def _scorer(forest: dict):
    def run(batches):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float).reshape(batch.num_rows, -1)
            score = anomaly_score(forest, _features(x)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "anomaly"])

    return run


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """Threshold on the anomaly score from labelled rows (quality 1 good, 0 bad).

    Of all bin edges that lose at most ``MAX_GOOD_LOSS`` of the good rows, the
    one with the best balance of rejected bad and kept good rows (the middle
    one where several are best); infinity when one of the classes is missing.
    """
    rows = (
        scored.join(labels.filter("quality is not null").groupBy(F.col("doc_id")).agg(F.max("quality").alias("quality")), "doc_id")
        .groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
        .collect()
    )
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in rows:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return float("inf")
    lost = good[::-1].cumsum()[::-1] / good.sum()
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    value = np.where(lost <= MAX_GOOD_LOSS, caught - lost, -1.0)
    best = np.flatnonzero(value == value.max())
    return float(best[len(best) // 2]) / BINS if value.max() > 0 else float("inf")


def train(stats: DataFrame, labels: DataFrame | None, trees: int = TREES, per_tree: int = SAMPLE_PER_TREE) -> tuple[dict, DataFrame, float]:
    """(forest, scored statistics, threshold).

    The base rules already remove the short and the repetitive, so the forest
    models what passes them.
    """
    sample = smallest_hashes(stats.filter(~base_failed()), "doc_id", trees * per_tree, 11).drop("doc_id").toPandas().to_numpy(float)
    forest = grow_forest(_features(sample.reshape(-1, 6)), trees, per_tree)
    scored = materialize(stats.mapInArrow(_scorer(forest), STATS_DDL + ", anomaly double"), "rule-scores")
    threshold = calibrate(scored.filter(~base_failed()), labels) if labels is not None else float("inf")
    return forest, scored, threshold


def judge(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Statistics, base_failed, anomaly score and kept for each document."""
    _, scored, threshold = train(materialize(rule_table(docs, id_col, text_col), "rule-stats"), labels, **more)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & (F.col("anomaly") < F.lit(threshold)))


def _keeper(forest: dict, threshold: float, at: int):
    def run(batches):
        for batch in batches:
            x = np.array([_row(t) for t in each_text(batch.column(at))], dtype=float).reshape(batch.num_rows, 6)
            failed = (x[:, 0] < MIN_WORDS) | (100 * x[:, 4] > 50 * x[:, 0])
            keep = ~failed
            keep[keep] = anomaly_score(forest, _features(x[keep])) < threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns.

    Statistics are taken again while filtering: that costs a second pass over
    the text but no shuffle of it, and needs no unique ids.
    """
    forest, _, threshold = train(materialize(rule_table(docs, id_col, text_col), "rule-stats"), labels, **more)
    return in_batches(docs, _keeper(forest, threshold, docs.columns.index(text_col)), docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdict on every document."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *STATS, "base_failed", "kept", "anomaly")
