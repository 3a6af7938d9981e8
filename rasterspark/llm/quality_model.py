"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, read_table, saved, small_batches
from .doc_stats import COUNTS, STATS_SCHEMA, counted

#: Most labelled rows that a fit takes, those with the least hashes of doc_id.
MAX_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LEAST, RIDGE = 64, 4, 80, 0.1, 20, 1.0


def features(count: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of statistics that don't name the document, its language or its source."""
    c = {k: count[k].astype(np.float64) for k in COUNTS}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.log1p(c["n_lines"]),
        c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_punct"] / chars, c["n_wide"] / chars, c["n_stops"] / words, words / lines, np.log1p(c["longest_line"]), c["n_punct"] / words,
    ])


@dataclass
class Trees:
    """Complete trees of one depth, level by level: arrays of (tree, inner node) and (tree, leaf)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (len(cut))]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting on the logistic loss with histograms of at most BINS quantile bins a feature."""
    n, width = x.shape
    rate = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base, inner = float(np.log(rate / (1 - rate))), 2**DEPTH - 1
    least = max(1, min(LEAST, n // 8))  # rows of a leaf; fewer where there are few in all
    if not n or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    total = np.full(n, base)
    features_, cuts_, leaves_ = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, nodes = 2**depth - 1, 2**depth
            key = ((node - first)[:, None] * width + np.arange(width)) * BINS + binned
            sums = [np.bincount(key.ravel(), np.repeat(w, width), nodes * width * BINS).reshape(nodes, width, BINS) for w in (grad, hess, np.ones(n))]
            g, h, c = (s.cumsum(axis=2) for s in sums)
            all_g, all_h, all_c = (s[:, :, -1:] for s in (g, h, c))
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(c < least) | (all_c - c < least)] = -np.inf
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, at = divmod(int(b), BINS)
                if gain[k, f, at] > 1e-6 and at < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][at]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf_g, leaf_h = np.bincount(node - inner, grad, inner + 1), np.bincount(node - inner, hess, inner + 1)
        leaf = -RATE * leaf_g / (leaf_h + RIDGE)
        total += leaf[node - inner]
        features_.append(feature)
        cuts_.append(cut)
        leaves_.append(leaf)
    return Trees(base, np.array(features_), np.array(cuts_), np.array(leaves_))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def scorer(shared):
    def score(batches):
        for batch in batches:
            count = {c: np.asarray(batch.column(c)) for c in COUNTS}
            yield pa.record_batch([batch.column("doc_id"), pa.array(Trees(*shared.value).score(features(count)))], names=["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5).

    Fitted on at most max_rows labelled documents that are not held out. Labels without an id or quality teach nothing;
    of labels that share a doc_id the largest counts. Null and empty texts are scored like any other; without labels of
    both kinds, all scores are the share of label 1 (0.5 if there are none). No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = saved(rows.mapInArrow(counted, f"doc_id long, {STATS_SCHEMA}"), "doc-stats")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    # labels may have no document, and documents more rows than one: the rows that can teach are counted
    labelled = counts.join(known, "doc_id")
    few = hash_share(labelled, "doc_id", labelled.count(), max_rows)
    sample = few.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), *COUNTS).limit(max_rows).toPandas()
    trees = fit(features({c: sample[c].to_numpy() for c in COUNTS}), (sample["y"].to_numpy() > 0).astype(np.float64))
    scored = counts.mapInArrow(scorer(spark.sparkContext.broadcast((trees.base, trees.feature, trees.cut, trees.leaf))), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
