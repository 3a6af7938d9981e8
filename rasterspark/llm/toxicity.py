"""Toxicity by a classifier chain: linear models predict the categories in turn, each with the probabilities of the
categories before it among its inputs. Those inputs are out-of-fold predictions while the chain is trained.

All categories come from the labels: `overt` is what the label calls toxic, told by few and strong marks; `veiled` the
toxic documents that this model misses when they are held out (a rarer language, a rarer wording), so marks are chosen
for them alone; `toxic` the label again, from marks of its own and both probabilities. A document's marks are its words
and the prefixes that several of its words share, so that a family of inflected words counts though each form is rare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import broadcast_if_small, hash_share, read_table, small_batches
from .words import Piece, mix, pieces

#: Most labelled documents that a fit takes, those with the least hashes of doc_id.
MAX_ROWS = 8_000
BUCKETS = 1 << 20
FOLDS, LEAST_DOCS, LEAST_Z, RIDGE = 3, 3, 4.5, 0.2
#: Lengths in bytes of the prefixes of longer words.
PREFIXES = (5, 7)
#: Categories in the order of the chain, and most marks of each.
CHAIN = {"overt": 20, "veiled": 256, "toxic": 256}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def prefix_buckets(piece: Piece, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words with more bytes than length, and the buckets of their first bytes."""
    at = np.flatnonzero(piece.word_end - piece.word_at > length)
    h = np.full(len(at), length, np.uint64)
    for j in range(length):
        h = h * np.uint64(0x100000001B3) + piece.folded[piece.word_at[at] + j].astype(np.uint64)
    return at, buckets_of(mix(h))


def marks(piece: Piece, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents and buckets (those wanted) of their words, and of the prefixes of two or more different words there."""
    words = buckets_of(piece.hashes)
    use = slice(None) if wanted is None else wanted[words]
    docs, buckets = [piece.word_doc[use]], [words[use]]
    for length in PREFIXES:
        at, prefix = prefix_buckets(piece, length)
        if wanted is not None:
            at, prefix = at[wanted[prefix]], prefix[wanted[prefix]]
        pairs = np.unique(piece.word_doc[at] * BUCKETS * BUCKETS + prefix * BUCKETS + words[at]) // BUCKETS
        twice = np.unique(pairs[1:][pairs[1:] == pairs[:-1]])
        docs.append(twice // BUCKETS)
        buckets.append(twice % BUCKETS)
    return np.concatenate(docs), np.concatenate(buckets)


def distinct_buckets(batches):
    """Replaces the last column, a text, by the distinct buckets of its marks."""
    for batch in batches:
        found = []
        for piece in pieces(batch.column(batch.num_columns - 1)):
            docs, buckets = marks(piece)
            pairs = np.unique(docs * BUCKETS + buckets)
            firsts = np.searchsorted(pairs, np.arange(piece.docs + 1) * BUCKETS)
            found += [(pairs[a:b] % BUCKETS).astype(np.int32) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "words"])


def telling_words(owner: np.ndarray, words: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Buckets that most set the category's documents apart, by the test of two proportions.

    A bucket counts from LEAST_DOCS of the category's documents on, near copies left out, whatever their share: a
    language with few of the documents has marks of its own.
    """
    ones, zeros = max(y.sum(), 1e-9), max(len(y) - y.sum(), 1e-9)
    n = np.bincount(words, minlength=BUCKETS).astype(np.float64)
    a = np.bincount(words, y[owner], BUCKETS)
    p = n / len(y)
    z = np.abs(a / ones - (n - a) / zeros) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / ones + 1 / zeros))
    z[(a < LEAST_DOCS) | (a / ones < (n - a) / zeros) | (z < LEAST_Z)] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 0])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the intercept last, by Newton steps with a ridge on all but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(25):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def presence(owner: np.ndarray, words: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    at = np.full(BUCKETS, -1, np.int64)
    at[chosen] = np.arange(len(chosen))
    column = at[words]
    out = np.zeros((n, len(chosen)))
    out[owner[column >= 0], column[column >= 0]] = 1
    return out


def one_of_copies(words: list[np.ndarray], y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Leaves one of the documents whose three least buckets (scrambled) agree: near copies would teach their wording."""
    prints = [tuple(np.sort((w.astype(np.int64) * 0x9E3779B1) % (1 << 32))[:3].tolist()) for w in words]
    keep = list({p if p else i: i for i, p in reversed(list(enumerate(prints)))}.values())[::-1]
    return [words[i] for i in keep], y[keep]


def fit_chain(words: list[np.ndarray], toxic: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each category: its buckets, and weights for them, for the categories before, and the intercept."""
    words, toxic = one_of_copies(words, toxic)
    n = len(words)
    owner = np.repeat(np.arange(n), [len(w) for w in words])
    flat = np.concatenate([np.zeros(0, np.int64), *words]).astype(np.int64)
    fold, before, chain = np.arange(n) % FOLDS, np.zeros((n, 0)), []
    for name, most in CHAIN.items():
        y, out_of_fold = (toxic * (before[:, 0] < 0.5) if name == "veiled" else toxic), np.zeros(n)
        for k in range(FOLDS):
            train, rows = fold != k, np.flatnonzero(fold != k)
            if not len(rows):
                continue
            place = np.cumsum(train) - 1
            use = train[owner]
            chosen = telling_words(place[owner[use]], flat[use], y[train], most)
            w = logistic(np.column_stack([presence(owner, flat, n, chosen)[train], before[train]]), y[train])
            x = np.column_stack([presence(owner, flat, n, chosen)[~train], before[~train]])
            out_of_fold[~train] = sigmoid(x @ w[:-1] + w[-1])
        chosen = telling_words(owner, flat, y, most) if n else np.zeros(0, np.int64)
        chain.append((chosen, logistic(np.column_stack([presence(owner, flat, n, chosen), before]), y)))
        before = np.column_stack([before, out_of_fold])
    return chain


def chain_scorer(shared):
    def score(batches):
        chain = shared.value
        table = np.full(BUCKETS, False)
        for chosen, _ in chain:
            table[chosen] = True
        for batch in batches:
            found = []
            for piece in pieces(batch.column(batch.num_columns - 1)):
                owner, words = marks(piece, table)
                before = np.zeros((piece.docs, 0))
                for chosen, w in chain:
                    at = np.minimum(np.searchsorted(chosen, words), max(len(chosen) - 1, 0))
                    inside = chosen[at] == words if len(chosen) else np.zeros(len(words), bool)
                    pairs = np.unique(owner[inside] * max(len(chosen), 1) + at[inside])
                    total = np.bincount(pairs // max(len(chosen), 1), w[pairs % max(len(chosen), 1)], piece.docs) if len(pairs) else np.zeros(piece.docs)
                    total = total + before @ w[len(chosen) : -1] + w[-1]
                    before = np.column_stack([before, sigmoid(total)])
                found.append(before)
            all_p = np.concatenate([np.zeros((0, len(chain))), *found])
            yield pa.record_batch([*batch.columns[:-1], *[pa.array(all_p[:, k]) for k in range(len(chain))]], names=[*batch.schema.names[:-1], *[f"p_{c}" for c in CHAIN]])

    return score


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[np.ndarray, np.ndarray]]:
    """A chain fitted on at most max_rows labelled documents. Labels without an id or toxic teach nothing; of labels
    that share a doc_id the largest counts. Without any label all probabilities are one half."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # some labels have no document: twice as many labels as rows are looked up
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    picked = hash_share(known, "doc_id", known.count(), 2 * max_rows).orderBy(order).limit(2 * max_rows)
    sample = texts.join(broadcast_if_small(picked, 2 * max_rows), "doc_id").select("doc_id", "y", "text")
    rows = sample.mapInArrow(distinct_buckets, "doc_id long, y int, words array<int>").orderBy(order, "words").limit(max_rows).toPandas()
    return fit_chain([np.asarray(w, np.int64) for w in rows["words"]], (rows["y"].to_numpy() > 0).astype(np.float64))


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, p_ of each category of the chain, toxic (p_toxic at least threshold).

    Null and empty texts have no words and get the chain's intercepts. No rows give no rows; rows that share a doc_id
    are scored one by one; other columns are not read.
    """
    chain = train(docs, labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    scored = rows.mapInArrow(chain_scorer(shared), "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN))
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the chain finds not toxic, all columns kept; the texts are read in place, without a join.

    Null and empty texts stay unless the chain's intercepts alone say toxic. Rows that repeat are judged one by one, alike
    if their texts are; rows without a doc_id are judged too, but teach nothing. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))
    schema = StructType().add("row", docs.schema, False)
    for c in CHAIN:
        schema = schema.add(f"p_{c}", "double")
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(chain_scorer(shared), schema).where(F.col("p_toxic") < threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
