"""Hard-negative mining with Kronecker-packed products.

Components are integers, floor(256 * x). Several candidates share one wide integer: each one's component, biased so that
none is negative, lies in a field of its own, wide enough for a whole score. A product with an anchor's component
multiplies all fields at once, and the sum over the components holds an exact score in each field.

Anchors (a stated query set) meet all rows twice, for their positives and then for the negatives below them: blocks of
anchors are copied to slots of rows. A task keeps only the best few of what it has seen for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, saved, small_batches

#: Factor of the components; ids of anchors, and of rows whose label moves on by one, are divisible by these.
SCALE, ANCHORS, MOVED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Least and greatest score of a negative in hundredths of its positive's.
LOW, HIGH = 30, 90
#: Anchors in a block, and rows in a slot that a copy of a block meets.
BLOCK, SLOT = 4096, 4096
#: Bits of a plain word, and fields of a wide one.
WORD, WIDE_FIELDS = 64, 4
_LONG = 2**63 - 1


@dataclass(frozen=True)
class Packing:
    """dim: components of a row. bias: no component is below -bias. field: bits of a score with its sign."""

    dim: int
    bias: int
    field: int

    @classmethod
    def of(cls, dim: int, largest: float, norm: float) -> Packing:
        """largest: of all |x|; norm: of the sums of squared components, which bounds the scores."""
        bias = SCALE * (math.floor(largest) + 1)
        bound = dim * bias * bias
        if math.isfinite(norm):
            bound = min(bound, math.floor(norm * (1 + 1e-9)) + 1)
        return cls(dim, bias, bound.bit_length() + 1)

    @property
    def plain(self) -> bool:
        """Scores fit 64 bits; else Python's integers of any width hold the fields."""
        return self.field <= WORD and self.bias < 2**62

    @property
    def fields(self) -> int:
        return WORD // self.field if self.plain else WIDE_FIELDS

    def components(self, values: np.ndarray) -> np.ndarray:
        if self.plain:
            return np.floor(SCALE * values).astype(np.int64)
        # a double is a fraction over a power of two, so this is exact where 256 * x overflows, too
        whole = [SCALE * n // d for n, d in (float(x).as_integer_ratio() for x in values.ravel())]
        return np.array(whole, object).reshape(values.shape)

    def words(self, rows: np.ndarray) -> np.ndarray:
        """(n, dim) components -> (ceil(n / fields), dim) words; field f of word k is row fields * k + f."""
        n = -(-len(rows) // self.fields)
        biased = np.full((n * self.fields, self.dim), self.bias, np.int64 if self.plain else object)
        biased[: len(rows)] += rows
        if self.plain:
            return sum(biased[f :: self.fields].astype(np.uint64) << np.uint64(self.field * f) for f in range(self.fields))
        return sum(biased[f :: self.fields] * (1 << self.field * f) for f in range(self.fields))

    def scores(self, anchors: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """(m, dim) components of anchors and words of n rows -> (m, n) exact inner products (beyond a long: the nearest)."""
        ones, half, mask = sum(1 << self.field * f for f in range(self.fields)), 1 << (self.field - 1), (1 << self.field) - 1
        out = np.empty((len(anchors), len(words), self.fields), np.int64)
        # field f of the sum of products is score + bias * sum(anchor); moved to score + half, so that no field borrows
        if self.plain:  # all modulo 2 ** 64
            total = np.matmul(anchors.astype(np.uint64), words.T)
            total -= ((anchors.sum(axis=1).astype(np.uint64) * np.uint64(self.bias) - np.uint64(half)) * np.uint64(ones))[:, None]
            for f in range(self.fields):
                out[:, :, f] = ((total >> np.uint64(self.field * f) & np.uint64(mask)) - np.uint64(half)).view(np.int64)
        else:
            total = np.dot(anchors, words.T) - ((anchors.sum(axis=1) * self.bias - half) * ones)[:, None]
            for f in range(self.fields):
                out[:, :, f] = np.clip((total // (1 << self.field * f)) % (mask + 1) - half, -_LONG, _LONG).astype(np.int64)
        return out.reshape(len(anchors), -1)[:, :n]


class Best:
    """The k best (highest score, then least id) of what each of some slots has been offered."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id, self.full = np.full((slots, k), -_LONG - 1), np.zeros((slots, k), np.int64), np.zeros((slots, k), bool)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        of = np.unique(slots)
        held = np.zeros(self.full.shape, bool)
        held[of] = self.full[of]
        slots = np.concatenate([np.nonzero(held)[0], slots])
        scores, ids = np.concatenate([self.score[held], scores]), np.concatenate([self.id[held], ids])
        order = np.lexsort((ids, ~scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        some = place < self.k
        for mine, new in ((self.score, scores), (self.id, ids), (self.full, np.ones(len(ids), bool))):
            mine[slots[some], place[some]] = new[some]

    def least(self) -> np.ndarray:
        """The score that a slot's next row must reach; the least of all while there is room."""
        return self.score[:, -1]


def vectors(lists: pa.Array, dim: int) -> np.ndarray:
    """Shorter vectors are filled up with zeros."""
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < np.asarray(lists.value_lengths())[:, None]] = np.asarray(lists.flatten())
    return out


class Anchors:
    """A block of anchors and the best rows of their label."""

    NAMES = ("number", "anchor_id", "score", "id")

    def __init__(self, packing: Packing, rows: pa.Table, k: int):
        self.packing = packing
        self.number, self.id, self.label = (np.asarray(rows[c].combine_chunks()) for c in ("number", "id", "label"))
        self.parts = packing.components(vectors(rows["vector"].combine_chunks(), packing.dim))
        self.start(rows, k)

    def start(self, rows: pa.Table, k: int) -> None:
        self.best = Best(len(self.id), k)

    def meet(self, rows: pa.RecordBatch) -> None:
        number, ids, label = (np.asarray(rows.column(rows.schema.get_field_index(c))) for c in ("number", "id", "label"))
        self.choose(number, ids, label, self.packing.components(vectors(rows.column(rows.schema.get_field_index("vector")), self.packing.dim)))

    def choose(self, number, ids, label, parts) -> None:
        for x in np.intersect1d(self.label, label):
            a, c = np.flatnonzero(self.label == x), np.flatnonzero(label == x)
            scores = self.packing.scores(self.parts[a], self.packing.words(parts[c]), len(c))
            i, j = np.nonzero((scores >= self.best.least()[a][:, None]) & (self.number[a][:, None] != number[c]))
            self.best.offer(a[i], scores[i, j], ids[c[j]])

    def told(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.best.full)
        return pa.record_batch([pa.array(c) for c in (self.number[slot], self.id[slot], self.best.score[slot, place], self.best.id[slot, place])], names=list(self.NAMES))


class Positives(Anchors):
    """A block of anchors with their positives, and each one's best rows of other labels between its bounds."""

    NAMES = ("number", "positive", "anchor_id", "positive_id", "positive_score", "score", "id")

    def start(self, rows: pa.Table, k: int) -> None:
        lists = rows["positives"].combine_chunks()
        self.anchor = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        flat = lists.flatten()
        self.positive, self.positive_id, self.positive_score = (np.asarray(flat.field(c)) for c in ("positive", "id", "score"))
        exact = self.positive_score.tolist()
        self.low, self.high = (np.array(x, np.int64) for x in ([-(-LOW * s // 100) for s in exact], [HIGH * s // 100 for s in exact]))
        self.best = Best(len(self.anchor), k)

    def choose(self, number, ids, label, parts) -> None:
        scores = self.packing.scores(self.parts, self.packing.words(parts), len(ids))
        other = self.label[:, None] != label
        for p in np.unique(self.positive):  # an anchor has one positive of each place at most
            at = np.flatnonzero(self.positive == p)
            of = self.anchor[at]
            mine = scores[of]
            i, j = np.nonzero(other[of] & (mine >= np.maximum(self.low[at], self.best.least()[at])[:, None]) & (mine <= self.high[at][:, None]))
            self.best.offer(at[i], mine[i, j], ids[j])

    def told(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.best.full)
        a = self.anchor[slot]
        cols = (self.number[a], self.positive[slot], self.id[a], self.positive_id[slot], self.positive_score[slot], self.best.score[slot, place], self.best.id[slot, place])
        return pa.record_batch([pa.array(c) for c in cols], names=list(self.NAMES))


def miner(packing: Packing, kind: type[Anchors], k: int) -> Callable:
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, slot and role: a block's anchors (role 0), then the slot's rows (role 1)."""
        state, block, slot, held = None, None, None, []
        for batch in batches:
            keys = [np.asarray(batch.column(c)) for c in range(3)]
            cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in keys])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                here, part = (int(keys[0][a]), int(keys[1][a])), batch.slice(a, b - a)
                if keys[2][a] == 0:
                    if here != slot:
                        slot, held = here, []
                    held.append(part)
                elif here == slot:  # rows whose block has no anchors find nothing
                    if block != here[0]:
                        if state:
                            yield state.told()
                        state, block = kind(packing, pa.Table.from_batches(held), k), here[0]
                    state.meet(part)
        if state:
            yield state.told()

    return mine


def labelled_vectors(rows: DataFrame) -> DataFrame:
    """id, label, vector of the rows that take part, their labels moved as the contract of the query says."""
    vector = F.col("embedding")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull()).where(whole)
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return some.select(vec_id.alias("id"), F.when(vec_id % MOVED == 0, (label + 1) % LABELS).otherwise(label).alias("label"), vector.alias("vector"))


def mine_negatives(rows: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows: id, label (long), vector (array of numbers) -> for each anchor (id divisible by `every`) and positive (the
    best rows of its label) the best rows of other labels within LOW to HIGH hundredths of the positive's score:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are exact inner products of floor(256 * x); higher ones come first, ties by the smaller id. Null ids, labels,
    vectors or components must be filtered before (labelled_vectors). Vectors of fewer components count as filled up
    with zeros. Rows that repeat, wholly or by their id, are rows of their own: each is an anchor, a positive and a
    negative for itself, so its lines repeat. Scores beyond a long are shown and compared as the nearest long. Anchors
    without a positive, and positives without a negative, give no line; no rows give no lines.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = saved(rows.withColumn("number", F.monotonically_increasing_id()), "vectors").withColumn("vector", F.col("vector").cast("array<double>"))
    # floor(256 * x) is within 1 of 256 * x
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (SCALE * F.abs(x) + 1) * (SCALE * F.abs(x) + 1))
    largest = F.array_max(F.transform("vector", F.abs))
    n, n_anchors, dim, largest, norm = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0), F.max(F.size("vector")), F.max(largest), F.max(norm)).first()
    packing = Packing.of(max(dim or 0, 1), largest or 0.0, norm or 0.0)
    blocks, slots = max(1, -(-n_anchors // BLOCK)), max(1, -(-n // SLOT))
    anchors = rows.where(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("number", F.lit(1)), F.lit(slots)).cast("int").alias("slot"), F.lit(1).alias("role"), "number", "id", "label", "vector")

    def met(block_rows: DataFrame, kind: type[Anchors], k: int, schema: str, *more: str) -> DataFrame:
        copies = block_rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(0).alias("role"), "number", "id", "label", "vector", *more)
        both = copies.unionByName(dealt, allowMissingColumns=True)
        count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return both.repartition(count, "block", "slot").sortWithinPartitions("block", "slot", "role", "number").mapInArrow(miner(packing, kind, k), schema)

    def first(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
        return found.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col(name) <= k)

    near = first(met(anchors, Anchors, positives, "number long, anchor_id long, score long, id long"), ["number"], positives, "positive")
    near = near.groupBy("number").agg(F.array_sort(F.collect_list(F.struct(F.col("positive").cast("long").alias("positive"), "id", "score"))).alias("positives"))
    paired = saved(anchors.join(near, "number"), "anchors")
    found = met(paired, Positives, negatives, "number long, positive long, anchor_id long, positive_id long, positive_score long, score long, id long", "positives")
    out = first(found, ["number", "positive"], negatives, "rank")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(labelled_vectors(read_table(spark, sf_dir, "embeddings")))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS number, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS parts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), s AS (
  SELECT a.number, a.vec_id AS anchor_id, b.number AS other, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum([coalesce(z[1], 0) * coalesce(z[2], 0) FOR z IN list_zip(a.parts, b.parts)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.number <> b.number WHERE a.vec_id % 100 = 0
), p AS (
  SELECT number, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY number ORDER BY score DESC, id, other) AS positive FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.number, p.positive ORDER BY s.score DESC, s.id, s.other) AS rank,
         s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON p.number = s.number AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
  WHERE p.positive <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
