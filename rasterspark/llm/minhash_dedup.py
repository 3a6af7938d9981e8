"""Near-duplicate documents by min-hashing with tensored banding.

A set has two small collections of min-hashes. HALF of them in a row are a half key; a table's key is a half key of the
first collection with one of the second, so `side` half keys on each side make side * side tables, with about the square
root of the min-hashes that as many tables of their own would need.

A table key can only be shared if both its halves are. Half keys that one set alone has are dropped before any keys are
formed, and of tables with the very same sets in a bucket one bucket stays. Sets near one of a large bucket (its pivot)
follow the pivot and form no keys equal to the pivot's.

Small buckets are compared by their min-hashes, large ones taken whole; what they tie is a class of candidates, verified on full sets: followers with
their pivot first, then only sets of a class that verified links haven't joined yet. Pairs are never written.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Table, broadcast_if_small, id_or_default, read_table, saved, small_batches, with_wanted
from .components import components
from .ngram_join import grouped, intersections, roots_of, set_of
from .words import SPACED, mix, pieces

SHINGLE = 5
#: Min-hashes of a half key.
HALF = 4
#: Sets in a bucket that is compared by itself, and in one whose sets may follow a pivot.
NODE, DENSE = 256, 64
#: Sets, and bytes of text, in a block of a class; followers that are compared with one copy of their pivot.
BLOCK_SETS, BLOCK_BYTES, FOLLOWERS = 768, 8 << 20, 512


def folded_table() -> np.ndarray:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased."""
    table = SPACED.copy()
    table[65:91] += 32
    return table


WORDS = folded_table()


class Plan:
    """What a similarity and a recall ask for: half keys on a side, equal places of sketches that tie two sets."""

    def __init__(self, similarity: tuple[int, int], recall: float):
        top, bottom = self.similarity = similarity
        s, miss = top / bottom, 1 - recall
        self.side = 1
        while self.missed(s) > miss / 2:
            self.side += 1
        self.places = 2 * self.side * HALF
        # places that a pair at the similarity agrees in, but for half of the chance that may be missed (binomial)
        chance, self.least = 0.0, 0
        for k in range(self.places):
            chance += math.comb(self.places, k) * s**k * (1 - s) ** (self.places - k)
            if chance > miss / 2:
                break
            self.least = k + 1
        # places that differ obey the triangle inequality: what is tied to a pivot's follower agrees with the pivot in
        # `fringe` places at least, and two pivots whose followers are tied in `meet`
        self.core = min(self.places, max(self.least, int(self.places * s)))
        self.fringe = max(0, self.least + self.core - self.places)
        self.meet = max(0, self.least + 2 * (self.core - self.places))

    def missed(self, s: float) -> float:
        """The chance that a pair of similarity s shares no table key."""
        return 1 - (1 - (1 - s**HALF) ** self.side) ** 2


def sets_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text; fewer words than a shingle has are one shingle, none are none."""
    for piece in pieces(texts, WORDS):
        firsts = piece.first_words()
        shingles, at = piece.shingles(SHINGLE)
        for d in range(piece.docs):
            yield piece.first + d, set_of(piece, d, firsts, shingles, at)


def sketcher(places: int) -> Callable:
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replaces the last column, a text, by the size of its set, a print of it (null if empty) and its min-hashes."""
        factors = mix(np.arange(1, places + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            sizes, prints, found = [], [], []
            for _, own in sets_of(batch.column(batch.num_columns - 1)):
                sizes.append(len(own))
                if not len(own):
                    prints.append(None)
                    found.append(None)
                    continue
                a, b = int(np.bitwise_xor.reduce(mix(own))), int(mix(own + np.uint64(1)).sum(dtype=np.uint64))
                low = np.full(places, 0xFFFFFFFF, np.uint64)
                for i in range(0, len(own), 2048):
                    low = np.minimum(low, ((own[i : i + 2048, None] * factors) >> np.uint64(32)).min(axis=0))
                prints.append(a.to_bytes(8, "big") + b.to_bytes(8, "big"))
                found.append(low.astype("<u4").tobytes())
            cols = [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(found, pa.binary())]
            yield pa.record_batch([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], "n_shingles", "print", "sketch"])

    return sketches


def sketch_rows(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").reshape(len(rows), -1)


def bucket_ties(plan: Plan) -> Callable:
    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket, set, pivot, sketch sorted by bucket -> u, v that span what each bucket ties together: two sets from
        `least` equal places on, a set and a pivot from `fringe` on, two pivots from `meet` on."""
        u, v = [], []
        for group in grouped(batches, 1):
            ids, pivot = (np.asarray(group.column(k).combine_chunks()) for k in (1, 2))
            rows = sketch_rows(group.column(3))
            floor = np.where(pivot[:, None] & pivot, plan.meet, np.where(pivot[:, None] | pivot, plan.fringe, plan.least)) if pivot.any() else plan.least
            linked = np.stack([np.count_nonzero(rows == r, axis=1) for r in rows]) >= floor
            np.fill_diagonal(linked, True)
            roots = roots_of(linked)
            move = roots != np.arange(len(ids))
            u += ids[move].tolist()
            v += ids[roots[move]].tolist()
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return ties


def block_candidates(least: int) -> Callable:
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class, i, j, block, joined, set, sketch sorted by class, i, j -> the sets with a candidate in their pair of
        blocks that verified links haven't joined them to."""
        for group in grouped(batches, 3):
            block, joined = (np.asarray(group.column(k).combine_chunks()) for k in (3, 4))
            rows, found = sketch_rows(group.column(6)), np.zeros(group.num_rows, bool)
            cross = group.column(1)[0].as_py() != group.column(2)[0].as_py()
            for k in range(len(rows)):
                if not found[k]:
                    at = np.flatnonzero((joined != joined[k]) & ((block != block[k]) | (not cross)))
                    near = at[np.count_nonzero(rows[at] == rows[k], axis=1) >= least]
                    found[near] = True
                    found[k] = len(near) > 0
            yield from group.select(range(6)).filter(pa.array(found)).to_batches()

    return candidates


def block_links(similarity: tuple[int, int]) -> Callable:
    top, bottom = similarity

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class, i, j, block, joined, set, text sorted by class, i, j -> u, v that span the links of the pair of blocks."""
        u, v = [], []
        for group in grouped(batches, 3):
            ids, once = np.unique(np.asarray(group.column(5).combine_chunks()), return_index=True)  # rows may repeat a text
            joined = np.asarray(group.column(4).combine_chunks())[once]
            sets = [s for chunk in group.column(6).take(pa.array(once)).chunks for _, s in sets_of(chunk)]
            sizes = np.array([len(s) for s in sets], np.float64)
            shared = intersections(sets).astype(np.float64)
            linked = (bottom + top) * shared >= top * (sizes[:, None] + sizes)  # shared / (a + b - shared) >= top / bottom
            linked &= joined[:, None] != joined
            np.fill_diagonal(linked, True)
            roots = roots_of(linked)
            move = roots != np.arange(len(ids))
            u += ids[move].tolist()
            v += ids[roots[move]].tolist()
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return links


def pivot_links(similarity: tuple[int, int]) -> Callable:
    top, bottom = similarity

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """home, chunk, role, set, text sorted so that a pivot (role 0) comes before its followers -> links with the pivot."""
        pivot, home = np.zeros(0, np.uint64), None
        for batch in batches:
            role, ids, homes = (np.asarray(batch.column(k)) for k in (2, 3, 0))
            u, v = [], []
            for k, own in sets_of(batch.column(4)):
                if role[k] == 0:
                    pivot, home = own, int(homes[k])
                elif home == homes[k]:
                    shared = len(np.intersect1d(pivot, own, assume_unique=True))
                    if (bottom + top) * shared >= top * (len(pivot) + len(own)):
                        u.append(int(ids[k]))
                        v.append(home)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return links


def half(sketch: Column, k: Column) -> Column:
    return F.substring(sketch, 4 * HALF * k + 1, F.lit(4 * HALF))


def half_keys(sets: DataFrame, plan: Plan) -> DataFrame:
    """set, k (from side on of the second collection), key: half keys that two sets share at least."""
    k = F.sequence(F.lit(0), F.lit(2 * plan.side - 1))
    rows = sets.select("set", F.explode(F.transform(k, lambda i: F.struct(i.alias("k"), F.xxhash64(i, half(F.col("sketch"), i)).alias("key")))).alias("h")).select("set", "h.k", "h.key")
    rows = saved(rows, "half-keys")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return saved(rows.join(shared, "key"), "shared-halves")


def followers(sets: DataFrame, halves: DataFrame, plan: Plan) -> DataFrame:
    """set, home (the pivot that it follows; its own if it is one), same (bits of the half keys equal to the pivot's)."""
    # the same order in every bucket, so the sets of a group often have the same pivot
    some = halves.where((F.col("k").isin(0, plan.side)) & (F.col("n") > DENSE))
    dense = saved(some.groupBy("key").agg(F.min(F.struct(F.xxhash64("set").alias("o"), "set")).alias("p")).select("key", F.col("p.set").alias("pivot")), "dense")
    n = dense.count()
    near = some.join(broadcast_if_small(dense, n), "key").select("set", "pivot").distinct().join(sets.select("set", "sketch"), "set")
    pivots = sets.join(broadcast_if_small(dense.select(F.col("pivot").alias("set")).distinct(), n), "set", "left_semi").select(F.col("set").alias("pivot"), F.col("sketch").alias("p"))
    near = near.join(F.broadcast(pivots) if n * 4 * plan.places <= 16 << 20 else pivots, "pivot")
    places = F.sequence(F.lit(0), F.lit(plan.places - 1))
    equal = F.size(F.filter(places, lambda i: F.substring(F.col("sketch"), 4 * i + 1, F.lit(4)) == F.substring(F.col("p"), 4 * i + 1, F.lit(4))))
    bit = lambda i: F.when(half(F.col("sketch"), i) == half(F.col("p"), i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(2 * plan.side - 1)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))
    near = near.where(equal >= plan.core).withColumn("same", same)
    found = near.groupBy("set").agg(F.max(F.col("set") == F.col("pivot")).alias("own"), F.min(F.struct(F.xxhash64("pivot").alias("o"), "pivot", "same")).alias("h"))
    return saved(found.select("set", F.when(F.col("own"), F.col("set")).otherwise(F.col("h.pivot")).alias("home"), "h.same"), "followers")


def table_keys(halves: DataFrame, homes: DataFrame, plan: Plan) -> DataFrame:
    """bucket, set, pivot: the keys of all tables but those whose halves are both the pivot's, for sets that follow one."""
    lists = halves.groupBy("set").agg(F.collect_list(F.struct("k", "key")).alias("h")).join(homes, "set", "left")  # 2 * side entries at most
    own = F.coalesce(F.col("home") == F.col("set"), F.lit(True))
    same = lambda h: F.coalesce(F.call_function("getbit", F.col("same"), h["k"]), F.lit(0).cast("byte")) == 1
    first, second = F.filter("h", lambda h: h["k"] < plan.side), F.filter("h", lambda h: h["k"] >= plan.side)
    lists = lists.select("set", "same", own.alias("own"), F.coalesce(F.col("home") == F.col("set"), F.lit(False)).alias("pivot"), F.explode(first).alias("a"), second.alias("second"))
    wanted = F.filter("second", lambda b: F.col("own") | ~(same(F.col("a")) & same(b)))
    return lists.select(F.explode(F.transform(wanted, lambda b: F.xxhash64(F.col("a")["key"], b["key"]))).alias("bucket"), "set", "pivot")


def candidate_classes(sets: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """set, class of sets that shared buckets tie together, directly or by others; and followers()."""
    halves = half_keys(sets, plan)
    homes = followers(sets, halves, plan)
    keys = saved(table_keys(halves, homes, plan), "table-keys")
    # of buckets that hold the very same sets one is compared
    held = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("y")).where("n > 1")
    held = held.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    live = saved(keys.join(held, "bucket"), "buckets")
    # a large bucket is tied whole: its sets are compared once, as a class, not again in each table
    large = live.where(F.col("n") > NODE)
    stars = large.join(large.groupBy("bucket").agg(F.min("set").alias("least")), "bucket").select(F.col("set").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
    count = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = live.where(F.col("n") <= NODE).join(sets.select("set", "sketch"), "set").select("bucket", "set", "pivot", "sketch").repartition(count, "bucket").sortWithinPartitions("bucket", "set")
    ties = Table(compared.mapInArrow(bucket_ties(plan), "u long, v long").unionByName(stars), "ties").read()
    edges = ties.unionByName(homes.select(F.col("set").alias("u"), F.col("home").alias("v")))
    return saved(components(edges).select(F.col("node").alias("set"), F.col("root").alias("class")), "candidates"), homes


def texts_of(rows: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, text of the wanted sets; a text that rows repeat may stand more than once."""
    named = saved(sets.select("set", "doc", "text_hash").join(wanted, "set", "left_semi"), "wanted-texts")
    return with_wanted(rows, named).select("set", "text")


def verified_links(rows: DataFrame, sets: DataFrame, classes: DataFrame, homes: DataFrame, plan: Plan) -> DataFrame:
    """u, v: links that span the same components as all links within the classes."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    follow = homes.where("home <> set")
    chunks = follow.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("chunks"))
    chunks = saved(chunks, "pivots")
    n = chunks.count()
    mine = follow.select("set", "home").join(broadcast_if_small(chunks, n), "home").select("home", F.pmod(F.xxhash64("set"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("role"), "set")
    own = chunks.select("home", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("home").alias("set"))
    starred = saved(mine.unionByName(own), "starred")
    starred = starred.join(texts_of(rows, sets, starred.select("set").distinct()), "set").select("home", "chunk", "role", "set", "text")
    starred = starred.repartition(count, "home", "chunk").sortWithinPartitions("home", "chunk", "role")
    links = Table(starred.mapInArrow(pivot_links(plan.similarity), "u long, v long"), "pivot-links").read()

    joined = components(links).select(F.col("node").alias("set"), F.col("root").alias("joined"))
    members = sets.join(classes, "set").join(joined, "set", "left").select("class", "set", F.coalesce("joined", "set").alias("joined"), "bytes", "sketch")
    members = saved(members, "members")
    # the part of a class that links have joined most sets of needs no comparison within itself
    parts_of = members.groupBy("class", "joined").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    totals = parts_of.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "joined")).alias("m"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("groups > 1")
    blocks = lambda n, b: F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(b / BLOCK_BYTES), F.lit(1)).cast("int")
    totals = totals.join(parts_of.select("class", F.col("joined").alias("major"), F.col("bytes").alias("major_bytes")), "class").where("major = m.joined")
    totals = totals.select("class", "major", blocks(F.col("m.n"), F.col("major_bytes")).alias("majors"), blocks(F.col("n") - F.col("m.n"), F.col("bytes") - F.col("major_bytes")).alias("minors"))
    totals = saved(totals, "open-classes")
    dealt = members.join(broadcast_if_small(totals, totals.count()), "class")
    # blocks of the rest are 0 .. minors - 1, those of the most joined part follow; two of these never meet
    major = F.col("joined") == F.col("major")
    block = F.when(major, F.col("minors") + F.pmod(F.xxhash64("set"), "majors")).otherwise(F.pmod(F.xxhash64("set"), "minors")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)))
    dealt = dealt.select("class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "joined", "set", "sketch")
    arranged = lambda df: df.repartition(count, "class", "i", "j").sortWithinPartitions("class", "i", "j")
    found = saved(arranged(dealt).mapInArrow(block_candidates(plan.least), "class long, i int, j int, block int, joined long, set long"), "block-candidates")
    texts = texts_of(rows, sets, found.select("set").distinct())
    more = arranged(found.join(texts, "set").select("class", "i", "j", "block", "joined", "set", "text"))
    return links.unionByName(Table(more.mapInArrow(block_links(plan.similarity), "u long, v long"), "links").read())


def near_components(docs: DataFrame, similarity: tuple[int, int] = (85, 100), recall: float = 0.9999) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A text is the set of its five-word shingles, words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; fewer words are one
    shingle, a null or wordless text is the empty set and linked with nothing. Sets are linked where their Jaccard
    similarity, verified on full sets, is at least `similarity`, a fraction; a pair at just that similarity is missed
    with a chance under 1 - recall, closer ones less. component_id is the least doc_id that links reach. kept:
    doc_id = component_id.

    Rows that repeat are compared one by one: rows of one doc_id may be in different components. A row without a doc_id
    takes part and has the component_id of those it is linked to, or null and is kept where none of them has one. Very
    long texts are compared whole. No rows give no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    plan = Plan(similarity, recall)
    text = F.col("text").cast("string")
    rows = docs.select(id_or_default().alias("doc"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("bytes"), text.alias("text"))
    sketched = saved(rows.mapInArrow(sketcher(plan.places), "doc long, text_hash long, bytes int, n_shingles long, print binary, sketch binary"), "sketches")
    # the least document names a set, documents without an id last
    name = F.struct((F.col("doc") == NO_ID).alias("none"), "doc", "text_hash")
    folded = sketched.where("print IS NOT NULL").groupBy("print").agg(F.min(name).alias("name"), F.first("sketch").alias("sketch"), F.first("bytes").alias("bytes"))
    # the numbers are fixed by being written
    sets = saved(folded.select(F.monotonically_increasing_id().alias("set"), "print", "name", F.col("name.doc").alias("doc"), F.col("name.text_hash").alias("text_hash"), "sketch", "bytes"), "sets")
    classes, homes = candidate_classes(sets.select("set", "sketch"), plan)
    links = verified_links(rows, sets, classes, homes, plan)
    roots = components(links).select(F.col("node").alias("set"), "root")
    linked = saved(sets.select("set", "print", "name").join(roots, "set", "left").select("print", "name", F.coalesce("root", "set").alias("root")), "linked-sets")
    keeps = linked.groupBy("root").agg(F.min("name").alias("keep"))
    per_set = linked.join(keeps, "root").select("print", F.col("keep.doc").alias("keep"))
    out = sketched.select("doc", "n_shingles", "print").join(per_set, "print", "left")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = out.select(known("doc").alias("doc_id"), "n_shingles", F.when(F.col("keep").isNull(), known("doc")).otherwise(known("keep")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"))
