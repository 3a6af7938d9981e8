"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles; exact copies are folded first. A run splits the sets: sets that share
the tokens at the run's coordinates of their min-hash sketches fall into one node (two tokens at a high similarity, so a
passage that many documents share makes no large node of them). Small nodes are compared by brute force on the sketches;
large ones are split again on sampled tokens while that parts them, and are compared in blocks where it doesn't. Runs
repeat until a pair at the similarity is missed with a chance under 1 - recall, all splits counted.

Groups of near copies would come together in every run. They are found first: a set that agrees with one of a large
node (its pivot) in most places follows the pivot, and is left out of each run in which its tokens are the pivot's.

What the runs tie is a class of candidates. Its sketches are compared in blocks; texts are read only of sets that have a
candidate in a block, and these are compared exactly. Links are counted where they are found, never written as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Table, broadcast_if_small, id_or_default, read_table, saved, small_batches, spare, with_wanted
from .components import components
from .words import mix, pieces, shingle_hash

SHINGLE, SKETCH = 5, 64
#: Sets in a node that is compared by brute force on the sketches, and in one whose sets may follow a pivot.
NODE, DENSE = 256, 64
#: Runs whose large nodes give pivots.
PIVOT_RUNS = 2
#: Tokens that each deeper split samples; a pair stays together if it shares one of them.
PICKS = 2
#: Sets, and bytes of text, in a block of a class.
BLOCK_SETS, BLOCK_BYTES = 1536, 8 << 20
_COLUMNS = 4096


def set_of(piece, d: int, firsts: np.ndarray, shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    a, b = int(firsts[d]), int(firsts[d + 1])
    if 0 < b - a < SHINGLE:
        return shingle_hash([piece.hashes[i : i + 1] for i in range(a, b)])
    i, j = np.searchsorted(at, [a, b])
    return np.unique(shingles[i:j])


def sets_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text; fewer words than a shingle has are one shingle, none are none."""
    for piece in pieces(texts):
        firsts = piece.first_words()
        shingles, at = piece.shingles(SHINGLE)
        for d in range(piece.docs):
            yield piece.first + d, set_of(piece, d, firsts, shingles, at)


def sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by a print of its set of shingles (null if there are none) and a sketch."""
    factors = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        prints, sketches = [], []
        for _, found in sets_of(batch.column(batch.num_columns - 1)):
            if len(found):
                a, b = int(np.bitwise_xor.reduce(mix(found))), int(mix(found + np.uint64(1)).sum(dtype=np.uint64))
                low = np.full(SKETCH, 0xFFFFFFFF, np.uint64)
                for i in range(0, len(found), 4096):
                    low = np.minimum(low, ((found[i : i + 4096, None] * factors) >> np.uint64(32)).min(axis=0))
                prints.append(a.to_bytes(8, "big") + b.to_bytes(8, "big"))
                sketches.append(low.astype("<u4").tobytes())
            else:
                prints.append(None)
                sketches.append(None)
        cols = [pa.array(prints, pa.binary()), pa.array(sketches, pa.binary())]
        yield pa.record_batch([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], "print", "sketch"])


def sketch_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, SKETCH)


def roots_of(linked: np.ndarray) -> np.ndarray:
    """linked: square, symmetric, True where two rows are linked -> the first row of each row's component."""
    n, root = len(linked), np.full(len(linked), -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        inside = np.zeros(n, bool)
        edge = np.array([i])
        inside[i] = True
        while len(edge):
            reached = linked[edge].any(axis=0) & ~inside
            inside |= reached
            edge = np.flatnonzero(reached)
        root[inside] = i
    return root


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first columns, of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(keys)]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(edges, edges[1:], strict=False):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def node_ties(least: int, fringe: int, meet: int) -> Callable:
    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """node, part, set, pivot, sketch sorted by node -> u, v that span what each node's sketches tie together.

        Two sets are tied from `least` equal places on, a set and a pivot from `fringe` on, for the set may be near one
        of those that follow the pivot, and two pivots from `meet` on. Of a node in two parts only pairs across count.
        """
        u, v = [], []
        for group in grouped(batches, 1):
            part, ids, pivot = (np.asarray(group.column(k).combine_chunks()) for k in (1, 2, 3))
            rows = sketch_rows(group.column(4))
            floor = np.where(pivot[:, None] & pivot[None, :], meet, np.where(pivot[:, None] | pivot[None, :], fringe, least)) if pivot.any() else least
            linked = np.stack([np.count_nonzero(rows == r, axis=1) for r in rows]) >= floor
            if part.min() != part.max():
                linked &= part[:, None] != part[None, :]
            some = np.flatnonzero(linked.sum(axis=1) > linked.diagonal())
            if len(some):
                roots = roots_of(linked[np.ix_(some, some)])
                move = roots != np.arange(len(some))
                u += ids[some[move]].tolist()
                v += ids[some[roots[move]]].tolist()
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return ties


def block_candidates(least: int) -> Callable:
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class, i, j, block, set, sketch sorted by class, i, j -> those with a candidate in their pair of blocks."""
        for group in grouped(batches, 3):
            block, rows = np.asarray(group.column(3).combine_chunks()), sketch_rows(group.column(5))
            found, cross = np.zeros(len(rows), bool), group.column(1)[0].as_py() != group.column(2)[0].as_py()
            for k in range(len(rows)):
                if not found[k]:  # what has a candidate need not look for another
                    near = np.count_nonzero(rows == rows[k], axis=1) >= least
                    near &= block != block[k] if cross else np.arange(len(rows)) != k
                    found |= near
                    found[k] = near.any()
            for out in group.select(range(5)).filter(pa.array(found)).to_batches():
                yield out

    return candidates


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over slices of the shared shingles."""
    n, lengths = len(sets), [len(s) for s in sets]
    owner = np.repeat(np.arange(n), lengths)
    tokens = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, len(tokens)])
    out = np.zeros((n, n), np.float32)
    place = np.cumsum(new) - 1
    few, many = count == 2, count > 2
    pairs = start[few]
    np.add.at(out, (owner[pairs], owner[pairs + 1]), 1)
    np.add.at(out, (owner[pairs + 1], owner[pairs]), 1)
    column = np.cumsum(many) - 1
    use = many[place]
    owner, column = owner[use], column[place[use]]
    for a in range(0, int(many.sum()), _COLUMNS):
        i, j = np.searchsorted(column, [a, a + _COLUMNS])
        slab = np.zeros((n, min(_COLUMNS, int(column[j - 1]) - a + 1)), np.float32)
        slab[owner[i:j], column[i:j] - a] = 1
        out += slab @ slab.T
    return out


def block_links(threshold: tuple[int, int]) -> Callable:
    top, bottom = threshold

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """class, i, j, block, set, text sorted by class, i, j -> for each set its links in the block pair, and a root."""
        ids_out, n_out, root_out = [], [], []
        for group in grouped(batches, 3):
            block, ids = np.asarray(group.column(3).combine_chunks()), np.asarray(group.column(4).combine_chunks())
            ids, once = np.unique(ids, return_index=True)  # rows may repeat a text
            sets = [s for chunk in group.column(5).take(pa.array(once)).chunks for _, s in sets_of(chunk)]
            sizes = np.array([len(s) for s in sets], np.float64)
            shared = intersections(sets).astype(np.float64)
            # shared / (a + b - shared) >= top / bottom
            linked = (bottom + top) * shared >= top * (sizes[:, None] + sizes[None, :])
            if group.column(1)[0].as_py() != group.column(2)[0].as_py():
                linked &= block[once][:, None] != block[once][None, :]
            np.fill_diagonal(linked, False)
            roots, n = roots_of(linked), linked.sum(axis=1)
            ids_out += ids[n > 0].tolist()
            n_out += n[n > 0].tolist()
            root_out += ids[roots[n > 0]].tolist()
        yield pa.record_batch([pa.array(ids_out, pa.int64()), pa.array(n_out, pa.int64()), pa.array(root_out, pa.int64())], names=["set", "n", "root"])

    return links


def token(sketch: Column, at: Column) -> Column:
    return F.substring(sketch, 4 * at + 1, F.lit(4))


class Plan:
    """What a similarity and a recall ask for: tokens of a first split, equal places of sketches, runs."""

    def __init__(self, similarity: float, recall: float):
        self.similarity, self.recall = similarity, recall
        self.splits = 2 if similarity >= 0.6 else 1
        # places that a pair at the similarity agrees in, but for half of the chance that may be missed (binomial)
        chance, self.least = 0.0, 0
        for k in range(SKETCH):
            chance += math.comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k)
            if chance > (1 - recall) / 2:
                break
            self.least = k + 1
        # places that differ obey the triangle inequality: a set near one of a pivot's followers agrees with the pivot
        # in `fringe` places at least, and two pivots with followers near each other in `meet`
        self.core = min(SKETCH, max(self.least, SKETCH + SKETCH // 4 - self.least))
        self.fringe = max(0, self.least + self.core - SKETCH)
        self.meet = max(0, self.least + 2 * (self.core - SKETCH))

    def missed(self, runs: int, depth: int) -> float:
        """The chance that no run brings a pair at the similarity together, with `depth` splits after the first."""
        kept = self.similarity**self.splits * (1 - (1 - self.similarity) ** PICKS) ** depth
        return (1 - kept) ** runs

    def runs(self, missed: float, depth: int) -> int:
        """Runs that bring the chance `missed` under half of 1 - recall."""
        return max(0, math.ceil(math.log((1 - self.recall) / 2 / missed) / math.log(self.missed(1, depth)) - 1e-9))

    def places(self, run: Column) -> list[Column]:
        # once all coordinates have been used they are paired anew
        at = lambda k: (self.splits * run + k) * 37 + k * self.splits * F.floor(run * self.splits / SKETCH)
        return [F.pmod(at(k), F.lit(SKETCH)).cast("int") for k in range(self.splits)]

    def first_node(self, run: Column) -> Column:
        return F.xxhash64(run, *[token(F.col("sketch"), at) for at in self.places(run)])


def followers(sets: DataFrame, plan: Plan) -> DataFrame:
    """set, home (the pivot that it follows; its own if it is one), same (bits of the places equal to the pivot's)."""
    firsts = F.transform(F.sequence(F.lit(0), F.lit(PIVOT_RUNS - 1)), plan.first_node)
    nodes = sets.select(F.explode(firsts).alias("node"), "set")
    # the same order in every node, so the sets of a group often have the same pivot
    dense = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("set").alias("o"), "set")).alias("p"))
    dense = saved(dense.where(F.col("n") > DENSE).select("node", F.col("p.set").alias("pivot")), "dense-nodes")
    n = dense.count()
    near = nodes.join(broadcast_if_small(dense, n), "node").select("set", "pivot").distinct().join(sets, "set")
    pivots = sets.join(broadcast_if_small(dense.select(F.col("pivot").alias("set")).distinct(), n), "set", "left_semi")
    near = near.join(broadcast_if_small(pivots.select(F.col("set").alias("pivot"), F.col("sketch").alias("p")), n), "pivot")
    bit = lambda i: F.when(token(F.col("sketch"), i) == token(F.col("p"), i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SKETCH - 1)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))
    near = near.withColumn("same", same).where(F.bit_count("same") >= plan.core)
    own = F.max(F.col("set") == F.col("pivot"))
    found = near.groupBy("set").agg(own.alias("own"), F.min(F.struct(F.xxhash64("pivot").alias("o"), "pivot", "same")).alias("h"))
    return saved(found.select("set", F.when(F.col("own"), F.col("set")).otherwise(F.col("h.pivot")).alias("home"), "h.same"), "followers")


def chosen_path_ties(sets: DataFrame, plan: Plan, first: int, runs: int) -> tuple[list[DataFrame], int]:
    """sets: set, sketch, home, same -> tables of u, v that nodes of the runs tie together, and how deep they were split."""
    own = F.coalesce(F.col("home") == F.col("set"), F.lit(False))

    def stays(r):
        follows = F.lit(True)
        for at in plan.places(r):
            follows = follows & (F.getbit(F.col("same"), at) == 1)
        return F.col("home").isNull() | own | ~follows

    wanted = F.transform(F.filter(F.sequence(F.lit(first), F.lit(first + runs - 1)), stays), plan.first_node)
    paths, ties, depth, before = sets.select(F.explode(wanted).alias("node"), "set", own.alias("pivot")), [], 0, None
    n_sets = sets.count()
    while True:
        sizes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        live = Table(paths.join(sizes.hint("merge"), "node"), f"paths-{depth}").read()
        nodes = live.where(F.col("n") <= NODE).select("node", F.lit(0).cast("long").alias("part"), "set", "pivot")
        parts = F.ceil(F.col("n") / (NODE // 2))
        is_large = F.col("n") > NODE
        large = live.where(is_large)
        n_live, rows, dealt = live.agg(F.count(F.lit(1)), F.count_if(is_large), F.coalesce(F.sum(F.when(is_large, parts)), F.lit(0))).first()
        # what splitting hardly parts, or makes no more rows than there are sets, is compared whole: all pairs of its parts
        last = dealt <= n_sets or (before is not None and 2 * rows > before)
        if last and rows:
            part, spread = F.pmod(F.xxhash64(F.col("set"), F.lit(1)), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
            pairs = large.select("node", "set", "pivot", part.alias("part"), spread.alias("b"))
            pairs = pairs.select(F.xxhash64("node", F.least("part", "b"), F.greatest("part", "b")).alias("node"), "part", "set", "pivot")
            nodes = nodes.unionByName(pairs)
        count = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        in_nodes = n_live - rows + (dealt if last else 0)
        compared = broadcast_if_small(nodes, in_nodes).join(sets.select("set", "sketch"), "set").select("node", "part", "set", "pivot", "sketch")
        compared = compared.repartition(count, "node").sortWithinPartitions("node", "set")
        ties.append(Table(compared.mapInArrow(node_ties(plan.least, plan.fringe, plan.meet), "u long, v long"), "ties").read())
        if last:
            return ties, depth
        picks = [F.pmod(F.xxhash64(F.col("node"), F.lit(f"pick-{k}")), F.lit(SKETCH)).cast("int") for k in range(PICKS)]
        children = F.array_distinct(F.array(*[F.xxhash64("node", at, token(F.col("sketch"), at)) for at in picks]))
        paths = broadcast_if_small(large, rows).join(sets.select("set", "sketch"), "set").select(F.explode(children).alias("node"), "set", "pivot")
        depth, before = depth + 1, rows


def candidate_classes(sets: DataFrame, plan: Plan) -> DataFrame:
    """set, class: sets that runs tie together, directly or by others; each pair at the similarity is in one class but
    for a chance under 1 - recall."""
    homes = followers(sets, plan)
    sets = saved(sets.join(broadcast_if_small(homes, homes.count()), "set", "left"), "path-sets")
    ties, done, missed, ahead = [homes.select(F.col("set").alias("u"), F.col("home").alias("v"))], 0, 1.0, 1
    while runs := plan.runs(missed, ahead):
        more, depth = chosen_path_ties(sets, plan, done, runs)
        ties, done, missed, ahead = ties + more, done + runs, missed * plan.missed(runs, depth), max(ahead, depth)
    edges = ties[0]
    for more in ties[1:]:
        edges = edges.unionByName(more)
    return saved(components(edges).select(F.col("node").alias("set"), F.col("root").alias("class")), "candidates")


def exact_links(rows: DataFrame, sets: DataFrame, classes: DataFrame, similarity: tuple[int, int], plan: Plan) -> DataFrame:
    """rows: doc, text_hash, text; sets: set, doc, text_hash, bytes, sketch -> set, n, root: the links that a pair of
    blocks gives a set, and another set that they join it to."""
    members = sets.join(broadcast_if_small(classes, classes.count()), "set").select("class", "set", "doc", "text_hash", "bytes", "sketch")
    members = saved(members, "members")
    sizes = members.groupBy("class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("parts"))
    sizes = saved(sizes.where("parts > 1"), "class-sizes")  # a class in one block needs no row here
    parts = F.coalesce("parts", F.lit(1))
    dealt = members.join(broadcast_if_small(sizes, sizes.count()), "class", "left").withColumn("block", F.pmod(F.xxhash64("set"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "sketch")
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda df: df.repartition(count, "class", "i", "j").sortWithinPartitions("class", "i", "j")
    found = saved(blocks(dealt).mapInArrow(block_candidates(plan.least), "class long, i int, j int, block int, set long"), "block-candidates")
    n = found.count()
    wanted = members.join(broadcast_if_small(found.select("set").distinct(), n), "set", "left_semi").select("doc", "text_hash", "set")
    texts = with_wanted(rows, saved(wanted, "wanted-texts")).select("set", "text")
    links = blocks(broadcast_if_small(found, n).join(texts, "set").select("class", "i", "j", "block", "set", "text")).mapInArrow(block_links(similarity), "set long, n long, root long")
    return saved(links, "links")


def classified(docs: DataFrame, similarity: tuple[int, int], recall: float) -> DataFrame:
    """doc (NO_ID: none) and text_hash of each row, with keep_doc and keep_hash of its class, n_links and n_copies."""
    small_batches(docs.sparkSession)
    plan = Plan(similarity[0] / similarity[1], recall)
    text = F.col("text").cast("string")
    rows = docs.select(id_or_default().alias("doc"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("bytes"), text.alias("text"))
    sketched = saved(rows.mapInArrow(sketcher, "doc long, text_hash long, bytes int, print binary, sketch binary"), "sketches")
    # the least document names a set, documents without an id last
    name = F.struct((F.col("doc") == NO_ID).alias("none"), "doc", "text_hash")
    folded = sketched.where("print IS NOT NULL").groupBy("print").agg(F.min(name).alias("name"), F.count(F.lit(1)).alias("n_copies"), F.first("sketch").alias("sketch"), F.first("bytes").alias("bytes"))
    # the numbers are fixed by being written
    sets = saved(folded.select(F.monotonically_increasing_id().alias("set"), "print", "name", F.col("name.doc").alias("doc"), F.col("name.text_hash").alias("text_hash"), "n_copies", "sketch", "bytes"), "sets")
    classes = candidate_classes(sets.select("set", "sketch"), plan)
    links = exact_links(rows, sets, classes, similarity, plan)
    roots = components(links.select(F.col("set").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("set"), "root")
    n = links.count()  # at least a row for each set with links
    counts = links.groupBy("set").agg(F.sum("n").alias("n_links"))
    joined = saved(sets.select("set", "name").join(broadcast_if_small(roots, n), "set").join(broadcast_if_small(counts, n), "set"), "linked-sets")
    n = joined.count()
    keeps = joined.groupBy("root").agg(F.min("name").alias("keep"))
    linked = joined.join(broadcast_if_small(keeps, n), "root").select("set", "n_links", "keep")
    per_set = sets.select("set", "print", "name", "n_copies").join(broadcast_if_small(linked, n), "set", "left")
    per_set = per_set.select("print", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("keep", "name").alias("keep"))
    out = sketched.select("doc", "text_hash", "print").join(per_set, "print", "left")
    return out.select("doc", "text_hash", F.col("keep.doc").alias("keep_doc"), F.col("keep.text_hash").alias("keep_hash"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


def near_classes(docs: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.99999) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of all that links join), n_links (different shingle sets
    linked to this one), n_copies (rows with this very set of shingles).

    Texts are sets of five-word shingles (A-Z lower-cased); a text of fewer words, but not none, is one shingle. Two
    sets are linked if their Jaccard similarity is at least `similarity`, a fraction. Null and wordless texts are alone
    in their class and have n_copies 1. Each row is compared for its text: rows that share a doc_id may be in different
    classes; rows without a doc_id are compared too, and name a class only if all its rows lack one (class_id is null).
    No rows give no rows; other columns are not read.
    """
    out = classified(docs, similarity, recall)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known("doc").alias("doc_id"), F.when(F.col("keep_doc").isNull(), known("doc")).otherwise(known("keep_doc")).alias("class_id"), "n_links", "n_copies")


def one_of_each(docs: DataFrame, similarity: tuple[int, int] = (4, 5), recall: float = 0.99999) -> DataFrame:
    """The rows of docs without the near copies: of each class of near_classes() one document stays, that of the least
    doc_id (those without one last), and of its texts in the class the one of the least hash.

    Rows that repeat both doc_id and text are one document and stay or go together. Null and wordless texts stay. All
    columns are kept; no rows give no rows.
    """
    out = classified(docs, similarity, recall)
    doc, text_hash = spare(docs, "doc", "text_hash")
    gone = out.where((F.col("doc") != F.col("keep_doc")) | (F.col("text_hash") != F.col("keep_hash"))).select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash)).distinct()
    keyed = docs.withColumn(doc, id_or_default()).withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(gone, [doc, text_hash], "left_anti").drop(doc, text_hash)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))
