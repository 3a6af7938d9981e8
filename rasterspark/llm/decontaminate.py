"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window of the benchmark occurs in a document only if all its shingles do, so its rarest shingle (fewest occurrences
over all documents) is prefix enough. Documents are scanned for these prefix shingles only; a match must leave room for
the window before and after it (positional and length bounds), and the words of the window are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bit_set, broadcast_if_small, broadcast_measured, id_or_default, in_bit_set, read_table, saved, small_batches, spare
from .words import Piece, pieces

WINDOW, SHINGLE = 13, 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """item, win: each distinct window of `window` words of each item; an item of fewer words, but not none, is one."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    at = items.withColumn("len", length).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - length)))
    return at.select("item", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("win")).distinct()


def shingles_of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """win -> its shingles: hash, width in words, place in the window, and the window's length."""
    for batch in batches:
        wins, rows = batch.column(0), []
        for piece in pieces(wins):
            firsts = piece.first_words()
            by_width = {k: piece.shingles(k) for k in range(1, SHINGLE + 1)}
            for d in range(piece.docs):
                a, b = int(firsts[d]), int(firsts[d + 1])
                k = min(SHINGLE, b - a)
                hashes, at = by_width[k]
                i, j = np.searchsorted(at, [a, b])
                rows += [(piece.first + d, int(h), k, int(p) - a, b - a) for h, p in zip(hashes[i:j].view(np.int64), at[i:j], strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.record_batch([wins.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], names=["win", "h", "k", "off", "len"])


def bit_filter(hashes: DataFrame, n: int) -> tuple[np.ndarray, list[int]]:
    """A bit set over the hashes (column h, n of them), and the widths k among them."""
    return bit_set(hashes, n), [r.k for r in hashes.select("k").distinct().collect()]


def matches(piece: Piece, k: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = piece.shingles(k)
    hit = in_bit_set(words, hashes)
    return hashes[hit], at[hit]


def shingle_counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, widths = shared.value
        for batch in batches:
            found = [matches(piece, k, words)[0] for piece in pieces(batch.column(0)) for k in widths]
            hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return count


def candidate_finder(shared, window: int):
    kind = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32()), ("first", pa.int32()), ("ctx", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, widths = shared.value
        for batch in batches:
            counts, found = [], []
            for piece in pieces(batch.column(batch.num_columns - 1)):
                firsts = piece.first_words()
                counts.append(np.diff(firsts))
                here: list[list[dict]] = [[] for _ in range(piece.docs)]
                for k in widths:
                    for h, at in zip(*matches(piece, k, words), strict=True):
                        d = piece.word_doc[at]
                        i, j = max(firsts[d], at - window + 1), min(firsts[d + 1], at + window)
                        ctx = " ".join(piece.word(x) for x in range(i, j))
                        here[d].append({"h": int(h.view(np.int64)), "p": int(at - firsts[d]), "first": int(i - firsts[d]), "ctx": ctx})
                found += here
            n = np.concatenate([np.zeros(0, np.int64), *counts])
            yield pa.record_batch([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names[:-1], "n_words", "found"])

    return find


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_words, n_hit (words inside any occurrence of a window), n_items and
    items (of windows that occur, sorted as strings), contaminated (n_hit > 0 and at least `percent` of the words).

    Null texts have no words; items without a word or an id have no windows; a window shared by items counts for each;
    rows that repeat a doc_id are judged row by row, very long texts whole. An empty table on either side gives clean or no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    items = saved(windows_of(benchmark, window), "windows")
    parts = saved(items.select("win").distinct().mapInArrow(shingles_of_windows, "win string, h long, k int, off int, len int"), "window-shingles")
    shingles = parts.select("h", "k").distinct()
    n_parts = parts.count()
    counter = shingle_counter(sc.broadcast(bit_filter(shingles, n_parts)))
    counts = docs.select(F.col("text").cast("string")).mapInArrow(counter, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # a window with a shingle that no document has can't occur: the inner join and the count of shingles leave it out
    rare = parts.join(broadcast_if_small(parts.select("h").distinct().join(counts, "h", "left").na.fill(0, ["n"]), n_parts), "h")
    index = rare.groupBy("win", "len").agg(F.min(F.struct("n", "h", "off", "k")).alias("r")).where("r.n > 0")
    index = saved(index.select("win", "len", "r.h", "r.off", "r.k"), "window-index")
    n_index = index.count()
    finder = candidate_finder(sc.broadcast(bit_filter(index, n_index)), window)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    scanned = saved(rows.mapInArrow(finder, "row long, doc_id long, text_hash long, n_words long, found array<struct<h:long,p:int,first:int,ctx:string>>"), "scanned")
    found = scanned.where(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    begin = F.col("p") - F.col("off")
    same = F.array_join(F.slice(F.split("ctx", " "), begin - F.col("first") + 1, F.col("len")), " ") == F.col("win")
    fits = (begin >= 0) & (begin + F.col("len") <= F.col("n_words"))
    hits = found.join(broadcast_measured(index), "h").where(F.when(fits, same).otherwise(False))
    hits = hits.select("row", begin.alias("at"), "len", "win").join(broadcast_measured(items), "win")
    spans = F.sort_array(F.collect_set(F.struct("at", "len")))
    per_row = hits.groupBy("row").agg(spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))

    def add(a, x):
        end = x["at"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(x["at"], a["end"]))).alias("n"))

    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add)["n"]
    out = scanned.select("row", "doc_id", "text_hash", "n_words").join(per_row.select("row", n_hit.cast("long").alias("n_hit"), "items"), "row", "left")
    out = out.na.fill(0, ["n_hit"]).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that contamination() finds clean, all columns kept. Null, empty and wordless texts are clean. Rows
    that share a doc_id are judged by their own texts, those that repeat both alike, and rows without a doc_id too; no
    rows give no rows, and an empty benchmark leaves all."""
    bad = contamination(docs, benchmark, **options).where("contaminated")
    doc, text_hash = spare(docs, "doc", "text_hash")
    bad = bad.select(id_or_default().alias(doc), F.col("text_hash").alias(text_hash)).distinct()
    keyed = docs.withColumn(doc, id_or_default()).withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(bad, [doc, text_hash], "left_anti").drop(doc, text_hash)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[pos + 1 : pos + least(len(w), 13)], ' ') AS win
  FROM (SELECT *, unnest(range(len(w) - least(len(w), 13) + 1)) AS pos FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, pos, array_to_string(w[pos + 1 : pos + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS pos FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT DISTINCT doc_id, pos, n FROM grams WHERE win IN (SELECT win FROM win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM occ) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT g.doc_id, CAST(win.item_id AS VARCHAR) AS i FROM grams g JOIN win ON g.win = win.win AND g.n = win.n) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), FALSE) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
