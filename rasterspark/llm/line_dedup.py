"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

A run is a table, bucketed and sorted by a 128-bit line hash, with the number of documents that hold the line and the
largest of their ids. Batches come in falling id ranges, so a line's keeper (its largest id) is known once it is seen.
Each new batch is merge-anti-joined, bucket by bucket and without moving the runs, with the settled lines of the runs
(those already in `min_docs` documents: nothing that a later batch adds changes their fate) and adds what is left as a
run of its own. When a level has `fanout` runs they are compacted into one run of the next level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Table, ascii_lower, broadcast_if_small, drop_path, read_table, scratch, spare

BLANKS = " \t\n\x0b\x0c\r"
#: Documents of a line whose rows are joined by broadcast, wherever they are: shuffled, they would be one task's.
HOT_DOCS = 100_000
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line's key: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """128 bits: the second hash is seeded with that of a constant, so it doesn't follow from the first."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def doc_key() -> Column:
    """doc_id; of rows without one a number below 0 from the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(NO_ID)))


class LineRuns:
    """The line store: add() takes batches in falling order of document ids, totals() merges all runs."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{scratch(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _merged(self, names: list[str]) -> DataFrame:
        """Merges runs pairwise by full outer merge joins of their buckets.

        A union with an aggregate above would read better, but Spark 4.1.2 then takes the union of bucketed scans for
        one that is partitioned by the hash, leaves the exchange out and gives the same line twice.
        """
        merged = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*HASH, F.col("n_docs").alias("n2"), F.col("keeper").alias("k2"))
            both = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            merged = merged.join(other.hint("merge"), HASH, "full_outer").select(*HASH, both.alias("n_docs"), F.greatest("keeper", "k2").alias("keeper"))
        return merged

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        self._write(self._merged(names), level + 1)
        self._drop(names)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            drop_path(self.spark, f"{self.folder}/{name}")

    def add(self, lines: DataFrame) -> None:
        """lines: doc, h1, h2, each line once for a document."""
        # counted within each task first, so a line of very many documents doesn't meet in one task
        batch = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))
        for name in self.runs():
            settled = self.spark.table(name).where(F.col("n_docs") >= self.min_docs).select(*HASH)
            batch = batch.join(settled.hint("merge"), HASH, "left_anti")
        self._write(batch, 0)

    def totals(self) -> DataFrame:
        return self._merged(self.runs())

    def drop(self) -> None:
        self._drop(self.runs())
        drop_path(self.spark, self.folder)
        self.levels = []


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """doc and drops (array of line hashes): the lines that a document loses."""
    spark = docs.sparkSession
    found = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.length(line_key(x)) >= min_chars), line_hash))
    lines = docs.select(doc_key().alias("doc"), F.explode(found).alias("h")).select("doc", "h.h1", "h.h2")
    cuts = [i / batches for i in range(1, batches)]
    bounds = sorted(set(docs.select(doc_key().alias("doc")).approxQuantile("doc", cuts, 0.01))) if cuts else []
    batch = F.lit(len(bounds)) - sum((F.when(F.col("doc") > F.lit(int(b)), 1).otherwise(0) for b in bounds), F.lit(0))
    # rows that share a doc_id are one document: its lines count once
    table = Table(lines.groupBy("doc", *HASH).agg(batch.alias("batch")).select("doc", *HASH, "batch"), "lines", "batch")
    store = LineRuns(spark, min_docs, fanout)
    for k in range(len(bounds) + 1):
        store.add(table.read().where(F.col("batch") == k))
    frequent = Table(store.totals().where(F.col("n_docs") >= min_docs), "frequent-lines")
    store.drop()
    hits = frequent_hits(table.read(), frequent.read()).where(F.col("doc") != F.col("keeper"))
    drops = Table(hits.groupBy("doc").agg(F.collect_list(F.struct(*HASH)).alias("drops")), "line-drops")
    table.drop()
    frequent.drop()
    return drops.read()


def frequent_hits(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The rows of lines that are frequent, with their keepers. There are few lines of HOT_DOCS documents or more (as many
    as there are rows, divided by that): they are joined first, and the rest by shuffle where it isn't small."""
    n, hot = frequent.agg(F.count(F.lit(1)), F.count_if(F.col("n_docs") >= HOT_DOCS)).first()
    keepers = frequent.select(*HASH, "keeper")
    if not hot:
        return lines.join(broadcast_if_small(keepers, n), HASH)
    often = frequent.where(F.col("n_docs") >= HOT_DOCS).select(*HASH, F.col("keeper").alias("often"))
    rows = lines.join(broadcast_if_small(often, hot), HASH, "left")
    rare = frequent.where(F.col("n_docs") < HOT_DOCS).select(*HASH, "keeper")
    return rows.where("often IS NOT NULL").withColumnRenamed("often", "keeper").unionByName(rows.where("often IS NULL").drop("often").join(broadcast_if_small(rare, n), HASH))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Drops every line whose key has at least min_chars code points and is found in at least min_docs documents, except
    in the largest doc_id that holds it.

    Returns the rows of docs with text replaced by the lines left, joined by \\n, and with n_lines (before dropping) and
    n_dropped, which replace columns of these names. A null or empty text is one empty line; a line repeated in one
    document counts once; rows that share a doc_id are one document and keep or lose the line alike; rows without a
    doc_id are a document for each different text, below all ids from 0 on. No rows give no rows; other columns pass
    through.
    """
    drops = repeated_lines(docs, min_chars, min_docs, batches, fanout)
    doc, lost, left = spare(docs, "doc", "lost", "left")
    drops = drops.select(F.col("doc").alias(doc), F.col("drops").alias(lost))
    lines, dropped = lines_of(F.col("text")), F.col(lost)
    kept = F.filter(lines, lambda x: (F.length(line_key(x)) < min_chars) | ~F.array_contains(dropped, line_hash(x)))
    # by shuffle at every size: the drops are a table now, which Spark would broadcast while it is small
    out = docs.withColumn(doc, doc_key()).join(drops.hint("merge"), doc, "left")
    out = out.withColumn(left, F.when(dropped.isNull(), lines).otherwise(kept)).withColumn("n_lines", F.size(lines).cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size(left)).withColumn("text", F.array_join(left, "\n"))
    return out.drop(doc, lost, left)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
freq AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, freq.keeper IS NOT NULL AND freq.keeper <> doc_id AS gone FROM keyed LEFT JOIN freq USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
