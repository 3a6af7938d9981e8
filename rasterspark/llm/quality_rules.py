"""Quality rules with adaptive thresholds from mergeable quantile sketches of each language and source.

A sketch is a table: counts of values cut to three significant digits, so sketches merge by adding counts and each has
900 rows a decade at most. A threshold lies beyond an upper quantile by a multiple of its distance from a lower one, both
read from the sketch; there are no fixed cutoffs. A quantile is read from the narrowest sketch (source, language, all)
with BEYOND documents beyond it; thresholds are joined back to the documents of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, read_table, saved, small_batches
from .doc_stats import STATS_SCHEMA, counted

#: Name, numerator, denominator (values are thousandths), lower and upper quantile (hundredths), reach, also a lower fence?
METRICS = (
    ("word_length", "word_chars", "n_words", 25, 75, 4, True),
    ("symbols", "n_symbols", "n_words", 25, 75, 3, False),
    ("dup_lines", "n_dup_lines", "n_lines", 50, 99, 1, False),
    ("repeats", "n_repeat_words", "n_words", 50, 99, 1, False),
)
#: Documents that a sketch must have beyond an upper quantile.
BEYOND = 10
LEVELS = ("source", "lang", "all")


def significant(value: Column) -> Column:
    """A count cut to its three leading digits."""
    scale = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.length(value.cast("string")) - 3)).cast("long")
    return value - F.pmod(value, scale)


def sketches(values: DataFrame) -> DataFrame:
    """lang, source, metric, value -> level, lang, source, metric, bin, n for sources, languages and all documents."""
    base = values.groupBy("lang", "source", "metric", significant(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    base = saved(base, "quality-sketches")
    merged = base.select(F.lit("source").alias("level"), "*")
    for level, lang in (("lang", F.col("lang")), ("all", F.lit(""))):
        merged = merged.unionByName(base.groupBy(lang.alias("lang"), "metric", "bin").agg(F.sum("n").alias("n")).select(F.lit(level).alias("level"), "lang", F.lit("").alias("source"), "metric", "bin", "n"))
    return merged


def metric_value(i: int) -> Column:
    """What METRICS say of the row's metric."""
    return F.element_at(F.create_map(*[F.lit(x) for m in METRICS for x in (m[0], m[i])]), F.col("metric"))


def fences(merged: DataFrame) -> DataFrame:
    """Of each sketch with enough documents (of the widest in any case) both quantiles and the fences beyond them."""
    group = ["level", "lang", "source", "metric"]
    at = Window.partitionBy(*group)
    cut = merged.withColumn("seen", F.sum("n").over(at.orderBy("bin"))).withColumn("docs", F.sum("n").over(at))
    quantile = lambda i: F.min(F.when(100 * F.col("seen") >= metric_value(i) * F.col("docs"), F.col("bin")))
    out = cut.groupBy(*group).agg(F.max("docs").alias("docs"), quantile(3).alias("lower"), quantile(4).alias("upper"))
    out = out.where((F.col("level") == "all") | (F.col("docs") * (100 - metric_value(4)) >= 100 * BEYOND))
    width = metric_value(5) * (F.col("upper") - F.col("lower"))
    return out.withColumn("high", F.col("upper") + width).withColumn("low", F.when(metric_value(6), F.col("lower") - width).otherwise(0))


def judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """judge() with lang and source, and the fences()."""
    spark = docs.sparkSession
    small_batches(spark)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name("lang"), name("source"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(counted, f"doc_id long, lang string, source string, {STATS_SCHEMA}")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = saved(rows.withColumn("base_failed", failed), "quality-counts")
    value = lambda m: F.expr(f"1000 * {m[1]} DIV greatest({m[2]}, 1)")
    values = rows.where("NOT base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m[0]).alias("metric"), value(m).alias("value")) for m in METRICS])).alias("v")).select("lang", "source", "v.*")
    limits = saved(fences(sketches(values)), "quality-fences")
    wide = limits.groupBy("level", "lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high").alias("limit")))).alias("limits"))
    wide = saved(wide, "quality-limits")
    out, n = rows.withColumn("one", F.lit(1)), wide.count()
    for level, keys in (("source", ["lang", "source"]), ("lang", ["lang"])):
        out = out.join(broadcast_if_small(wide.where(F.col("level") == level).select(*keys, F.col("limits").alias(f"l_{level}")), n), keys, "left")
    # the widest sketch has one row
    out = out.join(F.broadcast(wide.where("level = 'all'").select(F.lit(1).alias("one"), F.col("limits").alias("l_all"))), "one", "left")
    limit = lambda m: F.coalesce(*[F.try_element_at(f"l_{level}", F.lit(m[0])) for level in LEVELS])
    outside = [F.when(value(m).between(limit(m)["low"], limit(m)["high"]), None).otherwise(F.lit(m[0])) for m in METRICS]
    out = out.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*outside))))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"), limits


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept and failed (names of the metrics outside
    their fences; empty where base_failed).

    A null or empty text has no words and fails; very long texts are counted whole. A null lang or source counts as an
    empty name. Thresholds follow the documents that pass the base rules: a group with fewer than BEYOND of them beyond
    a metric's upper quantile uses the next wider sketch for that metric, the widest whatever its size. No rows give no
    rows; rows that share a doc_id are judged one by one; other columns are not read.
    """
    return judged(docs)[0].drop("lang", "source")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).drop("failed")


_VALUES = " UNION ALL ".join(f"SELECT lang, source, '{m[0]}' AS metric, 1000 * {m[1]} // greatest({m[2]}, 1) AS value FROM base WHERE NOT base_failed" for m in METRICS)


def _case(i: int) -> str:
    return "CASE metric " + " ".join(f"WHEN '{m[0]}' THEN {int(m[i])}" for m in METRICS) + " END"


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE n > 1) AS n_dup_lines FROM (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS n
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM w)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) GROUP BY doc_id),
grams AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (
    SELECT doc_id, pos, array_to_string(ws[pos + 1 : pos + 8], ' ') AS gram
    FROM (SELECT *, unnest(range(len(ws) - 7)) AS pos FROM w WHERE len(ws) >= 8))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(ws) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(ws) AS base_failed
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
vals AS ({_VALUES}),
src AS (
  SELECT lang, source, metric, value - value % CAST(pow(10, greatest(0, length(CAST(value AS VARCHAR)) - 3)) AS BIGINT) AS bin, count(*) AS n
  FROM vals GROUP BY ALL),
merged AS (
  SELECT 'source' AS level, * FROM src
  UNION ALL SELECT 'lang', lang, '', metric, bin, sum(n) FROM src GROUP BY lang, metric, bin
  UNION ALL SELECT 'all', '', '', metric, bin, sum(n) FROM src GROUP BY metric, bin),
cut AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS seen,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs FROM merged),
quant AS (
  SELECT level, lang, source, metric, max(docs) AS docs, min(bin) FILTER (WHERE 100 * seen >= {_case(3)} * docs) AS lower,
    min(bin) FILTER (WHERE 100 * seen >= {_case(4)} * docs) AS upper FROM cut GROUP BY ALL),
fence AS (
  SELECT *, upper + {_case(5)} * (upper - lower) AS high, CASE WHEN {_case(6)} = 1 THEN lower - {_case(5)} * (upper - lower) ELSE 0 END AS low
  FROM quant WHERE level = 'all' OR docs * (100 - {_case(4)}) >= {100 * BEYOND}),
judged AS (
  SELECT b.doc_id, m.metric, m.value BETWEEN coalesce(s.low, l.low, a.low) AND coalesce(s.high, l.high, a.high) AS fine
  FROM base b
  JOIN LATERAL (SELECT * FROM (VALUES {", ".join(f"('{m[0]}', 1000 * b.{m[1]} // greatest(b.{m[2]}, 1))" for m in METRICS)}) AS v(metric, value)) m ON TRUE
  LEFT JOIN fence s ON s.level = 'source' AND s.lang = b.lang AND s.source = b.source AND s.metric = m.metric
  LEFT JOIN fence l ON l.level = 'lang' AND l.lang = b.lang AND l.metric = m.metric
  LEFT JOIN fence a ON a.level = 'all' AND a.metric = m.metric)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (SELECT bool_and(coalesce(fine, FALSE)) FROM judged j WHERE j.doc_id = base.doc_id) AS kept
FROM base
"""
