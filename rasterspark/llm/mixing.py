"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Documents fall into blocks of their source by a hash, more of them the larger the source. A source's quota is a number of
whole passes over its blocks and a run of permuted blocks for the rest. The tree halves the output shards again and
again: at each node a hypergeometric draw tells how many of each source's blocks go left, so quotas stay exact. Each
shard then takes its share of every source's permuted blocks, disjoint from the other shards', and orders its rows by a
hash. A document's draws are those of its block; what the mix takes of it is their sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, read_table, saved, spare

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
#: Halvings of the output: 2 ** DEPTH shards.
DEPTH = 3
#: Standard deviations around the mode within which a draw is weighed.
REACH = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def md5_key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """no, source, source_size, source_rows, target: sources by code point, null last, weigh weights in turn and share the total;
    none gets over `most` times its size, and what is over is shared by weight among the others.

    That is one level: target = least(most * size, weight * level). With the sources by cap / weight, the level is the
    first (total - caps before) / (weights from here on) that is within the source's own cap / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    everything = Window.partitionBy()  # a row for each source
    no = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("no", no).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.partitionBy().orderBy("ratio", "no").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy().orderBy("ratio", "no").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no", "level"))).over(everything)["level"]
    return per.withColumn("target", F.least(F.col("cap"), F.col("weight") * level)).select("no", "source", "source_size", "source_rows", "target")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside lambdas Spark computes an expression each time it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series eight steps up, within 1e-11 of it."""
    z, product = n + 9.0, n + 1.0
    for k in range(2, 9):
        product = product * (n + float(k))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + series - F.log(product)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `marked` out of `total` are among `drawn`, by the inverse of the distribution at `uniform`.

    Only values within REACH standard deviations of the mode are weighed, each by itself: work grows with the root of
    the numbers, and what lies beyond weighs less than the sums are rounded by.
    """
    numbers = F.struct(*[c.cast("double").alias(n) for c, n in ((total, "t"), (marked, "m"), (drawn, "d"))], uniform.alias("u"))

    def draw(x):
        t, m, d = x["t"], x["m"], x["d"]
        least, most = F.greatest(F.lit(0.0), d - (t - m)), F.least(m, d)
        mode = F.floor((m + 1) * (d + 1) / (t + 2)).cast("double")
        reach = F.ceil(REACH * F.sqrt(F.greatest(F.lit(1.0), d * (m / F.greatest(t, F.lit(1.0))) * (1 - m / F.greatest(t, F.lit(1.0))))) + REACH).cast("double")
        low, high = F.greatest(least, mode - reach), F.least(most, mode + reach)
        log = lambda k: -(log_factorial(k) + log_factorial(m - k) + log_factorial(d - k) + log_factorial(t - m - d + k))
        ks = F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))
        logs = F.transform(ks, lambda k: let(k.cast("double"), log))
        return let(F.struct(low.cast("long").alias("low"), logs.alias("logs"), x["u"].alias("u")), pick)

    def pick(x):
        return let(F.array_max(x["logs"]), lambda top: let(F.transform(x["logs"], lambda v: F.exp(v - top)), lambda weights: x["low"] + inverse(weights, x["u"])))

    def inverse(weights, u):
        none = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("k"))
        walk = lambda cut: F.aggregate(weights, none, lambda a, w: F.when(a["sum"] <= cut, F.struct((a["sum"] + w).alias("sum"), (a["k"] + 1).alias("k"))).otherwise(a))["k"]
        return let(u * F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), walk)

    return let(numbers, draw)


def uniform(*parts) -> Column:
    """A number in (0, 1) from the first 13 hex digits of a hash, as SQL can make it too."""
    return (F.conv(F.substring(md5_key(*parts), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def split_tree(quotas: DataFrame, depth: int, seed: str) -> DataFrame:
    """quotas: no, n (blocks of each source) -> shard, no, n: exact quotas of 2 ** depth shards of like size."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("no", "n"))).alias("has")).select(F.lit(1).cast("long").alias("node"), "has")

    for level in range(depth):
        total = F.aggregate("has", F.lit(0).cast("long"), lambda a, x: a + x["n"])

        def draw(a, x):
            k = hypergeometric(a["total"], x["n"], a["drawn"], uniform(seed, "split", F.col("node"), x["no"]))
            left = F.concat(a["left"], F.array(F.struct(x["no"].alias("no"), k.alias("n"))))
            return F.struct((a["total"] - x["n"]).alias("total"), (a["drawn"] - k).alias("drawn"), left.alias("left"))

        # of an odd number of blocks the half that a draw picks gets one more
        odd = F.when(uniform(seed, "odd", F.col("node")) < 0.5, F.pmod(total, F.lit(2))).otherwise(0)
        start = F.struct(total.alias("total"), (F.floor(total / 2) + odd).cast("long").alias("drawn"), F.array().cast("array<struct<no:int,n:bigint>>").alias("left"))
        left = nodes.withColumn("left", F.aggregate("has", start, draw)["left"])
        right = F.zip_with("has", "left", lambda x, y: F.struct(x["no"].alias("no"), (x["n"] - y["n"]).alias("n")))
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("has")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("has")))
        nodes = saved(left.select(F.explode(both).alias("c")).select("c.*"), f"split-{level}")
    return nodes.select((F.col("node") - (1 << depth)).cast("int").alias("shard"), F.explode("has").alias("q")).select("shard", "q.*")


def running(rows: DataFrame, value: Column, order: Column, name: str, n_sources: int) -> DataFrame:
    """rows with name: the sum of value over the rows of the same source (no) before this one in the order of a hash.

    Sums of ranges of the hash go first, so a source of many blocks is not one task's sort.
    """
    rows = rows.withColumn("order", order).withColumn("range", F.substring("order", 1, 2))
    ranges = rows.groupBy("no", "range").agg(F.sum(value).alias("there"))
    past = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("no", "range", F.coalesce(F.sum("there").over(past("no", "range")), F.lit(0)).alias("past"))
    rows = rows.join(broadcast_if_small(ranges, 256 * n_sources), ["no", "range"])
    here = F.coalesce(F.sum(value).over(past("no", "range", "order")), F.lit(0))
    return rows.withColumn(name, (F.col("past") + here).cast("long")).drop("order", "range", "past")


def row_key(seed: str) -> Column:
    """A hash of the document's id, or of its text where it has none."""
    return md5_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), F.xxhash64(F.col("text").cast("string")).cast("string"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, depth: int = DEPTH, seed: str = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size (words), source_size, target (its source's words in the mix),
    copies (draws), taken (words of all draws), draws (array of shard, words and order: where each copy goes, what of it
    is taken, and the local shuffle's key there).

    A source of r rows has 16 ** d blocks at most, d the hex digits of r less three, two at least. Of the last document
    that a source's target reaches, the mix takes the first words that the target still lacks, so a source's taken words
    are its target, rounded. The same rows and seed give the same mix. A null text has no words, very long ones are
    counted whole, a null source is a source, named last; rows that share a doc_id, or their text without one, are taken
    alike unless the target ends between them. No rows give no rows; if no text has a word, targets are 0.
    """
    return planned(docs, weights, most, depth, seed).drop("key")


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, depth: int = DEPTH, seed: str = SEED) -> DataFrame:
    """mix() with the key of each row."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), row_key(seed).alias("key"))
    sizes = saved(sizes, "mix-sizes")
    targets = saved(source_targets(sizes, weights, most), "mix-targets")
    n_sources = targets.count()
    numbered = sizes.join(broadcast_if_small(targets, n_sources), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    numbered = numbered.withColumn("passes", passes).withColumn("rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long"))
    digits = F.greatest(F.lit(2), F.length(F.hex("source_rows")) - 3)
    numbered = numbered.withColumn("block", F.substring(F.col("key"), F.lit(1), digits)).drop("source_rows")
    blocks = numbered.groupBy("no", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    blocks = running(blocks, F.col("words"), md5_key(seed, F.col("no"), F.col("block")), "before", n_sources)
    blocks = blocks.withColumn("copies", F.col("passes") + ((F.col("before") < F.col("rest")) & (F.col("words") > 0)).cast("long"))
    blocks = saved(blocks.select("no", "block", "before", "copies"), "mix-blocks")
    quotas = split_tree(blocks.groupBy("no").agg(F.sum("copies").alias("n")), depth, seed)
    by_shard = Window.partitionBy("no").orderBy("shard")  # a row for each shard
    quotas = quotas.withColumn("to", F.sum("n").over(by_shard)).withColumn("from", F.col("to") - F.col("n")).where("n > 0")
    drawn = blocks.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    drawn = running(drawn, F.lit(1), md5_key(seed, "draw", F.col("no"), F.col("block"), F.col("copy")), "rank", n_sources)
    quotas = broadcast_if_small(quotas, n_sources << depth)
    placed = drawn.alias("b").join(quotas.alias("q"), (F.col("b.no") == F.col("q.no")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    shards = placed.groupBy("b.no", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("shards"))  # `most` at most
    blocks = saved(blocks.join(shards, ["no", "block"], "left"), "mix-placed")
    at = Window.partitionBy("no", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = numbered.withColumn("inside", F.coalesce(F.sum("size").over(at), F.lit(0))).join(broadcast_if_small(blocks, blocks.count()), ["no", "block"])
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before") - F.col("inside")))
    # the block's draw after its whole passes takes what the target still lacks
    whole = lambda d: d["copy"] < F.col("passes")
    draws = F.filter(F.coalesce("shards", F.array().cast("array<struct<copy:bigint,shard:int>>")), lambda d: whole(d) | (F.col("part") > 0))
    draws = F.transform(draws, lambda d: F.struct(d["shard"].alias("shard"), F.when(whole(d), F.col("size")).otherwise(F.col("part")).alias("words"), F.xxhash64(F.lit(seed), d["shard"], d["copy"], F.col("key")).alias("order")))
    out = out.withColumn("part", part).withColumn("draws", draws)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", F.size("draws").cast("long").alias("copies"), taken.alias("taken"), "draws", "key")


def shard_rows(mixed: DataFrame) -> DataFrame:
    """The mix as rows, a row for each copy with what is taken of it, dealt by shard and shuffled within it."""
    rows = mixed.selectExpr("*", "inline(draws) AS (shard, shard_words, shard_order)").drop("draws")
    return rows.repartitionByRange("shard", "shard_order").sortWithinPartitions("shard", "shard_order")


def mixed_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The documents that the mix takes, all columns kept, with size, target, copies, taken and draws (a `_` is added to
    the name of one that docs has already). A row is a plan: a document drawn three times stands once, and one taken in
    part stands whole; mixed_rows() makes the rows of the shards, each with its words."""
    key, words, *names = spare(docs, "key", "words", "size", "target", "copies", "taken", "draws")
    plan = planned(docs, seed=seed, **options).where("copies > 0").withColumnsRenamed({"key": key}).withColumn(words, F.col("size"))
    plan = plan.select(key, words, *[F.col(c).alias(n) for c, n in zip(("size", "target", "copies", "taken", "draws"), names, strict=True)])
    # rows that share a key and size are alike to the mix
    keyed = docs.withColumn(key, row_key(seed)).withColumn(words, word_count(F.col("text")))
    return keyed.join(plan.dropDuplicates([key, words]), [key, words]).drop(key, words)


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, its words joined by one space."""
    return F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), n.cast("int")), " ")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy of a document, with the columns of docs and target (its source's words in the
    mix), taken (words of this copy), shard and shard_order. A copy taken in part has the first of its words as text, joined
    by one space, and n_chars follows it. Rows are dealt by shard and shuffled within it."""
    size, copies, draws, taken, shard, order, draw = spare(docs, "size", "copies", "draws", "taken", "shard", "shard_order", "draw")
    rows = mixed_documents(docs, **options).withColumn(draw, F.explode(draws))
    part = F.col(draw)["words"] < F.col(size)
    text = F.when(part, first_words(F.col("text"), F.col(draw)["words"])).otherwise(F.col("text"))
    out = rows.withColumns({shard: F.col(draw)["shard"], order: F.col(draw)["order"], taken: F.col(draw)["words"], "text": text})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(part, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    out = out.drop(draw, size, copies, draws)
    return out.repartitionByRange(shard, order).sortWithinPartitions(shard, order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return out.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


TARGETS = """
per AS (SELECT source, sum(size) AS source_size, count(*) AS source_rows FROM sizes GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM per),
weighed AS (
  SELECT *, CAST(1 + (no - 1) % 3 AS DOUBLE) AS weight, 3 * CAST(source_size AS DOUBLE) AS cap FROM numbered),
levels AS (
  SELECT *, cap / weight AS ratio, ((SELECT sum(source_size) FROM per)::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT no, source, CAST(source_size AS BIGINT) AS source_size, source_rows,
    least(cap, weight * (SELECT arg_min(level, (ratio, no)) FROM levels WHERE level <= ratio)) AS target FROM levels)
"""


def _uniform(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 13))::UBIGINT)::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE"


def _level(k: int) -> str:
    """The nodes of one level: each source's blocks that go left, one source after the other."""
    return f"""
n{k} AS (SELECT node, no, n, row_number() OVER (PARTITION BY node ORDER BY no) AS i, CAST(sum(n) OVER (PARTITION BY node) AS BIGINT) AS total FROM q{k}),
d{k} AS (
  SELECT node, 0 AS i, 0 AS no, 0::BIGINT AS n, 0::BIGINT AS k, total, total // 2 + CASE WHEN {_uniform("'odd'", "node")} < 0.5 THEN total % 2 ELSE 0 END AS drawn FROM (SELECT DISTINCT node, total FROM n{k})
  UNION ALL
  SELECT node, i, no, n, k, total - n, drawn - k FROM (
    SELECT *, low + len(list_filter(range(1, len(w) + 1), lambda j: list_sum(w[1:j]) <= {_uniform("'split'", "node", "no")} * list_sum(w))) AS k FROM (
      SELECT *, list_transform(logs, lambda x: exp(x - list_max(logs))) AS w FROM (
        SELECT *, list_transform(range(0, high - low + 1), lambda j: coalesce(list_sum(steps[1:j]), 0.0::DOUBLE)) AS logs FROM (
          SELECT *, list_transform(range(low, high), lambda j: ln((n - j)::DOUBLE * (drawn - j)) - ln((j + 1)::DOUBLE * (total - n - drawn + j + 1))) AS steps FROM (
            SELECT p.node, m.i, m.no, m.n, p.total, p.drawn, greatest(0, p.drawn - (p.total - m.n)) AS low, least(m.n, p.drawn) AS high FROM d{k} p JOIN n{k} m ON m.node = p.node AND m.i = p.i + 1)))))),
q{k + 1} AS (SELECT 2 * node AS node, no, k AS n FROM d{k} WHERE i > 0 UNION ALL SELECT 2 * node + 1, no, n - k FROM d{k} WHERE i > 0)"""


ORACLE = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('{SEED}:' || doc_id) AS key FROM documents),
{TARGETS},
plan AS (
  SELECT doc_id, key, size, no, source_size, target, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes,
    substr(key, 1, greatest(2, length(to_hex(source_rows)) - 3)) AS block
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
placed AS (
  SELECT *, CAST(floor(target - passes * source_size + 0.5) AS BIGINT) AS rest, coalesce(sum(size) OVER (
    PARTITION BY no ORDER BY md5('{SEED}:' || no || ':' || block), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM plan),
blocks AS (SELECT no, block, CAST(passes + CASE WHEN min(before) < rest AND sum(size) > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM placed GROUP BY no, block, passes, rest),
q0 AS (SELECT 1 AS node, no, CAST(sum(copies) AS BIGINT) AS n FROM blocks GROUP BY no),
{",".join(_level(k) for k in range(DEPTH))},
quotas AS (SELECT node - {1 << DEPTH} AS shard, no, n, sum(n) OVER (PARTITION BY no ORDER BY node) AS upto FROM q{DEPTH}),
copies AS (SELECT no, block, unnest(range(copies)) AS copy FROM blocks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY md5('{SEED}:draw:' || no || ':' || block || ':' || copy)) AS rank FROM copies),
drawn AS (SELECT r.no, block, copy, shard FROM ranked r JOIN quotas s ON s.no = r.no AND rank > upto - n AND rank <= upto),
taking AS (
  SELECT doc_id, d.shard, d.copy, CASE WHEN copy < passes THEN size ELSE greatest(0, least(size, rest - before)) END AS words, copy < passes AS whole
  FROM placed p JOIN drawn d ON d.no = p.no AND d.block = p.block),
per_doc AS (SELECT doc_id, sum(words) AS taken, string_agg(shard, ',' ORDER BY copy) AS shards FROM taking WHERE whole OR words > 0 GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(shards, '') AS shards FROM placed LEFT JOIN per_doc USING (doc_id)
"""
