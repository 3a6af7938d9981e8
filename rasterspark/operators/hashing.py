"""Hashes of files, identities and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("relative_path"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"))


def identity_hash(*names: str) -> Column:
    """Hash of the named columns as JSON with keys in order; nulls count."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and a sum of row hashes: the same for the same rows in any order, repeated rows counted."""
    cols = sorted(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("digest"))


def inventory(files: DataFrame, prior: DataFrame, content: str = "content") -> DataFrame:
    """files: relative_path, byte_size, kind, content -> sha256 and hash_source; only stale rows are hashed."""
    from .joins import reusable_hashes

    out = reusable_hashes(files, prior)
    return out.withColumn("sha256", F.coalesce("sha256", F.sha2(F.col(content).cast("binary"), 256))).drop(content)


def inventory_counts(inv: DataFrame) -> DataFrame:
    return inv.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("hash_source") == "reused").alias("reused"), F.count_if(F.col("hash_source") == "fresh").alias("fresh"))


def inventory_faults(inv: DataFrame, found: DataFrame, seed: int = 9, sample: int = 32) -> DataFrame:
    """Paths on one side only, other sizes, other hashes of fresh files and of a seeded sample of reused ones."""
    from .ranking import seeded_sample

    a = inv.select("relative_path", "byte_size", "sha256", "hash_source")
    b = found.select("relative_path", F.col("byte_size").alias("size"), F.col("sha256").alias("hash"))
    checked = seeded_sample(a.where("hash_source = 'reused'"), "relative_path", seed, sample).select("relative_path").unionByName(a.where("hash_source = 'fresh'").select("relative_path")).withColumn("checked", F.lit(True))
    out = a.join(b, "relative_path", "full_outer").join(checked, "relative_path", "left")
    fault = F.when(F.col("size").isNull(), "missing").when(F.col("byte_size").isNull(), "extra").when(F.col("size") != F.col("byte_size"), "size").when(F.col("checked") & ~F.col("hash").eqNullSafe(F.col("sha256")), "hash")
    return out.select("relative_path", fault.alias("fault")).where("fault IS NOT NULL")
