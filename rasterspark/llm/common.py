"""Session helpers of the training-data operators: shared scratch tables, bounded broadcasts, row keys."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that an operator may mark for broadcast: its counted rows times what a row takes in a hash table.
BROADCAST_BYTES = 16 << 20
#: Rows of an Arrow batch; texts are long, so a batch stays small.
ARROW_ROWS = 1_000
#: Least and most bits (powers of two) of a filter of hashes that goes to every task, and bits for each hash: 1 MB for
#: half a million hashes, 32 MB for 16 million and more, where it lets more pass.
FILTER_BITS, MOST_BITS, BITS_EACH = 1 << 23, 1 << 28, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null document id inside the operators; results show null again.
NO_ID = -(2**63)


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """For operators with Python code: small Arrow batches, and code that travels with the task, not by name."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


class Table:
    """A Parquet table in the shared folder; it cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/{name}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).read()


def row_bytes(df: DataFrame) -> int:
    """What a row takes in the hash table of a broadcast: its columns, by their types (texts and hashes are short where an
    operator joins with them), and 16 bytes about them, in pages that may be half full, with 64 bytes of slots."""
    sizes = {"binary": 264, **dict.fromkeys(("boolean", "tinyint", "int", "bigint", "double"), 8)}
    return 64 + 2 * (16 + sum(sizes.get(f.dataType.simpleString(), 136) for f in df.schema))


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    return rows * row_bytes(df) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast only where its counted rows are within BROADCAST_BYTES; else for a join by shuffle, for
    Spark may take a table for small by its compressed files."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df.hint("merge")


def bit_set(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits, as 64-bit words, that are set where a hash (column h, n of them) has its last bits."""
    size = min(MOST_BITS, max(FILTER_BITS, 1 << (BITS_EACH * n).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    bits = hashes.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
    words = np.zeros(size // 64, np.int64)
    found = bits.toArrow()  # MOST_BITS / 64 pairs of numbers at most, as columns
    words[np.asarray(found["w"])] = np.asarray(found["b"])
    return words


def in_bit_set(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(64 * len(words) - 1)
    return (words.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def with_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows: doc, text_hash, text; wanted: doc, text_hash, set, saved -> their join. Where wanted is not small, a filter
    of its hashes leaves out almost all other rows before they are shuffled; it may let some pass, and loses none."""
    n = wanted.count()
    if fits_broadcast(wanted, n):
        return rows.join(F.broadcast(wanted), ["doc", "text_hash"])
    shared = rows.sparkSession.sparkContext.broadcast(bit_set(wanted.select(F.col("text_hash").alias("h")), n))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bit_set(shared.value, hashes.to_numpy().view(np.uint64)))

    return rows.where(maybe("text_hash")).join(wanted.hint("merge"), ["doc", "text_hash"])


def broadcast_measured(df: DataFrame) -> DataFrame:
    """Marks a saved table for broadcast only where its values, as measured, are within BROADCAST_BYTES."""
    wide = [f.name for f in df.schema if f.dataType.simpleString() == "string" or f.dataType.typeName() in ("array", "map", "struct")]
    sizes = [F.octet_length(F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.octet_length(F.to_json(F.struct(c))) for c in wide]
    total = df.agg(F.sum(sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(8 * len(df.columns))))).first()[0]
    return F.broadcast(df) if (total or 0) <= BROADCAST_BYTES else df


def hash_share(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """Rows (n of them) whose key's hash is among the least, a little more than `most` of them: few beyond what a limit
    takes leave their tasks."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * min(1.0, (1.05 * most + 100) / n)))


def id_or_default(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def spare(df: DataFrame, *names: str) -> tuple[str, ...]:
    """names for helper columns beside those of df, lengthened where df has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
