"""Set algebra over tables and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_faults(before: DataFrame, active: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows that break `active + removed = before`: in both parts (by key), lost, added or changed; as many as there are
    copies. The copies of equal rows are counted on all sides at once, then the keys; rows that are dealt by one of their
    columns already stay where they are for the first count."""
    cols, sides = before.columns, (before, active, removed)
    counted = [df.select(*cols, *[F.lit(int(k == i)).alias(f"__{k}") for k in range(3)]) for i, df in enumerate(sides)]
    n, a, r = (F.col(f"__{k}") for k in range(3))
    rows = counted[0].unionByName(counted[1]).unionByName(counted[2]).groupBy(*cols).agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in range(3)])
    more = lambda x, y: F.sum(F.greatest(x - y, F.lit(0)))
    found = dealt(rows.select(F.col(key).alias("__key"), "__0", "__1", "__2"), "__key").groupBy("__key").agg(more(n, a + r).alias("lost"), more(a + r, n).alias("new"), F.sum(a).alias("a"), F.sum(r).alias("r"))
    both = F.when((F.col("r") > 0) & F.col("__key").isNotNull(), F.col("a")).otherwise(0)
    found = found.select("__key", both.alias("both"), "lost", "new").where("both > 0 OR lost > 0 OR new > 0")
    copies = lambda name, c: F.array_repeat(F.lit(name), F.col(c).cast("int"))
    faults = F.concat(copies("in_both", "both"), copies("lost_or_changed", "lost"), copies("added_or_changed", "new"))
    return found.select(F.explode(faults).alias("fault"), F.col("__key").cast("string").alias("key"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys to all shuffle partitions: sorted names compress so well that small ones would be put
    together to tasks of tens of millions of rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def added_rows(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str, samples: int = 5) -> DataFrame:
    """One row: how many keys each side lacks, and the first of them. The samples are a top-k, not a collected list."""
    missing, extra = (a.select(key).distinct().join(b.select(key), key, "left_anti") for a, b in ((left, right), (right, left)))
    def count(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))

    def first(df, name):
        return df.orderBy(key).limit(samples).agg(F.array_sort(F.collect_list(key)).alias(name))

    out = count(missing, "n_missing").crossJoin(count(extra, "n_extra"))  # one row each
    return out.crossJoin(first(missing, "missing")).crossJoin(first(extra, "extra"))


def symmetric_difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one side without a like one on the other, as many as there are copies; both sides are counted at once."""
    sides = expected.select(*keys, F.lit(1).alias("__n")).unionByName(found.select(*keys, F.lit(-1).alias("__n")))
    differ = sides.groupBy(*keys).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    side = F.when(F.col("__n") > 0, "missing").otherwise("unexpected")
    return differ.select(*keys, F.explode(F.array_repeat(side, F.abs("__n").cast("int"))).alias("side"))


def with_global(rows: DataFrame, group: str, name: str = "global") -> DataFrame:
    """Each row in its own group and in the one of all rows."""
    return rows.withColumn("scope", F.explode(F.array(F.lit(name), F.col(group))))


def not_subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    return part.select(key).distinct().join(whole.select(key), key, "left_anti")
