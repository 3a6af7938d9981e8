"""The run registry as a stream: latest state, transitions, incremental work and repeated delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegralType, LongType, StructType, TimestampNTZType, TimestampType

from ..operators.ranking import latest_state as latest_states


def transition_faults(events: DataFrame, keys: list[str], resumes: str, resumable: tuple[str, ...], order: str = "seq") -> DataFrame:
    """Events of status `resumes` whose predecessor isn't resumable."""
    before = F.lag("status").over(Window.partitionBy(*keys).orderBy(order))
    return events.withColumn("previous", before).where((F.col("status") == resumes) & F.col("previous").isNotNull() & ~F.col("previous").isin(*resumable))


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: How a row's fields are kept as text in the state, to the microsecond.
_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


class LatestState(StatefulProcessor):
    """Holds each key's row of the highest order and gives it out when an event replaces it; late and repeated events,
    whose order isn't higher, change nothing."""

    def __init__(self, keys: list[str], orders: list[str], state: StructType):
        self.keys, self.orders, self.schema = keys, orders, state

    def init(self, handle) -> None:
        self.held = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        names = self.schema.names
        rank = lambda row: tuple((v is not None, v) for v in row[: len(self.orders)])
        before = best = tuple(self.held.get()) if self.held.exists() else None
        for frame in rows:
            for row in frame[names].astype(object).itertuples(index=False):
                # numbers beside nulls come as floats, nulls as NaN
                row = tuple(None if v is None or v != v else int(v) if isinstance(t, LongType) else v for v, t in zip(row, self.types(), strict=True))
                if best is None or rank(row) > rank(best):
                    best = row
        if best is not before:
            self.held.update(best)
            yield pd.DataFrame({n: [v] for n, v in zip([*self.keys, *names], [*key, *best], strict=True)}).astype({n: "Int64" for n, t in zip(names, self.types(), strict=True) if isinstance(t, LongType)})

    def types(self):
        return [f.dataType for f in self.schema.fields]

    def close(self) -> None:
        pass


def latest_changes(stream: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The stream's rows that become the latest of their key, one of each key and batch, in update mode. States lie in
    Spark's state store, so a batch reads and writes those of its own keys only. The order may be a struct of numbers,
    times and strings; its leaves and the row as text are what a state holds."""
    kind = stream.schema[order].dataType
    leaves = [F.col(order)[f.name] for f in kind.fields] if isinstance(kind, StructType) else [F.col(order)]
    types = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind]
    as_state = lambda c, t: F.unix_micros(c.cast("timestamp")) if isinstance(t, (TimestampType, TimestampNTZType)) else c.cast("long") if isinstance(t, IntegralType) else c
    orders = [f"order_{k}" for k in range(len(leaves))]
    fields = [f for f in stream.schema.fields if f.name not in keys]
    given = stream.select(*keys, *[as_state(c, t).alias(n) for c, t, n in zip(leaves, types, orders, strict=True)], F.to_json(F.struct(*[f.name for f in fields]), _TEXT).alias("payload"))
    state = StructType([given.schema[n] for n in (*orders, "payload")])
    out = StructType([*[stream.schema[k] for k in keys], *state.fields])
    changed = given.groupBy(*keys).transformWithStateInPandas(statefulProcessor=LatestState(keys, orders, state), outputStructType=out, outputMode="Update", timeMode="None")
    return changed.select(*keys, F.from_json("payload", StructType(fields), _TEXT).alias("p")).select(*keys, "p.*").select(*stream.columns)


def upsert_states(stream: DataFrame, keys: list[str], path: str, checkpoint: str, order: str = "seq", compact_every: int = 20) -> None:
    """Appends events to path/events, and what they change to a log of latest states, path/changes: a batch writes the
    keys that it changes, under its own number, so one that is delivered again writes the same. Every `compact_every`
    batches the log is merged into one table (see compact)."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if compact_every and number % compact_every == compact_every - 1:
            compact(spark, keys, path, number, order)

    events = stream.writeStream.format("parquet").option("path", f"{path}/events").option("checkpointLocation", f"{checkpoint}/events").trigger(availableNow=True).start()
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        states = latest_changes(stream, keys, order).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/states").trigger(availableNow=True).start()
        for query in (events, states):
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the folders name=number that Spark has finished."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def compact(spark: SparkSession, keys: list[str], path: str, number: int, order: str = "seq") -> None:
    """Merges the log up to batch `number` into path/base/upto=number, then clears what that replaces: the log's batches
    before it, and all tables but the one before, which readers may still hold."""
    states(spark, path, number).transform(lambda rows: latest_states(rows, keys, order)).write.mode("overwrite").parquet(f"{path}/base/upto={number}")
    bases = [k for k in _numbers(spark, f"{path}/base", "upto") if k < number]
    for old in [f"{path}/base/upto={k}" for k in bases[:-1]] + [f"{path}/changes/batch={k}" for k in _numbers(spark, f"{path}/changes", "batch") if bases and k <= bases[-1]]:
        where = spark._jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def states(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest table and the log's batches after it, up to batch `upto`."""
    base = max((k for k in _numbers(spark, f"{path}/base", "upto") if upto is None or k < upto), default=None)
    parts = [f"{path}/base/upto={base}"] if base is not None else []
    parts += [f"{path}/changes/batch={k}" for k in _numbers(spark, f"{path}/changes", "batch") if (base is None or k > base) and (upto is None or k <= upto)]
    if not parts:
        raise FileNotFoundError(f"{path} has no states")
    return spark.read.parquet(*parts)


def read_states(spark: SparkSession, path: str, keys: list[str] = ["run_key"], order: str = "seq") -> DataFrame:  # noqa: B006
    """The latest state of each key."""
    return latest_states(states(spark, path), keys, order)


def run_available(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Takes what has arrived and returns the latest states."""
    upsert_states(stream, keys, path, checkpoint)
    return read_states(stream.sparkSession, path, keys)


def process_new(work: DataFrame, done: Callable[[], DataFrame], keys: list[str], process: Callable[[DataFrame], None]) -> int:
    """Processes what has no completion of the same identity; returns how many there were."""
    todo = work.join(done().select(*keys), keys, "left_anti").cache()
    n = todo.count()
    if n:
        process(todo)
    todo.unpersist()
    return n


def once_each(rows: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once: batch, or stream within a watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])
