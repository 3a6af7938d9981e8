"""How much of a growing table a task gets, and results that don't depend on it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from compare import SF
from rasterspark.operators import sets
from rasterspark.plans import adapters
from rasterspark.plans.queries import QUERIES


@pytest.fixture
def no_broadcast(spark):
    """Small tables are joined as large ones are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chips_of_a_task_are_bounded(spark, monkeypatch, no_broadcast):
    """Many more tasks than shuffle partitions where there are more lines; adaptive execution doesn't put them together."""
    monkeypatch.setattr(adapters, "LINES", (200, 100))
    found = adapters.Tables(spark, SF)["chips"].groupBy(F.spark_partition_id().alias("p")).count().agg(F.count(F.lit(1)).alias("tasks"), F.max("count").alias("most")).first()
    assert found.tasks > 20 and found.most < 400


def test_chips_stay_where_their_source_is(spark, no_broadcast):
    """Grouping chips by source needs no shuffle beyond those of the lines and of the sources."""
    chips = adapters.Tables(spark, SF)["chips"]
    assert plan(chips.groupBy("source_tiff_id").count()).count("Exchange hash") == plan(chips.select("source_tiff_id")).count("Exchange hash")


def test_percentiles_are_not_gathered_by_group(spark):
    assert "percentile(" not in plan(QUERIES["percentile_stretch"](spark, SF))


def test_sides_are_counted_at_once(spark):
    """As many faults as there are copies, from one pass over each side (and not one for each kind of fault)."""
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (None, "n")], "k long, v string")
    active = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (4, "d")], "k long, v string")
    removed = spark.createDataFrame([(2, "x"), (3, "c"), (None, "n")], "k long, v string")
    found = sets.partition_faults(before, active, removed, "k")
    assert plan(found).count("Scan") == 3
    assert sorted(map(tuple, found.collect())) == sorted([("lost_or_changed", "1"), ("in_both", "2"), ("in_both", "2"), ("added_or_changed", "2"), ("added_or_changed", "2"), ("added_or_changed", "4")])
    found = sets.symmetric_difference(before, active, ["k", "v"])
    assert plan(found).count("Scan") == 2
    assert {(r.k, r.side) for r in found.collect()} == {(1, "missing"), (2, "unexpected"), (3, "missing"), (4, "unexpected"), (None, "missing")} and found.count() == 5


def test_rules_read_chips_once(spark):
    """All rules of a table are held against a row at once."""
    assert plan(QUERIES["chip_violations"](spark, SF)).count("lineitem") == 1


def test_sums_of_sources_are_not_moved(spark, no_broadcast):
    """Sums by source and their zeros stay where the chips are; only sums of regions are shuffled."""
    made = plan(QUERIES["class_presence_rollup"](spark, SF))
    chips = plan(adapters.Tables(spark, SF)["chips"].select("source_tiff_id"))
    assert made.count("Exchange hash") <= 2 * chips.count("Exchange hash") + 3


def test_sampled_rows_are_dealt_to_all_partitions(spark, no_broadcast):
    """Adaptive execution puts no partitions of the sample's join together, however small their files are."""
    from rasterspark.operators import ranking

    rows = spark.range(400).select(F.concat(F.lit("c"), "id").alias("chip_id"), (F.col("id") % 3).alias("g"))
    found = ranking.qa_sample(rows, ["g"], ["chip_id"], "chip_id", F.col("g") == 1)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 4 and found.count() == 133 + 2
