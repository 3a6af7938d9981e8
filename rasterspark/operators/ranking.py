"""Rankings, samples, chronological cuts and neighbourhoods."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(seed: int | str, *names: str):
    """Hash of the seed and the columns, joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", F.lit(str(seed)), *[F.col(n) for n in names]), 256)


def stratified_keep(rows: DataFrame, strata: list[str], key: str, fraction: Decimal, seed: int) -> DataFrame:
    """keep: the first int(n * fraction) of each stratum by seeded hash, then key without case, then key."""
    order = Window.partitionBy(*strata).orderBy(seeded_order(seed, *strata, key), F.lower(key), key)
    n = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    most = F.floor(n.cast("decimal(18,0)") * F.lit(fraction))
    return rows.withColumn("keep", F.row_number().over(order) <= most)


def latest_state(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    fields = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("s")).select(*keys, "s.*")


def date_groups(sources: DataFrame) -> DataFrame:
    """region_id, acquisition_date, n, index, before (sources of earlier dates), gap_days and year_change to the one before."""
    order = Window.partitionBy("region_id").orderBy("acquisition_date")
    out = sources.groupBy("region_id", "acquisition_date").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lag("acquisition_date").over(order)
    return out.withColumns({"index": F.row_number().over(order) - 1, "before": before, "gap_days": F.datediff("acquisition_date", last), "year_change": (F.year("acquisition_date") != F.year(last)).cast("int")})


def best_cuts(groups: DataFrame, fractions: tuple[float, float, float] = (0.7, 0.15, 0.15), bonus: float = 0.05) -> DataFrame:
    """The best pair of cuts of each region with three dates or more: least sum of distances from the fractions less a
    bonus for each year's end, then the longest gaps, then the earliest cuts. Work is dates squared, never rows."""
    cuts = groups.where("index > 0").select("region_id", "index", "before", "gap_days", "year_change")
    total = groups.groupBy("region_id").agg(F.sum("n").alias("total"))
    a, b = cuts.alias("a"), cuts.alias("b")
    pairs = a.join(b, (F.col("a.region_id") == F.col("b.region_id")) & (F.col("a.index") < F.col("b.index"))).select(F.col("a.region_id").alias("region_id"), F.col("a.index").alias("i"), F.col("b.index").alias("j"), F.col("a.before").alias("x"), F.col("b.before").alias("y"), (F.col("a.gap_days") + F.col("b.gap_days")).alias("gap"), (F.col("a.year_change") + F.col("b.year_change")).alias("years"))
    pairs = pairs.join(total, "region_id")
    parts = (F.col("x"), F.col("y") - F.col("x"), F.col("total") - F.col("y"))
    error = sum((F.abs(p / F.col("total") - f) for p, f in zip(parts, fractions, strict=True)), F.lit(0.0))
    score = F.struct((error - bonus * F.col("years")).alias("error"), (-F.col("gap")).alias("gap"), "i", "j")
    return pairs.groupBy("region_id").agg(F.min(score).alias("s")).select("region_id", F.col("s.i").alias("first_cut"), F.col("s.j").alias("second_cut"))


def temporal_split(sources: DataFrame, fractions: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """sources with split: whole dates stay together. Regions of fewer than three dates, and sources without a region or a
    date, get a null split."""
    groups = date_groups(sources.where("region_id IS NOT NULL AND acquisition_date IS NOT NULL"))
    cuts = groups.join(best_cuts(groups, fractions), "region_id", "left")
    split = F.when(F.col("first_cut").isNull(), None).when(F.col("index") < F.col("first_cut"), "TRAIN").when(F.col("index") < F.col("second_cut"), "VAL").otherwise("TEST")
    return sources.join(cuts.select("region_id", "acquisition_date", split.alias("split")), ["region_id", "acquisition_date"], "left")


def chronology_faults(split: DataFrame) -> DataFrame:
    """Dates with two splits, and dates whose split comes before that of an earlier date."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in (("TRAIN", 0), ("VAL", 1), ("TEST", 2)) for x in kv]), F.col("split"))
    days = split.groupBy("region_id", "acquisition_date").agg(F.count_distinct("split").alias("splits"), F.min(rank).alias("low"), F.max(rank).alias("high"))
    last = F.lag("high").over(Window.partitionBy("region_id").orderBy("acquisition_date"))
    fault = F.when(F.col("splits") > 1, "mixed_date").when(last > F.col("low"), "out_of_order")
    return days.withColumn("fault", fault).where("fault IS NOT NULL").select("region_id", "acquisition_date", "fault")


def threshold_examples(chips: DataFrame, thresholds: tuple[float, ...], per_side: int | None = None) -> list[tuple[float, str, str]]:
    """For each threshold the nearest chip below (or at) and above it, none used twice. Spark ranks; the pick walks over
    as many rows a side as there are sides, which is enough for a choice without reuse."""
    most = per_side or 2 * len(thresholds)
    rows = chips.withColumn("t", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(thresholds)])))
    rows = rows.withColumn("side", F.when(F.col("nodata_pct") <= F.col("t.threshold"), "below").otherwise("above"))
    order = Window.partitionBy("t.k", "side").orderBy(F.abs(F.col("nodata_pct") - F.col("t.threshold")), F.desc("class_1_pixel_count"), "chip_id")
    near = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("t.k", "t.threshold", "side", "rank", "chip_id").collect()
    used, out = set(), []
    for k, threshold in enumerate(thresholds):
        for side in ("below", "above"):
            for row in sorted((r for r in near if r.k == k and r.side == side), key=lambda r: r["rank"]):
                if row.chip_id not in used:
                    used.add(row.chip_id)
                    out.append((float(threshold), side, row.chip_id))
                    break
    return out


def qa_sample(rows: DataFrame, groups: list[str], order: list[str], key: str, partial: Column) -> DataFrame:
    """The first row of each value of each grouping column, and every partial chip; each key once.

    The first row of a group is a partial aggregate, not a sort of the group. Both sides of the join are dealt to all
    shuffle partitions (sets.dealt).
    """
    from .sets import dealt

    first = F.min_by(key, F.struct(*order, key))
    keys = [rows.groupBy(g).agg(first.alias(key)).select(key) for g in groups]
    wanted = rows.where(partial).select(key)
    for k in keys:
        wanted = wanted.unionByName(k)
    return dealt(rows, key).join(dealt(wanted, key).distinct(), key, "left_semi")


def seeded_sample(rows: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """k rows, the same for the same seed and keys (a top-k)."""
    return rows.orderBy(seeded_order(seed, key), key).limit(k)


def extremes(deltas: DataFrame, value: str = "delta", k: int = 5) -> DataFrame:
    """The k lowest and k highest known values; ties by source."""
    known = deltas.where(F.col(value).isNotNull())
    low = known.orderBy(value, "source_tiff_id").limit(k).withColumn("end", F.lit("lowest"))
    return low.unionByName(known.orderBy(F.desc(value), "source_tiff_id").limit(k).withColumn("end", F.lit("highest")))


def wins(regions: DataFrame, value: str = "delta") -> DataFrame:
    return regions.agg(F.count_if(F.col(value) > 0).alias("wins"), F.count(value).alias("known"))


def manifest_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.lower("region_id"), "acquisition_date", F.lower("source_tiff_id"), "source_tiff_id")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Sorted rows with their places from 1 on: a range sort, then the rows before each partition are added; no task
    sorts or holds the table. The sort is written, for it need not cut its ranges alike twice."""
    from ..sources.scratch import saved

    cut = saved(rows.withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()), "numbered")
    sizes = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return cut.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn(name, F.col("before") + inside + 1).drop("part", "id", "before")


def footprint_order(regions: DataFrame, last: str = "bc") -> DataFrame:
    return regions.orderBy(F.col("region_id") == last, "region_id")


def extreme_regions(regions: DataFrame, value: str = "removed_pct") -> DataFrame:
    return regions.agg(F.max_by("region_id", F.struct(value, "region_id")).alias("most"), F.min_by("region_id", F.struct(value, "region_id")).alias("least"))


def slope(cells: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """cells: source_tiff_id, row, col, value -> slope in degrees from the 3 x 3 neighbourhood; null if a neighbour is
    null or lacks. Cells are gathered to blocks, and blocks exchange their borders (blocks.slope_blocks)."""
    from . import blocks

    keys = ["source_tiff_id"]
    found = blocks.slope_blocks(blocks.gathered(cells, keys, ["value"]), keys, "value", cell_size)
    return blocks.block_pixels(found, keys, "slope")
