"""Filter, selection, fold and repair policies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import grid, ranking
from .hashing import table_fingerprint


def filter_report(chips: DataFrame, threshold: str) -> DataFrame:
    """action and reason of each chip; a chip at the threshold stays."""
    value = X.bounded_decimal(threshold, 100)
    over = F.col("nodata_pct") > F.lit(float(value))
    text = format(value.normalize(), "f")
    return chips.withColumns({"threshold_pct": F.lit(text), "action": F.when(over, "remove").otherwise("keep"), "reason": F.when(over, "nodata_pct_above_threshold").otherwise("nodata_pct_at_or_below_threshold")})


def apply_filter(chips: DataFrame, threshold: str) -> dict[str, DataFrame]:
    """active, removed, snapshot (the chips as they came, with what was decided) and metadata (one row with the
    fingerprints of what went in and what stays)."""
    report = filter_report(chips, threshold)
    active, removed = report.where("action = 'keep'").select(*chips.columns), report.where("action = 'remove'").select(*chips.columns)
    before, after = table_fingerprint(chips), table_fingerprint(active)
    meta = before.select(F.struct("*").alias("input")).crossJoin(after.select(F.struct("*").alias("output"))).withColumn("threshold_pct", F.lit(threshold))  # one row each
    return {"active": active, "removed": removed, "snapshot": report, "metadata": meta}


def filter_status(chips: DataFrame, metadata: DataFrame, threshold: str) -> str:
    """already_applied if the chips are what an earlier run with this threshold left, else pending."""
    now = table_fingerprint(chips).first()
    done = [r for r in metadata.where(F.col("threshold_pct") == threshold).select("output").collect() if tuple(r.output) == tuple(now)]
    return "already_applied" if done else "pending"


def training_selection(chips: DataFrame, policy: str = "exclude_all", fraction: str | None = None, seed: int = 41) -> DataFrame:
    """Positives stay; backgrounds go (exclude_all), or a seeded share of each region, source and class stays."""
    rows = chips.withColumn("class_presence", X.class_presence(F.col("class_0_pixel_count"), F.col("class_1_pixel_count"), F.col("nodata_pixel_count")))
    positive, presence = F.col("class_presence") == "positive", F.col("class_presence")
    if policy == "exclude_all":
        chosen, reason = positive, F.when(positive, "positive").otherwise(F.concat(F.lit("excluded_"), presence))
    elif policy == "retain_fraction":
        share: Decimal = X.bounded_decimal(fraction or "", 1)
        rows = ranking.stratified_keep(rows, ["region_id", "source_tiff_id", "class_presence"], "chip_id", share, seed)
        chosen = positive | F.col("keep")
        reason = F.when(positive, "positive").when(F.col("keep"), F.concat(F.lit("retained_"), presence, F.lit("_fraction"))).otherwise(F.concat(F.lit("excluded_"), presence, F.lit("_fraction")))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    text, seeds = ("", "") if fraction is None else (format(X.bounded_decimal(fraction, 1).normalize(), "f"), str(seed))
    return rows.withColumns({"selected_for_training": chosen, "selection_reason": reason, "policy": F.lit(policy), "retain_fraction": F.lit(text), "seed": F.lit(seeds)}).drop("keep")


def _folds(rows: DataFrame, split, reason) -> DataFrame:
    out = rows.withColumn("experiment_split", split).withColumn("selection_reason", reason).withColumn("selected", F.col("experiment_split") != "")
    return out.withColumn("view_path", F.when(F.col("selected"), X.chip_path(F.col("experiment_split"), F.col("chip_id"))).otherwise(""))


def baseline_fold(chips: DataFrame) -> DataFrame:
    """chips with selected_for_training and source_temporal_split. Training takes selected chips, evaluation the grid's."""
    on, time = X.on_grid(F.col("row_off"), F.col("col_off")), F.col("source_temporal_split")
    train, held = (time == "TRAIN") & F.col("selected_for_training"), time.isin("VAL", "TEST")
    # fixed values: names of splits and reasons, here and below
    split = F.when(train, "train").when(held & on, F.lower(time)).otherwise("")
    reason = F.when(train | (held & on), "selected").when(time == "TRAIN", "background_policy_exclusion").when(time == "VAL", "validation_overlap_exclusion").when(time == "TEST", "test_overlap_exclusion").otherwise("")
    return _folds(chips, split, reason)


def held_out_folds(chips: DataFrame, regions: list[str]) -> DataFrame:
    """All leave-one-region-out folds in one pass over the chips."""
    rows = grid.per_held_out(chips, regions)
    on, time, held = X.on_grid(F.col("row_off"), F.col("col_off")), F.col("source_temporal_split"), F.col("region_id") == F.col("held_out_region")
    train = (time == "TRAIN") & F.col("selected_for_training")
    split = F.when(held & on, "test").when(held, "").when(train, "train").when((time == "VAL") & on, "val").otherwise("")
    reason = (
        F.when(held & on, "held_out_region_test").when(held, "held_out_region_overlap_exclusion").when(train, "nonheldout_temporal_train").when(time == "TRAIN", "training_background_excluded")
        .when((time == "VAL") & on, "nonheldout_temporal_val").when(time == "VAL", "nonheldout_temporal_val_overlap_exclusion").otherwise("nonheldout_temporal_test_unused")
    )
    return _folds(rows, split, reason)


def recount(tiles: DataFrame, chips: DataFrame, nodata: float, classes: list[int]) -> DataFrame:
    """Counts with the declared nodata value beside the stored ones."""
    from .aggregates import tile_counts
    from .joins import side_by_side

    fresh = tile_counts(tiles, classes, nodata)
    return side_by_side(chips, fresh, "chip_id", ("nodata_pixel_count", "nodata_pct", "ignore_pixel_count"))


def repair_labels(pixels: DataFrame, family: str, nodata: float = 0) -> DataFrame:
    """pixels: bands, label (family masked: set class 3 at nodata pixels; family aligned: 0 outside the source's label,
    other values to 0/1, class 3 at nodata pixels; a pixel whose bands are unknown is not nodata)."""
    empty = X.is_nodata(F.col("bands"), nodata)
    empty = F.coalesce(empty, F.lit(False)) if family == "aligned" else empty
    other = F.col("label") if family == "masked" else F.when(F.col("label") == 1, 1).otherwise(0)
    return pixels.withColumn("is_nodata", empty).withColumn("label", F.when(empty, 3).otherwise(other))


def rebuild_labels(image: DataFrame, labels: DataFrame, origin: tuple[float, float], pixel: tuple[float, float], nodata: float = 0) -> DataFrame:
    """A label on the image's grid. image: source_tiff_id, row, col, x, y (map position of the pixel's centre), bands;
    labels: source_tiff_id, row, col, label on a grid of its own -> 1 where the label's pixel at that place is 1, else 0
    (outside the label too), 3 at nodata pixels of the image; with covered and is_nodata for the audit."""
    from .joins import nearest_align

    aligned = nearest_align(image, labels, origin, pixel).drop("src_row", "src_col")
    return repair_labels(aligned, "aligned", nodata)


def repaired_parts(chips: DataFrame, limit: float = 50.0) -> tuple[DataFrame, DataFrame]:
    return chips.where(F.col("nodata_pct") <= limit), chips.where(F.col("nodata_pct") > limit)


def prediction_plan(states: DataFrame, conditions: dict) -> DataFrame:
    """Latest completed runs with their status, the baseline first, then by region; position counts from 1."""
    from pyspark.sql import Window

    from .rules import package_status

    order = Window.partitionBy().orderBy(F.col("run_type") != "baseline", "held_out_region", "run_key")  # a row for each run of a suite
    return package_status(states.where("state = 'completed'"), conditions).withColumn("position", F.row_number().over(order))
