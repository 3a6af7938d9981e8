"""Joins of manifests, metrics and pixel grids. Absence becomes a reason or an issue, not a dropped row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = ("severity", "issue_type", "dataset", "candidate_id", "path", "details")
COUNT_FIELDS = ("total_source_pixel_count", "covered_pixel_count", "uncovered_pixel_count", "ignored_pixel_count", "scored_pixel_count")


def issue(kind: str, key: Column, path: Column, details: str = "", dataset: Column | None = None) -> list[Column]:
    values = (F.lit("error"), F.lit(kind), F.lit(None).cast("string") if dataset is None else dataset, key, path, F.lit(details))
    return [v.alias(name) for v, name in zip(values, ISSUE, strict=True)]


def paired_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """images, labels: stem, relative_path -> pairs by lower-cased stem; the other side's path is null where it lacks."""
    a = images.select(F.lower("stem").alias("k"), F.col("relative_path").alias("image_path"))
    b = labels.select(F.lower("stem").alias("k"), F.col("relative_path").alias("label_path"))
    return a.join(b, "k", "full_outer").withColumnRenamed("k", "stem")


def pairing_issues(images: DataFrame, labels: DataFrame) -> DataFrame:
    pairs = paired_files(images, labels)
    lack_label = pairs.where("label_path IS NULL").select(*issue("missing_label", F.col("stem"), F.col("image_path")))
    return lack_label.unionByName(pairs.where("image_path IS NULL").select(*issue("missing_image", F.col("stem"), F.col("label_path"))))


def identity_faults(chips: DataFrame, sources: DataFrame, fields: tuple[str, ...] = ("dataset", "region_id", "region_name", "acquisition_date")) -> DataFrame:
    """chip_id and what differs from its source: the names of fields, or missing_source."""
    s = sources.select("source_tiff_id", F.lit(True).alias("known"), *[F.col(f).alias(f"s_{f}") for f in fields])
    differs = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"s_{f}")), F.lit(f)) for f in fields]))
    out = chips.join(s, "source_tiff_id", "left")
    return out.select("chip_id", F.when(F.col("known").isNull(), F.array(F.lit("missing_source"))).otherwise(differs).alias("faults")).where(F.size("faults") > 0)


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """1:1 by lower-cased key: missing, extra or the fields that differ."""
    a = left.select(F.lower(key).alias("k"), F.lit(True).alias("in_left"), *[F.col(f).alias(f"l_{f}") for f in fields])
    b = right.select(F.lower(key).alias("k"), F.lit(True).alias("in_right"), *[F.col(f).alias(f"r_{f}") for f in fields])
    differs = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields])), ";")
    fault = F.when(F.col("in_right").isNull(), "missing").when(F.col("in_left").isNull(), "extra").otherwise(differs)
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), fault.alias("fault")).where("fault <> ''")


def with_selection(chips: DataFrame, selection: DataFrame) -> DataFrame:
    """1:1 by chip_id; unmatched or conflicting rows show in selection_faults()."""
    return chips.join(selection.select("chip_id", "selected_for_training", "class_presence"), "chip_id", "left")


def selection_faults(chips: DataFrame, selection: DataFrame) -> DataFrame:
    return reconcile(chips, selection, "chip_id", ("source_tiff_id", "region_id"))


def with_split(chips: DataFrame, split: DataFrame) -> DataFrame:
    return chips.join(split.select("source_tiff_id", F.col("split").alias("source_temporal_split")), "source_tiff_id", "left")


def split_faults(chips: DataFrame, split: DataFrame) -> DataFrame:
    """Sources of chips without a split, or whose chips disagree with it on date or region."""
    own = chips.groupBy("source_tiff_id").agg(F.count_distinct("region_id", "acquisition_date").alias("n"), F.min("region_id").alias("r"), F.min("acquisition_date").alias("d"))
    out = own.join(split.select("source_tiff_id", F.col("region_id").alias("sr"), F.col("acquisition_date").alias("sd"), F.lit(True).alias("known")), "source_tiff_id", "left")
    fault = F.when(F.col("known").isNull(), "missing_split").when(F.col("n") > 1, "inconsistent_chips").when(~F.col("r").eqNullSafe(F.col("sr")) | ~F.col("d").eqNullSafe(F.col("sd")), "metadata_conflict")
    return out.select("source_tiff_id", fault.alias("fault")).where("fault IS NOT NULL")


def provenance_faults(copies: DataFrame, alignments: DataFrame, key: str = "source_tiff_id") -> DataFrame:
    from .sets import not_subset

    twice = [t.groupBy(key).count().where("count > 1").select(key, F.lit(name).alias("fault")) for t, name in ((copies, "repeated_copy"), (alignments, "repeated_alignment"))]
    lacks = [not_subset(a, b, key).withColumn("fault", F.lit(name)) for a, b, name in ((copies, alignments, "no_alignment"), (alignments, copies, "no_copy"))]
    return twice[0].unionByName(twice[1]).unionByName(lacks[0]).unionByName(lacks[1])


def fold_chips(folds: DataFrame, chips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fold's chips with their windows, and the rows whose chip is missing or of another source."""
    c = chips.select("chip_id", F.col("source_tiff_id").alias("chip_source"), "row_off", "col_off", "chip_height", "chip_width")
    out = folds.join(c, "chip_id", "left")
    fine = F.col("chip_source") == F.col("source_tiff_id")
    return out.where(fine).drop("chip_source"), out.where(~F.coalesce(fine, F.lit(False))).select("chip_id", "source_tiff_id", "chip_source")


def shape_faults(metrics: DataFrame, rasters: DataFrame) -> DataFrame:
    r = rasters.select("source_tiff_id", (F.col("width").cast("long") * F.col("height")).alias("pixels"), F.col("acquisition_date").alias("raster_date"))
    out = metrics.join(r, "source_tiff_id", "left")
    fault = F.when(F.col("pixels").isNull(), "missing_raster").when(F.col("pixels") != F.col("total_source_pixel_count"), "shape").when(~F.col("raster_date").eqNullSafe(F.col("acquisition_date")), "date")
    return out.select("source_tiff_id", fault.alias("fault")).where("fault IS NOT NULL")


def model_pairs(expected: DataFrame, baseline: DataFrame, held_out: DataFrame, rasters: DataFrame | None = None) -> DataFrame:
    """expected: region_id, source_tiff_id, acquisition_date; the models' source metrics (with chips, a sorted array) ->
    both sides as structs b and h and exclusion_reasons, empty for a match."""
    keys = ["region_id", "source_tiff_id"]
    b = baseline.select(*keys, F.struct(*[c for c in baseline.columns if c not in keys]).alias("b"))
    h = held_out.select(*keys, F.struct(*[c for c in held_out.columns if c not in keys]).alias("h"))
    out = expected.join(b, keys, "left").join(h, keys, "left")
    both = F.col("b").isNotNull() & F.col("h").isNotNull()
    differ = lambda x, y: both & ~x.eqNullSafe(y)
    # fixed values: names of the reasons
    rules = [(F.col("b").isNull(), "missing_baseline_metrics"), (F.col("h").isNull(), "missing_loro_metrics"), (differ(F.col("b.acquisition_date"), F.col("h.acquisition_date")), "acquisition_date_mismatch"), (differ(F.col("b.chips"), F.col("h.chips")), "selected_chip_membership_mismatch")]
    rules += [(differ(F.col(f"b.{f}"), F.col(f"h.{f}")), f"{f}_mismatch") for f in COUNT_FIELDS]
    truth = {"background": ("true_negative", "false_positive"), "kelp": ("true_positive", "false_negative")}
    rules += [(differ(F.col(f"b.{x}") + F.col(f"b.{y}"), F.col(f"h.{x}") + F.col(f"h.{y}")), f"{k}_truth_count_mismatch") for k, (x, y) in truth.items()]
    if rasters is not None:
        out = out.join(rasters.select(*keys, (F.col("width").cast("long") * F.col("height")).alias("pixels")), keys, "left")
        rules += [(F.col("pixels").isNull(), "missing_raster_metadata")]
        rules += [(F.col(f"{s}.total_source_pixel_count") != F.col("pixels"), f"{name}_source_shape_mismatch") for s, name in (("b", "baseline"), ("h", "loro"))]
    reasons = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules])))), ";")
    return out.withColumn("exclusion_reasons", reasons)


def inventory_faults(current: DataFrame, historical: DataFrame) -> DataFrame:
    return current.select("run_key", F.lit(1).alias("a")).join(historical.select("run_key", F.lit(1).alias("b")), "run_key", "full_outer").where("a IS NULL OR b IS NULL").select("run_key", F.when(F.col("a").isNull(), "missing").otherwise("added").alias("fault"))


def coverage_pairs(current: DataFrame, historical: DataFrame) -> DataFrame:
    """source_tiff_id, old and new covered counts and their state: shared, added, dropped or regressed."""
    a = current.select("source_tiff_id", F.col("covered_pixel_count").alias("new_covered"), F.col("total_source_pixel_count").alias("new_total"))
    b = historical.select("source_tiff_id", F.col("covered_pixel_count").alias("old_covered"), F.col("total_source_pixel_count").alias("old_total"))
    state = F.when(F.col("old_total").isNull(), "added").when(F.col("new_total").isNull(), "dropped").when(F.col("new_covered") < F.col("old_covered"), "regressed").otherwise("shared")
    return a.join(b, "source_tiff_id", "full_outer").withColumn("state", state)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys), keys, "left_anti")


def kept(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def side_by_side(old: DataFrame, new: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    a = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields])
    return a.join(new.select(key, *[F.col(f).alias(f"new_{f}") for f in fields]), key)


def reusable_hashes(files: DataFrame, prior: DataFrame, force: bool = False) -> DataFrame:
    """A chip of the same size keeps its stored hash; what is left is stale and must be hashed again."""
    p = prior.select("relative_path", F.col("sha256").alias("old_sha256"), F.col("byte_size").alias("old_size"))
    reuse = (F.col("kind") == "chip") & (F.col("old_size") == F.col("byte_size")) & F.lit(not force)
    out = files.join(p, "relative_path", "left")
    return out.withColumn("sha256", F.when(reuse, F.col("old_sha256"))).withColumn("hash_source", F.when(reuse, "reused").otherwise("fresh")).drop("old_sha256", "old_size")


def nearest_align(targets: DataFrame, source: DataFrame, origin: tuple[float, float], pixel: tuple[float, float]) -> DataFrame:
    """targets: source_tiff_id, row, col, x, y (map position of the pixel's centre); the source's label at the pixel that
    holds the point. covered is false outside the source's pixels."""
    at_col = F.floor((F.col("x") - origin[0]) / pixel[0]).cast("int")
    at_row = F.floor((F.col("y") - origin[1]) / pixel[1]).cast("int")
    s = source.select("source_tiff_id", F.col("row").alias("src_row"), F.col("col").alias("src_col"), "label")
    out = targets.withColumn("src_row", at_row).withColumn("src_col", at_col).join(s, ["source_tiff_id", "src_row", "src_col"], "left")
    return out.withColumn("covered", F.col("label").isNotNull())


def bilinear_align(targets: DataFrame, source: DataFrame) -> DataFrame:
    """targets: key, sx, sy (place in pixel centres of the source) -> value from the four pixels around; pixels that
    lack give their weight to the others, none give null."""
    r, c = F.floor("sy").cast("int"), F.floor("sx").cast("int")
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    corners = F.array(*[F.struct((r + i).alias("row"), (c + j).alias("col"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("weight")) for i in (0, 1) for j in (0, 1)])
    spread = targets.select("key", F.explode(corners).alias("k")).select("key", "k.*").join(source.select("row", "col", "value"), ["row", "col"], "left")
    known = F.when(F.col("value").isNotNull(), F.col("weight"))
    return spread.groupBy("key").agg(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum(known)).alias("value"))


def logit_ensemble(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """mask where the mean of two models' logits is over 0.5 (the logits' mean, not a probability)."""
    out = a.select(*keys, F.col("logit").alias("a")).join(b.select(*keys, F.col("logit").alias("b")), keys)
    return out.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("logit"), ((F.col("a") + F.col("b")) / 2 > 0.5).cast("int").alias("mask"))
