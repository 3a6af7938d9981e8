"""Aggregations of chips, sources, pixels and metrics. Counts are summed before ratios are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.metrics import CONFUSION, COUNTS, RATIOS, confusion, ratios
from . import grid

PRESENCE = ("positive", "clean_background_only", "mixed_background_nodata", "ignore_only")
PERCENTILES = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)
PIXELS = ("total_pixel_count", "class_0_pixel_count", "class_1_pixel_count", "ignore_pixel_count", "nodata_pixel_count")


def class_columns(remap: tuple[int, ...], ignore: int = X.IGNORE) -> list[int]:
    return sorted({v for v in remap if v != ignore})


def tile_counts(tiles: DataFrame, classes: list[int], nodata: float = 0, ignore: int = X.IGNORE) -> DataFrame:
    """Pixel counts of each tile beside its other columns; the arrays (image, label) are counted where they are read and
    aren't moved on. A pixel is nodata if all its bands are."""
    names = ["total_pixel_count", *[f"class_{v}_pixel_count" for v in classes], "ignore_pixel_count", "nodata_pixel_count"]
    kept = [c for c in tiles.columns if c not in ("image", "label")]
    schema = ", ".join([*[f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in kept], *[f"{n} long" for n in names]])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            sizes = zip(*[cols[c].to_pylist() for c in ("h", "w", "b")], strict=True)
            rows = []
            for k, (h, w, b) in enumerate(sizes):
                label, image = (cols[c][k].values.to_numpy(zero_copy_only=False) for c in ("label", "image"))
                whole = min(h * w, len(image) // b) if b else 0  # an array that is too short has fewer pixels
                empty = (image[: whole * b].reshape(whole, b) == nodata).all(axis=1)
                rows.append([h * w, *[np.count_nonzero(label == v) for v in (*classes, ignore)], np.count_nonzero(empty)])
            found = np.array(rows, np.int64).reshape(len(rows), len(names))
            yield pa.record_batch([*[cols[c] for c in kept], *[pa.array(found[:, i]) for i in range(len(names))]], names=[*kept, *names])

    out = tiles.select(*kept, "image", "label").mapInArrow(count, schema)
    return out.withColumn("nodata_pct", X.percentage(F.col("nodata_pixel_count"), F.col("total_pixel_count")))


def pixel_counts(pixels: DataFrame, keys: list[str], classes: list[int], nodata: float = 0, ignore: int = X.IGNORE) -> DataFrame:
    """The same from a pixel table: label and bands."""
    aggs = [F.count_if(F.col("label") == v).alias(f"class_{v}_pixel_count") for v in classes]
    return pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_pixel_count"), *aggs, F.count_if(F.col("label") == ignore).alias("ignore_pixel_count"), F.count_if(X.is_nodata(F.col("bands"), nodata)).alias("nodata_pixel_count"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _sums(cols: tuple[str, ...] = PIXELS) -> list[Column]:
    return [F.sum(c).alias(c) for c in cols]


def group_summary(chips: DataFrame, *keys: str) -> DataFrame:
    presence = F.create_map(*[x for p in PRESENCE for x in (F.lit(p), F.count_if(F.col("class_presence") == p))])
    return chips.groupBy(*keys).agg(F.count(F.lit(1)).alias("chips"), F.count_distinct("source_tiff_id").alias("sources"), *_sums(), presence.alias("class_presence"))


def source_rollup(chips: DataFrame, size: int) -> DataFrame:
    """A row for each source: identity, chips, partial chips, presence counts and pixel sums."""
    identity = ("dataset", "region_id", "region_name", "acquisition_date", "source_width", "source_height")
    partial = F.count_if((F.col("chip_width") < size) | (F.col("chip_height") < size))
    presence = [F.count_if(F.col("class_presence") == p).alias(f"{p}_chips") for p in PRESENCE]
    return chips.groupBy("source_tiff_id").agg(*[F.min_by(c, "chip_index").alias(c) for c in identity], F.count(F.lit(1)).alias("chips"), partial.alias("partial_chips"), *presence, *_sums())


def presence_rollup(selection: DataFrame) -> DataFrame:
    """scope (global, region, source) x class presence, selected and excluded sums; every class is there, 0 if unseen.

    Sums are taken by source first. Chips that are dealt by source are not moved for them, nor for their zeros; only sums
    of regions are copied for the wider scopes.
    """
    chosen = F.col("selected_for_training")
    sums = [F.coalesce(F.sum(F.when(chosen if s == "selected" else ~chosen, F.col(c))), F.lit(0)).alias(f"{s}_{c}") for c in PIXELS for s in ("selected", "excluded")]
    per = selection.groupBy("region_id", "source_tiff_id", "class_presence").agg(F.count(F.lit(1)).alias("chips"), F.count_if(chosen).alias("selected_chips"), F.count_if(~chosen).alias("excluded_chips"), *sums)
    measures = ["chips", "selected_chips", "excluded_chips", *[f"{s}_{c}" for c in PIXELS for s in ("selected", "excluded")]]
    by_source = grid.zero_filled(per, ["region_id", "source_tiff_id"], "class_presence", PRESENCE, measures)
    by_region = per.groupBy("region_id", "class_presence").agg(*_sums(tuple(measures))).withColumn("level", F.explode(F.array(F.lit("global"), F.lit("region"))))
    wider = by_region.groupBy("level", F.when(F.col("level") == "region", F.col("region_id")).alias("region"), "class_presence").agg(*_sums(tuple(measures)))
    wider = grid.zero_filled(wider, ["level", "region"], "class_presence", PRESENCE, measures).withColumn("source", F.lit(None).cast("string"))
    return by_source.withColumnsRenamed({"region_id": "region", "source_tiff_id": "source"}).withColumn("level", F.lit("source")).unionByName(wider).select("level", "region", "source", "class_presence", *measures)


def filter_rollup(report: DataFrame) -> DataFrame:
    """Kept and removed chips, retained sums and the largest retained percentage (0 if none) by (), region, source; by
    source first, so the grouping sets copy sources and not chips."""
    keep = F.col("action") == "keep"
    names = [f"retained_{c}" for c in ("total_pixel_count", "class_1_pixel_count", "nodata_pixel_count")]
    aggs = [F.count(F.lit(1)).alias("chips"), F.count_if(keep).alias("kept_chips"), F.count_if(~keep).alias("removed_chips")]
    aggs += [F.coalesce(F.sum(F.when(keep, F.col(n.removeprefix("retained_")))), F.lit(0)).alias(n) for n in names]
    per = report.groupBy("region_id", "source_tiff_id").agg(*aggs, F.coalesce(F.max(F.when(keep, F.col("nodata_pct"))), F.lit(0.0)).alias("most"))
    sums = [*_sums(("chips", "kept_chips", "removed_chips", *names)), F.max("most").alias("max_retained_nodata_pct")]
    grouped = per.groupingSets([[], [F.col("region_id")], [F.col("region_id"), F.col("source_tiff_id")]], F.col("region_id"), F.col("source_tiff_id")).agg(F.grouping_id().alias("g"), *sums)
    return grouped.withColumn("level", F.when(F.col("g") == 3, "global").when(F.col("g") == 1, "region").otherwise("source")).drop("g")


def percentile_rows(chips: DataFrame, value: str, group: str) -> DataFrame:
    """Exact percentiles with linear interpolation, in long form, of all rows and of each group (quantiles.py)."""
    from .quantiles import counted_quantiles
    from .sets import with_global

    counts = chips.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    counts = with_global(counts, group).groupBy("scope", value).agg(F.sum("n").alias("n"))
    found = counted_quantiles(counts, "scope", value, tuple(p / 100 for p in PERCENTILES))
    numbers = F.element_at(F.create_map(*[F.lit(x) for p in PERCENTILES for x in (p / 100, p)]), F.col("point"))
    return found.select("scope", numbers.alias("percentile"), F.col(value).alias("value"))


def threshold_candidates(chips: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """What each candidate would remove, of all chips and of each region. Three steps: by region and source, by scope and
    source, by scope."""
    from .sets import with_global

    gone = F.col("nodata_pct") > F.col("threshold_pct")
    per = grid.with_thresholds(chips, thresholds).groupBy("threshold_pct", "region_id", "source_tiff_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("removed"), F.sum("class_1_pixel_count").alias("c1"), F.coalesce(F.sum(F.when(gone, F.col("class_1_pixel_count"))), F.lit(0)).alias("c1_removed"))
    by_source = with_global(per, "region_id").groupBy("threshold_pct", "scope", "source_tiff_id").agg(*_sums(("n", "removed", "c1", "c1_removed")))
    lost = F.when(F.col("removed") == F.col("n"), F.col("source_tiff_id"))
    out = by_source.groupBy("threshold_pct", "scope").agg(
        F.sum("n").alias("total_chips"), (F.sum("n") - F.sum("removed")).alias("retained_chips"), F.sum("removed").alias("removed_chips"), F.count(F.lit(1)).alias("total_source_tiffs"), F.count_if(F.col("removed") > 0).alias("source_tiffs_affected"),
        F.count(lost).alias("source_tiffs_eliminated"), F.array_join(F.array_sort(F.collect_list(lost)), ";").alias("eliminated_source_tiff_ids"), F.sum("c1").alias("class_1_pixels_total"), F.sum("c1_removed").alias("class_1_pixels_removed"))
    return out.withColumns({
        "candidate_basis": X.candidate_basis(F.col("threshold_pct")), "removed_chip_pct": X.percentage(F.col("removed_chips"), F.col("total_chips")), "region_eliminated": (F.col("scope") != "global") & (F.col("retained_chips") == 0),
        "class_1_pixels_retained": F.col("class_1_pixels_total") - F.col("class_1_pixels_removed"),
        "class_1_pixels_removed_pct": F.when(F.col("class_1_pixels_total") > 0, X.percentage(F.col("class_1_pixels_removed"), F.col("class_1_pixels_total"))).otherwise(0.0)})


def audit_bins(chips: DataFrame) -> DataFrame:
    p = F.col("nodata_pct")
    return chips.groupBy("source_tiff_id").agg(F.count_if(p == 0).alias("zero"), F.count_if((p > 0) & (p <= 50)).alias("to_50"), F.count_if(p > 50).alias("over_50"))


def channel_stats(pixels: DataFrame, keys: list[str], bands: int, max_value: float = 1.0) -> DataFrame:
    """Mean and sample deviation of each band over pixels with any band over 0, scaled by max_value; deviation 0 for one
    pixel. A group without such a pixel has no row."""
    lit = pixels.where(F.exists("bands", lambda x: x > 0))
    aggs = [a for k in range(bands) for a in (F.avg(F.col("bands")[k] / max_value).alias(f"mean_{k}"), F.coalesce(F.stddev_samp(F.col("bands")[k] / max_value), F.lit(0.0)).alias(f"std_{k}"))]
    return (lit.groupBy(*keys) if keys else lit.groupBy()).agg(F.count(F.lit(1)).alias("n_pixels"), *aggs)


def source_metrics(pixels: DataFrame, sources: DataFrame, keys: list[str] = ["source_tiff_id"]) -> DataFrame:  # noqa: B006
    """pixels: covered pixels with label and mask; sources: keys and total_source_pixel_count. Uncovered pixels are what
    the source has beyond the covered ones, so no dense grid is made."""
    counts = pixels.groupBy(*keys).agg(*confusion(F.col("label"), F.col("mask")))
    out = sources.join(counts, keys, "left").na.fill(0, list(COUNTS))
    out = out.withColumn("uncovered_pixel_count", F.col("total_source_pixel_count") - F.col("covered_pixel_count"))
    return out.select("*", *ratios())


def pooled(metrics: DataFrame, *keys: str) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in CONFUSION]).select("*", *ratios())


def region_metrics(metrics: DataFrame) -> DataFrame:
    """Pooled metrics of each region and of all, with the number of sources."""
    sums = [F.sum(c).alias(c) for c in (*CONFUSION, "scored_pixel_count", "ignored_pixel_count", "covered_pixel_count", "uncovered_pixel_count", "total_source_pixel_count")]
    rows = metrics.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("region_id"))))
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("source_count"), *sums).select("*", *ratios())


def equal_region_mean(regions: DataFrame) -> DataFrame:
    return regions.where("scope <> 'all'").agg(*[F.avg(r).alias(r) for r in RATIOS]).withColumn("scope", F.lit("equal_region_mean"))


def paired_summary(matched: DataFrame) -> DataFrame:
    """matched: region_id, b and h (metric structs) -> pooled metrics of both models and their delta, by region, over all
    pixels and as the mean of regions."""
    rows = matched.withColumn("scope", F.explode(F.array(F.lit("all_pixels"), F.col("region_id"))))
    sides = F.explode(F.array(F.struct(F.lit("baseline").alias("model"), *[F.col(f"b.{c}").alias(c) for c in CONFUSION]), F.struct(F.lit("held_out").alias("model"), *[F.col(f"h.{c}").alias(c) for c in CONFUSION])))
    long = pooled(rows.select("scope", sides.alias("m")).select("scope", "m.*"), "scope", "model")
    mean = long.where("scope <> 'all_pixels'").groupBy("model").agg(*[F.avg(r).alias(r) for r in RATIOS]).withColumn("scope", F.lit("equal_region_mean"))
    both = long.select("scope", "model", *RATIOS).unionByName(mean.select("scope", "model", *RATIOS))
    pick = lambda m, r: F.max(F.when(F.col("model") == m, F.col(r)))
    return both.groupBy("scope").agg(*[a for r in RATIOS for a in (pick("baseline", r).alias(f"baseline_{r}"), pick("held_out", r).alias(f"held_out_{r}"), (pick("held_out", r) - pick("baseline", r)).alias(f"delta_{r}"))])


def delta_summary(deltas: DataFrame, value: str = "delta") -> DataFrame:
    """Count, mean, median and quartiles of the known deltas, by region and over all (quantiles.py)."""
    from .quantiles import counted_quantiles
    from .sets import with_global

    counts = with_global(deltas.groupBy("region_id", value).agg(F.count(F.lit(1)).alias("n")), "region_id", "all_tiffs").groupBy("scope", value).agg(F.sum("n").alias("n"))
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    sums = counts.groupBy("scope").agg(F.coalesce(F.sum(known), F.lit(0)).alias("n"), F.try_divide(F.sum(F.col(value) * F.col("n")), F.sum(known)).alias("mean"))
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    found = counted_quantiles(counts.where(F.col(value).isNotNull()), "scope", value, tuple(names))
    wide = found.groupBy("scope").agg(*[F.max(F.when(F.col("point") == p, F.col(value))).alias(c) for p, c in names.items()])
    return sums.join(wide, "scope", "left").select("scope", "n", "mean", "median", "q1", "q3")


def bootstrap_interval(deltas: DataFrame, value: str = "delta", statistic: str = "mean", replicates: int = 10_000, seed: int = 20260810) -> DataFrame:
    """95% percentile interval of the mean or median by seeded resampling, by region and over all. A group is a table of
    source-level deltas, small by nature; Spark deals the groups to tasks."""
    from .sets import with_global

    def resample(key, frame):
        import numpy as np
        import pandas as pd

        values = np.sort(frame["v"].to_numpy(np.float64))
        rng, parts = np.random.default_rng(seed), []
        step = max(1, 4_000_000 // len(values))
        for k in range(0, replicates, step):
            drawn = values[rng.integers(0, len(values), (min(step, replicates - k), len(values)))]
            parts.append(drawn.mean(axis=1) if statistic == "mean" else np.median(drawn, axis=1))
        low, high = np.quantile(np.concatenate(parts), [0.025, 0.975])
        return pd.DataFrame({"scope": [key[0]], "n": [len(values)], "low": [low], "high": [high]})

    rows = with_global(deltas, "region_id", "all_tiffs").select("scope", F.col(value).alias("v")).where("v IS NOT NULL")
    return rows.groupBy("scope").applyInPandas(resample, "scope string, n long, low double, high double")


def bootstrap_interval_by_bins(deltas: DataFrame, value: str = "delta", replicates: int = 10_000, seed: int = 20260810, digits: int = 4, drawn: int = 4_000_000) -> DataFrame:
    """scope, statistic (mean, median), n, low, high: 95% percentile intervals by region and over all, for groups of any
    size.

    Rows are counted in bins of `digits` significant digits, and a bin of n rows weighs Poisson(n) in a replicate, which
    is what n rows of weight Poisson(1) sum to. A replicate's mean and median follow from its bins' weights, so no task
    sees a group's rows: bins (9 * 10 ** (digits - 1) a decade at most) are copied to chunks of replicates that draw
    `drawn` numbers each. A bin stands for its rows by their mean: a mean is exact but for the spread within bins, a median
    is within a bin's width, 10 ** (1 - digits) of its value.
    """
    from ..sources.scratch import saved
    from .sets import with_global

    known = deltas.where(F.col(value).isNotNull()).select("region_id", F.col(value).cast("double").alias("v"))
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.abs("v"))) - digits + 1)
    known = known.withColumn("bin", F.when(F.col("v") == 0, 0.0).otherwise(F.round(F.col("v") / size) * size))
    bins = known.groupBy("region_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    bins = saved(with_global(bins, "region_id", "all_tiffs").groupBy("scope", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "value-bins")
    chunks = bins.groupBy("scope").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("rows"))
    step = F.greatest(F.lit(1), F.least(F.lit(replicates), F.floor(F.lit(drawn) / F.col("bins")).cast("int")))
    chunks = chunks.withColumn("step", step).withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.ceil(F.lit(replicates) / F.col("step")) - 1).cast("int"))))

    def replicate(key, frame):
        import zlib

        import numpy as np
        import pandas as pd

        frame = frame.sort_values("bin")
        n, at = frame["n"].to_numpy(), (frame["s"] / frame["n"]).to_numpy()
        step = min(int(frame["step"].iloc[0]), replicates - int(key[1]) * int(frame["step"].iloc[0]))
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode()), int(key[1])])
        weights = rng.poisson(n, (step, len(n)))
        upto = weights.cumsum(axis=1)
        total = upto[:, -1]
        some = total > 0  # few rows draw a replicate without any of them now and then: it has no mean
        rank = lambda r: at[(upto[some] <= r[:, None]).sum(axis=1)]
        mean = (weights[some] @ at) / total[some]
        median = (rank((total[some] - 1) // 2) + rank(total[some] // 2)) / 2
        return pd.DataFrame({"scope": key[0], "rows": int(frame["rows"].iloc[0]), "mean": mean, "median": median})

    dealt = bins.join(chunks, "scope").groupBy("scope", "chunk").applyInPandas(replicate, "scope string, rows long, mean double, median double")
    q = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))  # noqa: E731  of `replicates` numbers
    out = dealt.groupBy("scope").agg(F.max("rows").alias("n"), *[q(c).alias(c) for c in ("mean", "median")])
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("q")) for c in ("mean", "median")])).alias("b")
    return out.select("scope", "n", both).select("scope", "b.statistic", "n", F.col("b.q")[0].alias("low"), F.col("b.q")[1].alias("high"))


def multiclass_metrics(rows: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Per class: tp, fp, fn and ratios; mean_iou of the classes from 1 on in every row."""
    cells = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    tp = [F.coalesce(F.sum(F.when((F.col(truth) == c) & (F.col(predicted) == c), F.col("n"))), F.lit(0)) for c in classes]
    fp = [F.coalesce(F.sum(F.when((F.col(truth) != c) & (F.col(predicted) == c), F.col("n"))), F.lit(0)) for c in classes]
    fn = [F.coalesce(F.sum(F.when((F.col(truth) == c) & (F.col(predicted) != c), F.col("n"))), F.lit(0)) for c in classes]
    each = [F.struct(F.lit(c).alias("class"), a.alias("tp"), b.alias("fp"), d.alias("fn")) for c, a, b, d in zip(classes, tp, fp, fn, strict=True)]
    iou = lambda s: F.try_divide(s["tp"], s["tp"] + s["fp"] + s["fn"])
    known = F.filter(F.transform(F.filter("cells", lambda s: s["class"] > 0), iou), lambda x: x.isNotNull())
    out = cells.agg(F.array(*each).alias("cells")).withColumn("mean_iou", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)))
    out = out.select("mean_iou", F.explode("cells").alias("s")).select("s.*", "mean_iou")
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select("class", "tp", "fp", "fn", iou({"tp": t, "fp": p, "fn": n}).alias("iou"), F.try_divide(t, t + p).alias("precision"), F.try_divide(t, t + n).alias("recall"), F.try_divide(2 * t, 2 * t + p + n).alias("f1"), "mean_iou")


def phase_metrics(log: DataFrame) -> DataFrame:
    """log: phase, epoch, label, mask of scored pixels -> metrics of each phase and epoch."""
    return log.groupBy("phase", "epoch").agg(*confusion(F.col("label"), F.col("mask"))).select("phase", "epoch", *ratios())


def fold_summary(folds: DataFrame, *keys: str) -> DataFrame:
    return folds.where("selected").groupBy(*keys, "experiment_split").agg(F.count(F.lit(1)).alias("chips"), F.count_distinct("source_tiff_id").alias("sources"), F.count_distinct("region_id").alias("regions"), F.array_join(F.array_sort(F.collect_set("region_id")), ";").alias("region_ids"), F.min("acquisition_date").alias("first_date"), F.max("acquisition_date").alias("last_date"))


def held_out_summary(chips: DataFrame, regions: list[str]) -> DataFrame:
    """fold_summary() of all leave-one-region-out folds: chips are counted by source and role first, and these few rows
    are what is copied for each held-out region."""
    from .policy import held_out_folds

    grid_place = F.when(X.on_grid(F.col("row_off"), F.col("col_off")), 0).otherwise(1)
    roles = chips.groupBy("source_tiff_id", "region_id", "acquisition_date", "source_temporal_split", "selected_for_training", grid_place.alias("row_off")).agg(F.count(F.lit(1)).alias("n"))
    folds = held_out_folds(roles.withColumns({"col_off": F.lit(0), "chip_id": F.lit("")}), regions)
    return folds.where("selected").groupBy("fold_id", "experiment_split").agg(F.sum("n").alias("chips"), F.count_distinct("source_tiff_id").alias("sources"), F.count_distinct("region_id").alias("regions"), F.array_join(F.array_sort(F.collect_set("region_id")), ";").alias("region_ids"), F.min("acquisition_date").alias("first_date"), F.max("acquisition_date").alias("last_date"))


def exclusion_counts(folds: DataFrame, *keys: str) -> DataFrame:
    return folds.groupBy(*keys, "selection_reason").agg(F.count(F.lit(1)).alias("chips"))


def selected_inventory(folds: DataFrame, files: DataFrame) -> DataFrame:
    """Chips, sources and bytes by split, and by split with region, source, date or class. Chips are summed by all of
    these first, so only sums are copied for each grouping."""
    of = ("experiment_split", "source_tiff_id", "region_id", "acquisition_date", "class_presence")
    rows = folds.where("selected").select("chip_id", *of).join(files.select("chip_id", "byte_size"), "chip_id", "left")
    rows = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.sum("byte_size").alias("byte_size"))
    groups = {"split": F.lit(""), "region": F.col("region_id"), "source": F.col("source_tiff_id"), "date": F.col("acquisition_date").cast("string"), "class": F.col("class_presence")}
    rows = rows.withColumn("g", F.explode(F.array(*[F.struct(F.lit(k).alias("grouping"), v.alias("value")) for k, v in groups.items()])))
    return rows.groupBy("experiment_split", F.col("g.grouping").alias("grouping"), F.col("g.value").alias("value")).agg(F.sum("n").alias("chips"), F.count_distinct("source_tiff_id").alias("sources"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))


def coverage_summary(pairs: DataFrame) -> DataFrame:
    """pairs: joins.coverage_pairs() -> one row of totals."""
    shared = F.col("state").isin("shared", "regressed")
    s = lambda c, when=None: F.coalesce(F.sum(F.col(c) if when is None else F.when(when, F.col(c))), F.lit(0))
    return pairs.agg(F.count_if(shared).alias("shared_sources"), F.count_if(F.col("state") == "added").alias("added_sources"), F.count_if(F.col("state") == "regressed").alias("regressed_sources"), (s("new_covered") - s("old_covered")).alias("covered_gain"), (s("new_covered", shared) - s("old_covered", shared)).alias("shared_gain"), F.try_divide(s("old_covered"), s("old_total")).alias("old_fraction"), F.try_divide(s("new_covered"), s("new_total")).alias("new_fraction"), (s("new_total") - s("new_covered")).alias("uncovered"))


def mask_audit(pixels: DataFrame, keys: list[str], nodata_label: int = 3) -> DataFrame:
    """Image nodata against the nodata label."""
    a, b = F.col("is_nodata"), F.col("label") == nodata_label
    return pixels.groupBy(*keys).agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.count_if(~a & ~b).alias("tn"))


def alignment_totals(aligned: DataFrame, *keys: str) -> DataFrame:
    return aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("outside"), F.count_if(F.col("label") == 1).alias("class_1"), F.count_if(F.col("label") == 0).alias("class_0"))


def label_sets(pixels: DataFrame, key: str) -> DataFrame:
    """How many rasters have each set of label values (a set has at most as many values as the label type)."""
    sets = pixels.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return sets.groupBy(F.array_join("labels", ";").alias("labels")).agg(F.count(F.lit(1)).alias("rasters"))


def value_range(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.groupBy(key).agg(F.min(F.array_min("values")).alias("low"), F.max(F.array_max("values")).alias("high"))


def pixel_totals(chips: DataFrame) -> DataFrame:
    return chips.agg(*_sums())


def split_table(split: DataFrame) -> DataFrame:
    years = F.array_join(F.array_sort(F.collect_set(F.year("acquisition_date"))), ";")
    return split.groupBy("region_id", "split").agg(F.count(F.lit(1)).alias("sources"), F.min("acquisition_date").alias("first_date"), F.max("acquisition_date").alias("last_date"), years.alias("years"))


def best_throughput(log: DataFrame, headroom: float = 0.15) -> DataFrame:
    fine = log.where((F.col("status") == "ok") & (F.col("headroom") >= headroom)).withColumn("rate", F.try_divide("n", "elapsed"))
    return fine.agg(F.max_by("batch", F.struct("rate", "batch")).alias("batch"), F.max("rate").alias("rate"))
