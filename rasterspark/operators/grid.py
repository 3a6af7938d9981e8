"""Row generation and geometry: window grids, chip cuts, pixel explosion, envelopes and footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offsets(dim: Column, size: int, stride: int) -> Column:
    """0, stride, ... while the window fits; a dimension under the size has one window at 0."""
    return F.when(dim < size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), dim - size, F.lit(stride)))


def window_grid(rasters: DataFrame, size: int, stride: int) -> DataFrame:
    """rasters: width, height and others -> a row for each window, with chip_index in row-major order."""
    pairs = F.flatten(F.transform(offsets(F.col("height"), size, stride), lambda r: F.transform(offsets(F.col("width"), size, stride), lambda c: F.struct(r.alias("row_off"), c.alias("col_off")))))
    out = rasters.select("*", F.posexplode(pairs).alias("chip_index", "w")).select("*", "w.*").drop("w")
    return out.withColumn("chip_height", F.least("height", F.lit(size))).withColumn("chip_width", F.least("width", F.lit(size)))


def to_map(col: Column, row: Column) -> tuple[Column, Column]:
    """Map coordinates of a pixel corner by the affine columns transform_a .. transform_f."""
    a, b, c, d, e, f = (F.col(f"transform_{k}") for k in "abcdef")
    return a * col + b * row + c, d * col + e * row + f


def window_bounds(windows: DataFrame) -> DataFrame:
    """Adds minx, miny, maxx, maxy from the four corners, so rotated grids are right too."""
    left, top = F.col("col_off"), F.col("row_off")
    corners = [to_map(x, y) for x in (left, left + F.col("chip_width")) for y in (top, top + F.col("chip_height"))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return windows.withColumns({"minx": F.least(*xs), "miny": F.least(*ys), "maxx": F.greatest(*xs), "maxy": F.greatest(*ys)})


def raster_bounds(rasters: DataFrame) -> DataFrame:
    corners = [to_map(x, y) for x in (F.lit(0), F.col("width")) for y in (F.lit(0), F.col("height"))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return rasters.withColumns({"left": F.least(*xs), "bottom": F.least(*ys), "right": F.greatest(*xs), "top": F.greatest(*ys)})


def cut_pixels(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """pixels: row, col, width, height and others -> a row for each window over each pixel, with its place in it.

    A pixel names the windows that cover it by arithmetic, so no join with the grid is needed.
    """
    def covering(at: Column, dim: Column) -> Column:
        last = F.floor((dim - size) / stride).cast("int") * stride
        low = F.greatest(F.lit(0), (F.ceil((at - size + 1) / stride) * stride).cast("int"))
        high = F.least(last, (F.floor(at / stride) * stride).cast("int"))
        return F.when(dim < size, F.array(F.lit(0))).when(low > high, F.array().cast("array<int>")).otherwise(F.sequence(low, high, F.lit(stride)))

    out = pixels.withColumn("row_off", F.explode(covering(F.col("row"), F.col("height")))).withColumn("col_off", F.explode(covering(F.col("col"), F.col("width"))))
    return out.withColumn("chip_row", F.col("row") - F.col("row_off")).withColumn("chip_col", F.col("col") - F.col("col_off"))


def cut_tile(image: Column, width: Column, bands: Column, row: Column, col: Column, height: Column, out_width: Column) -> Column:
    """A window of a flattened, row-major, band-last array."""
    rows = F.transform(F.sequence(row, row + height - 1), lambda r: F.slice(image, (r * width + col) * bands + 1, out_width * bands))
    return F.flatten(rows)


def explode_pixels(tiles: DataFrame, *arrays: str) -> DataFrame:
    """tiles: row_off, col_off, w, and arrays of one value a pixel -> a row for each pixel at its place in the source."""
    zipped = F.arrays_zip(*arrays)
    out = tiles.select(*[c for c in tiles.columns if c not in arrays], F.posexplode(zipped).alias("__i", "__p"))
    out = out.withColumn("row", F.col("row_off") + F.floor(F.col("__i") / F.col("w")).cast("int")).withColumn("col", F.col("col_off") + F.pmod("__i", "w"))
    return out.select("*", *[F.col(f"__p.{a}").alias(a) for a in arrays]).drop("__i", "__p")


def raster_pixels(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """rasters: keys, source_height, source_width -> keys, row and col of every pixel of each raster, covered or not."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    some = rasters.select(*keys, "source_height", "source_width").distinct().where("source_height > 0 AND source_width > 0")
    return some.withColumn("row", every("source_height")).withColumn("col", every("source_width")).select(*keys, "row", "col")


def with_thresholds(groups: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Every candidate for every row, without a join: the candidates are literals."""
    return groups.withColumn("threshold_pct", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def zero_filled(counts: DataFrame, keys: list[str], category: str, values: tuple[str, ...], measures: list[str]) -> DataFrame:
    """Every category for each key that there is, with 0 where nothing was counted. The categories of a key come together
    in a row, so zeros need no join, and counts that are dealt by a key stay where they are."""
    of = lambda v, m: F.coalesce(F.sum(F.when(F.col(category) == v, F.col(m))), F.lit(0)).alias(m)
    rows = F.array(*[F.struct(F.lit(v).alias(category), *[of(v, m) for m in measures]) for v in values])
    return counts.groupBy(*keys).agg(rows.alias("__rows")).select(*keys, F.inline("__rows"))


def per_held_out(rows: DataFrame, regions: list[str]) -> DataFrame:
    """A copy of the rows for each held-out region, in one pass."""
    return rows.withColumn("held_out_region", F.explode(F.array(*map(F.lit, regions)))).withColumn("fold_id", F.concat(F.lit("loro_"), "held_out_region"))


def inconsistent_regions(sources: DataFrame) -> DataFrame:
    out = sources.groupBy("region_id").agg(F.count_distinct("dataset").alias("datasets"), F.count_distinct("region_name").alias("names"))
    return out.where("datasets > 1 OR names > 1")


def region_envelopes(rasters: DataFrame) -> DataFrame:
    return rasters.groupBy("region_id", "dataset", "region_name").agg(F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"), F.count_distinct("source_tiff_id").alias("source_count"))


#: Boxes of a region that a strip is cut for.
STRIP = 2_000


def strips(boxes: DataFrame, per_strip: int = STRIP) -> DataFrame:
    """boxes and strip, from_x, to_x: each box once for each strip of its region that it touches. A region of n boxes has
    n / per_strip strips between quantiles of the boxes' left ends, so boxes that span many strips are what copies."""
    n = boxes.groupBy("region_id").agg(F.ceil(F.count(F.lit(1)) / per_strip).cast("int").alias("k"), F.percentile_approx("left", F.array(*[F.lit(i / 1000) for i in range(1, 1000)]), 10_000).alias("q"), F.min("left").alias("low"), F.max("right").alias("high"))
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.col("k") - 1, F.lit(1))), lambda i: F.get("q", F.floor(i * 999 / F.col("k")).cast("int")))
    inner = F.filter(F.array_distinct(F.when(F.col("k") > 1, at).otherwise(F.array().cast("array<double>"))), lambda x: (x > F.col("low")) & (x < F.col("high")))
    cuts = n.select("region_id", F.array_sort(F.concat(F.array("low"), inner, F.array("high"))).alias("cuts"))
    out = boxes.join(cuts, "region_id").where("right > left AND top > bottom")
    touched = F.filter(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: (F.get("cuts", i - 1) < F.col("right")) & (F.get("cuts", i) > F.col("left")))
    out = out.withColumn("strip", F.explode(touched))
    return out.select("region_id", "strip", F.greatest("left", F.get("cuts", F.col("strip") - 1)).alias("left"), F.least("right", F.get("cuts", "strip")).alias("right"), "bottom", "top")


def sweep(key, frame):
    """One strip's boxes -> the rectangles of their union: each covered stretch in y that is as long as can be, for as
    long as it stays so in x. Counts of how many boxes cover each step in y are kept while x moves over the ends."""
    import numpy as np
    import pandas as pd

    left, right = frame["left"].to_numpy(float), frame["right"].to_numpy(float)
    ys, at = np.unique(np.concatenate([frame["bottom"], frame["top"]]).astype(float), return_inverse=True)
    low, high = at[: len(frame)], at[len(frame) :]
    count, found, since = np.zeros(len(ys) + 1, np.int32), [], {}
    for x in np.unique(np.concatenate([left, right])):
        for i in np.flatnonzero(right == x):
            count[low[i] : high[i]] -= 1
        for i in np.flatnonzero(left == x):
            count[low[i] : high[i]] += 1
        edge = np.diff(np.concatenate([[0], (count > 0).astype(np.int8)]))
        now = set(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        for span in since.keys() - now:
            found.append((key[0], since.pop(span), x, ys[span[0]], ys[span[1]]))
        for span in now - since.keys():
            since[span] = x
    return pd.DataFrame(found, columns=["region_id", "x", "x2", "from", "to"])


def footprint_parts(boxes: DataFrame, per_strip: int = STRIP) -> DataFrame:
    """boxes: region_id, left, bottom, right, top -> region_id, x, x2, from, to: disjoint rectangles of the same union, the
    same however the boxes are dealt. Strips of a region are swept by tasks of their own (see sweep); rectangles that go
    on beyond a strip are joined. Empty boxes and those with a null end cover nothing."""
    from pyspark.sql import Window

    kind = boxes.schema["region_id"].dataType.simpleString()
    found = strips(boxes, per_strip).groupBy("region_id", "strip").applyInPandas(sweep, f"region_id {kind}, x double, x2 double, `from` double, `to` double")
    order = Window.partitionBy("region_id", "from", "to").orderBy("x")
    goes_on = F.coalesce((F.lag("x2").over(order) == F.col("x")).cast("int"), F.lit(0))
    run = F.sum(1 - F.col("goes_on")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("goes_on", goes_on).withColumn("run", run)
    return found.groupBy("region_id", "from", "to", "run").agg(F.min("x").alias("x"), F.max("x2").alias("x2")).select("region_id", "x", "x2", "from", "to")


def footprints(boxes: DataFrame) -> DataFrame:
    """boxes: region_id, left, bottom, right, top -> area and centroid of the union of each region's boxes."""
    area = (F.col("x2") - F.col("x")) * (F.col("to") - F.col("from"))
    parts = footprint_parts(boxes).select("region_id", area.alias("a"), ((F.col("x") + F.col("x2")) / 2).alias("cx"), ((F.col("to") + F.col("from")) / 2).alias("cy"))
    return parts.groupBy("region_id").agg(F.sum("a").alias("area"), F.try_divide(F.sum(F.col("a") * F.col("cx")), F.sum("a")).alias("centroid_x"), F.try_divide(F.sum(F.col("a") * F.col("cy")), F.sum("a")).alias("centroid_y"))
