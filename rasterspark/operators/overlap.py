"""Reconstruction of sources from overlapping scored tiles: average first, then threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks


def tile_faults(tiles: DataFrame) -> DataFrame:
    """Tiles that don't fit: outside the source, arrays of another size, probabilities that aren't in [0, 1]."""
    n = F.col("h") * F.col("w")
    bad = F.exists("probability", lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    outside = (F.col("row_off") < 0) | (F.col("col_off") < 0) | (F.col("row_off") + F.col("h") > F.col("source_height")) | (F.col("col_off") + F.col("w") > F.col("source_width"))
    fault = F.when((F.size("probability") != n) | (F.size("label") != n), "shape").when(outside, "bounds").when(bad, "probability")
    return tiles.select("chip_id", fault.alias("fault")).where("fault IS NOT NULL")


def reconstruct(tiles: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("source_tiff_id",)) -> DataFrame:
    """tiles: keys, row_off, col_off, h, w, probability, label -> a row for each covered pixel: probability (mean over the
    tiles), coverage, label (the one that isn't ignored), conflict (two such labels differ), mask.

    Sums are made by blocks (blocks.reconstruct_blocks); pixels are rows only after them.
    """
    found = blocks.reconstruct_blocks(tiles, list(keys), threshold)
    return blocks.block_pixels(found, list(keys), "probability", "coverage", "label", "conflict", "mask")


def label_conflicts(pixels: DataFrame) -> DataFrame:
    return pixels.where("conflict OR coverage > 65535")


def tile_diagnostics(tiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of each tile alone, counted from its arrays without a shuffle; they don't add up over overlaps. Pixels
    without a probability have no mask."""
    from ..functions.exprs import IGNORE
    from ..functions.metrics import COUNTS, ratios

    kind = tiles.schema["chip_id"].dataType.simpleString()

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                p, label = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in (1, 2))
                known, mask = ~np.isnan(p.astype(float)), p.astype(float) >= threshold
                cells = [np.count_nonzero((label == t) & (mask == m) & known) for t, m in ((0, False), (0, True), (1, False), (1, True))]
                ignored = np.count_nonzero(label == IGNORE)
                rows.append([*cells, np.count_nonzero(~np.isnan(label.astype(float))) - ignored, ignored, len(label)])
            found = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
            yield pa.record_batch([batch.column(0), *[pa.array(found[:, i]) for i in range(len(COUNTS))]], names=["chip_id", *COUNTS])

    counted = tiles.select("chip_id", "probability", "label").mapInArrow(count, f"chip_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.select("*", *ratios()).withColumn("additive", F.lit(False))


def centre_crop(values: Column, padded_height: int, padded_width: int, height: Column, width: Column) -> Column:
    """The part of a padded, flattened array that held the original: offsets floor((padded - size) / 2)."""
    top, left = F.floor((padded_height - height) / 2).cast("int"), F.floor((padded_width - width) / 2).cast("int")
    # values goes through an array of one, so it is computed once and not for each row
    return F.flatten(F.transform(F.array(values), lambda v: F.flatten(F.transform(F.sequence(top, top + height - 1), lambda r: F.slice(v, r * padded_width + left + 1, width)))))


def crop_faults(tiles: DataFrame, padded_height: int, padded_width: int) -> DataFrame:
    cropped = centre_crop(F.col("padded_label"), padded_height, padded_width, F.col("h"), F.col("w"))
    return tiles.where(~cropped.eqNullSafe(F.col("label"))).select("chip_id")


def score_tiles(tiles: DataFrame, predictor: Callable, batched: bool = False) -> DataFrame:
    """predictor(image, label) -> probabilities, arrays of shape (h, w, b) and (h, w); it travels with the tasks. Batched,
    it takes the tiles of one shape at once: (n, h, w, b) and (n, h, w)."""
    schema = tiles.drop("probability").schema

    def score(frames):
        import numpy as np

        for frame in frames:
            found = [None] * len(frame)
            for (h, w, b), rows in frame.reset_index(drop=True).groupby(["h", "w", "b"]):
                images = np.stack(rows["image"].to_list()).reshape(len(rows), h, w, b)
                labels = np.stack(rows["label"].to_list()).reshape(len(rows), h, w)
                p = predictor(images, labels) if batched else np.stack([predictor(i, x) for i, x in zip(images, labels, strict=True)])
                p = np.asarray(p, np.float32)
                if p.shape != labels.shape:
                    raise ValueError(f"{rows['chip_id'].iloc[0]}: {p.shape} probabilities for {labels.shape} pixels")
                for i, row in zip(rows.index, p.reshape(len(rows), -1), strict=True):
                    found[i] = row
            yield frame.assign(probability=found)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return tiles.drop("probability").mapInPandas(score, f"{fields}, probability array<float>")


def merge_layers(layers: DataFrame, keys: list[str], valid: list[int]) -> DataFrame:
    """The value of the last layer (column layer) with a valid one; 0 if none has."""
    value = F.max_by(F.when(F.col("value").isin(valid), F.col("value")), F.when(F.col("value").isin(valid), F.col("layer")))
    return layers.groupBy(*keys).agg(F.coalesce(value, F.lit(0)).alias("value"))
