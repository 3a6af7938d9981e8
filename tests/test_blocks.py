"""Block operators against pixel by pixel versions on uneven tiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.operators import blocks, grid, ranking

KEYS = ["source_tiff_id"]


def tiles_of(spark, rng, n=40, most=30):
    rows = []
    for k in range(n):
        h, w, top, left = (int(x) for x in (rng.integers(1, 12), rng.integers(1, 12), rng.integers(0, most), rng.integers(0, most)))
        p = [None if x < 0.03 else float(x) for x in rng.random(h * w)]
        label = [int(x) for x in rng.choice([-100, 0, 1], h * w)]
        rows.append((f"s{k % 3}", f"c{k}", top, left, h, w, p, label))
    return spark.createDataFrame(rows, "source_tiff_id string, chip_id string, row_off int, col_off int, h int, w int, probability array<double>, label array<int>")


def plain_reconstruct(tiles):
    """One row for each pixel of each tile, grouped."""
    pixels = grid.explode_pixels(tiles.select(*KEYS, "row_off", "col_off", "w", "probability", "label"), "probability", "label")
    known = F.when(F.col("label") != -100, F.col("label"))
    out = pixels.groupBy(*KEYS, "row", "col").agg(F.avg("probability").alias("probability"), F.count(F.lit(1)).alias("coverage"), F.max(known).alias("known"), F.min(known).alias("low"))
    out = out.withColumn("label", F.coalesce("known", F.lit(-100))).withColumn("conflict", F.coalesce(F.col("known") != F.col("low"), F.lit(False)))
    return out.withColumn("mask", (F.col("probability") >= 0.5).cast("int")).drop("known", "low")


def plain(df, *names):
    near = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(near(r[c]) for c in ("source_tiff_id", "row", "col", *names)) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [4, 7, 256])
def test_reconstruction_by_blocks(spark, size):
    tiles = tiles_of(spark, np.random.default_rng(size))
    found = blocks.reconstruct_blocks(tiles, KEYS, size=size)
    names = ("probability", "coverage", "label", "conflict", "mask")
    assert plain(blocks.block_pixels(found, KEYS, *names), *names) == plain(plain_reconstruct(tiles), *names)
    assert found.where(f"h > {size} OR w > {size} OR size(label) <> h * w").count() == 0
    assert blocks.reconstruct_blocks(tiles.limit(0), KEYS, size=size).count() == 0


@pytest.mark.parametrize("size", [3, 5, 256])
def test_slope_with_halos(spark, size):
    cells = plain_reconstruct(tiles_of(spark, np.random.default_rng(3))).select(*KEYS, "row", "col", F.col("probability").alias("value"))
    at = {(r[0], r[1], r[2]): r[3] for r in cells.collect()}
    want = []
    for s, r, c in at:
        z = {(i, j): at.get((s, r + i, c + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)}
        slope = None
        if None not in z.values():
            x = sum(v * j * (2 if i == 0 else 1) for (i, j), v in z.items()) / 8
            y = sum(v * i * (2 if j == 0 else 1) for (i, j), v in z.items()) / 8
            slope = round(float(np.degrees(np.arctan(np.hypot(x, y)))), 9)
        want.append((s, r, c, slope))
    gathered = blocks.gathered(cells, KEYS, ["value"], size)
    assert plain(blocks.block_pixels(gathered, KEYS, "value"), "value") == plain(cells, "value")
    assert plain(blocks.block_pixels(blocks.slope_blocks(gathered, KEYS, "value", size=size), KEYS, "slope"), "slope") == sorted(want, key=str)
    if size == 256:
        assert plain(ranking.slope(cells), "slope") == sorted(want, key=str)


def test_halos_grow_with_the_border(spark):
    n, size = 64, 16
    tile = spark.range(1).select(F.lit("s").alias("source_tiff_id"), F.lit(0).alias("row_off"), F.lit(0).alias("col_off"), F.lit(n).alias("h"), F.lit(n).alias("w"), F.array_repeat(F.lit(0.5), n * n).alias("probability"), F.array_repeat(F.lit(1), n * n).alias("label"))
    found = blocks.reconstruct_blocks(tile, KEYS, size=size)
    pieces = blocks.cut(found, KEYS, ["probability"], blocks.with_halo(size))
    shuffled = pieces.agg(F.sum(F.col("h") * F.col("w"))).first()[0]
    assert found.count() == 16 and n * n < shuffled <= n * n + 16 * (4 * size + 4)


@pytest.mark.parametrize("bilinear", [False, True])
@pytest.mark.parametrize("size", [4, 256])
def test_alignment_by_blocks(spark, bilinear, size):
    cells = plain_reconstruct(tiles_of(spark, np.random.default_rng(8), 60)).select(*KEYS, "row", "col", F.col("probability").alias("value"))
    at = {(r[0], r[1], r[2]): r[3] for r in cells.collect() if r[3] is not None}
    grids = {"s0": (9, 11, 100.0, 3.7, 50.0, -2.3, 98.0, 2.0, 51.0, -1.5), "s1": (20, 6, 0.0, 0.4, 0.0, 0.4, 0.0, 1.0, 0.0, 1.0), "s2": (5, 5, 900.0, 1.0, 900.0, 1.0, 0.0, 1.0, 0.0, 1.0)}
    rasters = spark.createDataFrame([(s, *g) for s, g in grids.items()], "source_tiff_id string, " + ", ".join(f"{c} {'int' if c.startswith('t_') else 'double'}" for c in blocks.GRID))
    want = []
    for s, (height, width, x0, dx, y0, dy, ox, px, oy, py) in grids.items():
        for r in range(height):
            for c in range(width):
                y, x = ((r + 0.5) * dy + y0 - oy) / py, ((c + 0.5) * dx + x0 - ox) / px
                if not bilinear:
                    value = at.get((s, int(np.floor(y)), int(np.floor(x))))
                else:
                    y, x = y - 0.5, x - 0.5
                    i, j = int(np.floor(y)), int(np.floor(x))
                    parts = [(at.get((s, i + a, j + b)), ((y - i) if a else 1 - (y - i)) * ((x - j) if b else 1 - (x - j))) for a in (0, 1) for b in (0, 1)]
                    weight = sum(w for v, w in parts if v is not None)
                    value = sum(v * w for v, w in parts if v is not None) / weight if weight > 0 else None
                want.append((s, r, c, None if value is None else round(value, 9)))
    source = blocks.gathered(cells, KEYS, ["value"], size)
    found = blocks.aligned_blocks(source, rasters, KEYS, "value", bilinear, 3)
    assert plain(blocks.block_pixels(found, KEYS, "value"), "value") == sorted(want, key=str)
    assert sum(w[3] is not None for w in want) > 20


@pytest.mark.parametrize("window, stride", [(6, 3), (5, 7), (64, 10)])
def test_windows_cut_from_blocks(spark, window, stride):
    cells = plain_reconstruct(tiles_of(spark, np.random.default_rng(4))).select(*KEYS, "row", "col", "label")
    sized = cells.withColumns({"width": F.lit(41), "height": F.lit(37)})
    want = sorted((r.source_tiff_id, r.row_off, r.col_off, r.chip_row, r.chip_col, r.label) for r in grid.cut_pixels(sized, window, stride).collect())
    source = blocks.gathered(cells, KEYS, ["label"], 8).withColumns({"source_height": F.lit(37), "source_width": F.lit(41)})
    chips = blocks.cut_windows(source, KEYS, ["label", "coverage"], window, stride).collect()
    got = [(r.source_tiff_id, r.row_off, r.col_off, i // r.w, i % r.w, v) for r in chips for i, (v, there) in enumerate(zip(r.label, r.coverage, strict=True)) if there]
    assert sorted(got) == want and all((r.h, r.w) == (min(window, 37), min(window, 41)) for r in chips)


def test_batches_of_python_are_bounded(spark, monkeypatch):
    """However many rows a batch brings, CHUNK elements and those of one more piece (or target) at most go on at once."""
    monkeypatch.setattr(blocks, "CHUNK", 200)
    tiles = tiles_of(spark, np.random.default_rng(5))
    taken = []
    with monkeypatch.context() as m:
        m.setattr(type(tiles), "mapInArrow", lambda df, f, schema: taken.append((df, f)) or df)
        blocks.cut(tiles, KEYS, ["probability"], blocks.to_blocks(7))
    given, cutter = taken[0]
    whole = given.toArrow().combine_chunks().to_batches()
    sizes = [len(b.column("probability").flatten()) for b in cutter(whole)]
    assert len(whole) == 1 and len(sizes) > 5 and max(sizes) < 200 + 7 * 7
    assert sum(sizes) == sum(r.h * r.w for r in tiles.select("h", "w").collect())
    pieces = spark.createDataFrame([("s", 0, c, 0, 0, 2, 3, [1.0] * 6) for c in range(300)], "source_tiff_id string, target_row int, target_col int, at_row int, at_col int, h int, w int, v array<double>")
    with monkeypatch.context() as m:
        m.setattr(type(tiles), "mapInArrow", lambda df, f, schema: taken.append((df, f)) or df)
        blocks.pasted(pieces, KEYS, ["v"], {"v": "array<double>"}, lambda row, col, found: {"v": np.concatenate([p.layers[0] for p in found])})
    dealt, paste = taken[1]
    rows = [b.num_rows for b in paste(dealt.toArrow().combine_chunks().to_batches())]
    assert sum(rows) == 300 and max(rows) == 34 and len(rows) == 9
