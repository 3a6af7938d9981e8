"""Raster files as data sources."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.sources import rasters


def blocks_of(spark):
    rows = [(f"s{s}", b, 4 * r, 5 * c, 4, 5, [float(1000 * b + 100 * s + 20 * k + r + c) for k in range(20)]) for s in range(2) for b in (1, 2) for r in range(3) for c in range(3)]
    return rows, spark.createDataFrame(rows, rasters.BLOCKS)


def test_block_files_round_trip_and_windows(spark, tmp_path):
    path, (rows, df) = str(tmp_path / "blocks"), blocks_of(spark)
    rasters.write_files(df, "rasterblocks", path)
    assert (tmp_path / "blocks" / "_SUCCESS").exists()
    assert sorted((*r[:6], list(r[6])) for r in map(tuple, rasters.read_block_files(spark, path).collect())) == sorted(rows)
    whole = {}
    for s, b, top, left, h, w, values in rows:
        whole.setdefault((s, b), np.zeros((12, 15)))[top : top + h, left : left + w] = np.array(values).reshape(h, w)
    got = {}
    for s, b, top, left, h, w, values in rasters.read_block_files(spark, path, window=(3, 6, 6, 5)).collect():
        got.setdefault((s, b), np.full((12, 15), np.nan))[top : top + h, left : left + w] = np.array(values).reshape(h, w)
    for key, full in whole.items():
        assert (got[key][3:9, 6:11] == full[3:9, 6:11]).all() and np.isnan(got[key]).sum() == 12 * 15 - 30


def test_files_outside_window_and_filters_are_not_opened(spark, tmp_path):
    path, (rows, df) = tmp_path / "blocks", blocks_of(spark)
    rasters.write_files(df, "rasterblocks", str(path))
    for file in path.glob("*.npy"):
        facts = rasters.NAME.fullmatch(file.name).groupdict()
        if facts["band"] == "2" or facts["source"] == "s1" or int(facts["row_off"]) >= 8:
            file.write_bytes(b"broken")  # an error wherever it is opened
    wanted = rasters.read_block_files(spark, str(path), window=(0, 0, 8, 15)).where((F.col("band") == 1) & F.col("source").isin("s0"))
    assert wanted.count() == 6 and wanted.agg(F.sum(F.size("values"))).first()[0] == 120
    assert "BlockReader" in str(type(rasters.RasterBlocks({"path": str(path)}).reader(df.schema)))
    assert rasters.read_block_files(spark, str(path), ("source", "band", "row_off")).where("band = 2").count() == 18  # names alone
    with pytest.raises(Exception, match="broken|magic|pickle"):
        rasters.read_block_files(spark, str(path)).agg(F.sum(F.size("values"))).collect()


def test_chip_files(spark, tmp_path):
    path = tmp_path / "chips"
    rows = [(f"all/c{k}", 2, 3, 2, list(range(k, k + 12)), [0, 1, 0, -100, 1, k]) for k in range(9)]
    df = spark.createDataFrame(rows, rasters.CHIPS)
    rasters.write_files(df, "rasterchips", str(path))
    back = sorted((r.path, r.h, r.w, r.b, list(r.image), list(r.label)) for r in rasters.read_chip_files(spark, str(path)).collect())
    assert back == sorted(rows)
    assert rasters.read_chip_files(spark, str(path), ("path", "label")).where("path = 'all/c3'").first().label[5] == 3
    np.savez(path / "bad.npz", other=np.zeros(3))
    with pytest.raises(Exception, match="bad.npz holds"):
        rasters.read_chip_files(spark, str(path)).collect()
    assert rasters.read_chip_files(spark, str(path), ("path",)).count() == 10


def test_a_failed_write_leaves_no_success(spark, tmp_path):
    path, (_, df) = tmp_path / "blocks", blocks_of(spark)
    broken = df.withColumn("values", F.when(F.col("band") == 2, F.slice("values", 1, 7)).otherwise(F.col("values")))
    with pytest.raises(Exception, match="reshape"):
        rasters.write_files(broken.coalesce(1), "rasterblocks", str(path))
    assert not (path / "_SUCCESS").exists()
