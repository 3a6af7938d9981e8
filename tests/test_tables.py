"""Publishing, strict scans, line numbers, exact quantiles and keyed states."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.operators import aggregates as A
from rasterspark.operators.quantiles import exact_quantiles
from rasterspark.sources import tables
from rasterspark.streaming import registry


def test_strict_scan_checks_the_header_of_every_file(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n")
    (folder / "b.csv").write_text("x,y\n3,4\n")
    assert sorted(map(tuple, tables.read_strict(spark, str(folder)).collect())) == [("1", "2"), ("3", "4")]
    (folder / "c.csv").write_text("y,x\n5,6\n")
    with pytest.raises(ValueError, match="c.csv has another header"):
        tables.read_strict(spark, str(folder))
    (folder / "c.csv").write_text("\n5,6\n")
    with pytest.raises(ValueError, match="has no header"):
        tables.read_strict(spark, str(folder))


def test_publish_survives_failures(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "out"), spark.range(50).withColumn("v", F.col("id") % 3)
    left = lambda: sorted(p.name for p in tmp_path.iterdir())
    broken = df.withColumn("v", F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        tables.publish(broken, path)
    assert left() == [] and not tables.is_published(spark, path)
    mark = tables.mark
    monkeypatch.setattr(tables, "mark", lambda *a: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError, match="no room"):
        tables.publish(df, path)
    assert left() == []
    with pytest.raises(FileNotFoundError):
        tables.read_published(spark, path)
    monkeypatch.setattr(tables, "mark", mark)
    df.limit(3).write.parquet(path)  # renamed by a driver that died before the mark
    assert tables.publish(df, path) and left() == ["out"] and tables.read_published(spark, path).count() == 50
    assert not tables.publish(df.repartition(7), path) and json.loads((tmp_path / "out" / tables.MARKER).read_text())["rows"] == 50
    with pytest.raises(FileExistsError):
        tables.publish(df.limit(49), path)
    assert tables.read_published(spark, path).count() == 50


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder, rng = tmp_path / "log", np.random.default_rng(6)
    folder.mkdir()
    want = []
    for name in ("a.log", "b.log", "c.log"):
        lines = ["x" * int(rng.integers(0, 40)) for _ in range(int(rng.integers(200, 900)))]
        (folder / name).write_text("\n".join(lines) + ("\n" if name != "b.log" else ""))
        want += [(name, k + 1, v) for k, v in enumerate(lines)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        lines = tables.numbered_lines(spark, str(folder))
        assert lines.rdd.getNumPartitions() > 1 or spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        got = sorted((r.file.split("/")[-1], r.line, r.value) for r in lines.collect())
        through = sorted((r.line, r.value) for r in tables.numbered_lines(spark, str(folder), across=True).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == sorted(want) and through == [(k + 1, v) for k, (_, _, v) in enumerate(want)]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    rows = [("a", float(round(x, 2))) for x in rng.normal(size=n)] + [("b", float(x)) for x in rng.integers(0, 3, 2 * n)] + [("b", None), ("c", None)]
    points = (0.0, 0.1, 0.25, 0.5, 0.95, 1.0)
    found = exact_quantiles(spark.createDataFrame(rows, "scope string, v double"), "scope", "v", points).collect()
    want = {(s, p): float(np.quantile([v for t, v in rows if t == s and v is not None], p)) for s in "ab" for p in points}
    assert {(r.scope, r.point): r.v for r in found} == pytest.approx(want)


def test_quantiles_hold_no_scope_in_one_task(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("r"), F.pmod("id", F.lit(3))).alias("region_id"), F.rand(3).alias("delta"))
    plan = A.delta_summary(rows)._jdf.queryExecution().toString()
    assert "percentile(" not in plan
    assert A.percentile_rows(rows, "delta", "region_id").count() == 4 * len(A.PERCENTILES)


def test_a_batch_writes_only_what_changes(spark, tmp_path):
    schema = "seq int, run_key string, status string"
    log, table = tmp_path / "log", tmp_path / "t"
    log.mkdir()
    batches = [
        [(k, f"k{k}", "started") for k in range(40)],
        [(100, "k1", "completed"), (100, "k1", "completed"), (50, "k2", None)],  # repeated, and a null field
        [(99, "k1", "late"), (100, "k1", "again"), (3, "k3", "same")],  # nothing newer
        [(200, "new", "started"), (201, "k2", "completed"), (150, "k2", "between")],
    ]
    written, events = [], []
    for k, rows in enumerate(batches):
        (log / f"{k}.json").write_text("".join(json.dumps({"seq": s, "run_key": r, "status": v}) + "\n" for s, r, v in rows))
        stream = spark.readStream.schema(schema).json(str(log))
        registry.upsert_states(stream, ["run_key"], str(table), str(tmp_path / "c"), compact_every=3)
        events += rows
        latest = {}
        for s, r, v in events:
            if r not in latest or s > latest[r][0]:
                latest[r] = (s, v)
        assert {r.run_key: (r.seq, r.status) for r in registry.read_states(spark, str(table)).collect()} == latest
        batch = table / "changes" / f"batch={k}"
        written.append(spark.read.schema(schema).parquet(str(batch)).count() if batch.exists() else None)
    assert written == [40, 2, 0, 2]
    assert registry._numbers(spark, f"{table}/base", "upto") == [2] and spark.read.parquet(f"{table}/events").count() == sum(map(len, batches))
    registry.compact(spark, ["run_key"], str(table), 3)
    assert registry._numbers(spark, f"{table}/base", "upto") == [2, 3] and registry._numbers(spark, f"{table}/changes", "batch") == [3]
    assert {r.run_key: (r.seq, r.status) for r in registry.read_states(spark, str(table)).collect()} == latest


def test_footprints_of_many_boxes_in_one_region(spark):
    from rasterspark.operators import grid

    rng = np.random.default_rng(12)
    n = 100_000
    left, bottom = rng.integers(0, 20_000, n).astype(float), rng.integers(0, 300, n).astype(float)
    boxes = spark.createDataFrame(list(zip(["r"] * n, left.tolist(), bottom.tolist(), (left + rng.integers(1, 9, n)).tolist(), (bottom + rng.integers(1, 9, n)).tolist(), strict=True)), "region_id string, left double, bottom double, right double, top double")
    dealt = grid.strips(boxes)
    assert dealt.count() < 1.1 * n and dealt.groupBy("strip").count().agg(F.max("count")).first()[0] < 3 * grid.STRIP
    cells = np.zeros((20_010, 310), bool)
    for x, y, x2, y2 in boxes.select("left", "bottom", "right", "top").toPandas().astype(int).itertuples(index=False):
        cells[x:x2, y:y2] = True
    parts = grid.footprint_parts(boxes).toPandas()
    assert ((parts["x2"] - parts["x"]) * (parts["to"] - parts["from"])).sum() == cells.sum()
    found = grid.footprints(boxes).first()
    assert found.area == cells.sum() and found.centroid_x == pytest.approx((np.nonzero(cells)[0] + 0.5).mean()) and found.centroid_y == pytest.approx((np.nonzero(cells)[1] + 0.5).mean())
    few = boxes.limit(3_000)
    key = ["region_id", "x", "x2", "from", "to"]
    one, many = (sorted(map(tuple, grid.footprint_parts(few, k).select(key).collect())) for k in (10**6, 100))
    assert one == many
