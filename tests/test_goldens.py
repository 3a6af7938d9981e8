"""Small hand-made cases with known results."""

from __future__ import annotations

import io
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterspark.functions import exprs as X
from rasterspark.functions import metrics as M
from rasterspark.operators import aggregates as A
from rasterspark.operators import grid, hashing, joins, overlap, policy, ranking, rules, sets
from rasterspark.sources import tables
from rasterspark.streaming import registry


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_names_and_dates(spark):
    row = one(spark, a=X.region_source(F.lit("003_20210131_x")), b=X.region_source(F.lit("012_20210131_x")), c=X.compact_date(F.lit("20210230")), d=X.iso_date(F.lit("2021-02-28")), e=X.dated_source(F.lit("20200422_y")))
    assert (row.a.region_id, row.a.region_name, str(row.a.acquisition_date)) == ("ca_003", "sanDiego", "2021-01-31")
    assert row.b is None and row.c is None and str(row.d) == "2021-02-28" and row.e.region_id == "bc"


def test_scalars(spark):
    row = one(spark, a=X.remap_label(F.lit(9), (0, 1, 0, -100, 0)), b=X.remap_label(F.lit(1), (0, 1, 0, -100, 0)), c=X.nodata_bin(F.lit(5.0)), d=X.strict_bool(F.lit(" True ")), e=X.strict_bool(F.lit("yes")), f=X.portable_path(F.lit("a/../b")), g=X.portable_path(F.lit("a/b.npz")), h=X.metric_in_name(F.lit("x-val-iou-0.71.ckpt")), i=X.nearest_of(F.lit(55.0), (50, 60))["threshold"], j=X.decimal_text(F.lit(Decimal("12.500"))), k=X.leaks_absolute_path(F.lit("see /home/me/x")))
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h, row.i, row.j, row.k) == (-100, 1, "(1,5]", True, None, False, True, 0.71, 50.0, "12.5", True)
    with pytest.raises(ValueError):
        X.bounded_decimal("101", 100)


def test_effective_nodata(spark):
    rows = [([0.0, 0.0],), ([None, None],), ([0.0, None],), ([0.0, 1.0],), ([float("nan"), 0.0],), ([0.5, 0.5],), ([70000.0, 70000.0],)]
    df = spark.createDataFrame(rows, "v array<double>").withColumn("t", F.array(F.lit("uint16"), F.lit("uint16")))
    found = [(r.e.value, r.e.error) for r in df.select(X.effective_nodata(F.col("v"), F.col("t"), 0.0).alias("e")).collect()]
    assert found == [(0.0, None), (0.0, None), (None, "partly_missing"), (None, "inconsistent"), (None, "not_finite"), (None, "not_representable"), (None, "not_representable")]


def test_window_grid(spark):
    raster = spark.sql("SELECT 6 AS width, 6 AS height, 10.0D AS transform_a, 0.0D AS transform_b, 100.0D AS transform_c, 0.0D AS transform_d, -10.0D AS transform_e, 200.0D AS transform_f")
    rows = grid.window_bounds(grid.window_grid(raster, 4, 2)).orderBy("chip_index").collect()
    assert [(r.row_off, r.col_off) for r in rows] == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert (rows[0].minx, rows[0].miny, rows[0].maxx, rows[0].maxy) == (100, 160, 140, 200)
    small = grid.window_grid(spark.sql("SELECT 3 AS width, 9 AS height"), 4, 4).collect()
    assert [(r.row_off, r.chip_height, r.chip_width) for r in small] == [(0, 4, 3), (4, 4, 3)]


def test_cut_pixels_covers_like_the_grid(spark):
    pixels = spark.range(36).select(F.expr("CAST(id DIV 6 AS INT)").alias("row"), F.expr("CAST(id % 6 AS INT)").alias("col"), F.lit(6).alias("width"), F.lit(6).alias("height"))
    cover = np.zeros((6, 6), int)
    for r in grid.cut_pixels(pixels, 4, 2).collect():
        cover[r.row, r.col] += 1
    assert cover[0].tolist() == [1, 1, 2, 2, 1, 1] and cover[2, 2] == 4


def test_tile_counts(spark):
    image = np.full((4, 4, 8), 10)
    image[0, 0] = 0
    label = np.zeros(16, int)
    label[[1, 2, 3]], label[0] = 1, -100
    tiles = spark.createDataFrame([(4, 4, 8, image.ravel().tolist(), label.tolist())], "h int, w int, b int, image array<int>, label array<int>")
    row = A.tile_counts(tiles, [0, 1]).first()
    assert (row.class_0_pixel_count, row.class_1_pixel_count, row.ignore_pixel_count, row.nodata_pixel_count, row.nodata_pct) == (12, 3, 1, 1, 6.25)
    assert A.class_columns((0, 1, 0, -100, 0)) == [0, 1]


TILES = "chip_id string, source_tiff_id string, row_off int, col_off int, h int, w int, source_height int, source_width int, probability array<double>, label array<int>"


def test_overlap(spark):
    tiles = spark.createDataFrame([("a", "s", 0, 0, 2, 2, 2, 3, [0.1, 0.4, 0.2, 0.4], [0, 1, 0, 0]), ("b", "s", 0, 1, 2, 2, 2, 3, [0.8, 0.3, 0.6, 0.8], [1, 0, 0, 1])], TILES)
    rows = {(r.row, r.col): r for r in overlap.reconstruct(tiles).collect()}
    assert [round(rows[k].probability, 6) for k in sorted(rows)] == [0.1, 0.6, 0.3, 0.2, 0.5, 0.8]
    assert [rows[k].mask for k in sorted(rows)] == [0, 1, 0, 0, 1, 1]
    sources = spark.sql("SELECT 's' AS source_tiff_id, CAST(6 AS BIGINT) AS total_source_pixel_count")
    m = A.source_metrics(overlap.reconstruct(tiles), sources).first()
    assert (m.true_positive, m.false_positive, m.false_negative, m.scored_pixel_count, m.uncovered_pixel_count) == (2, 1, 0, 6, 0)
    assert overlap.tile_faults(tiles).count() == 0 and overlap.tile_diagnostics(tiles).count() == 2
    clash = spark.createDataFrame([("a", "s", 0, 0, 1, 1, 1, 1, [0.5], [1]), ("b", "s", 0, 0, 1, 1, 1, 1, [0.5], [0]), ("c", "s", 1, 0, 1, 1, 1, 1, [1.5], [0])], TILES)
    assert overlap.label_conflicts(overlap.reconstruct(clash)).count() == 1
    assert [r.fault for r in overlap.tile_faults(clash).collect()] == ["bounds"]


def test_accounting_and_nulls(spark):
    tiles = spark.createDataFrame([("a", "s", 0, 0, 1, 2, 2, 3, [0.9, 0.1], [1, -100])], TILES)
    m = A.source_metrics(overlap.reconstruct(tiles), spark.sql("SELECT 's' AS source_tiff_id, CAST(6 AS BIGINT) AS total_source_pixel_count")).first()
    assert (m.scored_pixel_count, m.ignored_pixel_count, m.uncovered_pixel_count, m.background_iou) == (1, 1, 4, None)
    pooled = A.pooled(spark.createDataFrame([(2, 1, 0, 1), (0, 0, 1, 0)], "true_negative int, false_positive int, false_negative int, true_positive int")).first()
    assert pooled.iou == pytest.approx(1 / 3)


CHIPS = "chip_id string, source_tiff_id string, region_id string, nodata_pct double, class_1_pixel_count long"


def test_thresholds(spark):
    chips = spark.createDataFrame([("a", "s1", "region_a", 50.0, 10), ("b", "s1", "region_a", 51.0, 20), ("c", "s2", "region_b", 75.0, 30)], CHIPS)
    rows = {r.scope: r for r in A.threshold_candidates(chips, (50.0,)).collect()}
    g = rows["global"]
    assert (g.retained_chips, g.removed_chips, g.source_tiffs_affected, g.source_tiffs_eliminated, g.class_1_pixels_removed) == (1, 2, 2, 1, 50)
    assert rows["region_b"].region_eliminated and not rows["region_a"].region_eliminated
    assert ranking.threshold_examples(chips, (50.0, 60.0)) == [(50.0, "below", "a"), (50.0, "above", "b"), (60.0, "above", "c")]
    two = spark.createDataFrame([("a", 0.0), ("a", 100.0)], "region_id string, v double")
    rows = A.percentile_rows(two, "v", "region_id").collect()
    assert len(rows) == 22 and [r.value for r in rows if r.scope == "global" and r.percentile == 50] == [50.0]


def test_selection(spark):
    kinds = [(0, 5, 0, 0)] + [(5, 0, 0, 0)] * 2 + [(4, 0, 1, 1)] * 2 + [(0, 0, 5, 5)] * 2
    rows = [(f"{r}{k}", f"s{r}", r, *kind) for r in ("x", "y") for k, kind in enumerate(kinds)]
    chips = spark.createDataFrame([(*r[:3], 5, *r[3:]) for r in rows], "chip_id string, source_tiff_id string, region_id string, total_pixel_count long, class_0_pixel_count long, class_1_pixel_count long, ignore_pixel_count long, nodata_pixel_count long")
    assert policy.training_selection(chips).where("selected_for_training").count() == 2
    kept = policy.training_selection(chips, "retain_fraction", "0.5", 41)
    assert kept.where("selected_for_training").count() == 8
    assert rules.count_algebra(chips).count() == 0
    assert rules.selection_consistency(policy.training_selection(chips)).count() == 0
    counts = {r.class_presence: r.chips for r in A.presence_rollup(policy.training_selection(chips)).where("level = 'global'").collect()}
    assert counts == {"positive": 2, "clean_background_only": 4, "mixed_background_nodata": 4, "ignore_only": 4}


def test_folds(spark):
    rows = [("a", "s1", "r1", 0, 0, True, "TRAIN"), ("b", "s1", "r1", 0, 512, False, "TRAIN"), ("c", "s2", "r1", 0, 0, True, "VAL"), ("d", "s2", "r1", 512, 0, True, "VAL"), ("e", "s3", "r2", 0, 0, True, "TEST"), ("f", "s3", "r2", 512, 512, True, "TEST")]
    chips = spark.createDataFrame(rows, "chip_id string, source_tiff_id string, region_id string, row_off int, col_off int, selected_for_training boolean, source_temporal_split string")
    found = {r.chip_id: r.selection_reason for r in policy.baseline_fold(chips).collect()}
    assert found == {"a": "selected", "b": "background_policy_exclusion", "c": "selected", "d": "validation_overlap_exclusion", "e": "selected", "f": "test_overlap_exclusion"}
    folds = policy.held_out_folds(chips, ["r1", "r2"])
    assert folds.count() == 12 and rules.fold_leakage(folds).count() == 0
    fine, bad = rules.scope_rows(policy.baseline_fold(chips), "all_retained")
    assert fine.count() == 2 and bad.count() == 0


def test_split_cuts(spark):
    days = [f"20{20 + k // 4}-0{1 + k % 4 * 2}-01" for k in range(8)]
    rows = [(f"s{k}_{i}", "r", d) for k, d in enumerate(days) for i in range(3)]
    split = ranking.temporal_split(spark.createDataFrame(rows, "source_tiff_id string, region_id string, d string").select("source_tiff_id", "region_id", F.to_date("d").alias("acquisition_date")))
    assert ranking.chronology_faults(split).count() == 0
    assert {r.split for r in split.select("split").distinct().collect()} == {"TRAIN", "VAL", "TEST"}


def test_filter_apply_twice(spark):
    chips = spark.createDataFrame([("a", "s", "r", 50.0, 1), ("b", "s", "r", 50.1, 1)], CHIPS)
    parts = policy.apply_filter(chips, "50")
    assert [r.chip_id for r in parts["active"].collect()] == ["a"]
    assert policy.filter_status(parts["active"], parts["metadata"], "50") == "already_applied"
    assert policy.filter_status(chips, parts["metadata"], "50") == "pending"
    assert sets.partition_faults(chips, parts["active"], parts["removed"], "chip_id").count() == 0
    assert rules.replay_faults(policy.filter_report(chips, "50"), chips, "50").count() == 0


def test_keys_and_issues(spark):
    rows = spark.createDataFrame([("A",), ("a",), (" ",), ("b",)], "k string")
    found = rules.unique_key(rows, "k")
    assert {r.issue_type for r in found.collect()} == {"blank_key", "duplicate_key"}
    with pytest.raises(ValueError):
        rules.require_none(found)


def test_footprint(spark):
    boxes = spark.createDataFrame([("r", 0.0, 0.0, 2.0, 2.0), ("r", 1.0, 1.0, 3.0, 3.0)], "region_id string, left double, bottom double, right double, top double")
    row = grid.footprints(boxes).first()
    assert (row.area, row.centroid_x) == (7.0, 1.5)
    assert "FeatureCollection" in tables.features(boxes.limit(1).withColumn("source_count", F.lit(1)), boxes).first().json


def test_tiles_and_scores(spark, tmp_path):
    for k in range(3):
        buffer = io.BytesIO()
        np.savez(buffer, image=np.full((2, 3, 4), k, np.uint16), label=np.zeros((2, 3), np.int64))
        (tmp_path / f"c{k}.npz").write_bytes(buffer.getvalue())
    tiles = tables.read_tiles(spark, str(tmp_path)).withColumn("chip_id", F.col("path"))
    assert tiles.count() == 3 and tiles.agg(F.sum(F.size("image"))).first()[0] == 72
    scored = overlap.score_tiles(tiles, lambda image, label: image[:, :, 0] / 2)
    assert sorted(r.probability[0] for r in scored.collect()) == [0.0, 0.5, 1.0]
    assert tables.read_inventory(spark, str(tmp_path)).count() == 3 and hashing.file_hashes(spark, str(tmp_path)).count() == 3


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n3,4\n")
    (tmp_path / "c.csv").write_text("x,x\n3,4\n")
    assert tables.read_fragments(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).count() == 2
    with pytest.raises(ValueError):
        tables.read_strict(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "a.csv"), ("z",))
    df = tables.read_manifest(spark, str(tmp_path / "a.csv"))
    assert tables.publish(df, str(tmp_path / "out")) and not tables.publish(df, str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        tables.publish(df.unionByName(df), str(tmp_path / "out"))


def test_registry_stream(spark, tmp_path):
    schema = "seq int, version string, run_key string, status string"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text('{"seq":1,"version":"v","run_key":"a","status":"started"}\n{"seq":2,"version":"v","run_key":"a","status":"completed"}\n{"seq":3,"version":"v","run_key":"b","status":"started"}\n')
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "log"))
    found = registry.run_available(stream(), ["version", "run_key"], str(tmp_path / "t1"), str(tmp_path / "c1"))
    assert {(r.run_key, r.status) for r in found.collect()} == {("a", "completed"), ("b", "started")}
    registry.upsert_states(stream(), ["version", "run_key"], str(tmp_path / "t"), str(tmp_path / "c2"))
    assert {(r.run_key, r.status) for r in registry.read_states(spark, str(tmp_path / "t"), ["version", "run_key"]).collect()} == {("a", "completed"), ("b", "started")}
    events = tables.read_events(spark, str(tmp_path / "log"), schema, ("started", "completed"))
    assert registry.transition_faults(events, ["run_key"], "completed", ("failed",)).count() == 1
    assert registry.process_new(events, lambda: events.where("run_key = 'a'"), ["run_key"], lambda df: None) == 1


def test_metrics_by_name(spark):
    rows = spark.createDataFrame([(0.0, 1), (2.0, 0), (1.0, -100)], "x double, y int")
    found = rows.agg(M.by_name("bce")(F.col("x"), F.col("y")).alias("v")).first().v
    assert found == pytest.approx((np.log(2) + np.log1p(np.exp(2.0))) / 2)
    with pytest.raises(KeyError):
        M.by_name("nothing")


def test_pairs_and_hashes(spark):
    a = spark.createDataFrame([("a.tif", "a"), ("b.tif", "b")], "relative_path string, stem string")
    issues = joins.pairing_issues(a, a.where("stem = 'a'").withColumn("stem", F.upper("stem")))
    assert [(r.issue_type, r.candidate_id) for r in issues.collect()] == [("missing_label", "b")]
    one_row, twice = a.limit(1), a.limit(1).unionByName(a.limit(1))
    assert hashing.table_fingerprint(one_row).first() != hashing.table_fingerprint(twice).first()


def test_bootstrap_by_bins(spark):
    rows = spark.range(0, 400, 1, 5).select("id", F.concat(F.lit("r"), F.pmod("id", F.lit(2))).alias("region_id"), (F.sin("id") / 10).alias("delta"))
    binned = {(r.scope, r.statistic): r for r in A.bootstrap_interval_by_bins(rows, replicates=4_000).collect()}
    dealt = {(r.scope, r.statistic): r for r in A.bootstrap_interval_by_bins(rows.repartition(3), replicates=4_000).collect()}
    chunked = {(r.scope, r.statistic): r for r in A.bootstrap_interval_by_bins(rows, replicates=4_000, drawn=100_000).collect()}
    assert set(binned) == {(s, k) for s in ("all_tiffs", "r0", "r1") for k in ("mean", "median")}
    for statistic in ("mean", "median"):
        for want in A.bootstrap_interval(rows, statistic=statistic, replicates=4_000).collect():
            width = want.high - want.low
            for found in (binned, chunked):
                got = found[want.scope, statistic]
                assert got.n == want.n and abs(got.low - want.low) < 0.1 * width and abs(got.high - want.high) < 0.1 * width
            assert abs(binned[want.scope, statistic].low - dealt[want.scope, statistic].low) < 1e-12
    nothing = A.bootstrap_interval_by_bins(rows.limit(0))
    assert nothing.count() == 0


def test_registered_queries_stay_off_one_task_and_the_driver(spark, monkeypatch):
    from rasterspark.plans.queries import QUERIES

    for module, name in ((A, "bootstrap_interval"), (registry, "run_available")):
        monkeypatch.setattr(module, name, lambda *a, **b: pytest.fail("reached"))
    folder = "/root/testdata/sf0.001"
    assert QUERIES["bootstrap_ci"](spark, folder).count() > 1
    states, events = QUERIES["latest_state_stream"](spark, folder), spark.read.parquet(f"{folder}/events.parquet")
    want = registry.latest_states(events.selectExpr("user_id AS run_key", "struct(ts, event_id) AS seq"), ["run_key"])
    assert {(r.run_key, r.ts, r.event_id) for r in states.collect()} == {(r.run_key, r.seq.ts, r.seq.event_id) for r in want.collect()}


def test_states_over_several_batches(spark, tmp_path):
    schema = "seq int, run_key string, status string"
    (tmp_path / "log").mkdir()
    for k, rows in enumerate(([(1, "a", "started"), (2, "b", "started")], [(4, "a", "completed")], [(3, "a", "failed"), (5, "c", "started")])):
        (tmp_path / "log" / f"{k}.json").write_text("".join(f'{{"seq":{s},"run_key":"{r}","status":"{v}"}}\n' for s, r, v in rows))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "log"))
        found = registry.run_available(stream, ["run_key"], str(tmp_path / "t"), str(tmp_path / "c"))
    assert {(r.run_key, r.status, r.seq) for r in found.collect()} == {("a", "completed", 4), ("b", "started", 2), ("c", "started", 5)}


@pytest.mark.parametrize("statistic", ["mean", "median"])
def test_bootstrap_draws_are_numpys(spark, statistic):
    values = np.sort(np.sin(np.arange(53)) / 10)
    drawn = values[np.random.default_rng(20260810).integers(0, len(values), (10_000, len(values)))]
    low, high = np.quantile(getattr(np, statistic)(drawn, axis=1), [0.025, 0.975])
    rows = spark.createDataFrame([("r", float(v)) for v in values], "region_id string, delta double")
    found = {r.scope: r for r in A.bootstrap_interval(rows, statistic=statistic).collect()}
    assert {(r.low, r.high) for r in found.values()} == {(low, high)} and found["r"].n == 53


def test_table_fingerprints(spark):
    found = {r.name: r.same for r in __import__("rasterspark.plans.queries", fromlist=["QUERIES"]).QUERIES["table_fingerprint"](spark, "/root/testdata/sf0.001").collect()}
    assert found == {"part": True, "shuffled": True, "changed": False, "repeated": False, "swapped": False}
    rows = [(1, "a"), (2, None), (2, None)]
    hashes = [r[0] for r in spark.createDataFrame(rows, "k int, v string").select(F.xxhash64("k", "v")).collect()]
    assert tuple(hashing.table_fingerprint(spark.createDataFrame(rows, "k int, v string")).first()) == (3, sum(hashes))


def test_sources_without_date_or_region_keep_their_row(spark):
    rows = [(f"s{k}", "r", f"2020-0{1 + k}-01") for k in range(5)] + [("n", "r", None), ("m", None, "2020-01-01")]
    sources = spark.createDataFrame(rows, "source_tiff_id string, region_id string, d string").withColumn("acquisition_date", F.to_date("d"))
    out = {r.source_tiff_id: r.split for r in ranking.temporal_split(sources).collect()}
    assert len(out) == 7 and out["n"] is None and out["m"] is None and out["s0"] == "TRAIN" and out["s4"] == "TEST"
