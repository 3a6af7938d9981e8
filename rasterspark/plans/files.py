"""Queries that write the given tables to the shared folder in the package's formats and scan them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import blocks, grid, policy
from ..sources import rasters, scratch, tables
from ..streaming import registry
from .adapters import PIXELS, Tables, duck
from .base import query, rounded
from .checks import _K, number
from .queries import _LORO, REGIONS, C, S, _with_roles

_SOURCES = ("source_tiff_id", "dataset", "region_id", "region_name", "acquisition_date")
_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _SOURCES)


def written(t: Tables, df: DataFrame, name: str, columns: tuple[str, ...] = _SOURCES) -> str:
    path = scratch.path(t.spark, name)
    tables.write_csv(df, path, list(columns), [columns[0]])
    return path


@query(duck(*S) + f" SELECT {_TEXT} FROM sources")
def manifest_scan(t: Tables) -> DataFrame:
    return tables.read_manifest(t.spark, written(t, t["sources"], "manifest"), _SOURCES)


@query(duck(*S) + f" SELECT {_TEXT} FROM sources")
def strict_scan(t: Tables) -> DataFrame:
    return tables.read_strict(t.spark, written(t, t["sources"], "strict"), _SOURCES)


@query(duck(*S) + f" SELECT {_TEXT} FROM sources")
def source_manifest_scan(t: Tables) -> DataFrame:
    return tables.read_sources(t.spark, written(t, t["sources"], "sources"))


@query(duck(*S) + " SELECT dataset, region_id, count(*) AS n, min(source_tiff_id) AS low, count(DISTINCT dataset) AS fragments FROM sources GROUP BY 1, 2")
def fragment_union(t: Tables) -> DataFrame:
    paths = [written(t, t["sources"].where(F.col("dataset") == d), f"fragment_{d}") for d in ("bc", "ca")]
    rows = tables.read_fragments(t.spark, paths).withColumn("part", F.regexp_extract("fragment", r"fragment_(\w\w)", 1))
    return rows.groupBy("dataset", "region_id").agg(F.count(F.lit(1)).alias("n"), F.min("source_tiff_id").alias("low"), F.count_distinct("part").alias("fragments"))


@query("""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(10 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(x AS DOUBLE) + 1) / 2))) AS INT)) AS v FROM embeddings)
SELECT concat('chip_', vec_id) AS path, 8 AS h, 8 AS w, 1 AS b, CAST(list_sum(v) AS BIGINT) AS total, v[1] AS first, v[64] AS last FROM t""")
def chip_archives(t: Tables) -> DataFrame:
    tiles = t.tiles().select(F.col("chip_id").alias("path"), "h", "w", F.lit(1).alias("b"), F.transform("probability", lambda p: F.floor(10 * p).cast("int")).alias("image"), "label")
    path = scratch.path(t.spark, "chip-files")
    rasters.write_files(tiles, "rasterchips", path)
    back = rasters.read_chip_files(t.spark, path, ("path", "h", "w", "b", "image"))
    return back.select("path", "h", "w", "b", F.aggregate("image", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("image")[0].alias("first"), F.col("image")[63].alias("last"))


@query("SELECT label, count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS pixels, min(vec_id) AS first_id FROM embeddings GROUP BY 1")
def image_dataset_scan(t: Tables) -> DataFrame:
    path = scratch.path(t.spark, "images")
    t["embeddings"].select(F.col("embedding").alias("image.tif"), F.array("label").alias("label.tif"), "vec_id").write.parquet(path)
    rows = tables.read_image_dataset(t.spark, path)
    return rows.groupBy(F.col("label")[0].alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("image")).alias("pixels"), F.min("vec_id").alias("first_id"))


@query("""WITH p AS (SELECT vec_id // 4 AS s, 1 + vec_id % 2 AS band, 4 * ((vec_id % 4) // 2) + i // 8 AS r, 8 * (vec_id % 2) + i % 8 AS c, x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings))
SELECT s, band, count(*) AS pixels, round(sum(x::DOUBLE), 6) AS total FROM p WHERE band <= 2 AND r >= 3 AND r < 10 AND c >= 5 AND c < 12 GROUP BY 1, 2""")
def windowed_blocks(t: Tables) -> DataFrame:
    path, k = scratch.path(t.spark, "block-files"), F.pmod("vec_id", F.lit(4))
    blocks = t["embeddings"].select(F.expr("CAST(vec_id DIV 4 AS STRING)").alias("source"), (1 + F.pmod("vec_id", F.lit(2))).alias("band"), (4 * F.floor(k / 2)).alias("row_off"), (8 * F.pmod(k, F.lit(2))).alias("col_off"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("values"))
    rasters.write_files(blocks, "rasterblocks", path)
    parts = rasters.read_block_files(t.spark, path, window=(3, 5, 7, 7)).where(F.col("band").isin(1, 2))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rounded(parts.groupBy(F.col("source").cast("long").alias("s"), "band").agg(F.sum(F.size("values")).alias("pixels"), F.sum(total).alias("total")), "total")


@query("""SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY 1""")
def event_log_scan(t: Tables) -> DataFrame:
    path = scratch.path(t.spark, "log")
    t["events"].select("event_id", F.col("event_type").alias("status")).write.json(path)
    known = tuple(r[0] for r in t["events"].select("event_type").distinct().collect())  # the names of the statuses
    rows = tables.read_events(t.spark, path, "event_id long, status string", known)
    return rows.groupBy(F.col("status").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS line FROM events) SELECT line, CASE WHEN event_id % 19 = 3 THEN 'json' ELSE 'status' END AS fault FROM o WHERE event_id % 19 = 3 OR event_id % 23 = 4""")
def event_log_faults(t: Tables) -> DataFrame:
    """A log of several files with broken lines and unknown statuses: their numbers through the log."""
    path, k = scratch.path(t.spark, "broken-log"), F.col("event_id")
    good = F.to_json(F.struct("event_id", F.when(k % 23 == 4, "?").otherwise("started").alias("status")))
    lines = t["events"].select(k, F.when(k % 19 == 3, F.substring(good, 1, 9)).otherwise(good).alias("value"))
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return tables.event_faults(t.spark, path, "event_id long, status string", ("started",), across=True).select("line", "fault")


@query(duck(*C) + """ SELECT region_id, '{"chips":' || count(*) || ',"nodata":' || sum(nodata_pixel_count) || ',"region_id":"' || region_id || '"}' AS json FROM chips GROUP BY 1""")
def summary_documents(t: Tables) -> DataFrame:
    rows = t["chips"].groupBy("region_id").agg(F.sum("nodata_pixel_count").alias("nodata"), F.count(F.lit(1)).alias("chips"))
    return tables.summary_json(rows).select(F.get_json_object("json", "$.region_id").alias("region_id"), "json")


@query("SELECT count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance, 'first' AS name FROM supplier")
def json_document(t: Tables) -> DataFrame:
    path = scratch.path(t.spark, "document")
    row = t["supplier"].agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"), F.lit("first").alias("name"))
    row.coalesce(1).write.json(path)
    return tables.read_document(t.spark, path).select("suppliers", "balance", "name")


@query("SELECT CAST(n_regionkey AS INT) AS region, count(*) AS nations, FALSE AS there_after_failure, TRUE AS wrote, FALSE AS wrote_again FROM nation GROUP BY 1")
def publish_once(t: Tables) -> DataFrame:
    """A publish that fails on a row leaves nothing, the next one writes, the one after finds the same content."""
    path, nations = scratch.path(t.spark, "published"), t["nation"]
    broken = nations.withColumn("n_name", F.when(F.col("n_nationkey") == 7, F.raise_error(F.lit("a broken row"))).otherwise(F.col("n_name")))
    try:
        tables.publish(broken, path)
    except Exception:  # noqa: BLE001  Spark's own error
        pass
    there = tables.is_published(t.spark, path)
    wrote, again = tables.publish(nations, path), tables.publish(nations.repartition(3), path)
    rows = tables.read_published(t.spark, path).groupBy(F.col("n_regionkey").cast("int").alias("region")).agg(F.count(F.lit(1)).alias("nations"))
    return rows.withColumns({"there_after_failure": F.lit(there), "wrote": F.lit(wrote), "wrote_again": F.lit(again)})


@query(duck(*C) + _LORO + """ SELECT fold_id, experiment_split, count(*) AS chips, min(chip_id) AS first_id, 0 AS faults FROM loro WHERE experiment_split <> '' GROUP BY 1, 2""")
def split_views(t: Tables) -> DataFrame:
    path = scratch.path(t.spark, "views")
    folds = policy.held_out_folds(_with_roles(t), REGIONS).select("fold_id", "experiment_split", "chip_id", "selected")
    tables.write_views(folds, path)
    faults = tables.verify_views(t.spark, folds, path).agg(F.count(F.lit(1)).cast("int").alias("faults"))  # one row
    rows = t.spark.read.parquet(path).groupBy("fold_id", "experiment_split").agg(F.count(F.lit(1)).alias("chips"), F.min("chip_id").alias("first_id"))
    return rows.crossJoin(F.broadcast(faults))


@query(f"""WITH {PIXELS} SELECT source_tiff_id, 182 AS pixels, 182 - count(*) AS uncovered, sum(mask) + 255 * (182 - count(*)) AS masks, round(sum(probability), 5) AS total FROM cov GROUP BY 1""")
def prediction_rasters(t: Tables) -> DataFrame:
    """Sources of 14 rows and 13 columns, larger than what their tiles cover, as raster files of probabilities and masks."""
    path, tiles = scratch.path(t.spark, "predictions"), t.tiles()
    sources = tiles.select("source_tiff_id", F.lit(14).alias("source_height"), F.lit(13).alias("source_width")).distinct()
    tables.write_predictions(blocks.reconstruct_blocks(tiles, ["source_tiff_id"]), sources, path)
    files = rasters.read_block_files(t.spark, path)
    known = F.filter("values", lambda x: ~F.isnan(x))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    first, second = F.col("band") == 1, F.col("band") == 2
    out = files.groupBy(F.col("source").alias("source_tiff_id")).agg(F.sum(F.when(first, F.size("values"))).alias("pixels"), F.sum(F.when(first, F.size("values") - F.size(known))).alias("uncovered"), F.sum(F.when(second, total(F.col("values")))).cast("long").alias("masks"), F.sum(F.when(first, total(known))).alias("total"))
    return rounded(out, "total", digits=5)


_BOXES = """WITH b AS (SELECT concat('r', l_suppkey % 5) AS region_id, (l_partkey % 40 + l_linenumber)::INT AS l, (l_partkey % 40 + l_linenumber + l_quantity::INT % 4 + 1)::INT AS r, (l_orderkey % 31)::INT AS b, (l_orderkey % 31 + l_linenumber % 3 + 1)::INT AS t FROM lineitem WHERE l_orderkey % 7 = l_partkey % 11),
u AS (SELECT DISTINCT region_id, x, y FROM (SELECT region_id, x, unnest(range(b, t)) AS y FROM (SELECT *, unnest(range(l, r)) AS x FROM b)))"""


def _boxes(t: Tables) -> DataFrame:
    line, part, order = F.col("l_linenumber"), F.pmod("l_partkey", F.lit(40)), F.pmod("l_orderkey", F.lit(31))
    rows = t["lineitem"].where(F.pmod("l_orderkey", F.lit(7)) == F.pmod("l_partkey", F.lit(11)))
    ends = {"left": part + line, "right": part + line + F.pmod(F.col("l_quantity").cast("int"), F.lit(4)) + 1, "bottom": order, "top": order + F.pmod(line, F.lit(3)) + 1}
    return rows.select(F.concat(F.lit("r"), F.pmod("l_suppkey", F.lit(5))).alias("region_id"), *[c.cast("double").alias(n) for n, c in ends.items()])


def _features(t: Tables, kind: str, shape: str) -> DataFrame:
    """Features of one kind from the collection that the GeoJSON sink makes, their coordinates parsed."""
    boxes = _boxes(t)
    regions = boxes.groupBy("region_id").agg(F.count(F.lit(1)).alias("source_count"))
    schema = "array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<region_id:string,source_count:bigint>>>"
    found = tables.features(regions, boxes).select(F.explode(F.from_json("json", f"features {schema}")["features"]).alias("f")).where(F.col("f.geometry.type") == kind)
    return found.select("f.properties.region_id", F.from_json("f.geometry.coordinates", shape).alias("at"), F.col("f.properties.source_count").alias("sources"))


@query(_BOXES + """, f AS (SELECT region_id, avg(x + 0.5) AS cx, avg(y + 0.5) AS cy FROM u GROUP BY 1)
SELECT region_id, round(cx, 6) AS x, round(cy, 6) AS y, (SELECT count(*) FROM b WHERE b.region_id = f.region_id) AS sources FROM f""")
def region_features(t: Tables) -> DataFrame:
    """The point features: area centroids of dissolved footprints."""
    found = _features(t, "Point", "array<double>")
    return rounded(found.select("region_id", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"), "sources"), "x", "y")


@query(_BOXES + """, v AS (SELECT region_id, x, min(y) AS low, max(y) + 1 AS high FROM (SELECT *, y - row_number() OVER (PARTITION BY region_id, x ORDER BY y) AS run FROM u) GROUP BY region_id, x, run),
h AS (SELECT *, x - row_number() OVER (PARTITION BY region_id, low, high ORDER BY x) AS run FROM v)
SELECT region_id, min(x)::DOUBLE AS x, max(x)::DOUBLE + 1 AS x2, low::DOUBLE AS low, high::DOUBLE AS high, 5 AS points FROM h GROUP BY region_id, low, high, run""")
def region_rings(t: Tables) -> DataFrame:
    """The rings of the dissolved MultiPolygons: covered stretches in y, joined in x while they stay the same."""
    rings = _features(t, "MultiPolygon", "array<array<array<array<double>>>>").select("region_id", F.explode("at").alias("polygon")).select("region_id", F.col("polygon")[0].alias("ring"))
    xs, ys = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    return rings.select("region_id", F.array_min(xs).alias("x"), F.array_max(xs).alias("x2"), F.array_min(ys).alias("low"), F.array_max(ys).alias("high"), F.size("ring").alias("points"))


@query(duck(*C) + f", n AS (SELECT DISTINCT {_K} AS k FROM chips) SELECT k % 4 = 1 AS done_before, count(*) AS sources FROM n GROUP BY 1")
def incremental_sources(t: Tables) -> DataFrame:
    """Sources without a completion are processed, once: the second call finds nothing to do."""
    path = scratch.path(t.spark, "completions")
    work = scratch.saved(t["chips"].select("source_tiff_id").distinct().select(number().alias("k")), "work")  # a name has one number
    work.where(F.pmod("k", F.lit(4)) == 1).withColumn("before", F.lit(True)).write.parquet(path)
    done = lambda: t.spark.read.schema("k long, before boolean").parquet(path)
    for _ in range(2):
        registry.process_new(work, done, ["k"], lambda todo: todo.withColumn("before", F.lit(False)).write.mode("append").parquet(path))
    return done().groupBy(F.col("before").alias("done_before")).agg(F.count(F.lit(1)).alias("sources"))


@query("SELECT 'class_' || x || '_pixel_count' AS name, count(*) AS n FROM (SELECT CASE l_linenumber - 2 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 4 THEN 0 END AS x FROM lineitem) WHERE x IS NOT NULL GROUP BY 1")
def class_columns(t: Tables) -> DataFrame:
    """Counts in columns that the remap table names, one for each of its classes."""
    from ..functions import exprs as X

    table = (0, 1, 0, -100, 0)
    pixels = t["lineitem"].select(F.lit("all").alias("k"), X.remap_label(F.col("l_linenumber") - 2, table).alias("label"), F.array(F.lit(1)).alias("bands"))
    names = [f"class_{v}_pixel_count" for v in A.class_columns(table)]
    wide = A.pixel_counts(pixels, ["k"], A.class_columns(table))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("c")).select("c.*")


@query(duck(*S) + """ SELECT region_id, row_number() OVER (ORDER BY region_id = 'ASIA', region_id) AS place FROM (SELECT DISTINCT region_id FROM sources)""")
def footprint_order(t: Tables) -> DataFrame:
    from ..operators import ranking

    regions = t["sources"].select("region_id").distinct()
    return ranking.numbered(ranking.footprint_order(regions, "ASIA"), "place")


@query("""WITH r AS (SELECT p_partkey, (p_size % 7 + 1)::DOUBLE AS a, (p_partkey % 5)::DOUBLE AS b FROM part) SELECT p_partkey, 300.0::DOUBLE AS "left", 500.0 - 20 * a AS bottom, 300.0 + 30 * a + 20 * b AS "right", 500.0 + 30 * b AS top FROM r""")
def rotated_bounds(t: Tables) -> DataFrame:
    """Envelopes of rasters on turned grids: 30 columns, 20 rows."""
    a, b = (F.pmod("p_size", F.lit(7)) + 1).cast("double"), F.pmod("p_partkey", F.lit(5)).cast("double")
    rasters = t["part"].select("p_partkey", F.lit(30).alias("width"), F.lit(20).alias("height"), a.alias("transform_a"), b.alias("transform_b"), F.lit(300.0).alias("transform_c"), b.alias("transform_d"), (-a).alias("transform_e"), F.lit(500.0).alias("transform_f"))
    return grid.raster_bounds(rasters).select("p_partkey", "left", "bottom", "right", "top")
