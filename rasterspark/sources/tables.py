"""Scans and sinks of manifests, chips, blocks and event logs."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = "path string, h int, w int, b int, image array<int>, label array<int>"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file and header (its first line, null if blank) of each file: the line at the start of the file's first split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), "value")
    first = lines.where("at = 0").groupBy("file").agg(F.min_by("value", "k").alias("value"))
    text = F.ltrim(F.regexp_replace("value", "^\ufeff", ""))
    return first.select("file", F.when(text != "", text).alias("header"))


def header(spark: SparkSession, path: str) -> list[str]:
    """The columns that all files of path name in their first lines; an error if one has none or other ones."""
    found = headers(spark, path).groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file")).orderBy(F.desc("n"), "file").limit(2).collect()
    if not found or any(r.header is None for r in found):
        raise ValueError(f"{found[0].file if found and found[0].header is None else path} has no header")
    if len(found) > 1:
        raise ValueError(f"{found[1].file} has another header than {found[0].file}")
    return [c.strip().strip('"') for c in found[0].header.split(",")]


def read_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Every cell a string; fails if a required column is missing."""
    df = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", False).csv(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


def read_strict(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Also fails on no header, on files with other headers, on repeated column names, and on rows of another width when
    the rows are read."""
    names = header(spark, path)
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"{path} repeats the columns {twice}")
    if missing := sorted(set(required) - set(names)):
        raise ValueError(f"{path} lacks the columns {missing}")
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("escape", '"').csv(path)


def read_fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Manifests of one schema as one table, ordered at the sink only; fails on other headers or on none."""
    if not paths:
        raise ValueError("no fragments")
    names = header(spark, paths[0])
    for path in paths[1:]:
        if header(spark, path) != names:
            raise ValueError(f"{path} has another header than {paths[0]}")
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).option("mode", "FAILFAST").csv(paths).withColumn("fragment", F.input_file_name())


SOURCE_COLUMNS = ("source_tiff_id", "dataset", "region_id", "region_name", "acquisition_date")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    df = read_manifest(spark, path, SOURCE_COLUMNS)
    if twice := [r[0] for r in df.groupBy(F.lower("source_tiff_id")).count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"{path} repeats the sources {twice}")
    return df


def decode_tiles(files: DataFrame) -> DataFrame:
    """files: path, content (NPZ bytes with exactly the arrays image (h, w, b) and label (h, w)) -> tiles."""

    def decode(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    if set(arrays.files) != {"image", "label"}:
                        raise ValueError(f"{name} holds {sorted(arrays.files)}")
                    image, label = arrays["image"], arrays["label"]
                if image.ndim != 3 or label.shape != image.shape[:2]:
                    raise ValueError(f"{name} has the shapes {image.shape} and {label.shape}")
                rows.append((name, *image.shape, image.astype("int32").ravel(), label.astype("int32").ravel()))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "b", "image", "label"])

    return files.select("path", "content").mapInPandas(decode, TILE)


def encode_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles (path, h, w, b, image, label) -> path and NPZ bytes."""

    def encode(frames):
        import numpy as np

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                held = io.BytesIO()
                np.savez_compressed(held, image=np.asarray(row.image, np.int32).reshape(row.h, row.w, row.b), label=np.asarray(row.label, np.int32).reshape(row.h, row.w))
                out.append(held.getvalue())
            yield frame[["path"]].assign(content=out)

    return tiles.select("path", "h", "w", "b", "image", "label").mapInPandas(encode, "path string, content binary")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """NPZ chips, one row for each file."""
    return decode_tiles(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path))


#: Columns of a hosted image dataset.
IMAGE_COLUMNS = ("image.tif", "label.tif")


def read_image_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset split with its arrays in the columns image.tif and label.tif -> image and label, and other columns."""
    df = spark.read.parquet(path)
    if missing := [c for c in IMAGE_COLUMNS if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*[F.col(f"`{c}`").alias(c.removesuffix(".tif")) for c in IMAGE_COLUMNS], *[F.col(f"`{c}`") for c in df.columns if c not in IMAGE_COLUMNS])


def read_blocks(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Block rows of rasters, of some bands, that touch a window (row, col, height, width); both prune the scan."""
    df = spark.read.parquet(path)
    if bands is not None:
        df = df.where(F.col("band").isin(bands))
    if window:
        row, col, height, width = window
        df = df.where((F.col("row_off") < row + height) & (F.col("row_off") + F.col("h") > row) & (F.col("col_off") < col + width) & (F.col("col_off") + F.col("w") > col))
    return df


def read_window(spark: SparkSession, path: str, bands: list[int], window: tuple[int, int, int, int]) -> DataFrame:
    """The parts of the blocks that lie in a window (row, col, height, width): offsets, h, w and values of each part."""
    from ..operators.grid import cut_tile

    row, col, height, width = window
    top, left = F.greatest("row_off", F.lit(row)), F.greatest("col_off", F.lit(col))
    h, w = F.least(F.col("row_off") + F.col("h"), F.lit(row + height)) - top, F.least(F.col("col_off") + F.col("w"), F.lit(col + width)) - left
    part = cut_tile(F.col("values"), F.col("w"), F.lit(1), top - F.col("row_off"), left - F.col("col_off"), h, w)
    blocks = read_blocks(spark, path, bands, window)
    # named apart first: within a lambda Spark takes an alias of the same select for the column of that name
    parts = blocks.select(*[c for c in blocks.columns if c not in ("row_off", "col_off", "h", "w", "values")], F.struct(top.alias("row_off"), left.alias("col_off"), h.alias("h"), w.alias("w"), part.alias("values")).alias("part"))
    return parts.select(*[c for c in parts.columns if c != "part"], "part.*")


def numbered_lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """file, line (from 1) and value of each line; across: numbers go on through the files in the order of their names.

    Files are read in splits of bytes. Lines of a split are counted where it is read, and a prefix sum over the splits
    (a row each) tells how many lines come before it, so a file of any size is many tasks' work and no line is shuffled.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    before = Window.partitionBy(*([] if across else ["file"])).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("k") - F.col("first") + 1).alias("line"), "value")


def event_faults(spark: SparkSession, path: str, schema: str, statuses: tuple[str, ...] = (), across: bool = False) -> DataFrame:
    """file, line (see numbered_lines) and fault (json, status) of the lines that read_events would fail on; blank lines
    are none."""
    parsed = numbered_lines(spark, path, across).where(F.trim("value") != "").withColumn("e", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    fault = F.when(F.col("e").isNull() | F.col("e._corrupt_record").isNotNull(), "json")
    if statuses:
        fault = fault.when(~F.coalesce(F.col("e.status").isin(*statuses), F.lit(False)), "status")
    return parsed.select("file", "line", fault.alias("fault")).where("fault IS NOT NULL")


def read_events(spark: SparkSession, path: str, schema: str, statuses: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines; a broken line or an unknown status is fatal when rows are read, event_faults() tells which lines."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if statuses:
        known = F.col("status").isin(*statuses)
        df = df.withColumn("status", F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null"))))))
    return df


def read_document(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if df.count() != 1:
        raise ValueError(f"{path} is not one JSON object")
    return df


def read_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """relative_path, stem (lower case), suffix, byte_size; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.col("path").alias("relative_path"), F.lower(F.regexp_replace(name, r"\.[^.]*$", "")).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), F.col("length").alias("byte_size"))


def write_csv(df: DataFrame, path: str, columns: list[str], keys: list[str], allow_empty: bool = False) -> None:
    if not allow_empty and df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.select(*columns).orderBy(*keys).write.option("header", True).csv(path)


#: File that a published table has; without it a table isn't there.
MARKER = "_PUBLISHED"


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def mark(spark: SparkSession, path: str, text: str) -> None:
    """Writes the marker, which must not be there; its making is what publishes a table."""
    where, fs = _place(spark, f"{path}/{MARKER}")
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def is_published(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, f"{path}/{MARKER}")
    return fs.exists(where)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A published table; an error for what a failed publish has left."""
    if not is_published(spark, path):
        raise FileNotFoundError(f"{path} is not published")
    return spark.read.parquet(path)


def publish(df: DataFrame, path: str) -> bool:
    """Writes a table whole or not at all: False if the same content is published, an error if other content is.

    The table is written beside its place, held against df, renamed, and marked last. What fails before the mark is
    cleared, by this call or by the next one, so a failed publish can be tried again.
    """
    import uuid

    from ..operators.hashing import table_fingerprint

    spark = df.sparkSession
    final, fs = _place(spark, path)
    print_of = lambda rows: tuple(table_fingerprint(rows.select(*df.columns)).first())
    if is_published(spark, path):
        if print_of(spark.read.parquet(path)) != print_of(df):
            raise FileExistsError(f"{path} has other content")
        return False
    stage = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    beside, _ = _place(spark, stage)
    try:
        df.write.mode("errorifexists").parquet(stage)
        found = print_of(spark.read.schema(df.schema).parquet(stage))
        if found != print_of(df):
            raise OSError(f"{stage} differs from what was to be written")
        if fs.exists(final):  # renamed but never marked
            fs.delete(final, True)
        if not fs.rename(beside, final):
            raise OSError(f"{stage} can't be renamed to {path}")
        mark(spark, path, f'{{"rows":{found[0]},"digest":"{found[1]}"}}')
    except BaseException:
        fs.delete(beside, True)
        if fs.exists(final) and not is_published(spark, path):
            fs.delete(final, True)
        raise
    return True


def summary_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text with their columns in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def write_views(folds: DataFrame, path: str) -> None:
    """The selected chips by fold and split; verify_views() holds what was written against them."""
    folds.where("selected").write.partitionBy("fold_id", "experiment_split").parquet(path)


def verify_views(spark: SparkSession, folds: DataFrame, path: str) -> DataFrame:
    """fold_id, experiment_split, chip_id and side (missing, unexpected) of rows that the written set and the selected
    one don't share; empty if they are equal."""
    from ..operators.sets import symmetric_difference

    keys = ["fold_id", "experiment_split", "chip_id"]
    return symmetric_difference(folds.where("selected"), spark.read.parquet(path), keys)


def dense_blocks(blocks: DataFrame, sources: DataFrame, size: int | None = None) -> DataFrame:
    """Blocks of every pixel of each source (source_width, source_height), as rows of raster files: band 1 the probability
    (NaN where no tile lies), band 2 the mask (255 there). Sources without a block are there, too."""
    from ..operators import blocks as B

    keys, size = ["source_tiff_id"], size or B.BLOCK
    whole = {"t_height": F.col("source_height"), "t_width": F.col("source_width"), **{c: F.lit(0 if c.startswith(("x0", "y0", "origin")) else 1) for c in B.GRID[2:]}}
    grids = sources.select(*keys, *[c.alias(n) for n, c in whole.items()])
    known_or = lambda gone: lambda x: F.coalesce(x.cast("double"), F.lit(gone))
    bands = []
    for band, layer, gone in ((1, "probability", float("nan")), (2, "mask", 255.0)):
        found = B.aligned_blocks(blocks, grids, keys, layer, size=size)
        bands.append(found.select(F.col("source_tiff_id").alias("source"), F.lit(band).alias("band"), "row_off", "col_off", "h", "w", F.transform(layer, known_or(gone)).alias("values")))
    return bands[0].unionByName(bands[1])


def write_predictions(blocks: DataFrame, sources: DataFrame, path: str, size: int | None = None) -> None:
    """Raster files of the dense probabilities and masks of all sources."""
    from . import rasters

    rasters.write_files(dense_blocks(blocks, sources, size), "rasterblocks", path)


def features(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """A JSON feature collection with the dissolved footprint (disjoint rectangles) and its area centroid for each region.

    regions: region_id, source_count; boxes: region_id, left, bottom, right, top. One row for each region is gathered.
    """
    from ..operators.grid import footprint_parts, footprints

    corners = [("x", "from"), ("x2", "from"), ("x2", "to"), ("x", "to"), ("x", "from")]
    ring = F.array(F.array(*[F.array(F.col(x), F.col(y)) for x, y in corners]))
    shapes = footprint_parts(boxes).groupBy("region_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "from", ring.alias("ring")))), lambda s: s["ring"]).alias("rings"))
    rows = regions.join(shapes, "region_id").join(footprints(boxes), "region_id")

    def feature(kind, coordinates):
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct("region_id", "source_count").alias("properties")))

    rows = rows.select("region_id", F.posexplode(F.array(feature("MultiPolygon", F.col("rings")), feature("Point", F.array("centroid_x", "centroid_y")))).alias("k", "f"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("region_id", "k", "f"))), lambda r: r["f"]), ",")
    return rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("json"))
