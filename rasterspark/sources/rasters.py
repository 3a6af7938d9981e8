"""Raster blocks and chips in files as Spark data sources: partitions of files, pushed filters, only what is asked for is opened.

`rasterblocks`: a NumPy file for each block, named by what it holds, so filters on source, band and place choose files
before any is opened. `rasterchips`: an NPZ file for each chip with the arrays image and label; an array that the schema
doesn't ask for is not read. Both are sinks too: a task writes its rows' files, and _SUCCESS is written once all have.

Paths may be any that pyarrow's file systems open (local, hdfs, s3, gs); the package must be installed on the executors.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = re.compile(r"(?P<source>.+)__b(?P<band>\d+)_r(?P<row_off>\d+)_c(?P<col_off>\d+)_h(?P<h>\d+)_w(?P<w>\d+)\.npy")
BLOCKS = "source string, band int, row_off int, col_off int, h int, w int, values array<double>"
CHIPS = "path string, h int, w int, b int, image array<int>, label array<int>"
#: Bytes of files in a partition.
PARTITION = 64 << 20
_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.rstrip("/"))


@dataclass
class Files(InputPartition):
    """Names in the folder, and what the names say."""

    files: list[tuple[str, dict]]


class FileReader(DataSourceReader):
    """Lists the folder, keeps what the pushed filters want, and deals files to partitions by their bytes."""

    suffix = ""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names, self.filters = options["path"], schema.names, []
        self.window = tuple(int(x) for x in options["window"].split(",")) if options.get("window") else None

    def facts(self, name: str) -> dict | None:
        """Columns that a file's name tells, or None for a file of another kind."""
        return {"path": name.removesuffix(self.suffix)} if name.endswith(self.suffix) else None

    known: tuple[str, ...] = ("path",)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.known:
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def wanted(self, facts: dict) -> bool:
        return all(_TESTS[kind](facts[c], value) for c, kind, value in self.filters)

    def partitions(self) -> list[Files]:
        system, folder = opened(self.path)
        parts, size = [Files([])], 0
        for info in sorted(system.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda i: i.path):
            name = info.path[len(folder) :].lstrip("/")
            facts = None if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")) else self.facts(name)
            if facts is None or not self.wanted(facts):
                continue
            if size + info.size > PARTITION and parts[-1].files:
                parts.append(Files([]))
                size = 0
            parts[-1].files.append((name, facts))
            size += info.size
        return parts

    def content(self, system: fs.FileSystem, folder: str, name: str) -> io.BytesIO:
        with system.open_input_file(f"{folder}/{name}") as f:
            return io.BytesIO(f.read())


class BlockReader(FileReader):
    suffix, known = ".npy", ("source", "band", "row_off", "col_off", "h", "w")

    def facts(self, name: str) -> dict | None:
        m = NAME.fullmatch(name)
        return {c: v if c == "source" else int(v) for c, v in m.groupdict().items()} if m else None

    def wanted(self, facts: dict) -> bool:
        if self.window:
            row, col, height, width = self.window
            if not (facts["row_off"] < row + height and facts["row_off"] + facts["h"] > row and facts["col_off"] < col + width and facts["col_off"] + facts["w"] > col):
                return False
        return super().wanted(facts)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, folder = opened(self.path)
        for name, facts in partition.files:
            top, left, bottom, right = facts["row_off"], facts["col_off"], facts["row_off"] + facts["h"], facts["col_off"] + facts["w"]
            if self.window:
                row, col, height, width = self.window
                top, left, bottom, right = max(top, row), max(left, col), min(bottom, row + height), min(right, col + width)
            out = facts | {"row_off": top, "col_off": left, "h": bottom - top, "w": right - left}
            if "values" in self.names:
                array = np.load(self.content(system, folder, name), allow_pickle=False)
                if array.shape != (facts["h"], facts["w"]):
                    raise ValueError(f"{name} holds an array of shape {array.shape}")
                out["values"] = array[top - facts["row_off"] : bottom - facts["row_off"], left - facts["col_off"] : right - facts["col_off"]].astype(float).ravel().tolist()
            yield tuple(out[c] for c in self.names)


class ChipReader(FileReader):
    suffix = ".npz"

    def read(self, partition: Files) -> Iterator[tuple]:
        system, folder = opened(self.path)
        for name, facts in partition.files:
            out = dict(facts)
            if self.names != ["path"]:
                with np.load(self.content(system, folder, name), allow_pickle=False) as arrays:
                    if set(arrays.files) != {"image", "label"}:
                        raise ValueError(f"{name} holds {sorted(arrays.files)}")
                    # a member of the archive is decompressed only when it is asked for
                    label = arrays["label"]
                    out |= {"h": label.shape[0], "w": label.shape[1], "label": label.ravel().tolist() if "label" in self.names else None}
                    if {"image", "b"} & set(self.names):
                        image = arrays["image"]
                        if image.ndim != 3 or image.shape[:2] != label.shape:
                            raise ValueError(f"{name} has the shapes {image.shape} and {label.shape}")
                        out |= {"b": image.shape[2], "image": image.ravel().tolist()}
            yield tuple(out[c] for c in self.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FileWriter(DataSourceWriter):
    """Each task writes its rows' files; they are cleared again if the job fails, and _SUCCESS comes last."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]

    def encoded(self, row) -> tuple[str, bytes]:
        raise NotImplementedError

    def write(self, rows: Iterator) -> Written:
        system, folder = opened(self.path)
        names = []
        for row in rows:
            name, content = self.encoded(row)
            system.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write(content)
            names.append(name)
        return Written(names)

    def commit(self, messages: list) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_SUCCESS") as f:
            f.write(b"")

    def abort(self, messages: list) -> None:
        system, folder = opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{folder}/{name}")


class BlockWriter(FileWriter):
    def encoded(self, row) -> tuple[str, bytes]:
        held = io.BytesIO()
        np.save(held, np.asarray(row["values"], float).reshape(row["h"], row["w"]))
        return f"{row['source']}__b{row['band']}_r{row['row_off']}_c{row['col_off']}_h{row['h']}_w{row['w']}.npy", held.getvalue()


class ChipWriter(FileWriter):
    def encoded(self, row) -> tuple[str, bytes]:
        held = io.BytesIO()
        np.savez_compressed(held, image=np.asarray(row["image"], np.int32).reshape(row["h"], row["w"], row["b"]), label=np.asarray(row["label"], np.int32).reshape(row["h"], row["w"]))
        return f"{row['path']}.npz", held.getvalue()


class RasterBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterblocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BlockWriter(self.options, overwrite)


class RasterChips(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterchips"

    def schema(self) -> str:
        return CHIPS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChipReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ChipWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (RasterBlocks, RasterChips):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def fields(schema: str, columns: tuple[str, ...] | None) -> str:
    kinds = dict(f.split(" ") for f in schema.split(", "))
    return ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)


def read_block_files(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Blocks of a folder, cut to the window (row, col, height, width). Without `values` among the columns no file is
    opened; files outside the window, and those that filters on the other columns exclude, never are."""
    register(spark)
    reader = spark.read.format("rasterblocks").schema(fields(BLOCKS, columns))
    return (reader.option("window", ",".join(map(str, window))) if window else reader).load(path)


def read_chip_files(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    register(spark)
    return spark.read.format("rasterchips").schema(fields(CHIPS, columns)).load(path)


def write_files(df: DataFrame, kind: str, path: str) -> None:
    """kind: rasterblocks or rasterchips."""
    register(df.sparkSession)
    schema = BLOCKS if kind == "rasterblocks" else CHIPS
    df.selectExpr(*[f"CAST({f.split(' ')[0]} AS {f.split(' ')[1]}) AS {f.split(' ')[0]}" for f in schema.split(", ")]).write.format(kind).mode("append").save(path)
