"""Rasters as blocks of arrays: overlap sums, halos, grid alignment and window cuts that shuffle pieces, never pixels.

A block is a row: the keys of its source, block_row and block_col, row_off and col_off (its corner in the source), h and w,
and one array for each layer, row-major. What an operator needs of a block is cut out as rectangular pieces where the
block lies, dealt by their target, and pasted there once; a task holds one target at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import IGNORE
from .grid import explode_pixels

#: Rows and columns of a block.
BLOCK = 256
#: Elements of arrays that a batch of rows goes on with: what a task's Python holds doesn't grow with its rows.
CHUNK = 1 << 16
#: Columns that place a block, and those that place a piece in its target.
PLACE = ("block_row", "block_col", "row_off", "col_off", "h", "w")
PIECE = ("target_row", "target_col", "at_row", "at_col", "h", "w")
ELEMENT = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


class Piece(NamedTuple):
    """Where a piece goes in its target, and its layers as (h, w) arrays."""

    row: int
    col: int
    layers: list[np.ndarray]


def layer(column: pa.Array, k: int, h: int, w: int) -> np.ndarray:
    """The array of row k as (h, w) numbers; nulls are NaN, so whole numbers come as doubles where some are null."""
    return column[k].values.to_numpy(zero_copy_only=False).reshape(h, w)


def listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as a list column of `kind` elements; NaN becomes null."""
    flat = np.concatenate([a.ravel() for a in arrays]) if arrays else np.zeros(0)
    gone = np.isnan(flat) if flat.dtype.kind == "f" else np.zeros(len(flat), bool)
    offsets = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.where(gone, 0, flat), kind, mask=gone))


def element(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.elementType.simpleString()


def cut(df: DataFrame, keys: list[str], layers: list[str], pieces_of: Callable[[dict], Iterator[tuple]], carried: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of the blocks (or tiles) of df: keys, PIECE, the numbers `carried` along, and layers.

    pieces_of takes a row's numbers by name (PLACE, where df has them, and carried) and yields (target_row, target_col, top,
    left, height, width, at_row, at_col): a rectangle of the row's arrays, and its place in the target.
    """
    numbers = [*[c for c in PLACE if c in df.columns], *carried]
    kinds = [ELEMENT[element(df, c)] for c in layers]
    given = df.select(*keys, *numbers, *layers)
    schema = ", ".join([f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keys] + [f"{c} int" for c in PIECE] + [f"`{c}` {given.schema[c].dataType.simpleString()}" for c in (*carried, *layers)])

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            rows, places, found, elements = [], [], [[] for _ in layers], 0

            def cut_out():
                picked = pa.array(rows, pa.int64())
                cols = [col[c].take(picked) for c in keys] + [pa.array(c, pa.int32()) for c in (zip(*places, strict=True) if places else [()] * len(PIECE))]
                cols += [col[c].take(picked) for c in carried]
                return pa.record_batch([*cols, *map(listed, found, kinds)], names=[*keys, *PIECE, *carried, *layers])

            for k, values in enumerate(zip(*[col[c].to_pylist() for c in numbers], strict=True)):
                row, own = dict(zip(numbers, values, strict=True)), None
                for target_row, target_col, top, left, height, width, at_row, at_col in pieces_of(row):
                    own = own or [layer(col[c], k, row["h"], row["w"]) for c in layers]
                    rows.append(k)
                    places.append((target_row, target_col, at_row, at_col, height, width))
                    for out, array in zip(found, own, strict=True):
                        out.append(array[top : top + height, left : left + width])
                    elements += height * width
                    if elements >= CHUNK:
                        yield cut_out()
                        rows, places, found, elements = [], [], [[] for _ in layers], 0
            yield cut_out()

    return given.mapInArrow(cutter, schema)


def pasted(pieces: DataFrame, keys: list[str], layers: list[str], out: dict[str, str], finish: Callable[..., dict | None], carried: tuple[str, ...] = ()) -> DataFrame:
    """Brings the pieces of each target together. finish(target_row, target_col, pieces, *carried) gives the columns `out`
    (name and type), or None; pieces come one at a time, in the order of their places."""
    n = len(keys)
    schema = ", ".join([f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in keys] + [f"`{c}` {t}" for c, t in out.items()])
    kinds = {c: ELEMENT[t.removeprefix("array<").removesuffix(">")] for c, t in out.items()}
    target, count = [*keys, "target_row", "target_col"], int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select(*target, *PIECE[2:], *carried, *layers).repartition(count, *target).sortWithinPartitions(*target, *PIECE[2:])

    def paste(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch, k) for batch in batches for k in range(batch.num_rows))
        name = lambda b, k: tuple(b.column(i)[k].as_py() for i in range(n + 2))
        held, done, elements = next(rows, None), [], 0
        joined = lambda: pa.record_batch([pa.concat_arrays(c) for c in zip(*done, strict=True)], names=[*keys, *out])
        while held:
            first, here = held, name(*held)

            def mine():
                nonlocal held
                while held and name(*held) == here:
                    batch, k = held
                    row, col, h, w = (batch.column(i)[k].as_py() for i in range(n + 2, n + 6))
                    yield Piece(row, col, [layer(batch.column(n + 6 + len(carried) + i), k, h, w) for i in range(len(layers))])
                    held = next(rows, None)

            found = mine()
            got = finish(here[n], here[n + 1], found, *[first[0].column(n + 6 + i)[first[1]].as_py() for i in range(len(carried))])
            for _ in found:  # what finish has left
                pass
            if got is not None:
                cols = [first[0].column(i).slice(first[1], 1) for i in range(n)]
                cols += [listed([got[c]], kinds[c]) if t.startswith("array") else pa.array([got[c]], kinds[c]) for c, t in out.items()]
                done.append(cols)
                elements += max(np.size(v) for v in got.values())
                if elements >= CHUNK:
                    yield joined()
                    done, elements = [], 0
        if done:
            yield joined()

    return dealt.mapInArrow(paste, schema)


def block_numbers(row: int, col: int, size: int, h: int, w: int) -> dict[str, int]:
    return dict(zip(PLACE, (row, col, row * size, col * size, h, w), strict=True))


INTS = dict.fromkeys(PLACE, "int")


def to_blocks(size: int) -> Callable[[dict], Iterator[tuple]]:
    """A tile cut at the borders of blocks of `size`."""

    def pieces_of(tile: dict) -> Iterator[tuple]:
        top, left, h, w = tile["row_off"], tile["col_off"], tile["h"], tile["w"]
        for r in range(top // size, (top + h - 1) // size + 1 if h else 0):
            for c in range(left // size, (left + w - 1) // size + 1 if w else 0):
                y, x = max(top, r * size), max(left, c * size)
                yield r, c, y - top, x - left, min(top + h, (r + 1) * size) - y, min(left + w, (c + 1) * size) - x, y - r * size, x - c * size

    return pieces_of


def reconstruct_blocks(tiles: DataFrame, keys: list[str], threshold: float = 0.5, size: int = BLOCK) -> DataFrame:
    """tiles: keys, row_off, col_off, h, w, probability, label (arrays) -> blocks with the layers probability (mean over
    the tiles, null where none lies), coverage, label (the one that isn't ignored), conflict (two such labels differ), mask.

    Tiles are cut at block borders; sums, counts and labels of a block add up piece by piece.
    """
    source = tiles.select(*keys, "row_off", "col_off", "h", "w", F.col("probability").cast("array<double>").alias("probability"), F.col("label").cast("array<int>").alias("label"))

    def add_up(row: int, col: int, pieces: Iterator[Piece]) -> dict:
        # sums, numbers of probabilities and of tiles, least and greatest label; they grow with what the pieces cover
        fills = (0.0, 0, 0, np.inf, -np.inf)
        held = [np.full((0, 0), fill) for fill in fills]
        height = width = 0
        for piece in pieces:
            p, label = piece.layers
            h, w = p.shape
            rows, cols = held[0].shape
            if piece.row + h > rows or piece.col + w > cols:
                rows, cols = (n if least <= n else min(size, max(least, 2 * n)) for n, least in ((rows, piece.row + h), (cols, piece.col + w)))
                for k, fill in enumerate(fills):
                    wider = np.full((rows, cols), fill, held[k].dtype)
                    wider[: held[k].shape[0], : held[k].shape[1]] = held[k]
                    held[k] = wider
            total, known, count, low, high = held
            at = np.s_[piece.row : piece.row + h, piece.col : piece.col + w]
            some = ~np.isnan(p)
            total[at] += np.where(some, p, 0)
            known[at] += some
            count[at] += 1
            real = (label != IGNORE) & ~np.isnan(label)
            low[at], high[at] = np.minimum(low[at], np.where(real, label, np.inf)), np.maximum(high[at], np.where(real, label, -np.inf))
            height, width = max(height, piece.row + h), max(width, piece.col + w)
        total, known, count, low, high = held
        here = np.s_[:height, :width]
        mean = np.where(known[here] > 0, total[here] / np.maximum(known[here], 1), np.nan)
        labelled = np.isfinite(high[here])
        gone = count[here] == 0
        return block_numbers(row, col, size, height, width) | {
            "probability": mean, "coverage": count[here], "label": np.where(gone, np.nan, np.where(labelled, high[here], IGNORE)),
            "conflict": labelled & (low[here] != high[here]), "mask": np.where(np.isnan(mean), np.nan, mean >= threshold),
        }

    out = INTS | {"probability": "array<double>", "coverage": "array<int>", "label": "array<int>", "conflict": "array<boolean>", "mask": "array<int>"}
    return pasted(cut(source, keys, ["probability", "label"], to_blocks(size)), keys, ["probability", "label"], out, add_up)


def block_pixels(blocks: DataFrame, keys: list[str], *layers: str) -> DataFrame:
    """A row for each pixel that a block covers: keys, row, col and the layers."""
    given = blocks.select(*keys, "row_off", "col_off", "w", *{*layers, "coverage"})
    return explode_pixels(given, *{*layers, "coverage"}).where("coverage > 0").select(*keys, "row", "col", *layers)


def gathered(cells: DataFrame, keys: list[str], layers: list[str], size: int = BLOCK) -> DataFrame:
    """Rows of pixels (keys, row, col, layers) as blocks with the layers and coverage (1 where a row was)."""
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    numbers = {"row": F.col("row").cast("int"), "col": F.col("col").cast("int")}
    given = cells.select(*keys, block("row").alias("block_row"), block("col").alias("block_col"), F.struct(*[c.alias(n) for n, c in numbers.items()], *layers).alias("cell"))
    sets = given.groupBy(*keys, "block_row", "block_col").agg(F.collect_list("cell").alias("cells"))  # size * size at most
    types = {c: cells.schema[c].dataType.simpleString() for c in layers}
    n, out = len(keys), INTS | {c: f"array<{t}>" for c, t in types.items()} | {"coverage": "array<int>"}
    schema = ", ".join([f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in keys] + [f"`{c}` {t}" for c, t in out.items()])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at_row, at_col = batch.column(n)[k].as_py(), batch.column(n + 1)[k].as_py()
                own = batch.column(n + 2)[k].values
                r, c = np.asarray(own.field("row")) - at_row * size, np.asarray(own.field("col")) - at_col * size
                h, w = int(r.max()) + 1, int(c.max()) + 1
                cols = [batch.column(i).slice(k, 1) for i in range(n)] + [pa.array([v], pa.int32()) for v in block_numbers(at_row, at_col, size, h, w).values()]
                for name, t in types.items():
                    full = np.full((h, w), np.nan)
                    full[r, c] = own.field(name).to_numpy(zero_copy_only=False)
                    cols.append(listed([full], ELEMENT[t]))
                cover = np.zeros((h, w), np.int32)
                cover[r, c] = 1
                yield pa.record_batch([*cols, listed([cover], pa.int32())], names=[*keys, *out])

    return sets.mapInArrow(fill, schema)


def with_halo(size: int, edge: int = 1) -> Callable[[dict], Iterator[tuple]]:
    """A block to itself, and only its border rows and columns to its eight neighbours. Places are moved by `edge`, so a
    target's array begins with its halo."""

    def pieces_of(block: dict) -> Iterator[tuple]:
        h, w = block["h"], block["w"]
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                # a neighbour above needs the first rows, one below the last ones of a block that is full
                top, height = (0, min(edge, h)) if dr < 0 else (0, h) if dr == 0 else (size - edge, h - (size - edge))
                left, width = (0, min(edge, w)) if dc < 0 else (0, w) if dc == 0 else (size - edge, w - (size - edge))
                if height > 0 and width > 0 and block["block_row"] + dr >= 0 and block["block_col"] + dc >= 0:
                    yield block["block_row"] + dr, block["block_col"] + dc, top, left, height, width, top + edge - dr * size, left + edge - dc * size

    return pieces_of


def slope_blocks(blocks: DataFrame, keys: list[str], value: str, cell_size: float = 1.0, size: int = BLOCK) -> DataFrame:
    """Blocks (value, coverage) -> blocks with slope, in degrees from the 3 x 3 neighbourhood, and coverage; slope is null
    where a neighbour is null or lacks. What is shuffled beside the blocks grows with their borders."""
    source = blocks.select(*keys, *PLACE, F.col(value).cast("array<double>").alias("value"), F.col("coverage").cast("array<int>").alias("coverage"))

    def tilt(row: int, col: int, pieces: Iterator[Piece]) -> dict | None:
        full, own = np.full((size + 2, size + 2), np.nan), None
        for piece in pieces:
            z, cover = piece.layers
            h, w = z.shape
            full[piece.row : piece.row + h, piece.col : piece.col + w] = np.where(cover > 0, z, np.nan)
            if piece.row == piece.col == 1 and (own is None or cover.size > own.size):
                own = cover
        if own is None:  # a halo whose block doesn't exist
            return None
        h, w = own.shape
        z = full[: h + 2, : w + 2]
        x = (z[:-2, 2:] + 2 * z[1:-1, 2:] + z[2:, 2:]) - (z[:-2, :-2] + 2 * z[1:-1, :-2] + z[2:, :-2])
        y = (z[2:, :-2] + 2 * z[2:, 1:-1] + z[2:, 2:]) - (z[:-2, :-2] + 2 * z[:-2, 1:-1] + z[:-2, 2:])
        angle = np.degrees(np.arctan(np.sqrt((x / (8 * cell_size)) ** 2 + (y / (8 * cell_size)) ** 2)))
        return block_numbers(row, col, size, h, w) | {"slope": np.where((own > 0) & ~np.isnan(z[1:-1, 1:-1]), angle, np.nan), "coverage": own}

    layers = ["value", "coverage"]
    return pasted(cut(source, keys, layers, with_halo(size)), keys, layers, INTS | {"slope": "array<double>", "coverage": "array<int>"}, tilt)


#: Columns of an alignment: the target's size, where its first pixel's corner lies and its pixels' size, and the source's
#: origin and pixel size, each by column (x) and row (y).
GRID = ("t_height", "t_width", "x0", "dx", "y0", "dy", "origin_x", "pixel_x", "origin_y", "pixel_y")


def aligned_blocks(blocks: DataFrame, rasters: DataFrame, keys: list[str], value: str, bilinear: bool = False, size: int = BLOCK) -> DataFrame:
    """blocks of sources, and rasters (keys and GRID) that they are aligned to -> blocks of the rasters with value (null
    outside the source) and coverage (1 in all of a raster's pixels).

    Nearest takes the source pixel that holds the target pixel's centre; bilinear weighs the four source pixels around it
    by distance, and those that lack give their weight to the others. A source block sends a target block only the
    rectangle that it reads.
    """
    reach = 1 if bilinear else 0

    def places(n: int, first: float, step: float, origin: float, pixel: float) -> np.ndarray:
        """Where n target pixels' centres lie in the source, in pixels; for bilinear between pixels' centres."""
        return ((np.arange(n) + 0.5) * step + first - origin) / pixel - (0.5 if bilinear else 0)

    def stretches(at: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """Target blocks that read some of the source's rows (or columns) low .. high - 1, and which."""
        base = np.floor(at).astype(np.int64)
        for k in range(-(-len(at) // size)):
            own = base[k * size : (k + 1) * size]
            a, b = max(low, int(own.min())), min(high, int(own.max()) + reach + 1)
            if a < b:
                yield k, a, b

    def pieces_of(row: dict) -> Iterator[tuple]:
        x = places(int(row["t_width"]), row["x0"], row["dx"], row["origin_x"], row["pixel_x"])
        y = places(int(row["t_height"]), row["y0"], row["dy"], row["origin_y"], row["pixel_y"])
        across = list(stretches(x, row["col_off"], row["col_off"] + row["w"]))
        for r, top, bottom in stretches(y, row["row_off"], row["row_off"] + row["h"]):
            for c, left, right in across:
                yield r, c, top - row["row_off"], left - row["col_off"], bottom - top, right - left, top, left

    def read(row: int, col: int, pieces: Iterator[Piece], n_rows, n_cols, x0, dx, y0, dy, origin_x, pixel_x, origin_y, pixel_y) -> dict:
        x = places(int(n_cols), x0, dx, origin_x, pixel_x)[col * size : (col + 1) * size]
        y = places(int(n_rows), y0, dy, origin_y, pixel_y)[row * size : (row + 1) * size]
        r, c = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        top, left = int(r.min()), int(c.min())
        full = np.full((int(r.max()) - top + 1 + reach, int(c.max()) - left + 1 + reach), np.nan)  # what the block reads
        for piece in pieces:
            z = piece.layers[0]
            if z.size:
                full[piece.row - top : piece.row - top + z.shape[0], piece.col - left : piece.col - left + z.shape[1]] = z
        if not bilinear:
            out = full[np.ix_(r - top, c - left)]
        else:
            fy, fx = (y - r)[:, None], (x - c)[None, :]
            total, weight = np.zeros((len(y), len(x))), np.zeros((len(y), len(x)))
            for i in (0, 1):
                for j in (0, 1):
                    z, part = full[np.ix_(r - top + i, c - left + j)], (fy if i else 1 - fy) * (fx if j else 1 - fx)
                    total += np.where(np.isnan(z), 0, z * part)
                    weight += np.where(np.isnan(z), 0, part)
            out = np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)
        return block_numbers(row, col, size, len(y), len(x)) | {value: out, "coverage": np.ones(out.shape, np.int32)}

    numbers = [F.col(g).cast("double").alias(g) for g in GRID]
    rasters = rasters.select(*keys, *numbers)
    pieces = cut(blocks.select(*keys, *PLACE, value).join(rasters, keys), keys, [value], pieces_of, GRID)
    # every target block gets an empty piece, so those outside the source are there, too
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / size) - 1).cast("int")))
    empty = rasters.where("t_height > 0 AND t_width > 0").withColumn("target_row", every("t_height")).withColumn("target_col", every("t_width"))
    kind = element(blocks, value)
    empty = empty.withColumns({c: F.lit(0) for c in PIECE[2:]}).withColumn(value, F.array().cast(f"array<{kind}>")).select(pieces.columns)
    out = INTS | {value: f"array<{kind}>", "coverage": "array<int>"}
    return pasted(pieces.unionByName(empty), keys, [value], out, read, GRID)


def cut_windows(blocks: DataFrame, keys: list[str], layers: list[str], size: int, stride: int) -> DataFrame:
    """blocks with source_height and source_width -> chips: keys, row_off, col_off, h, w and the layers of each window of
    `size` at every `stride` that fits (one at 0 for a source that is smaller), null where no block lies.

    A block knows the windows that need it by arithmetic and sends each the rectangle they share.
    """
    extent = ("source_height", "source_width")

    def windows(low: int, n: int, dim: int) -> Iterator[tuple[int, int, int, int]]:
        """Number and offset of the windows over low .. low + n - 1, and the part they share."""
        last = max(0, (dim - size) // stride)
        for k in range(max(0, -(-(low - size + 1) // stride)), min(last, (low + n - 1) // stride) + 1):
            a, b = max(low, k * stride), min(low + n, k * stride + size, dim)
            if a < b:
                yield k, k * stride, a, b

    def pieces_of(row: dict) -> Iterator[tuple]:
        across = list(windows(row["col_off"], row["w"], int(row["source_width"])))
        for r, off_r, top, bottom in windows(row["row_off"], row["h"], int(row["source_height"])):
            for c, off_c, left, right in across:
                yield r, c, top - row["row_off"], left - row["col_off"], bottom - top, right - left, top - off_r, left - off_c

    def paste(row: int, col: int, pieces: Iterator[Piece], source_height, source_width) -> dict:
        h, w = min(size, int(source_height)), min(size, int(source_width))
        full = [np.full((h, w), np.nan) for _ in layers]
        for piece in pieces:
            for out, z in zip(full, piece.layers, strict=True):
                out[piece.row : piece.row + z.shape[0], piece.col : piece.col + z.shape[1]] = z
        return {"row_off": row * stride, "col_off": col * stride, "h": h, "w": w} | dict(zip(layers, full, strict=True))

    source = blocks.select(*keys, *PLACE, *[F.col(c).cast("double").alias(c) for c in extent], *layers)
    out = {"row_off": "int", "col_off": "int", "h": "int", "w": "int"} | {c: f"array<{element(blocks, c)}>" for c in layers}
    return pasted(cut(source, keys, layers, pieces_of, extent), keys, layers, out, paste, extent)
