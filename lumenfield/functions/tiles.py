"""Tile grid, tile of a pixel, byte offsets, and the fixed sample of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 512
#: Tiles that statistics are sampled from, and for a first view.
SAMPLED, SAMPLED_FIRST = 5, 2


def grid(samples: int, lines: int, size: int = TILE) -> tuple[int, int]:
    """Columns and rows of tiles."""
    if any(not isinstance(v, int) or isinstance(v, bool) or v < 1 for v in (samples, lines, size)):
        raise TypeError("dimensions and tile size must be positive integers")
    return -(-samples // size), -(-lines // size)


def tile_of(x: Column, y: Column, size: int = TILE) -> tuple[Column, Column]:
    return F.floor(x / size).cast("int"), F.floor(y / size).cast("int")


def clipped(t: Column, extent: Column, size: int) -> Column:
    """Width (or height) of a tile, less what stands over the edge; 0 outside."""
    return F.greatest(F.least((t + 1) * size, extent) - t * size, F.lit(0)).cast("int")


def local_index(x: Column, y: Column, samples: Column, size: int = TILE) -> Column:
    tx, _ = tile_of(x, y, size)
    return ((y % size) * clipped(tx, samples, size) + x % size).cast("long")


def cell_offset(layout: Column, x: Column, y: Column, band0: Column, samples: Column, lines: Column, bands: Column, width: Column, header: Column) -> Column:
    """Byte at which a cell stands in a file of a layout (bsq, bil or bip); band0 counts from 0. All in 64 bits."""
    s, n, b = samples.cast("long"), lines.cast("long"), bands.cast("long")
    cell = F.when(layout == "bsq", (band0 * n + y) * s + x).when(layout == "bil", (y * b + band0) * s + x).when(layout == "bip", (y * s + x) * b + band0)
    return header.cast("long") + cell * width.cast("long")


def strip_range(band0: Column, ty: Column, samples: Column, lines: Column, width: Column, header: Column, size: int) -> tuple[Column, Column]:
    """Byte range [start, end) of one band's lines under a tile row, band-sequential; null for a row outside."""
    inside = (ty >= 0) & (ty * size < lines)
    start = header.cast("long") + (band0.cast("long") * lines + ty * size) * samples * width
    end = start + clipped(ty, lines, size).cast("long") * samples * width
    return F.when(inside, start), F.when(inside, end)


def sample_tiles(samples: int, lines: int, size: int = TILE, count: int = 5) -> list[tuple[int, int]]:
    """The fixed sample: corners and middle first, quarter points next, then row by row; no tile twice."""
    columns, rows = grid(samples, lines, size)
    mx, my = columns - 1, rows - 1
    first = [(0, 0), (mx, my), (mx // 2, my // 2), (mx, 0), (0, my), (mx // 4, my // 4), (mx * 3 // 4, my * 3 // 4)]
    out: dict[tuple[int, int], None] = {}
    for tile in first:
        if len(out) < max(1, count):
            out.setdefault(tile)
    at = 0
    while len(out) < min(max(1, count), columns * rows):
        out.setdefault((at % columns, at // columns))
        at += 1
    return list(out)


def tile_grid(spark: SparkSession, samples: int, lines: int, size: int = TILE) -> DataFrame:
    """All tiles, (tx, ty, eff_w, eff_h), made on the executors."""
    columns, rows = grid(samples, lines, size)
    t = spark.range(columns * rows).select((F.col("id") % columns).cast("int").alias("tx"), F.expr(f"id div {columns}").cast("int").alias("ty"))
    return t.select("tx", "ty", clipped(F.col("tx"), F.lit(samples), size).alias("eff_w"), clipped(F.col("ty"), F.lit(lines), size).alias("eff_h"))
