"""Cells straight from chunks of a cube's payload: rows (start, chunk) of bytes, whatever their cut.

A chunk may begin and end anywhere between two cells: which cells stand in it follows from its start,
the header and the layout, in 64 bits, so chunks are worked on one by one, in any order and on any
executor. What is wrong with a chunk is a value, not a failure: a row with its start and error, and
no cell. A null start or chunk, a start in front of the cells, a start or length that cuts a cell,
and an end beyond the payload are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.envi import NUMPY, decode
from ..sources.header import Header, HeaderError
from ..sources.ranges import open_bytes
from .cube import wide_of

CELLS = "x int, y int, band int, value float, start long, error string"


def byte_chunks(spark: SparkSession, data: str, chunk_bytes: int, start: int = 0, end: int | None = None) -> DataFrame:
    """(start, chunk): the bytes of a payload from start to end (all), read by the tasks that hold them."""
    source = open_bytes(data)
    end = source.size() if end is None else end
    n = max(0, -(-(end - start) // chunk_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                a = start + i * chunk_bytes
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([source.read(a, min(end, a + chunk_bytes))], pa.binary())], names=["start", "chunk"])

    return spark.range(n).mapInArrow(run, "start long, chunk binary")


def fault(h: Header, start: int | None, chunk: bytes | None) -> str | None:
    """What is wrong with a chunk."""
    if start is None or chunk is None:
        return "no chunk"
    at, width, cells = start - h.header_offset, h.bytes_per_pixel, h.samples * h.lines * h.bands
    if at < 0:
        return f"the chunk starts {-at} bytes before the cells"
    if at % width or len(chunk) % width:
        return f"the chunk isn't cut between cells of {width} bytes"
    if at + len(chunk) > cells * width:
        return "the chunk ends beyond the payload"
    return None


def places(h: Header, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and band of cells by their number in the payload."""
    if h.interleave == "bip":
        pixel, band = np.divmod(cell, h.bands)
        y, x = np.divmod(pixel, h.samples)
    elif h.interleave == "bil":
        row, x = np.divmod(cell, h.samples)
        y, band = np.divmod(row, h.bands)
    else:
        row, x = np.divmod(cell, h.samples)
        band, y = np.divmod(row, h.lines)
    return x, y, band + 1


def numbers(h: Header, x: int, y: int) -> np.ndarray:
    """The cells of a pixel's bands by their number in the payload."""
    b = np.arange(h.bands, dtype=np.int64)
    if h.interleave == "bip":
        return (y * h.samples + x) * h.bands + b
    return (y * h.bands + b) * h.samples + x if h.interleave == "bil" else (b * h.lines + y) * h.samples + x


def chunk_cells(chunks: DataFrame, h: Header, bands: list[int] | None = None, pixel: tuple[int, int] | None = None) -> DataFrame:
    """CELLS of chunks (start, chunk): of some bands (all if None), of one pixel, or everything."""
    if h.data_type not in NUMPY:
        raise HeaderError(f"cells of type {h.data_type} can't be read")
    if bands is not None and not all(1 <= b <= h.bands for b in bands):
        raise IndexError(f"bands are between 1 and {h.bands}")
    if pixel is not None and not (0 <= pixel[0] < h.samples and 0 <= pixel[1] < h.lines):
        raise IndexError("the pixel is outside the cube")
    names = [c.split()[0] for c in CELLS.split(", ")]
    own = None if pixel is None else numbers(h, *pixel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, chunk in zip(batch.column(0), batch.column(1)):
                start, chunk = start.as_py(), chunk.as_py()
                if (error := fault(h, start, chunk)) is not None:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, None, start, error), kinds)], names=names)
                    continue
                first, n = (start - h.header_offset) // h.bytes_per_pixel, len(chunk) // h.bytes_per_pixel
                cell = np.arange(first, first + n) if own is None else own[(own >= first) & (own < first + n)]
                x, y, band = places(h, cell)
                if bands is not None:
                    keep = np.isin(band, bands)
                    cell, x, y, band = cell[keep], x[keep], y[keep], band[keep]
                value = decode(chunk, h)[cell - first]
                each = [pa.array(c.astype(np.int32)) for c in (x, y, band)]
                yield pa.RecordBatch.from_arrays([*each, pa.array(value), pa.array(np.full(len(cell), start)), pa.nulls(len(cell), pa.string())], names=names)

    return chunks.select("start", "chunk").mapInArrow(run, CELLS)


def chunk_profile(chunks: DataFrame, h: Header, x: int, y: int) -> DataFrame:
    """(band, value, start, error): a pixel's bands that stand in the chunks, and the chunks' errors."""
    return chunk_cells(chunks, h, pixel=(x, y)).select("band", "value", "start", "error")


def chunk_rgb(chunks: DataFrame, h: Header, r: int, g: int, b: int) -> DataFrame:
    """(x, y, r, g, b): three bands of the pixels in the chunks side by side; null where no chunk has the cell."""
    return wide_of(chunk_cells(chunks, h, [r, g, b]).where(F.col("error").isNull()), [r, g, b])
