"""The cube data source: header and binary payload as rows (x, y, band, value), and such rows as files.

    spark.dataSource.register(CubeDataSource)
    spark.read.format("cube").option("header", "a.hdr").option("data", "a.img").load()

Options: header, data (paths on a file system that executors see, or http urls), bands (numbers to
read, comma-separated), y0 and y1 (lines to read, y1 exclusive), strip_lines (lines read at once),
http.* (request headers), mode ("permissive": what can't be read gives a row with its error instead
of failing the job). The header is read once, on the driver. A strip is some lines of one band where
bands are stored apart (bsq), of all bands otherwise. Strips are packed into tasks of TARGET bytes,
a read counting COST bytes more, and a task reads over gaps of GAP bytes: a pixel of many bands is a
few tasks and not one a band. What to read is told by options and not by pushed filters: Spark keeps
a reader for all queries on a frame, so a reader changed by one query's filters would leave rows out
of the next.

Writing is in cube_writer.
"""

from __future__ import annotations

import http.client
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .header import Header, HeaderError, parse
from .ranges import Bytes, HttpBytes, joined, open_bytes, packed

NUMPY = {"u8": "u1", "i16": "i2", "i32": "i4", "f32": "f4", "f64": "f8", "u16": "u2", "u32": "u4", "i64": "i8", "u64": "u8"}
BATCH_CELLS = 1 << 20
#: Bytes of a strip and of a task, what a read costs in bytes, and the gap that one read goes over.
TARGET, COST, GAP = 32 << 20, 1 << 16, 1 << 16


@dataclass
class Strip:
    """Lines y0..y1 of one band, or of all bands (band None)."""

    y0: int
    y1: int
    band: int | None
    start: int
    end: int


@dataclass
class Strips(InputPartition):
    """What one task reads."""

    strips: list[Strip]


def decode(raw: bytes, h: Header) -> np.ndarray:
    """Cells as single-precision numbers, whatever their stored type."""
    if h.data_type not in NUMPY:
        raise HeaderError(f"cells of type {h.data_type} can't be read")
    return np.frombuffer(raw, np.dtype(NUMPY[h.data_type]).newbyteorder("<" if h.byte_order == "lsb" else ">")).astype(np.float32)


def strip_cells(raw: bytes, h: Header, s: Strip, bands: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, y, band and value of a strip's cells, for the bands asked for."""
    n = s.y1 - s.y0
    v = decode(raw, h)
    if s.band is not None:
        cube, numbers = v.reshape(n, 1, h.samples), np.array([s.band], np.int32)
    else:
        cube = v.reshape(n, h.bands, h.samples) if h.interleave == "bil" else v.reshape(n, h.samples, h.bands).transpose(0, 2, 1)
        cube, numbers = cube[:, bands - 1], bands
    y, b, x = np.broadcast_arrays(np.arange(s.y0, s.y1, dtype=np.int32)[:, None, None], numbers.astype(np.int32)[None, :, None], np.arange(h.samples, dtype=np.int32))
    return x.ravel(), y.ravel(), b.ravel(), np.ascontiguousarray(cube).ravel()


def line_bytes(h: Header) -> int:
    """Bytes of a line: of one band where bands are stored apart, of all otherwise."""
    return h.samples * h.bytes_per_pixel * (1 if h.interleave == "bsq" else h.bands)


class CubeReader(DataSourceReader):
    def __init__(self, h: Header, source: Bytes, bands: list[int] | None, strip_lines: int | None, y: tuple[int, int] | None = None, permissive: bool = False) -> None:
        self.h, self.source, self.permissive = h, source, permissive
        self.bands = sorted(set(bands)) if bands else list(range(1, h.bands + 1))
        if not all(1 <= b <= h.bands for b in self.bands):
            raise ValueError(f"bands must be between 1 and {h.bands}")
        self.strip_lines = strip_lines
        low, high = y or (0, h.lines)
        self.y = (max(0, low), min(high, h.lines))

    def strips(self) -> list[Strip]:
        h, line = self.h, line_bytes(self.h)
        apart = h.interleave == "bsq"
        lines = self.strip_lines or max(1, TARGET // line)
        out = []
        for band in self.bands if apart else [None] * bool(self.bands):
            base = h.header_offset + (0 if band is None else (band - 1) * h.lines * line)
            for y0 in range(self.y[0], self.y[1], lines):
                y1 = min(self.y[1], y0 + lines)
                out.append(Strip(y0, y1, band, base + y0 * line, base + y1 * line))
        return out

    def partitions(self) -> list[Strips]:
        own = self.strips()
        return [Strips([own[i] for i in group]) for group in packed([s.end - s.start + COST for s in own], TARGET + COST)] or [Strips([])]

    def raw(self, strips: list[Strip]) -> Iterator[tuple[Strip, bytes | Exception]]:
        """Each strip's bytes, or why there are none."""
        for group in joined([(s.start, s.end) for s in strips], GAP):
            own = [strips[i] for i in group]
            start, end = own[0].start, max(s.end for s in own)
            if not self.permissive or len(own) == 1:
                try:
                    raw = self.source.read(start, end)
                except (OSError, ValueError, http.client.HTTPException) as e:
                    if not self.permissive:
                        raise
                    yield own[0], e
                    continue
                yield from ((s, raw[s.start - start : s.end - start]) for s in own)
                continue
            try:
                raw = self.source.read(start, end)
            except (OSError, ValueError, http.client.HTTPException):
                for s in own:  # one by one: only what is broken is lost
                    yield from self.raw([s])
            else:
                yield from ((s, raw[s.start - start : s.end - start]) for s in own)

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        names = ["x", "y", "band", "value"] + ["error"] * self.permissive
        for strip, raw in self.raw(partition.strips):
            if isinstance(raw, Exception):
                row = (None, strip.y0, strip.band, None, f"{type(raw).__name__}: {raw}")
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)
                continue
            cells = strip_cells(raw, self.h, strip, np.array(self.bands))
            for at in range(0, len(cells[0]), BATCH_CELLS):
                part = [pa.array(c[at : at + BATCH_CELLS]) for c in cells]
                yield pa.RecordBatch.from_arrays(part + [pa.nulls(len(part[0]), pa.string())] * self.permissive, names=names)


class CubeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cube"

    def permissive(self) -> bool:
        mode = (self.options.get("mode") or "failfast").lower()
        if mode not in ("permissive", "failfast"):
            raise ValueError(f"mode is permissive or failfast, not {mode}")
        return mode == "permissive"

    def schema(self) -> str:
        return "x int, y int, band int, value float" + ", error string" * self.permissive()

    def reader(self, schema) -> CubeReader:
        o = self.options
        http = {k.removeprefix("http."): v for k, v in o.items() if k.startswith("http.")}
        for name in ("header", "data"):
            if not o.get(name):
                raise ValueError(f"the cube source takes the option {name}")
        head = open_bytes(o["header"], http)
        h = parse(head.read_all().decode("utf-8", "replace"))
        if h.data_type not in NUMPY:
            raise HeaderError(f"cells of type {h.data_type} can't be read")
        source = open_bytes(o["data"], http)
        if isinstance(source, HttpBytes):
            source = HttpBytes(source.url, source.headers, source.size())
        bands = [int(b) for b in o["bands"].split(",")] if o.get("bands") else None
        y = (int(o.get("y0") or 0), int(o["y1"]) if o.get("y1") else h.lines)
        return CubeReader(h, source, bands, int(o["strip_lines"]) if o.get("strip_lines") else None, y, self.permissive())

    def writer(self, schema, overwrite: bool):
        from .cube_writer import CubeWriter

        return CubeWriter(self.options, schema.names, overwrite)
