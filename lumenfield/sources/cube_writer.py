"""Rows as a cube's header and payload.

    write_cube(pixels, header, "a.hdr", "a.img")

Rows are (x, y, band, value) or (x, y, spectrum). write_cube deals them by strip of lines (and band,
where bands are stored apart and rows are cells), so that a task holds one strip at a time and
writes its byte ranges itself. On a local or mounted file system all tasks write into one file, each
at its own ranges, under a temporary name that the commit renames. Where a file can't be written in
place, a payload named *.parts is a manifest of part files, one a task. The commit is the driver's:
it checks that no strip came from two tasks, drops what lost attempts left, moves the payload into
place and writes the header last. The driver gets a few numbers a strip and no cells.

Cells that no row gives, or whose value is null, are zero. A cell outside the cube, a cell given
twice, and a value that the stored type can't hold (whole types: values are rounded to the nearest,
halves to even) fail the job, and nothing is left behind.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .envi import NUMPY, TARGET, CubeDataSource, line_bytes
from .header import Header, HeaderError, parse, render
from .ranges import store_of


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its strips (first line, band or 0), its cells, and the ranges of its part file."""

    strips: list[tuple[int, int]]
    cells: int
    parts: list[tuple]


def stored(values: np.ndarray, h: Header) -> np.ndarray:
    """Values in the cube's type and byte order."""
    kind = np.dtype(NUMPY[h.data_type])
    if kind.kind in "iu":
        v, info = np.rint(values), np.iinfo(kind)
        # the upper bound as a power of two: a double can't hold the greatest 64-bit integer
        if not np.isfinite(v).all() or (v < float(info.min)).any() or (v >= 2.0 ** (8 * kind.itemsize - (kind.kind == "i"))).any():
            raise ValueError(f"a value doesn't fit in {h.data_type}")
        values = v
    with np.errstate(over="ignore"):
        out = values.astype(kind)
    if kind.kind == "f" and (np.isinf(out) & np.isfinite(values)).any():
        raise ValueError(f"a value doesn't fit in {h.data_type}")
    return out.astype(kind.newbyteorder("<" if h.byte_order == "lsb" else ">"))


class CubeWriter(DataSourceArrowWriter):
    def __init__(self, options, names: list[str], overwrite: bool) -> None:
        for name in ("header", "data", "text"):
            if not options.get(name):
                raise ValueError(f"writing a cube takes the option {name}")
        self.h = parse(options["text"])
        if self.h.data_type not in NUMPY:
            raise HeaderError(f"cells of type {self.h.data_type} can't be written")
        self.head, self.data, self.text = options["header"], options["data"], options["text"]
        self.wide = "spectrum" in names
        self.columns = ["x", "y", "spectrum"] if self.wide else ["x", "y", "band", "value"]
        if missing := set(self.columns) - set(names):
            raise ValueError(f"a cube's rows have the columns {', '.join(self.columns)}; there is no {', '.join(sorted(missing))}")
        self.apart = self.h.interleave == "bsq" and not self.wide
        self.lines = int(options.get("strip_lines") or strip_lines(self.h))
        self.in_parts = self.data.endswith(".parts")
        store, inside = store_of(self.data)
        if not self.in_parts and not isinstance(store, fs.LocalFileSystem):
            raise ValueError("a payload is written in place on a local or mounted file system; elsewhere name it *.parts")
        if not overwrite and store.get_file_info(inside).type != fs.FileType.NotFound:
            raise FileExistsError(self.data)
        self.job = f"{self.data}.{uuid.uuid4().hex}"
        # made here and not by the tasks: a task that runs on after an abort finds no place to write to
        store, inside = store_of(self.job)
        store.create_dir(inside) if self.in_parts else store.open_output_stream(inside).close()

    # -- on the executors ------------------------------------------------------------------------

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        made = Written([], 0, [])
        out = None
        if self.in_parts:
            store, inside = store_of(f"{self.job}/{uuid.uuid4().hex}")
            name = f"{self.job.rpartition('/')[2]}/{inside.rpartition('/')[2]}"
            out = store.open_output_stream(inside)
        else:
            out = os.open(store_of(self.job)[1], os.O_RDWR)
        try:
            for strip, cells, given in self.strips(batches):
                made.strips.append(strip)
                made.cells += int(given)
                raw, start, step = self.laid_out(strip, cells)
                if self.in_parts:
                    made.parts.append((name, out.tell(), start, len(raw[0]), step, len(raw)))
                    for r in raw:
                        out.write(r)
                else:
                    for i, r in enumerate(raw):
                        at = start + i * step
                        while r:  # a write may be cut short
                            n = os.pwrite(out, r, at)
                            r, at = r[n:], at + n
        finally:
            out.close() if self.in_parts else os.close(out)
        return made

    def strips(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, int]]:
        """(first line, band or 0), cells as (line, band, sample), and how many were given, of one strip after another."""
        h, current, cells, seen = self.h, None, None, None
        done = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            inside = (x >= 0) & (x < h.samples) & (y >= 0) & (y < h.lines)
            band = np.zeros(len(x), np.int64) if self.wide else batch.column("band").to_numpy(zero_copy_only=False)
            if not inside.all() or not self.wide and not ((band >= 1) & (band <= h.bands)).all():
                raise ValueError("a cell is outside the cube")
            values, there = self.values(batch)
            x, y, band = x.astype(np.int64), y.astype(np.int64), band.astype(np.int64)
            first, own = y // self.lines * self.lines, band if self.apart else np.zeros_like(band)
            cut = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (own[1:] != own[:-1]), [True]]))
            for a, b in zip(cut, cut[1:]):
                key = (int(first[a]), int(own[a]))
                if key != current:
                    if current is not None:
                        yield current, cells, seen.sum()
                    if key in done:
                        raise ValueError("a strip's rows don't stand together: write with write_cube")
                    done.add(key)
                    current, n = key, min(self.lines, h.lines - key[0])
                    shape = (n, 1 if self.apart else h.bands, h.samples)
                    cells, seen = np.zeros(shape), np.zeros(shape, bool)
                i = slice(a, b)
                at = (y[i] - current[0], slice(None), x[i]) if self.wide else (y[i] - current[0], np.zeros(b - a, np.int64) if self.apart else band[i] - 1, x[i])
                place = (np.ravel_multi_index((at[0], at[2]), (len(cells), h.samples)) if self.wide else np.ravel_multi_index(at, cells.shape))
                if len(np.unique(place)) < b - a or (seen[at] & there[i]).any():
                    raise ValueError("a cell is given twice")
                cells[at] = np.where(there[i], values[i], cells[at])
                seen[at] |= there[i]
        if current is not None:
            yield current, cells, seen.sum()

    def values(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Values in double precision, a row each, and where they aren't null."""
        if not self.wide:
            c = batch.column("value")
            return c.to_numpy(zero_copy_only=False).astype(np.float64), c.is_valid().to_numpy(zero_copy_only=False)
        lists = batch.column("spectrum")
        if lists.null_count or (lists.value_lengths().to_numpy(zero_copy_only=False) != self.h.bands).any():
            raise ValueError(f"a spectrum has {self.h.bands} bands")
        c = lists.flatten()
        shape = (-1, self.h.bands)
        return c.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape), c.is_valid().to_numpy(zero_copy_only=False).reshape(shape)

    def laid_out(self, strip: tuple[int, int], cells: np.ndarray) -> tuple[list[bytes], int, int]:
        """The strip's byte ranges, the first one's start and their distance."""
        h, line = self.h, line_bytes(self.h)
        v = stored(cells, h)
        if h.interleave == "bsq":
            start = h.header_offset + (max(strip[1] - 1, 0) * h.lines + strip[0]) * line
            return [v[:, b].tobytes() for b in range(v.shape[1])], start, h.lines * line
        return [(v if h.interleave == "bil" else v.transpose(0, 2, 1)).tobytes()], h.header_offset + strip[0] * line, line * len(v)

    # -- on the driver ---------------------------------------------------------------------------

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        strips = [s for m in done for s in m.strips]
        if len(set(strips)) < len(strips):
            self.abort(messages)
            raise ValueError("two tasks wrote a strip: write with write_cube")
        size = self.h.header_offset + self.h.lines * line_bytes(self.h) * (self.h.bands if self.h.interleave == "bsq" else 1)
        store, inside = store_of(self.data)
        before = self.part_folders()
        if self.in_parts:
            used = {p[0].rpartition("/")[2] for m in done for p in m.parts}
            folder = store_of(self.job)[1]
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.base_name not in used:
                    store.delete_file(f.path)
            put(self.data, json.dumps({"size": size, "parts": [p for m in done for p in m.parts]}).encode())
        else:
            own = store_of(self.job)[1]
            os.truncate(own, size)
            os.replace(own, inside)
        put(self.head, self.text.encode())
        for folder in before:
            store.delete_dir(folder)

    def part_folders(self) -> list[str]:
        """Folders of parts of what stood here before."""
        store, inside = store_of(self.data)
        folder, _, name = inside.rpartition("/")
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if self.in_parts else []
        return [f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{name}.") and f.base_name != self.job.rpartition("/")[2]]

    def abort(self, messages: list[Written | None]) -> None:
        store, own = store_of(self.job)
        kind = store.get_file_info(own).type
        if kind == fs.FileType.Directory:
            store.delete_dir(own)
        elif kind == fs.FileType.File:
            store.delete_file(own)


def put(place: str, raw: bytes) -> None:
    """A small file at once."""
    store, inside = store_of(place)
    beside = f"{inside}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as f:
        f.write(raw)
    store.move(beside, inside)


def strip_lines(h: Header) -> int:
    """Lines that a task holds at once: of all bands, unless bands are stored apart and rows are cells."""
    return max(1, TARGET // line_bytes(h))


def write_cube(rows: DataFrame, h: Header, head: str, data: str, lines: int | None = None) -> None:
    """rows (x, y, band, value) or (x, y, spectrum) as files; `lines`: lines of a strip."""
    spark = rows.sparkSession
    spark.dataSource.register(CubeDataSource)
    wide = "spectrum" in rows.columns
    per_strip = max(1, TARGET // (line_bytes(h) * (h.bands if wide and h.interleave == "bsq" else 1)))
    lines = lines or per_strip
    keys = [F.expr(f"y div {lines}")] + ([F.col("band")] if h.interleave == "bsq" and not wide else [])
    own = rows.select(*(["x", "y", "spectrum"] if wide else ["x", "y", "band", "value"]))
    store, inside = store_of(data)
    store.create_dir(inside.rpartition("/")[0])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.repartition(n, *keys).sortWithinPartitions(*keys).write.format("cube").options(header=head, data=data, text=render(h), strip_lines=str(lines)).mode("overwrite").save()
