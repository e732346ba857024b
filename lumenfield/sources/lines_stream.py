"""A stream of lines from files that grow: telemetry as JSON lines.

    spark.dataSource.register(LineSource)
    spark.readStream.format("growing_lines").option("path", folder).load()

Rows are (file, at, value): a line and the byte at which it starts, which together are its key. The
offset is how far each file has been read, up to the end of its last whole line: a line that is still
being written waits for its end. A file that is away for a while keeps its place as long as the
stream runs, and a stream that is stopped goes on from its checkpoint, so no line is lost or comes
twice. A file that is shorter than its place was begun anew, and is an error. Long stretches are read
by several tasks (option range_bytes): each takes the lines that start in its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .ranges import store_of

BLOCK = 1 << 16


@dataclass
class Stretch(InputPartition):
    """Lines of a file that start in [start, end), of the bytes up to `upto`."""

    file: str
    start: int
    end: int
    first: int
    upto: int


def last_line_end(f, size: int) -> int:
    """The end of the last whole line, looked for from the end."""
    end = size
    while end > 0:
        start = max(0, end - BLOCK)
        at = f.read_at(end - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


class LineStream(DataSourceStreamReader):
    def __init__(self, folder: str, range_bytes: int) -> None:
        self.folder, self.range_bytes = folder, range_bytes
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, inside = store_of(self.folder)
        for info in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                try:
                    with store.open_input_file(info.path) as f:
                        self.known[info.base_name] = max(self.known.get(info.base_name, 0), last_line_end(f, info.size))
                except OSError:  # away for now: it keeps its place, and is tried again with the next batch
                    continue
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.known = {k: max(v, end.get(k, 0), start.get(k, 0)) for k, v in (self.known | end | start).items()}
        out = []
        for file, upto in sorted(end.items()):
            for a in range(start.get(file, 0), upto, self.range_bytes):
                out.append(Stretch(file, a, min(upto, a + self.range_bytes), start.get(file, 0), upto))
        return out

    def read(self, s: Stretch) -> Iterator[pa.RecordBatch]:
        store, inside = store_of(f"{self.folder}/{s.file}")
        with store.open_input_file(inside) as f:
            if f.size() < s.upto:
                raise OSError(f"{s.file} was begun anew: it is shorter than what has been read of it")
            at, held = s.start, b""
            if s.start > s.first:  # the line that the byte before belongs to is the task's before
                at, held = s.start - 1, b""
            skip, line_at = s.start > s.first, at
            at_rows: list[int] = []
            lines: list[bytes] = []
            while line_at < s.end or skip:
                cut = held.find(b"\n")
                if cut < 0:
                    more = f.read_at(min(BLOCK, s.upto - at), at)
                    if not more:
                        break
                    held, at = held + more, at + len(more)
                    continue
                line, held = held[:cut], held[cut + 1 :]
                if not skip and line_at < s.end:
                    at_rows.append(line_at)
                    lines.append(line)
                skip, line_at = False, line_at + cut + 1
                if len(lines) >= 10_000:
                    yield self.batch(s.file, at_rows, lines)
                    at_rows, lines = [], []
            yield self.batch(s.file, at_rows, lines)

    def batch(self, file: str, at: list[int], lines: list[bytes]) -> pa.RecordBatch:
        text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(text, pa.string())], names=["file", "at", "value"])

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> LineStream:
        if not self.options.get("path"):
            raise ValueError("a stream of lines takes the option path")
        return LineStream(self.options["path"].rstrip("/"), int(self.options.get("range_bytes") or 8 << 20))


SAMPLE = "source_id long, seq long, ts timestamp, cpu_usage double, memory_usage double, gpu_usage double, busy boolean"


def samples_of(lines: DataFrame, value: Column | str = "value") -> DataFrame:
    """Telemetry samples (source_id, seq, ts, cpu, memory, gpu, busy) and the line's key; what isn't JSON has nulls."""
    s = F.from_json(F.col(value) if isinstance(value, str) else value, SAMPLE)
    return lines.withColumn("__s", s).select("file", "at", "__s.source_id", "__s.seq", "__s.ts", F.col("__s.cpu_usage").alias("cpu"), F.col("__s.memory_usage").alias("memory"), F.col("__s.gpu_usage").alias("gpu"), F.coalesce("__s.busy", F.lit(False)).alias("busy"))
