"""Token counts by separator scan.

Flat token files are streams of fixed-width identifiers in which an end-of-document identifier
follows each document; there is no index. Files are read as byte ranges cut at fixed lengths,
wherever documents end, each by the task that scans it, so a file of any length is spread over
tasks. A range is searched with one vectorised comparison a block, and a prefix scan over the
blocks' summaries carries the open document across block boundaries.

Documents are written to flat files in the shared folder, a file a partition; a task that is run
again writes a file of its own, and only files of tasks that ended are read. Files are opened by
path, on any file system that pyarrow knows.

Empty documents count zero tokens. Tokens after a file's last separator are an open document and
make no row. Null texts count as empty. An empty table or file gives no rows. A trailing byte that
isn't a whole identifier is no token.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .util import cut, shared_file, shared_folder

DTYPE, EOD = "<u2", 50256
FILES = "path string, bytes long, first long, ids binary"
SCAN = "file string, block long, n_tokens long, n_docs long, head long, tail long, inner_lengths array<int>"


@lru_cache(2)
def encoder(path: str):
    """The byte-level vocabulary file at path, as an ordinary encoder without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_files(docs: DataFrame, vocabulary: str, folder: str, ids_a_row: int = 100_000) -> DataFrame:
    """Encode docs into flat files under folder, one a partition.

    Rows (path, bytes, first, ids): the first row of a file has its length; ids are the ids of its
    documents from number `first` on, packed, so that a count can be traced to its document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, path, size, ids, valid = encoder(vocabulary), f"{folder}/{uuid.uuid4().hex}.bin", 0, [], []
        with shared_file(path, "w") as f:
            for batch in batches:
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                valid.append(np.array(batch.column(0).is_valid(), np.uint8))
                for text in batch.column(1):
                    data = np.array([*enc.encode_ordinary(text.as_py() or ""), EOD], DTYPE).tobytes()
                    f.write(data)
                    size += len(data)
        if ids:
            ids, valid = np.concatenate(ids), np.concatenate(valid)
            at = range(0, len(ids), ids_a_row)
            packed = [ids[i : i + ids_a_row].tobytes() + valid[i : i + ids_a_row].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array([0 if i else size for i in at], pa.int64()), pa.array(at, pa.int64()), pa.array(packed, pa.binary())], names=["path", "bytes", "first", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FILES)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the flat files in a folder; only names and lengths are read."""
    from pyspark.sql import types as T

    given = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType())])
    return spark.read.format("binaryFile").schema(T.StructType([*given.fields, T.StructField("content", T.BinaryType())])).load(path).select("path", F.col("length").alias("bytes"))


def scan_files(files: DataFrame, block_tokens: int = 1 << 13, range_blocks: int = 1 << 12, eod: int = EOD, dtype: str = DTYPE) -> DataFrame:
    """Search files (path, bytes) for eod, by ranges of range_blocks blocks: each block's tokens, documents ended, tokens before the first and after the last end, and the lengths between."""
    step = block_tokens * np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with shared_file(path, "r") as f:
                    rows = []
                    for block in range(first, min(first + range_blocks, -(-size // step))):
                        data = f.read_at(min(step, size - block * step), block * step)
                        rows.append((path, block, *scan(np.frombuffer(data, dtype, len(data) // np.dtype(dtype).itemsize), eod)))
                        if len(rows) == 64:
                            yield scanned(rows)
                            rows = []
                    if rows:
                        yield scanned(rows)

    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step), F.lit(range_blocks).cast("long")))
    given = files.where("bytes > 0").select("path", "bytes", ranges.alias("block"))
    return given.repartition("path", "block").mapInArrow(run, SCAN)


def scan(ids: np.ndarray, eod: int) -> tuple[int, int, int, int, list[int]]:
    ends = np.flatnonzero(ids == eod)
    some = len(ends) > 0
    return len(ids), len(ends), int(ends[0]) if some else len(ids), len(ids) - 1 - int(ends[-1]) if some else len(ids), (np.diff(ends) - 1).tolist()


def scanned(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.list_(pa.int32()))], names=["file", "block", "n_tokens", "n_docs", "head", "tail", "inner_lengths"])


def stitch(scanned: DataFrame, run: int = 4096) -> DataFrame:
    """(file, ordinal, n_tokens) of every ended document.

    The prefix scan has two levels, so that no task holds a whole file's blocks: sums and the last
    end within runs of blocks, then over the runs of a file.
    """
    s = scanned.withColumn("run", F.expr(f"block div {run}"))
    inside = W.Window.partitionBy("file", "run").orderBy("block")
    s = s.withColumn("upto", F.sum("n_tokens").over(inside)).withColumn("docs_upto", F.sum("n_docs").over(inside))
    s = s.withColumn("ended", F.when(F.col("n_docs") > 0, F.col("upto") - F.col("tail")))
    s = s.withColumn("last", F.max("ended").over(inside.rowsBetween(W.Window.unboundedPreceding, -1)))
    runs = s.groupBy("file", "run").agg(F.sum("n_tokens").alias("t"), F.sum("n_docs").alias("d"), F.max("ended").alias("e"))
    over = W.Window.partitionBy("file").orderBy("run")
    before = over.rowsBetween(W.Window.unboundedPreceding, -1)
    runs = runs.withColumn("t0", F.coalesce(F.sum("t").over(before), F.lit(0))).withColumn("d0", F.coalesce(F.sum("d").over(before), F.lit(0)))
    runs = runs.withColumn("e0", F.coalesce(F.max(F.col("t0") + F.col("e")).over(before), F.lit(0)))
    j = s.join(runs.select("file", "run", "t0", "d0", "e0").hint("merge"), ["file", "run"])  # it grows with the input: never sent whole
    carried = F.col("t0") + F.col("upto") - F.col("n_tokens") - F.coalesce(F.col("t0") + F.col("last"), F.col("e0"))
    lengths = F.concat(F.array((F.col("head") + carried)), F.transform("inner_lengths", lambda x: x.cast("long")))
    j = j.where("n_docs > 0").select("file", (F.col("d0") + F.col("docs_upto") - F.col("n_docs")).alias("d"), F.posexplode(lengths).alias("i", "n_tokens"))
    return j.select("file", (F.col("d") + F.col("i")).alias("ordinal"), "n_tokens")


def file_ids(written: DataFrame) -> DataFrame:
    """(file, ordinal, doc_id) of the written documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(data) // 9
                ids, valid = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, offset=8 * n).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(first, first + n)), pa.array(ids, mask=~valid)], names=["file", "ordinal", "doc_id"])

    return written.select("path", "first", "ids").mapInArrow(run, "file string, ordinal long, doc_id long")


def token_counts(docs: DataFrame, vocabulary: str, block_tokens: int = 1 << 13) -> DataFrame:
    """doc_id and n_tokens of every row of docs, counted in the flat files that docs are written to."""
    written = cut(write_files(docs, vocabulary, shared_folder(docs.sparkSession, "tokens")))
    counts = stitch(scan_files(written.select("path", "bytes"), block_tokens))
    return file_ids(written).join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
