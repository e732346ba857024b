"""Shared pieces of the corpus operators: word rules, materialisation, row mapping, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words. bytes.split() without arguments splits at the same six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: So many words of 64 marks are broadcast at most (16 bytes each).
MOST_WORDS = 1 << 19
#: Links that a task of components() reads.
TASK_LINKS = 50_000


def scratch(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It is the one in spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder; a cluster, whose executors couldn't see one, gets an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumenfield-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written rows.

    The lineage ends there, so a lost executor costs no recomputation of what stands before. Spark
    removes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_file(path: str, mode: str):
    """A file of the shared folder, opened by path in a task ("r" or "w"), on any file system that pyarrow knows."""
    fs, name = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.open_input_file(name) if mode == "r" else fs.open_output_stream(name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, made from the driver; a folder for files that tasks write by path."""
    path = re.sub("^file:/+", "file:///", f"{scratch(spark)}/{name}-{uuid.uuid4().hex}")
    fs, inside = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(inside)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_columns(df: DataFrame, make: Callable[..., list], schema: str) -> DataFrame:
    """Rows of df through make(*columns as Python lists) -> list of columns, one Arrow batch at a time."""
    fields = pa.schema([])
    spark = df.sparkSession
    target = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


def perhaps_in(rows: DataFrame, keys: DataFrame, key: str, words: int = MOST_WORDS) -> DataFrame:
    """rows with __lf_in: false only where key isn't among those of keys; true for all that are, and for some others. No row is shuffled.

    Each key sets one of 64 * words marks, which are broadcast. With very many keys more of the
    others are true; the broadcast doesn't grow. For a join or a grouping that few rows take part in.
    """
    place = F.pmod(F.xxhash64(key), F.lit(64 * words))
    word, mark = F.shiftright(place, 6).alias("__lf_word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    marks = keys.groupBy(word).agg(F.bit_or(mark).alias("__lf_marks"))
    told = rows.withColumn("__lf_word", word).join(F.broadcast(marks), "__lf_word", "left")
    return told.withColumn("__lf_in", F.coalesce(F.col("__lf_marks").bitwiseAND(mark) != 0, F.lit(False))).drop("__lf_word", "__lf_marks")


def narrowed(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key isn't among those of keys, to be joined with them."""
    return perhaps_in(rows, keys, key).where("__lf_in").drop("__lf_in")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the undirected edges: rows (node, root), root the smallest node id.

    Alternates large-star and small-star passes: each node's neighbours are linked to the smallest
    of them until nothing changes. Minima are aggregates and the rest is joins on the node, so a
    node with very many neighbours is pre-aggregated and its rows can be split by adaptive
    execution. Only two numbers per round reach the driver. Self-links and null ends are ignored.
    Links don't grow in number from round to round, so their first count sizes the tasks: few links
    don't become hundreds of shuffle files a round.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    tasks = links.count() // TASK_LINKS + 1
    links, before = links.coalesce(tasks), None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        # every row now points from a node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(small.union(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def save(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed Parquet table in the shared folder, read back as a scan.

    For wide intermediate rows. The table stays in the checkpoint folder, which is scratch space.
    """
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._lf_saved = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table that save() made and that nothing reads any more."""
    fs, name = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", df._lf_saved))
    fs.delete_dir(name)


def spread_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, ways: int = 8) -> DataFrame:
    """left join right on key (both not null), a key's left rows dealt over `ways` tasks by spread_by.

    For a left side with hot keys and a right side with one narrow row a key, which is repeated.
    """
    left = left.withColumn("__lf_way", F.pmod(F.xxhash64(spread_by), F.lit(ways)).cast("int"))
    right = right.withColumn("__lf_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return left.join(right, [key, "__lf_way"]).drop("__lf_way")
