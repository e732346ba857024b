"""Streams worked on in event-time order, whatever the cut into batches, and tables played as streams.

A key's rows wait in its state until the watermark has passed them; then they are fed in order of
(t, seq), t in microseconds, to step(). So the outcome doesn't depend on how rows were cut into
batches or in which order they came, as long as none is later than the watermark's delay. What a key
remembers beside that is a small dictionary; a key that remembers nothing holds no state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.synthetic import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Rows in order by key. A subclass names its columns (t and seq among them) and outputs, and has step() and, if time alone changes something, wake()."""

    #: Input columns as a DDL text, and output columns.
    columns = "t long, seq long"
    output = "seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.columns.split(", ")]
        self.whole = {c.split()[0] for c in self.columns.split(", ") if c.split()[1] in ("int", "long")}
        self.out = [c.split()[0] for c in self.output.split(", ")]
        self.waiting = handle.getListState("waiting", self.columns)
        self.memory = handle.getValueState("memory", StructType([StructField("json", StringType())]))

    def step(self, key: tuple, row: dict, memory: dict) -> list[tuple]:
        """Rows put out for a row; memory is changed in place."""
        raise NotImplementedError

    def wake(self, key: tuple, now: int, memory: dict) -> list[tuple]:
        """Rows put out because it is `now` (microseconds; None: the end of all rows waiting), before rows that come later."""
        return []

    def due(self, memory: dict) -> int | None:
        """When wake() is to be called next, in microseconds."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))[self.names]
        # pandas has whole numbers with nulls as floats
        plain = lambda n, v: None if pd.isna(v) else int(v) if n in self.whole else v.item() if hasattr(v, "item") else v
        self.waiting.appendList([tuple(map(plain, self.names, r)) for r in got.itertuples(index=False, name=None)])
        self.handle.registerTimer(int(got["t"].max()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [dict(zip(self.names, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted((r for r in held if r["t"] <= now), key=lambda r: (r["t"], r["seq"]))
        rest = [tuple(r[n] for n in self.names) for r in held if r["t"] > now]
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        out = []
        for r in rows:
            out += self.wake(key, r["t"] - 1, memory)
            out += self.step(key, r, memory)
        out += self.wake(key, now, memory)
        self.waiting.put(rest) if rest else self.waiting.clear()
        if memory:
            self.memory.update((json.dumps(memory),))
            if (at := self.due(memory)) is not None:
                self.handle.registerTimer(at // 1000 + 1)
        else:
            self.memory.clear()
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A row of initial state: what the key remembers, as JSON in the column json."""
        self.memory.update((str(initialState["json"].iloc[0]),))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, keys: list[str], processor: StatefulProcessor, late: str, initial: DataFrame | None = None) -> DataFrame:
    """A stream of rows (with ts and seq) through the processor, one with an output, by key; rows with closed = true only move time on."""
    live = rows.withWatermark("ts", late).where("closed is null or not closed or ts is null").withColumn("t", F.unix_micros("ts"))
    # the event time isn't needed any more but for the watermark, which goes on with it
    return live.groupBy(*keys).transformWithStateInPandas(processor, processor.output, "Append", "EventTime", *([initial.groupBy(*keys)] if initial is not None else []))


def play(rows: DataFrame, batches: int, shuffled: bool = False) -> str:
    """A table with a column ts as files that a stream takes one a batch, and a last row that moves time on; the folder.

    In order of ts, or dealt so that each batch has rows of the whole span. For tables that a test
    or a query plays; a stream of its own comes in as it does.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("closed", F.lit(False))
    low, high = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    at = F.pmod(F.xxhash64("seq"), F.lit(batches)) if shuffled else F.least(F.floor((F.unix_micros("ts") - (low or 0)) * batches / (max(1, (high or 0) - (low or 0)) + 1)), F.lit(batches - 1))
    for i in range(batches):
        rows.where(at == i).coalesce(1).write.mode("append").parquet(folder)
    # its other columns are some row's: filters that a join infers, as on null keys, would drop it below the watermark
    last = rows.limit(1).withColumns({"seq": F.lit(None).cast(dict(rows.dtypes)["seq"]), "ts": F.timestamp_micros(F.lit((high or 0) + 400 * 86_400_000_000)), "closed": F.lit(True)})
    last.select(*rows.columns).coalesce(1).write.mode("append").parquet(folder)
    return folder


def played(rows: DataFrame, run: Callable[[DataFrame], DataFrame], batches: int = 1, shuffled: bool = False) -> DataFrame:
    """rows as a stream of batches through run(), until all is done; what came out, as a table of the shared folder."""
    spark = rows.sparkSession
    folder = play(rows, batches, shuffled)
    return drained(spark, run(opened(spark, folder, 1)), f"{folder}-out")


def opened(spark: SparkSession, folder: str, files: int) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)


def drained(spark: SparkSession, stream: DataFrame, folder: str, timeout: int = 600, partitions: int = 8) -> DataFrame:
    """Run a stream on what there is, from its checkpoint beside the folder, and read what it has put out so far.

    partitions: of its state, which a checkpoint keeps from its first run on; more for a larger stream.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}-checkpoint").option("path", folder).trigger(availableNow=True).start()
        if not q.awaitTermination(timeout):
            q.stop()
            raise TimeoutError("the stream didn't end")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(folder)


def state_rows(spark: SparkSession, folder: str) -> int:
    """Rows that the state of a drained() stream's ordered operator holds."""
    read = lambda name: spark.read.format("statestore").option("path", f"{folder}-checkpoint").option("stateVarName", name).load()
    return read("waiting").count() + read("memory").count()
