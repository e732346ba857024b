"""Telemetry of a viewer: baselines, peaks, histories, metrics, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import running
from .ordered import Ordered, in_order

#: Fixed values of the idle rule: CPU percent, the number of samples after which a baseline is forced, and milliseconds to the second look.
IDLE, FORCED, AGAIN = 20.0, 41, 500


def micros(ts: str) -> Column:
    """Microseconds of a timestamp column with or without a time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def baseline(samples: DataFrame, again_ms: int = AGAIN) -> DataFrame:
    """Per source the sample taken as its baseline: what is current `again_ms` after a sample with low CPU while the viewer rests, if that is still so, or the 41st sample, whichever comes first.

    A sample that comes at the very time of the second look is current. Only the first 41 samples of
    a source matter: they are cut out by rank, which Spark limits before the shuffle.
    """
    order = Window.partitionBy("source_id").orderBy("__t", "seq")
    # samples without a time stand in their order, too far apart to be seen together
    time = micros("ts") if "ts" in samples.columns else F.col("seq") * (again_ms * 1000 + 1)
    s = samples.select("source_id", "seq", "cpu", "memory", "gpu", "busy", time.alias("__t"))
    s = s.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FORCED)
    idle = (F.col("cpu") < IDLE) & ~F.col("busy")
    ahead = Window.partitionBy("source_id").orderBy("__t").rangeBetween(Window.currentRow, again_ms * 1000)
    s = s.withColumn("now", F.max(F.struct("__t", "seq", "cpu", "memory", "gpu", idle.alias("idle"))).over(ahead))
    looked = F.when(F.col("n") == FORCED, F.struct(F.col("__t").alias("at"), F.lit(1).alias("late"), F.struct("seq", "cpu", "memory", "gpu").alias("s")))
    looked = F.coalesce(F.when(idle & (F.col("n") < FORCED) & F.col("now.idle"), F.struct((F.col("__t") + again_ms * 1000).alias("at"), F.lit(0).alias("late"), F.struct("now.seq", "now.cpu", "now.memory", "now.gpu").alias("s"))), looked)
    return s.groupBy("source_id").agg(F.min(looked).alias("b")).where("b is not null").select("source_id", "b.s.*")


class Baselines(Ordered):
    """baseline() on a stream; memory: samples seen, the current one, times of second looks; after the capture only that it is done."""

    columns = "t long, seq long, cpu double, memory double, gpu double, busy boolean"
    output = "source_id long, seq long, cpu double, memory double, gpu double"

    def __init__(self, again_ms: int) -> None:
        self.again = again_ms * 1000

    def captured(self, key: tuple, memory: dict) -> list[tuple]:
        s = memory["now"]
        memory.clear()
        memory["done"] = True
        return [(*key, s["seq"], s["cpu"], s["memory"], s["gpu"])]

    def idle(self, s: dict) -> bool:
        return s["cpu"] is not None and s["busy"] is not None and s["cpu"] < IDLE and not s["busy"]

    def step(self, key: tuple, row: dict, memory: dict) -> list[tuple]:
        if "done" in memory:
            return []
        memory["n"], memory["now"] = memory.get("n", 0) + 1, row
        if memory["n"] >= FORCED:
            return self.captured(key, memory)
        if self.idle(row):
            memory.setdefault("looks", []).append(row["t"] + self.again)
        return []

    def wake(self, key: tuple, now: int, memory: dict) -> list[tuple]:
        while memory.get("looks") and memory["looks"][0] <= now:
            memory["looks"].pop(0)
            if self.idle(memory["now"]):
                return self.captured(key, memory)
        return []

    def due(self, memory: dict) -> int | None:
        return memory["looks"][0] if memory.get("looks") else None


def baseline_stream(samples: DataFrame, again_ms: int = AGAIN, late: str = "1 hour") -> DataFrame:
    """The stateful form of baseline(), for a stream (source_id, seq, ts, cpu, memory, gpu, busy, closed)."""
    return in_order(samples, ["source_id"], Baselines(again_ms), late)


def peaks(samples: DataFrame, base: DataFrame) -> DataFrame:
    """Running maxima from the baseline on; the GPU's only where baseline and sample have one."""
    b = base.select("source_id", F.col("seq").alias("from"), F.col("gpu").alias("gpu0"))
    s = samples.join(b, "source_id").where(F.col("seq") >= F.col("from"))
    r = running(s, "source_id", "seq", maxima={"peak_cpu": "cpu", "peak_memory": "memory", "most_gpu": "gpu"})
    return r.select("source_id", "seq", "peak_cpu", "peak_memory", F.when(F.col("gpu0").isNotNull(), F.col("most_gpu")).alias("peak_gpu"))


def switch_times(samples: DataFrame) -> DataFrame:
    """Milliseconds since the sample before of the same source; no row for the first."""
    r = running(samples, "source_id", "seq", before={"before": "ts"})
    return r.where("before is not null").select("source_id", "seq", ((micros("ts") - micros("before")) / 1000).alias("ms"))


def history(samples: DataFrame, n: int = 50) -> DataFrame:
    """The last n samples of each source."""
    late = Window.partitionBy("source_id").orderBy(F.desc("seq"))
    return samples.withColumn("__row", F.row_number().over(late)).where(F.col("__row") <= n).drop("__row")


def within(samples: DataFrame, seconds: int | None) -> DataFrame:
    """Samples of the last seconds before the newest one; all if None."""
    if seconds is None:
        return samples
    newest = samples.agg(F.max("ts")).first()[0]
    return samples.where(F.col("ts") >= F.lit(newest) - F.expr(f"INTERVAL {seconds} SECONDS"))


def initial_view(tiles: DataFrame, done: DataFrame, started: DataFrame) -> DataFrame:
    """Milliseconds from a source's start until all tiles first visible were complete; no row while one is missing."""
    first = done.groupBy("source_id", "tile").agg(F.min("ts").alias("ts"))
    j = tiles.join(first, ["source_id", "tile"], "left").groupBy("source_id").agg(F.count_if(F.col("ts").isNull()).alias("missing"), F.max("ts").alias("done"))
    took = (micros("done") - micros("started")) / 1000
    return j.where("missing = 0").join(started, "source_id").select("source_id", took.alias("value"))


def first_metric(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("source_id", "name").agg(F.min_by("value", "seq").alias("value"))


def windowed(events: DataFrame, length: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows, for batches and, with late data dropped, for streams."""
    kind = dict(events.dtypes)["ts"]
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast(kind).alias("start"), "event_type", "n", "total")


def band_changes(selections: DataFrame) -> DataFrame:
    """Selections that differ from the one before of the same source."""
    r = running(selections, "source_id", "seq", before={"__before": "bands"})
    return r.where(~F.col("bands").eqNullSafe(F.col("__before"))).drop("__before")
