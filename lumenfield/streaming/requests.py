"""Request state by source: as batch aggregates, and as stateful stream operators.

Actions come in order of seq: track, release, cancel, invalidate. A cancellation stands until work on
its request looks at it, once, or until it is older than its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

from .ordered import Ordered, in_order

#: Fixed value: a request is tried again once.
ATTEMPTS = 2

KEYS = ["source_id", "request_id"]

#: Microseconds of a range of time that a key's rows are worked on together.
RANGE = 3_600_000_000


def valid(actions: DataFrame) -> DataFrame:
    return actions.where((F.col("source_id") > 0) & F.coalesce(F.length("request_id") > 0, F.lit(False)))


def pending(actions: DataFrame) -> DataFrame:
    """Requests that are tracked after all actions: the last of track, release and the source's invalidations is a track."""
    own = valid(actions.where("action in ('track', 'release')")).groupBy("source_id", "request_id").agg(F.max_by("action", "seq").alias("last"), F.max("seq").alias("seq"))
    cleared = actions.where("action = 'invalidate'").groupBy("source_id").agg(F.max("seq").alias("cleared"))
    return own.join(cleared, "source_id", "left").where((F.col("last") == "track") & (F.coalesce("cleared", F.lit(-1)) < F.col("seq"))).select("source_id", "request_id")


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses with the request that waits for them, each request's first only."""
    r = responses.groupBy("source_id", "request_id").agg(F.min("ts").alias("answered_at"))
    return requests.join(r, ["source_id", "request_id"]).where(F.col("answered_at") >= F.col("ts"))


def not_cancelled(work: DataFrame, cancels: DataFrame) -> DataFrame:
    """Work whose request has no cancellation before it starts."""
    c = cancels.groupBy("source_id", "request_id").agg(F.min("seq").alias("cancelled"))
    return work.join(c, ["source_id", "request_id"], "left").where(F.col("cancelled").isNull() | (F.col("cancelled") > F.col("seq"))).drop("cancelled")


def retries(failures: DataFrame) -> DataFrame:
    """Each failure of a request with its number, and whether it is tried again."""
    n = F.row_number().over(Window.partitionBy("source_id", "request_id").orderBy("seq"))
    return failures.withColumn("attempt", n).withColumn("retry", F.col("attempt") < ATTEMPTS)


def superseded(loads: DataFrame) -> DataFrame:
    """Each load's source id, and the one it cancels: ids rise with every load."""
    before = Window.partitionBy("viewer").orderBy("seq")
    return loads.withColumn("source_id", F.row_number().over(before)).withColumn("cancels", F.lag("source_id").over(before))


class Tracker(StatefulProcessor):
    """Per source: which requests are pending. Emits each action with whether it had an effect."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.requests = handle.getMapState("requests", StructType([StructField("request_id", StringType())]), StructType([StructField("open", BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            name = (r.request_id,)
            effect = False
            if r.action == "invalidate":
                names = list(self.requests.keys())
                effect = bool(names)
                for n in names:
                    self.requests.removeKey(n)
            elif key[0] > 0 and r.request_id:
                known = self.requests.containsKey(name)
                effect = known == (r.action == "release")
                if r.action == "release" and known:
                    self.requests.removeKey(name)
                elif r.action == "track":
                    self.requests.updateValue(name, (True,))
            out.append((key[0], r.request_id, int(r.seq), r.action, effect))
        yield pd.DataFrame(out, columns=["source_id", "request_id", "seq", "action", "effect"])

    def close(self) -> None:
        pass


def tracked_stream(actions: DataFrame) -> DataFrame:
    """The stateful form, for a stream (source_id, request_id, seq, action)."""
    schema = "source_id long, request_id string, seq long, action string, effect boolean"
    return actions.groupBy("source_id").transformWithStateInPandas(Tracker(), schema, "Append", "None")


def consumed(actions: DataFrame, ttl_seconds: int) -> DataFrame:
    """Work (rows with action work) with whether it is cancelled: several cancellations are one, and the first work after them takes them."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy(*KEYS).orderBy("__t", "seq")
    a = valid(actions).where("action in ('work', 'cancel')").withColumn("__t", micros)
    a = a.withColumn("__last", F.lag("action").over(order)).withColumn("__at", F.lag("__t").over(order))
    hit = F.coalesce((F.col("__last") == "cancel") & (F.col("__t") - F.col("__at") <= ttl_seconds * 1_000_000), F.lit(False))
    return a.where("action = 'work'").select(*KEYS, "seq", hit.alias("cancelled"))


class Cancellations(Ordered):
    """consumed() on a stream; memory: when the request was cancelled."""

    columns = "t long, seq long, action string"
    output = "source_id long, request_id string, seq long, cancelled boolean"

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def step(self, key: tuple, row: dict, memory: dict) -> list[tuple]:
        if row["action"] == "cancel":
            memory["at"] = row["t"]
            return []
        return [(*key, row["seq"], memory.pop("at", None) is not None)]

    def wake(self, key: tuple, now: int, memory: dict) -> list[tuple]:
        if memory and now > memory["at"] + self.ttl:
            memory.clear()
        return []

    def due(self, memory: dict) -> int:
        return memory["at"] + self.ttl + 1


def cancelled_stream(actions: DataFrame, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """The stateful form of consumed(), for a stream (source_id, request_id, seq, ts, action, closed), by request."""
    own = actions.where("closed or (source_id > 0 and length(request_id) > 0 and action in ('work', 'cancel'))")
    return in_order(own, KEYS, Cancellations(ttl_seconds), late)


def responses_within(requests: DataFrame, responses: DataFrame, bound: str, late: str = "1 hour") -> DataFrame:
    """Requests (source_id, request_id, seq, ts) with their responses (source_id, request_id, ts) no later than `bound` after them: seq and answered_at, a row a response, or one with null.

    The same for batches and streams. On streams both sides have a watermark, state is held for the
    bound only, and a request without response comes out when the watermark has passed it.
    """
    live = requests.isStreaming
    marked = (lambda df, c: df.withWatermark(c, late)) if live else (lambda df, c: df)
    q = marked(requests.select("source_id", "request_id", "seq", F.col("ts").cast("timestamp").alias("asked_at")), "asked_at")
    r = marked(responses.select(F.col("source_id").alias("r_source"), F.col("request_id").alias("r_id"), F.col("ts").cast("timestamp").alias("answered_at")), "answered_at")
    near = F.expr(f"source_id = r_source and request_id = r_id and answered_at >= asked_at and answered_at <= asked_at + interval {bound}")
    return q.join(r, near, "left_outer").select("source_id", "request_id", "seq", "answered_at")


def first_responses(requests: DataFrame, responses: DataFrame, bound_seconds: int) -> DataFrame:
    """Each request (source_id, request_id, seq) with answered_at, the first of its responses no later than the bound after it, or null: the one that its waiting ends with.

    What responses_within() finds, without its pairs: a row is shuffled, not met with every other of
    its key. A key's rows are cut into ranges of time; each range takes the first response of the
    ranges after it as one more row, so no task holds a whole key.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp")).alias("__t")
    q = requests.select(*KEYS, "seq", t, F.lit(0).alias("__said"))
    r = responses.select(*KEYS, F.lit(None).cast(requests.schema["seq"].dataType).alias("seq"), t, F.lit(1).alias("__said")).where("source_id is not null and request_id is not null and __t is not null")
    rows = q.unionByName(r).withColumn("__part", F.floor(F.col("__t") / RANGE))
    said = F.min(F.when(F.col("__said") == 1, F.col("__t")))
    later = Window.partitionBy(*KEYS).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*KEYS, "__part").agg(said.alias("__first")).withColumn("__t", F.min("__first").over(later)).where("__t is not null")
    ahead = ahead.select(*KEYS, F.lit(None).cast(requests.schema["seq"].dataType).alias("seq"), "__t", F.lit(1).alias("__said"), "__part")
    # backwards in time, since only frames that begin at the first row grow without being worked out anew
    back = Window.partitionBy(*KEYS, "__part").orderBy(F.desc("__t"), F.desc("__said")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = rows.unionByName(ahead).withColumn("__at", said.over(back)).where("__said = 0")
    near = F.when(F.col("__at") - F.col("__t") <= bound_seconds * 1_000_000, F.timestamp_micros("__at"))
    return got.groupBy(*KEYS, "seq").agg(F.min(near).alias("answered_at"))


#: What a waiting row is: a request, one whose seq is null, or a response.
ASKED, NAMELESS, SAID = range(3)

#: Spark's watermark begins in 1970 and pandas' times end in 2262: event times go along as t in units of 2^6 microseconds, BEGIN for 1970, which holds the years 1 to 9999.
BITS, BEGIN = 6, 10**15


class FirstResponses(StatefulProcessor):
    """first_responses() on a stream, by request; state: rows that wait, as pieces of whole numbers (micros, seq, what).

    A request goes out when the watermark has passed its first response, or the bound after it; a
    response is forgotten once the watermark has passed it, when requests before it have gone out.
    """

    output = "source_id long, request_id string, seq long, at long"

    def __init__(self, bound_seconds: int) -> None:
        self.bound = bound_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("piece", BinaryType())]))

    def look_again(self, micros) -> None:
        self.handle.registerTimer(((int(micros) >> BITS) + BEGIN) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = np.concatenate([r[["micros", "seq", "what"]].to_numpy("int64") for r in rows])
        # in one piece: Spark reads all that a key has before it appends to it
        self.waiting.appendValue((got.tobytes(),))
        self.look_again(got[:, 0].max())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the last microsecond that the watermark has passed
        now = ((timerValues.getCurrentWatermarkInMs() * 1000 - BEGIN + 1) << BITS) - 1
        pieces = [np.frombuffer(p, "int64").reshape(-1, 3) for (p,) in self.waiting.get()] if self.waiting.exists() else []
        if not pieces:
            return
        rows = np.concatenate(pieces)
        t, seq, what = rows.T
        asks, said = what != SAID, np.append(np.sort(t[what == SAID]), np.iinfo("int64").max)
        at = said[np.searchsorted(said, t)]
        near = at <= t + self.bound
        due = np.where(near, at, t + self.bound)
        out = asks & (due <= now)
        rest = np.where(asks, ~out, t > now)
        self.waiting.put([(rows[rest].tobytes(),)]) if rest.any() else self.waiting.clear()
        if (asks & rest).any():
            self.look_again(due[asks & rest].min())
        if out.any():
            whole = pd.arrays.IntegerArray
            yield pd.DataFrame({"source_id": key[0], "request_id": key[1], "seq": whole(seq[out], what[out] == NAMELESS), "at": whole(at[out], ~near[out])})

    def close(self) -> None:
        pass


def first_responses_stream(actions: DataFrame, bound_seconds: int, late_seconds: int = 3600) -> DataFrame:
    """The stateful form of first_responses(), for a stream (source_id, request_id, seq, ts, action, closed) whose action track asks and whose release answers: a row a request.

    Requests without a key or a time can't be answered: they go out at once.
    """
    known = "source_id is not null and request_id is not null and ts is not null"
    what = F.when(F.col("action") == "release", SAID).when(F.col("seq").isNull(), NAMELESS).otherwise(ASKED)
    micros = F.unix_micros("ts")
    own = actions.where(f"closed or ({known} and action in ('track', 'release'))")
    own = own.select(*KEYS, F.coalesce("seq", F.lit(0)).alias("seq"), micros.alias("micros"), F.timestamp_micros(F.shiftright(micros, BITS) + BEGIN).alias("ts"), "closed", what.alias("what"))
    late = f"{(late_seconds * 1000 >> BITS) + 1} milliseconds"
    got = in_order(own, KEYS, FirstResponses(bound_seconds), late).select(*KEYS, "seq", F.timestamp_micros("at").alias("answered_at"))
    lost = actions.where(f"not coalesce(closed, false) and action = 'track' and not ({known})").select(*KEYS, "seq", F.lit(None).cast("timestamp").alias("answered_at"))
    return got.unionByName(lost)
