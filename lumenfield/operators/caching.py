"""What a viewer's caches hold: missing entries, usage, and what a budget lets stay."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running

#: Budgets of the tile cache of one source.
BYTES, TILES = 128 * 1024 * 1024, 512


@dataclass(frozen=True)
class Policy:
    """What a cache may hold of a source (None: any number), by which columns it is scoped beside the source, and what empties it."""

    clears: tuple[str, ...]
    scope: tuple[str, ...] = ()
    entries: int | None = None
    bytes: int | None = None


#: The policies of the viewer's caches.
POLICIES = {
    "metadata": Policy(("unload", "source-switch", "destroy"), entries=1),
    "stats": Policy(("unload", "source-switch", "destroy")),
    "raw-tiles": Policy(("unload", "source-switch", "viewport-eviction", "budget-eviction"), ("viewport",), bytes=64 * 1024 * 1024),
    "render-tiles": Policy(("unload", "source-switch", "budget-eviction", "device-loss", "destroy"), entries=TILES, bytes=BYTES),
}


def missing(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted, each once, that aren't cached."""
    return wanted.dropDuplicates(keys).join(cached.select(*keys), keys, "left_anti")


def usage(slots: DataFrame) -> DataFrame:
    """Tiles and bytes that each source holds, over all slots."""
    return slots.groupBy("source_id").agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"))


def last_touched(touches: DataFrame) -> DataFrame:
    """Each tile's last touch and the bytes it had then."""
    return touches.groupBy("source_id", "tile").agg(F.max("seq").alias("seq"), F.max_by("bytes", "seq").alias("bytes"))


def kept(entries: DataFrame, bytes_: int = BYTES, tiles: int = TILES) -> DataFrame:
    """Least-recently-used eviction: of each source the most recent entries that meet both budgets together."""
    r = running(entries.withColumn("__late", -F.col("seq")), "source_id", "__late", sums={"__upto": F.col("bytes"), "__row": F.lit(1)})
    return r.where((F.col("__upto") <= bytes_) & (F.col("__row") <= tiles)).drop("__upto", "__row", "__late")


def stats_plan(bands: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: whether all bands have cached limits, and the bands that don't."""
    asked = bands.select("band").distinct().join(cached.where("min is not null").select("band", F.lit(True).alias("known")), "band", "left")
    return asked.agg(F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("band")))).alias("missing")).select((F.size("missing") == 0).alias("ready"), "missing")


def swapped(slots: DataFrame, source: str, target: str) -> DataFrame:
    """The entries of slot source take the place of those of slot target."""
    return slots.where(F.col("slot") != target).withColumn("slot", F.when(F.col("slot") == source, target).otherwise(F.col("slot")))


def standing(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries (policy, source_id, seq, ...) that no later event (source_id, kind, seq) of a kind that their policy lists has cleared."""
    last = events.where(F.col("kind").isin(sorted({k for p in POLICIES.values() for k in p.clears}))).groupBy("source_id", "kind").agg(F.max("seq").alias("s"))
    # a source has a row and in it a number a kind
    last = last.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "s"))).alias("__last"))
    listed = F.create_map(*(c for name, p in POLICIES.items() for c in (F.lit(name), F.array(*map(F.lit, p.clears)))))
    cleared = F.array_max(F.transform(F.try_element_at(listed, F.col("policy")), lambda k: F.try_element_at(F.col("__last"), k)))
    return entries.join(last, "source_id", "left").where(F.coalesce(cleared, F.lit(-1)) < F.col("seq")).drop("__last")


def held(entries: DataFrame) -> DataFrame:
    """Of entries (policy, source_id, seq, bytes, ...) the most recent that meet their policy's budgets, by source and scope."""
    parts = []
    for name, p in POLICIES.items():
        own = entries.where(F.col("policy") == name)
        if p.entries is None and p.bytes is None:
            parts.append(own)
            continue
        own = own.withColumn("__scope", F.struct("source_id", *p.scope)).withColumn("__late", -F.col("seq"))
        r = running(own, "__scope", "__late", sums={"__upto": F.col("bytes"), "__row": F.lit(1)})
        fits = (F.lit(p.bytes is None) | (F.col("__upto") <= F.lit(p.bytes or 0))) & (F.lit(p.entries is None) | (F.col("__row") <= F.lit(p.entries or 0)))
        parts.append(r.where(fits).select(*entries.columns))
    return functools.reduce(DataFrame.unionByName, parts)
