"""The viewer's message protocol: envelopes, classification, reactions. All row by row, so they hold for batches and streams.

A message has protocol_version, type, source_id, request_id, bands (array<int>), tx, ty, is_initial, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

PROTOCOL = 1
#: Commands to workers and their responses.
COMMANDS = ("init", "cancel", "calculate_stats", "load_tile", "get_spectrum")
RESPONSES = ("ready", "canceled", "stats_complete", "tile_complete", "tile_error", "spectrum_complete", "spectrum_error", "error")


def supported(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of the protocol's version, and the others, which change no state."""
    ok = F.coalesce(F.col("protocol_version") == PROTOCOL, F.lit(False))
    return df.where(ok), df.where(~ok)


def stale_source(active: Column) -> Column:
    return (F.col("source_id") > 0) & (F.col("source_id") != active)


def kind(active: Column, bands: tuple[int, int, int]) -> Column:
    """What a message is: version first, then the source, then by type."""
    t = F.col("type")
    triple = F.array(*map(F.lit, bands))
    tile = (
        F.when(F.col("bands").isNull() | (F.size("bands") < 3), "tile-complete-malformed")
        .when(F.slice("bands", 1, 3) != triple, "tile-complete-stale-bands")
        .when(F.col("tx").isNull() | F.col("ty").isNull(), "tile-complete-malformed")
        .otherwise("tile-complete")
    )
    return (
        F.when(~F.coalesce(F.col("protocol_version") == PROTOCOL, F.lit(False)), "error")
        .when(F.coalesce(stale_source(active), F.lit(False)), "stale-source")
        .when(t == "canceled", "canceled")
        .when(t == "stats_complete", "stats-complete")
        .when(t == "tile_complete", tile)
        .when(t == "spectrum_complete", "spectrum-complete")
        .when(t == "spectrum_error", "spectrum-error")
        .when(t == "tile_error", "tile-error")
        .when(t == "error", "error")
        .otherwise("unknown")
    )


def classified(df: DataFrame, active: int, bands: tuple[int, int, int]) -> DataFrame:
    return df.withColumn("kind", kind(F.lit(active), bands))


def tile_reaction(stored: Column, transitioning: Column, remaining: Column, metric: Column) -> Column:
    """What a completed tile leads to."""
    done = transitioning & (remaining == 0)
    return F.struct(
        (~stored).alias("remove_tile"),
        (stored & done).alias("finalise"),
        F.when(stored & (~transitioning | done), metric).alias("metric"),
        (stored & ~transitioning).alias("draw"),
    )


def tile_error_reaction(tile: Column, message: Column, transitioning: Column, remaining: Column) -> Column:
    name = F.coalesce(tile, F.lit("unknown"))
    line = F.concat(F.lit("Worker failed to load tile ("), name, F.lit(") : "), F.coalesce(F.when(message != "", message), F.lit("Unknown error")))
    return F.struct(name.alias("tile"), line.alias("log"), (transitioning & (remaining == 0)).alias("finalise"))


def stats_reaction(initial: Column, transitioning: Column, waiting: Column, ready: Column) -> Column:
    """What completed statistics lead to."""
    switch = ~initial & ~transitioning & waiting & ready
    return F.struct(initial.alias("set_view"), initial.alias("load_end"), initial.alias("background"), switch.alias("transition"), switch.alias("stop_waiting"))


def stats_to_cache(stats: DataFrame, requested: DataFrame) -> DataFrame:
    """Limits that aren't null, of bands that were asked for."""
    return stats.where("min is not null").join(requested.select("band").distinct(), "band", "left_semi")


def request(command: str, source: Column, request_id: Column, payload: Column) -> Column:
    """An envelope as JSON."""
    if command not in COMMANDS:
        raise ValueError(f"unknown command: {command}")
    return F.to_json(F.struct(F.lit(PROTOCOL).alias("protocolVersion"), F.lit(command).alias("type"), source.alias("sourceId"), request_id.alias("requestId"), payload.alias("payload")))


def tile_request(source: Column, phase: Column, tx: Column, ty: Column, bands: Column, load: Column) -> Column:
    """A tile's request, with the id that tells it from others. load: a struct of what is loaded from."""
    payload = F.struct(load.alias("dataSource"), F.struct(tx.alias("x"), ty.alias("y")).alias("tile"), bands.alias("bands"))
    return request("load_tile", source, text.tile_request_id(source, phase, tx, ty, bands), payload)


def stats_request(source: Column, bands: Column, initial: Column, load: Column) -> Column:
    payload = F.struct(load.alias("dataSource"), bands.alias("bands"), initial.alias("isInitial"))
    return request("calculate_stats", source, text.stats_request_id(source, bands, initial), payload)


def spectrum_request(source: Column, request_id: Column, x: Column, y: Column, load: Column) -> Column:
    return request("get_spectrum", source, request_id, F.struct(load.alias("dataSource"), x.alias("x"), y.alias("y")))


def cancel_request(source: Column, request_id: Column, reason: Column) -> Column:
    return request("cancel", source, request_id, F.struct(reason.alias("reason")))


ENVELOPE = "protocolVersion int, type string, sourceId bigint, requestId string, payload struct<bands:array<int>,tile:struct<x:int,y:int>,isInitial:boolean,message:string>, error struct<message:string>"


def parsed(df: DataFrame, column: str = "value") -> DataFrame:
    """Messages from JSON envelopes; what can't be parsed has a null version and so becomes an error."""
    e = df.withColumn("__e", F.from_json(F.col(column).cast("string"), ENVELOPE)).select(*df.columns, "__e.*")
    own = e.select(
        *df.columns, F.col("protocolVersion").alias("protocol_version"), F.coalesce("type", F.lit("error")).alias("type"), F.coalesce("sourceId", F.lit(0)).alias("source_id"),
        F.col("requestId").alias("request_id"), F.col("payload.bands").alias("bands"), F.col("payload.tile.x").alias("tx"), F.col("payload.tile.y").alias("ty"),
        F.coalesce("payload.isInitial", F.lit(False)).alias("is_initial"), F.coalesce("error.message", "payload.message").alias("error_message"),
    )
    return own
