"""The driver's tables as a cube, messages and telemetry, in Spark and in DuckDB SQL.

embeddings is a cube stored by pixel: 25 samples a line, 64 bands, wavelengths 400, 410, ... nm.
events is the message and telemetry stream.
"""

from __future__ import annotations

import dataclasses
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cube import Cube
from ..sources import synthetic
from ..sources.cube_writer import write_cube
from ..sources.header import Header
from ..sources.ranges import store_of

SAMPLES, BANDS, SIZE = 25, 64, 8
MAP_INFO = "UTM, 1, 1, 500000, 4100000, 30, 30, 50, North, WGS-84, units=Meters"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % SAMPLES).cast("int").alias("x"), F.expr(f"vec_id div {SAMPLES}").cast("int").alias("y"), F.col("embedding").alias("spectrum"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = wide(spark, sf_dir).select("x", "y", F.posexplode("spectrum").alias("pos", "value"))
    return p.select("x", "y", (F.col("pos") + 1).alias("band"), "value")


def cube(spark: SparkSession, sf_dir: str) -> Cube:
    lines = -(-table(spark, sf_dir, "embeddings").count() // SAMPLES)
    h = Header(SAMPLES, lines, BANDS, "bip", "f32", map_info=MAP_INFO, wavelength=tuple(400.0 + 10 * b for b in range(BANDS)))
    return Cube(h, pixels(spark, sf_dir), wide(spark, sf_dir))


#: Written cubes by session, tables, layout and whether they are cut short.
WRITTEN: dict[tuple, tuple[str, str]] = {}


def file_cube(spark: SparkSession, sf_dir: str, layout: str, cut_short: bool = False) -> Cube:
    """The cube as header and payload files in the session's shared folder (a temporary one for a local session), written once a session.

    Pixels that the table has no row for are zero. Cut short, the payload lacks its last third.
    """
    key = (spark.sparkContext.applicationId, sf_dir, layout, cut_short)
    if key not in WRITTEN:
        c = cube(spark, sf_dir)
        h = dataclasses.replace(c.header, interleave=layout)
        place = f"{synthetic.shared_folder(spark)}/{layout}"
        write_cube(c.wide, h, f"{place}.hdr", f"{place}.img")
        if cut_short:
            _, inside = store_of(f"{place}.img")
            os.truncate(inside, os.path.getsize(inside) * 2 // 3)
        WRITTEN[key] = f"{place}.hdr", f"{place}.img"
    return Cube.load(spark, *WRITTEN[key])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of workers made of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.create_map(*map(F.lit, ("view", "tile_complete", "click", "stats_complete", "signup", "spectrum_complete", "error", "error", "purchase", "tile_error")))
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.alias("seq"), "ts", F.when(n % 17 == 0, 2).otherwise(1).alias("protocol_version"), kinds[F.col("event_type")].alias("type"), (F.col("user_id") % 4).alias("source_id"),
        F.concat(F.lit("r"), (n % 97).cast("string")).alias("request_id"), F.when(n % 11 == 0, F.lit(None)).otherwise(F.array(k % 2 + 26, F.lit(16), F.lit(8))).alias("bands"),
        F.when(n % 13 != 0, k % 5).alias("tx"), (k % 3).alias("ty"), (k < 10).alias("is_initial"), "value",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a monitor made of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("source_id"), F.col("event_id").alias("seq"), "ts", F.col("value").alias("cpu"), (F.col("value") * 2).alias("memory"), F.when(k % 3 != 0, k.cast("double")).alias("gpu"), (k >= 50).alias("busy"), "event_type")


#: The same in DuckDB.
PX = f"px AS (SELECT (vec_id % {SAMPLES})::INT AS x, (vec_id // {SAMPLES})::INT AS y, b::INT AS band, embedding[b] AS value FROM embeddings, range(1, {BANDS + 1}) t(b))"
#: The cube in files: a cell for every place, zero where the table has no row.
FILE_PX = f"fe AS (SELECT *, (vec_id % {SAMPLES})::INT AS x, (vec_id // {SAMPLES})::INT AS y FROM embeddings), fd AS (SELECT ceil(count(*) / {SAMPLES}.0)::INT AS lines FROM embeddings), px AS (SELECT p.x::INT AS x, q.y::INT AS y, b::INT AS band, coalesce(embedding[b], 0)::FLOAT AS value FROM fd, range({SAMPLES}) p(x), range(lines) q(y), range(1, {BANDS + 1}) r(b) LEFT JOIN fe ON fe.x = p.x AND fe.y = q.y)"
DIM = f"dim AS (SELECT {SAMPLES} AS samples, ceil(count(*) / {SAMPLES}.0)::INT AS lines FROM embeddings)"
MSG = """k AS (SELECT *, (props->>'k')::INT AS k FROM events),
msg AS (SELECT event_id AS seq, ts, CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS protocol_version,
  CASE event_type WHEN 'view' THEN 'tile_complete' WHEN 'click' THEN 'stats_complete' WHEN 'signup' THEN 'spectrum_complete' WHEN 'error' THEN 'error' ELSE 'tile_error' END AS type,
  user_id % 4 AS source_id, 'r' || (event_id % 97) AS request_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE [k % 2 + 26, 16, 8] END AS bands,
  CASE WHEN event_id % 13 <> 0 THEN k % 5 END AS tx, k % 3 AS ty, k < 10 AS is_initial, value FROM k)"""
TEL = """k AS (SELECT *, (props->>'k')::INT AS k FROM events),
tel AS (SELECT user_id % 10 AS source_id, event_id AS seq, ts, value AS cpu, value * 2 AS memory, CASE WHEN k % 3 <> 0 THEN k::DOUBLE END AS gpu, k >= 50 AS busy, event_type FROM k)"""
