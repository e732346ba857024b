"""Plans of a viewer: visible tiles, missing tiles, preload order, background statistics, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tiles, viewport


def visible(grid: DataFrame, bounds: Column, samples: int, lines: int, size: int) -> DataFrame:
    """Tiles of the grid that the bounds touch."""
    x0, x1 = viewport.visible_span(bounds["x"], bounds["width"], F.lit(samples), size)
    y0, y1 = viewport.visible_span(bounds["y"], bounds["height"], F.lit(lines), size)
    return grid.where((F.col("tx") >= x0) & (F.col("tx") < x1) & (F.col("ty") >= y0) & (F.col("ty") < y1))


def centre(shown: DataFrame) -> tuple[int, int]:
    """The floored mean of the visible tiles; (0, 0) without any."""
    return tuple(shown.agg(F.coalesce(F.floor(F.avg("tx")), F.lit(0)), F.coalesce(F.floor(F.avg("ty")), F.lit(0))).first())


def preload(grid: DataFrame, shown: DataFrame, active: DataFrame) -> DataFrame:
    """Tiles neither visible nor active, with their distance to the centre of the visible ones and their place in the queue."""
    cx, cy = centre(shown)
    rest = grid.join(shown.select("tx", "ty"), ["tx", "ty"], "left_anti").join(active.select("tx", "ty"), ["tx", "ty"], "left_anti")
    return rest.select("tx", "ty", (F.abs(F.col("tx") - cx) + F.abs(F.col("ty") - cy)).alias("distance")).orderBy("distance", "ty", "tx")


def missing_tiles(spark: SparkSession, samples: int, lines: int, size: int, canvas: tuple[int, int], view: Column, cached: DataFrame) -> DataFrame:
    """Tiles that a viewport shows and the cache doesn't hold."""
    a = viewport.aspect(F.lit(samples), F.lit(lines), F.lit(canvas[0]), F.lit(canvas[1]))
    shown = visible(tiles.tile_grid(spark, samples, lines, size), viewport.visible_bounds(view, a), samples, lines, size)
    return shown.join(cached.select("tx", "ty"), ["tx", "ty"], "left_anti")


def background_stats(bands: DataFrame, cached: DataFrame) -> DataFrame:
    """Bands without limits, in order, each with its progress in percent when done. As many rows as the cube has bands, at most."""
    rest = bands.join(cached.select("band"), "band", "left_anti")
    order, every = Window.orderBy("band"), Window.partitionBy()
    return rest.select("band", F.row_number().over(order).alias("processed"), F.count(F.lit(1)).over(every).alias("total")).withColumn("progress", F.col("processed") / F.col("total") * 100)


def queued(requests: DataFrame, keys: list[str]) -> DataFrame:
    """A queue by key: a repeated request keeps its place and takes the latest payload."""
    return requests.groupBy(*keys).agg(F.min("seq").alias("place"), F.max_by("payload", "seq").alias("payload"))


def prepended(requests: DataFrame) -> DataFrame:
    """Bands put in front one by one: the last put stands first, each once."""
    return requests.groupBy("band").agg(F.max("seq").alias("put"))


#: Which queue is served first.
QUEUES = ("recovery", "tile", "stats", "preload")


def served(requests: DataFrame) -> DataFrame:
    """Requests with their rank; preloading waits while any tile request of the source does."""
    rank = F.array_position(F.array(*map(F.lit, QUEUES)), F.col("queue"))
    waiting = requests.where("queue = 'tile'").select("source_id", F.lit(True).alias("busy")).distinct()
    out = requests.join(waiting, "source_id", "left").where((F.col("queue") != "preload") | F.col("busy").isNull())
    return out.withColumn("rank", rank.cast("int")).drop("busy")
