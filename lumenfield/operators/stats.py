"""Band statistics: stretch limits from sampled tiles, nearest-rank percentiles, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stretch import is_finite, limits, percentile_rank
from ..functions.tiles import tile_of

#: Accuracy of approximate quantiles (rank error: a share of 1 / ACCURACY), and by how much a bracket is wider.
ACCURACY, SLACK = 10_000, 5e-4


def in_tiles(pixels: DataFrame, tiles: list[tuple[int, int]], size: int) -> DataFrame:
    """pixels of the given tiles (a handful), with tx and ty."""
    tx, ty = tile_of(F.col("x"), F.col("y"), size)
    near = F.lit(False)
    for x, y in tiles:
        near = near | (F.col("x").between(x * size, (x + 1) * size - 1) & F.col("y").between(y * size, (y + 1) * size - 1))
    return pixels.where(near).withColumn("tx", tx).withColumn("ty", ty)


def chunk_limits(pixels: DataFrame) -> DataFrame:
    """Stretch limits (low, high) of each band in each tile, over finite values; (0, 255) without any."""
    v = F.when(is_finite(F.col("value")), F.col("value").cast("double"))
    sums = pixels.groupBy("band", "tx", "ty").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    low, high = limits(F.col("n"), F.col("s"), F.col("q"))
    return sums.select("band", "tx", "ty", "n", low.alias("low"), high.alias("high"))


def band_stats(pixels: DataFrame, tiles: list[tuple[int, int]], size: int) -> DataFrame:
    """(band, min, max): the envelope of the sampled tiles' limits; limits that aren't finite are passed over."""
    return envelope(in_tiles(pixels, tiles, size))


def envelope(pixels: DataFrame) -> DataFrame:
    """(band, min, max) over the tiles of pixels with tx and ty."""
    return envelope_of(chunk_limits(pixels))


def envelope_of(chunks: DataFrame) -> DataFrame:
    """(band, min, max) over the limits (band, tx, ty, low, high) of tiles; those that aren't finite are passed over."""
    chunks = chunks.where(is_finite(F.col("low")) & is_finite(F.col("high")))
    return chunks.groupBy("band").agg(F.min("low").alias("min"), F.max("high").alias("max"))


def pooled_stats(pixels: DataFrame) -> DataFrame:
    """(band, n, mean, sd, min, max) over all finite values, in one pass with partial sums."""
    v = F.when(is_finite(F.col("value")), F.col("value").cast("double"))
    s = pixels.groupBy("band").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))
    return s


def nearest_rank(pixels: DataFrame, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """(band, low, high): values at two nearest ranks of each band, without interpolation. NaN and null are left out.

    Approximate quantiles a little below and above each rank bracket it, whatever the values'
    distribution (SLACK is five times their rank error). One more pass counts the rows below each
    bracket and the equal values inside, and only a bracket's distinct values are sorted.
    """
    v = pixels.where(F.col("value").isNotNull() & ~F.isnan("value")).select("band", F.col("value").cast("double").alias("value"))
    shares = [min(1.0, max(0.0, p / 100 + s)) for p in (low, high) for s in (-SLACK, SLACK)]
    ends = v.groupBy("band").agg(F.percentile_approx("value", shares, ACCURACY).alias("e"), F.count(F.lit(1)).alias("n"))
    ends = ends.withColumns({"lo": percentile_rank(F.col("n"), low, False), "hi": percentile_rank(F.col("n"), high, True)})
    e, x = (lambda i: F.element_at("e", i + 1)), F.col("value")
    # a row a band is sent to the pixels; a value in both brackets counts in each
    zoned = v.join(F.broadcast(ends), "band")
    zones = []
    for zone, (a, b) in enumerate(((0, 1), (2, 3))):
        place = F.when(x < e(a), F.lit(float("-inf"))).otherwise(x)
        zones.append(F.when(x <= e(b), F.struct(F.lit(zone).alias("zone"), (x >= e(a)).alias("inside"), place.alias("v"))))
    found = zoned.select("band", "lo", "hi", F.explode(F.array_compact(F.array(*zones))).alias("z"))
    counts = found.groupBy("band", "z.zone", "z.inside", "z.v").agg(F.count(F.lit(1)).alias("c"), F.first(F.when(F.col("z.zone") == 0, F.col("lo")).otherwise(F.col("hi"))).alias("rank"))
    upto = F.sum("c").over(Window.partitionBy("band", "zone").orderBy("inside", "v"))
    held = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    return held.groupBy("band").agg(F.max(F.when(F.col("zone") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("zone") == 1, F.col("v"))).alias("high"))
