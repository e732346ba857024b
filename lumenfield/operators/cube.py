"""A cube as DataFrames: tiles, composites, spectra, probes, statistics."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, stretch, tiles
from ..sources.header import Header
from . import stats


def wide_of(pixels: DataFrame, bands: list[int], names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """One row a pixel with the bands side by side: one conditional aggregate, not a join a band."""
    return pixels.where(F.col("band").isin(sorted(set(bands)))).groupBy("x", "y").agg(*(F.max(F.when(F.col("band") == b, F.col("value"))).alias(n) for b, n in zip(bands, names, strict=True)))


def window(df: DataFrame, tx: int, ty: int, size: int, samples: int, lines: int) -> DataFrame:
    """Rows of a tile; edge tiles are clipped and tiles outside are empty."""
    x1, y1 = min((tx + 1) * size, samples), min((ty + 1) * size, lines)
    return df.where((F.col("x") >= max(0, tx * size)) & (F.col("x") < x1) & (F.col("y") >= max(0, ty * size)) & (F.col("y") < y1))


def rgb(wide: DataFrame, limits: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(x, y, r, g, b, a) of 0..255 from (x, y, r, g, b) values and each channel's stretch limits."""
    channel = lambda c: stretch.quantise(stretch.stretch(F.col(c), *limits[c])).alias(c)
    return wide.select("x", "y", *map(channel, "rgb"), F.lit(255).alias("a"))


@dataclass
class Cube:
    """A cube's header and its relations.

    pixels has rows (x, y, band, value). wide, if there is one, has (x, y, spectrum) and answers
    per-pixel questions without a shuffle, as a file stored by pixel does. A cube in files has the
    data source's options, and each operation reads only its own bands and lines.
    """

    header: Header
    pixels: DataFrame
    wide: DataFrame | None = None
    stored: dict[int, tuple[float, float] | None] = field(default_factory=dict)
    options: dict[str, str] | None = None

    @classmethod
    def load(cls, spark: SparkSession, header: str, data: str, **options: str) -> Cube:
        from ..sources.envi import CubeDataSource
        from ..sources.header import parse
        from ..sources.ranges import open_bytes

        spark.dataSource.register(CubeDataSource)
        options = {"header": header, "data": data} | options
        return cls(parse(open_bytes(header).read_all().decode("utf-8", "replace")), spark.read.format("cube").options(**options).load(), options=options)

    def cells(self, bands: list[int] | None = None, y0: int = 0, y1: int | None = None, **options: str) -> DataFrame:
        """Pixels of some bands (all if None) and lines. From files, only those are read."""
        y1 = self.header.lines if y1 is None else min(y1, self.header.lines)
        if self.options is not None:
            if y0 >= y1 or bands == []:
                return self.pixels.where(F.lit(False))
            own = self.options | options | {"y0": str(y0), "y1": str(y1)} | ({} if bands is None else {"bands": ",".join(map(str, sorted(set(bands))))})
            return self.pixels.sparkSession.read.format("cube").options(**own).load()
        p = self.pixels if bands is None else self.pixels.where(F.col("band").isin(sorted(set(bands))))
        return p if (y0, y1) == (0, self.header.lines) else p.where((F.col("y") >= y0) & (F.col("y") < y1))

    @property
    def affine(self) -> Column:
        """The header's transform as a literal array, or null: it is worked out once, not for each row."""
        if self.header.map_info is None:
            return F.lit(None).cast("array<double>")
        info = self.pixels.sparkSession.range(1).select(geo.map_info(F.when(F.col("id") >= 0, self.header.map_info)).alias("info"))
        row = info.select(geo.affine_of(F.col("info"))).first()[0]
        return F.lit(None).cast("array<double>") if row is None else F.array(*map(F.lit, row))

    # -- reading ---------------------------------------------------------------------------------

    def band(self, number: int) -> DataFrame:
        self.check(number)
        if self.wide is not None:
            return self.wide.select("x", "y", F.lit(number).alias("band"), F.element_at("spectrum", number).alias("value"))
        return self.cells([number])

    def check(self, *numbers: int) -> None:
        for n in numbers:
            if not isinstance(n, int) or isinstance(n, bool):
                raise TypeError("bands are integers")
            if not 1 <= n <= self.header.bands:
                raise IndexError(f"bands are between 1 and {self.header.bands}")

    def channels(self, r: int, g: int, b: int, y0: int = 0, y1: int | None = None) -> DataFrame:
        self.check(r, g, b)
        if self.wide is not None:
            return self.wide.select("x", "y", *(F.element_at("spectrum", n).alias(c) for c, n in (("r", r), ("g", g), ("b", b))))
        return wide_of(self.cells([r, g, b], y0, y1), [r, g, b])

    def tile(self, number: int, tx: int, ty: int, size: int = tiles.TILE) -> DataFrame:
        self.check(number)
        own = self.band(number) if self.options is None else self.cells([number], max(0, ty * size), (ty + 1) * size)
        return window(own, tx, ty, size, self.header.samples, self.header.lines)

    def spectrum(self, x: int, y: int) -> DataFrame:
        """(band, value) of a pixel, a row a band; an absent cell counts 0. A pixel outside is an error."""
        if not (0 <= x < self.header.samples and 0 <= y < self.header.lines):
            raise IndexError("the pixel is outside the cube")
        spark = self.pixels.sparkSession
        own = self.cells(None, y, y + 1).where(F.col("x") == x).select("band", "value")
        every = spark.range(1, self.header.bands + 1).select(F.col("id").cast("int").alias("band"))
        return every.join(own, "band", "left").select("band", F.coalesce("value", F.lit(0.0).cast("float")).alias("value"))

    def wavelengths(self) -> DataFrame:
        w = list(self.header.wavelength or ())
        return self.pixels.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(w)], "band int, wavelength double")

    def profile(self, x: int, y: int) -> DataFrame:
        """The spectrum with wavelengths, or with band numbers if there isn't one for each band."""
        s = self.spectrum(x, y)
        if len(self.header.wavelength or ()) != self.header.bands:
            return s.select("band", F.col("band").cast("double").alias("wavelength"), "value")
        return s.join(F.broadcast(self.wavelengths()), "band").select("band", "wavelength", "value")

    def probe(self, x: int, y: int) -> DataFrame:
        """One row about a pixel: world coordinates and spectrum; no row outside the cube."""
        if not (0 <= x < self.header.samples and 0 <= y < self.header.lines):
            return self.pixels.sparkSession.createDataFrame([], "x int, y int, world struct<x:double,y:double>, spectrum array<struct<band:int,wavelength:double,value:float>>")
        s = self.spectrum(x, y).join(F.broadcast(self.wavelengths()), "band", "left")
        w = F.when(stretch.is_finite(F.col("wavelength")), F.col("wavelength"))
        row = s.agg(F.sort_array(F.collect_list(F.struct("band", w.alias("wavelength"), "value"))).alias("spectrum"))
        return row.select(F.lit(x).alias("x"), F.lit(y).alias("y"), geo.pixel_to_world(self.affine, F.lit(x), F.lit(y)).alias("world"), "spectrum")

    # -- statistics and composites ---------------------------------------------------------------

    def band_stats(self, bands: list[int] | None = None, count: int = tiles.SAMPLED, size: int = tiles.TILE, permissive: bool = False) -> DataFrame:
        """Stretch limits of bands (all if None) from the fixed sample of tiles.

        Permissive: a tile of which something can't be read is passed over, and a band whose tiles
        all are has no row; failures() tells why.
        """
        sampled = tiles.sample_tiles(self.header.samples, self.header.lines, size, count)
        if self.options is None:
            return stats.band_stats(self.cells(bands), sampled, size)
        # a scan a row of tiles reads the lines of its tiles and no others
        scans = [stats.in_tiles(scan, [t for t in sampled if t[1] == ty], size) for ty, scan in self.sampled_rows(bands, sampled, size, permissive)]
        limits = stats.chunk_limits(functools.reduce(DataFrame.unionByName, scans))
        if permissive:
            # a row a broken strip of the sample, against a row a band and tile
            broken = self.failures(bands, count, size).select(F.col("ty").alias("broken_ty"), F.col("band").alias("broken_band"))
            limits = limits.join(F.broadcast(broken), (F.col("ty") == F.col("broken_ty")) & (F.col("broken_band").isNull() | (F.col("band") == F.col("broken_band"))), "left_anti")
        return stats.envelope_of(limits)

    def first_stats(self, bands: list[int], size: int = tiles.TILE) -> DataFrame:
        """Limits for a first view: from the first tiles of the sample, broken ones passed over."""
        return self.band_stats(bands, tiles.SAMPLED_FIRST, size, permissive=self.options is not None)

    def failures(self, bands: list[int] | None = None, count: int = tiles.SAMPLED, size: int = tiles.TILE) -> DataFrame:
        """(ty, y, band, error) of each strip of the sampled tiles' lines that can't be read; band is null for all bands."""
        if self.options is None:
            raise ValueError("only a cube in files can't be read")
        sampled = tiles.sample_tiles(self.header.samples, self.header.lines, size, count)
        scans = [scan.where("error is not null").select(F.lit(ty).alias("ty"), "y", "band", "error") for ty, scan in self.sampled_rows(bands, sampled, size, True)]
        return functools.reduce(DataFrame.unionByName, scans)

    def sampled_rows(self, bands: list[int] | None, sampled: list[tuple[int, int]], size: int, permissive: bool) -> list[tuple[int, DataFrame]]:
        """Each row of sampled tiles and a scan of its lines."""
        more = {"mode": "permissive"} if permissive else {}
        return [(ty, self.cells(bands, ty * size, (ty + 1) * size, **more)) for ty in sorted({ty for _, ty in sampled})]

    def keep_stats(self, bands: list[int], **options) -> dict[int, tuple[float, float] | None]:
        """Limits of bands on the driver (two numbers a band), computing only those not kept yet."""
        missing = [b for b in dict.fromkeys(bands) if b not in self.stored]
        if missing:
            got = {r.band: (r.min, r.max) for r in self.band_stats(missing, **options).collect()}
            self.stored |= {b: got.get(b) for b in missing}
        return {b: self.stored[b] for b in bands}

    def composite(self, r: int, g: int, b: int, tile: tuple[int, int] | None = None, size: int = tiles.TILE, count: int = 5) -> DataFrame:
        """Stretched (x, y, r, g, b, a), of a tile or of the whole cube; empty if a band has no limits."""
        kept = self.keep_stats([r, g, b], count=count, size=size)
        wide = self.channels(r, g, b) if tile is None else self.channels(r, g, b, max(0, tile[1] * size), (tile[1] + 1) * size)
        if tile is not None:
            wide = window(wide, *tile, size, self.header.samples, self.header.lines)
        if any(kept[n] is None for n in (r, g, b)):
            wide = wide.where(F.lit(False))
        own = {c: tuple(map(F.lit, kept[n] or (0.0, 0.0))) for c, n in (("r", r), ("g", g), ("b", b))}
        return rgb(wide, own)

    def with_world(self, df: DataFrame) -> DataFrame:
        return df.withColumn("world", geo.pixel_to_world(self.affine, F.col("x"), F.col("y")))

    def with_pixel(self, df: DataFrame, wx: str, wy: str) -> DataFrame:
        return df.withColumn("pixel", geo.world_to_pixel(self.affine, F.col(wx), F.col(wy)))

    def metadata(self, size: int | None = None) -> DataFrame:
        h = self.header
        return self.pixels.sparkSession.createDataFrame([(h.samples, h.lines, h.bands, h.interleave.upper(), h.data_type, h.byte_order.upper(), size)], "samples int, lines int, bands int, interleave string, data_type string, byte_order string, file_size long")

    def summary(self) -> DataFrame:
        """metadata() with the source's name and kind (memory, local, parts or http); a cube in files has its size in bytes."""
        from ..sources.ranges import name_of, open_bytes

        data = (self.options or {}).get("data")
        source = open_bytes(data, {k.removeprefix("http."): v for k, v in self.options.items() if k.startswith("http.")}) if data else None
        named = self.metadata(source.size() if source else None)
        return named.select(F.lit(name_of(data) if data else "cube").alias("name"), F.lit(source.kind if source else "memory").alias("kind"), *named.columns)

    def unpersist(self) -> None:
        self.stored.clear()
        for df in (self.pixels, self.wide):
            if df is not None:
                df.unpersist()
