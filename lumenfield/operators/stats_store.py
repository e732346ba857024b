"""A table of stretch limits by source and band, filled as bands are asked for.

The table is a folder of Parquet files, a folder a source and, in it, one for each set of bands that
was worked out together. A set's folder is named by its bands and overwritten, so a call that is run
twice or again after a failure leaves the same rows. A band without limits is kept too, with nulls,
and isn't worked out again. Sources are positive numbers; others keep nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ranges import store_of
from .cube import Cube

LIMITS = "band int, min double, max double"


@dataclass(frozen=True)
class StatsStore:
    spark: SparkSession
    folder: str

    def of(self, source_id: int) -> DataFrame:
        """What is known of a source: LIMITS."""
        store, inside = store_of(f"{self.folder}/source={source_id}")
        if source_id <= 0 or store.get_file_info(inside).type == fs.FileType.NotFound:
            return self.spark.createDataFrame([], LIMITS)
        # two calls may have worked out a band at the same time
        return self.spark.read.schema(LIMITS).option("recursiveFileLookup", "true").parquet(f"{self.folder}/source={source_id}").dropDuplicates(["band"])

    def missing(self, source_id: int, bands: list[int]) -> list[int]:
        """The bands that aren't known, each once and in order; a few numbers."""
        known = {r.band for r in self.of(source_id).select("band").collect()}
        return [b for b in dict.fromkeys(bands) if b not in known]

    def ensure(self, source_id: int, cube: Cube, bands: list[int], **options) -> DataFrame:
        """LIMITS of bands, working out only those not known yet."""
        cube.check(*bands)
        todo = self.missing(source_id, bands)
        if todo:
            every = self.spark.createDataFrame([(b,) for b in todo], "band int")
            rows = every.join(cube.band_stats(todo, **options), "band", "left").select("band", F.col("min").cast("double"), F.col("max").cast("double"))
            if source_id <= 0:
                return rows
            name = hashlib.sha256(",".join(map(str, sorted(todo))).encode()).hexdigest()[:16]
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/source={source_id}/bands={name}")
        return self.of(source_id).where(F.col("band").isin(bands))

    def unload(self, source_id: int) -> bool:
        """Forget a source; whether there was one."""
        store, inside = store_of(f"{self.folder}/source={source_id}")
        there = store.get_file_info(inside).type != fs.FileType.NotFound
        if there:
            store.delete_dir(inside)
        return there
