"""Session settings for cube work."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that don't depend on the cluster. Partition counts and memory are the cluster's own.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python data sources get filters only with this
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "lumenfield", **settings: str) -> SparkSession:
    """A session with SETTINGS and the cube data source registered."""
    from .sources.envi import CubeDataSource

    spark = SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
    spark.dataSource.register(CubeDataSource)
    return spark
