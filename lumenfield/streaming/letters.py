"""Messages to a table, those that can't be taken to a dead-letter table, and how far it has come.

Each batch of the stream writes three folders named by its number, overwriting them: a batch that is
played again after a failure leaves every row once, in all three tables. Progress is counted while
the messages are written, by observation, so it costs no pass of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .messages import PROTOCOL

PROGRESS = "batch long, processed long, dead long"


def routed(messages: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start writing messages (with protocol_version) to folder/messages, folder/dead and folder/progress."""

    def batch(df: DataFrame, number: int) -> None:
        ok = F.coalesce(F.col("protocol_version") == PROTOCOL, F.lit(False))
        seen = Observation()
        marked = df.withColumn("__dead", ~ok).observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if("__dead").alias("dead"))
        # one pass: the flag is the folder
        marked.write.mode("overwrite").partitionBy("__dead").parquet(f"{folder}/parts/batch={number}")
        got = seen.get
        df.sparkSession.createDataFrame([(number, got["processed"], got["dead"])], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")

    w = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def letters(spark, folder: str, schema, dead: bool) -> DataFrame:
    """The messages that were taken, or the dead ones, with their batch."""
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    whole = StructType([*schema.fields, StructField("batch", LongType()), StructField("__dead", BooleanType())])
    return spark.read.schema(whole).option("basePath", f"{folder}/parts").parquet(f"{folder}/parts").where(F.col("__dead") == dead).drop("__dead")


def progress(spark, folder: str) -> DataFrame:
    """(batch, processed, dead, total, total_dead): what each batch brought, and all up to it."""
    from pyspark.sql import Window

    upto = Window.orderBy("batch")  # a row a batch
    p = spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").parquet(f"{folder}/progress")
    return p.withColumn("total", F.sum("processed").over(upto)).withColumn("total_dead", F.sum("dead").over(upto))
