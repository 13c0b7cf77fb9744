"""Incremental counterparts: file streams, windows under a watermark, and late binding by stream-stream joins.

Each run takes what is there and ends; its state and progress lie in the shared folder, so
a run that is started again goes on from where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream to its present end into Parquet and reads that."""
    spark, schema = stream.sparkSession, stream.schema
    out = storage.path(spark, name)
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", storage.path(spark, f"{name}-progress")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def latest(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregate to its present end and reads its last complete state."""
    spark, schema = stream.sparkSession, stream.schema
    out = storage.path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", storage.path(spark, f"{name}-progress")).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def type_counts(stream: DataFrame, kind: str) -> DataFrame:
    return stream.groupBy(kind).agg(F.count("*").alias("n"))


def tumbling(stream: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by window, given out once the watermark has passed the window's end."""
    own = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return own.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def sessions(stream: DataFrame, at: str, gap: str, late: str, *by: str) -> DataFrame:
    """Counts by session, given out once the watermark has passed the session's end."""
    own = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return own.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def late_binding(references: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """References with their targets, whichever arrives first; give both a watermark where they never end."""
    return references.join(targets, on)
