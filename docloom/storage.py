"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    if not _written:
        atexit.register(_clear)
    where = f"{folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, where))
    return where


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows and reads them again, which cuts the plan: a lost executor costs no more than a read.

    The shuffle files of the write are deleted when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(where := path(spark, name))
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(where)


def free(*tables: DataFrame) -> None:
    """Deletes what ``table`` wrote for these, once nothing reads them any more: a loop's superseded steps."""
    for df in tables:
        files = df.inputFiles()
        for spark, where in [w for w in _written if any(w[1] in f for f in files)]:
            _delete(spark, where)
            _written.remove((spark, where))


def _delete(spark: SparkSession, where: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(where)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _clear() -> None:
    for spark, where in _written:
        try:
            _delete(spark, where)
        except Exception:  # the session may have ended before the driver does
            return
