"""Order-sensitive operators: islands, change logs, missing ends, caches and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Numbers runs of rows: ``breaks`` may use ``previous(c)`` and tells where a new run begins."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("_new").over(w)).drop("_new")


def previous(column: str, by: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def following(column: str, by: list[str], order: list[str]) -> Column:
    return F.lead(column).over(Window.partitionBy(*by).orderBy(*order))


def merged_ranges(rows: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Adjacent and overlapping ranges of each group as one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    return marked.withColumn("_run", F.sum("_new").over(w)).groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def unended(rows: DataFrame, by: list[str], order: list[str], kind: str, begin: str, end: str) -> DataFrame:
    """Begin marks whose next mark of either kind is not an end."""
    marks = rows.where(F.col(kind).isin(begin, end))
    return marks.withColumn("_next", following(kind, by, order)).where((F.col(kind) == begin) & ~F.coalesce(F.col("_next") == end, F.lit(False))).drop("_next")


def least_recently_used(rows: DataFrame, by: list[str], key: str, at: str, tie: str, capacity: int) -> DataFrame:
    """What a cache of so many keys holds at the end of each group's accesses."""
    last = rows.groupBy(*by, key).agg(F.max(F.struct(at, tie)).alias("last"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("last"), key))
    return last.withColumn("place", place).where(F.col("place") <= capacity).select(*by, key, "place")


def first_per_group(rows: DataFrame, by: list[str], order: list[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before it shuffles."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
