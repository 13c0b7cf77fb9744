"""Resolving references and merging what they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reference edges with the nodes that they lead to; dangling ones are left out."""
    target = nodes.select("doc_id", F.col("id").alias("dst"), "node_type", "props")
    return edges.join(target, ["doc_id", "dst"])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reference edges that lead to no node."""
    return edges.join(nodes.select("doc_id", F.col("id").alias("dst")), ["doc_id", "dst"], "left_anti")


def reference_integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, broken ones, and the share that resolves (1 if there are none)."""
    known = nodes.select("doc_id", F.col("id").alias("dst"), F.lit(True).alias("known")).distinct()
    found = edges.join(known, ["doc_id", "dst"], "left").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("broken"))
    return found.withColumn("integrity", F.when(F.col("total") > 0, 1 - F.col("broken") / F.col("total")).otherwise(1.0))


def within(rows: DataFrame, key: Column, bands: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Rows with the band whose limits, both included, hold their key: a range join on integer keys.

    Bands are cut into unit steps, which turns the range into an equality; they must be few.
    """
    steps = bands.withColumn("_key", F.explode(F.sequence(F.col(low), F.col(high))))
    return rows.withColumn("_key", key).join(steps, "_key").drop("_key")


def merged_map(parent: Column, child: Column) -> Column:
    """Both maps' entries; where both have a key the child's value counts."""
    return F.map_zip_with(F.coalesce(parent, F.create_map().cast("map<string,string>")), F.coalesce(child, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))


def full_outer_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with the change from old to new: Added, Removed, Modified or Same."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "Added").when(F.col("_new").isNull(), "Removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "Modified").otherwise("Same")
    return a.join(b, keys, "full_outer").select(*keys, "old_value", "new_value", change.alias("change"))
