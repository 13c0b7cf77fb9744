"""Set algebra, differences, revisions and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revision_deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str, free: Column) -> DataFrame:
    """(keys, change) of the rows of a later revision: deleted where freed, added where new, modified where changed."""
    old = before.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_known"))
    known = F.coalesce(F.col("_known"), F.lit(False))
    change = F.when(free, "deleted").when(~known, "added").when(~F.col(value).eqNullSafe(F.col("_old")), "modified")
    return after.join(old, keys, "left").withColumn("change", change).where("change is not null").select(*keys, "change")


def timeline(revisions: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Each revision with the one before; the first has none."""
    return revisions.withColumn("before", F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def line_changes(pairs: DataFrame) -> DataFrame:
    """(pair_id, change, line, n) of (pair_id, old_text, new_text): lines that one text has more often."""
    count = lambda c: pairs.select("pair_id", F.explode(F.split(F.coalesce(F.col(c), F.lit("")), "\n")).alias("line")).groupBy("pair_id", "line").agg(F.count("*").alias(c))
    both = count("old_text").join(count("new_text"), ["pair_id", "line"], "full_outer")
    more = F.coalesce(F.col("new_text"), F.lit(0)) - F.coalesce(F.col("old_text"), F.lit(0))
    return both.withColumn("d", more).where("d <> 0").select("pair_id", F.when(F.col("d") > 0, "Insert").otherwise("Delete").alias("change"), "line", F.abs("d").alias("n"))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of fields that differ, nulls being values."""
    a = old.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    b = new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old_value"), F.col(f"n_{f}").alias("new_value")) for f in fields]))
    return a.join(b, key).select(key, each.alias("x")).select(key, "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def visible_layers(layers: DataFrame) -> DataFrame:
    """Layers (layer, base, on, off, radio) that are visible: base or on, not off, and of a radio group the smallest alone."""
    shown = layers.where((F.col("base") | F.col("on")) & ~F.col("off"))
    place = F.row_number().over(Window.partitionBy("radio").orderBy("layer"))
    grouped = shown.where("radio is not null").withColumn("_p", place).where("_p = 1").drop("_p")
    return shown.where("radio is null").unionByName(grouped)


def membership(policy: str, members: Column, visible: Column) -> Column:
    """Whether the visible ones among an array's members satisfy AllOn, AnyOn, AllOff or AnyOff; other policies always do."""
    on = lambda x: F.array_contains(visible, x)
    if policy == "AllOn":
        return F.forall(members, on)
    if policy == "AnyOn":
        return F.exists(members, on)
    if policy == "AllOff":
        return F.forall(members, lambda x: ~on(x))
    if policy == "AnyOff":
        return F.exists(members, lambda x: ~on(x))
    return F.lit(True)


def with_provenance(rows: DataFrame, stage: str, steps: str = "steps") -> DataFrame:
    """Rows that any step of their history matches."""
    return rows.where(F.exists(steps, lambda s: s == stage))
