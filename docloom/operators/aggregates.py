"""Roll-ups, histograms, percentiles and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def type_counts(nodes: DataFrame, kind: str = "node_type") -> DataFrame:
    return nodes.groupBy(kind).agg(F.count("*").alias("n"))


#: How far to either side of a percentile its bracket reaches, and the accuracy of the approximation, whose error is far less.
BRACKET, ACCURACY = 0.002, 10_000


def nearest_rank(rows: DataFrame, value: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """(by, percent, value): the value at place (n - 1) * percent / 100, rounded down, of the sorted values.

    Exact, and without sorting a whole group: mergeable approximate percentiles bracket each
    place, values below the bracket are counted, and only those inside it are put in order.
    A group so small that a bracket spans under two places is put in order from its least value.
    """
    own = rows.where(F.col(value).isNotNull())
    if not by:
        return nearest_rank(own.withColumn("_all", F.lit(1)), value, percents, ["_all"]).drop("_all")
    ends = [min(1.0, max(0.0, p / 100 + d)) for p in percents for d in (-BRACKET, BRACKET)]
    known = own.groupBy(*by).agg(F.count("*").alias("_total"), F.percentile_approx(value, ends, ACCURACY).alias("_q"))
    each = [F.struct(F.lit(p).alias("percent"), F.when(F.col("_total") * BRACKET >= 2, F.col("_q")[2 * i]).alias("low"), F.col("_q")[2 * i + 1].alias("high")) for i, p in enumerate(percents)]
    brackets = known.select(*by, "_total", F.array(*each).alias("_b"))
    placed = own.select(*by, F.col(value).alias("value")).join(brackets, by).select(*by, "value", "_total", F.explode("_b").alias("b"))
    placed = placed.where("value <= b.high").select(*by, "_total", "b.percent", F.when(F.col("b.low").isNull() | (F.col("value") >= F.col("b.low")), F.col("value")).alias("value"))
    counts = placed.groupBy(*by, "percent", "_total", "value").agg(F.count("*").alias("c"))  # a null value stands for all below
    running = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "percent").orderBy(F.asc_nulls_first("value"))))
    place = F.floor((F.col("_total") - 1) * F.col("percent") / 100)
    return running.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))).select(*by, "percent", "value")


def predominant(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """The most frequent kind of each group; ties go to the smaller name."""
    counts = rows.groupBy(*by, kind).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max("n").alias("n"))
    return counts.join(best, [*by, "n"]).groupBy(*by).agg(F.min(kind).alias(kind), F.max("n").alias("n"))


#: What a finding of each severity weighs, the highest score, and the levels' upper ends.
SEVERITY_WEIGHT = {"Critical": 100, "High": 50, "Medium": 20, "Low": 5}
MOST_RISK = 1000
RISK_LEVELS = [(20, "LOW"), (100, "MEDIUM"), (200, "HIGH")]


def weight(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv]), severity), F.lit(0))


def risk(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, score, level, safe) from findings with a severity."""
    score = F.least(F.sum(weight(F.col("severity"))), F.lit(MOST_RISK)).cast("long")
    grave = F.bool_or(F.col("severity").isin("Critical", "High"))
    level = F.lit("CRITICAL")
    for most, name in reversed(RISK_LEVELS):
        level = F.when(F.col("score") <= most, name).otherwise(level)
    found = findings.groupBy(by).agg(score.alias("score"), grave.alias("grave"))
    return found.select(by, "score", level.alias("level"), ((F.col("score") <= 20) & ~F.col("grave")).alias("safe"))


def health(integrity: Column, missing: dict[str, tuple[Column, float]], critical: Column, errors: Column) -> tuple[Column, Column]:
    """(score, band): integrity less a penalty for each missing part and each finding."""
    score = integrity
    for absent, penalty in missing.values():
        score = score - F.when(absent, penalty).otherwise(0.0)
    score = F.round(score - critical * 0.2 - errors * 0.1, 6)
    band = F.when(score >= 0.9, "Healthy").when(score >= 0.7, "PartiallyRecovered").when(score >= 0.4, "Damaged").otherwise("SeverelyDamaged")
    return score, band


def similarity(changes: Column, nodes: Column, pages: Column) -> Column:
    """One less the changes' share of a document's size, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - changes / (nodes + pages + 10)))


def accessibility(errors: Column, warnings: Column) -> tuple[Column, Column]:
    """(score, level) of an accessibility check."""
    score = F.greatest(F.lit(0.0), 1 - (0.5 * errors + 0.2 * warnings) / 10)
    clean = errors == 0
    level = F.when(clean & (warnings == 0), "AAA").when(clean & (warnings <= 5), "AA").when(errors <= 2, "A").otherwise("NonCompliant")
    return score, level
