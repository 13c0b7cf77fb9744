"""Rules as data: a name, a severity and a condition; each rule that holds for a row is a finding row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``when`` is a condition on one row; nulls count as not holding."""

    code: str
    severity: str
    when: Column


def findings(rows: DataFrame, rules: list[Rule], *keys: str) -> DataFrame:
    """(keys, code, severity): a row for each rule that holds, from one pass over the rows."""
    hits = F.array(*[F.when(r.when, F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules])
    return rows.select(*keys, F.explode(F.array_compact(hits)).alias("f")).select(*keys, "f.*")


def counts(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(code, severity, n) of every rule, those that nothing meets too: conditional counts in one aggregate."""
    one = rows.agg(*[F.count_if(F.coalesce(r.when, F.lit(False))).alias(f"c{i}") for i, r in enumerate(rules)])
    each = F.array(*[F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.col(f"c{i}").alias("n")) for i, r in enumerate(rules)])
    return one.select(F.explode(each).alias("x")).select("x.*")


def report(found: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """(key, n_critical, n_error, n_warning, n_info, valid): valid where there is no error or worse; subjects without findings too."""
    n = lambda s: F.count_if(F.col("severity") == s)
    by = found.groupBy(key).agg(n("Critical").alias("n_critical"), n("Error").alias("n_error"), n("Warning").alias("n_warning"), n("Info").alias("n_info"))
    names = ["n_critical", "n_error", "n_warning", "n_info"]
    all_of = subjects.select(key).join(by, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return all_of.withColumn("valid", (F.col("n_critical") == 0) & (F.col("n_error") == 0))


def compliance(valid: Column, warnings: Column) -> Column:
    return F.when(~valid, "NonCompliant").when(warnings > 0, "PartiallyCompliant").otherwise("Compliant")
