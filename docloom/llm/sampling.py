"""Bounded samples that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hash(rows: DataFrame, key: str, bound: int, total: int) -> DataFrame:
    """At most ``bound`` of about ``total`` rows: those of smallest key hash.

    A first cut by the hash alone leaves about twice as many, so that the sort that
    follows gets a bounded number of rows from all tasks together.
    """
    digest = F.xxhash64(key)
    if total > 2 * bound:
        rows = rows.where(digest < int(-(2**63) + 2**64 * (2 * bound / total)))
    return rows.orderBy(digest, key).limit(bound)
