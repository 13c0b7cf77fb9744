"""Queries by name, with the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..graph import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of the tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


#: The containment tree of ``graph.org_graph`` in SQL: nodes ``n`` and Child edges ``e``.
ORG = """
WITH n AS (
  SELECT r_regionkey::BIGINT AS doc_id, r_regionkey::BIGINT AS id, 'region' AS node_type, NULL::BIGINT AS parent, r_name AS name, NULL AS tag, NULL::DOUBLE AS value FROM region
  UNION ALL SELECT n_regionkey, 100 + n_nationkey, 'nation', n_regionkey, n_name, NULL, NULL FROM nation
  UNION ALL SELECT n_regionkey, 1000000 + c_custkey, 'customer', 100 + c_nationkey, c_name, c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey, 100000000 + o_orderkey, 'order', 1000000 + o_custkey, NULL, o_orderstatus, o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT doc_id, parent AS src, id AS dst, row_number() OVER (PARTITION BY doc_id, parent ORDER BY id) AS ord FROM n WHERE parent IS NOT NULL)
"""
