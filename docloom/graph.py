"""Document graphs as two DataFrames, and graphs derived from relational tables.

``nodes``: doc_id, id, node_type, props (map of strings), value (double), errors (array of strings).
``edges``: doc_id, src, dst, edge_type, ord.  Ids are unique within a document; every key holds doc_id, so
one plan serves any number of documents and no edge crosses from one to another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage

CHILD, REFERENCE = "Child", "Reference"
#: Ids of the tables' rows are shifted so that they stay apart within a document.
NATION, CUSTOMER, ORDER, PART, SUPPLIER = 100, 1_000_000, 100_000_000, 1_000_000_000, 2_000_000_000


@dataclass(frozen=True)
class Tables:
    """The Parquet tables of a folder, read when asked for."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Graph:
    """Nodes and edges of many documents."""

    nodes: DataFrame
    edges: DataFrame

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("node_type").isin(*types))

    def children(self) -> DataFrame:
        """Child edges alone."""
        return self.edges.where(F.col("edge_type") == CHILD)

    def references(self) -> DataFrame:
        return self.edges.where(F.col("edge_type") == REFERENCE)

    def stored(self) -> Graph:
        """The graph written once to the shared folder, for work that reads it many times."""
        return Graph(storage.table(self.nodes, "nodes"), storage.table(self.edges, "edges"))

    def roots(self) -> DataFrame:
        """Nodes that are no node's child."""
        below = self.children().select("doc_id", F.col("dst").alias("id"))
        return self.nodes.join(below, ["doc_id", "id"], "left_anti")


def _props(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def org_graph(t: Tables) -> Graph:
    """One document for each region: region, nations, customers and orders as a containment tree.

    The document of a customer or order follows from its nation, by a join with the fixed
    nation table.  ``ord`` numbers the children of a parent by id.
    """
    nation = t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").cast("long").alias("doc_id"))
    customers = t.customer.join(nation, F.col("c_nationkey") == F.col("nk"))
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, doc: Column, ident: Column, kind: str, parent: Column, props: Column, value: Column) -> DataFrame:
        return df.select(doc.alias("doc_id"), ident.cast("long").alias("id"), F.lit(kind).alias("node_type"), parent.cast("long").alias("parent"), props.alias("props"), value.cast("double").alias("value"), none.alias("errors"))

    owner = customers.select(F.col("c_custkey").alias("ck"), "doc_id")
    orders = t.orders.join(owner, F.col("o_custkey") == F.col("ck"))
    missing = F.lit(None)
    parts = [
        rows(t.region, F.col("r_regionkey").cast("long"), F.col("r_regionkey"), "region", missing, _props(name=F.col("r_name")), missing),
        rows(t.nation, F.col("n_regionkey").cast("long"), F.col("n_nationkey") + NATION, "nation", F.col("n_regionkey"), _props(name=F.col("n_name")), missing),
        rows(customers, F.col("doc_id"), F.col("c_custkey") + CUSTOMER, "customer", F.col("c_nationkey") + NATION, _props(name=F.col("c_name"), segment=F.col("c_mktsegment")), F.col("c_acctbal")),
        rows(orders, F.col("doc_id"), F.col("o_orderkey") + ORDER, "order", F.col("o_custkey") + CUSTOMER, _props(status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")), F.col("o_totalprice")),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("id"))
    edges = both.where("parent is not null").select("doc_id", F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit(CHILD).alias("edge_type"), place.alias("ord"))
    return Graph(both.drop("parent"), edges)


def reference_edges(t: Tables) -> DataFrame:
    """Reference edges of orders to the parts and suppliers of their lines, once each, in one document."""
    line = t.lineitem
    kinds = [(F.col("l_partkey") + PART, "part"), (F.col("l_suppkey") + SUPPLIER, "supplier")]
    both = line.select(F.col("l_orderkey").alias("o"), F.explode(F.array(*[d for d, _ in kinds])).alias("dst"))
    return both.distinct().select(F.lit(0).cast("long").alias("doc_id"), (F.col("o") + ORDER).alias("src"), "dst", F.lit(REFERENCE).alias("edge_type"))
