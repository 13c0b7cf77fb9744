"""Structural validation: profiles of rules over graphs that give issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .rules import Rule, compliance, findings, report


def structure_rules() -> list[Rule]:
    """On one row for each document: counts of nodes, roots, edges and dangling edges."""
    c = F.col
    return [
        Rule("EMPTY_DOCUMENT", "Critical", c("n_nodes") == 0),
        Rule("NO_ROOT", "Critical", c("n_roots") == 0),
        Rule("MULTIPLE_ROOTS", "Error", c("n_roots") > 1),
        Rule("DANGLING_EDGE", "Error", c("n_dangling") > 0),
        Rule("NO_CHILDREN", "Warning", (c("n_nodes") > 0) & (c("n_edges") == 0)),
    ]


def summary(g: Graph) -> DataFrame:
    """(doc_id, n_nodes, n_edges, n_roots, n_dangling)."""
    nodes = g.nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    edges = g.children().groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    roots = g.roots().groupBy("doc_id").agg(F.count("*").alias("n_roots"))
    target = g.nodes.select("doc_id", F.col("id").alias("dst"))
    loose = g.edges.join(target, ["doc_id", "dst"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_dangling"))
    both = nodes
    for other in (edges, roots, loose):
        both = both.join(other, "doc_id", "left")
    return both.fillna(0)


def validate(g: Graph) -> DataFrame:
    """The report of each document under the structure profile, with its compliance."""
    rows = summary(g)
    done = report(findings(rows, structure_rules(), "doc_id"), rows, "doc_id")
    return done.withColumn("status", compliance(F.col("valid"), F.col("n_warning")))


def missing_properties(nodes: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(doc_id, id, node_type, property) of required properties that are absent or empty."""
    kinds = F.create_map(*[x for t, keys in required.items() for x in (F.lit(t), F.array(*map(F.lit, keys)))])
    each = nodes.where(F.col("node_type").isin(*required)).select("doc_id", "id", "node_type", "props", F.explode(F.try_element_at(kinds, F.col("node_type"))).alias("property"))
    value = F.try_element_at("props", F.col("property"))
    return each.where(value.isNull() | (value == "")).drop("props")


def count_mismatch(stated: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """(key, stated, counted) where a stated count differs from what is there; nothing there counts as 0."""
    both = stated.join(counted, key, "left").select(key, "stated", F.coalesce("counted", F.lit(0)).alias("counted"))
    return both.where(~F.col("stated").eqNullSafe(F.col("counted")))


def permissions(flags: Column) -> Column:
    """Permission bits as a struct: print, modify, copy, annotate, fill, extract, assemble, print well."""
    bits = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill": 9, "extract": 10, "assemble": 11, "print_high": 12}
    return F.struct(*[(F.shiftright(flags, bit - 1).bitwiseAND(1) == 1).alias(name) for name, bit in bits.items()])
