"""Selecting nodes: each function takes DataFrames and returns a lazy DataFrame of (doc_id, id).

Selections combine as ordinary DataFrames; conditions on one node are column predicates,
so that Catalyst fuses and pushes them down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from . import traversal

KEY = ["doc_id", "id"]


def select(g: Graph, *conditions: Column) -> DataFrame:
    """Nodes for which all conditions hold."""
    return g.nodes.where(reduce(lambda a, b: a & b, conditions, F.lit(True))).select(KEY)


def is_type(name: str) -> Column:
    return F.col("node_type") == name


def has_id(ident: int) -> Column:
    return F.col("id") == ident


def has_property(key: str) -> Column:
    return F.try_element_at("props", F.lit(key)).isNotNull()


def property_equals(key: str, value: str) -> Column:
    return F.try_element_at("props", F.lit(key)) == value


def property_matches(key: str, pattern: str) -> Column:
    return F.try_element_at("props", F.lit(key)).rlike(pattern)


def has_errors() -> Column:
    return F.size("errors") > 0


def children_of(g: Graph, parents: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Children of the parents, that are among the given nodes if any are given."""
    up = parents.select("doc_id", F.col("id").alias("src")).distinct()
    found = g.children().join(up, ["doc_id", "src"], "left_semi").select("doc_id", F.col("dst").alias("id"))
    return found if among is None else found.join(among, KEY, "left_semi")


def parents_of(g: Graph, nodes: DataFrame) -> DataFrame:
    down = nodes.select("doc_id", F.col("id").alias("dst"))
    return g.children().join(down, ["doc_id", "dst"], "left_semi").select("doc_id", F.col("src").alias("id")).distinct()


def descendants_of(g: Graph, ancestors: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, start, id, depth): everything below each of the ancestors."""
    return traversal.closure(g.children(), ancestors, depth)


def ancestors_of(g: Graph, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, start, id, depth): everything above each of the nodes."""
    up = g.children().select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traversal.closure(up, nodes, depth)


def siblings_of(g: Graph, nodes: DataFrame) -> DataFrame:
    """Other children of the nodes' parents, once each."""
    own = g.children().select("doc_id", "src", F.col("dst").alias("own"))
    own = own.join(nodes.select("doc_id", F.col("id").alias("own")), ["doc_id", "own"], "left_semi")
    # of a parent it is enough to know one chosen child, and whether there are more
    chosen = own.groupBy("doc_id", "src").agg(F.min("own").alias("one"), F.max("own").alias("other"))
    found = g.children().join(chosen, ["doc_id", "src"]).where((F.col("dst") != F.col("one")) | (F.col("dst") != F.col("other")))
    return found.select("doc_id", F.col("dst").alias("id")).distinct()


def both(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [f.select(KEY) for f in found])


def either(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [f.select(KEY) for f in found]).distinct()


def none_of(g: Graph, found: DataFrame) -> DataFrame:
    return g.nodes.select(KEY).join(found, KEY, "left_anti")


def child_range(g: Graph, start: int, end: int) -> DataFrame:
    """(doc_id, src, id) of each parent's children at 0-based places start to end, end left out; no place if end <= start."""
    return g.children().where((F.col("ord") > start) & (F.col("ord") <= end)).select("doc_id", "src", F.col("dst").alias("id"))


def first_child(g: Graph) -> DataFrame:
    return child_range(g, 0, 1)


def last_child(g: Graph) -> DataFrame:
    """A partial aggregate in place of a second sort."""
    return g.children().groupBy("doc_id", "src").agg(F.max_by("dst", "ord").alias("id"))


def path(g: Graph, start: DataFrame, *steps: Column) -> DataFrame:
    """From the start down one Child edge for each condition."""
    at = start
    for condition in steps:
        at = children_of(g, at, select(g, condition))
    return at
