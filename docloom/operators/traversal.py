"""Traversals: closures, depths, paths and cycles.

A closure of known depth is a chain of joins, one lazy plan.  Without a bound, each level
is a join whose new pairs are written to the shared folder, so that neither plan nor
lineage grows, until no new pair is found; pairs met before are left out, so cycles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage

PAIR = ["doc_id", "start", "id"]


def closure(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, start, id, depth): what each seed reaches over edges (doc_id, src, dst), with the least number of steps.

    Each pair is there once, with or without a depth, whatever ways lead from one to the other.
    """
    own = edges.select("doc_id", F.col("src").alias("id"), "dst")
    at = seeds.select("doc_id", F.col("id").alias("start"), "id")
    step = lambda f: f.join(own, ["doc_id", "id"]).select("doc_id", "start", F.col("dst").alias("id"))
    if depth is not None:
        levels = []
        for d in range(1, depth + 1):
            at = step(at)
            levels.append(at.withColumn("depth", F.lit(d)))
        return reduce(DataFrame.unionByName, levels).groupBy(*PAIR).agg(F.min("depth").alias("depth"))
    seen, d = None, 0  # the pairs met so far, one table that is written anew with each level
    while True:
        d += 1
        new = step(at).distinct()
        if seen is not None:
            new = new.join(seen.select(*PAIR), PAIR, "left_anti")
        at = storage.table(new, "frontier")
        level = at.withColumn("depth", F.lit(d))
        if at.isEmpty():
            return seen if seen is not None else level
        before, seen = seen, storage.table(level if seen is None else seen.unionByName(level), "seen")
        if before is not None:
            storage.free(before)


def on_cycle(edges: DataFrame) -> DataFrame:
    """(doc_id, id) of nodes that reach themselves.

    Nodes that nothing leads to, and nodes that lead nowhere, are peeled off with their
    edges until none is left; what remains lies on cycles or between them.  Only there,
    the nodes that reach themselves are told from those between by a closure.
    """
    left = storage.table(edges.select("doc_id", "src", "dst").distinct(), "edges")
    n = left.count()
    while n:
        inner = left.join(left.select("doc_id", F.col("dst").alias("src")).distinct(), ["doc_id", "src"], "left_semi")
        inner = inner.join(left.select("doc_id", F.col("src").alias("dst")).distinct(), ["doc_id", "dst"], "left_semi").select("doc_id", "src", "dst")
        before, left = left, storage.table(inner, "edges")
        storage.free(before)
        if (more := left.count()) == n:
            break
        n = more
    starts = left.select("doc_id", F.col("src").alias("id")).distinct()
    return closure(left, starts).where("start = id").select("doc_id", "id").distinct()


def acyclic_layers(edges: DataFrame) -> DataFrame:
    """(doc_id, id, layer): the longest way down to each node, a topological order; nodes on or below cycles are left out.

    Layers are peeled: a node goes when all edges into it have gone.
    """
    layers, layer, left = [], 0, edges.select("doc_id", "src", "dst")
    nodes = storage.table(left.select("doc_id", F.explode(F.array("src", "dst")).alias("id")).distinct(), "nodes")
    while True:
        free = storage.table(nodes.join(left.select("doc_id", F.col("dst").alias("id")), ["doc_id", "id"], "left_anti"), "free")
        if free.isEmpty():
            break
        layers.append(free.withColumn("layer", F.lit(layer)))
        nodes = storage.table(nodes.join(free, ["doc_id", "id"], "left_anti"), "nodes")
        left = storage.table(left.join(free.select("doc_id", F.col("id").alias("src")), ["doc_id", "src"], "left_anti"), "edges")
        layer += 1
    return reduce(DataFrame.unionByName, layers) if layers else nodes.withColumn("layer", F.lit(0))


def depths(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, id, depth): least steps from any root, roots included at 0."""
    below = closure(edges, roots, depth).groupBy("doc_id", "id").agg(F.min("depth").alias("depth"))
    start = roots.select("doc_id", "id", F.lit(0).alias("depth"))
    return start.unionByName(below).groupBy("doc_id", "id").agg(F.min("depth").alias("depth"))


def paths_to_root(edges: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, id, path): ids from the root to each node, itself included."""
    up = edges.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    above = closure(up, nodes, depth)
    steps = above.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "id"))).alias("steps"))
    ids = F.transform("steps", lambda s: s["id"])
    own = nodes.select("doc_id", F.col("id").alias("start")).join(steps, ["doc_id", "start"], "left")
    return own.select("doc_id", F.col("start").alias("id"), F.concat(F.coalesce(ids, F.array().cast("array<long>")), F.array("start")).alias("path"))
