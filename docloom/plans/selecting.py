"""Selections over the containment tree of regions, nations, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Tables, org_graph
from ..operators import selectors as s
from ..operators import traversal
from .registry import ORG, query


@query(ORG + "SELECT doc_id, id FROM n WHERE node_type = 'nation'")
def sel_type(t: Tables) -> DataFrame:
    return s.select(org_graph(t), s.is_type("nation"))


@query(ORG + "SELECT doc_id, id, node_type FROM n WHERE id = 1000007")
def sel_object_id(t: Tables) -> DataFrame:
    return org_graph(t).nodes.where(s.has_id(1_000_007)).select("doc_id", "id", "node_type")


@query(ORG + "SELECT node_type, count(*) AS n FROM n WHERE node_type = 'customer' AND tag IS NOT NULL GROUP BY 1")
def sel_has_prop(t: Tables) -> DataFrame:
    return org_graph(t).nodes.where(s.has_property("segment")).groupBy("node_type").agg(F.count("*").alias("n"))


@query(ORG + "SELECT doc_id, id FROM n WHERE node_type = 'customer' AND tag = 'BUILDING'")
def sel_prop_eq(t: Tables) -> DataFrame:
    return s.select(org_graph(t), s.property_equals("segment", "BUILDING"))


@query(ORG + "SELECT doc_id, id FROM n WHERE regexp_matches(name, '^Customer#0+[0-9]7$')")
def sel_prop_regex(t: Tables) -> DataFrame:
    return s.select(org_graph(t), s.property_matches("name", "^Customer#0+[0-9]7$"))


@query(ORG + "SELECT doc_id, dst AS id FROM e JOIN n USING (doc_id) WHERE e.src = n.id AND n.node_type = 'nation'")
def sel_child(t: Tables) -> DataFrame:
    g = org_graph(t)
    return s.children_of(g, s.select(g, s.is_type("nation")), s.select(g, s.is_type("customer")))


@query("SELECT n_regionkey::BIGINT AS doc_id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def sel_descendant(t: Tables) -> DataFrame:
    """Customers below each region: closure, semi join and count."""
    g = org_graph(t)
    below = s.descendants_of(g, s.select(g, s.is_type("region")), depth=2)
    return below.join(s.select(g, s.is_type("customer")), s.KEY, "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n_regionkey::BIGINT AS doc_id, 100 + c_nationkey::BIGINT AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def sel_parent(t: Tables) -> DataFrame:
    g = org_graph(t)
    return s.parents_of(g, s.select(g, s.is_type("customer"), F.col("value") > 5000))


@query(
    ORG + "SELECT DISTINCT c.doc_id, unnest([c.id, p.id, r.id]) AS id FROM n o JOIN n c ON o.parent = c.id JOIN n p ON c.parent = p.id JOIN n r ON p.parent = r.id AND r.node_type = 'region' WHERE o.node_type = 'order' AND o.value > 300000"
)
def sel_ancestor(t: Tables) -> DataFrame:
    g = org_graph(t)
    return s.ancestors_of(g, s.select(g, s.is_type("order"), F.col("value") > 300000), depth=3).select("doc_id", "id").distinct()


@query(
    ORG + "SELECT DISTINCT b.doc_id, b.id FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.parent = b.parent AND a.id <> b.id WHERE a.node_type = 'customer' AND a.value > 9500"
)
def sel_sibling(t: Tables) -> DataFrame:
    g = org_graph(t)
    return s.siblings_of(g, s.select(g, s.is_type("customer"), F.col("value") > 9500))


@query(ORG + "SELECT doc_id, id FROM n WHERE tag = 'MACHINERY' AND value < 0")
def sel_and(t: Tables) -> DataFrame:
    g = org_graph(t)
    return s.both(s.select(g, s.property_equals("segment", "MACHINERY")), s.select(g, F.col("value") < 0))


@query(ORG + "SELECT DISTINCT doc_id, id FROM n WHERE node_type = 'region' OR (node_type = 'order' AND tag = 'P')")
def sel_or(t: Tables) -> DataFrame:
    g = org_graph(t)
    return s.either(s.select(g, s.is_type("region")), s.select(g, s.property_equals("status", "P")))


@query(ORG + "SELECT doc_id, id FROM n WHERE node_type <> 'order' AND NOT (node_type = 'customer')")
def sel_not(t: Tables) -> DataFrame:
    g = org_graph(t)
    return s.none_of(g, s.select(g, F.col("node_type").isin("customer", "order")))


@query(ORG + "SELECT doc_id, src, dst AS id FROM e WHERE ord = 1")
def sel_first(t: Tables) -> DataFrame:
    return s.first_child(org_graph(t))


@query(ORG + "SELECT doc_id, src, max(dst) AS id FROM e GROUP BY doc_id, src")
def sel_last(t: Tables) -> DataFrame:
    return s.last_child(org_graph(t))


@query(ORG + "SELECT doc_id, src, dst AS id FROM e WHERE ord = 3")
def sel_nth(t: Tables) -> DataFrame:
    return s.child_range(org_graph(t), 2, 3)


@query(ORG + "SELECT doc_id, src, dst AS id FROM e WHERE ord BETWEEN 2 AND 4")
def sel_range(t: Tables) -> DataFrame:
    return s.child_range(org_graph(t), 1, 4)


@query(
    ORG + "SELECT o.doc_id, o.id FROM n r JOIN n p ON p.parent = r.id AND p.node_type = 'nation' JOIN n c ON c.parent = p.id JOIN n o ON o.parent = c.id WHERE r.node_type = 'region' AND r.name = 'ASIA' AND c.tag = 'FURNITURE' AND o.tag = 'F'"
)
def sel_path(t: Tables) -> DataFrame:
    g = org_graph(t)
    start = s.select(g, s.is_type("region"), s.property_equals("name", "ASIA"))
    return s.path(g, start, s.is_type("nation"), s.property_equals("segment", "FURNITURE"), s.property_equals("status", "F"))


@query(ORG + "SELECT doc_id, id, CASE node_type WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END AS depth FROM n WHERE node_type <> 'order'")
def vis_query_depth(t: Tables) -> DataFrame:
    g = org_graph(t)
    return traversal.depths(g.children(), s.select(g, s.is_type("region")), depth=2)


@query(
    "SELECT node_type, depth, n FROM (SELECT 'region' AS node_type, 0 AS depth, count(*) AS n FROM region UNION ALL SELECT 'nation', 1, count(*) FROM nation UNION ALL SELECT 'customer', 2, count(*) FROM customer UNION ALL SELECT 'order', 3, count(*) FROM orders)"
)
def graph_bfs_depth(t: Tables) -> DataFrame:
    g = org_graph(t)
    d = traversal.depths(g.children(), s.select(g, s.is_type("region")), depth=3)
    return d.join(g.nodes.select("doc_id", "id", "node_type"), s.KEY).groupBy("node_type", "depth").agg(F.count("*").alias("n"))


@query(ORG + "SELECT doc_id, max(CASE node_type WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 ELSE 3 END) AS max_depth FROM n GROUP BY doc_id")
def graph_max_depth(t: Tables) -> DataFrame:
    g = org_graph(t)
    return traversal.depths(g.children(), s.select(g, s.is_type("region")), depth=3).groupBy("doc_id").agg(F.max("depth").alias("max_depth"))


@query(
    ORG + "SELECT o.doc_id, o.id, concat_ws('>', r.id, p.id, c.id, o.id) AS path FROM n o JOIN n c ON o.parent = c.id JOIN n p ON c.parent = p.id JOIN n r ON p.parent = r.id AND r.node_type = 'region' WHERE o.node_type = 'order' AND o.tag = 'P'"
)
def graph_path_to_root(t: Tables) -> DataFrame:
    g = org_graph(t)
    paths = traversal.paths_to_root(g.children(), s.select(g, s.property_equals("status", "P")), depth=3)
    return paths.select("doc_id", "id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(ORG + "SELECT e.doc_id, c.id, p.ord AS place FROM n c JOIN e ON c.doc_id = e.doc_id AND c.id = e.dst JOIN e p ON p.doc_id = e.doc_id AND p.dst = e.src WHERE c.node_type = 'customer' AND c.value < -900")
def graph_page_number(t: Tables) -> DataFrame:
    """The place among its siblings of the nation that each customer in debt belongs to."""
    g = org_graph(t)
    own = s.select(g, s.is_type("customer"), F.col("value") < -900).select("doc_id", F.col("id").alias("dst"))
    up = g.children().join(own, ["doc_id", "dst"], "left_semi").select("doc_id", F.col("dst").alias("id"), F.col("src").alias("dst"))
    place = g.children().select("doc_id", "dst", F.col("ord").alias("place"))
    return up.join(place, ["doc_id", "dst"]).select("doc_id", "id", F.col("place").cast("long").alias("place"))


@query("SELECT n_regionkey::BIGINT AS doc_id, n_nationkey::BIGINT AS id FROM nation")
def graph_is_cyclic(t: Tables) -> DataFrame:
    """Nations of a region as a ring, each leading to the next: every one of them lies on a cycle."""
    from pyspark.sql import Window

    ring = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    after = F.coalesce(F.lead("n_nationkey").over(ring), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")))
    edges = t.nation.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.col("n_nationkey").cast("long").alias("src"), after.cast("long").alias("dst"))
    return traversal.on_cycle(edges)


@query("SELECT 0::BIGINT AS doc_id, n_nationkey::BIGINT AS id, n_nationkey // 5 AS layer FROM nation")
def plugin_topo(t: Tables) -> DataFrame:
    """A dependency order by layers: each nation needs the one five before it."""
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("src")).where("src < 20")
    edges = n.select(F.lit(0).cast("long").alias("doc_id"), "src", (F.col("src") + 5).alias("dst"))
    return traversal.acyclic_layers(edges)


@query(ORG + "SELECT p.doc_id, p.id, count(c.id) AS n, round(avg(c.value), 4) AS mean_value FROM n p LEFT JOIN n c ON c.parent = p.id AND c.doc_id = p.doc_id AND c.node_type = 'customer' WHERE p.node_type = 'nation' GROUP BY 1, 2")
def sel_child_stats(t: Tables) -> DataFrame:
    g = org_graph(t)
    nations = s.select(g, s.is_type("nation"))
    kids = g.children().select("doc_id", F.col("src").alias("id"), F.col("dst"))
    values = g.of_type("customer").select("doc_id", F.col("id").alias("dst"), "value")
    by = kids.join(values, ["doc_id", "dst"]).groupBy("doc_id", "id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return nations.join(by, s.KEY, "left").fillna(0, ["n"])
