"""Joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import ORDER, PART, SUPPLIER, Tables, org_graph, reference_edges
from ..operators import aggregates, joins, sets, windows
from .registry import ORG, query


@query("SELECT l_orderkey::BIGINT AS src, count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1")
def graph_degree(t: Tables) -> DataFrame:
    e = reference_edges(t)
    return e.groupBy((F.col("src") - ORDER).alias("src")).agg(F.count("*").alias("degree"))


@query("SELECT p_brand AS brand, s_nationkey AS nation, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 10 GROUP BY 1, 2")
def join_resolve_refs(t: Tables) -> DataFrame:
    """Lines with the part and the supplier that they refer to."""
    line = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity")
    both = line.join(t.part.where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.groupBy(F.col("p_brand").alias("brand"), F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT count(*) AS total, count(*) FILTER (p_partkey IS NULL) AS broken, round(1 - count(*) FILTER (p_partkey IS NULL) / count(*), 6) AS integrity FROM e LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey")
def join_reference_integrity(t: Tables) -> DataFrame:
    e = reference_edges(t).where((F.col("dst") < SUPPLIER) & (F.col("dst") >= PART))
    parts = t.part.where("p_size <= 25").select(F.lit(0).cast("long").alias("doc_id"), (F.col("p_partkey") + PART).alias("id"))
    return joins.reference_integrity(e, parts).withColumn("integrity", F.round("integrity", 6))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_dangling(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000)")
def join_semi(t: Tables) -> DataFrame:
    wanted = t.orders.where("o_orderstatus = 'F' and o_totalprice > 100000")
    return t.customer.join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT band, count(*) AS n FROM part JOIN (VALUES ('small', 1, 10), ('middle', 11, 30), ('large', 31, 50)) b(band, low, high) ON p_size BETWEEN low AND high GROUP BY 1")
def join_range_names(t: Tables) -> DataFrame:
    bands = t.spark.createDataFrame([("small", 1, 10), ("middle", 11, 30), ("large", 31, 50)], "band string, low int, high int")
    return joins.within(t.part.select("p_size"), F.col("p_size"), bands).groupBy("band").agg(F.count("*").alias("n"))


_SNAPSHOTS = """WITH a AS (SELECT o_custkey, o_orderpriority, count(*) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderpriority, count(*) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2)"""


@query(
    _SNAPSHOTS + """SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, a.v AS old_value, b.v AS new_value,
    CASE WHEN a.v IS NULL THEN 'Added' WHEN b.v IS NULL THEN 'Removed' WHEN a.v <> b.v THEN 'Modified' ELSE 'Same' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority"""
)
def join_full_outer_diff(t: Tables) -> DataFrame:
    keys = ["o_custkey", "o_orderpriority"]
    of = lambda year: t.orders.where(F.year("o_orderdate") == year).groupBy(*keys).agg(F.count("*").alias("v"))
    return joins.full_outer_diff(of(1996), of(1997), keys, "v")


@query(
    """WITH m AS (SELECT n_nationkey, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'kind', 'nation' FROM nation)
    SELECT n_nationkey, key, value FROM m"""
)
def map_merge_resources(t: Tables) -> DataFrame:
    """A nation's own entries over those of its region."""
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    parent = F.create_map(F.lit("name"), F.col("r_name"), F.lit("region"), F.col("r_name"), F.lit("kind"), F.lit("region"))
    child = F.create_map(F.lit("name"), F.col("n_name"), F.lit("kind"), F.lit("nation"))
    return both.select("n_nationkey", F.explode(joins.merged_map(parent, child)).alias("key", "value"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_type_counts(t: Tables) -> DataFrame:
    return aggregates.type_counts(t.events, "event_type")


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS n, count(*) FILTER (html LIKE '%<script%') AS n_script, bool_or(url LIKE 'http://%') AS any_plain, max(strlen(html))::BIGINT AS most_bytes FROM pages GROUP BY 1")
def agg_doc_rollup(t: Tables) -> DataFrame:
    host = F.get(F.split(F.get(F.split("url", "://"), 1), "/"), 0)
    return t.pages.groupBy(host.alias("host")).agg(
        F.count("*").alias("n"), F.count_if(F.col("html").contains("<script")).alias("n_script"), F.bool_or(F.col("url").startswith("http://")).alias("any_plain"), F.max(F.octet_length("html")).cast("long").alias("most_bytes")
    )


@query(
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, percent, value FROM s, (VALUES (50), (95), (99)) p(percent) WHERE place = ((n - 1) * percent) // 100"""
)
def agg_latency_percentiles(t: Tables) -> DataFrame:
    return aggregates.nearest_rank(t.events, "value", [50, 95, 99], ["event_type"])


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"
)
def agg_cube_profile(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS p FROM c) WHERE p = 1"""
)
def agg_predominant(t: Tables) -> DataFrame:
    return aggregates.predominant(t.events, ["user_id"], "event_type")


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_acctbal >= 0) AS ok, round(avg((c_acctbal >= 0)::INT), 6) AS rate FROM customer GROUP BY 1")
def agg_success_rate(t: Tables) -> DataFrame:
    ok = F.col("c_acctbal") >= 0
    return t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.round(F.avg(ok.cast("int")), 6).alias("rate"))


@query(
    """WITH d AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM d)
    SELECT user_id, island::BIGINT AS island, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY 1, 2"""
)
def win_lines_islands(t: Tables) -> DataFrame:
    """Runs of a user's events with gaps of at most an hour."""
    by, order = ["user_id"], ["ts", "event_id"]
    gap = F.col("ts") - windows.previous("ts", by, order) > F.expr("INTERVAL '1' HOUR")
    runs = windows.islands(t.events, by, order, gap)
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def win_timeline_deltas(t: Tables) -> DataFrame:
    line = sets.timeline(t.events, ["user_id"], ["ts", "event_id"], "value")
    return line.select("user_id", "event_id", F.round(F.col("value") - F.col("before"), 6).alias("delta"))


@query(
    """WITH m AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type IN (SELECT min(event_type) FROM events UNION ALL SELECT max(event_type) FROM events))
    SELECT user_id, event_id FROM m WHERE event_type = (SELECT min(event_type) FROM events) AND nxt IS DISTINCT FROM (SELECT max(event_type) FROM events)"""
)
def win_missing_end(t: Tables) -> DataFrame:
    """Events of the first type that are not followed by one of the last type."""
    ends = t.events.agg(F.min("event_type"), F.max("event_type")).first()
    return windows.unended(t.events, ["user_id"], ["ts", "event_id"], "event_type", ends[0], ends[1]).select("user_id", "event_id")


@query(
    """WITH l AS (SELECT event_type, user_id, max((ts, event_id)) AS last FROM events GROUP BY 1, 2)
    SELECT event_type, user_id, place FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY last DESC, user_id) AS place FROM l) WHERE place <= 10"""
)
def win_lru(t: Tables) -> DataFrame:
    return windows.least_recently_used(t.events, ["event_type"], "user_id", "ts", "event_id", 10).withColumn("place", F.col("place").cast("long"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_topk(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders) WHERE place <= 5")
def sort_priority(t: Tables) -> DataFrame:
    """The next five of each priority's queue."""
    first = windows.first_per_group(t.orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 5)
    return first.select("o_orderpriority", "o_orderkey", F.col("place").cast("long").alias("place"))


@query(
    """WITH r AS (SELECT l_orderkey, l_partkey AS s, l_partkey + l_quantity::BIGINT AS e FROM lineitem), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
    i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT l_orderkey, min(s) AS "start", max(e) AS "end" FROM i GROUP BY l_orderkey, k"""
)
def win_merged_ranges(t: Tables) -> DataFrame:
    """Overlapping ranges of an order as one: the ranges run from each line's part key over its quantity."""
    ranges = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return windows.merged_ranges(ranges, ["l_orderkey"])


@query(
    """WITH a AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2),
    b AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS v, bool_and(o_orderstatus = 'F') AS freed FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2)
    SELECT o_custkey, o_orderpriority, change FROM (SELECT b.o_custkey, b.o_orderpriority, CASE WHEN b.freed THEN 'deleted' WHEN a.v IS NULL THEN 'added' WHEN a.v <> b.v THEN 'modified' END AS change FROM b LEFT JOIN a USING (o_custkey, o_orderpriority)) WHERE change IS NOT NULL"""
)
def set_revision_deltas(t: Tables) -> DataFrame:
    keys, date = ["o_custkey", "o_orderpriority"], F.col("o_orderdate")
    before = t.orders.where(date < F.lit("1996-01-01").cast("timestamp_ntz")).groupBy(*keys).agg(F.max("o_totalprice").alias("v"))
    after = t.orders.where(date >= F.lit("1995-01-01").cast("timestamp_ntz")).groupBy(*keys).agg(F.max("o_totalprice").alias("v"), F.bool_and(F.col("o_orderstatus") == "F").alias("freed"))
    return sets.revision_deltas(before, after, keys, "v", F.col("freed"))


@query(
    """WITH l AS (SELECT n_nationkey AS layer, n_nationkey % 2 = 0 AS base, n_nationkey % 3 = 0 AS on_, n_nationkey % 7 = 0 AS off, CASE WHEN n_regionkey < 3 THEN n_regionkey END AS radio FROM nation),
    s AS (SELECT * FROM l WHERE (base OR on_) AND NOT off)
    SELECT layer FROM s WHERE radio IS NULL UNION ALL SELECT min(layer) FROM s WHERE radio IS NOT NULL GROUP BY radio"""
)
def set_visible_layers(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    layers = t.nation.select(k.alias("layer"), (k % 2 == 0).alias("base"), (k % 3 == 0).alias("on"), (k % 7 == 0).alias("off"), F.when(F.col("n_regionkey") < 3, F.col("n_regionkey")).alias("radio"))
    return sets.visible_layers(layers).select("layer")


@query(
    """WITH a AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)
    SELECT o_custkey, len(list_filter(s, lambda x: x NOT IN ('F', 'O'))) = 0 AS all_on, len(list_filter(s, lambda x: x IN ('F', 'O'))) > 0 AS any_on, len(list_filter(s, lambda x: x IN ('F', 'O'))) = 0 AS all_off, len(list_filter(s, lambda x: x NOT IN ('F', 'O'))) > 0 AS any_off FROM a"""
)
def set_policy(t: Tables) -> DataFrame:
    states = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    shown = F.array(F.lit("F"), F.lit("O"))
    names = {"all_on": "AllOn", "any_on": "AnyOn", "all_off": "AllOff", "any_off": "AnyOff"}
    return states.select("o_custkey", *[sets.membership(p, F.col("s"), shown).alias(n) for n, p in names.items()])


@query(
    """WITH d AS (SELECT source, count(*) AS docs, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs FROM documents GROUP BY 1)
    SELECT source, round(greatest(0.0, least(1.0, 1 - (docs - texts)::DOUBLE / (docs + langs + 10))), 6) AS similarity FROM d"""
)
def diff_similarity(t: Tables) -> DataFrame:
    d = t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.count_distinct("text").alias("texts"), F.count_distinct("lang").alias("langs"))
    return d.select("source", F.round(aggregates.similarity(F.col("docs") - F.col("texts"), F.col("docs"), F.col("langs")), 6).alias("similarity"))


_PAIRS = "WITH p AS (SELECT a.doc_id AS pair_id, a.text AS old_text, b.text AS new_text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


@query(
    _PAIRS + """, o AS (SELECT pair_id, unnest(string_split(old_text, chr(10))) AS line FROM p), w AS (SELECT pair_id, unnest(string_split(new_text, chr(10))) AS line FROM p),
    oc AS (SELECT pair_id, line, count(*) AS c FROM o GROUP BY 1, 2), wc AS (SELECT pair_id, line, count(*) AS c FROM w GROUP BY 1, 2),
    f AS (SELECT coalesce(oc.pair_id, wc.pair_id) AS pair_id, coalesce(oc.line, wc.line) AS line, coalesce(wc.c, 0) - coalesce(oc.c, 0) AS d FROM oc FULL JOIN wc ON oc.pair_id = wc.pair_id AND oc.line = wc.line)
    SELECT pair_id, CASE WHEN d > 0 THEN 'Insert' ELSE 'Delete' END AS change, count(*) AS n_lines, sum(abs(d))::BIGINT AS n FROM f WHERE d <> 0 GROUP BY 1, 2"""
)
def diff_lines(t: Tables) -> DataFrame:
    """Lines that differ between each document and the next, as multisets."""
    new = t.documents.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("new_text"))
    pairs = t.documents.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("old_text")).join(new, "pair_id")
    return sets.line_changes(pairs).groupBy("pair_id", "change").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n"))


@query(
    """WITH a AS (SELECT doc_id AS k, lang, source, n_chars FROM documents), p AS (SELECT a.k, a.lang AS l1, b.lang AS l2, a.source AS s1, b.source AS s2, a.n_chars::VARCHAR AS c1, b.n_chars::VARCHAR AS c2 FROM a JOIN a b ON b.k = a.k + 1)
    SELECT k, 'lang' AS field, l1 AS old_value, l2 AS new_value FROM p WHERE l1 IS DISTINCT FROM l2 UNION ALL SELECT k, 'source', s1, s2 FROM p WHERE s1 IS DISTINCT FROM s2 UNION ALL SELECT k, 'n_chars', c1, c2 FROM p WHERE c1 IS DISTINCT FROM c2"""
)
def diff_metadata(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("k"), "lang", "source", "n_chars")
    return sets.field_changes(d, d.withColumn("k", F.col("k") - 1), "k", ["lang", "source", "n_chars"])


@query(
    "WITH h AS (SELECT user_id, list(DISTINCT event_type) AS steps FROM events GROUP BY 1) SELECT user_id, len(steps) AS n_steps FROM h WHERE list_contains(steps, (SELECT min(event_type) FROM events))"
)
def prov_query(t: Tables) -> DataFrame:
    stage = t.events.agg(F.min("event_type")).first()[0]
    history = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("steps"))
    return sets.with_provenance(history, stage).select("user_id", F.size("steps").cast("long").alias("n_steps"))


@query(ORG + "SELECT node_type, count(*) AS n, count(value) AS n_value, round(sum(value), 2) AS total FROM n GROUP BY 1")
def agg_org_types(t: Tables) -> DataFrame:
    return org_graph(t).nodes.groupBy("node_type").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.round(F.sum("value"), 2).alias("total"))
