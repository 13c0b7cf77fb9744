"""Page programs, laid-out text, code maps, codecs and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import filters, values
from ..graph import ORDER, Tables, org_graph
from ..operators import content
from ..sources import graphs
from .registry import ORG, query


@query(
    """SELECT op, "group", count(*) AS n, sum(k)::BIGINT AS n_operands FROM (SELECT unnest(['q', 'cm', 'BT', 'Tf', 'Tj', 'ET', 'Q']) AS op, unnest(['graphics state', 'graphics state', 'text object', 'text state', 'text show', 'text object', 'graphics state']) AS "group", unnest([0, 6, 0, 2, 1, 0, 0]) AS k FROM part) GROUP BY 1, 2"""
)
def content_operations(t: Tables) -> DataFrame:
    """A small program for each part, cut into operators."""
    program = F.format_string("q 1 0 0 1 %d 0 cm BT /F1 %d Tf (%s) Tj ET Q", "p_size", "p_size", "p_brand")
    ops = content.operations(t.part.select(F.col("p_partkey").alias("doc_id"), program.alias("program")))
    return ops.groupBy("op", "group").agg(F.count("*").alias("n"), F.sum(F.size("operands")).cast("long").alias("n_operands"))


@query("SELECT p_partkey AS doc_id, p_brand || ' ' || p_type AS text FROM part")
def content_shown_text(t: Tables) -> DataFrame:
    program = F.format_string("BT (%s) Tj 0 -12 Td (%s) Tj ET", "p_brand", "p_type")
    return content.shown_text(content.operations(t.part.select(F.col("p_partkey").alias("doc_id"), program.alias("program"))))


@query(
    """WITH s AS (SELECT c_nationkey AS page, (c_custkey % 40)::DOUBLE AS x, (c_custkey // 40)::DOUBLE AS y, c_custkey::VARCHAR AS text FROM customer),
    m AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR abs(y - lag(y) OVER w) > 0.3 OR x - (lag(x) OVER w + 1) >= 6 THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY page ORDER BY y, x, text)),
    l AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, x, text ROWS UNBOUNDED PRECEDING) AS line FROM m)
    SELECT page, line::BIGINT AS line, string_agg(text, ' ' ORDER BY y, x, text) AS text, min(x) AS x, min(y) AS y FROM l GROUP BY 1, 2"""
)
def content_text_lines(t: Tables) -> DataFrame:
    """Customers laid out on a page for each nation, forty to a line; gaps of six columns end a line."""
    k = F.col("c_custkey")
    spans = t.customer.select(F.col("c_nationkey").alias("page"), (k % 40).cast("double").alias("x"), F.floor(k / 40).cast("double").alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.lit(2.0).alias("space"), k.cast("string").alias("text"))
    return content.text_lines(spans, ["page"])


@query("SELECT p_partkey, CASE WHEN p_size = 7 THEN '#' WHEN p_size BETWEEN 1 AND 26 THEN chr(96 + p_size) WHEN p_size BETWEEN 30 AND 39 THEN chr(48 + p_size - 30) END AS char FROM part")
def content_mapped_codes(t: Tables) -> DataFrame:
    """Part sizes as codes of a character map."""
    singles = t.spark.createDataFrame([(7, "#")], "code int, char string")
    ranges = t.spark.createDataFrame([(1, 26, 97), (30, 39, 48)], "low int, high int, start int")
    return content.mapped_codes(t.part.select("p_partkey", F.col("p_size").alias("code")), singles, ranges).select("p_partkey", "char")


@query("SELECT p_partkey, 'dc:title' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey, 'dc:format', p_type FROM part")
def content_properties(t: Tables) -> DataFrame:
    """The entries of one namespace among a part's properties."""
    own = F.create_map(F.lit("dc:title"), F.col("p_name"), F.lit("xmp:brand"), F.col("p_brand"), F.lit("dc:format"), F.col("p_type"))
    return t.part.select("p_partkey", F.explode(content.properties_of("dc", own)).alias("key", "value"))


@query("WITH l AS (SELECT l_orderkey, count(*) AS n, avg(l_discount) AS mean, count(*) FILTER (l_returnflag = 'N') AS ok, bool_or(l_linestatus = 'O') AS rebuilt FROM lineitem GROUP BY 1) SELECT l_orderkey, round(least(1.0, (mean + ok / n) / 2 + CASE WHEN rebuilt THEN 0.2 ELSE 0 END), 6)::DOUBLE AS confidence FROM l")
def content_confidence(t: Tables) -> DataFrame:
    """Orders as reconstructions of their lines."""
    by = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean"), F.count_if(F.col("l_returnflag") == "N").alias("ok"), F.bool_or(F.col("l_linestatus") == "O").alias("rebuilt"))
    return by.select("l_orderkey", F.round(content.confidence(F.col("n"), F.col("mean"), F.col("ok"), F.col("rebuilt")), 6).alias("confidence"))


@query(
    """WITH b AS (SELECT 'documents' AS src, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'events', props FROM events),
    f AS (SELECT src, text, left(text, 1000) AS head FROM b),
    k AS (SELECT src, CASE WHEN length(head) > 0 AND length(regexp_replace(head, '[^\\x00-\\x7F]', '', 'g')) / length(head) > 0.8 THEN 'Text' ELSE 'Other' END AS kind FROM f)
    SELECT src, kind, count(*) AS n FROM k GROUP BY 1, 2"""
)
def codec_content_class(t: Tables) -> DataFrame:
    """Which texts are plain enough for a text codec."""
    both = t.documents.select(F.lit("documents").alias("src"), "text").unionAll(t.pages.select(F.lit("pages"), "html")).unionAll(t.events.select(F.lit("events"), "props"))
    kind = F.when(filters.content_class(F.col("text")) == "Text", "Text").otherwise("Other")
    return both.groupBy("src", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT page_id, html AS back FROM pages")
def codec_filter_chain(t: Tables) -> DataFrame:
    """Pages through hex and deflate, and back through a chain of two filters."""
    coded = F.concat(F.hex(values.deflate(F.col("html").cast("binary"))), F.lit(">")).cast("binary")
    names = F.array(F.lit("ASCIIHexDecode"), F.lit("FlateDecode"))
    return t.pages.select("page_id", filters.decoded(coded, names, ratio=1000).cast("string").alias("back"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def sink_json(t: Tables) -> DataFrame:
    """Rows as JSON texts, with the key that they are read back by."""
    rows = graphs.as_json(t.nation.select("n_nationkey", "n_name", "n_regionkey"))
    return rows.select(F.from_json("json", "n_nationkey int").getField("n_nationkey").alias("n_nationkey"), "json")


@query(ORG + "SELECT doc_id, id, node_type || '_' || name AS stable_id FROM n WHERE node_type IN ('region', 'nation', 'customer')")
def sink_stable_ids(t: Tables) -> DataFrame:
    """Names of regions, nations and customers that stay the same from export to export; orders have no name."""
    named = graphs.stable_ids(org_graph(t), {"region": "name", "nation": "name", "customer": "name"})
    return named.where(F.col("id") < ORDER).select("doc_id", "id", "stable_id")


@query(ORG + "SELECT n.doc_id, n.id, n.node_type, n.name, n.value, n.parent, e.ord::BIGINT AS place FROM n LEFT JOIN e ON e.doc_id = n.doc_id AND e.dst = n.id")
def sink_graph_round_trip(t: Tables) -> DataFrame:
    """The whole graph written as JSON lines and read back: every node with its parent and place."""
    graphs.write(org_graph(t), where := storage.path(t.spark, "graph"), "json")
    back = graphs.read(t.spark, where, "json")
    above = back.children().select("doc_id", F.col("dst").alias("id"), F.col("src").alias("parent"), F.col("ord").cast("long").alias("place"))
    return back.nodes.join(above, ["doc_id", "id"], "left").select("doc_id", "id", "node_type", F.try_element_at("props", F.lit("name")).alias("name"), "value", "parent", "place")
