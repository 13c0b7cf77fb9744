"""Small document files, one for each supplier, through the raw source and the document rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Tables
from ..operators import profiles, rules
from ..sources import raw
from .registry import query

#: What each file holds, in SQL: k is the supplier's key, n its pages.
FILES = """
WITH d AS (SELECT 's' || s_suppkey AS doc_id, s_suppkey AS k, s_suppkey % 3 + 1 AS n, (s_suppkey % 4 = 1)::INT AS fonts, s_suppkey % 2 AS again, s_suppkey % 4 = 0 AS modern FROM supplier),
p AS (SELECT d.*, i FROM d, unnest(range(n)) AS u(i)),
o AS (SELECT doc_id, k, 1 AS num, 'Catalog' AS node_type FROM d UNION ALL SELECT doc_id, k, 2, 'Pages' FROM d UNION ALL SELECT doc_id, k, 3 + i, 'Page' FROM p UNION ALL SELECT doc_id, k, 3 + n, 'Font' FROM d WHERE fonts = 1)
"""


def _files(t: Tables) -> DataFrame:
    """(path, length, content): a catalog, a page tree, pages, at times a font, a table and a trailer; odd keys have a second revision of the first page."""
    k = F.col("s_suppkey")
    n, font = k % 3 + 1, (k % 4 == 1).cast("int")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    when = lambda c, *parts: F.when(c, text(*parts)).otherwise("")
    pages = F.sequence(F.lit(3), 2 + n)
    obj = lambda num, body: text(num, " 0 obj\n<< ", body, " >>\nendobj\n")
    kids = F.array_join(F.transform(pages, lambda i: F.concat(i.cast("string"), F.lit(" 0 R"))), " ")
    page = F.array_join(F.transform(pages, lambda i: obj(i, text("/Type /Page /Parent 2 0 R", when(k % 3 == 0, " /TrimBox [0 0 9 9]")))), "")
    ids = F.when(k % 6 == 0, "").when(k % 10 == 5, " /ID [<aa>]").otherwise(" /ID [<aa> <bb>]")
    size = 3 + n + font
    table = F.array_join(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.format_string("%010d 00000 n \n", i * 10)), "")
    whole = text(
        "%PDF-", F.when(k % 4 == 0, "2.0").otherwise("1.4"), "\n",
        obj("1", text("/Type /Catalog", when(k % 2 == 0, " /Lang (en)"), when((k % 8 == 0) | (k % 6 == 1), " /Version /2.0"), when(k % 7 != 0, " /Pages 2 0 R"))),
        obj("2", text("/Type /Pages /Count ", n + (k % 5 == 0).cast("int"), " /Kids [", kids, "]")),
        page,
        F.when(font == 1, obj(3 + n, text("/Type /Font /Subtype /TrueType", when(k % 8 == 1, " /Encoding /WinAnsiEncoding")))).otherwise(""),
        "xref\n0 ", size, "\n0000000000 65535 f \n", table, "trailer\n<< /Size ", size, " /Root 1 0 R", ids, " >>\nstartxref\n0\n%%EOF\n",
        when(k % 2 == 1, obj("3", F.lit("/Type /Page /Parent 2 0 R /Rotate 90")), "xref\n3 1\n0000099999 00000 n \ntrailer\n<< /Size ", size, " /Root 1 0 R /Prev 100", ids, " >>\nstartxref\n1\n%%EOF\n"),
    )
    own = t.supplier.select(text("s", k).alias("path"), whole.cast("binary").alias("content"))
    return own.select("path", F.octet_length("content").cast("long").alias("length"), "content")


@query(FILES + "SELECT doc_id, CASE WHEN modern THEN 2 ELSE 1 END AS major, CASE WHEN modern THEN 0 ELSE 4 END AS minor, (2 + n + fonts + again)::BIGINT AS n_objects, (1 + again)::BIGINT AS n_revisions, false AS encrypted FROM d")
def raw_overview(t: Tables) -> DataFrame:
    o = raw.overview(_files(t))
    return o.select(F.col("path").alias("doc_id"), "major", "minor", F.col("n_objects").cast("long").alias("n_objects"), F.col("n_revisions").cast("long").alias("n_revisions"), "encrypted")


@query(FILES + "SELECT doc_id, num::BIGINT AS num, node_type, CASE WHEN num = 3 AND k % 2 = 1 THEN '90' END AS rotate FROM o")
def raw_objects(t: Tables) -> DataFrame:
    """Objects with their types; a later revision replaces an earlier."""
    nodes = raw.graph(_files(t)).nodes
    return nodes.select("doc_id", F.shiftright("id", 16).alias("num"), "node_type", F.try_element_at("props", F.lit("Rotate")).alias("rotate"))


@query(FILES + "SELECT doc_id, 1::BIGINT AS src, 2::BIGINT AS dst FROM d WHERE k % 7 <> 0 UNION ALL SELECT doc_id, 2, 3 + i FROM p UNION ALL SELECT doc_id, 3 + i, 2 FROM p")
def raw_references(t: Tables) -> DataFrame:
    return raw.graph(_files(t)).edges.select("doc_id", F.shiftright("src", 16).alias("src"), F.shiftright("dst", 16).alias("dst"))


@query(FILES + """SELECT doc_id, 0::BIGINT AS num, 65535 AS gen, 'Free' AS kind, 0::BIGINT AS "offset" FROM d UNION ALL SELECT doc_id, num, 0, 'InUse', CASE WHEN num = 3 AND k % 2 = 1 THEN 99999 ELSE num * 10 END FROM o""")
def raw_xref(t: Tables) -> DataFrame:
    """Cross-reference tables, sections merged."""
    return raw.merged_xref(raw.xref_entries(_files(t)))


@query(FILES + """SELECT doc_id, section::BIGINT AS section, 1::BIGINT AS root, (3 + n + fonts)::BIGINT AS size, CASE WHEN section = 1 THEN 100::BIGINT END AS prev,
    (CASE WHEN k % 6 = 0 THEN 0 WHEN k % 10 = 5 THEN 1 ELSE 2 END)::BIGINT AS n_ids FROM d, unnest(range(1 + again)) AS u(section)""")
def raw_trailers(t: Tables) -> DataFrame:
    own = raw.trailers(_files(t))
    return own.select("doc_id", F.col("section").cast("long").alias("section"), "root", "size", "prev", F.col("n_ids").cast("long").alias("n_ids"))


@query(FILES + "SELECT doc_id, 0::BIGINT AS section, num::BIGINT AS num, 'added' AS change FROM o UNION ALL SELECT doc_id, 1, 3, 'modified' FROM d WHERE again = 1")
def raw_revisions(t: Tables) -> DataFrame:
    own = raw.revisions(raw.xref_entries(_files(t)))
    return own.select("doc_id", F.col("section").cast("long").alias("section"), "num", "change")


@query(FILES + "SELECT doc_id, 'XREF_PAST_END' AS code FROM d WHERE again = 1")
def raw_offsets(t: Tables) -> DataFrame:
    """Files whose tables point past their end, or have fewer entries than their trailers say."""
    return raw.offset_findings(_files(t))


_ISSUES = FILES + """, w AS (
  SELECT doc_id, NULL::BIGINT AS num, 'CATALOG_WITHOUT_PAGES' AS code, 'Error' AS severity FROM d WHERE k % 7 = 0
  UNION ALL SELECT doc_id, NULL, 'PAGES_COUNT_MISMATCH', 'Error' FROM d WHERE k % 5 = 0
  UNION ALL SELECT doc_id, NULL, 'LANG_MISSING', 'Warning' FROM d WHERE k % 2 = 1
  UNION ALL SELECT doc_id, NULL, unnest(['METADATA_MISSING', 'NOT_TAGGED', 'OUTPUT_INTENTS_MISSING']), 'Warning' FROM d),
x AS (
  SELECT doc_id, (3 + n)::BIGINT AS num, 'FONT_NOT_EMBEDDED' AS code, 'Error' AS severity FROM d WHERE fonts = 1
  UNION ALL SELECT doc_id, 3 + n, 'FONT_WITHOUT_ENCODING', 'Warning' FROM d WHERE fonts = 1 AND k % 8 <> 1
  UNION ALL SELECT doc_id, 3 + i, 'TRIM_BOX_MISSING', 'Warning' FROM p WHERE k % 3 <> 0 OR i = 0 AND k % 2 = 1)
"""


@query(_ISSUES + "SELECT doc_id, code, severity FROM w")
def val_document_rules(t: Tables) -> DataFrame:
    return rules.findings(profiles.document_rows(raw.graph(_files(t))), profiles.document_rules(), "doc_id")


@query(_ISSUES + "SELECT doc_id, num, code, severity FROM x")
def val_node_rules(t: Tables) -> DataFrame:
    found = rules.findings(raw.graph(_files(t)).nodes, profiles.node_rules(), "doc_id", "id")
    return found.select("doc_id", F.shiftright("id", 16).alias("num"), "code", "severity")


@query(FILES + """, v AS (SELECT *, k % 8 = 0 OR k % 6 = 1 AS declares FROM d)
    SELECT doc_id, 'TRAILER_ID_INVALID' AS code FROM v WHERE k % 6 = 0 OR k % 10 = 5 UNION ALL SELECT doc_id, 'VERSION_MISMATCH' FROM v WHERE modern <> declares UNION ALL SELECT doc_id, 'VERSION_TOO_NEW' FROM v WHERE modern""")
def val_file_rules(t: Tables) -> DataFrame:
    """Trailers without two ids, and versions that head and catalog disagree about."""
    return rules.findings(profiles.file_rows(_files(t)), profiles.file_rules(), "doc_id").select("doc_id", "code")


_CODES = ", ".join(f"('{p}', '{c}')" for p, cs in profiles.PROFILES.items() for c in cs)


@query(_ISSUES + f""", f AS (SELECT * FROM (VALUES {_CODES}) AS t(profile, code)), a AS (SELECT doc_id, code, severity FROM w UNION ALL SELECT doc_id, code, severity FROM x),
    c AS (SELECT doc_id, profile, count(*) FILTER (severity = 'Error') AS n_error, count(*) FILTER (severity = 'Warning') AS n_warning FROM a JOIN f USING (code) GROUP BY 1, 2),
    e AS (SELECT DISTINCT doc_id, profile FROM d, f)
    SELECT doc_id, profile, coalesce(n_error, 0) AS n_error, coalesce(n_warning, 0) AS n_warning, coalesce(n_error, 0) = 0 AS valid,
           CASE WHEN n_error > 0 THEN 'NonCompliant' WHEN n_warning > 0 THEN 'PartiallyCompliant' ELSE 'Compliant' END AS status FROM e LEFT JOIN c USING (doc_id, profile)""")
def val_all_profiles(t: Tables) -> DataFrame:
    done = profiles.validate_all(raw.graph(_files(t)))
    return done.select("doc_id", "profile", "n_error", "n_warning", "valid", "status")


@query("SELECT o_orderkey AS doc_id, CASE i WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE o_custkey + 100 END AS num, CASE i WHEN 0 THEN 'InUse' WHEN 1 THEN 'Compressed' ELSE 'Free' END AS kind, CASE i WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey % 1000 ELSE 5 END AS field2, i AS field3 FROM orders, unnest([0::BIGINT, 1::BIGINT, 2::BIGINT]) AS u(i)")
def raw_xref_stream(t: Tables) -> DataFrame:
    """Three rows of a cross-reference stream for each order, in two ranges of numbers; a third range has no rows left."""
    row = lambda kind, a, b: F.format_string("%02x%08x%04x", F.lit(kind), a, F.lit(b))
    content: Column = F.unhex(F.concat(row(1, F.col("o_custkey"), 0), row(2, F.col("o_orderkey") % 1000, 1), row(0, F.lit(5), 2)))
    pair = lambda first, count: F.struct(first.cast("long").alias("first"), F.lit(count).cast("long").alias("count"))
    index = F.array(pair(F.lit(7), 2), pair(F.col("o_custkey") + 100, 1), pair(F.lit(1), 3))
    return raw.stream_entries(t.orders.select(F.col("o_orderkey").alias("doc_id"), index.alias("index"), content.alias("content")), [1, 4, 2])


#: Files of three sections whose newest stands first: k is the part's key; every fifth file's oldest section leads back to the newest, every seventh's to nowhere.
_CHAIN = """WITH c AS (SELECT p_partkey AS k, 'c' || p_partkey AS doc_id, 9 + length('c' || p_partkey) + 1 AS a FROM part),
    s AS (SELECT *, a + 68 AS b, a + 136 AS o FROM c)
"""


def _chained(t: Tables) -> DataFrame:
    """The newest section, then the oldest, then the middle one; each has one entry and its /Prev, all of 68 bytes."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("c"), k.cast("string"))
    first = F.length(name) + 10
    section = lambda num, offset, prev: F.format_string("xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Prev %010d >>\n", F.lit(num), offset, prev)
    last = F.when(k % 5 == 0, first).when(k % 7 == 0, F.lit(3)).otherwise(F.lit(0))
    text = F.concat(F.lit("%PDF-1.4\n"), name, F.lit("\n"), section(1, k, first + 136), section(3, k + 2, last), section(1, k + 1, first + 68), F.format_string("startxref\n%d\n%%%%EOF\n", first))
    return t.part.select(name.alias("path"), text.cast("binary").alias("content"))


@query(_CHAIN + """SELECT doc_id, 0 AS revision, a AS "offset", NULL::VARCHAR AS anomaly FROM s UNION ALL SELECT doc_id, 1, o, NULL FROM s UNION ALL SELECT doc_id, 2, b, NULL FROM s
    UNION ALL SELECT doc_id, NULL, a, 'xref_prev_cycle' FROM s WHERE k % 5 = 0 UNION ALL SELECT doc_id, NULL, 3, 'xref_parse_failed' FROM s WHERE k % 5 > 0 AND k % 7 = 0""")
def raw_xref_chain(t: Tables) -> DataFrame:
    """Sections in order of time along /Prev, and chains that end early."""
    return raw.xref_chain(_chained(t))


@query(_CHAIN + """SELECT doc_id, 1::BIGINT AS num, 0 AS gen, 'InUse' AS kind, k AS "offset", 0 AS revision FROM s UNION ALL SELECT doc_id, 3, 0, 'InUse', k + 2, 2 FROM s""")
def raw_chained_entries(t: Tables) -> DataFrame:
    """Object 1 has entries in two sections, of which the newer stands first in the file."""
    return raw.chained_xref(_chained(t))


@query("SELECT n_nationkey AS doc_id, i::BIGINT AS index, (n_nationkey + 10 * i)::BIGINT AS num, CASE i WHEN 0 THEN '<< /Name (' || n_name || ') >>' ELSE '[' || n_regionkey || ']' END AS body FROM nation, unnest([0, 1]) AS u(i)")
def raw_object_stream(t: Tables) -> DataFrame:
    """Two objects in a stream for each nation."""
    one, other = F.concat(F.lit("<< /Name ("), "n_name", F.lit(") >>")), F.concat(F.lit("["), F.col("n_regionkey").cast("string"), F.lit("]"))
    header = F.format_string("%d 0 %d %d ", F.col("n_nationkey"), F.col("n_nationkey") + 10, F.length(one) + 1)
    streams = t.nation.select(F.col("n_nationkey").alias("doc_id"), F.lit(2).alias("n"), F.length(header).alias("first"), F.concat(header, one, F.lit(" "), other).alias("text"))
    return raw.stream_objects(streams).select("doc_id", F.col("index").cast("long").alias("index"), F.col("num").cast("long").alias("num"), "body")


@query("SELECT 's' || s_suppkey AS doc_id, 1.0::DOUBLE AS version, (s_suppkey * 7)::BIGINT AS length, 5::BIGINT AS first_page, (s_suppkey % 4)::BIGINT AS n_pages, 99::BIGINT AS hint FROM supplier WHERE s_suppkey % 2 = 0")
def raw_linearization(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    said = F.when(k % 2 == 0, F.format_string("/Linearized 1 /L %d /O 5 /N %d /H [99 12]", k * 7, k % 4)).otherwise("/Type /Catalog")
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< "), said, F.lit(" >>\nendobj\n"))
    return raw.linearization(t.supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("path"), body.cast("binary").alias("content")))
