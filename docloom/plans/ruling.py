"""A set of files on which every rule fires, resources of pages as rows, and checks of content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import cbor, filters
from ..graph import Tables, org_graph
from ..operators import profiles, resources, rules, security, tours, transforms
from ..sources import graphs, raw
from .registry import ORG, query

#: What is wrong with file number m (a part's key modulo 40), and the codes that say so; every other number is a clean file.
FAULTS = {
    1: ("no catalog", ["CATALOG_MISSING", "LANG_MISSING"]), 2: ("a second catalog", ["MULTIPLE_CATALOGS"]), 3: ("no page tree", ["PAGES_MISSING", "CATALOG_WITHOUT_PAGES"]),
    4: ("a catalog without pages", ["CATALOG_WITHOUT_PAGES"]), 5: ("no count", ["PAGES_COUNT_MISSING"]), 6: ("a wrong count", ["PAGES_COUNT_MISMATCH"]), 7: ("no metadata", ["METADATA_MISSING"]),
    8: ("no language", ["LANG_MISSING"]), 9: ("no structure", ["NOT_TAGGED"]), 10: ("no intent", ["OUTPUT_INTENTS_MISSING"]), 11: ("encrypted", ["ENCRYPTED"]),
    12: ("no objects", ["EMPTY_DOCUMENT", "CATALOG_MISSING", "PAGES_MISSING", "METADATA_MISSING", "LANG_MISSING", "NOT_TAGGED", "OUTPUT_INTENTS_MISSING"]),
    13: ("a font that is not embedded", ["FONT_NOT_EMBEDDED"]), 14: ("a font without encoding", ["FONT_WITHOUT_ENCODING"]), 15: ("a script", ["JAVASCRIPT"]), 16: ("a link", ["EXTERNAL_REFERENCE"]),
    17: ("a file", ["EMBEDDED_FILE"]), 18: ("media", ["MULTIMEDIA"]), 19: ("no trim box", ["TRIM_BOX_MISSING"]), 20: ("transparency", ["TRANSPARENCY"]), 21: ("an image by LZW", ["IMAGE_LZW"]),
    22: ("an annotation of a file", ["ANNOTATION_NOT_ALLOWED"]), 23: ("no appearance", ["ANNOTATION_WITHOUT_APPEARANCE"]), 24: ("device colour", ["DEVICE_COLOUR"]), 25: ("a form of packets", ["XFA_FORM"]), 26: ("no alternative", ["ALT_MISSING"]),
    27: ("no root", ["TRAILER_ROOT_MISSING"]), 28: ("no size", ["TRAILER_SIZE_MISSING"]), 29: ("one id", ["TRAILER_ID_INVALID"]), 30: ("two versions", ["VERSION_MISMATCH"]), 31: ("a new version", ["VERSION_TOO_NEW"]),
    32: ("an offset past the end", ["XREF_PAST_END"]), 33: ("too few entries", ["TRAILER_SIZE"]), 34: ("no entries", ["XREF_ENTRIES_MISSING"]),
}
#: The object that a fault adds.
ADDED = {
    2: "/Type /Catalog /Lang (en)", 13: "/Type /Font /Subtype /TrueType /Encoding /WinAnsiEncoding", 14: "/Type /Font /Subtype /TrueType /FontDescriptor << /Flags 4 >>", 15: "/Type /Action /S /JavaScript /JS (x)",
    16: "/Type /Action /S /URI /URI (x)", 17: "/Type /Filespec /F (a.txt)", 18: "/Type /Annot /Subtype /RichMedia /AP << >>", 20: "/Type /Group /S /Transparency", 21: "/Type /XObject /Subtype /Image /Filter /LZWDecode",
    22: "/Type /Annot /Subtype /FileAttachment /AP << >>", 23: "/Type /Annot /Subtype /Link", 24: "/Type /XObject /Subtype /Image /ColorSpace /DeviceRGB", 25: "/Type /AcroForm /XFA (x)", 26: "/Type /StructElem /S /Figure",
}
_FAULTY = "WITH k AS (SELECT 'f' || p_partkey AS doc_id, p_partkey % 40 AS m FROM part), f AS (SELECT * FROM (VALUES " + ", ".join(f"({m}, '{c}')" for m, (_, cs) in FAULTS.items() for c in cs) + ") v(m, code))"


def _faulty(t: Tables) -> DataFrame:
    """(path, length, content): a whole file for each part, with the fault of its number."""
    m = F.col("p_partkey") % 40
    alt = lambda number, text, other="": F.when(m == number, text).otherwise(other)
    obj = lambda num, *body: F.concat(F.lit(f"{num} 0 obj\n<< "), *[F.lit(b) if isinstance(b, str) else b for b in body], F.lit(" >>\nendobj\n"))
    pages, root = alt(4, "", " /Pages 2 0 R"), F.when(m == 1, "/Type /Katalog").otherwise("/Type /Catalog")
    added = F.lit("")
    for number, body in ADDED.items():
        added = F.when(m == number, obj(9, body)).otherwise(added)
    objects = F.concat(
        obj(1, root, pages, alt(8, "", " /Lang (en)"), alt(11, " /Encrypt true"), alt(30, " /Version /2.0")),
        obj(2, alt(3, "/Type /Folder", "/Type /Pages"), F.when(m == 5, "").when(m == 6, " /Count 2").otherwise(" /Count 1"), " /Kids [3 0 R]"),
        obj(3, "/Type /Page /Parent 2 0 R", alt(19, "", " /TrimBox [0 0 9 9]")), obj(4, alt(9, "/Type /Other", "/Type /StructTreeRoot")), obj(5, alt(7, "/Type /Other", "/Type /Metadata")),
        obj(6, alt(10, "/Type /Other", "/Type /OutputIntent"), " /S /GTS_PDFX"), obj(7, "/Type /Font /Subtype /TrueType /Encoding /WinAnsiEncoding /FontDescriptor << /Flags 4 >>"), added,
    )
    table = F.when(m == 34, "").otherwise(F.concat(F.lit("xref\n0 2\n0000000000 65535 f \n"), F.when(m == 32, "0009999999").otherwise("0000000009"), F.lit(" 00000 n \n")))
    trailer = F.concat(F.lit("trailer\n<<"), F.when(m == 28, "").when(m == 33, " /Size 5").otherwise(" /Size 2"), alt(27, "", " /Root 1 0 R"), alt(29, " /ID [<aa>]", " /ID [<aa> <bb>]"), F.lit(" >>\nstartxref\n0\n%%EOF\n"))
    text = F.concat(F.lit("%PDF-"), alt(31, "1.7", "1.4"), F.lit("\n"), F.when(m == 12, "").otherwise(objects), table, trailer)
    own = t.part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), text.cast("binary").alias("content"))
    return own.select("path", F.octet_length("content").cast("long").alias("length"), "content")


@query(_FAULTY + " SELECT doc_id, code FROM k JOIN f USING (m)")
def val_every_rule(t: Tables) -> DataFrame:
    """Every rule on documents, nodes, files and offsets: each fires on the files with its fault, and on no others."""
    files = _faulty(t)
    g = raw.graph(files)
    documents = profiles.document_rows(g, files.select(F.col("path").alias("doc_id")))
    found = rules.findings(documents, profiles.document_rules(), "doc_id").select("doc_id", "code")
    found = found.unionByName(rules.findings(g.nodes, profiles.node_rules(), "doc_id", "id").select("doc_id", "code"))
    found = found.unionByName(rules.findings(profiles.file_rows(files), profiles.file_rules(), "doc_id").select("doc_id", "code"))
    return found.unionByName(raw.offset_findings(files).select("doc_id", "code"))


# --- resources ---


@query("SELECT p_partkey, (p_partkey + 128)::BIGINT AS size, 'lcms' AS cmm_type, (2 + p_partkey % 3) || '.' || (p_partkey % 10) AS version, 'mntr' AS device_class, CASE WHEN p_size % 2 = 0 THEN 'RGB?' ELSE 'CMYK' END AS color_space, 'XYZ?' AS pcs, 'acsp' AS signature FROM part WHERE p_size > 5")
def info_icc_headers(t: Tables) -> DataFrame:
    """Heads of colour profiles; parts of small size have ones that are too short."""
    k = F.col("p_partkey")
    number = F.unhex(F.lpad(F.hex(k + 128), 8, "0"))
    version = F.unhex(F.format_string("%x%x000000", 2 + k % 3, k % 10))
    tag = lambda c: F.lit(c.encode())
    space = F.when(F.col("p_size") % 2 == 0, tag("RGB ")).otherwise(tag("CMYK"))
    rest = F.when(F.col("p_size") > 5, F.lit(bytes(88))).otherwise(F.lit(bytes(87)))
    head = F.concat(number, tag("lcms"), version, tag("mntr"), space, tag("XYZ "), F.lit(bytes(12)), tag("acsp"), rest)
    return t.part.select("p_partkey", resources.icc_header(head).alias("h")).where("h is not null").select("p_partkey", "h.*")


def _spaces(t: Tables) -> DataFrame:
    k, brand = F.col("p_partkey") % 7, F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    text = F.when(k == 0, "/DeviceRGB").when(k == 1, F.format_string("[/ICCBased %d 0 R]", "p_partkey")).when(k == 2, F.format_string("[ /Indexed /DeviceCMYK %d 9 0 R ]", "p_size"))
    text = text.when(k == 3, F.format_string("[/Separation /%s /DeviceGray 8 0 R]", brand)).when(k == 4, F.format_string("[/DeviceN [/Cyan /%s] /DeviceCMYK 8 0 R]", brand)).when(k == 5, "[/ICCBased null]").otherwise("(none)")
    return t.part.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("id"), resources.colour_space(text).alias("space"))


_SPACES = """WITH s AS (SELECT p_size AS doc_id, p_partkey AS id, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS brand, p_partkey % 7 AS k FROM part WHERE p_partkey % 7 < 6)"""


@query(_SPACES + """ SELECT doc_id, id, CASE k WHEN 0 THEN 'DeviceRGB' WHEN 1 THEN 'ICCBased' WHEN 2 THEN 'Indexed' WHEN 3 THEN 'Separation' WHEN 4 THEN 'DeviceN' ELSE 'ICCBased' END AS family, CASE k WHEN 2 THEN 'DeviceCMYK' WHEN 3 THEN 'DeviceGray' WHEN 4 THEN 'DeviceCMYK' END AS alternate,
    CASE k WHEN 3 THEN brand WHEN 4 THEN 'Cyan,' || brand END AS colourants, CASE k WHEN 2 THEN doc_id::BIGINT END AS most, CASE k WHEN 1 THEN id END AS profile FROM s""")
def content_colour_spaces(t: Tables) -> DataFrame:
    return _spaces(t).where("space is not null").select("doc_id", "id", "space.family", "space.alternate", F.when(F.col("space.colourants").isNotNull(), F.array_join("space.colourants", ",")).alias("colourants"), "space.most", "space.profile")


@query(_SPACES + """ SELECT doc_id, id, 'DEVICE_WITHOUT_INTENT' AS code FROM s WHERE k IN (0, 2, 3, 4) AND doc_id % 3 > 0 UNION ALL SELECT doc_id, id, 'ICC_WITHOUT_PROFILE' FROM s WHERE k = 5""")
def val_colour_spaces(t: Tables) -> DataFrame:
    """Spaces that depend on a device where no output condition is named: documents by size, every third of which names one."""
    return resources.colour_findings(_spaces(t).where("space is not null"), t.part.where("p_size % 3 = 0").select(F.col("p_size").alias("doc_id")))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS line_width, CASE WHEN l_returnflag <> 'A' THEN l_linenumber::BIGINT END AS line_cap, CASE WHEN l_linestatus = 'F' THEN true WHEN l_returnflag = 'N' THEN false END AS overprint, CASE WHEN l_returnflag = 'R' THEN 'Perceptual' END AS rendering_intent, count(*) AS n FROM lineitem GROUP BY ALL")
def content_graphics_states(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    entries = {"LW": F.col("l_quantity").cast("string"), "LC": F.when(flag == "A", "butt").otherwise(F.col("l_linenumber").cast("string")), "OP": F.when(F.col("l_linestatus") == "F", "true").when(flag == "N", "false"), "RI": F.when(flag == "R", "Perceptual")}
    props = F.map_filter(F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    own = t.lineitem.select("l_orderkey", "l_linenumber", resources.graphics_state(props).alias("s"))
    return own.groupBy("l_orderkey", "l_linenumber", F.col("s.line_width").alias("line_width"), F.col("s.line_cap").alias("line_cap"), F.col("s.overprint").alias("overprint"), F.col("s.rendering_intent").alias("rendering_intent")).agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT 'f' || p_partkey AS doc_id, p_partkey % 40 AS m FROM part) SELECT doc_id, 6::BIGINT AS num, 'GTS_PDFX' AS subtype, false AS has_profile FROM k WHERE m NOT IN (10, 12)")
def content_output_intents(t: Tables) -> DataFrame:
    """Output intents of the files with faults."""
    found = resources.output_intents(raw.graph(_faulty(t)).nodes)
    return found.select("doc_id", F.shiftright("id", 16).alias("num"), "subtype", "has_profile")


@query("SELECT p_brand AS doc_id, p_type AS name, max_by(CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 1 THEN 'run(' || p_partkey || ')' ELSE p_name END, p_partkey) AS script, max_by(p_partkey % 3 = 0, p_partkey) AS is_stream FROM part GROUP BY 1, 2 HAVING max(p_partkey) % 3 < 2")
def names_scripts(t: Tables) -> DataFrame:
    """Scripts by name, in dictionaries or streams; some names lead to neither."""
    k = F.col("p_partkey")
    names = t.part.select(F.col("p_brand").alias("doc_id"), k.alias("ord"), F.col("p_type").alias("name"), k.alias("target"))
    nodes = t.part.select(F.col("p_brand").alias("doc_id"), k.alias("id"), F.when(k % 3 == 1, F.format_string("run(%d)", k)).alias("js"), F.when(k % 3 == 0, F.col("p_name").cast("binary")).alias("stream"))
    return resources.named_scripts(names, nodes)


@query("SELECT o_custkey AS doc_id, o_orderkey AS id, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INT AS ord, l_partkey AS num, 'stream of ' || l_partkey AS content FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 5 > 0")
def content_streams(t: Tables) -> DataFrame:
    """Orders as pages whose content lies in the streams of their parts."""
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    refs = F.concat(F.lit("["), F.array_join(F.transform(F.filter(listed, lambda x: x["l_partkey"] % 5 > 0), lambda x: F.concat(x["l_partkey"].cast("string"), F.lit(" 0 R"))), " "), F.lit("]"))
    pages = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id")).agg(refs.alias("contents"))
    owned = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), F.col("l_partkey").alias("num")).distinct()
    return resources.content_streams(pages, owned.withColumn("content", F.concat(F.lit("stream of "), F.col("num").cast("string"))))


@query("""SELECT n_nationkey, p AS prefix, CASE p WHEN 'dc' THEN 'http://purl.org/dc/elements/1.1/' ELSE 'urn:own:' || n_regionkey END AS uri, CASE p WHEN 'dc' THEN 'dc:title,dc:creator' ELSE 'own:name' END AS properties FROM nation, (VALUES ('dc'), ('own')) v(p)""")
def info_namespaces(t: Tables) -> DataFrame:
    """Namespaces that metadata declares, with the properties of each."""
    xml = F.format_string('<rdf xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:own="urn:own:%d"><dc:title own:name="x">%s</dc:title><dc:creator/></rdf>', "n_regionkey", "n_name")
    found = resources.namespaces(t.nation.select("n_nationkey", xml.alias("xml")), "n_nationkey")
    return found.select("n_nationkey", "prefix", "uri", F.array_join("properties", ",").alias("properties"))


# --- checks of content ---

_CHECKED = """WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<(script|form|video|button)[^>]*>', 1)) AS tag FROM pages), p AS (SELECT page_id, list(tag) AS tags, any_value(page_id % 4) AS k FROM s GROUP BY 1),
    f AS (SELECT page_id AS doc_id, 'MALICIOUS_SCRIPT' AS code, 'Critical' AS severity FROM pages WHERE regexp_matches(regexp_extract(html, '<script[^>]*>([^<]*)', 1), 'eval\\s*\\(|Function\\s*\\(|document\\.|window\\.|XMLHttpRequest|fetch\\s*\\(|\\.innerHTML|\\.outerHTML|createElement')
    UNION ALL SELECT page_id, 'ANNOTATION_ACTION', 'Error' FROM pages WHERE contains(url, '?') UNION ALL SELECT page_id, 'WIDGET', 'Warning' FROM pages WHERE contains(html, '<form'))
"""


def _page_props(t: Tables) -> DataFrame:
    """Pages as nodes: their script, a widget where there is a form, a link otherwise, and an action where the address has a query."""
    entries = {"JS": F.regexp_extract("html", "<script[^>]*>([^<]*)", 1), "Subtype": F.when(F.col("html").contains("<form"), "Widget").otherwise("Link"), "A": F.when(F.col("url").contains("?"), F.col("url"))}
    props = F.map_filter(F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return t.pages.select(F.col("page_id").alias("doc_id"), props.alias("props"))


@query(_CHECKED + "SELECT doc_id, code, severity FROM f")
def sec_content_checks(t: Tables) -> DataFrame:
    return rules.findings(_page_props(t), resources.content_rules(F.col("props")), "doc_id")


@query(_CHECKED + "SELECT (SELECT count(*) FROM pages) AS n_checked, count(DISTINCT doc_id) AS n_with_findings, count(*) AS n_findings, count(*) FILTER (severity <> 'Warning') AS n_grave FROM f")
def sec_check_statistics(t: Tables) -> DataFrame:
    nodes = _page_props(t)
    return resources.check_statistics(rules.findings(nodes, resources.content_rules(F.col("props")), "doc_id"), nodes)


@query("SELECT page_id AS doc_id, strlen(html) <= 3000 AS clean, least(strlen(html), 3000) AS n_bytes FROM pages")
def sec_sanitized_streams(t: Tables) -> DataFrame:
    cut = resources.sanitised_streams(t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content")), 3000)
    return cut.select("doc_id", "clean", F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT doc_id, 'LARGE' AS state, 'Read the document in parts' AS advice FROM documents WHERE length(text) > 5000 UNION ALL SELECT doc_id, 'DAMAGED', 'Recover objects by a scan' FROM documents WHERE length(text) <> n_chars UNION ALL SELECT doc_id, 'SLOW', 'Raise the number of partitions' FROM documents WHERE len(string_split(text, chr(10))) > 30")
def health_advice(t: Tables) -> DataFrame:
    text = F.col("text")
    return resources.health_advice(t.documents, "doc_id", F.size(F.split(text, "\n")) > 30, F.length(text) > 5000, F.length(text) != F.col("n_chars"), F.lit(None).cast("boolean"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'VERSION_MISSING' WHEN 1 THEN 'VERSION_UNSUPPORTED' ELSE 'VERSION_INVALID' END AS code FROM part WHERE p_size % 4 < 3")
def val_report_versions(t: Tables) -> DataFrame:
    k = F.col("p_size") % 4
    version = F.when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0.7"))).when(k == 2, F.col("p_brand")).when(k == 3, "1.9.2")
    return graphs.report_version(t.part.where("p_size <> 1").select("p_partkey", version.alias("version")).unionByName(t.part.where("p_size = 1").select("p_partkey", F.lit("7.0").alias("version"))), "p_partkey")


# --- codecs, files, edges ---


def _round_trip(t: Tables, codec: str) -> DataFrame:
    """Documents through a codec and back."""
    back = filters.decoded(filters.coded(F.col("text").cast("binary"), codec), F.array(F.lit(f"{codec}Decode")), most=1 << 28, ratio=1 << 20)
    return t.documents.select("doc_id", back.cast("string").alias("back"))


@query("SELECT doc_id, text AS back FROM documents")
def codec_base85(t: Tables) -> DataFrame:
    return _round_trip(t, "ASCII85")


@query("SELECT doc_id, text AS back FROM documents")
def codec_run_length(t: Tables) -> DataFrame:
    return _round_trip(t, "RunLength")


@query("SELECT page_id, 'Flate' AS codec, true AS smaller, 'Compress it' AS advice FROM pages")
def codec_adaptive(t: Tables) -> DataFrame:
    """The codec of fewest bytes for each page, and advice; pages are markup, so the same codec wins on all."""
    content = F.col("html").cast("binary")
    tries = F.array(*[F.struct(F.lit(c).alias("codec"), F.octet_length(filters.coded(content, c)).alias("size")) for c in ("Flate", "RunLength", "ASCIIHex")])
    own = t.pages.select("page_id", F.octet_length("html").alias("bytes"), F.explode(tries).alias("x"))
    best = filters.smallest(own.select("page_id", "x.*"), "page_id").join(own.select("page_id", "bytes").distinct(), "page_id")
    return best.select("page_id", "codec", (F.col("size") < F.col("bytes")).alias("smaller"), filters.advice(F.lit("Structured"), F.col("bytes"), F.col("size")).alias("advice"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'DOUBLE_EXTENSION' ELSE 'HIDDEN_EXECUTABLE' END AS code FROM part WHERE p_partkey % 3 < 2")
def sec_file_names(t: Tables) -> DataFrame:
    """Names of attached files that hide what they are."""
    k = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(k == 0, ".pdf.exe").when(k == 1, " .exe").otherwise(".exe.pdf"))
    return rules.findings(t.part.select("p_partkey", name.alias("name")), security.file_rules(F.col("name")), "p_partkey").select("p_partkey", "code")


@query(ORG + "SELECT doc_id, node_type, count(*) AS n FROM (SELECT doc_id, node_type FROM n UNION ALL SELECT doc_id, 'note' FROM n WHERE node_type = 'customer') GROUP BY 1, 2")
def tf_insert(t: Tables) -> DataFrame:
    """A note under every customer."""
    g = org_graph(t)
    notes = g.of_type("customer").select("doc_id", (F.col("id") + 10**12).alias("id"), F.lit("note").alias("node_type"), "props", "value", "errors")
    grown = transforms.insert_nodes(g, notes, F.col("id") - 10**12)
    held = grown.children().select("doc_id", F.col("dst").alias("id")).unionByName(g.of_type("region").select("doc_id", "id"))
    return grown.nodes.join(held, ["doc_id", "id"], "left_semi").groupBy("doc_id", "node_type").agg(F.count("*").alias("n"))


@query(ORG + "SELECT count(*) AS n_edges, count(*) FILTER (WHERE src > 1000000 AND dst < 1000000) AS n_back FROM (SELECT src, dst FROM e UNION ALL SELECT id, parent FROM n WHERE node_type = 'customer')")
def tf_add_edges(t: Tables) -> DataFrame:
    """Edges from customers back to their nations, and as many to nodes that do not exist, which are left out."""
    g = org_graph(t)
    up = g.children().join(g.of_type("customer").select("doc_id", F.col("id").alias("dst")), ["doc_id", "dst"])
    back = up.select("doc_id", F.col("dst").alias("src"), F.explode(F.array("src", F.lit(-5).cast("long"))).alias("dst"), F.lit("Reference").alias("edge_type"), F.lit(1).alias("ord"))
    return transforms.add_edges(g, back).edges.agg(F.count("*").alias("n_edges"), F.count_if((F.col("src") > 1_000_000) & (F.col("dst") < 1_000_000)).alias("n_back"))


@query(ORG + "SELECT doc_id, parent AS root, id AS new_parent, true AS cycle FROM n WHERE node_type = 'order' UNION ALL SELECT doc_id, id, parent, false FROM n WHERE node_type = 'order' UNION ALL SELECT doc_id, doc_id, id, true FROM n WHERE node_type = 'customer'")
def tf_cyclic_moves(t: Tables) -> DataFrame:
    """Moves of customers below their orders, of orders below their customers, and of regions below customers."""
    g = org_graph(t)
    kids = g.children()
    walked = storage.table(tours.walk(kids.select("doc_id", "src", "dst", F.col("ord").alias("place")), g.of_type("region")), "walked")
    held = kids.join(g.of_type("order").select("doc_id", F.col("id").alias("dst")), ["doc_id", "dst"])
    moves = held.select("doc_id", F.col("src").alias("root"), F.col("dst").alias("new_parent")).unionByName(held.select("doc_id", F.col("dst").alias("root"), F.col("src").alias("new_parent")))
    return transforms.cyclic_moves(walked, moves.unionByName(g.of_type("customer").select("doc_id", F.col("doc_id").alias("root"), F.col("id").alias("new_parent"))))


@query("SELECT page_id, 'p' || page_id || '.pdf' AS file, strlen(html) AS length FROM pages WHERE page_id % 2 = 0")
def source_binary_files(t: Tables) -> DataFrame:
    """Pages as files, half of them with another ending, read by Spark's own reader of whole files."""
    where = storage.path(t.spark, "files")
    end = F.when(F.col("page_id") % 2 == 0, ".pdf").otherwise(".txt")
    t.pages.select(F.concat(F.lit("p"), "page_id", end).alias("name"), F.col("html").alias("value")).write.partitionBy("name").option("lineSep", "\x04").text(where)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).select(F.col("path"), "length")
    name = F.regexp_extract("path", "name=([^/]+)", 1)
    return files.where(name.endswith(".pdf")).select(F.regexp_extract(name, "([0-9]+)", 1).cast("long").alias("page_id"), name.alias("file"), (F.col("length") - 1).alias("length"))


@query("SELECT n_nationkey, '<row><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name></row>' AS xml FROM nation")
def sink_xml(t: Tables) -> DataFrame:
    rows = graphs.as_xml(t.nation.select("n_nationkey", "n_name"))
    return rows.select(F.regexp_extract("xml", "<n_nationkey>([0-9]+)", 1).cast("int").alias("n_nationkey"), F.regexp_replace("xml", ">\\s+<", "><").alias("xml"))


_CBOR_TEXT = "CASE WHEN strlen({0}) < 24 THEN printf('%02X', 96 + strlen({0})) WHEN strlen({0}) < 256 THEN '78' || printf('%02X', strlen({0})) ELSE '79' || printf('%04X', strlen({0})) END || hex(encode({0}))"


@query(f"SELECT doc_id, 'A3' || {_CBOR_TEXT.format("'lang'")} || {_CBOR_TEXT.format('lang')} || {_CBOR_TEXT.format("'source'")} || {_CBOR_TEXT.format('source')} || {_CBOR_TEXT.format("'text'")} || {_CBOR_TEXT.format('text')} AS cbor, text AS back FROM documents WHERE strlen(text) < 65536")
def sink_cbor(t: Tables) -> DataFrame:
    """Documents of under 64 KB, the longest that two bytes of size hold, as CBOR maps, and their texts read back."""
    own = t.documents.where(F.octet_length("text") < 1 << 16)
    coded = own.select("doc_id", cbor.encoded(F.create_map(F.lit("text"), "text", F.lit("lang"), "lang", F.lit("source"), "source")).alias("c"))
    return coded.select("doc_id", F.hex("c").alias("cbor"), F.try_element_at(cbor.decoded(F.col("c")), F.lit("text")).alias("back"))
