"""Outlines, names, inherited values, structure, forms, information and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calculators, filters
from ..graph import NATION, ORDER, Tables, org_graph
from ..operators import extractors as x
from ..operators import rules, security, tours
from ..sources import graphs
from .registry import ORG, query


def _children(t: Tables) -> DataFrame:
    """Containment edges with their places."""
    return org_graph(t).children().select("doc_id", "src", "dst", F.col("ord").alias("place"))


@query("SELECT n_regionkey::BIGINT AS doc_id, n_nationkey + 100::BIGINT AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place FROM nation")
def outline_places(t: Tables) -> DataFrame:
    """Nations of a region as a linked list, each naming the next."""
    after = F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    items = t.nation.select(F.col("n_regionkey").cast("long").alias("doc_id"), (F.col("n_nationkey") + NATION).cast("long").alias("id"), (after + NATION).cast("long").alias("next"))
    return x.list_places(items)


@query("SELECT c_nationkey AS doc_id, count(*) AS n, count(*) FILTER (coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, 0) >= 0) AS n_visible FROM customer GROUP BY 1")
def outline_visible(t: Tables) -> DataFrame:
    return x.visible_items(t.customer.select(F.col("c_nationkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("count")))


@query(ORG + """SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE node_type WHEN 'region' THEN -1 WHEN 'nation' THEN id ELSE parent END, CASE node_type WHEN 'customer' THEN id ELSE -1 END) AS place FROM n WHERE node_type <> 'order'""")
def graph_dfs_order(t: Tables) -> DataFrame:
    """The order of a walk in depth over regions, nations and customers."""
    roots = org_graph(t).of_type("region").select("doc_id", "id")
    return tours.walk(_children(t).where(F.col("dst") < ORDER), roots).select("doc_id", "id", "place")


@query("SELECT p_brand AS doc_id, p_type AS name, max(p_partkey)::VARCHAR AS value FROM part GROUP BY 1, 2")
def names_all(t: Tables) -> DataFrame:
    """Names of each brand's tree; of a name that occurs twice the later value counts."""
    return x.all_names(t.part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("name"), F.col("p_partkey").cast("string").alias("value")))


_ENDS = "CASE p_partkey % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.MOV' WHEN 2 THEN '.txt' ELSE '' END"


@query(f"""SELECT p_partkey AS doc_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand || {_ENDS} ELSE p_name || {_ENDS} END AS file_name, p_type AS description, p_size::BIGINT AS size,
    CASE WHEN p_partkey % 5 = 0 THEN 'text/x' ELSE CASE p_partkey % 4 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'video/quicktime' END END AS format FROM part""")
def names_embedded_files(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, ".mp3").when(k % 4 == 1, ".MOV").when(k % 4 == 2, ".txt").otherwise("")
    entries = [("UF", F.when(k % 3 == 0, F.concat("p_brand", end))), ("F", F.concat("p_name", end)), ("Desc", F.col("p_type")), ("Size", F.col("p_size").cast("string")), ("Subtype", F.when(k % 5 == 0, "text/x"))]
    props = F.map_filter(F.create_map(*[c for n, v in entries for c in (F.lit(n), v)]), lambda _, v: v.isNotNull())
    return x.embedded_files(t.part.select(k.alias("doc_id"), F.col("p_name").alias("name"), props.alias("props")))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/wav' WHEN 2 THEN 'audio/ogg' WHEN 3 THEN 'audio/basic' END AS format FROM part")
def media_audio_format(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 5
    start = F.when(k == 0, "ID3\x04").when(k == 1, "RIFF1234WAVE").when(k == 2, "OggS").when(k == 3, ".snd").otherwise("RIFF1234AVI ")
    return t.part.select("p_partkey", x.audio_format(F.concat(start, "p_name").cast("binary")).alias("format"))


@query(ORG + """, h AS (SELECT c.doc_id, c.id, c.tag AS segment, c.id % 3 = 0 AS own, p.name AS nation, p.id % 2 = 0 AS held, r.name AS region, p.id AS pid, r.id AS rid FROM n c JOIN n p ON p.id = c.parent AND p.doc_id = c.doc_id JOIN n r ON r.id = p.parent AND r.doc_id = c.doc_id WHERE c.node_type = 'customer')
    SELECT doc_id, id, 'Font' AS key, CASE WHEN own THEN segment WHEN held THEN nation ELSE region END AS value, CASE WHEN own THEN id WHEN held THEN pid ELSE rid END AS owner FROM h""")
def content_inherited(t: Tables) -> DataFrame:
    """What each customer has of a key that some customers, some nations and all regions give."""
    g = org_graph(t)
    gives = (F.col("node_type") == "region") | (F.col("node_type") == "nation") & (F.col("id") % 2 == 0) | (F.col("node_type") == "customer") & (F.col("id") % 3 == 0)
    value = F.coalesce(F.try_element_at("props", F.lit("segment")), F.try_element_at("props", F.lit("name")))
    values = g.nodes.where(gives).select("doc_id", "id", F.lit("Font").alias("key"), value.alias("value"))
    return x.inherited(values, g.children().where(F.col("dst") < ORDER), g.of_type("customer"), depth=2)


@query("SELECT l_orderkey AS doc_id, l_linenumber AS mcid, max(l_returnflag) || max(l_linestatus) AS text, CASE l_linenumber % 3 WHEN 0 THEN 'H1' WHEN 1 THEN 'P' END AS tag FROM lineitem WHERE l_linenumber % 3 < 2 GROUP BY 1, 2")
def content_structure_links(t: Tables) -> DataFrame:
    """Marked texts of a page, one sequence for each line of an order, with the elements that they belong to."""
    n = F.col("l_linenumber").cast("long")
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("l_linestatus"))
    none = F.lit(None)
    parts = [("BDC", n, none), ("Tj", none, F.col("l_returnflag")), ("Tj", none, F.col("l_linestatus")), ("EMC", none, none), ("Tj", none, F.lit("loose"))]
    ops = F.array(*[F.struct((n * 10 + k).alias("ord"), F.lit(o).alias("op"), m.cast("long").alias("mcid"), s.cast("string").alias("text")) for k, (o, m, s) in enumerate(parts)])
    shown = x.marked_text(lines.select(F.col("l_orderkey").alias("doc_id"), F.explode(ops).alias("o")).select("doc_id", "o.*"))
    elements = lines.where(n % 3 < 2).select(F.col("l_orderkey").alias("doc_id"), n.alias("mcid"), F.when(n % 3 == 0, "H1").otherwise("P").alias("tag"))
    return x.linked_structure(shown, elements)


@query("SELECT p_partkey, p_name AS alt, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS language, NULL::VARCHAR AS scope FROM part")
def content_attributes(t: Tables) -> DataFrame:
    props = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("Alt"), "p_name", F.lit("Lang"), "p_brand")).otherwise(F.create_map(F.lit("Alt"), "p_name"))
    return t.part.select("p_partkey", x.attributes(props).alias("a")).select("p_partkey", "a.alt", "a.language", "a.scope")


@query(ORG + "SELECT doc_id, count(*) FILTER (node_type <> 'region') AS n_fields, count(*) FILTER (node_type <> 'region' AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = n.doc_id AND e.src = n.id)) AS n_terminal, doc_id % 2 = 0 AND count(*) > 1 AS hybrid FROM n GROUP BY doc_id")
def form_field_counts(t: Tables) -> DataFrame:
    """Regions as forms: fields are all that they hold, terminal ones hold no others."""
    g = org_graph(t)
    by = x.field_counts(g.of_type("region"), g.children(), depth=3)
    return by.select("doc_id", "n_fields", "n_terminal", x.hybrid(F.col("doc_id") % 2 == 0, F.col("n_fields")).alias("hybrid"))


@query("SELECT n_nationkey AS doc_id, i AS ord, CASE i WHEN 0 THEN 'template' ELSE 'datasets' END AS packet, CASE i WHEN 0 THEN n_name ELSE '<f>' || n_regionkey || '</f>' END AS body FROM nation, unnest([0, 1]) AS u(i)")
def form_packets(t: Tables) -> DataFrame:
    xfa = F.format_string('<?xml version="1.0"?><xdp a="b"><template>%s</template> <datasets x="y"><f>%d</f></datasets></xdp>', "n_name", "n_regionkey")
    return x.xfa_packets(t.nation.select(F.col("n_nationkey").alias("doc_id"), xfa.alias("xfa")))


@query("SELECT doc_id, lang AS title, source AS author, NULL::VARCHAR AS subject, n_chars::VARCHAR AS created FROM documents")
def info_fields(t: Tables) -> DataFrame:
    props = F.create_map(F.lit("Title"), "lang", F.lit("Author"), "source", F.lit("CreationDate"), F.col("n_chars").cast("string"))
    return t.documents.select("doc_id", x.information(props).alias("i")).select("doc_id", "i.title", "i.author", "i.subject", "i.created")


@query("SELECT doc_id, 'author' AS field, source AS info_value, lang AS xmp_value FROM documents WHERE source <> lang UNION ALL SELECT doc_id, 'title', lang, 'en' FROM documents WHERE lang <> 'en'")
def info_incoherent(t: Tables) -> DataFrame:
    """Fields in which a document's information and its metadata differ."""
    info = F.create_map(F.lit("Title"), "lang", F.lit("Author"), "source")
    xmp = F.create_map(F.lit("dc:title"), F.lit("en"), F.lit("dc:creator"), "lang")
    return x.incoherent(t.documents.select("doc_id", info.alias("info"), xmp.alias("xmp")))


@query("SELECT event_id, event_id % 3 = 0 AS geographic, event_id % 3 = 1 AS camera FROM events")
def info_flags(t: Tables) -> DataFrame:
    key = F.when(F.col("event_id") % 3 == 0, "exif:GPSLatitude").when(F.col("event_id") % 3 == 1, "tiff:Model").otherwise("dc:title")
    xmp = F.create_map(key, F.lit("1"))
    return t.events.select("event_id", x.has_geography(xmp).alias("geographic"), x.has_camera(xmp).alias("camera"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CONDITION_MISSING' WHEN 1 THEN 'SUBTYPE_MISSING' END AS issue FROM part WHERE p_partkey % 3 < 2")
def val_output_intents(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    props = F.when(k == 0, F.create_map(F.lit("S"), F.lit("GTS_PDFA1"))).when(k == 1, F.create_map(F.lit("OutputConditionIdentifier"), "p_brand")).otherwise(F.create_map(F.lit("S"), F.lit("GTS_PDFX"), F.lit("DestOutputProfile"), "p_brand"))
    return t.part.select("p_partkey", F.explode(x.intent_issues(props)).alias("issue"))


@query("SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'LinkAnnotation' WHEN 1 THEN 'ImageXObject' WHEN 2 THEN 'TrueTypeFont' WHEN 3 THEN 'URIAction' ELSE 'Annotation' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def sel_refined_types(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    kind = F.when(k == 0, "Annot").when(k == 1, "XObject").when(k == 2, "Font").when(k == 3, "Object").otherwise("Annot")
    props = F.create_map(F.when(k == 3, "S").otherwise("Subtype"), F.when(k == 0, "Link").when(k == 1, "Image").when(k == 2, "TrueType").when(k == 3, "URI").otherwise("Ink"))
    return t.events.groupBy("event_type", x.refined_type(kind, props).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_quantity, round(CASE WHEN l_quantity < 25 THEN l_quantity / 25 * 4 ELSE 4 - (l_quantity - 25) / 25 * 3 END, 6) AS v, count(*) AS n FROM lineitem GROUP BY 1")
def sc_sampled_function(t: Tables) -> DataFrame:
    """Quantities through a function of three samples."""
    v = calculators.sampled([F.col("l_quantity")], F.lit(bytes([0, 4, 1])), [3], 8, [(0, 50)], [(0, 255)])[0]
    return t.lineitem.groupBy("l_quantity", F.round(v, 6).alias("v")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, text AS back, (octet_length(encode(text)) // 16 + 2) * 16 AS n_bytes FROM documents")
def sc_aes(t: Tables) -> DataFrame:
    """Texts through AES in chained blocks and back; the first block is the initial vector."""
    key, mode = F.lit(b"0123456789abcdef"), F.lit("CBC")
    coded = F.aes_encrypt(F.col("text").cast("binary"), key, mode, F.lit("PKCS"), F.lit(bytes(range(16))))
    back = F.aes_decrypt(coded, key, mode, F.lit("PKCS"))
    return t.documents.select("doc_id", back.cast("string").alias("back"), F.octet_length(coded).cast("long").alias("n_bytes"))


#: Every link of a page, its own address and the targets that it names, and of a document: the hosts and the mail addresses that it names, as links.
_LINKS = """WITH u AS (SELECT 'p' || page_id AS page_id, unnest([url] || regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url FROM pages
    UNION ALL SELECT 'd' || doc_id, 'http://' || unnest(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) FROM documents
    UNION ALL SELECT 'd' || doc_id, 'https://mail.example.org/?user=' || unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) FROM documents), l AS (SELECT page_id, url, lower(url) AS low FROM u),
f AS (SELECT page_id, 'SUSPICIOUS_URL' AS code FROM l WHERE regexp_matches(low, 'https?://[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}') OR regexp_matches(low, '[.]tk|[.]ml|[.]ga|[.]cf|[.]cc|[.]info|[.]biz|bit[.]ly|tinyurl|t[.]co|goo[.]gl|ow[.]ly|is[.]gd|/download|/exe|/install|/setup|/update')
UNION ALL SELECT page_id, 'DATA_EXFILTRATION' FROM l WHERE regexp_matches(low, '[?&](data|info|user)=') OR (contains(low, '=') AND strlen(url) > 100 AND strlen(split_part(url, '?', 2)) > 50 AND regexp_matches(split_part(url, '?', 2), '^[A-Za-z0-9=&]*$'))
UNION ALL SELECT page_id, 'RISKY_LINK' FROM l WHERE regexp_matches(low, '^(ftp://|file://|javascript:|data:)') OR regexp_matches(low, 'bit[.]ly|tinyurl[.]com|t[.]co|goo[.]gl|ow[.]ly|is[.]gd|[.][.]|localhost|127[.]0[.]0[.]1|192[.]168[.]|10[.]') OR len(string_split(low, '.')) > 7)
"""


def _findings(t: Tables) -> DataFrame:
    """Findings about the links of pages and documents."""
    links = F.concat(F.array("url"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    found = lambda pattern, start: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit(start), x))
    named = F.concat(found("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "http://"), found("[A-Za-z0-9._]+@[A-Za-z0-9.]+", "https://mail.example.org/?user="))
    own = t.pages.select(F.concat(F.lit("p"), "page_id").alias("doc_id"), F.explode(links).alias("url"))
    own = own.unionByName(t.documents.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.explode(named).alias("url")))
    return rules.findings(own, security.url_rules(F.col("url")), "doc_id")


@query(_LINKS + "SELECT page_id AS doc_id, count(*) AS n FROM f WHERE code = 'DATA_EXFILTRATION' GROUP BY 1")
def sec_privacy_risks(t: Tables) -> DataFrame:
    return x.privacy_risks(_findings(t)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(_LINKS + "SELECT doc_id, doc_id NOT IN (SELECT page_id FROM f WHERE code = 'DATA_EXFILTRATION') AS safe FROM (SELECT 'p' || page_id AS doc_id FROM pages UNION ALL SELECT 'd' || doc_id FROM documents)")
def sec_quick_check(t: Tables) -> DataFrame:
    subjects = t.pages.select(F.concat(F.lit("p"), "page_id").alias("doc_id")).unionByName(t.documents.select(F.concat(F.lit("d"), "doc_id").alias("doc_id")))
    return x.quick_check(_findings(t), subjects)


@query(_LINKS + "SELECT DISTINCT page_id AS doc_id, CASE code WHEN 'DATA_EXFILTRATION' THEN 'Block outgoing data' ELSE 'Check the links' END AS advice FROM f")
def sec_recommendations(t: Tables) -> DataFrame:
    return x.recommendations(_findings(t))


@query("SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: \"' || n_name || '\"' AS yaml FROM nation")
def sink_yaml(t: Tables) -> DataFrame:
    return x.as_yaml(t.nation.select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT n_nationkey, 'n_nationkey = ' || n_nationkey || chr(10) || 'n_name = \"' || n_name || '\"' AS toml FROM nation")
def sink_toml(t: Tables) -> DataFrame:
    return x.as_toml(t.nation.select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT page_id, html AS back FROM pages")
def codec_predictor(t: Tables) -> DataFrame:
    """Pages as rows of eight bytes, each coded by what differs from the row above, and back."""
    return t.pages.select("page_id", filters.unpredicted(filters.predicted(F.col("html").cast("binary"), 8), 12, 8).cast("string").alias("back"))


@query("SELECT doc_id, text AS back FROM documents")
def codec_lzw(t: Tables) -> DataFrame:
    """Texts through the variable-width dictionary code and back."""
    coded = filters.lzw_coded(F.col("text").cast("binary"))
    return t.documents.select("doc_id", filters.decoded(coded, F.array(F.lit("LZWDecode")), most=1 << 28, ratio=1 << 20).cast("string").alias("back"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Text' WHEN 1 THEN 'Image' WHEN 2 THEN 'Vector' WHEN 3 THEN 'Structured' ELSE 'Binary' END AS kind, CASE n_nationkey % 5 WHEN 1 THEN 'DCT' WHEN 2 THEN 'LZW' WHEN 4 THEN 'RunLength' ELSE 'Flate' END AS codec FROM nation")
def codec_choice(t: Tables) -> DataFrame:
    """Which kind of content a stream is, and the codec for it: one stream of each kind."""
    k = F.col("n_nationkey") % 5
    wide = F.repeat(F.lit("\xe9"), 400)
    stream = F.when(k == 0, "plain words of a text").when(k == 1, F.concat(F.decode(F.unhex(F.lit("89504E47")), "ISO-8859-1"), wide))
    stream = stream.when(k == 2, F.concat(wide, F.repeat(F.lit("\xe9m \xe9l "), 30))).when(k == 3, F.concat(wide, F.repeat(F.lit("\xe9/\xe9[\xe9]\xe9"), 40))).otherwise(wide)
    kind = filters.content_class(stream)
    return t.nation.select("n_nationkey", kind.alias("kind"), filters.best_codec(kind, stream).alias("codec"))


@query("SELECT l_quantity, round(sqrt(abs(l_quantity * l_quantity / 2 - 10)) + l_quantity, 6) AS v, count(*) AS n FROM lineitem GROUP BY 1")
def sc_calculator(t: Tables) -> DataFrame:
    """Quantities through a postfix program."""
    v = calculators.calculated([F.col("l_quantity")], "{ dup dup mul 2 div 10 sub abs sqrt exch add }")[-1]
    return t.lineitem.groupBy("l_quantity", F.round(v, 6).alias("v")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, i AS ord, (p_size + i)::BIGINT AS width, p_size::BIGINT AS height, 8::BIGINT AS depth, CASE i WHEN 0 THEN 'AHx' END AS filter, length(p_brand) AS n_chars FROM part, unnest([0, 1]) AS u(i)")
def content_inline_images(t: Tables) -> DataFrame:
    """Two images in the page program of each part."""
    image = lambda i, more: F.concat(F.format_string("q BI /W %d /Height %d /BPC 8", F.col("p_size") + i, F.col("p_size")), F.lit(more + " ID "), "p_brand", F.lit("\nEI Q\n"))
    return x.inline_images(t.part.select(F.col("p_partkey").alias("doc_id"), F.concat(image(0, " /F /AHx"), image(1, "")).alias("program")))


@query("SELECT event_id, i AS ord, length(substr(props, 8 * i + 1, 8)) AS n_bytes, sha256(substr(props, 8 * i + 1, 8)) AS sha256 FROM events, unnest(range((length(props) + 7) // 8)) AS u(i)")
def sc_fragments(t: Tables) -> DataFrame:
    return x.fragments(t.events.select("event_id", F.col("props").cast("binary").alias("content")), "event_id", "content", 8)


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Sound' ELSE 'Movie' END AS kind, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE p_type END AS told FROM part WHERE p_partkey % 3 < 2")
def media_annotations(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    props = F.create_map(F.lit("Subtype"), F.when(k == 0, "Sound").when(k == 1, "Movie").otherwise("Link"), F.lit("R"), F.col("p_brand"), F.lit("Aspect"), F.col("p_type"))
    nodes = t.part.select(F.lit("a").alias("doc_id"), F.col("p_partkey").alias("id"), props.alias("props"))
    return x.media(nodes).select("id", "kind", F.element_at(F.map_values("info"), 1).alias("told"))


@query("SELECT c_custkey AS id, c_mktsegment AS node_type, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, '1.1.0' AS schema_version, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 0 END AS n_errors FROM customer")
def sink_migrated(t: Tables) -> DataFrame:
    """A mixture of rows of three versions, brought up to the present one."""
    k = F.col("c_custkey") % 3
    named = F.create_map(F.lit("name"), "c_name")
    old = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(k == 0, "0.9.0").when(k == 1, "1.0.0").otherwise("1.1.0").alias("schema_version"), F.when(k == 0, F.col("c_mktsegment")).alias("kind"),
        F.when(k > 0, F.col("c_mktsegment")).alias("node_type"), F.when(k == 1, named).alias("properties"), F.when(k == 2, named).alias("props"),
    )
    new = graphs.migrated(old)
    return new.select("id", "node_type", F.try_element_at("props", F.lit("name")).alias("name"), "schema_version", F.when(F.col("errors").isNotNull(), F.size("errors")).alias("n_errors"))


@query(ORG + """SELECT 'nodes' AS "table", c AS "column", k AS kind, (SELECT count(*) FROM n) AS n, CASE c WHEN 'value' THEN (SELECT count(*) FROM n WHERE value IS NULL) ELSE 0 END AS n_null FROM (VALUES ('doc_id', 'bigint'), ('id', 'bigint'), ('node_type', 'string'), ('props', 'map'), ('value', 'double'), ('errors', 'array')) v(c, k)
    UNION ALL SELECT 'edges', c, k, (SELECT count(*) FROM e), 0 FROM (VALUES ('doc_id', 'bigint'), ('src', 'bigint'), ('dst', 'bigint'), ('edge_type', 'string'), ('ord', 'int')) v(c, k)""")
def sink_schema(t: Tables) -> DataFrame:
    """The schema that the rows of the ORG graph have, and how many hold nothing."""
    return graphs.described(org_graph(t))
