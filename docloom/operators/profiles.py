"""Profiles of structural rules over typed nodes with properties, such as ``sources.raw`` gives.

A rule about a document is a condition on one row of counts for it; a rule about nodes is a
filter.  Both give (doc_id, id, code, severity) rows, id null for the document as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .rules import Rule, compliance, findings, report

# Types and keys that the rules name.
FONTS = ["Font", "Type1Font", "TrueTypeFont", "Type3Font", "CIDFont"]
FONT_FILES = ["FontFile", "FontFile2", "FontFile3", "CIDFontFile"]
SCRIPTS = ["JavaScriptAction", "EmbeddedJS"]
OUTSIDE = ["ExternalReference", "URIAction"]
MEDIA = ["3D", "Movie", "Sound", "Screen", "RichMedia"]


def _count(kind: str) -> Column:
    return F.count_if(F.col("node_type") == kind)


def _first(kind: str, key: str) -> Column:
    """The key of a document's node of a type, the one of smallest id."""
    value = F.try_element_at("props", F.lit(key))
    return F.min_by(F.when(F.col("node_type") == kind, value), F.when(F.col("node_type") == kind, F.col("id")))


def document_rows(g: Graph, documents: DataFrame | None = None) -> DataFrame:
    """One row for each document, what its rules look at; with (doc_id) of all documents also those without any node."""
    keys = lambda kind, key: F.bool_or((F.col("node_type") == kind) & F.map_contains_key("props", key))
    by = g.nodes.groupBy("doc_id").agg(
        F.count("*").alias("n_nodes"),
        _count("Catalog").alias("n_catalogs"), _count("Pages").alias("n_trees"), _count("Page").alias("n_pages"), _count("Metadata").alias("n_metadata"), _count("StructTreeRoot").alias("n_structs"), _count("OutputIntent").alias("n_intents"),
        _first("Pages", "Count").try_cast("long").alias("stated_pages"), _first("Catalog", "Version").alias("version"), _first("Catalog", "Lang").alias("lang"), keys("Catalog", "Encrypt").alias("encrypted"),
    )
    to = g.nodes.select("doc_id", F.col("id").alias("dst"), F.col("node_type").alias("to_type"))
    from_ = g.nodes.select("doc_id", F.col("id").alias("src"), F.col("node_type").alias("from_type"))
    tree = g.edges.join(to, ["doc_id", "dst"]).join(from_, ["doc_id", "src"]).where("from_type = 'Catalog' and to_type = 'Pages'").select("doc_id", F.lit(True).alias("leads_to_pages")).distinct()
    if documents is not None:
        by = documents.select("doc_id").distinct().join(by, "doc_id", "left").fillna(0, [c for c in by.columns if c.startswith("n_")])
    return by.join(tree, "doc_id", "left").fillna(False, ["leads_to_pages"])


def document_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("EMPTY_DOCUMENT", "Critical", c("n_nodes") == 0),
        Rule("CATALOG_MISSING", "Critical", c("n_catalogs") == 0),
        Rule("MULTIPLE_CATALOGS", "Error", c("n_catalogs") > 1),
        Rule("PAGES_MISSING", "Error", c("n_trees") == 0),
        Rule("CATALOG_WITHOUT_PAGES", "Error", (c("n_catalogs") > 0) & ~c("leads_to_pages")),
        Rule("PAGES_COUNT_MISSING", "Error", (c("n_trees") > 0) & c("stated_pages").isNull()),
        Rule("PAGES_COUNT_MISMATCH", "Error", (c("n_trees") == 1) & (c("stated_pages") != c("n_pages"))),
        Rule("METADATA_MISSING", "Warning", c("n_metadata") == 0),
        Rule("LANG_MISSING", "Warning", F.coalesce(c("lang"), F.lit("")) == ""),
        Rule("NOT_TAGGED", "Warning", c("n_structs") == 0),
        Rule("OUTPUT_INTENTS_MISSING", "Warning", c("n_intents") == 0),
        Rule("ENCRYPTED", "Error", c("encrypted")),
    ]


def node_rules() -> list[Rule]:
    kind, has = F.col("node_type"), lambda key: F.map_contains_key("props", key)
    subtype = F.try_element_at("props", F.lit("Subtype"))
    embedded = F.arrays_overlap(F.map_keys("props"), F.array(*map(F.lit, FONT_FILES)))
    return [
        Rule("FONT_NOT_EMBEDDED", "Error", kind.isin(*FONTS) & ~embedded & ~has("FontDescriptor")),
        Rule("FONT_WITHOUT_ENCODING", "Warning", kind.isin(*FONTS) & ~has("Encoding") & ~has("ToUnicode")),
        Rule("JAVASCRIPT", "Error", kind.isin(*SCRIPTS) | (F.try_element_at("props", F.lit("S")) == "JavaScript")),
        Rule("EXTERNAL_REFERENCE", "Warning", kind.isin(*OUTSIDE) | (F.try_element_at("props", F.lit("S")) == "URI")),
        Rule("EMBEDDED_FILE", "Warning", kind.isin("EmbeddedFile", "Filespec")),
        Rule("MULTIMEDIA", "Error", (kind == "Annot") & subtype.isin(*MEDIA)),
        Rule("TRIM_BOX_MISSING", "Warning", (kind == "Page") & ~has("TrimBox")),
        Rule("TRANSPARENCY", "Warning", (subtype == "Transparency") | (F.try_element_at("props", F.lit("S")) == "Transparency")),
        Rule("IMAGE_LZW", "Warning", (subtype == "Image") & (F.try_element_at("props", F.lit("Filter")) == "LZWDecode")),
        Rule("ANNOTATION_NOT_ALLOWED", "Error", (kind == "Annot") & subtype.isin("Movie", "Sound", "FileAttachment")),
        Rule("ANNOTATION_WITHOUT_APPEARANCE", "Warning", (kind == "Annot") & ~has("AP") & ~F.coalesce(subtype == "Popup", F.lit(False))),
        Rule("DEVICE_COLOUR", "Warning", F.try_element_at("props", F.lit("ColorSpace")) == "DeviceRGB"),
        Rule("XFA_FORM", "Error", (kind == "AcroForm") & has("XFA")),
        Rule("ALT_MISSING", "Warning", (kind == "StructElem") & F.try_element_at("props", F.lit("S")).isin("Figure", "Formula", "Table") & ~has("Alt")),
    ]


#: Codes of each profile, and the severity that a profile gives to some.
PROFILES = {
    "structure": ["EMPTY_DOCUMENT", "CATALOG_MISSING", "MULTIPLE_CATALOGS", "PAGES_MISSING", "CATALOG_WITHOUT_PAGES", "PAGES_COUNT_MISSING", "PAGES_COUNT_MISMATCH"],
    "archive": ["CATALOG_MISSING", "PAGES_MISSING", "METADATA_MISSING", "ENCRYPTED", "FONT_NOT_EMBEDDED", "FONT_WITHOUT_ENCODING", "JAVASCRIPT", "EXTERNAL_REFERENCE", "EMBEDDED_FILE", "MULTIMEDIA", "TRANSPARENCY", "IMAGE_LZW", "ANNOTATION_NOT_ALLOWED", "ANNOTATION_WITHOUT_APPEARANCE", "DEVICE_COLOUR", "XFA_FORM"],
    "print": ["CATALOG_MISSING", "PAGES_MISSING", "OUTPUT_INTENTS_MISSING", "TRIM_BOX_MISSING", "FONT_NOT_EMBEDDED"],
    "access": ["CATALOG_MISSING", "NOT_TAGGED", "LANG_MISSING", "ALT_MISSING", "METADATA_MISSING"],
}


def file_rows(files: DataFrame) -> DataFrame:
    """One row for each raw file: what its head, its last trailer and its catalog say of it."""
    from ..sources import raw

    head = raw.overview(files).withColumnRenamed("path", "doc_id").select("doc_id", "major", "minor")
    catalog = document_rows(raw.graph(files)).select("doc_id", "version")
    trailer = raw.last_trailers(files).select("doc_id", "root", "size", "n_ids")
    return head.join(catalog, "doc_id", "left").join(trailer, "doc_id", "left")


def file_rules() -> list[Rule]:
    c = F.col
    declares = F.coalesce(c("version"), F.lit("")) == "2.0"
    return [
        Rule("TRAILER_ROOT_MISSING", "Critical", c("root").isNull()),
        Rule("TRAILER_SIZE_MISSING", "Error", c("size").isNull()),
        Rule("TRAILER_ID_INVALID", "Error", F.coalesce(c("n_ids"), F.lit(0)) != 2),
        Rule("VERSION_MISMATCH", "Error", (c("major") >= 2) != declares),
        Rule("VERSION_TOO_NEW", "Error", ~((c("major") == 1) & (c("minor") <= 4))),
    ]


def issues(g: Graph) -> DataFrame:
    """(doc_id, id, code, severity) of all rules."""
    whole = findings(document_rows(g), document_rules(), "doc_id").select("doc_id", F.lit(None).cast("long").alias("id"), "code", "severity")
    return whole.unionByName(findings(g.nodes, node_rules(), "doc_id", "id"))


def validate_all(g: Graph) -> DataFrame:
    """(doc_id, profile, counts, valid, status) of every document under every profile."""
    names = F.create_map(*[x for code in sorted({c for cs in PROFILES.values() for c in cs}) for x in (F.lit(code), F.array(*[F.lit(p) for p, cs in PROFILES.items() if code in cs]))])
    found = issues(g).withColumn("profile", F.explode(F.try_element_at(names, F.col("code"))))
    key = F.concat_ws("\x01", "doc_id", "profile")
    every = g.nodes.select("doc_id").distinct().withColumn("profile", F.explode(F.array(*map(F.lit, PROFILES))))
    done = report(found.withColumn("_k", key), every.withColumn("_k", key), "_k").withColumn("status", compliance(F.col("valid"), F.col("n_warning")))
    part = lambda i: F.get(F.split("_k", "\x01"), i)
    return done.select(part(0).alias("doc_id"), part(1).alias("profile"), "n_critical", "n_error", "n_warning", "n_info", "valid", "status")
