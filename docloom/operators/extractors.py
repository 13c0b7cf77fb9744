"""Parts of documents as rows: outlines, name trees, inherited resources, structure, forms, information."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from . import traversal

# --- outlines and orders ---


def list_places(items: DataFrame) -> DataFrame:
    """(doc_id, id, next) to (doc_id, id, place): places in linked lists, counted from 0.

    Pointers double: after k rounds each item knows the one 2 ** k before it, so a list of n
    items takes log n joins.  Items of a ring, which has no first, are left out.
    """
    before = items.where("next is not null").select("doc_id", F.col("next").alias("id"), F.col("id").alias("before"))
    now = items.select("doc_id", "id").join(before, ["doc_id", "id"], "left").withColumn("place", F.col("before").isNotNull().cast("long"))
    now = storage.table(now, "places")
    left = now.where("before is not null").count()
    while left:
        far = now.select("doc_id", F.col("id").alias("before"), F.col("before").alias("further"), F.col("place").alias("more"))
        stepped = now.join(far, ["doc_id", "before"], "left").select("doc_id", "id", F.col("further").alias("before"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        old, now = now, storage.table(stepped, "places")
        storage.free(old)
        last, left = left, now.where("before is not null").count()
        if left == last:  # only rings are left
            break
    return now.where("before is null").select("doc_id", "id", "place")


def visible_items(items: DataFrame) -> DataFrame:
    """(doc_id, n, n_visible): a negative count says that an item is shut."""
    return items.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("count", F.lit(0)) >= 0).alias("n_visible"))


# --- name trees ---


def all_names(names: DataFrame) -> DataFrame:
    """(doc_id, ord, name, value) of a tree's leaves, in the order of the walk, to one row for each name; the later counts."""
    last = names.groupBy("doc_id", "name").agg(F.max_by("value", "ord").alias("value"))
    return last.select("doc_id", "name", "value")


#: Formats by the end of a file's name.
MEDIA = {"mp3": "audio/mpeg", "wav": "audio/wav", "aiff": "audio/aiff", "au": "audio/basic", "ogg": "audio/ogg", "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "webm": "video/webm", "mkv": "video/x-matroska", "u3d": "model/u3d", "prc": "model/prc", "swf": "application/x-shockwave-flash"}


def media_format(name: Column) -> Column:
    """The format that a file's name says, null for others."""
    end = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv]), end)


def audio_format(content: Column) -> Column:
    """The format that the first bytes say, null for others."""
    start = F.hex(F.substring(content, 1, 12))
    return (
        F.when(start.startswith("494433") | start.startswith("FFFB"), "audio/mpeg")
        .when(start.startswith("52494646") & F.substring(start, 17, 8).eqNullSafe("57415645"), "audio/wav")
        .when(start.startswith("4F676753"), "audio/ogg")
        .when(start.startswith("464F524D"), "audio/aiff")
        .when(start.startswith("2E736E64"), "audio/basic")
    )


def embedded_files(specs: DataFrame) -> DataFrame:
    """(doc_id, name, props) of file specifications to a row for each: name, description, stated size, format."""
    get = lambda key: F.try_element_at("props", F.lit(key))
    name = F.coalesce(get("UF"), get("F"), F.col("name"))
    return specs.select("doc_id", "name", name.alias("file_name"), get("Desc").alias("description"), get("Size").try_cast("long").alias("size"), F.coalesce(get("Subtype"), media_format(name)).alias("format"))


# --- what pages inherit ---


def inherited(values: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(doc_id, id, key, value, owner): of each key the value of the nearest node above or at a node.

    ``values`` are (doc_id, id, key, value); a node's own value counts before any above it.
    """
    up = edges.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    above = traversal.closure(up, nodes.select("doc_id", "id"), depth).select("doc_id", F.col("start").alias("id"), F.col("id").alias("owner"), "depth")
    own = nodes.select("doc_id", "id", F.col("id").alias("owner"), F.lit(0).alias("depth"))
    held = values.select("doc_id", F.col("id").alias("owner"), "key", "value")
    met = own.unionByName(above).join(held, ["doc_id", "owner"])
    nearest = met.groupBy("doc_id", "id", "key").agg(F.min_by(F.struct("value", "owner"), "depth").alias("v"))
    return nearest.select("doc_id", "id", "key", "v.value", "v.owner")


# --- structure ---


def marked_text(ops: DataFrame) -> DataFrame:
    """(doc_id, ord, op, mcid, text) of a page's operators to (doc_id, mcid, text): what is shown while a marked sequence is open.

    Sequences may lie in others; a text belongs to the innermost.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    opens, closes = F.col("op").isin("BDC", "BMC"), F.col("op") == "EMC"
    level = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w)
    own = ops.withColumns({"level": level, "opened": F.when(opens, F.struct("ord", "mcid"))})
    # the innermost sequence that is open: the latest that was opened at the present level
    inner = F.last("opened", ignorenulls=True).over(Window.partitionBy("doc_id", "level").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    shown = own.withColumn("inner", inner).where((F.col("op") == "Tj") & (F.col("level") > 0)).select("doc_id", "ord", "inner", "text")
    by = shown.groupBy("doc_id", F.col("inner.mcid").alias("mcid")).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("t"))
    return by.where("mcid is not null").select("doc_id", "mcid", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


def linked_structure(content: DataFrame, elements: DataFrame) -> DataFrame:
    """Marked texts with the structure elements that name their page and number."""
    return content.join(elements, ["doc_id", "mcid"])


#: Attributes of accessibility, by the key that holds each.
ATTRIBUTES = {"alt": "Alt", "actual_text": "ActualText", "expansion": "E", "language": "Lang", "title": "T", "scope": "Scope", "headers": "Headers"}


def attributes(props: Column) -> Column:
    return F.struct(*[F.try_element_at(props, F.lit(k)).alias(n) for n, k in ATTRIBUTES.items()])


# --- forms ---


def field_counts(forms: DataFrame, edges: DataFrame, depth: int = 64) -> DataFrame:
    """(doc_id, id) of forms and the edges of their fields to (doc_id, n_fields, n_terminal): fields at most ``depth`` steps below, and those without fields of their own."""
    below = traversal.closure(edges, forms.select("doc_id", "id"), depth).select("doc_id", "id").distinct()
    parents = edges.select("doc_id", F.col("src").alias("id")).distinct().withColumn("inner", F.lit(True))
    by = below.join(parents, ["doc_id", "id"], "left").groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.count_if(F.col("inner").isNull()).alias("n_terminal"))
    return forms.select("doc_id").distinct().join(by, "doc_id", "left").fillna(0, ["n_fields", "n_terminal"])


def hybrid(has_xfa: Column, n_fields: Column) -> Column:
    """Whether a form has both packets and fields of its own."""
    return has_xfa & (n_fields > 0)


def xfa_packets(forms: DataFrame) -> DataFrame:
    """(doc_id, xfa: XML) to (doc_id, ord, packet, body): the elements of the topmost element, which may not hold one of their own name."""
    inner = F.regexp_extract("xfa", "(?s)^\\s*(?:<\\?.*?\\?>\\s*)?<([A-Za-z:]+)[^>]*>(.*)</\\1>\\s*$", 2)
    parts = F.regexp_extract_all(inner, F.lit("(?s)<([A-Za-z:]+)(?:\\s[^>]*)?>.*?</\\1>"), F.lit(0))
    each = forms.select("doc_id", F.posexplode(parts).alias("ord", "part"))
    return each.select("doc_id", "ord", F.regexp_extract("part", "^<([A-Za-z:]+)", 1).alias("packet"), F.regexp_extract("part", "(?s)^<[^>]*>(.*)</[^>]*>$", 1).alias("body"))


# --- information ---

#: Fields of a document's information, and the property of its metadata that says the same.
INFO = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "created": "CreationDate", "modified": "ModDate", "trapped": "Trapped"}
SAME = {"title": "dc:title", "author": "dc:creator", "subject": "dc:description", "keywords": "pdf:Keywords", "creator": "xmp:CreatorTool", "producer": "pdf:Producer"}


def information(props: Column) -> Column:
    """The nine fields as a struct; absent ones are null."""
    return F.struct(*[F.try_element_at(props, F.lit(k)).alias(n) for n, k in INFO.items()])


def incoherent(rows: DataFrame, info: str = "info", xmp: str = "xmp", key: str = "doc_id") -> DataFrame:
    """(key, field, info_value, xmp_value) of fields that both have and that differ."""
    each = [F.struct(F.lit(n).alias("field"), F.try_element_at(info, F.lit(INFO[n])).alias("info_value"), F.try_element_at(xmp, F.lit(p)).alias("xmp_value")) for n, p in SAME.items()]
    return rows.select(key, F.explode(F.array(*each)).alias("f")).select(key, "f.*").where("info_value <> xmp_value")


def has_geography(xmp: Column) -> Column:
    return F.exists(F.map_keys(xmp), lambda k: k.startswith("exif:GPS") | k.startswith("geo:"))


def has_camera(xmp: Column) -> Column:
    keys = ["tiff:Make", "tiff:Model", "exif:ExposureTime", "exif:FNumber", "exif:ISOSpeedRatings", "aux:Lens"]
    return F.exists(F.map_keys(xmp), lambda k: k.isin(keys))


# --- output intents, types ---


def intent_issues(props: Column) -> Column:
    """What is wrong with an output intent, as codes."""
    get = lambda key: F.coalesce(F.try_element_at(props, F.lit(key)), F.lit(""))
    return F.array_compact(F.array(
        F.when(get("S") == "", "SUBTYPE_MISSING"),
        F.when((get("OutputConditionIdentifier") == "") & ~F.map_contains_key(props, "DestOutputProfile"), "CONDITION_MISSING"),
        F.when((get("S") == "GTS_PDFX") & (get("Info") == "") & ~F.map_contains_key(props, "DestOutputProfile"), "INFO_MISSING"),
    ))


#: Node types of annotations by their subtype.
ANNOTATIONS = {"Link": "LinkAnnotation", "Widget": "WidgetAnnotation", "Movie": "MediaAnnotation", "Sound": "MediaAnnotation", "Screen": "MediaAnnotation", "RichMedia": "MediaAnnotation", "3D": "MediaAnnotation", "FileAttachment": "FileAnnotation", "Popup": "PopupAnnotation"}


def refined_type(kind: Column, props: Column) -> Column:
    """A finer type where properties tell more than the type."""
    get = lambda key: F.try_element_at(props, F.lit(key))
    annotation = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ANNOTATIONS.items() for x in kv]), get("Subtype")), F.lit("Annotation"))
    return (
        F.when(kind == "Annot", annotation)
        .when((kind == "XObject") | get("Subtype").isin("Image", "Form"), F.when(get("Subtype") == "Image", "ImageXObject").when(get("Subtype") == "Form", "FormXObject").otherwise(kind))
        .when(kind == "Font", F.concat(F.coalesce(get("Subtype"), F.lit("")), F.lit("Font")))
        .when((kind == "Action") | (kind == "Object") & get("S").isin("JavaScript", "URI", "Launch", "GoTo"), F.concat(F.coalesce(get("S"), F.lit("")), F.lit("Action")))
        .otherwise(kind)
    )


# --- reports ---

#: Advice for codes of findings.
ADVICE = {"SUSPICIOUS_URL": "Check the links", "DATA_EXFILTRATION": "Block outgoing data", "RISKY_LINK": "Check the links", "OBFUSCATED": "Disable scripts", "SHELLCODE": "Isolate the document", "HEAP_SPRAY": "Isolate the document", "SUSPICIOUS_WORDS": "Disable scripts", "DOUBLE_EXTENSION": "Do not open attachments", "HIDDEN_EXECUTABLE": "Do not open attachments"}
#: Codes that concern privacy.
PRIVATE = ["PRIVACY_RISK", "DATA_LEAKAGE", "DATA_EXFILTRATION"]


def recommendations(found: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, advice): what to do about the codes of a subject, each advice once."""
    text = F.try_element_at(F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv]), F.col("code"))
    return found.select(by, text.alias("advice")).where("advice is not null").distinct()


def privacy_risks(found: DataFrame) -> DataFrame:
    return found.where(F.col("code").isin(PRIVATE))


def quick_check(found: DataFrame, subjects: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, safe): no finding of high severity or worse."""
    bad = found.groupBy(by).agg(F.bool_or(F.col("severity").isin("Critical", "High", "Error")).alias("bad"))
    return subjects.select(by).distinct().join(bad, by, "left").select(by, (~F.coalesce("bad", F.lit(False))).alias("safe"))


def as_yaml(rows: DataFrame, key: str) -> DataFrame:
    """(key, yaml): a line for each column, strings as JSON strings, which YAML takes too; nulls are ``null``."""
    def value(name: str, kind: str) -> Column:
        text = F.col(name).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.coalesce(quoted if kind == "string" else text, F.lit("null"))

    return rows.select(key, F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), value(n, k)) for n, k in rows.dtypes]).alias("yaml"))


def as_toml(rows: DataFrame, key: str) -> DataFrame:
    """(key, toml): a line for each column that is not null, since the format knows no null."""
    def line(name: str, kind: str) -> Column:
        text = F.col(name).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.concat(F.lit(f"{name} = "), quoted if kind == "string" else text)

    return rows.select(key, F.concat_ws("\n", *[line(n, k) for n, k in rows.dtypes]).alias("toml"))


# --- calculators, images, fragments, media ---


def inline_images(programs: DataFrame, key: str = "doc_id", text: str = "program") -> DataFrame:
    """(key, ord, width, height, depth, filter, n_chars) of images that stand in a page program between BI, ID and EI."""
    each = programs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("(?s)\\bBI\\b\\s(.*?)\\bID\\s(?:.*?)\\sEI\\b"), F.lit(0))).alias("ord", "image"))
    head, body = F.regexp_extract("image", "(?s)^BI\\s(.*?)\\bID\\s", 1), F.regexp_extract("image", "(?s)\\bID\\s(.*)\\sEI$", 1)
    number = lambda short, long: F.regexp_extract(head, f"/(?:{short}|{long})\\s+([0-9]+)", 1).try_cast("long")
    name = F.regexp_extract(head, "/(?:F|Filter)\\s*/([A-Za-z0-9]+)", 1)
    return each.select(key, "ord", number("W", "Width").alias("width"), number("H", "Height").alias("height"), number("BPC", "BitsPerComponent").alias("depth"), F.when(name != "", name).alias("filter"), F.length(body).alias("n_chars"))


def fragments(rows: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """(key, ord, n_bytes, sha256): binary content in pieces of so many bytes, each with its digest."""
    starts = F.when(F.octet_length(content) > 0, F.sequence(F.lit(0), F.floor((F.octet_length(content) - 1) / size).cast("int")))
    each = rows.select(key, content, F.explode(starts).alias("ord"))
    part = F.substring(content, F.col("ord") * size + 1, F.lit(size))
    return each.select(key, "ord", F.octet_length(part).alias("n_bytes"), F.sha2(part, 256).alias("sha256"))


#: Kinds of media by an annotation's subtype, and the keys that tell of each.
MEDIA_KEYS = {"RichMedia": ["Activation", "Views", "Assets"], "3D": ["3DD", "3DV", "3DA"], "Sound": ["R", "C", "B", "E"], "Movie": ["Aspect", "Rotate", "Poster"]}


def media(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, kind, info) of media annotations: the keys that tell of their kind, with their values."""
    subtype = F.try_element_at("props", F.lit("Subtype"))
    wanted = F.try_element_at(F.create_map(*[x for k, v in MEDIA_KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), subtype)
    own = nodes.where(subtype.isin(*MEDIA_KEYS)).withColumn("wanted", wanted)
    return own.select("doc_id", "id", subtype.alias("kind"), F.map_filter("props", lambda k, v: F.array_contains("wanted", k)).alias("info"))
