"""What pages use, as rows: colour profiles and spaces, graphics states, output intents, scripts, streams, metadata namespaces; and checks of their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import Rule

# --- colour ---


def _tag(content: Column, at: int) -> Column:
    """Four bytes as characters; what is no visible ASCII character is a question mark."""
    return F.regexp_replace(F.decode(F.substring(content, at + 1, 4), "ISO-8859-1"), "[^\\x21-\\x7e]", "?")


def _number(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def icc_header(content: Column) -> Column:
    """A colour profile's head as a struct; null where there are under 128 bytes."""
    version = _number(content, 8, 1)
    text = F.concat_ws(".", F.shiftright(version, 4), version.bitwiseAND(F.lit(15)))
    head = F.struct(
        _number(content, 0, 4).alias("size"), _tag(content, 4).alias("cmm_type"), text.alias("version"), _tag(content, 12).alias("device_class"),
        _tag(content, 16).alias("color_space"), _tag(content, 20).alias("pcs"), _tag(content, 36).alias("signature"),
    )
    return F.when(F.octet_length(content) >= 128, head)


#: Families of colour spaces that are a name alone, and those that begin an array.
DEVICES = ["DeviceGray", "DeviceRGB", "DeviceCMYK"]
FAMILIES = ["ICCBased", "CalGray", "CalRGB", "Lab", "Separation", "DeviceN", "Indexed", "Pattern"]


def colour_space(value: Column) -> Column:
    """The text of a colour space, ``/DeviceRGB`` or ``[/Indexed /DeviceRGB 255 7 0 R]``, as a struct; null where it is none.

    family; alternate: the space below it; colourants: names of a separation or of several inks; most: an
    indexed space's greatest index; profile: the object number of an ICC profile.
    """
    text = F.trim(F.regexp_replace(value, "\\s+", " "))
    part = lambda pattern, i=1: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    family = F.coalesce(part(f"^/({'|'.join(DEVICES)})$"), part(f"^\\[ ?/({'|'.join(FAMILIES)})\\b"))
    alternate = (
        F.when(family == "Indexed", part("^\\[ ?/Indexed ?\\[? ?/([A-Za-z]+)"))
        .when(family == "Separation", part("^\\[ ?/Separation ?/[^\\s/\\[\\]]+ ?\\[? ?/([A-Za-z]+)"))
        .when(family == "DeviceN", part("^\\[ ?/DeviceN ?\\[[^\\]]*\\] ?\\[? ?/([A-Za-z]+)"))
        .when(family == "Pattern", part("^\\[ ?/Pattern ?\\[? ?/([A-Za-z]+)"))
    )
    names = F.when(family == "Separation", F.array(part("^\\[ ?/Separation ?/([^\\s/\\[\\]]+)"))).when(family == "DeviceN", F.regexp_extract_all(F.regexp_extract(text, "^\\[ ?/DeviceN ?\\[([^\\]]*)\\]", 1), F.lit("/([^\\s/\\[\\]]+)"), F.lit(1)))
    most = F.when(family == "Indexed", part("^\\[ ?/Indexed ?(?:\\[[^\\]]*\\]|/[A-Za-z]+|[0-9]+ [0-9]+ R) ?([0-9]+)\\b").try_cast("long"))
    profile = F.when(family == "ICCBased", part("^\\[ ?/ICCBased ([0-9]+) [0-9]+ R").try_cast("long"))
    return F.when(family.isNotNull(), F.struct(family.alias("family"), alternate.alias("alternate"), names.alias("colourants"), most.alias("most"), profile.alias("profile")))


def colour_findings(spaces: DataFrame, intents: DataFrame) -> DataFrame:
    """(doc_id, id, space) of ``colour_space`` and (doc_id) of documents with an output intent to (doc_id, id, code).

    DEVICE_WITHOUT_INTENT: a space that depends on a device, or lies over one, in a document that names no
    output condition.  ICC_WITHOUT_PROFILE: an ICC-based space that names no profile.
    """
    known = intents.select("doc_id").distinct().withColumn("intent", F.lit(True))
    device = F.col("space.family").isin(DEVICES) | F.coalesce(F.col("space.alternate").isin(DEVICES), F.lit(False))
    code = F.when(device & F.col("intent").isNull(), "DEVICE_WITHOUT_INTENT").when((F.col("space.family") == "ICCBased") & F.col("space.profile").isNull(), "ICC_WITHOUT_PROFILE")
    return spaces.join(known, "doc_id", "left").select("doc_id", "id", code.alias("code")).where("code is not null")


#: Entries of a graphics state, the key of each and its type.
STATE = {
    "line_width": ("LW", "double"), "line_cap": ("LC", "long"), "line_join": ("LJ", "long"), "miter_limit": ("ML", "double"), "rendering_intent": ("RI", "string"), "overprint": ("OP", "boolean"),
    "overprint_fill": ("op", "boolean"), "overprint_mode": ("OPM", "long"), "flatness": ("FL", "double"), "smoothness": ("SM", "double"), "text_knockout": ("TK", "boolean"),
}


def graphics_state(props: Column) -> Column:
    """A graphics state's entries, typed; null where one is absent or of another type."""
    return F.struct(*[F.try_element_at(props, F.lit(k)).try_cast(kind).alias(name) for name, (k, kind) in STATE.items()])


#: Entries of an output intent.
INTENT = {"subtype": "S", "output_condition": "OutputCondition", "output_condition_identifier": "OutputConditionIdentifier", "registry_name": "RegistryName", "info": "Info"}


def output_intents(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, entries, has_profile) of nodes that are output intents; text in brackets is without them."""
    text = lambda k: F.regexp_replace(F.try_element_at("props", F.lit(k)), "^\\((.*)\\)$", "$1")
    own = nodes.where("node_type = 'OutputIntent'")
    return own.select("doc_id", "id", *[text(k).alias(n) for n, k in INTENT.items()], F.map_contains_key("props", "DestOutputProfile").alias("has_profile"))


# --- scripts and streams ---


def named_scripts(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, name, target) of a name tree and (doc_id, id, js, stream) of nodes to (doc_id, name, script, is_stream).

    A node's own ``js`` counts before its stream, a binary of UTF-8; nodes with neither, or whose
    stream is not UTF-8, are left out.  Of a name that occurs twice the later entry counts.
    """
    last = names.groupBy("doc_id", "name").agg(F.max_by("target", "ord").alias("id"))
    script = F.coalesce("js", F.try_validate_utf8(F.col("stream").cast("string")))
    return last.join(nodes, ["doc_id", "id"]).select("doc_id", "name", script.alias("script"), F.col("js").isNull().alias("is_stream")).where("script is not null")


def content_streams(pages: DataFrame, streams: DataFrame) -> DataFrame:
    """(doc_id, id, contents: text) of pages and (doc_id, num, content) of streams to (doc_id, id, ord, num, content): each page's streams in order, those that several pages share once for each."""
    refs = F.regexp_extract_all("contents", F.lit("([0-9]+) [0-9]+ R"), F.lit(1))
    each = pages.select("doc_id", "id", F.posexplode(refs).alias("ord", "num")).withColumn("num", F.col("num").try_cast("long"))
    return each.join(streams, ["doc_id", "num"]).select("doc_id", "id", "ord", "num", "content")


# --- metadata ---


def namespaces(packets: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(key, prefix, uri, properties) of the namespaces that a packet declares, with the names that it uses of each, in order and once."""
    declared = F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit("xmlns:[A-Za-z0-9_.-]+\\s*=\\s*\"[^\"]*\""), F.lit(0)), lambda d: F.struct(F.regexp_extract(d, "xmlns:([A-Za-z0-9_.-]+)", 1).alias("prefix"), F.regexp_extract(d, "\"([^\"]*)\"", 1).alias("uri"))))
    used = F.array_distinct(F.regexp_extract_all(xml, F.lit("[<\\s]((?!xmlns)[A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+)(?=[\\s=>/])"), F.lit(1)))
    each = packets.select(key, F.explode(declared).alias("n"), used.alias("used"))
    return each.select(key, "n.prefix", "n.uri", F.filter("used", lambda u: F.substring_index(u, ":", 1) == F.col("n.prefix")).alias("properties"))


# --- checks of content ---

#: Patterns of dangerous scripts.
DANGEROUS = ["eval\\s*\\(", "Function\\s*\\(", "document\\.", "window\\.", "XMLHttpRequest", "fetch\\s*\\(", "\\.innerHTML", "\\.outerHTML", "createElement"]


def script_danger(script: Column) -> Column:
    return script.rlike("|".join(DANGEROUS))


def content_rules(props: Column) -> list[Rule]:
    """Rules on one node's properties: its script, what makes a form dangerous and an annotation suspicious."""
    get, has = lambda k: F.try_element_at(props, F.lit(k)), lambda k: F.map_contains_key(props, k)
    return [
        Rule("MALICIOUS_SCRIPT", "Critical", script_danger(F.concat_ws("\n", get("JS"), get("JavaScript")))),
        Rule("SIGNATURE_FIELD", "Warning", get("FT") == "Sig"),
        Rule("FORM_ACTION", "Error", has("FT") & (has("A") | has("AA"))),
        Rule("WIDGET", "Warning", get("Subtype") == "Widget"),
        Rule("ANNOTATION_ACTION", "Error", has("Subtype") & (has("A") | has("AA"))),
        Rule("MULTIMEDIA_CONTENT", "Error", has("Movie") | has("Sound")),
    ]


def sanitised_streams(streams: DataFrame, most: int) -> DataFrame:
    """(doc_id, id, content) with contents cut at the greatest length, and ``clean``: whether nothing was cut."""
    return streams.withColumns({"clean": F.octet_length("content") <= most, "content": F.substring("content", 1, most)})


def check_statistics(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(n_checked, n_with_findings, n_findings, n_grave): one row about findings (doc_id, code, severity) of checked rows (doc_id)."""
    by = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("Critical", "Error")).alias("grave"))
    total = rows.select("doc_id").distinct().join(by, "doc_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return total.agg(F.count("*").alias("n_checked"), F.count("n").alias("n_with_findings"), zero("n").alias("n_findings"), zero("grave").alias("n_grave"))


#: Advice by the state of a document, from the numbers of its work.
ADVICE = [("SLOW", "Raise the number of partitions"), ("LARGE", "Read the document in parts"), ("DAMAGED", "Recover objects by a scan"), ("LOSSY", "Compare with an earlier revision")]


def health_advice(rows: DataFrame, key: str, slow: Column, large: Column, damaged: Column, lossy: Column) -> DataFrame:
    """(key, state, advice): a row for each state that holds; nulls count as not holding."""
    hits = [F.when(c, F.struct(F.lit(s).alias("state"), F.lit(a).alias("advice"))) for c, (s, a) in zip((slow, large, damaged, lossy), ADVICE)]
    return rows.select(key, F.explode(F.array_compact(F.array(*hits))).alias("a")).select(key, "a.*")
