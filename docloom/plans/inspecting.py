"""Text, security, validation, scalar functions and transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..graph import CHILD, CUSTOMER, Tables, org_graph
from ..operators import aggregates, rules, security, transforms, validation
from ..operators import selectors as s
from .registry import ORG, query

#: Fixed values of the queries' SQL: words as DuckDB splits them.
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({_WORDS})::BIGINT AS n_words, length(text)::BIGINT AS chars, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents")
def txt_word_stats(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", F.size(tx.words(text)).cast("long").alias("n_words"), F.length(text).cast("long").alias("chars"), F.size(tx.lines(text)).cast("long").alias("n_lines"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), i AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l)
    SELECT doc_id, line_no, line FROM i WHERE contains(lower(line), 'license')"""
)
def txt_search(t: Tables) -> DataFrame:
    return tx.search(t.documents, "doc_id", "text", "License").withColumn("line_no", F.col("line_no").cast("long"))


@query(f"SELECT doc_id, array_to_string(list_transform(list_slice(list_filter({_WORDS}, lambda w: strlen(w) >= 3), 1, 100), lambda w: lower(w)), ' ') AS terms FROM documents")
def txt_index_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(tx.index_terms(F.col("text")), " ").alias("terms"))


@query(
    """WITH b AS (SELECT 'documents' AS src, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'urls', url FROM pages)
    SELECT src, CASE WHEN starts_with(ltrim(text), '<') THEN 'markup' WHEN starts_with(ltrim(text), '{') OR starts_with(ltrim(text), '[') THEN 'data' WHEN contains(text, 'http://') OR contains(text, 'https://') THEN 'links' WHEN contains(text, 'function') OR contains(text, 'eval') THEN 'script' ELSE 'text' END AS kind, count(*) AS n FROM b GROUP BY 1, 2"""
)
def txt_content_type(t: Tables) -> DataFrame:
    parts = [t.documents.select(F.lit("documents").alias("src"), "text"), t.pages.select(F.lit("pages").alias("src"), F.col("html").alias("text")), t.conversations.select(F.lit("conversations").alias("src"), "text"), t.pages.select(F.lit("urls").alias("src"), F.col("url").alias("text"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.groupBy("src", tx.content_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """WITH k AS (SELECT unnest(regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*')) AS tag FROM pages) SELECT lower(tag) AS tag, count(*) AS n FROM k GROUP BY 1"""
)
def txt_tokens(t: Tables) -> DataFrame:
    tag = F.explode(tx.tokens(F.col("html"), "</?[a-zA-Z][a-zA-Z0-9]*")).alias("tag")
    return t.pages.select(tag).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS text, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def txt_join_pages(t: Tables) -> DataFrame:
    """A conversation's turns in order, as one text with blank lines between."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda p: p["text"]), "\n\n").alias("text"), F.sum(F.length("text")).cast("long").alias("chars"))


_URL_FINDINGS = """WITH u AS (SELECT page_id, url, lower(url) AS low FROM pages),
f AS (SELECT page_id, 'SUSPICIOUS_URL' AS code, 'Medium' AS severity FROM u WHERE regexp_matches(low, 'https?://[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}') OR regexp_matches(low, '[.]tk|[.]ml|[.]ga|[.]cf|[.]cc|[.]info|[.]biz|bit[.]ly|tinyurl|t[.]co|goo[.]gl|ow[.]ly|is[.]gd|/download|/exe|/install|/setup|/update')
UNION ALL SELECT page_id, 'DATA_EXFILTRATION', 'High' FROM u WHERE regexp_matches(low, '[?&](data|info|user)=') OR (contains(low, '=') AND strlen(url) > 100 AND strlen(split_part(url, '?', 2)) > 50 AND regexp_matches(split_part(url, '?', 2), '^[A-Za-z0-9=&]*$'))
UNION ALL SELECT page_id, 'RISKY_LINK', 'Low' FROM u WHERE regexp_matches(low, '^(ftp://|file://|javascript:|data:)') OR regexp_matches(low, 'bit[.]ly|tinyurl[.]com|t[.]co|goo[.]gl|ow[.]ly|is[.]gd|[.][.]|localhost|127[.]0[.]0[.]1|192[.]168[.]|10[.]') OR len(string_split(low, '.')) > 7
UNION ALL SELECT page_id, 'SUSPICIOUS_TEXT', 'Low' FROM u WHERE regexp_matches(low, '/openaction|/aa|/launch|/uri|/xfa|cmd[.]exe|powershell|javascript:|file://|http://|https://')
UNION ALL SELECT page_id, 'SUSPICIOUS_WORDS', 'Medium' FROM pages WHERE regexp_matches(lower(html), 'eval[(]|document[.]write|unescape[(]|activexobject|wscript[.]shell|new array[(]|fromcharcode|shellcode|exploit|payload|app[.]launchurl|this[.]print|app[.]execdialog'))
"""


def _page_findings(t: Tables) -> DataFrame:
    url = F.col("url")
    every = security.url_rules(url) + security.text_rules(url)[1:] + security.script_rules(F.col("html"))[3:]
    return rules.findings(t.pages, every, "page_id")


@query(_URL_FINDINGS + "SELECT page_id, code, severity FROM f")
def sec_url_rules(t: Tables) -> DataFrame:
    return _page_findings(t)


@query(
    """WITH s AS (SELECT page_id, regexp_extract(html, '<script>([^<]*)', 1) AS script FROM pages)
    SELECT page_id, 'HAS_VAR' AS code FROM s WHERE contains(script, 'var ') UNION ALL SELECT page_id, 'HAS_TRACK' FROM s WHERE contains(script, 'track(')
    UNION ALL SELECT page_id, 'DENSE' FROM s WHERE strlen(script) > 0 AND length(regexp_replace(script, '[\\p{L}\\p{N}\\s]', '', 'g')) / strlen(script) > 0.4"""
)
def sec_js_rules(t: Tables) -> DataFrame:
    script = F.regexp_extract("html", "<script>([^<]*)", 1)
    pages = t.pages.select("page_id", script.alias("script"))
    c = F.col("script")
    dense = (F.octet_length(c) > 0) & (F.length(F.regexp_replace(c, "[\\p{L}\\p{N}\\s]", "")) / F.octet_length(c) > 0.4)
    own = [rules.Rule("HAS_VAR", "Low", c.contains("var ")), rules.Rule("HAS_TRACK", "Low", c.contains("track(")), rules.Rule("DENSE", "Medium", dense), *security.script_rules(c)]
    return rules.findings(pages, own, "page_id").select("page_id", "code")


@query(_URL_FINDINGS + ", c AS (SELECT code, severity, count(*) AS n FROM f GROUP BY 1, 2) SELECT k.code, k.severity, coalesce(c.n, 0) AS n FROM (VALUES ('SUSPICIOUS_URL', 'Medium'), ('DATA_EXFILTRATION', 'High'), ('RISKY_LINK', 'Low')) k(code, severity) LEFT JOIN c USING (code)")
def sec_ioc(t: Tables) -> DataFrame:
    """How many pages each link indicator meets; those that none meets have 0."""
    return rules.counts(t.pages, security.url_rules(F.col("url")))


@query(_URL_FINDINGS + ", g AS (SELECT page_id, count(*) FILTER (severity IN ('Critical', 'High')) AS grave, bool_or(code = 'SUSPICIOUS_WORDS') AS script, bool_or(code IN ('SUSPICIOUS_URL', 'DATA_EXFILTRATION', 'RISKY_LINK')) AS network FROM (SELECT * FROM f UNION ALL SELECT page_id, 'SUSPICIOUS_WORDS', 'Medium' FROM pages WHERE contains(html, 'track(')) GROUP BY 1) SELECT page_id, 'SCRIPT_AND_NETWORK' AS code, 'High' AS severity FROM g WHERE script AND network UNION ALL SELECT page_id, 'MULTIPLE_GRAVE', 'Critical' FROM g WHERE grave > 2")
def sec_correlation(t: Tables) -> DataFrame:
    """What a page's findings say together; a script that tracks counts as suspicious here."""
    tracks = rules.findings(t.pages, [rules.Rule("SUSPICIOUS_WORDS", "Medium", F.col("html").contains("track("))], "page_id")
    return security.correlated(_page_findings(t).unionByName(tracks), "page_id")


@query(_URL_FINDINGS + ", r AS (SELECT page_id, least(sum(CASE severity WHEN 'Critical' THEN 100 WHEN 'High' THEN 50 WHEN 'Medium' THEN 20 ELSE 5 END), 1000)::BIGINT AS score, bool_or(severity IN ('Critical', 'High')) AS grave FROM f GROUP BY 1) SELECT page_id, score, CASE WHEN score <= 20 THEN 'LOW' WHEN score <= 100 THEN 'MEDIUM' WHEN score <= 200 THEN 'HIGH' ELSE 'CRITICAL' END AS level, score <= 20 AND NOT grave AS safe FROM r")
def sec_risk_score(t: Tables) -> DataFrame:
    return aggregates.risk(_page_findings(t), "page_id")


@query(
    "SELECT k.name, (SELECT count(*) FROM documents WHERE contains(text, k.magic)) + (SELECT count(*) FROM pages WHERE contains(html, k.magic)) AS n FROM (VALUES ('ELF', chr(127) || 'ELF'), ('MZ', 'MZ'), ('MP4', 'ftyp'), ('GIF89a', 'GIF89a')) k(name, magic)"
)
def sec_polyglot(t: Tables) -> DataFrame:
    """How many texts hold the magic bytes of other file formats."""
    both = t.documents.select("text").unionAll(t.pages.select("html"))
    own = [rules.Rule(n, "Low", F.contains(F.col("text").cast("binary"), F.unhex(F.lit(security.MAGIC[n])))) for n in ("ELF", "MZ", "MP4", "GIF89a")]
    return rules.counts(both, own).select(F.col("code").alias("name"), "n")


@query("SELECT source, count(*) FILTER (contains(lower(text), 'license')) AS n_license, count(*) FILTER (contains(lower(text), 'rights reserved') OR contains(lower(text), 'copyright')) AS n_rights FROM documents GROUP BY 1")
def sec_quirks(t: Tables) -> DataFrame:
    low = F.lower("text")
    own = [("n_license", ["license"]), ("n_rights", ["rights reserved", "copyright"])]
    return t.documents.groupBy("source").agg(*[F.count_if(security.contains_any(low, words)).alias(n) for n, words in own])


@query(
    """WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', '[SANITIZED]', 'g'), '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '[SANITIZED]', 'g') AS s FROM documents)
    SELECT doc_id, CASE WHEN length(s) > 500 THEN left(s, 500) || '[TRUNCATED]' ELSE s END AS text FROM a"""
)
def sec_sanitize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", security.sanitized(F.col("text"), ["[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "[A-Za-z0-9._]+@[A-Za-z0-9.]+"], 500).alias("text"))


@query("SELECT doc_id, 'TOO_LONG' AS code FROM documents WHERE strlen(text) > 10000 UNION ALL SELECT doc_id, 'MANY_LINES' FROM documents WHERE len(string_split(text, chr(10))) > 50")
def sec_limits(t: Tables) -> DataFrame:
    own = [rules.Rule("TOO_LONG", "Error", F.octet_length("text") > 10_000), rules.Rule("MANY_LINES", "Warning", F.size(F.split("text", "\n")) > 50)]
    return rules.findings(t.documents, own, "doc_id").select("doc_id", "code")


@query(
    """SELECT n_regionkey::BIGINT AS doc_id, 0::BIGINT AS n_critical, 0::BIGINT AS n_error, 0::BIGINT AS n_warning, true AS valid, 'Compliant' AS status FROM nation GROUP BY 1"""
)
def val_profile_report(t: Tables) -> DataFrame:
    return validation.validate(org_graph(t)).select("doc_id", "n_critical", "n_error", "n_warning", "valid", "status")


@query("WITH l AS (SELECT l_orderkey, count(*) AS counted, max(l_linenumber)::BIGINT AS stated FROM lineitem GROUP BY 1) SELECT l_orderkey, stated, counted FROM l WHERE stated <> counted")
def val_count_consistency(t: Tables) -> DataFrame:
    """Orders whose greatest line number is not the number of their lines."""
    by = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("stated"), F.count("*").alias("counted"))
    return validation.count_mismatch(by.select("l_orderkey", "stated"), by.select("l_orderkey", "counted"), "l_orderkey")


@query(ORG + "SELECT doc_id, id, node_type, 'segment' AS property FROM n WHERE node_type IN ('nation', 'customer') AND (node_type = 'nation' OR coalesce(tag, '') = '') UNION ALL SELECT doc_id, id, node_type, 'name' FROM n WHERE node_type IN ('nation', 'customer') AND coalesce(name, '') = ''")
def val_required_keys(t: Tables) -> DataFrame:
    return validation.missing_properties(org_graph(t).nodes, {"nation": ["name", "segment"], "customer": ["name", "segment"]})


@query("SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'NonCompliant' WHEN c_acctbal < 0 THEN 'PartiallyCompliant' ELSE 'Compliant' END AS status FROM customer")
def val_compliance_status(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal")
    return t.customer.select("c_custkey", rules.compliance(balance >= -500, (balance < 0).cast("int")).alias("status"))


@query("SELECT n_nationkey, n_nationkey & 4 <> 0 AS can_print, n_nationkey & 8 <> 0 AS can_modify, n_nationkey & 16 <> 0 AS can_copy FROM nation")
def val_permissions(t: Tables) -> DataFrame:
    own = t.nation.select("n_nationkey", validation.permissions(F.col("n_nationkey")).alias("p"))
    return own.select("n_nationkey", F.col("p.print").alias("can_print"), F.col("p.modify").alias("can_modify"), F.col("p.copy").alias("can_copy"))


@query(
    """WITH h AS (SELECT doc_id, round(1.0 - CASE WHEN NOT contains(text, chr(10)) THEN 0.2 ELSE 0 END - CASE WHEN length(text) < 100 THEN 0.3 ELSE 0 END - 0.1 * (CASE WHEN length(text) <> n_chars THEN 1 ELSE 0 END), 6) AS score FROM documents)
    SELECT doc_id, score::DOUBLE AS score, CASE WHEN score >= 0.9 THEN 'Healthy' WHEN score >= 0.7 THEN 'PartiallyRecovered' WHEN score >= 0.4 THEN 'Damaged' ELSE 'SeverelyDamaged' END AS band FROM h"""
)
def health_score(t: Tables) -> DataFrame:
    text = F.col("text")
    missing = {"lines": (~text.contains("\n"), 0.2), "length": (F.length(text) < 100, 0.3)}
    score, band = aggregates.health(F.lit(1.0), missing, F.lit(0), (F.length(text) != F.col("n_chars")).cast("int"))
    return t.documents.select("doc_id", score.alias("score"), band.alias("band"))


@query(
    "WITH e AS (SELECT source, count(*) FILTER (length(text) < 60) AS errors, count(*) FILTER (NOT contains(text, chr(10))) AS warnings FROM documents GROUP BY 1) SELECT source, round(greatest(0.0, 1 - (0.5 * errors + 0.2 * warnings) / 10), 6)::DOUBLE AS score, CASE WHEN errors = 0 AND warnings = 0 THEN 'AAA' WHEN errors = 0 AND warnings <= 5 THEN 'AA' WHEN errors <= 2 THEN 'A' ELSE 'NonCompliant' END AS level FROM e"
)
def val_accessibility(t: Tables) -> DataFrame:
    e = t.documents.groupBy("source").agg(F.count_if(F.length("text") < 60).alias("errors"), F.count_if(~F.col("text").contains("\n")).alias("warnings"))
    score, level = aggregates.accessibility(F.col("errors"), F.col("warnings"))
    return e.select("source", F.round(score, 6).alias("score"), level.alias("level"))


@query("SELECT l_orderkey, l_linenumber, round(sum(greatest(0.0, least(1.0, 0.1 + pow(l_discount, 2.0) * 0.8))), 6) AS v FROM lineitem GROUP BY 1, 2")
def sc_type2_function(t: Tables) -> DataFrame:
    v = vl.exponential(F.col("l_discount"), 0.1, 0.9, 2.0, 0.0, 1.0)
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(v), 6).alias("v"))


@query("SELECT l_quantity, round(CASE WHEN l_quantity < 10 THEN l_quantity * (1.0 / 10) WHEN l_quantity < 30 THEN 1 + (l_quantity - 10) * (3.0 / 20) ELSE 4 + (l_quantity - 30) * (-4.0 / 20) END, 6) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2")
def sc_type3_function(t: Tables) -> DataFrame:
    v = vl.stitched(F.col("l_quantity"), [10.0, 30.0], [(0.0, 1.0), (1.0, 4.0), (4.0, 0.0)], (0.0, 50.0))
    return t.lineitem.groupBy("l_quantity", F.round(v, 6).alias("v")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def sc_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, hex(text) AS hexed, to_base64(encode(text)) AS b64, text AS back FROM documents")
def sc_decode(t: Tables) -> DataFrame:
    """Texts to hex and base 64 and back again."""
    coded = t.documents.select("doc_id", F.hex(F.col("text").cast("binary")).alias("hexed"), F.base64(F.col("text").cast("binary")).alias("b64"))
    return coded.select("doc_id", "hexed", F.regexp_replace("b64", "[\\r\\n]", "").alias("b64"), vl.ascii_hex(F.concat("hexed", F.lit(">"))).cast("string").alias("back"))


@query("SELECT o_orderkey, o_orderdate AS stamped, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders")
def sc_dates(t: Tables) -> DataFrame:
    text = F.date_format("o_orderdate", "'D:'yyyyMMddHHmmss'Z'")
    own = t.orders.select("o_orderkey", vl.stamped(text).cast("timestamp_ntz").alias("stamped"))
    return own.select("o_orderkey", "stamped", F.year("stamped").cast("long").alias("y"), F.month("stamped").cast("long").alias("m"))


@query("SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def sc_map_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(vl.map_of_json(F.col("props"))).alias("key", "value"))


@query("SELECT user_id, count(*) AS n FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 50 GROUP BY 1")
def sc_map_filter(t: Tables) -> DataFrame:
    large = F.map_filter(vl.map_of_json(F.col("props")), lambda k, v: (k == "k") & (v.try_cast("bigint") > 50))
    return t.events.where(F.size(large) > 0).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name, regexp_replace('/' || p_brand, '^/', '') AS brand, try_cast(p_size AS BIGINT) AS size FROM part")
def sc_literals(t: Tables) -> DataFrame:
    """Names, numbers and escapes read back from their written forms."""
    slash = F.concat(F.lit("/"), F.col("p_brand"))
    written = F.replace(F.replace("p_name", F.lit("#"), F.lit("#23")), F.lit(" "), F.lit("#20"))
    return t.part.select("p_partkey", tx.unescaped_name(written).alias("p_name"), tx.without_slash(slash).alias("brand"), tx.integer(F.col("p_size").cast("string")).alias("size"))


@query(ORG + "SELECT e.doc_id, e.dst AS id, e.src FROM e LEFT JOIN n p ON p.id = e.src AND p.doc_id = e.doc_id WHERE e.src <> 103 AND e.dst <> 103 AND p.parent IS DISTINCT FROM 103")
def tf_remove(t: Tables) -> DataFrame:
    """What is left without nation 3, its customers and their orders."""
    g = org_graph(t)
    left = transforms.remove_subtree(g, s.select(g, s.has_id(103)), depth=2)
    return left.edges.select("doc_id", F.col("dst").alias("id"), "src")


@query(ORG + "SELECT n.doc_id, n.id, CASE WHEN n.id = 1000005 THEN 101 ELSE n.parent END AS src FROM n WHERE parent IS NOT NULL")
def tf_move(t: Tables) -> DataFrame:
    moved = transforms.move_subtree(org_graph(t), CUSTOMER + 5, 101)
    return moved.edges.select("doc_id", F.col("dst").alias("id"), "src")


@query(ORG + "SELECT doc_id, node_type, count(*) AS n FROM (SELECT doc_id, node_type FROM n UNION ALL SELECT doc_id, node_type FROM n WHERE id = 102 OR parent = 102 OR parent IN (SELECT id FROM n WHERE parent = 102)) GROUP BY 1, 2")
def tf_subtree_clone(t: Tables) -> DataFrame:
    """Nation 2 with its customers and their orders, twice."""
    g = org_graph(t)
    more = transforms.clone_subtree(g, s.select(g, s.has_id(102)), 1, 5_000_000_000, depth=2)
    return more.nodes.groupBy("doc_id", "node_type").agg(F.count("*").alias("n"))


@query(ORG + "SELECT doc_id, dst AS id, CASE WHEN src = 104 THEN 110 ELSE src END AS src FROM e WHERE dst <> 104")
def tf_merge(t: Tables) -> DataFrame:
    """The children of nation 4 go to nation 10."""
    merged = transforms.merge_nodes(org_graph(t), 110, 104)
    return merged.edges.where(F.col("edge_type") == CHILD).select("doc_id", F.col("dst").alias("id"), "src")


@query(ORG + "SELECT doc_id, id, node_type, CASE WHEN value < 0 THEN 0.0 ELSE value END AS value FROM n WHERE node_type IN ('customer', 'order')")
def tf_update(t: Tables) -> DataFrame:
    g = org_graph(t)
    patch = g.nodes.where("value < 0").select("doc_id", "id", F.lit(None).cast("string").alias("node_type"), F.lit(0.0).alias("value"))
    return transforms.replace_values(g, patch).of_type("customer", "order").select("doc_id", "id", "node_type", "value")


@query(ORG + "SELECT e.doc_id, e.src, e.dst FROM e JOIN n ON n.doc_id = e.doc_id AND n.id = e.dst LEFT JOIN n p ON p.doc_id = e.doc_id AND p.id = e.src WHERE n.node_type = 'customer' AND n.value < 0 OR n.node_type = 'order' AND p.value < 0")
def tf_misplaced(t: Tables) -> DataFrame:
    """With customers in debt of a type of their own, their edges and those to their orders are of no allowed kind."""
    g = org_graph(t)
    patch = g.nodes.where("value < 0").select("doc_id", "id", F.lit("debtor").alias("node_type"), F.lit(None).cast("double").alias("value"))
    return transforms.misplaced(transforms.replace_values(g, patch)).select("doc_id", "src", "dst")


@query("SELECT doc_id, text AS back FROM documents")
def udf_codec(t: Tables) -> DataFrame:
    """Texts through deflate and back."""
    return t.documents.select("doc_id", vl.inflate(vl.deflate(F.col("text").cast("binary"))).cast("string").alias("back"))
