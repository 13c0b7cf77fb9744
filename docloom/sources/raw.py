"""Raw document files as a graph, by Spark's own expressions.

A file's objects are found by their declarations, references by their form, types by their
``/Type`` entry.  Streams stay binary; nothing is parsed row by row in Python.  The scan is
tolerant: it needs no cross-reference table, so damaged files give what objects they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import REFERENCE, Graph


def read(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, content) of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def latin(content: Column) -> Column:
    """One character for each byte."""
    return F.decode(content, "ISO-8859-1")


def overview(files: DataFrame) -> DataFrame:
    """(path, length, major, minor, n_objects, n_eof, n_revisions, encrypted, trailing): what head, tail and marks tell."""
    text = files.withColumn("text", latin(F.col("content")))
    version = lambda i: F.regexp_extract("text", "%PDF-([0-9])\\.([0-9])", i).try_cast("int")
    tail = F.regexp_replace(F.substring_index("text", "%%EOF", -1), "^[\\s\\x00]+", "")
    return text.select(
        "path", "length", version(1).alias("major"), version(2).alias("minor"),
        F.regexp_count("text", F.lit("[0-9]+\\s+[0-9]+\\s+obj\\b")).alias("n_objects"),
        F.regexp_count("text", F.lit("%%EOF")).alias("n_eof"),
        F.regexp_count("text", F.lit("startxref")).alias("n_revisions"),
        F.col("text").contains("/Encrypt").alias("encrypted"),
        F.when(F.col("text").contains("%%EOF"), F.length(tail)).otherwise(0).alias("trailing"),
    )


def objects(files: DataFrame) -> DataFrame:
    """(doc_id, ord, num, gen, body) of each declared object, in file order; a later one of the same number replaces an earlier."""
    parts = files.select(F.col("path").alias("doc_id"), F.posexplode(F.split(latin(F.col("content")), "\\bendobj\\b")).alias("ord", "part"))
    head = "(?s)^.*?([0-9]+)\\s+([0-9]+)\\s+obj\\b(.*)$"
    own = parts.where(F.col("part").rlike(head)).select("doc_id", "ord", *[F.regexp_extract("part", head, i).alias(n) for i, n in ((1, "num"), (2, "gen"), (3, "body"))])
    return own.withColumns({"num": F.col("num").try_cast("long"), "gen": F.col("gen").try_cast("int")}).where("num is not null and gen is not null")


def graph(files: DataFrame) -> Graph:
    """Objects as nodes, references as edges."""
    own = objects(files)
    last = own.groupBy("doc_id", "num", "gen").agg(F.max("ord").alias("ord"))
    own = own.join(last, ["doc_id", "num", "gen", "ord"])
    dictionary = F.regexp_replace(F.substring_index("body", "stream", 1), "\\s+", " ")
    own = own.withColumn("dictionary", dictionary).withColumn("id", F.col("num") * 65536 + F.col("gen"))
    kind = F.regexp_extract("dictionary", "/Type ?/([A-Za-z0-9]+)", 1)
    keys = F.regexp_extract_all("dictionary", F.lit("/([A-Za-z0-9]+) ?(/[A-Za-z0-9._+-]+|[0-9.+-]+(?! [0-9]+ R)\\b|\\([^)]*\\)|\\[[^\\]R]*\\]|<<|true|false)"), F.lit(1))
    values = F.regexp_extract_all("dictionary", F.lit("/([A-Za-z0-9]+) ?(/[A-Za-z0-9._+-]+|[0-9.+-]+(?! [0-9]+ R)\\b|\\([^)]*\\)|\\[[^\\]R]*\\]|<<|true|false)"), F.lit(2))
    pairs = F.array_distinct(F.arrays_zip(keys.alias("k"), values.alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    props = F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], F.regexp_replace(p["v"], "^/", ""))))
    nodes = own.select("doc_id", "id", F.when(kind != "", kind).otherwise("Object").alias("node_type"), props.alias("props"), F.lit(None).cast("double").alias("value"), F.array().cast("array<string>").alias("errors"))
    refs = F.regexp_extract_all("dictionary", F.lit("([0-9]+) ([0-9]+) R\\b"), F.lit(0))
    edges = own.select("doc_id", F.col("id").alias("src"), F.posexplode(refs).alias("ord", "r"))
    number = lambda i: F.get(F.split("r", " "), i).try_cast("long")
    return Graph(nodes, edges.select("doc_id", "src", (number(0) * 65536 + number(1)).alias("dst"), F.lit(REFERENCE).alias("edge_type"), F.col("ord")).where("dst is not null"))


def xref_entries(files: DataFrame) -> DataFrame:
    """(doc_id, section, num, gen, kind, offset) of the rows of classic cross-reference tables, sections in file order."""
    row = "[0-9]{10} [0-9]{5} [nf]"
    part = f"(?:[0-9]+ [0-9]+\\s+(?:{row}\\s*)*)"
    text = files.select(F.col("path").alias("doc_id"), latin(F.col("content")).alias("text"))
    sections = text.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"\\bxref\\s+({part}+)"), F.lit(1))).alias("section", "body"))
    runs = sections.select("doc_id", "section", F.explode(F.regexp_extract_all("body", F.lit(part), F.lit(0))).alias("run"))
    first = F.regexp_extract("run", "^([0-9]+)", 1).try_cast("long")
    rows = runs.select("doc_id", "section", first.alias("first"), F.posexplode(F.regexp_extract_all("run", F.lit(row), F.lit(0))).alias("i", "row"))
    return rows.select(
        "doc_id", "section", (F.col("first") + F.col("i")).alias("num"), F.substring("row", 12, 5).try_cast("int").alias("gen"),
        F.when(F.substring("row", 18, 1) == "n", "InUse").otherwise("Free").alias("kind"), F.substring("row", 1, 10).try_cast("long").alias("offset"),
    )


def merged_xref(entries: DataFrame) -> DataFrame:
    """The entry of each object in the latest section that names it."""
    last = entries.groupBy("doc_id", "num").agg(F.max_by(F.struct("gen", "kind", "offset"), "section").alias("e"))
    return last.select("doc_id", "num", "e.*")


def sections(files: DataFrame) -> DataFrame:
    """(doc_id, offset, body, prev, start) of each classic cross-reference section: where it stands in the file, what follows its keyword, its trailer's /Prev, and where the file says that the newest stands."""
    text = files.select(F.col("path").alias("doc_id"), latin(F.col("content")).alias("text"))
    start = F.regexp_extract("text", "(?s).*\\bstartxref\\s+([0-9]+)", 1).try_cast("long")
    parts = F.split("text", "\\bxref\\b")
    places = F.aggregate(parts, F.array(F.lit(-4).cast("long")), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + 4 + F.length(p))))
    each = text.select("doc_id", start.alias("start"), parts.alias("parts"), places.alias("places")).select("doc_id", "start", "places", F.posexplode("parts").alias("i", "body")).where("i > 0")
    prev = F.regexp_extract("body", "(?s)^.*?\\btrailer\\s*<<.*?/Prev\\s+([0-9]+).*?>>", 1).try_cast("long")
    return each.select("doc_id", F.get("places", F.col("i")).alias("offset"), "body", prev.alias("prev"), "start")


def xref_chain(files: DataFrame) -> DataFrame:
    """(doc_id, revision, offset, anomaly): sections along /Prev, the newest 0, whatever their order in the file.

    A last row of no revision tells why a chain ended early: ``xref_prev_cycle`` where /Prev leads back,
    ``xref_parse_failed`` where it leads to no section.  A file's sections are one row's array.
    """
    by = sections(files).groupBy("doc_id").agg(F.max("start").alias("start"), F.map_from_entries(F.collect_list(F.struct("offset", F.struct("prev")))).alias("known"))
    none = F.array().cast("array<long>")
    ended = lambda s: s["at"].isNull() | (s["at"] <= 0) | F.array_contains(s["way"], s["at"]) | ~F.map_contains_key("known", s["at"])
    step = lambda s, _: F.when(ended(s), s).otherwise(F.struct(F.try_element_at("known", s["at"])["prev"].alias("at"), F.concat(s["way"], F.array(s["at"])).alias("way")))
    walked = F.aggregate(F.sequence(F.lit(0), F.size("known")), F.struct(F.col("start").alias("at"), none.alias("way")), step)
    own = by.withColumn("w", walked).select("doc_id", F.col("w.at").alias("at"), F.col("w.way").alias("way"))
    anomaly = F.when(F.array_contains("way", F.col("at")), "xref_prev_cycle").when(F.col("at") > 0, "xref_parse_failed")
    rows = own.select("doc_id", F.posexplode("way").alias("revision", "offset")).withColumn("anomaly", F.lit(None).cast("string"))
    return rows.unionByName(own.select("doc_id", F.lit(None).cast("int").alias("revision"), F.col("at").alias("offset"), anomaly.alias("anomaly")).where("anomaly is not null"))


def chained_xref(files: DataFrame) -> DataFrame:
    """(doc_id, num, gen, kind, offset, revision): each object's entry in the newest section of the chain that names it."""
    row = "[0-9]{10} [0-9]{5} [nf]"
    chain = xref_chain(files).where("revision is not null").select("doc_id", F.col("offset").alias("section"), "revision")
    own = sections(files).select("doc_id", F.col("offset").alias("section"), "body").join(chain, ["doc_id", "section"])
    runs = own.select("doc_id", "revision", F.explode(F.regexp_extract_all(F.regexp_extract("body", f"^\\s+((?:[0-9]+ [0-9]+\\s+(?:{row}\\s*)*)+)", 1), F.lit(f"[0-9]+ [0-9]+\\s+(?:{row}\\s*)*"), F.lit(0))).alias("run"))
    first = F.regexp_extract("run", "^([0-9]+)", 1).try_cast("long")
    rows = runs.select("doc_id", "revision", first.alias("first"), F.posexplode(F.regexp_extract_all("run", F.lit(row), F.lit(0))).alias("i", "row"))
    entry = F.struct(F.substring("row", 12, 5).try_cast("int").alias("gen"), F.when(F.substring("row", 18, 1) == "n", "InUse").otherwise("Free").alias("kind"), F.substring("row", 1, 10).try_cast("long").alias("offset"))
    newest = rows.groupBy("doc_id", (F.col("first") + F.col("i")).alias("num")).agg(F.min_by(F.struct(entry.alias("e"), "revision"), "revision").alias("x"))
    return newest.select("doc_id", "num", "x.e.*", "x.revision")


def trailers(files: DataFrame) -> DataFrame:
    """(doc_id, section, root, size, prev, n_ids, encrypted) of each trailer, in file order."""
    text = files.select(F.col("path").alias("doc_id"), latin(F.col("content")).alias("text"))
    each = text.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)\\btrailer\\s*<<(.*?)>>\\s*startxref"), F.lit(1))).alias("section", "t"))
    number = lambda key, more="": F.regexp_extract("t", f"/{key}\\s+([0-9]+){more}", 1).try_cast("long")
    ids = F.regexp_extract("t", "/ID\\s*\\[([^\\]]*)\\]", 1)
    return each.select("doc_id", "section", number("Root", "\\s+[0-9]+\\s+R").alias("root"), number("Size").alias("size"), number("Prev").alias("prev"), F.regexp_count(ids, F.lit("<[0-9A-Fa-f]*>|\\([^)]*\\)")).alias("n_ids"), F.col("t").contains("/Encrypt").alias("encrypted"))


def revisions(entries: DataFrame) -> DataFrame:
    """(doc_id, section, num, change) of each section against all before it: added, modified or deleted."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "num").orderBy("section")
    before = F.lag(F.struct("kind", "offset", "gen")).over(w)
    own = entries.withColumn("before", before)
    change = F.when(F.col("kind") == "Free", F.when(F.col("before.kind") == "InUse", "deleted")).when(F.col("before").isNull() | (F.col("before.kind") == "Free"), "added").when((F.col("before.offset") != F.col("offset")) | (F.col("before.gen") != F.col("gen")), "modified")
    return own.withColumn("change", change).where("change is not null").select("doc_id", "section", "num", "change")


def offset_findings(files: DataFrame) -> DataFrame:
    """(doc_id, code) of files whose table points past their end, has fewer entries than the trailer says, or is not there."""
    entries = merged_xref(xref_entries(files))
    size = files.select(F.col("path").alias("doc_id"), "length")
    stated = trailers(files).groupBy("doc_id").agg(F.max_by("size", "section").alias("stated"))
    by = entries.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "InUse", F.col("offset"))).alias("furthest"), F.count("*").alias("n"))
    rows = size.join(by, "doc_id", "left").join(stated, "doc_id", "left")
    hits = F.array(F.when(F.col("n").isNull(), F.lit("XREF_ENTRIES_MISSING")), F.when(F.col("furthest") >= F.col("length"), F.lit("XREF_PAST_END")), F.when(F.col("n") < F.col("stated"), F.lit("TRAILER_SIZE")))
    return rows.select("doc_id", F.explode(F.array_compact(hits)).alias("code"))


def last_trailers(files: DataFrame) -> DataFrame:
    """The trailer of each file's latest section."""
    own = trailers(files)
    last = own.groupBy("doc_id").agg(F.max("section").alias("section"))
    return own.join(last, ["doc_id", "section"])


def stream_entries(streams: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, index, content) of cross-reference streams to (doc_id, num, kind, field2, field3): rows of fixed widths, high byte first.

    ``index`` holds pairs of a first number and a count; a pair's rows follow those of the pairs
    before it.  A field of width 0 has its default: kind 1, others 0.  Rows that the content is too
    short for are left out.  With a column ``first`` in place of ``index`` all rows are numbered from there.
    """
    row = sum(widths)
    n_rows = F.floor(F.octet_length("content") / row)
    if "index" not in streams.columns:
        streams = streams.withColumn("index", F.array(F.struct(F.col("first").cast("long").alias("first"), n_rows.cast("long").alias("count"))))
    pair = lambda first, before, count: F.struct(first.cast("long").alias("first"), before.cast("long").alias("before"), count.cast("long").alias("count"))
    zero = F.array(pair(F.lit(0), F.lit(0), F.lit(0)))
    placed = F.aggregate("index", zero, lambda a, p: F.concat(a, F.array(pair(p["first"], F.element_at(a, -1)["before"] + F.element_at(a, -1)["count"], p["count"]))))
    each = streams.select("doc_id", "content", F.explode(placed).alias("p")).where((F.col("p.count") > 0) & (F.col("p.before") < n_rows))
    count = F.least(F.col("p.count"), n_rows - F.col("p.before"))
    each = each.select("doc_id", "content", "p", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("j")).withColumn("i", (F.col("p.before") + F.col("j")).cast("int"))

    def field(k: int) -> Column:
        if not widths[k]:
            return F.lit(1 if k == 0 else 0).cast("long")
        at = F.col("i") * row + sum(widths[:k]) + 1
        return F.conv(F.hex(F.substring("content", at, F.lit(widths[k]))), 16, 10).cast("long")

    kind = F.create_map(*[x for k, v in ((0, "Free"), (1, "InUse"), (2, "Compressed")) for x in (F.lit(k).cast("long"), F.lit(v))])
    return each.select("doc_id", (F.col("p.first") + F.col("j")).alias("num"), F.try_element_at(kind, field(0)).alias("kind"), field(1).alias("field2"), field(2).alias("field3"))


def stream_objects(streams: DataFrame) -> DataFrame:
    """(doc_id, n, first, text) of object streams to (doc_id, index, num, body): pairs of number and offset, then the objects themselves.

    A stream whose header holds fewer than n pairs, or offsets that fall, gives no rows.
    """
    header = F.filter(F.split(F.substring(F.col("text"), F.lit(1), F.col("first")), "\\s+"), lambda x: x != "")
    numbers = F.slice(F.transform(header, lambda x: x.try_cast("long")), F.lit(1), 2 * F.col("n"))
    pair = lambda k: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("numbers", 2 * i + k))
    own = streams.withColumn("numbers", numbers).where((F.col("n") > 0) & (F.size("numbers") == 2 * F.col("n")) & ~F.exists("numbers", lambda x: x.isNull()))
    own = own.withColumns({"nums": pair(0), "offsets": pair(1)}).where(F.col("offsets") == F.array_sort("offsets"))
    each = own.select("doc_id", "text", "first", "offsets", F.posexplode("nums").alias("index", "num"))
    start = F.get("offsets", F.col("index"))
    end = F.coalesce(F.get("offsets", F.col("index") + 1), F.length("text") - F.col("first"))
    return each.select("doc_id", "index", "num", F.trim(F.substring("text", (F.col("first") + start + 1).cast("int"), (end - start).cast("int"))).alias("body"))


def linearization(files: DataFrame) -> DataFrame:
    """(doc_id, version, length, first_page, n_pages, hint) of files whose first object says that they are linearised."""
    body = F.regexp_extract(latin(F.col("content")), "(?s)^.*?obj\\b(.*?)\\bendobj", 1)
    own = files.select(F.col("path").alias("doc_id"), body.alias("b")).where(F.col("b").contains("/Linearized"))
    number = lambda key: F.regexp_extract("b", f"/{key}\\s+([0-9]+)", 1).try_cast("long")
    version = F.regexp_extract("b", "/Linearized\\s+([0-9.]+)", 1).try_cast("double")
    return own.select("doc_id", version.alias("version"), number("L").alias("length"), number("O").alias("first_page"), number("N").alias("n_pages"), F.regexp_extract("b", "/H\\s*\\[\\s*([0-9]+)", 1).try_cast("long").alias("hint"))
