"""Operators on hand-made graphs: diamonds, cycles, orphans and several documents."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import filters
from docloom.functions import text as tx
from docloom.functions import values as vl
from docloom.graph import CHILD, REFERENCE, Graph
from docloom.operators import aggregates, content, joins, profiles, rules, security, selectors, sets, transforms, traversal, validation, windows
from docloom.sources import graphs, raw

NODES = "doc_id string, id long, node_type string, props map<string,string>, value double, errors array<string>"
EDGES = "doc_id string, src long, dst long, edge_type string, ord int"


def make(spark, nodes, edges, docs=("a",)):
    n = [(d, i, t, p, None, e) for d in docs for i, t, p, e in nodes]
    return Graph(spark.createDataFrame(n, NODES), spark.createDataFrame([(d, *x) for d in docs for x in edges], EDGES))


@pytest.fixture(scope="module")
def diamond(spark):
    """1 over 2 and 3, both over 4; 5 is an orphan with an error.  Two documents hold the same."""
    nodes = [(i, t, {"k": str(i)}, e) for i, t, e in [(1, "root", []), (2, "mid", []), (3, "mid", []), (4, "leaf", []), (5, "lost", ["x"])]]
    edges = [(1, 2, CHILD, 1), (1, 3, CHILD, 2), (2, 4, CHILD, 1), (3, 4, CHILD, 1), (4, 9, REFERENCE, 1)]
    return make(spark, nodes, edges, ("a", "b"))


def ids(df, doc="a"):
    return sorted(r["id"] for r in df.where(F.col("doc_id") == doc).select("id").collect())


def test_selectors(diamond):
    s, g = selectors, diamond
    assert ids(s.select(g, s.is_type("mid"))) == [2, 3]
    assert ids(s.select(g, s.has_property("nope"))) == []
    assert ids(s.select(g, s.has_errors())) == [5]
    assert ids(s.children_of(g, s.select(g, s.is_type("mid")))) == [4, 4]  # a bag: once for each parent
    assert ids(s.parents_of(g, s.select(g, s.has_id(4)))) == [2, 3]
    assert ids(s.siblings_of(g, s.select(g, s.has_id(2)))) == [3]
    assert ids(s.siblings_of(g, s.select(g, s.is_type("mid")))) == [2, 3]
    assert ids(s.none_of(g, s.select(g, s.is_type("mid")))) == [1, 4, 5]
    assert ids(s.either(s.select(g, s.has_id(1)), s.select(g, s.has_id(1)))) == [1]
    assert ids(s.child_range(g, 1, 1)) == []
    assert ids(g.roots()) == [1, 5]


def test_closure_of_unknown_depth_is_a_set(diamond):
    g = diamond
    found = traversal.closure(g.children(), selectors.select(g, selectors.has_id(1)))
    assert sorted((r["id"], r["depth"]) for r in found.where("doc_id = 'b'").collect()) == [(2, 1), (3, 1), (4, 2)]
    assert found.where("doc_id not in ('a', 'b')").isEmpty()


def test_cycles(spark):
    g = make(spark, [(i, "n", {}, []) for i in range(6)], [(0, 1, CHILD, 1), (1, 2, CHILD, 1), (2, 1, CHILD, 1), (3, 3, CHILD, 1), (2, 4, CHILD, 2)])
    assert ids(traversal.on_cycle(g.children())) == [1, 2, 3]
    layers = {r["id"]: r["layer"] for r in traversal.acyclic_layers(g.children()).collect()}
    assert layers == {0: 0}  # everything else is on or below a cycle
    assert ids(traversal.closure(g.children(), selectors.select(g, selectors.has_id(0)))) == [1, 2, 4]


def test_paths(diamond):
    g = diamond
    tree = Graph(g.nodes, g.edges.where("not (src = 3 and dst = 4)"))
    paths = traversal.paths_to_root(tree.children(), tree.nodes.select("doc_id", "id"))
    assert {r["id"]: r["path"] for r in paths.where("doc_id = 'a'").collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 2, 4], 5: [5]}


def test_references(diamond):
    g = diamond.stored()
    assert joins.dangling(g.references(), g.nodes).count() == 2
    assert joins.reference_integrity(g.references(), g.nodes).first()["integrity"] == 0
    assert joins.reference_integrity(g.references().limit(0), g.nodes).first()["integrity"] == 1
    report = {r["doc_id"]: r for r in validation.validate(g).collect()}["a"]
    assert (report["n_error"], report["valid"], report["status"]) == (2, False, "NonCompliant")  # two roots and a dangling edge


def test_transforms(diamond):
    g = diamond
    root = selectors.select(g, selectors.has_id(2))
    assert ids(transforms.remove_subtree(g, root).nodes) == [1, 3, 5]
    more = transforms.clone_subtree(g, root, 5, 100)
    assert ids(more.nodes) == [1, 2, 3, 4, 5, 102, 104]
    assert ids(selectors.children_of(more, selectors.select(more, selectors.has_id(5)))) == [102]
    assert transforms.would_make_cycle(g, 1, 4) and not transforms.would_make_cycle(g, 2, 3)
    assert ids(transforms.merge_nodes(g, 3, 2).nodes) == [1, 3, 4, 5]
    loose = g.edges.limit(1).withColumn("dst", F.lit(77).cast("long"))
    assert transforms.add_edges(g, loose).edges.count() == g.edges.count()


def test_graphs_on_disk(spark, diamond, tmp_path):
    for form in ("parquet", "json"):
        graphs.write(diamond, f"{tmp_path}/{form}", form)
        back = graphs.read(spark, f"{tmp_path}/{form}", form)
        assert sorted(map(str, back.nodes.select("doc_id", "id", "props").collect())) == sorted(map(str, diamond.nodes.select("doc_id", "id", "props").collect()))
        assert back.edges.count() == diamond.edges.count()
    diamond.nodes.withColumn("schema_version", F.lit("2.0.0")).write.mode("overwrite").parquet(f"{tmp_path}/parquet/nodes")
    with pytest.raises(ValueError, match="major version"):
        graphs.read(spark, f"{tmp_path}/parquet")


def test_raw_files(spark, tmp_path):
    body = b"%PDF-1.7\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count 1 /Kids [3 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>\nendobj\nstartxref\n0\n%%EOF\njunk"
    (tmp_path / "x.pdf").write_bytes(body)
    (tmp_path / "empty.pdf").write_bytes(b"x")
    files = raw.read(spark, str(tmp_path))
    o = {r["path"].rsplit("/", 1)[1]: r for r in raw.overview(files).collect()}
    assert (o["x.pdf"]["major"], o["x.pdf"]["minor"], o["x.pdf"]["n_objects"], o["x.pdf"]["n_eof"], o["x.pdf"]["trailing"]) == (1, 7, 3, 1, 4)
    assert (o["empty.pdf"]["major"], o["empty.pdf"]["n_objects"]) == (None, 0)
    g = raw.graph(files)
    assert sorted((r["id"] // 65536, r["node_type"]) for r in g.nodes.collect()) == [(1, "Catalog"), (2, "Pages"), (3, "Page")]
    assert {r["node_type"]: r["props"] for r in g.nodes.collect()}["Pages"] == {"Type": "Pages", "Count": "1"}
    assert sorted((r["src"] // 65536, r["dst"] // 65536) for r in g.edges.collect()) == [(1, 2), (2, 3), (3, 2), (3, 9)]
    assert [r["dst"] // 65536 for r in joins.dangling(g.references(), g.nodes).collect()] == [9]


def test_security_rules(spark):
    rows = [("http://1.2.3.4/x",), ("https://a.example.org/?data=1",), ("https://ok.example.org/",), (None,), ("",)]
    df = spark.createDataFrame(rows, "url string")
    found = {(r["url"], r["code"]) for r in rules.findings(df, security.url_rules(F.col("url")), "url").collect()}
    assert ("http://1.2.3.4/x", "SUSPICIOUS_URL") in found and ("https://a.example.org/?data=1", "DATA_EXFILTRATION") in found
    assert not any(u in (None, "", "https://ok.example.org/") for u, _ in found)
    names = spark.createDataFrame([("a.pdf.exe",), ("a.exe.pdf",), ("b .exe",)], "n string")
    got = {(r["n"], r["code"]) for r in rules.findings(names, security.file_rules(F.col("n")), "n").collect()}
    assert got == {("a.pdf.exe", "DOUBLE_EXTENSION"), ("b .exe", "HIDDEN_EXECUTABLE")}
    script = "eval(unescape('" + "\\x41" * 60 + "')); var a = 1;"
    got = {r["code"] for r in rules.findings(spark.createDataFrame([(script,)], "s string"), security.script_rules(F.col("s")), "s").collect()}
    assert got == {"OBFUSCATED", "SHELLCODE", "SUSPICIOUS_WORDS"}


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert str(get(vl.stamped(F.lit("D:20240229123456Z")))) == "2024-02-29 12:34:56"
    assert get(vl.stamped(F.lit("D:20241399000000"))) is None and get(vl.stamped(F.lit("2024"))) is None
    assert bytes(get(vl.ascii_hex(F.lit("48 65 6C6C6F7>")))) == b"Hello\x70"
    assert get(tx.unescaped_name(F.lit("A#20B+C%"))) == "A B+C%"
    assert get(tx.integer(F.lit("99999999999999999999"))) is None and get(tx.integer(F.lit("-7"))) == -7
    assert get(tx.real(F.lit("1e5"))) is None and get(tx.real(F.lit("-.5"))) == -0.5
    assert get(tx.decoded(F.lit(b"\xfe\xff\x00A\x00B"))) == "AB"
    assert bytes(get(vl.inflate(F.lit(b"broken")))) == b""
    a = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    b = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert get(vl.content_hash(F.lit("t"), a)) == get(vl.content_hash(F.lit("t"), b))


def test_order_sensitive(spark):
    r = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 9, 10), (2, 1, 2)], "g int, start int, end int")
    assert sorted(map(tuple, windows.merged_ranges(r, ["g"]).collect())) == [(1, 0, 8), (1, 9, 10), (2, 1, 2)]
    marks = spark.createDataFrame([(1, 1, "b"), (1, 2, "b"), (1, 3, "e"), (1, 4, "b")], "g int, t int, k string")
    assert sorted(x["t"] for x in windows.unended(marks, ["g"], ["t"], "k", "b", "e").collect()) == [1, 4]
    pairs = spark.createDataFrame([(1, "a\nb\nb", "b\nc"), (2, None, "x")], "pair_id int, old_text string, new_text string")
    got = sorted(map(tuple, sets.line_changes(pairs).collect()))
    assert got == [(1, "Delete", "a", 1), (1, "Delete", "b", 1), (1, "Insert", "c", 1), (2, "Delete", "", 1), (2, "Insert", "x", 1)]


PDF = b"""%PDF-1.4
1 0 obj
<< /Type /Catalog /Pages 2 0 R /Lang (en) >>
endobj
2 0 obj
<< /Type /Pages /Count 2 /Kids [3 0 R] >>
endobj
3 0 obj
<< /Type /Page /Parent 2 0 R >>
endobj
xref
0 4
0000000000 65535 f 
0000000009 00000 n 
0000000070 00000 n 
0000000130 00000 n 
trailer
<< /Root 1 0 R /Size 4 /ID [<aa> <bb>] >>
startxref
170
%%EOF
4 0 obj
<< /Type /Font /Subtype /Type1 >>
endobj
xref
3 2
0000000000 00001 f 
0000999999 00000 n 
trailer
<< /Root 1 0 R /Size 9 /Prev 170 >>
startxref
400
%%EOF
"""


def test_tables_of_raw_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(PDF)
    files = raw.read(spark, str(tmp_path))
    entries = raw.xref_entries(files)
    assert sorted((r["section"], r["num"], r["kind"]) for r in entries.collect()) == [(0, 0, "Free"), (0, 1, "InUse"), (0, 2, "InUse"), (0, 3, "InUse"), (1, 3, "Free"), (1, 4, "InUse")]
    assert {r["num"]: r["offset"] for r in raw.merged_xref(entries).collect()}[4] == 999999
    assert sorted((r["section"], r["num"], r["change"]) for r in raw.revisions(entries).collect()) == [(0, 1, "added"), (0, 2, "added"), (0, 3, "added"), (1, 3, "deleted"), (1, 4, "added")]
    assert [(r["root"], r["size"], r["prev"], r["n_ids"]) for r in raw.trailers(files).orderBy("section").collect()] == [(1, 4, None, 2), (1, 9, 170, 0)]
    assert sorted(r["code"] for r in raw.offset_findings(files).collect()) == ["TRAILER_SIZE", "XREF_PAST_END"]
    g = raw.graph(files)
    found = {(r["code"], r["severity"]) for r in profiles.issues(g).collect()}
    assert {("PAGES_COUNT_MISMATCH", "Error"), ("FONT_NOT_EMBEDDED", "Error"), ("METADATA_MISSING", "Warning")} <= found
    assert not {c for c, _ in found} & {"CATALOG_MISSING", "LANG_MISSING", "CATALOG_WITHOUT_PAGES", "ENCRYPTED"}
    status = {r["profile"]: r["status"] for r in profiles.validate_all(g).collect()}
    assert status == {"structure": "NonCompliant", "archive": "NonCompliant", "print": "NonCompliant", "access": "PartiallyCompliant"}


def test_page_programs(spark):
    program = "q 1 0 0 1 72.5 -3. cm % note\nBT /F1 12 Tf (Hel\\(lo) Tj [(Wo) -20 (rld)] TJ ET\n0 0 10 10 re f* XX Q 7"
    df = spark.createDataFrame([("a", program), ("b", ""), ("c", None)], "doc_id string, program string")
    ops = content.operations(df)
    rows = ops.orderBy("ord").collect()
    assert [r["op"] for r in rows] == ["q", "cm", "BT", "Tf", "Tj", "TJ", "ET", "re", "f*", "XX", "Q"]
    assert rows[1]["operands"] == ["1", "0", "0", "1", "72.5", "-3."] and rows[3]["operands"] == ["/F1", "12"] and rows[9]["group"] == "unknown"
    assert content.shown_text(ops).first()["text"] == "Hel(lo World"
    depth = {r["op"]: r["depth"] for r in content.nesting(ops, ["q"], ["Q"]).collect()}
    assert (depth["q"], depth["Tj"], depth["Q"]) == (1, 1, 0)
    assert {r["op"]: r["state"] for r in content.carried(ops, "Tf").collect()}["Tj"] == ["/F1", "12"]


def test_laid_out_text(spark):
    spans = [(1, 0.0, 0.0, 10.0, 10.0, 3.0, "a"), (1, 12.0, 1.0, 10.0, 10.0, 3.0, "b"), (1, 40.0, 1.0, 5.0, 10.0, 3.0, "far"), (1, 0.0, 20.0, 5.0, 10.0, 3.0, "next"), (2, 0.0, 0.0, 5.0, 10.0, 3.0, "z")]
    df = spark.createDataFrame(spans, "page int, x double, y double, width double, height double, space double, text string")
    got = sorted((r["page"], r["line"], r["text"]) for r in content.text_lines(df, ["page"]).collect())
    assert got == [(1, 1, "a b"), (1, 2, "far"), (1, 3, "next"), (2, 1, "z")]
    codes = spark.createDataFrame([(65,), (66,), (100,), (9,)], "code int")
    singles = spark.createDataFrame([(66, "!")], "code int, char string")
    ranges = spark.createDataFrame([(60, 70, 97), (64, 66, 48)], "low int, high int, start int")
    assert {r["code"]: r["char"] for r in content.mapped_codes(codes, singles, ranges).collect()} == {65: "f", 66: "!", 100: None, 9: None}
    one = spark.range(1).select(content.confidence(F.lit(4), F.lit(0.5), F.lit(2), F.lit(True)).alias("c")).first()["c"]
    assert one == pytest.approx(0.7)


def lzw_encoded(data, early=1):
    """Every code in turn, without clearing: short data only."""
    table, word, codes = {bytes([i]): i for i in range(256)}, b"", [256]
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
        else:
            codes.append(table[word])
            table[word + bytes([c])] = len(table) + 2
            word = bytes([c])
    codes += [table[word]] if word else []
    bits, size, known = "", 9, 258
    for i, c in enumerate([*codes, 257]):
        bits += format(c, f"0{size}b")
        known += i > 1
        size += size < 12 and known + early >= 1 << size
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_filter_chains(spark):
    import zlib

    for data in (b"", b"a", b"ababababab" * 30, bytes(range(256)) * 3):
        assert filters.lzw(lzw_encoded(data)) == data
    assert filters.chain(bytes([2, 65, 66, 67, 254, 90, 128, 1]), ["RunLengthDecode"]) == b"ABCZZZ"
    assert filters.chain(b"87cURD]~>", ["ASCII85Decode"]) == b"Hello" and filters.chain(b"\x01~>", ["ASCII85Decode"]) is None
    packed = zlib.compress(b"hello" * 10)
    assert filters.chain(packed.hex().encode() + b">", ["ASCIIHexDecode", "FlateDecode"]) == b"hello" * 10
    assert filters.chain(packed, ["Unknown"]) is None and filters.chain(b"broken", ["FlateDecode"]) is None and filters.chain(None, ["FlateDecode"]) is None
    assert filters.chain(zlib.compress(b"0" * 10**6), ["FlateDecode"]) is None  # over the ratio
    assert filters.chain(zlib.compress(b"0" * 10**6), ["FlateDecode"], most=1000, ratio=10**6) is None
    df = spark.createDataFrame([(packed, ["FlateDecode"]), (b"x", None), (None, [])], "d binary, f array<string>")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(filters.decoded(F.col("d"), F.col("f"))).collect()] == [b"hello" * 10, b"x", None]


def test_stable_ids(spark):
    g = make(spark, [(1, "root", {}, []), (2, "Font", {"BaseFont": "A"}, []), (3, "Font", {"BaseFont": "A"}, []), (4, "Font", {}, [])], [(1, 2, CHILD, 1), (1, 3, CHILD, 2), (2, 4, CHILD, 1)])
    names = {r["id"]: r["stable_id"] for r in graphs.stable_ids(g, {"Font": "BaseFont"}).collect()}
    assert names[2] == "font_A" and names[3] == "font_A_2" and names[4].startswith("font_") and len(set(names.values())) == 4
    assert graphs.as_xml(spark.createDataFrame([(1, "a<b")], "k int, v string")).first()["xml"].count("&lt;") == 1


def test_exact_percentiles(spark):
    import random

    r = random.Random(6)
    rows = [(g, float(r.choice([r.gauss(0, 1), 7.0, r.randint(0, 3)]))) for g in "aab" for _ in range(4000)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(x["g"], x["percent"]): x["value"] for x in aggregates.nearest_rank(df, "v", [0, 1, 50, 95, 100], ["g"]).collect()}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g)
        assert all(got[g, p] == values[(len(values) - 1) * p // 100] for p in (0, 1, 50, 95, 100))
    assert len(got) == 15
    assert [x["value"] for x in aggregates.nearest_rank(df, "v", [50]).collect()] == [sorted(v for _, v in rows if v is not None)[12000 // 2]]


def test_lists_outlines_and_orders(spark):
    from docloom.operators import extractors as x
    from docloom.operators import tours

    n = 37
    items = [("a", i, i + 1 if i < n - 1 else None) for i in range(n)] + [("b", 5, 3), ("b", 3, 4), ("b", 4, None), ("c", 1, 2), ("c", 2, 1)]
    got = {(r["doc_id"], r["id"]): r["place"] for r in x.list_places(spark.createDataFrame(items, "doc_id string, id long, next long")).collect()}
    assert got == {**{("a", i): i for i in range(n)}, ("b", 5): 0, ("b", 3): 1, ("b", 4): 2}  # the ring of c has no first item
    kids = spark.createDataFrame([("a", 0, 5, 1), ("a", 0, 4, 2), ("a", 5, 9, 1), ("a", 5, 7, 2), ("a", 4, 8, 1)], "doc_id string, src long, dst long, place long")
    flat = tours.walk(kids, spark.createDataFrame([("a", 0)], "doc_id string, id long"))
    assert [(r["id"], r["level"]) for r in flat.orderBy("place").collect()] == [(0, 0), (5, 1), (9, 2), (7, 2), (4, 1), (8, 2)]


def test_nested_marked_text(spark):
    from docloom.operators import extractors as x

    ops = [(1, "BDC", 1, None), (2, "Tj", None, "a"), (3, "BDC", 2, None), (4, "Tj", None, "b"), (5, "EMC", None, None), (6, "Tj", None, "c"), (7, "EMC", None, None), (8, "Tj", None, "d"), (9, "BMC", None, None), (10, "Tj", None, "e"), (11, "EMC", None, None)]
    rows = x.marked_text(spark.createDataFrame([("p", *o) for o in ops], "doc_id string, ord int, op string, mcid long, text string")).collect()
    assert {r["mcid"]: r["text"] for r in rows} == {1: "ac", 2: "b"}


def test_predictors_and_dictionary_codes():
    import random

    r = random.Random(5)
    for size in (0, 1, 7, 300, 20_000):
        data = bytes(r.choice(b"abc") if r.random() < 0.9 else r.randrange(256) for _ in range(size))
        assert filters.lzw(filters.lzw_encode(data)) == data
    rows = [bytes(r.randrange(256) for _ in range(6)) for _ in range(9)]
    coded, above = b"", bytes(6)
    for k, row in enumerate(rows):
        kind, out = k % 5, bytearray(6)
        for i in range(6):
            a, b, c = (row[i - 2] if i >= 2 else 0), above[i], (above[i - 2] if i >= 2 else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out[i] = row[i] - [0, a, b, (a + b) // 2, near][kind] & 255
        coded, above = coded + bytes([kind]) + bytes(out), row
    assert filters.unpredict(coded, 15, 3, 2) == b"".join(rows)
    pixels = bytes(range(24))
    left = b"".join(bytes(row[i] - (row[i - 2] if i >= 2 else 0) & 255 for i in range(6)) for row in (pixels[k : k + 6] for k in range(0, 24, 6)))
    assert filters.unpredict(left, 2, 3, 2) == pixels and filters.unpredict(b"abc", 1, 3) == b"abc"
    assert filters.chain(filters.lzw_encode(b"x" * 50_000), ["LZWDecode"], most=1000) is None
    assert filters.chain(b"61" * 30_000_000, ["ASCIIHexDecode"], most=1 << 26) is not None


def test_the_smallest_codec_is_chosen(spark):
    rows = [(1, "Flate", 10), (1, "LZW", 8), (1, "RunLength", None), (2, "RunLength", 3), (2, "LZW", 3)]
    got = {r["k"]: r["codec"] for r in filters.smallest(spark.createDataFrame(rows, "k int, codec string, size int"), "k").collect()}
    assert got == {1: "LZW", 2: "LZW"}


def test_shared_folders_are_asked_for_on_clusters(spark, monkeypatch):
    from docloom import storage

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="share"):
        storage.folder(Session)


def test_depths_give_sets(diamond):
    root = selectors.select(diamond, selectors.has_id(1))
    with_depth = traversal.closure(diamond.children(), root, depth=3)
    assert sorted((r["doc_id"], r["id"], r["depth"]) for r in with_depth.collect()) == sorted((r["doc_id"], r["id"], r["depth"]) for r in traversal.closure(diamond.children(), root).collect())


def test_cycles_and_what_lies_between_them(spark):
    g = make(spark, [], [(0, 1, CHILD, 1), (1, 0, CHILD, 1), (1, 2, CHILD, 1), (2, 3, CHILD, 1), (3, 4, CHILD, 1), (4, 3, CHILD, 1), (9, 0, CHILD, 1), (4, 8, CHILD, 1)])
    assert ids(traversal.on_cycle(g.children())) == [0, 1, 3, 4]  # 2 lies between two cycles
