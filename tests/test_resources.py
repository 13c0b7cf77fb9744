"""Rules, resources, versions, codecs and moves on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import cbor, filters
from docloom.graph import Graph
from docloom.operators import profiles, resources, rules, tours, transforms
from docloom.plans import ruling
from docloom.sources import graphs, raw


def test_every_code_has_a_file(spark):
    """The faults name every code of the profiles, and those of offsets."""
    codes = {r.code for r in (*profiles.document_rules(), *profiles.node_rules(), *profiles.file_rules())}
    assert codes | {"XREF_PAST_END", "TRAILER_SIZE", "XREF_ENTRIES_MISSING"} == {c for _, cs in ruling.FAULTS.values() for c in cs}


def test_documents_without_nodes(spark):
    nodes = spark.createDataFrame([], "doc_id string, id long, node_type string, props map<string,string>, value double, errors array<string>")
    g = Graph(nodes, spark.createDataFrame([], "doc_id string, src long, dst long, edge_type string, ord int"))
    rows = profiles.document_rows(g, spark.createDataFrame([("a",)], "doc_id string"))
    assert "EMPTY_DOCUMENT" in {r["code"] for r in rules.findings(rows, profiles.document_rules(), "doc_id").collect()}
    assert profiles.document_rows(g).count() == 0


def test_offsets_of_files_without_tables(spark):
    files = spark.createDataFrame([("a", 9, b"%PDF-1.4\n"), ("b", 2, None)], "path string, length long, content binary")
    assert sorted(tuple(r) for r in raw.offset_findings(files).collect()) == [("a", "XREF_ENTRIES_MISSING"), ("b", "XREF_ENTRIES_MISSING")]


def test_icc_headers(spark):
    head = (300).to_bytes(4, "big") + b"ab\x00d" + b"\x43\x00\x00\x00" + b"mntrRGB Lab " + bytes(12) + b"acsp" + bytes(88)
    got = [r["h"] for r in spark.createDataFrame([(head,), (head[:127],), (None,)], "c binary").select(resources.icc_header(F.col("c")).alias("h")).collect()]
    assert got[0].asDict() == {"size": 300, "cmm_type": "ab?d", "version": "4.3", "device_class": "mntr", "color_space": "RGB?", "pcs": "Lab?", "signature": "acsp"} and got[1:] == [None, None]


@pytest.mark.parametrize(("text", "want"), [
    ("/DeviceGray", ("DeviceGray", None, None, None, None)), ("[/ICCBased 12 0 R]", ("ICCBased", None, None, None, 12)), ("[ /Indexed\n/DeviceRGB 15 <00ff>]", ("Indexed", "DeviceRGB", None, 15, None)),
    ("[/Indexed [/ICCBased 5 0 R] 3 7 0 R]", ("Indexed", "ICCBased", None, 3, None)), ("[/Separation /Gold /DeviceCMYK 4 0 R]", ("Separation", "DeviceCMYK", ["Gold"], None, None)),
    ("[/DeviceN [/A /B#20C] [/CalRGB << >>] 4 0 R]", ("DeviceN", "CalRGB", ["A", "B#20C"], None, None)), ("[/Pattern /DeviceRGB]", ("Pattern", "DeviceRGB", None, None, None)), ("/Unknown", None), ("[/DeviceRGBX]", None), ("", None), (None, None),
])
def test_colour_spaces(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(resources.colour_space(F.col("t")).alias("s")).first()["s"]
    assert (got and tuple(got)) == want


def test_graphics_states_are_typed(spark):
    df = spark.createDataFrame([({"LW": "2", "LC": "x", "op": "false", "RI": "Perceptual", "SM": "0.5"},), ({},), (None,)], "p map<string,string>")
    got = [r["s"].asDict() for r in df.select(resources.graphics_state(F.col("p")).alias("s")).collect()]
    assert (got[0]["line_width"], got[0]["line_cap"], got[0]["overprint_fill"], got[0]["overprint"], got[0]["smoothness"]) == (2.0, None, False, None, 0.5)
    assert all(v is None for v in (*got[1].values(), *got[2].values()))


def test_scripts_streams_and_namespaces(spark):
    names = spark.createDataFrame([("a", 1, "n", 7), ("a", 2, "n", 8), ("a", 3, "m", 9), ("a", 4, "none", 99)], "doc_id string, ord long, name string, target long")
    nodes = spark.createDataFrame([("a", 7, "old", None), ("a", 8, None, b"new"), ("a", 9, None, b"\xff")], "doc_id string, id long, js string, stream binary")
    assert [tuple(r) for r in resources.named_scripts(names, nodes).collect()] == [("a", "n", "new", True)]
    pages = spark.createDataFrame([("a", 1, "[5 0 R 6 0 R 5 0 R]"), ("a", 2, "6 0 R"), ("a", 3, None)], "doc_id string, id long, contents string")
    streams = spark.createDataFrame([("a", 5, b"x"), ("a", 6, b"y"), ("b", 5, b"z")], "doc_id string, num long, content binary")
    assert sorted((r["id"], r["ord"], bytes(r["content"])) for r in resources.content_streams(pages, streams).collect()) == [(1, 0, b"x"), (1, 1, b"y"), (1, 2, b"x"), (2, 0, b"y")]
    packets = spark.createDataFrame([(1, '<a xmlns:p="u:1" xmlns:q = "u:2"><p:x p:y="1"/><p:x/></a>'), (2, None), (3, "<none/>")], "doc_id long, xml string")
    assert sorted((r["prefix"], r["uri"], r["properties"]) for r in resources.namespaces(packets).collect()) == [("p", "u:1", ["p:x", "p:y"]), ("q", "u:2", [])]


def test_content_rules(spark):
    rows = [(1, {"JS": "x = eval (1)"}), (2, {"FT": "Sig", "AA": "<<"}), (3, {"Subtype": "Widget", "A": "<<"}), (4, {"Movie": "m"}), (5, {"JS": "evaluate(1)", "Subtype": "Link"}), (6, None)]
    found = rules.findings(spark.createDataFrame(rows, "doc_id long, props map<string,string>"), resources.content_rules(F.col("props")), "doc_id")
    assert {(r["doc_id"], r["code"]) for r in found.collect()} == {(1, "MALICIOUS_SCRIPT"), (2, "SIGNATURE_FIELD"), (2, "FORM_ACTION"), (3, "WIDGET"), (3, "ANNOTATION_ACTION"), (4, "MULTIMEDIA_CONTENT")}
    total = resources.check_statistics(found, spark.createDataFrame(rows, "doc_id long, props map<string,string>")).first()
    assert tuple(total) == (6, 4, 6, 4)


def test_versions_row_by_row(spark):
    rows = [(1, "0.9.0", "Page", None, {"a": "1"}, None), (2, "1.0.0", None, "Font", {"b": "2"}, None), (3, "1.1.0", None, "Form", None, {"c": "3"})]
    df = spark.createDataFrame(rows, "id long, schema_version string, kind string, node_type string, properties map<string,string>, props map<string,string>")
    got = {r["id"]: (r["node_type"], r["props"], r["errors"], r["schema_version"]) for r in graphs.migrated(df).collect()}
    assert got == {1: ("Page", {"a": "1"}, [], "1.1.0"), 2: ("Font", {"b": "2"}, [], "1.1.0"), 3: ("Form", {"c": "3"}, None, "1.1.0")}
    with pytest.raises(Exception, match="no way from version 7.0.0"):
        graphs.migrated(df.withColumn("schema_version", F.lit("7.0.0"))).collect()
    reports = spark.createDataFrame([(1, None), (2, "x"), (3, "1.4.2"), (4, "2.0")], "id long, version string")
    assert {tuple(r) for r in graphs.report_version(reports, "id").collect()} == {(1, "VERSION_MISSING"), (2, "VERSION_INVALID"), (4, "VERSION_UNSUPPORTED")}


def test_json_schema(spark):
    import json

    schema = json.loads(graphs.as_json_schema(spark.range(1).select("id", F.array(F.lit("a")).alias("tags"), F.create_map(F.lit("k"), F.lit(1.5)).alias("props")), "nodes"))
    assert schema["properties"] == {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}, "props": {"type": "object", "additionalProperties": {"type": "number"}}}
    assert "id" in schema["required"] and schema["title"] == "nodes"


@pytest.mark.parametrize("codec", ["Flate", "LZW", "RunLength", "ASCII85", "ASCIIHex"])
def test_codecs_give_back_what_they_take(spark, codec):
    r = random.Random(1)
    rows = [(i, bytes(r.choice(b"ab\x00\xff") for _ in range(n)) + b"z" * r.randint(0, 400)) for i, n in enumerate((0, 1, 2, 127, 128, 129, 1000))] + [(50, None)]
    df = spark.createDataFrame(rows, "id long, content binary")
    back = df.select("id", filters.decoded(filters.coded(F.col("content"), codec), F.array(F.lit(f"{codec}Decode"))).alias("b")).collect()
    assert {x["id"]: x["b"] if x["b"] is None else bytes(x["b"]) for x in back} == dict(rows)


def item(value):
    """CBOR of a text, by hand."""
    data = value.encode()
    n = len(data)
    return (bytes([0x60 + n]) if n < 24 else b"\x78" + bytes([n]) if n < 256 else b"\x79" + n.to_bytes(2, "big") if n < 65536 else b"\x7a" + n.to_bytes(4, "big")) + data


def test_cbor(spark):
    maps = [{}, {"a": "1"}, {"b": "x" * 23, "a": "y" * 24, "ü": "é" * 200}, {"long": "z" * 70_000}, {f"k{i:02}": str(i) for i in range(30)}, {"n": None}]
    df = spark.createDataFrame(list(enumerate(maps)), "id long, m map<string,string>").select("id", cbor.encoded(F.col("m")).alias("c"))
    for r in df.select("id", "c", cbor.decoded(F.col("c")).alias("m")).collect():
        m = maps[r["id"]]
        head = bytes([0xA0 + len(m)]) if len(m) < 24 else b"\xb8" + bytes([len(m)])
        assert bytes(r["c"]) == head + b"".join(item(k) + (b"\xf6" if v is None else item(v)) for k, v in sorted(m.items(), key=lambda kv: kv[0].encode())) and r["m"] == m
    odd = [b"", b"\xa1", b"\xa1\x61a", b"\xa1\x61a\x01", b"\x61a", b"\xbf\xff", b"\xa1\x61a\x61b\x00", b"\xa2\x61a\x61b\x61a\x61c", b"\xa1\x61a\x62\xff\xff", None]
    assert [r["m"] for r in spark.createDataFrame([(x,) for x in odd], "c binary").select(cbor.decoded(F.col("c")).alias("m")).collect()] == [None] * len(odd)


def test_cyclic_moves(spark):
    kids = spark.createDataFrame([("a", 0, 1, 1), ("a", 1, 2, 1), ("a", 1, 3, 2), ("a", 0, 4, 2)], "doc_id string, src long, dst long, place long")
    walked = tours.walk(kids, spark.createDataFrame([("a", 0)], "doc_id string, id long"))
    moves = spark.createDataFrame([("a", 1, 3), ("a", 1, 1), ("a", 1, 4), ("a", 2, 3), ("a", 0, 4), ("a", 9, 1)], "doc_id string, root long, new_parent long")
    assert {(r["root"], r["new_parent"]): r["cycle"] for r in transforms.cyclic_moves(walked, moves).collect()} == {(1, 3): True, (1, 1): True, (1, 4): False, (2, 3): False, (0, 4): True, (9, 1): None}


def test_stable_ids_are_given_once(spark):
    nodes = [(1, i, "Font", {"F": name}, None, []) for i, name in enumerate(["a", "a", "a_2", "a_2"])]
    g = Graph(spark.createDataFrame(nodes, "doc_id long, id long, node_type string, props map<string,string>, value double, errors array<string>"), spark.createDataFrame([], "doc_id long, src long, dst long, edge_type string, ord int"))
    names = {r["id"]: r["stable_id"] for r in graphs.stable_ids(g, {"Font": "F"}).collect()}
    assert len(set(names.values())) == 4 and names[0] == "font_a" and names[2] == "font_a_2"
