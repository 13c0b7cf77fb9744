"""Ordered diffs, tours, nested values, table functions, folders, signatures, chains, functions and waiting references."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import calculators, dom, nested
from docloom.operators import diffs, signatures, tours
from docloom.sources import folders, raw

# --- ordered diffs ---


def lcs(a, b):
    """The length of a longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def applied(runs, old, new):
    out, at_old, at_new = [], 0, 0
    for r in sorted(runs, key=lambda r: (r["new_start"], r["old_start"])):
        assert (r["old_start"], r["new_start"]) == (at_old, at_new)
        at_old, at_new = at_old + r["old_len"], at_new + r["new_len"]
        if r["op"] == "equal":
            assert r["old_len"] == r["new_len"]
            out += old[r["old_start"] : at_old]
        else:
            assert (r["op"] == "insert") == (r["old_len"] == 0) and (r["op"] == "delete") == (r["new_len"] == 0)
            out += new[r["new_start"] : at_new]
    assert at_old == len(old)
    return out


def test_scripts_turn_old_into_new(spark):
    r, rows = random.Random(4), []
    for i in range(60):  # lines drawn with repeats
        rows.append((i, "\n".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 30))), "\n".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 30)))))
    for i in range(60, 100):  # lines of their own: a script keeps a longest common subsequence
        old = r.sample(range(100), 40)
        rows.append((i, "\n".join(map(str, old)), "\n".join(map(str, r.sample(old, 25) + r.sample(range(100, 130), 9)))))
    same = "\n".join(map(str, range(5000)))
    rows += [(100, None, None), (101, None, "a\nb"), (102, "a\nb\n", ""), (103, same, same), (104, "x\n" * 50, "x\n" * 60), (105, same, same.replace("\n2500\n", "\nnew\n"))]
    df = spark.createDataFrame(rows, "pair_id long, old string, new string").repartition(3)
    by = {}
    for run in diffs.script(df).collect():
        by.setdefault(run["pair_id"], []).append(run)
    for i, old, new in rows:
        old, new = (old or "").split("\n"), (new or "").split("\n")
        assert applied(by[i], old, new) == new
        kept, best = sum(x["old_len"] for x in by[i] if x["op"] == "equal"), None
        if i < 100:
            best = lcs(old, new)
            assert kept <= best
        if 60 <= i < 100:
            assert kept == best
    assert sum(x["old_len"] for x in by[105] if x["op"] == "equal") == 4999 and len(by[105]) == 3
    assert sum(x["old_len"] for x in by[104] if x["op"] == "equal") == 51
    assert {r["pair_id"]: r["text"] for r in diffs.patched(df, diffs.script(df)).collect()} == {i: new or "" for i, _, new in rows}


def test_no_pairs(spark):
    assert diffs.script(spark.createDataFrame([], "pair_id long, old string, new string")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_rising_runs_are_longest(seed):
    r = random.Random(seed)
    values = r.sample(range(100), r.randint(0, 40))
    got = [values[i] for i in diffs.rising(values)]
    assert got == sorted(got) and len(got) == lcs(values, sorted(values))


def test_version_summary(spark):
    node = "doc_id long, id long, node_type string, props map<string,string>"
    old = spark.createDataFrame([(1, 1, "Page", {"a": "1"}), (1, 2, "Page", {"a": "1"}), (1, 3, "Font", {"a": "1", "b": "2"}), (2, 1, "Font", {})], node)
    new = spark.createDataFrame([(1, 1, "Page", {"a": "2"}), (1, 3, "Font", {"b": "2", "a": "1"}), (1, 4, "Page", None), (2, 1, "Font", {})], node)
    rows = {r["doc_id"]: r for r in diffs.summary(old, new).collect()}
    assert (rows[1]["structure"], rows[1]["content"], rows[1]["pages_added"], rows[1]["pages_removed"], rows[1]["pages_modified"], rows[1]["changes"]) == (2, 1, 1, 1, 1, 6)
    assert rows[1]["similarity"] == pytest.approx(1 - 6 / 15) and rows[2]["similarity"] == 1.0
    assert diffs.report(diffs.summary(old, new)).where("doc_id = 2").first()["report"].startswith("Similarity Score: 100.00%\nTotal Changes: 0\n")


# --- tours ---


def brute_walk(children, roots):
    below, out, place = {}, {}, 0
    for doc, src, dst, at in children:
        below.setdefault((doc, src), []).append((at, dst))
    for doc in sorted({d for d, _ in roots}):
        place, todo = 0, [(i, 0) for i in sorted((i for d, i in roots if d == doc), reverse=True)]
        while todo:
            node, level = todo.pop()
            place += 1
            out[doc, node] = [level, place, 0]
            todo += [(n, level + 1) for _, n in sorted(below.get((doc, node), []), reverse=True)]
    def size(doc, node):
        return 1 + sum(size(doc, n) for _, n in below.get((doc, node), []))
    for doc, node in out:
        out[doc, node][2] = size(doc, node)
    return {k: tuple(v) for k, v in out.items()}


def test_walks(spark):
    r, children, roots = random.Random(3), [], [(1, 0), (2, 0), (2, 1000), (3, 5), (4, 0)]
    for doc in (1, 2):
        for n in range(1, 120):
            children.append((doc, r.randint(max(0, n - 6), n - 1), n, r.randint(0, 3)))
    children += [(2, 1000, 1001, 0), (1, 900, 901, 0), (4, 70, 71, 0), (4, 71, 70, 0)]  # nodes that no root leads to, and a ring
    got = tours.walk(spark.createDataFrame(children, "doc_id long, src long, dst long, place long"), spark.createDataFrame(roots, "doc_id long, id long")).collect()
    assert {(x["doc_id"], x["id"]): (x["level"], x["place"], x["size"]) for x in got} == brute_walk(children, roots)


def test_a_long_chain_takes_rows_linear_in_its_length(spark, monkeypatch):
    from docloom import storage

    n, written, table = 20_000, [], storage.table
    monkeypatch.setattr(storage, "table", lambda df, name: written.append(t := table(df, name)) or t)
    kids = spark.range(n - 1).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("place"))
    roots = spark.createDataFrame([(1, 0)], "doc_id long, id long")
    wrong = tours.walk(kids, roots).where("level <> id or place <> id + 1 or size <> 20000 - id").count()
    assert wrong == 0 and len(written) <= 18  # a round for each doubling; each round's table has two rows a node


def test_reading_order(spark):
    walked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "doc_id long, id long, place long")
    content = spark.createDataFrame([(1, 1, 10), (1, 3, 20), (1, 2, 30), (1, 9, 5)], "doc_id long, id long, shown long")
    assert sorted(tuple(r) for r in tours.reading_order(walked, content).collect()) == [(1, 2, "OUT_OF_ORDER"), (1, 9, "UNREAD")]


# --- nested values ---


def test_levels_and_limits(spark):
    rows = [(1, '{"a": [1, {"b": "text"}], "c": null}'), (2, "[[[[1]]]]"), (3, "not json"), (4, None), (5, '"x"'), (6, "{}")]
    df = spark.createDataFrame(rows, "id long, j string").select("id", nested.parsed(F.col("j")).alias("value"))
    got = {(r["id"], r["path"]): (r["depth"], r["kind"]) for r in nested.levels(df, "id", "value", 3).collect()}
    assert got[1, "$"] == (0, "object") and got[1, "$.a"] == (1, "array") and got[1, "$.a[0]"] == (2, "bigint") and got[1, "$.a[1].b"] == (3, "string") and got[1, "$.c"] == (1, "void")
    assert got[2, "$[0][0][0]"] == (3, "array") and (2, "$[0][0][0][0]") not in got
    assert got[5, "$"] == (0, "string") and got[6, "$"] == (0, "object") and not any(k[0] in (3, 4) for k in got)
    found = {(r["id"], r["path"], r["code"]) for r in nested.limit_findings(df, "id", "value", 2, 1, 1, 3).collect()}
    assert found == {(1, "$.a", "TOO_MANY_ITEMS"), (1, "$", "TOO_MANY_KEYS"), (1, "$.a[1].b", "TOO_DEEP"), (1, "$.a[1].b", "STRING_TOO_LONG"), (2, "$[0][0][0]", "TOO_DEEP")}
    assert {(r["id"], r["path"], r["text"]) for r in nested.texts(df, "id", "value", 5).collect()} == {(1, "$.a[1].b", "text"), (5, "$", "x")}


# --- elements ---


def test_elements_by_hand():
    assert dom.elements("<html><body><p>a<br>b<img/></p><ul><li>1<li>2</ul>t</body></html>") == [(0, None, "html", 0), (1, 0, "body", 1), (2, 1, "p", 2), (3, 2, "br", 3), (4, 2, "img", 3), (5, 1, "ul", 2), (6, 5, "li", 3), (7, 6, "li", 4)]
    assert dom.elements(None) == [] and dom.elements("</p>text &amp; more") == [] and dom.elements("<script>if (a<b) '<p>'</script><P>") == [(0, None, "script", 0), (1, None, "p", 0)]
    assert len(dom.elements("<b>" * 5000 + "</i>" * 5000)) == 5000


def test_table_function(spark):
    pages = [(i, f"<div><p>{i}<br></p></div>" * (i % 4), "clash") for i in range(40)] + [(50, None, "clash")]
    got = dom.dom(spark.createDataFrame(pages, "page_id long, html string, node string").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, *e) for i, html, _ in pages for e in dom.elements(html))


# --- folders ---


@pytest.fixture
def folder(tmp_path):
    for i in range(10):
        os.makedirs(tmp_path / f"d{i % 3}", exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"f{i}.pdf").write_bytes(bytes([i]) * (100 * i))
    (tmp_path / "notes.txt").write_text("not taken")
    return str(tmp_path)


def test_folder_partitions_by_bytes(spark, folder):
    folders.register(spark)
    read = lambda **o: spark.read.format("documents").options(path=folder, pattern="*.pdf", **o).load()
    rows = {os.path.basename(r["path"]): (r["length"], bytes(r["content"])) for r in read().collect()}
    assert rows == {f"f{i}.pdf": (100 * i, bytes([i]) * (100 * i)) for i in range(10)}
    sizes = [sum(n for _, n in p.files) for p in folders.FolderReader({"path": folder, "pattern": "*.pdf", "partitionbytes": "1000"}).partitions()]
    assert sum(sizes) == 4500 and max(sizes) <= 1000 and read(partitionBytes=1000).rdd.getNumPartitions() == len(sizes) == 6
    assert read(partitionBytes=1).rdd.getNumPartitions() == 9  # a file each, the empty one with the next


def test_folder_takes_filters_at_planning(spark, folder):
    folders.register(spark)
    path = next(p for p, _, _ in folders.listed(folder, "f5.pdf"))
    df = spark.read.format("documents").options(path=folder, partitionBytes=1).load().where(F.col("path") == path)
    assert [r["length"] for r in df.collect()] == [500] and df.rdd.getNumPartitions() == 1
    assert spark.read.format("documents").options(path=folder).load().where(F.col("path").startswith(folder + "/d1")).count() == 3
    assert spark.read.format("documents").options(path=folder).load().where(F.col("length") > 700).count() == 2
    assert spark.read.format("documents").options(path=folder, pattern="*.none").load().count() == 0


def test_folder_as_a_stream(spark, folder, tmp_path_factory):
    folders.register(spark)
    out, progress = (str(tmp_path_factory.mktemp(n)) for n in ("out", "progress"))

    def run():
        stream = spark.readStream.format("documents").options(path=folder, pattern="*.pdf").load()
        stream.select("path", "length").writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(once=True).start().awaitTermination()
        return spark.read.schema("path string, length long").parquet(out).count()

    assert run() == 10
    with open(f"{folder}/late.pdf", "wb") as f:
        f.write(b"x")
    assert run() == 11


# --- signatures ---


def test_signatures_as_brute_force_has_them(spark):
    r = random.Random(2)
    known = {"AA": "4141", "AAA": "414141", "AB": "4142", "ZERO": "00", "SAME": "4142"}
    rows = [(i, bytes(r.choice(b"AB\x00\xff") for _ in range(r.randint(0, 60)))) for i in range(80)] + [(99, None)]
    got = sorted(tuple(x) for x in signatures.hits(spark.createDataFrame(rows, "id long, content binary").repartition(3), "id", "content", known).collect())
    want = sorted((i, name, k) for i, data in rows for name, code in known.items() for k in range(len(data or b"")) if data.startswith(bytes.fromhex(code), k))
    assert got == want


# --- cross-reference chains ---


def chained_file(sections, start):
    """Sections (entry's number, /Prev) after a head of nine bytes; %d in a /Prev is the place of a section."""
    size = 68
    text = "%PDF-1.4\n" + "".join(f"xref\n{num} 1\n{k:010d} 00000 n \ntrailer\n<< /Size 9 /Prev {9 + size * prev if prev is not None else 0:010d} >>\n" for k, (num, prev) in enumerate(sections))
    return f"{text}startxref\n{9 + size * start}\n%%EOF\n".encode()


def test_chains_follow_prev(spark):
    files = [("a", chained_file([(1, 2), (2, None), (1, 1)], 0)), ("ring", chained_file([(1, 1), (2, 0)], 0)), ("self", chained_file([(1, 0)], 0)), ("lost", b"%PDF-1.4\nstartxref\n5\n%%EOF"), ("off", chained_file([(1, 7)], 0))]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {}
    for r in raw.xref_chain(df).collect():
        got.setdefault(r["doc_id"], []).append((r["revision"], r["offset"], r["anomaly"]))
    assert sorted(got["a"]) == [(0, 9, None), (1, 145, None), (2, 77, None)]
    assert sorted(got["ring"], key=str) == [(0, 9, None), (1, 77, None), (None, 9, "xref_prev_cycle")]
    assert sorted(got["self"], key=str) == [(0, 9, None), (None, 9, "xref_prev_cycle")]
    assert sorted(got["off"], key=str) == [(0, 9, None), (None, 9 + 68 * 7, "xref_parse_failed")]
    assert "lost" not in got
    entries = {(r["doc_id"], r["num"]): (r["offset"], r["revision"]) for r in raw.chained_xref(df).where("doc_id = 'a'").collect()}
    assert entries == {("a", 1): (0, 0), ("a", 2): (1, 2)}


def test_stream_index_ranges(spark):
    index = "index array<struct<first: long, count: long>>"
    rows = [(1, [(5, 2), (100, 1)], bytes([1, 7, 1, 8, 0, 9])), (2, [(5, 9)], bytes([1, 7, 1])), (3, [(0, 0), (4, 1)], bytes([2, 3])), (4, [], bytes([1, 1])), (5, [(1, 1)], b"")]
    got = raw.stream_entries(spark.createDataFrame(rows, f"doc_id long, {index}, content binary"), [1, 1, 0]).collect()
    assert sorted((r["doc_id"], r["num"], r["kind"], r["field2"]) for r in got) == [(1, 5, "InUse", 7), (1, 6, "InUse", 8), (1, 100, "Free", 9), (2, 5, "InUse", 7), (3, 4, "Compressed", 3)]


# --- sampled functions and calculators ---


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 12, 16, 24, 32])
def test_samples_of_any_width(spark, bits):
    r = random.Random(bits)
    values = [r.randrange(1 << bits) for _ in range(37)]
    df = spark.range(37).select("id", calculators.sample(F.lit(calculators.packed_samples(values, bits)), F.col("id"), bits).alias("v"))
    assert [x["v"] for x in df.orderBy("id").collect()] == values


def test_three_inputs_two_outputs(spark):
    """On a grid of samples that are linear in each input, interpolation is exact."""
    sizes, top = [3, 2, 4], 255
    grid = [v for k in range(4) for j in range(2) for i in range(3) for v in (i * 20 + j * 50 + k * 30, 200 - i * 20 - k * 10)]
    r = random.Random(1)
    rows = [(r.uniform(-1, 3), r.uniform(0, 1), r.uniform(0, 9)) for _ in range(50)]
    columns = calculators.sampled([F.col(c) for c in "abc"], F.lit(calculators.packed_samples(grid, 8)), sizes, 8, [(0, 2), (0, 1), (0, 9)], [(0, 1), (-1, 1)], decode=[(0, 1), (-1, 1)])
    for row in spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", *[c.alias(n) for c, n in zip(columns, "xy")]).collect():
        a, b, c = min(2, max(0, row["a"])), row["b"], row["c"] / 3
        assert row["x"] == pytest.approx((a * 20 + b * 50 + c * 30) / top) and row["y"] == pytest.approx(-1 + 2 * (200 - a * 20 - c * 10) / top)


def interpreted(words, stack):
    """A plain interpreter of the same words."""
    whole = lambda x: int(x)
    blocks = []
    for w in words:
        if isinstance(w, list):
            blocks.append(w)
        elif w == "if":
            if stack.pop():
                interpreted(blocks[0], stack)
            blocks = []
        elif w == "ifelse":
            interpreted(blocks[0] if stack.pop() else blocks[1], stack)
            blocks = []
        elif w in ("add", "sub", "mul", "gt", "lt", "ge", "le", "eq", "ne"):
            b, a = stack.pop(), stack.pop()
            stack.append({"add": a + b, "sub": a - b, "mul": a * b, "gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b, "eq": a == b, "ne": a != b}[w])
        elif w == "neg":
            stack.append(-stack.pop())
        elif w == "floor":
            stack.append(math.floor(stack.pop()))
        elif w == "not":
            stack.append(not stack.pop())
        elif w == "dup":
            stack.append(stack[-1])
        elif w == "exch":
            stack[-2:] = [stack[-1], stack[-2]]
        elif w == "pop":
            stack.pop()
        elif w == "copy":
            n = whole(stack.pop())
            stack += stack[len(stack) - n :]
        elif w == "index":
            stack.append(stack[-1 - whole(stack.pop())])
        elif w == "roll":
            by, n = whole(stack.pop()), whole(stack.pop())
            held = stack[len(stack) - n :]
            for _ in range(by % n):
                held = [held[-1], *held[:-1]]
            stack[len(stack) - n :] = held
        else:
            stack.append(float(w))
    return stack


def drawn(r, depth, size):
    """A random program, as words, that keeps at least two numbers, and the stack's size after it."""
    words = []
    for _ in range(r.randint(3, 9)):
        kind = r.choice(["number", "two", "one", "dup", "exch", "copy", "index", "roll", "branch"])
        if kind == "number" or size < 3:
            words.append(str(r.randint(-4, 4)))
            size += 1
        elif kind == "two":
            words.append(r.choice(["add", "sub", "mul"]))
            size -= 1
        elif kind == "one":
            words.append(r.choice(["neg", "floor"]))
        elif kind == "dup":
            words.append("dup")
            size += 1
        elif kind == "exch":
            words.append("exch")
        elif kind == "copy":
            n = r.randint(0, 2)
            words += [str(n), "copy"]
            size += n
        elif kind == "index":
            words += [str(r.randint(0, size - 1)), "index"]
            size += 1
        elif kind == "roll":
            words += [str(r.randint(1, size)), str(r.randint(-3, 3)), "roll"]
        elif depth:
            words += ["dup", str(r.randint(-3, 3)), r.choice(["gt", "lt", "ge", "le", "eq", "ne"])] + ["not"] * r.randint(0, 1)
            one, n = drawn(r, depth - 1, size)
            other, m = drawn(r, depth - 1, size)
            words += [one + ["pop"] * max(0, n - m), other + ["pop"] * max(0, m - n), "ifelse"]
            size = min(n, m)
    return words, size


def text_of(words):
    return " ".join("{ " + text_of(w) + " }" if isinstance(w, list) else w for w in words)


def test_random_programs_as_an_interpreter_runs_them(spark):
    r, rows = random.Random(8), [(float(a), float(b)) for a in (-2, 0, 1, 3) for b in (-1, 0, 2)]
    df = spark.createDataFrame(rows, "a double, b double")
    programs = [drawn(r, 2, 2)[0] for _ in range(40)]
    columns = [F.array(*calculators.calculated([F.col("a"), F.col("b")], "{ " + text_of(p) + " }")).alias(f"p{i}") for i, p in enumerate(programs)]
    for row in df.select("a", "b", *columns).collect():
        for i, p in enumerate(programs):
            assert row[f"p{i}"] == pytest.approx(interpreted(p, [row["a"], row["b"]])), text_of(p)


@pytest.mark.parametrize(("program", "error"), [("{ add }", "stackunderflow"), ("{ 3 copy }", "stackunderflow"), ("{ 9 index }", "stackunderflow"), ("{ dup 2 gt add }", "typecheck"), ("{ { 1 } if }", "typecheck"), ("{ true { 1 } if }", "rangecheck"), ("{ what }", "undefined"), ("{ 1", "syntaxerror"), ("{ true { 1 } { 2 } if }", "syntaxerror"), ("{ dup copy }", "typecheck"), ("{ -1 copy }", "rangecheck")])
def test_errors_by_name(spark, program, error):
    with pytest.raises(calculators.CalculatorError, match=error):
        calculators.calculated([F.col("x")], program)


# --- references that wait ---


def test_waiting_state_shrinks(spark, tmp_path):
    from docloom.streaming import streams, waiting

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    base, day = "2024-01-{:02d} 00:00:00", "timestamp"
    refs, targets = str(tmp_path / "refs"), str(tmp_path / "targets")

    def put(path, rows, column):
        spark.createDataFrame(rows, f"key long, {column} long, at string").withColumn("at", F.col("at").cast(day)).coalesce(1).write.mode("append").parquet(path)

    put(refs, [(1, 10, base.format(1)), (2, 20, base.format(1)), (3, 30, base.format(1))], "ref")
    put(targets, [(9, 90, base.format(1))], "target")
    names = []

    def run():
        left = streams.source(spark, refs, f"key long, ref long, at {day}")
        right = streams.source(spark, targets, f"key long, target long, at {day}")
        stream = waiting.resolved(left, right, "1 day", 5 * 86_400_000)
        with waiting.store(spark):
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        names.append([s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]][-1])
        return sorted((r["key"], r["ref"], r["target"], r["state"]) for r in spark.read.schema("key long, ref long, target long, state string").parquet(str(tmp_path / "out")).collect())

    assert run() == []
    put(targets, [(1, 100, base.format(2))], "target")
    assert run() == [(1, 10, 100, "bound")]
    put(refs, [(7, 70, base.format(20))], "ref")
    assert run() == [(1, 10, 100, "bound"), (2, 20, None, "expired"), (3, 30, None, "expired")]
    assert names[-1] < names[0]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_waiting_keys_share_timers(spark, tmp_path):
    """Neither timers nor state grow with the keys: their calls, one by one, are what took the time."""
    from docloom.streaming import streams, waiting

    ids = spark.range(9000).select(F.col("id").alias("key"), F.timestamp_seconds(F.col("id") % 7 * 86_400 + 86_400).alias("at"))
    ids.select("key", F.col("key").alias("ref"), "at").coalesce(1).write.parquet(refs := str(tmp_path / "refs"))
    ids.where("key % 2 = 0").select("key", (F.col("key") + 5).alias("target"), "at").coalesce(1).write.parquet(targets := str(tmp_path / "targets"))
    with waiting.store(spark):
        left, right = streams.source(spark, refs, "key long, ref long, at timestamp"), streams.source(spark, targets, "key long, target long, at timestamp")
        stream = waiting.resolved(left, right, "1 day", 2 * 86_400_000)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    told = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < told[0]["customMetrics"]["numRegisteredTimers"] <= 4096 and told[0]["numRowsTotal"] <= 2 * 4096
    got = {tuple(r) for r in spark.read.schema(waiting.COLUMNS).parquet(str(tmp_path / "out")).collect()}
    assert got == {(k, k, k + 5, "bound") for k in range(0, 9000, 2)} | {(k, k, None, "expired") for k in range(1, 9000, 2) if k % 7 + 1 + 2 <= 7 - 1}


def test_waiting_by_batches(spark, tmp_path):
    """Batches in three buckets, of more rows than come in a frame, against a plain model; references that come late are not lost, and without a target a row only moves the mark."""
    from docloom.streaming import streams, waiting

    day, wait, chance = 86_400_000_000, 5 * 86_400_000_000, random.Random(5)
    refs, targets = str(tmp_path / "refs"), str(tmp_path / "targets")

    def rows(n, keys, batch):
        return [(chance.randrange(keys), chance.randrange(1000), (batch * 3 + 1 + chance.randrange(4)) * day + chance.choice([0, 0, 0, 1, 999, 1500])) for _ in range(n)]

    batches = [(rows(40_000, 300, 0), rows(80, 300, 0)), *((rows(300, 300, b) + rows(20, 300, b - 3), rows(60, 300, b) + [(7, None, (b * 3 + 6) * day)]) for b in range(1, 4))]
    held, found, out, mark = [], {}, [], 0
    for left, right in [*batches, ([], [])]:
        for key, target, at in sorted((r for r in right if r[1] is not None), key=lambda r: (r[2], r[1])):
            found.setdefault(key, (target, at))
        held += left
        out += [(key, ref, found[key][0], "bound") for key, ref, at in held if key in found]
        held = [r for r in held if r[0] not in found]
        over = lambda at, mark=mark: (at + wait) // 1000 <= mark
        out += [(key, ref, None, "expired") for key, ref, at in held if over(at)]
        held, found = [r for r in held if not over(r[2])], {k: x for k, x in found.items() if not over(x[1])}
        mark = max([mark, *(at // 1000 - 86_400_000 for _, _, at in left + right)])
        for path, own, column in ((refs, left, "ref"), (targets, right, "target")):
            if own:
                spark.createDataFrame(own, f"key long, {column} long, us long").select("key", column, F.timestamp_micros("us").alias("at")).coalesce(1).write.mode("append").parquet(path)

    with waiting.store(spark):
        left = streams.source(spark, refs, "key long, ref long, at timestamp", 1)
        stream = waiting.resolved(left, streams.source(spark, targets, "key long, target long, at timestamp", 1), "1 day", wait // 1000, buckets=3)
        got = streams.appended(stream, "by_batches").collect()
    order = lambda r: (r[0], r[1], r[2] or 0, r[3])
    assert sorted((tuple(r) for r in got), key=order) == sorted(out, key=order)
    assert {r[3] for r in out} == {"bound", "expired"} and held


def test_waiting_mark_counts_all_orders(spark, tmp_path):
    """The latest date is that of an order that never comes; columns that can be empty."""
    import datetime

    from docloom import plans

    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    lines, orders = [(1, 10, at(0)), (1, 10, at(3)), (2, 20, at(0)), (2, 21, at(9)), (2, 22, at(10)), (2, None, None)], [(1, "O", at(1)), (2, "P", at(40)), (3, "F", None)]
    for name, rows, schema in (("lineitem", lines, "l_orderkey long, l_partkey long, l_shipdate timestamp_ntz"), ("orders", orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp_ntz")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(r) for r in plans.QUERIES["stream_waiting"](spark, str(tmp_path)).collect()}
    assert got == {(1, 10, 1, "bound", 2), (2, 20, None, "expired", 1), (2, 21, None, "expired", 1)}


def test_stream_waiting_takes_all_files(spark, tmp_path):
    """An order in the last of 2,001 files binds its line, whatever dates the files before it hold."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    from docloom import plans

    at = lambda d: pa.array([datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)], pa.timestamp("us"))
    for name in ("lineitem", "orders"):
        (tmp_path / f"{name}.parquet").mkdir()
    pq.write_table(pa.table({"l_orderkey": [1], "l_partkey": [10], "l_shipdate": at(0)}), tmp_path / "lineitem.parquet/0.parquet")
    for i in range(2001):
        last = i == 2000
        pq.write_table(pa.table({"o_orderkey": [1 if last else i + 5], "o_orderstatus": ["O"], "o_orderdate": at(50 if last else 100)}), where := tmp_path / f"orders.parquet/{i:04}.parquet")
        os.utime(where, (1_700_000_000 + i, 1_700_000_000 + i))
    assert [tuple(r) for r in plans.QUERIES["stream_waiting"](spark, str(tmp_path)).collect()] == [(1, 10, 1, "bound", 1)]
