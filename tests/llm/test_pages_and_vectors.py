"""Archives, main texts and nearest neighbours: round trips, damage, crafted pages, brute force."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import main_text, neighbours, warc

HTML = ["<p>one</p>", "<p>one</p>", "", None, "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "x" * 300_000, "<p>one</p>", "tail\r\n\r\n"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a.example/{i}\r\nX: y", h, "clash") for i, h in enumerate(HTML)] + [(7, None, HTML[7], None), (None, None, "<p>one</p>", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3, "page_id")


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_round_trip(spark, pages):
    rows = warc.round_trip(pages).collect()
    assert len(rows) == pages.count()
    last = {}
    for i, h in enumerate(HTML):
        last[h or ""] = i
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    for i, h in enumerate(HTML):
        for r in by[i]:
            data = (h or "").encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), digest(data))
            assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
    assert len(by[7]) == 2 and (by[None][0]["record_type"], by[None][0]["refers_to"]) == ("revisit", 6)
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.round_trip(pages, least_bytes=10**6).collect()} == {"response"}


def test_pages_of_very_long_urls_come_back(spark, monkeypatch):
    page = spark.createDataFrame([(1, "data:," + "x" * 70_000, "<p>a"), (2, "u", "<p>b"), (3, "v", "<p>a")], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in warc.round_trip(page).collect()} == {1: 3, 2: None, 3: None}
    monkeypatch.setattr(warc, "VERSION", "WARC/9.9")  # records that the reader does not take
    with pytest.raises(Exception, match="not read back"):
        warc.round_trip(page).collect()


def test_files_hold_whole_records(spark, pages, tmp_path):
    warc.write(pages, f"{tmp_path}/w", records_per_file=2)
    rows = warc.read(spark, f"{tmp_path}/w", payloads=True).collect()
    assert all(r["record_type"] for r in rows)
    assert {bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"} == {h or "" for h in HTML}


def record(body, kind="resource", extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{len(body)}>\r\nWARC-Payload-Digest: sha1:{digest(body)}\r\n{extra}Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def pieces(data):
    return [x if isinstance(x, tuple) else x.payload for x in warc.salvage(data)]


def test_salvage_of_plain_and_compressed_files():
    a, b, c = record(b"first"), record(b"second one"), record(b"third")
    assert pieces(a + b + c) == [b"first", b"second one", b"third"]
    zipped = b"".join(map(gzip.compress, (a, b, c)))
    assert pieces(zipped) == [b"first", b"second one", b"third"]
    assert pieces(gzip.compress(a + b) + c) == [b"first", b"second one", b"third"]
    broken = a + b.replace(b"second", b"sEcond") + c  # the digest no longer fits
    assert pieces(broken) == [b"first", (len(a), len(a + b)), b"third"]
    cut = a + b[: len(b) // 2] + c
    assert pieces(cut) == [b"first", (len(a), len(a) + len(b) // 2), b"third"]
    z = [gzip.compress(x) for x in (a, b, c)]
    hurt = z[0] + z[1][:60] + bytes([z[1][60] ^ 255]) + z[1][61:] + z[2]
    assert pieces(hurt) == [b"first", (len(z[0]), len(z[0] + z[1])), b"third"]
    assert pieces(b"noise" + a + b"noise") == [(0, 5), b"first", (5 + len(a), 10 + len(a))]
    assert pieces(b"") == [] and pieces(b"only noise") == [(0, 10)]
    wrong = a + b.replace(b"Content-Length: 10", b"Content-Length: 99") + c
    assert pieces(wrong) == [b"first", (len(a), len(a + b)), b"third"]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_salvage_never_loses_what_is_whole(seed):
    r = random.Random(seed)
    records = [record(r.randbytes(r.randint(0, 200)).replace(b"WARC/1.", b"")) for _ in range(6)]
    if r.random() < 0.5:
        records = [gzip.compress(x) for x in records]
    hurt = r.randrange(6)
    at = r.randrange(len(records[hurt]))
    data = [*records]
    data[hurt] = data[hurt][:at] + data[hurt][at + r.randint(1, 9) :]
    whole = b"".join(data)
    found = list(warc.salvage(whole))
    ends = sorted((x if isinstance(x, tuple) else (x.start, x.end)) for x in found)
    assert ends[0][0] == 0 and ends[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))  # every byte is accounted for
    kept = [x.payload for x in found if not isinstance(x, tuple)]
    clean = [p for i, x in enumerate(records) if i != hurt for p in pieces(x)]
    assert [p for p in kept if p in clean] == clean or len(kept) >= 5


def test_long_archives_take_linear_time(spark, tmp_path):
    import time

    r = random.Random(1)
    members = [gzip.compress(record(r.randbytes(20_000).replace(b"WARC/1.", b"")), 1) for _ in range(2000)]
    began = time.thread_time()
    found = list(warc.salvage(b"".join(members)))
    assert len(found) == 2000 and not any(isinstance(x, tuple) for x in found) and time.thread_time() - began < 8
    large = spark.createDataFrame([(i, "x" * (5_000_000 + i // 2) if i < 6 else "small") for i in range(40)], "page_id long, html string")
    warc.write(large, f"{tmp_path}/w", file_bytes=8 << 20, records_per_file=2000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    assert max(sizes) < 8 << 20 and warc.read(spark, f"{tmp_path}/w").where("record_type is not null").count() == 40


def test_members_that_grow_without_bound_are_quarantined(monkeypatch):
    monkeypatch.setattr(warc, "MOST_MEMBER", 1 << 20)
    a, bomb = gzip.compress(record(b"first")), gzip.compress(record(bytes(3 << 20)))
    found = list(warc.salvage(a + bomb + a))
    assert [x if isinstance(x, tuple) else x.payload for x in found] == [b"first", (len(a), len(a + bomb)), b"first"]


def test_gaps_are_kept_in_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(record(b"one") + b"junk" + record(b"two!"))
    whole = warc.quarantine(warc.read(spark, f"{tmp_path}/in"), f"{tmp_path}/gaps")
    assert whole.count() == 2 and [r["end"] - r["start"] for r in spark.read.parquet(f"{tmp_path}/gaps").collect()] == [4]


def test_gaps_are_logged(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"one") + b"junk" + record(b"two!"))
    rows = sorted(warc.read(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    assert [(r["record_type"], r["page_id"]) for r in rows] == [("resource", 3), (None, None), ("resource", 4)]
    assert rows[1]["end"] - rows[1]["start"] == 4


# --- main text ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body class="home page"><header><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to please you</div>
<aside>Words at the side</aside>%s<h1>Title&nbsp;&amp; more</h1><p>Hello <b>bo</b>ld
   world.</p><div class="ad-banner">Buy now</div><script>var a="<p>x</p>";</script><p>Line<br>break <!-- <p>no</p> --> here</p><form><label>Your name</label></form>
<section id="comments"><h2>Comments</h2><p>A reader's long remark about this and that.</p></section>%s<footer>&copy; all of us</footer></body></html>"""
WANTED = "Title & more Hello bold world. Line break here"
DEFAULT = main_text.DEFAULTS


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>"), ("<ARTICLE CLASS='post'>", ""), ("", "")])
def test_crafted_page(around):
    assert main_text.extract(PAGE % around, DEFAULT) == WANTED


def test_odd_pages():
    for page, text in [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a", "a"), ("<p", ""), ("a < b", "a < b"), ("<!-- x", ""), ("<nav>menu</nav>", ""), ("<p>&lt;b&gt; &#233; &am", "<b> é &am"), ("<script>x", ""), ("<p>x</p><script>y</script><p>z</p>", "x z")]:
        assert main_text.extract(page, DEFAULT) == text
    for page, text in [("<ul><li class=ad>x<li>y</ul><p>z", "y z"), ("<ul><li class=ad>x <div>q</div> r</ul><p>z", "z"), ("<p class=notice>x<div>y</div>", "y"), ("<table><tr><td class=ad>x<td>y</table>z", "y z"), ("<div class=ad><div>x</div>y</div>z", "z"), ("<p hidden>x</p><p>y", "y")]:
        assert main_text.extract(page, DEFAULT) == text
    long = "<article>" + "<p>word</p>" * 50_000 + "<a '" * 1000
    assert len(main_text.extract(long, DEFAULT)) == 50_000 * 5 - 1


def test_region_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.choice([-3.0, -1.0, -0.01, 0.0, 0.5, 2.0]) for _ in range(rng.randint(0, 14))]
        best = max([sum(values[a:b]) for a in range(len(values)) for b in range(a, len(values) + 1)], default=0.0)
        a, b = main_text.region(values)
        assert sum(values[a:b]) == pytest.approx(max(0.0, best))


def test_names_of_articles_and_of_what_holds_them_say_nothing():
    text = "A story of some length that goes on for a while. It has two sentences."
    for around in ('<main class="has-sidebar">%s</main>', '<main class="content no-sidebar">%s</main>', '<article class="post has-related comments">%s</article>', '<div class="with-sidebar">%s</div>', '<div class="sidebar"><main>%s</main></div>'):
        assert main_text.extract(around % f"<p>{text}</p>", DEFAULT) == text
    for weak in ('<section id="discussion"><p>%s</p></section>', '<div class="related-work"><p>%s</p></div>'):
        assert main_text.extract(f"<article><p>{text}</p>{weak % text}<p>{text}</p></article>", DEFAULT) == f"{text} {text} {text}"
    assert main_text.extract(f'<article><p>{text}</p><p class="ad">Buy</p><form>Name</form><p>{text}</p></article>', DEFAULT) == f"{text} {text}"
    assert main_text.extract(f'<article><p>{text}</p><p>see <span hidden>not this</span><a href="/x">that</a></p></article>', DEFAULT) == f"{text} see that"


def test_learning_and_rows(spark):
    rows = [(i, None, PAGE % ("<article>", "</article>")) for i in range(30)] + [(99, "u", None), (None, None, "<p>no id</p>"), (1, None, PAGE % ("", ""))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    weights = main_text.learn(pages)
    assert all(v < 0 for k, v in weights.items() if k[0] == "<") and weights["<p"] > weights["<nav"] and set(main_text.NAMES) <= set(weights)
    got = main_text.main_texts(pages).collect()
    assert len(got) == len(rows) and all(r["text"] == WANTED for r in got if r["page_id"] not in (99, None)) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert main_text.main_texts(pages.drop("url")).where("url is null").count() == len(rows)
    assert main_text.main_texts(pages.limit(0)).count() == 0
    assert main_text.learn(pages.limit(0)) == DEFAULT


def test_the_scan_alone_finds_articles_without_marks(spark, monkeypatch):
    """Pages whose boilerplate is plain ``div`` and ``p`` elements without names, after learning from pages that mark their article."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(500)]
    some = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))

    def page(marked):
        body = [some(20, 90) + "." for _ in range(r.randint(2, 7))]
        title = some(3, 8)
        menu = "".join(f'<li><a href="/{k}">{some(1, 2)}</a></li>' for k in range(6))
        links = " ".join(f'<a href="/{k}">{some(1, 3)}</a>' for k in range(5))
        before = f"<div><ul>{menu}</ul></div><div>{some(3, 9)}.</div><div><p>{some(2, 6)}</p></div>"
        after = f"<div><p>{links}</p></div><div>{some(8, 18)}.</div><div><p>{some(2, 5)}</p></div>"
        name = "article" if marked else "div"
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in body)
        return f"<html><head><title>{title}</title></head><body>{before}<{name}>{inner}</{name}>{after}</body></html>", " ".join([title, *body])

    known = main_text.learn(spark.createDataFrame([(i, page(True)[0]) for i in range(200)], "page_id long, html string"))

    def f1(got, wanted):
        got, wanted = got.split(), wanted.split()
        both = sum((Counter(got) & Counter(wanted)).values())
        return 2 * both / (len(got) + len(wanted))

    plain = [page(False) for _ in range(100)]
    scanned = np.mean([f1(main_text.extract(h, known), w) for h, w in plain])
    monkeypatch.setattr(main_text, "region", lambda values: (0, len(values)))
    whole = np.mean([f1(main_text.extract(h, known), w) for h, w in plain])
    assert scanned >= 0.98 and whole < scanned - 0.05


# --- nearest neighbours ---


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 6000)] + 0.3 * rng.normal(size=(6000, 16))).astype(np.float32)
    x[3000:3400] = 3 * x[3000]  # many copies of one long vector
    bad = [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16), (-4, [float("inf")] + [1.0] * 15), (-5, [1.0] * 15), (-6, [None] + [1.0] * 15), (None, [1.0] * 16)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, cell string").repartition(5)
    found = {}
    for r in neighbours.search(df).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 6000, 20))
    d, hits = x.astype(float), 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        scores = (d * d[q]).sum(axis=1)
        scores[q] = -np.inf
        assert all(abs(scores[v] - s) < 1e-9 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        order = np.lexsort((np.arange(6000), -scores))[:20]
        hits += len(set(order) & {g[1] for g in got})
    assert hits / (20 * len(found)) >= 0.9
    near_copies = [v for _, v, _ in found[3100]]
    assert near_copies == list(range(3000, 3020))  # copies tie, and ties go to the smaller id


def test_clustered_queries_meet_few_rows_and_exact_search_meets_all(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    near = centres[rng.integers(0, 40, 9000)] + 0.1 * rng.normal(size=(9000, 16))
    x = np.vstack([near, rng.normal(size=(3000, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    truth = {}
    for q in range(0, 12000, 20):
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        truth[q] = np.lexsort((np.arange(len(x)), -scores))[:20].tolist()

    def recall_of(rows):
        got = {}
        for r in rows:
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        hits = {q: len({v for _, v in got[q]} & set(truth[q])) / 20 for q in truth}
        return np.mean([h for q, h in hits.items() if q < 9000]), np.mean([h for q, h in hits.items() if q >= 9000])

    assert min(recall_of(neighbours.search(df).collect())) >= 0.9
    assert recall_of(neighbours.search(df, recall=1).collect()) == (1.0, 1.0)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df).collect())
    assert got == [(0, 1, 20, 4.0), (0, 2, 3, 3.0), (20, 1, 0, 4.0), (20, 2, 3, 3.0)]
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id = 3")).count() == 0


def test_cells_come_in_order():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.normal(size=7), rng.normal(size=7)
        rows = rng.integers(0, 4, 49)
        cells = neighbours.visited(a, b, rows, int(rows.sum()))
        assert sorted(cells) == np.flatnonzero(rows).tolist()
        sums = [a[c // 7] + b[c % 7] for c in cells]
        assert all(p >= q - 1e-12 for p, q in zip(sums, sums[1:]))
