"""Like texts that are no copies, damaged archives, named paragraphs and clashing columns."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import storage
from docloom.llm import main_text, rules, simhash, warc


def brute_links(sets, least=0.8):
    found = set()
    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                found.add((a, b))
    return found


def classes(vertices, links):
    top = {v: v for v in vertices}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in links:
        top[find(a)] = find(b)
    groups = {}
    for v in vertices:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def families(seed):
    """Sets of shingles with common parts of several sizes, own parts, and copies that differ a little."""
    r, sets, fresh = random.Random(seed), {}, iter(range(10**6, 10**9))
    for family in range(4):
        common = [next(fresh) for _ in range(r.choice([20, 60, 100]))]
        for _ in range(r.choice([6, 25])):
            own = set(r.sample(common, r.randint(len(common) * 3 // 4, len(common)))) if family % 2 else set(common)
            sets[len(sets)] = own | {next(fresh) for _ in range(r.choice([0, 2, 5, 12, 30, 60]))}
            if r.random() < 0.4:
                sets[len(sets)] = {x if r.random() > 0.05 else next(fresh) for x in sets[len(sets) - 1]}
    return sets


@pytest.mark.parametrize("rare", [1, 2, 4, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_exact_candidates_connect_what_all_pairs_do(spark, seed, rare):
    sets = families(seed)
    rows = [(v, len(s), x) for v, s in sets.items() for x in s]
    members = spark.createDataFrame([(v, v) for v in sets], "vertex long, root long")
    sure, pairs = simhash.exact_candidates(members, spark.createDataFrame(rows, "vertex long, n long, s long"), rare=rare)
    want = brute_links(sets)
    sure, pairs = ({(r["a"], r["b"]) for r in df.collect()} for df in (sure, pairs))
    assert sure <= want
    assert classes(sets, sure | pairs & want) == classes(sets, want)


def like_texts(n):
    """Texts of 100 common words and 30 words of their own, no two of which are copies."""
    r = random.Random(n)
    common = [f"w{i}" for i in range(100)]
    return [(i, " ".join(common[:50] + [f"o{r.randrange(10**9)}" for _ in range(30)] + common[50:])) for i in range(n)]


def test_like_texts_make_no_pairs(spark):
    made = []
    for n in (300, 600):
        rows = [(i, simhash.shingle_set(simhash.words_of(t)).view(np.int64).tolist()) for i, t in like_texts(n)]
        sets = spark.createDataFrame([(i, len(s), x) for i, s in rows for x in s], "vertex long, n long, s long")
        sure, pairs = simhash.exact_candidates(spark.createDataFrame([(i, i) for i, _ in rows], "vertex long, root long"), sets)
        made.append(sure.count() + pairs.count())
    assert made == [0, 0]


def changed_texts(n, base=True, dropped=False):
    """Texts of 150 words, of which each changes up to four; with the text itself, or texts that lack a word."""
    r = random.Random(n)
    words = [f"w{i}" for i in range(150)]
    rows = [list(words)] if base else []
    while len(rows) < n:
        own = list(words)
        for i in r.sample(range(150), r.randint(1, 4)):
            own[i] = f"o{r.randrange(10**9)}"
        if dropped and r.random() < 0.2:
            del own[r.randrange(150)]
        rows.append(own)
    return [(i, simhash.shingle_set(simhash.words_of(" ".join(x))).view(np.int64).tolist()) for i, x in enumerate(rows)]


def candidates(spark, rows):
    sets = spark.createDataFrame([(i, len(s), x) for i, s in rows for x in s], "vertex long, n long, s long")
    found = simhash.exact_candidates(spark.createDataFrame([(i, i) for i, _ in rows], "vertex long, root long"), sets)
    return [{(r["a"], r["b"]) for r in df.collect()} for df in found]


def test_changed_copies_of_one_text_make_no_pairs(spark):
    for n in (150, 300):
        rows = changed_texts(n)
        sure, pairs = candidates(spark, rows)
        sets = {i: set(s) for i, s in rows}
        want = brute_links(sets)
        assert len(want) > 10 * n and sure <= want and classes(sets, sure | pairs & want) == classes(sets, want)
        assert len(sure) <= 2 * n and len(pairs) <= n


@pytest.mark.parametrize(("base", "dropped"), [(False, False), (True, True), (False, True)])
def test_changed_copies_without_their_text_or_a_word(spark, base, dropped):
    rows = changed_texts(120, base, dropped)
    sure, pairs = candidates(spark, rows)
    sets = {i: set(s) for i, s in rows}
    want = brute_links(sets)
    assert sure <= want and classes(sets, sure | pairs & want) == classes(sets, want)


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in manager.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}


def test_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = storage.table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # they go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_like_texts_are_kept(spark):
    rows = like_texts(400)
    copies = [(1000, rows[7][1].replace("o", "O")), (1001, rows[9][1] + " end"), (1002, rows[9][1])]
    kept = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows + copies, "doc_id long, text string")).collect()}
    assert kept == set(range(400))


def test_every_pair_can_be_verified(spark):
    rows = like_texts(30) + [(100, like_texts(30)[3][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.first_of_each(docs, most_bits=None).count() == simhash.first_of_each(docs).count() == 30


def test_columns_may_have_the_names_in_use(spark):
    names = ["row", "vertex", "prints", "given", "key", "size_class", "pool", "salt", "n_words"]
    text = "a good long text of more than ten different words that nobody would throw away for any reason at all"
    rows = [(i, text if i < 2 else f"{text} {i} {i * i} and {i * 7} others", "en", "web") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for out in (simhash.first_of_each(docs), rules.kept_rows(docs)):
        assert out.columns == docs.columns
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names)
    assert simhash.first_of_each(docs).count() < 5 and rules.kept_rows(docs.drop("lang", "source")).count() == 5


@pytest.mark.parametrize("junk", [b"WARC/1.x junk ", b"\x1f\x8b\x08 junk", b"WARC/1.1\r\njunk\r\n"])
def test_false_marks_cost_their_own_bytes(junk):
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    data = record + junk * (20_000_000 // len(junk)) + record
    began = time.perf_counter()
    found = list(warc.salvage(data))
    assert time.perf_counter() - began < 60  # before, hours
    assert [x if isinstance(x, tuple) else x.payload for x in found] == [b"ok", (len(record), len(data) - len(record)), b"ok"]


def test_members_beyond_a_bound_are_gaps():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5000\r\n\r\n" + b"x" * 5000 + b"\r\n\r\n"
    data = gzip.compress(record)
    assert not isinstance(next(iter(warc.salvage(data))), tuple) and list(warc.salvage(data, most_member=100)) == [(0, len(data))]


@pytest.mark.parametrize("name", ["hidden-gem", "share-price", "menu-items", "comment-free", "ad_hoc"])
def test_named_paragraphs_stay_in_articles(name):
    words = "This paragraph is a part of the article, and it has enough words to be one, as any reader would say."
    page = f"<html><body><nav class='menu'><a href='/'>Home</a></nav><main><p>{words}</p><p class='{name}'>{words} It is named.</p><div class='ad-box'>Buy this</div><p>{words}</p></main><footer>Imprint</footer></body></html>"
    assert main_text.extract(page, main_text.DEFAULTS) == f"{words} {words} It is named. {words}"


def test_neighbours_meet_a_part_of_clustered_rows(spark):
    from docloom.llm import neighbours

    r = np.random.default_rng(0)
    centres = r.normal(size=(60, 32))
    x = np.concatenate([centres[r.integers(0, 60, 8000)] + 0.15 * r.normal(size=(8000, 32)), r.normal(size=(4000, 32))])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    found, met = neighbours.search_and_count(rows, every=100)
    got = {}
    for f in found.collect():
        got.setdefault(f["query_id"], set()).add(f["vec_id"])
    right = 0
    for q, near in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        right += len(near & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert right / (20 * len(got)) >= 0.9 and len(got) == 120
    assert met.agg(F.avg("met")).first()[0] < len(x) / 3


@pytest.mark.parametrize("n", [29, 30, 31])
def test_groups_of_a_least_size_have_an_estimate_of_their_own(spark, n):
    rows = [("en", "web", 0.0)] * n + [("en", "news", 0.0)] * 40 + [("de", "web", 0.0)] * 5
    df = spark.createDataFrame(rows, "lang string, source string, v0 double")
    found = {r["name"]: (r["pool"], r["feeds"]) for r in rules.pools(df, 30).collect()}
    own = next(v for k, v in found.items() if '"en"' in k and '"web"' in k)
    small = next(v for k, v in found.items() if '"de"' in k)
    assert own[0].startswith("source:" if n >= 30 else "language:") and small[0] == "all" and "all" in own[1]
    assert next(v for k, v in found.items() if '"news"' in k)[0].startswith("source:")
    assert all(p[0] == "all" for p in ((r["pool"], r["feeds"]) for r in rules.pools(df, 1000).collect()))


def test_near_copies_keep_texts_once_and_keys_by_turns(spark, monkeypatch, tmp_path):
    """The most that tables and the shuffles of the next one take together, against the input."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(5000)]
    texts = [" ".join(r.choices(vocabulary, k=300)) for _ in range(800)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"{t} end") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    size = lambda folder: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    known, written, table, most = set(storage._written), [], storage.table, {}

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def watched(df, name):
        held, before = sum(size(w.removeprefix("file:")) for s, w in storage._written if (s, w) not in known), shuffled()
        out = table(df, name)
        most[name] = max(most.get(name, 0), held + shuffled() - before)
        return out

    monkeypatch.setattr(storage, "table", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        assert simhash.first_of_each(spark.read.parquet(str(tmp_path / "docs"))).count() == 800
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    given = size(tmp_path / "docs")
    assert max(most.values()) < 3.2 * given and most["met"] < 2.2 * given
