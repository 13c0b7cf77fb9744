"""Personal data, quality rules, quality classifier and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import classifier, pii, rules, simhash

from llm_texts import TEXTS

# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def ok(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1])))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m[0])]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789.+@-ab ()_%é\n", max_size=80))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_detect(docs, no_docs):
    rows = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    for i, text in enumerate(TEXTS):
        base = plain_spans(text or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in base) for k in PATTERNS]
        assert set(filter(None, rows[i]["spans"].split(","))) >= {f"{k}:{a}:{b}" for a, b, k in base}
    assert pii.detect(no_docs).count() == 0


def test_field_generalises():
    own, right = pii.field(), 0
    held_out = pii.examples(200, seed=77)
    for text, gold in held_out:
        right += {s for a, b in pii.regions(text) for s in own.decode(text, a, b)} == gold
    assert right >= 190


def test_field_adds_what_greedy_patterns_lose():
    text = "call +1 (269) 555-3296 4524132264652876 now"
    assert pii.base_spans(text) == []
    assert [s[2] for s in pii.all_spans(text, [], pii.field())] == ["phone", "card"]
    assert pii.mask(text, pii.field()) == "call [PHONE] [CARD] now"
    for clean in ("In 1999, 12.05.2023 and 3.14159 of 1,234,567", "version 1.2.3 build 20240115", "no data at all"):
        assert pii.mask(clean, pii.field()) == clean


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_decode_is_the_best_of_all_segmentations(seed):
    own, r = pii.field(), random.Random(seed)
    parts = ["+1 555-010-2233", "4111111111111111", "a@b.cd", "10.0.0.1", "(269) 555-3296", "12", "x", "4111.1111.1111.1111", "77@x.y", "1234.ab@c.de", "\n", "-", "3"]
    text = "a " + r.choice(["", " "]).join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 5))) + " b"
    region = pii.Region(text)
    memo = {}

    def best(end, y_after):
        if end == 0:
            return own.w.get(f"->{y_after}", 0.0)
        if (end, y_after) not in memo:
            options = [(end - 1, "-", [])] + region.by_end.get(end, [])
            memo[end, y_after] = max(best(i, y) + sum(own.w.get(f, 0.0) for f in fs) + own.w.get(f"{y}>{y_after}", 0.0) for i, y, fs in options)
        return memo[end, y_after]

    def score(spans):
        e, total, after = len(region.symbols), 0.0, "-"
        ends = {b: (a, k) for a, b, k in spans}
        while e > 0:
            b = region.symbols[e - 1][1]
            hit = next(((i, y, f) for i, y, f in region.by_end.get(e, []) if b in ends and ends[b] == (region.symbols[i][0], y)), (e - 1, "-", []))
            total += sum(own.w.get(f, 0.0) for f in hit[2]) + own.w.get(f"{hit[1]}>{after}", 0.0)
            after, e = hit[1], hit[0]
        return total + own.w.get(f"->{after}", 0.0)

    assert score(own.decode(text)) == pytest.approx(best(len(region.symbols), "-"))


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([" 12 ab", "1 ", "555-3296 (269) ", "word ", "@", "a.b", "+1 (2", "4111 1111 1111 1111, "]), st.integers(0, 3000))
def test_what_stands_before_changes_no_later_span(filler, times):
    own, tail = pii.field(), "call 555-123 4567, a@b.cd or +1 (269) 555-3296 4524132264652876 now"
    wanted = {(a, b, k) for a, b, k in pii.all_spans(tail, pii.base_spans(tail), own)}
    text = filler * times + "\n\n"
    found = pii.all_spans(text + tail, pii.base_spans(text + tail), own)
    assert {(a - len(text), b - len(text), k) for a, b, k in found if a >= len(text)} == wanted
    near = filler * (times % 4) + "\n\n"  # no cut lies between spans, however long what stands before them is
    again = [(a - len(near), b - len(near), k) for a, b, k in pii.all_spans(near + tail, pii.base_spans(near + tail), own) if a >= len(near)]
    assert set(again) == wanted


def test_spans_next_to_long_stretches():
    own = pii.field()
    for times in (0, 10, 660, 682, 719, 3000):
        text = " 12 ab" * times + " 555-123 4567"
        assert any(text[a:b] == "555-123 4567" for a, b, _ in pii.all_spans(text, pii.base_spans(text), own))
    many = "(269) 555-3296 " * 5000
    assert len(pii.all_spans(many, pii.base_spans(many), own)) == 5000


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1 " * 200_000, "12-34 5" * 20_000, "(1" * 50_000, "+1" + "(" * 100_000, "@" * 100_000):
        pii.all_spans(text, pii.base_spans(text), pii.field())


# --- quality rules ---


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(windows) < 3000 else set()
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(docs, no_docs):
    rows = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    for i, text in enumerate(TEXTS):
        n, chars, symbols, lines, repeats = plain_counts(text)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (r["kept"] and r["base_failed"]) and (r["distance"] is None) == r["base_failed"]
    assert rules.judge(docs).count() == docs.count() and rules.judge(no_docs).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=20))
def test_rule_counts_of_any_text(spark, texts):
    rows = rules.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(texts[r["doc_id"]])


def test_outliers_go_and_others_stay(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(40, 300))), "en", f"s{i % 2}") for i in range(300)]
    odd = [(1000 + i, " ".join(w + "%%%" for w in rng.choice(vocabulary, 150)), "en", f"s{i % 2}") for i in range(20)]
    odd += [(2000 + i, " ".join(rng.choice(vocabulary[:12], 150)), "en", "s0") for i in range(10)]
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(not kept[i] for i in range(300)) <= 1
    assert not any(kept[i] for i in kept if i >= 1000)


def test_distances_are_mahalanobis(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    cov, mean = np.cov(x.T, bias=True), x.mean(axis=0)
    moments = [("p", *map(float, mean), *(float(cov[i, j]) for i in range(5) for j in range(i, 5)))]
    names = ["pool", *(f"m{i}" for i in range(5)), *(f"c{i}{j}" for i in range(5) for j in range(i, 5))]
    factored = rules._factored(spark.createDataFrame(moments, names))
    rows = spark.createDataFrame([(i, "p", i % rules.SALTS, *map(float, v)) for i, v in enumerate(x)], ["k", "pool", "salt", *rules.V])
    got = {r["k"]: r["d2"] for r in rules._distances(rows, factored).collect()}
    inverse = np.linalg.inv(cov + np.diag([f**2 for f in rules.FLOORS.values()]))
    for i, v in enumerate(x):
        assert got[i] == pytest.approx((v - mean) @ inverse @ (v - mean))


def plain_core(x, centre, cov, steps=60):
    """Concentration steps in NumPy from one start, to a fixed core."""
    floor, h = np.diag([f**2 for f in rules.FLOORS.values()]), int(np.ceil(rules.CORE * len(x)))
    last = None
    for _ in range(steps):
        d = x - centre
        near = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d), kind="stable")[:h]
        centre, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) + floor
        if last is not None and set(near) == last:
            break
        last = set(near)
    return np.linalg.slogdet(cov)[1], centre


def test_estimates_reach_the_least_determinant_of_many_starts(spark):
    rng = np.random.default_rng(8)
    clouds = {}
    for k, (n, wrong) in enumerate([(120, 0), (160, 30), (200, 45), (90, 20)]):
        x = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5))
        x[:wrong] = x[:wrong] * 0.2 + 8 + 2 * k  # a tight cloud of outliers that would pull a plain mean
        clouds[f"p{k}"] = x
    rows = [(p, i % rules.SALTS, *map(float, v)) for p, x in clouds.items() for i, v in enumerate(x)]
    found = {r["pool"]: r for r in rules.estimates(spark.createDataFrame(rows, ["pool", "salt", *rules.V])).collect()}
    assert set(found) == set(clouds)
    for p, x in clouds.items():
        starts = [rng.choice(len(x), 8, replace=False) for _ in range(100)]
        best = min((plain_core(x, x[s].mean(axis=0), np.cov(x[s].T) + 0.1 * np.eye(5)) for s in starts), key=lambda b: b[0])
        assert found[p]["logdet"] <= best[0] + 0.05
        assert [found[p][f"m{i}"] for i in range(5)] == pytest.approx(best[1].tolist(), abs=0.5)


def test_small_and_null_groups_are_judged_by_what_holds_them(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(2000)]
    text = lambda: " ".join(rng.choice(words, rng.integers(60, 200)))
    odd = " ".join(w + "%%%" for w in words[:150])
    rows = [(i, text(), "en", None) for i in range(100)]  # a large group without a source
    rows += [(1000 + i, text() if i else odd, "en", "rare") for i in range(4)] + [(2000, odd, "xx", "alone"), (2001, text(), "yy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = {r["name"]: r for r in rules.pools(rules.vectors(rules.statistics(docs))).collect()}
    assert names['name:{"lang":"en","source":null}']["pool"] == 'source:{"lang":"en","source":null}'
    assert names['name:{"lang":"en","source":"rare"}']["pool"] == 'language:{"lang":"en"}' and names['name:{"lang":"xx","source":"alone"}']["pool"] == "all"
    assert set(names['name:{"lang":"en","source":null}']["feeds"]) == {'source:{"lang":"en","source":null}', 'language:{"lang":"en"}', "all"}
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs).collect()}
    assert not kept[1000] and not kept[2000] and all(kept[i] for i in (1001, 1002, 1003, 2001)) and all(kept[i] for i in range(100))


def test_each_row_meets_its_own_verdict(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, "en", "s"), (1, "too short", "en", "s"), (None, good, None, None), (None, "no", None, None)], "doc_id long, text string, lang string, source string")
    assert {(r["doc_id"], r["text"]) for r in rules.kept_rows(docs).collect()} == {(1, good), (None, good)}


# --- quality classifier ---


def test_the_fit_is_the_ridge_of_a_plain_solve(spark):
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma!", "12", "delta."], int(rng.integers(5, 60)))), int(rng.integers(0, 2))) for i in range(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string").repartition(5)
    model = classifier.fit(d, spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int"))
    rows = classifier.sample(d, spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int"), 1000).collect()
    x, y = np.array([classifier.statistics(r["text"]) for r in rows]), np.array([r["y"] for r in rows])
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(np.maximum(x.std(axis=0), 1e-6))
    learnt = np.array([r["fold"] != classifier.FOLDS - 1 for r in rows])
    z = model.waves(x[learnt])
    plain = np.linalg.solve(z.T @ z + classifier.RIDGE * len(x) * np.eye(z.shape[1]) / (z.shape[1] - 1), z.T @ y[learnt])
    assert model.weights == pytest.approx(plain, abs=1e-6)
    knots, values = classifier.isotonic(model.waves(x[~learnt]) @ plain, y[~learnt])
    assert np.allclose(model.steps[0], knots, atol=1e-6) and np.allclose(model.steps[1], values)


def test_the_sample_is_bounded_by_rows_and_not_thinned_by_repeats(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    repeated = labels.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("k")
    assert classifier.sample(ids, repeated, 500).count() == classifier.sample(ids, labels, 500).count() == 500
    many = ids.where("doc_id < 50").withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: k.cast("string"))))
    few = classifier.sample(many, labels, 500)
    assert few.count() <= 50




def test_classifier(spark, docs, no_docs):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "green", "house"]
    texts = []
    for i in range(600):
        good = " ".join(rng.choice(words, 60)) + "."
        texts.append((i, good if i % 3 else good.upper().replace(" ", "!! "), i % 3 != 0))
    d = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(q), None) for i, _, q in texts] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(d, labels)
    rows = classifier.score(d, model).collect()
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in classifier.score(d, classifier.fit(d, flipped)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)  # held-out labels are never learnt from
    assert classifier.score(docs, model).count() == docs.count() and classifier.score(no_docs, model).count() == 0
    assert classifier.keep(docs, model).columns == docs.columns
    none = classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in classifier.score(docs, none).collect()} == {0.5}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=40))
def test_isotonic_rises(points):
    x, y = (np.array(v, float) for v in zip(*points))
    knots, values = classifier.isotonic(x, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(values) > 0).all()
    assert (np.interp(x, knots, values)).mean() <= 1


# --- SimHash ---


def plain_fingerprint(text):
    words = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints):
    group = {i: i for i in prints}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i: top(i) for i in prints}


def test_simhash(docs, no_docs):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}
    groups = components_of(prints)
    for i in prints:
        assert rows[i]["fingerprint"] == f"{prints[i]:016x}" and rows[i]["component_id"] == groups[i]
    assert rows[4]["component_id"] == rows[5]["component_id"] == rows[3]["component_id"] == 3
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(no_docs).count() == 0


def test_links_and_chains(spark):
    rng = np.random.default_rng(9)
    prints, now = {}, int(rng.integers(1 << 62))
    for i in range(40):  # a chain of two flipped bits at each step, then strangers
        prints[100 - i] = now
        now ^= sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
    prints |= {200 + i: int(rng.integers(1 << 62)) for i in range(30)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    vertices = spark.createDataFrame([(signed(v),) for v in set(prints.values())], "fp long")
    links = {(r["a"], r["b"]) for r in simhash.links(vertices).collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
    found = {r["v"]: r["root"] for r in simhash.components(spark.createDataFrame(list(links), "a long, b long")).collect()}
    expected = components_of(prints)
    by = {}
    for i, v in prints.items():
        by.setdefault(expected[i], set()).add(found.get(signed(v), signed(v)))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


@pytest.mark.parametrize("radius", [1, 3])
def test_links_of_other_radii(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int(rng.integers(1 << 62)) for _ in range(5)]
    prints = sorted({b ^ sum(1 << int(k) for k in rng.choice(62, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(12)})
    links = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius).collect()}
    pairs = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius}
    assert links == pairs


def test_rules_are_native(docs):
    plan = rules.judge(docs)._jdf.queryExecution().executedPlan().toString() + rules.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
