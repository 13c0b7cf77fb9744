"""The corpus pipeline stage by stage, and the entry point's guard."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from docloom.llm import pii, queries, simhash

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "personal data", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).cache()
        assert after.columns == columns
        kept[name] = (before.count(), after.count())
        before = after
    assert all(b > 0 for _, b in kept.values()) and kept["quality rules"][0] > kept["quality rules"][1] and kept["near duplicates"][0] > kept["near duplicates"][1]
    groups = simhash.near_duplicates(before)
    texts = [r["text"] for r in before.collect()]
    assert all(not pii.base_spans(t) for t in texts)
    assert before.where(F.length("text") != F.col("n_chars")).isEmpty()
    assert groups.count() == len(texts)
    pieces = corpus_pipeline.packed(spark, before, FOLDER)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in before.collect()}
    clean = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    first = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    lost = docs.join(clean, "doc_id", "left_semi").join(first, "doc_id", "left_anti").where(F.size(F.split("text", "\\s+")) >= 12).count()
    assert lost <= 0.05 * clean.count()


def test_near_duplicates_with_odd_rows(spark):
    rows = [(2, "a b c d e f", None, None, 1), (1, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (3, None, "x", "y", None), (4, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, None}


def test_near_copies_of_five_word_similarity_go(spark):
    words = [f"w{i}" for i in range(200)]
    near = [w if i not in (40, 80, 120, 160) else "changed" for i, w in enumerate(words)]  # Jaccard 176 / 216
    far = [w if i % 20 else "other" for i, w in enumerate(words)]  # under 0.8
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([words, near, far], 1)]
    rows += [(10 + k, " ".join([*words[:100], f"z{k}", *words[101:]]), "en", "s", 1) for k in range(150)]  # one large group
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() > 2  # op9's radius does not reach
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_near_copies_against_all_pairs(spark):
    """Components of every pair of texts of the test table, by plain sets."""
    rows = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()
    words = {}
    for r in rows:
        words.setdefault(tuple((r["text"] or "").encode().lower().split()), []).append(r["doc_id"])
    sets = {w: {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in words}
    top = {w: w for w in words}

    def find(w):
        while top[w] != w:
            w = top[w]
        return w

    by_shingle = {}
    for w, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(w)
    met = {(a, b) for v in by_shingle.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    links = 0
    for a, b in met:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            top[find(a)], links = find(b), links + 1
    first = {}
    for w, ids in words.items():
        first[find(w)] = min(first.get(find(w), min(ids)), min(ids))
    docs = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet")
    kept = {r["doc_id"] for r in simhash.first_of_each(docs).select("doc_id").collect()}
    assert links and kept == set(first.values())


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("docloom", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "docloom" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def _tables(spark, folder, docs, labels):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_every_stage_with_odd_and_empty_tables(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in range(14)] + [(None, 1, 0, "x"), (3, None, None, None)], "doc_id long, quality int, toxic int, text string")
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", "words", "fp", F.lit(True).alias("kept"), F.lit(1.0).alias("d2"), F.lit("p").alias("pool"))
    for name, rows, known in (("odd", odd, labels), ("none", no_docs.select(*odd.columns[:5]), labels), ("unlabelled", odd, labels.limit(0))):
        folder = _tables(spark, tmp_path / name, rows, known)
        given = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, folder)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= given.count()
        pieces = corpus_pipeline.packed(spark, given, folder)
        assert pieces.select("doc_id").distinct().count() == given.select("doc_id").distinct().count()
        assert corpus_pipeline.run(spark, folder).count() >= 0
