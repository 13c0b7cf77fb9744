"""Encoding, decoding, packing and token counts against the public libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from docloom.llm import bpe, packing, token_counts

from llm_texts import TEXTS


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark, docs, library):
    rows = bpe.round_trip(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = "a row without an id" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        ids = ids_of(library, text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(no_docs):
    assert bpe.round_trip(no_docs).count() == 0 and packing.pack(no_docs).count() == 0 and token_counts.count_tokens(no_docs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdrtlvem　\x85étheing012")), max_size=60))
def test_any_text(text):
    library = Tokenizer.from_file(bpe.default_vocabulary()) if not hasattr(test_any_text, "library") else test_any_text.library
    test_any_text.library = library
    own = bpe.codec(bpe.default_vocabulary())
    own.learn([text])
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == ids_of(library, text)
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_array_and_scalar_trees_agree():
    own, r = bpe.BytePairCodec(bpe.default_vocabulary()), random.Random(3)
    words = ["".join(r.choice("etaoinshrdluzq ") for _ in range(r.randint(1, 16))).encode() for _ in range(2000)]
    many = own.merge_many(words, 4)
    assert [np.frombuffer(m, "<u4").tolist() for m in many] == [own.merge(w) for w in words]


def test_cache_is_bounded():
    cache = bpe.Generations(len, entries=10, longest=5)
    assert [cache[f"k{i}"] for i in range(100)] == [len(f"k{i}") for i in range(100)]
    assert cache["too long for it"] == 15 and len(cache) + len(cache.old) <= 20 and "too long for it" not in cache


def test_packing(docs, library):
    rows = packing.pack(docs, group_windows=4).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["doc_id"] not in (None, 0):
            pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, text in enumerate(TEXTS[1:], 1):
        ids, at = [*ids_of(library, text), 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] == len(part) > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in rows if r["doc_id"] == 0) == 2 * (len(ids_of(library, TEXTS[0])) + 1)
    for members in windows.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2047), max_size=120))
def test_differencing_places_each_once(sizes):
    windows = packing.windows_for(sizes, 2048)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)


def test_differencing_is_near_equal():
    r = random.Random(5)
    sizes = [r.randint(1, 2047) for _ in range(400)]
    windows = packing.windows_for(sizes, 2048)
    assert sum(sizes) / (len(windows) * 2048) > 0.95
    assert packing.difference([8, 7, 6, 5, 4], 2)[0] == 16  # the classic example: 16 and 14


def best_pieces(word, scores):
    """All segmentations, by plain dynamic programming without a trie."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + token_counts.BYTE_SCORE * size, best[end - 1][1] + size)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts(docs):
    scores = token_counts.pieces(token_counts.default_vocabulary())
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect()}
    for i, text in enumerate(TEXTS):
        if i != 9:
            words = token_counts.PRETOKEN.findall(text or "")
            assert "".join(words) == (text or "")
            if len(text or "") < 5000:
                assert (rows[i]["n_pretokens"], rows[i]["n_tokens"]) == (len(words), sum(best_pieces(w, scores) for w in words))


def test_token_counts_as_the_library_has_them():
    scores = token_counts.pieces(token_counts.default_vocabulary())
    other = Tokenizer(models.Unigram([("<unk>", -200.0), *scores.items()], unk_id=0, byte_fallback=False))
    own, r = token_counts.Trie(scores, max_nodes=500), random.Random(1)
    for _ in range(500):
        word = " " + "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 12)))
        assert own.count(word) == own._alone(word) == len(other.encode(word).tokens)
    assert len(own.scores) < 600  # it started anew on the way


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t é", max_size=80), st.integers(1, 9))
def test_parts_do_not_change_chunks(text, size):
    cut = list(bpe.parts(text, bpe.EDGE, size))
    assert "".join(cut) == text and [c for p in cut for c in bpe.CHUNK.findall(p)] == bpe.CHUNK.findall(text)
    cut = list(bpe.parts(text, token_counts.EDGE, size))
    assert "".join(cut) == text and [c for p in cut for c in token_counts.PRETOKEN.findall(p)] == token_counts.PRETOKEN.findall(text)


@pytest.mark.parametrize("run", [" ", "\n", "\xa0", "a", "!"])
def test_long_runs_pack_as_the_library_has_them(spark, library, run):
    texts = ["word" + run * 2_000_000 + " end"]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, text in enumerate(texts):
        ids = np.array([*ids_of(library, text), packing.CLOSING_ID], "<u4")
        own = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == i)
        assert sum(n for _, n, _ in own) == len(ids) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == i)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in own)
