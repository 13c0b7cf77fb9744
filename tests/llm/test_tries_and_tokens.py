"""Prefix tries, aligned tokenizers and files of token ids against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import alignment, bpe, id_files, prefix_trie, queries

from llm_texts import TEXTS

TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
SCORES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
MORE = [(None, "x y"), (None, None), (3, "again"), (100, "▁a b"), (101, "  two  spaces\n\n here\t \t x "), (102, "a " * 3000 + " " * 500), (103, "</s><s><unk> <0x0A> <|endoftext|>"), (104, "b" * 9000)]
ROWS = [*enumerate(TEXTS), *MORE]


def brute_trie(rows, rebuilt=True):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in found.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        built[c] = turns.get(c - abs(c) % 20 * (1 if c > 0 else -1), [])[:h] + own[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, own in built.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    out, leaves, saved = [], {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[x] for x in below[path]) or 1
        saved[path] = own + sum(saved[x] for x in below[path])
        ends = ",".join(map(str, sorted(c for c in members[path] if len(built[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(below[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    r = random.Random(1)
    rows = [(r.choice([None, *range(-45, 120)]), r.choice([None, 0, 1, 2, 3, 4]), r.choice(["user", "assistant", None]), r.choice(["a b", "a", "", None])) for _ in range(900)]
    rows += [(700, i, "user", "x y") for i in range(60)] + [(701, i, "user", "x y") for i in range(55)]
    return rows + [(7000 + k, i, "user", "x y" if i != k else f"z{k}") for k in range(20) for i in range(25)]


def trie_rows(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def told(spark):
    columns = "conv_id long, turn long, role string, text string, depth int, block string, w int, owner string"
    return spark.createDataFrame([(*r, 1, "clash", 0, "clash") for r in conversations()], columns).repartition(3)


def test_rebuilt_trie(told):
    assert trie_rows(prefix_trie.rebuilt_trie(told)) == brute_trie(conversations())


def test_trie_of_conversations_as_they_are(told):
    assert trie_rows(prefix_trie.conversation_trie(told)) == brute_trie(conversations(), rebuilt=False)


def test_small_tries(spark):
    columns = "conv_id long, turn long, role string, text string"
    for rows in ([], [(None, 1, "user", "x")], [(7, 0, "user", "x")], [(41, 0, "user", "x"), (43, 0, "user", "x")]):
        assert trie_rows(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, columns))) == brute_trie(rows)


def test_one_conversation_in_many_blocks(spark, monkeypatch):
    """Chains are summed by blocks of two depths, and ends by blocks of two ids."""
    monkeypatch.setattr(prefix_trie, "DEPTHS", 1)
    monkeypatch.setattr(prefix_trie, "ENDS", 1)
    rows = [(c, i, "user", "x y" if i < 12 - c % 3 else f"{c % 5}") for c in range(1, 19) for i in range(12 + c % 2)]
    assert trie_rows(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == brute_trie(rows)


def test_doubling_sums_deep_chains(spark):
    rows = [(c, c - 1 if c else None, 1) for c in range(50)] + [(100 + k, 49, 2) for k in range(30)]
    got = prefix_trie.totals_below(spark.createDataFrame(rows, "conv_id long, parent long, v long"), ["v"]).collect()
    assert {r[0]: r[1] for r in got} == {c: 50 - c + 60 for c in range(50)} | {100 + k: 2 for k in range(30)}


def test_trie_sql_is_there():
    assert "op11_prefix_trie" in queries.ORACLE_SQL


@pytest.fixture(scope="module")
def libraries():
    plain = Tokenizer.from_file(bpe.default_vocabulary())
    plain.encode_special_tokens = True
    return plain, sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())


def spelt(libraries, text):
    """Both tokenizers' ids and the ends of their tokens; None if the text has no tokens."""
    plain, pieces = libraries
    if not text:
        return None
    a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    token = bpe.codec(bpe.default_vocabulary()).token_bytes
    piece = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    whole, of_a, of_b = (" " + text).encode(), [token[i] for i in a], [piece(i) for i in b]
    return (a, b, np.cumsum(list(map(len, of_a))), np.cumsum(list(map(len, of_b)))) if b"".join(of_a) == whole == b"".join(of_b) else None


def brute_scores(libraries, rows):
    docs, held = [], Counter()
    for doc_id, text in rows:
        groups, found = [], spelt(libraries, text)
        if found:
            a, b, ends_a, ends_b = found
            cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
            groups = [([], []) for _ in cuts]
            for x, e in zip(a, np.searchsorted(cuts, ends_a)):
                groups[e][0].append(x)
            for x, e in zip(b, np.searchsorted(cuts, ends_b)):
                groups[e][1].append(x)
        docs.append((doc_id, groups))
        held.update({(x, y) for g in groups for x in set(g[0]) for y in set(g[1])})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups in docs:
        links = Counter()
        for of_a, of_b in groups:
            counts = Counter(of_b)
            for x, n in Counter(of_a).items():
                for y, m in counts.items():
                    links[x, y] += n * m
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        sizes = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out.append((doc_id, *sizes, len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def all_docs(spark):
    return spark.createDataFrame([(*r, 1, "clash", 2.0) for r in ROWS], "doc_id long, text string, block int, pairs string, start double").repartition(3)


@pytest.mark.parametrize("block_pairs", [alignment.BLOCK_PAIRS, 40])
def test_scored(all_docs, libraries, block_pairs):
    got = sorted((tuple(r[c] for c in SCORES) for r in alignment.scored(all_docs, block_pairs=block_pairs).collect()), key=str)
    assert got == brute_scores(libraries, ROWS)


def test_parts_do_not_change_groups(all_docs, libraries, monkeypatch):
    own = alignment.TwoTokenizers(bpe.default_vocabulary(), alignment.default_pieces())
    monkeypatch.setattr(alignment, "PART", 50)
    monkeypatch.setattr(alignment, "TOGETHER", 120)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ROWS]), pa.array([r[1] for r in ROWS])], ["doc_id", "text"])
    got = [(d.doc_id, *d.row()[1:6]) for d in alignment.documents(own, [batch])]
    assert sorted(got, key=str) == [(r[0], *r[1:5], r[7]) for r in brute_scores(libraries, ROWS)]


def test_alignment_spans(spark, libraries):
    rows = [(1, "naïve 日本語 👩‍👩‍👧 don't"), (2, None), (3, "word " * 20)]
    for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = spelt(libraries, dict(rows)[r["doc_id"]])
        a, b, ends_a, ends_b = found or ([], [], np.array([0]), np.array([0]))
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        begin = lambda ends: np.concatenate(([0], ends[:-1]))
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if begin(ends_a)[i] < ends_b[j] and begin(ends_b)[j] < ends_a[i]]
        assert sorted((o["a"], o["b"]) for o in r["overlaps"]) == want
        assert r["cuts"] == sorted(set(ends_a.tolist()) & set(ends_b.tolist()) - {int(ends_a[-1])})


def test_packed_pairs():
    keys, times = np.array([0, 5, 70_000, 2**32 - 1]), np.array([1, 2**40, 1, 3])
    back = alignment.unpack_pairs(alignment.pack_pairs(keys, times))
    assert (back[0] == keys).all() and (back[1] == times).all() and len(alignment.unpack_pairs(b"")[0]) == 0


def test_id_files(all_docs):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    got = sorted((tuple(r) for r in id_files.round_trip(all_docs).collect()), key=lambda r: r[1])
    at, ids = 0, [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in ROWS]
    assert [r[0] for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids), key=str) == sorted(((r[0], *r[2:]) for r in got), key=str)


def test_ids_read_back_whole(spark, tmp_path):
    rows = [(3, "c d e"), (1, "a"), (2, None)]
    id_files.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"), segment_ids=2, block=4)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in id_files.read(spark, str(tmp_path / "ids"), with_ids=True).collect():
        assert r["ids"] == [*library.encode(dict(rows)[r["doc_id"]] or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("size", [1, 5, 1023, 1024, 1025, 9000])
@pytest.mark.parametrize("most", [1, 2, 300, 50_000, 2**32])
def test_blocks_give_any_run_of_ids(size, most):
    r = np.random.default_rng(size)
    ids = r.integers(0, most, size, dtype=np.uint64).astype(np.uint32)
    ids[r.integers(0, size)] = most - 1
    data = id_files.segment(7, [1, None], [ids[: size // 2], ids[size // 2 :]]) + id_files.LAST
    own = id_files.Segment(data)
    assert (own.ids() == ids).all() and (own.ids(size // 3, size // 2) == ids[size // 3 : size // 2]).all() and own.number == 7
    assert [(d, s, x.tolist()) for d, s, x in own.documents(10)] == [(1, 0, ids[: size // 2].tolist()), (None, size // 2, ids[size // 2 :].tolist())]


def test_outliers_do_not_widen_blocks():
    ids = np.full(1024, 5, np.uint32)
    ids[:20] = 50_000
    assert len(id_files.packed(ids)[0]) == id_files.BLOCK_HEAD.size + 20 * 6


def test_damage_is_seen():
    data = bytearray(id_files.segment(1, [1], [np.arange(3000, dtype=np.uint32)]) + id_files.LAST)
    data[500] ^= 4
    with pytest.raises(ValueError, match="not a whole segment"):
        id_files.Segment(bytes(data))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scored(empty).count() == 0 and id_files.round_trip(empty).count() == 0 and alignment.align(empty).count() == 0
