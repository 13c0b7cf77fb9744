"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

``encode_documents`` gives the ids that the vocabulary's own library gives; ``decode``
turns ids back into text.  Work is per row: one pass, no shuffle.

Defined cases: a null text is the empty text; the empty text has no ids; a very long
text or word takes O(n log n) time and O(n) memory; repeated rows give repeated results;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space characters, as the inside of a character class.
SPACE = "\t-\r \x85\xa0  -     　"
#: A run of white space belongs to what follows it, so no pre-token crosses a chunk's edge.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Fixed value: the vocabulary's pre-token pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PRETOKEN = regex.compile(PATTERN)
#: White space after other characters: a chunk begins there.
EDGE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
NONE = 1 << 60
#: Chunks kept by a worker in each of two generations, and the longest chunk kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 40


def default_vocabulary() -> str:
    """The place of the public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        letters[b] = chr(b) if b in shown else chr(256 + extra)
        extra += b not in shown
    return letters


def parts(text: str, edge: re.Pattern, size: int = 1 << 20) -> Iterator[str]:
    """The text in parts of about so many characters, cut at edges only, so that lists stay short."""
    start = 0
    while len(text) - start > 2 * size and (m := edge.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


class Generations(dict):
    """A bounded cache: entries not asked for while a generation fills up are forgotten."""

    def __init__(self, make, entries: int = CACHE_ENTRIES, longest: int = CACHE_CHARS):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key: str):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value


class BytePairCodec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left] << 32 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_ids = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(map(byte_of.__getitem__, token))
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        ids = self.byte_ids
        self.byte_pairs = [self.pairs.get(ids[a] << 32 | ids[b]) for a in range(256) for b in range(256)]
        order = sorted(self.pairs)
        self.keys, self.ranks = np.array(order, np.int64), np.array([self.pairs[k] for k in order], np.int64)
        self.merged_ids, self.byte_lut = np.array(self.merged, np.int64), np.array(ids, np.int64)
        self.byte_ranks = np.array([NONE if r is None else r for r in self.byte_pairs], np.int64)
        self.chunks = Generations(self._encode_chunk)

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token: joins the leftmost pair of lowest rank until none is left.

        Leaf i of a binary tree holds the rank of the pair that begins at symbol i, with i
        in the low bits, so the root is the next merge.  A merge changes three leaves.
        """
        ids, pairs = [self.byte_ids[b] for b in word], self.pairs.get
        n = len(ids)
        if n < 2:
            return ids
        bits = (n - 2).bit_length()
        size = 1 << bits
        tree = [NONE] * (2 * size)
        for i, (a, b) in enumerate(zip(word, word[1:])):
            if (rank := self.byte_pairs[a << 8 | b]) is not None:
                tree[size + i] = rank << bits | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (root := tree[1]) < NONE:
            i = root & (size - 1)
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            ids[i], ids[j] = self.merged[root >> bits], -1
            h = before[i]
            changed = [(j, NONE)] if j < n - 1 else []
            rank = pairs(ids[i] << 32 | ids[k]) if k < n else None
            changed.append((i, NONE if rank is None else rank << bits | i))
            if h >= 0:
                rank = pairs(ids[h] << 32 | ids[i])
                changed.append((h, NONE if rank is None else rank << bits | h))
            for leaf, value in changed:
                p = size + leaf
                tree[p] = value
                while p > 1:
                    other = tree[p ^ 1]
                    value = value if value < other else other
                    p >>= 1
                    if tree[p] == value:
                        break
                    tree[p] = value
        return [x for x in ids if x >= 0]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((right >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def merge_many(self, words: list[bytes], bits: int) -> list[bytes]:
        """``merge`` for words of at most 2 ** bits bytes: a row of arrays for each word's tree."""
        size, w = 1 << bits, len(words)
        text = np.frombuffer(b"".join(x.ljust(size + 1, b"\0") for x in words), np.uint8).reshape(w, size + 1).astype(np.int64)
        n, leaf = np.array([len(x) for x in words])[:, None], np.arange(size)
        symbols = np.where(np.arange(size + 1) < n, self.byte_lut[text], -1)
        first = np.where(leaf < n - 1, self.byte_ranks[text[:, :-1] << 8 | text[:, 1:]], NONE)
        tree = np.full((w, 2 * size), NONE, np.int64)
        tree[:, size:] = np.where(first < NONE, first << bits | leaf, NONE)
        for level in range(bits - 1, -1, -1):
            at = np.arange(1 << level, 2 << level)
            tree[:, at] = np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1])
        after = np.tile(np.arange(1, size + 2), (w, 1))
        before = np.tile(np.arange(-1, size), (w, 1))
        rows = np.arange(w)
        while True:
            root = tree[rows, 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                break
            i = root & (size - 1)
            j = after[rows, i]
            k = after[rows, j]
            after[rows, i], before[rows, k] = k, i
            symbols[rows, i], symbols[rows, j] = self.merged_ids[root >> bits], -1
            h = np.maximum(before[rows, i], 0)
            own = self._ranks_of(symbols[rows, i], symbols[rows, k])
            previous = self._ranks_of(symbols[rows, h], symbols[rows, i])
            tree[rows, size + j] = NONE
            tree[rows, size + h] = np.where(previous < NONE, previous << bits | h, NONE)
            tree[rows, size + i] = np.where(own < NONE, own << bits | i, NONE)
            nodes = size + np.stack([i, j, h])
            for _ in range(bits):
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
        left = symbols >= 0
        ends = (left.sum(axis=1).cumsum() * 4).tolist()
        ids = symbols[left].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, texts: list[str]) -> None:
        """Encodes the chunks that are new in these texts, words of like length together."""
        words_of: dict[str, list[str]] = {}
        seen = set().union(*(CHUNK.findall(p) for text in texts for p in parts(text, EDGE)))
        for chunk in seen.difference(self.chunks).difference(self.chunks.old):
            if len(chunk) <= CACHE_CHARS:
                alone = chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha()
                words_of[chunk] = [chunk] if alone else PRETOKEN.findall(chunk)
        by_bits: dict[int, list[tuple[str, bytes]]] = {}
        for word in set().union(*words_of.values()):
            text = word.encode()
            by_bits.setdefault(max(3, (len(text) - 1).bit_length()), []).append((word, text))
        known: dict[str, bytes] = {}
        for bits, words in by_bits.items():
            known |= zip((w for w, _ in words), self.merge_many([text for _, text in words], bits))
        for chunk, words in words_of.items():
            self.chunks.put(chunk, known[chunk] if len(words) == 1 else b"".join(map(known.__getitem__, words)))

    def _encode_chunk(self, chunk: str) -> bytes:
        words = PRETOKEN.findall(chunk)
        return b"".join(array("I", self.merge(w.encode())).tobytes() for w in words)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; special tokens' strings are theirs."""
        if self.special is None or not self.special.search(text):
            return self._encode_plain(text)
        out, end = [], 0
        for m in self.special.finditer(text):
            out += [self._encode_plain(text[end : m.start()]), self.special_ids[m[0]]]
            end = m.end()
        return b"".join([*out, self._encode_plain(text[end:])])

    def _encode_plain(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.chunks.__getitem__, CHUNK.findall(p))) for p in parts(text, EDGE))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens as their strings; broken UTF-8 becomes U+FFFD."""
        all_ids, step = np.frombuffer(ids, "<u4"), 1 << 20
        blocks = (all_ids[k : k + step].tolist() for k in range(0, len(all_ids), step))
        return b"".join(b"".join(map(self.token_bytes.__getitem__, b)) for b in blocks).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec for each vocabulary and worker process."""
    return BytePairCodec(path)


def _slices(batch: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[list[str]]:
    """The batch's texts in order, a few million characters (or one text) at a time."""
    texts, size = [], 0
    for text in batch["text"]:
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= chars:
            yield texts
            texts, size = [], 0
    yield texts


def encode_all(own: BytePairCodec, batch: pa.RecordBatch) -> Iterator[bytes]:
    """The ids of each row's text."""
    for texts in _slices(batch):
        own.learn(texts)
        yield from map(own.encode, texts)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, ids: binary of little-endian unsigned 32-bit integers)."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = pa.array(encode_all(own, batch), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encodes every text, decodes the ids again and returns digests of both.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row.
    """
    path = vocabulary or default_vocabulary()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in encode_all(own, batch):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, schema)
