"""Tokens of two tokenizers on the same bytes.

A text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece
vocabulary (B).  ``np.repeat`` gives each byte its owner among A's tokens and among B's; where
consecutive pairs of owners differ a new overlap begins, and where both owners change at once
there is a cut.  Between two cuts lies a group of tokens, all of whose A-B pairs are linked.

``scored`` counts for each pair of ids how many documents hold it linked, and gives every document
the counts of its links.  One pass encodes and keeps each document's distinct pairs,
packed; tasks add documents up by blocks of a bounded number of pairs, so what is shuffled is a
row for each pair of a block.  Its corpus-wide counts go back to the block, not to the document.

Texts are encoded in parts, cut at spaces where both tokenizers cut, so memory is that of a part
(a run without such a space is one part) and of a document's distinct pairs.  In a group of many
tokens pairs are counted by distinct ids, so no group is multiplied out.

Defined cases: a null or empty text, or one that either tokenizer changes, has no tokens, and
zeros; special tokens' strings are plain text; repeated rows count as documents each; a very long
text is many parts; an empty table gives an empty result; other columns are not read.  A piece
vocabulary whose pieces go on after a space is refused with ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from .bpe import SPACE, Generations, codec, default_vocabulary, parts
from .packing import tokenizer

#: Characters of a part, and of the parts that are aligned together.
PART, TOGETHER = 1 << 18, 1 << 19
#: Links of a group from which its pairs are counted by distinct ids, and pairs of a block of documents.
MANY, BLOCK_PAIRS = 64, 1 << 20
#: A run of spaces belongs to what follows it; a part begins at such a run after other characters.
CHUNK, EDGE = re.compile(" +[^ ]*"), re.compile(f"(?<=[^{SPACE}]) ")
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def default_pieces() -> str:
    """The place of the public piece vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class TwoTokenizers:
    """Encodes by both vocabularies; knows the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a_path, self.a = a_path, tokenizer(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(rb"[^ ] ", x) for x in self.b_bytes):
            raise ValueError("a piece goes on after a space")
        self.space = self.b.piece_to_id("▁")
        a_bytes = codec(a_path).token_bytes
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in xs], np.int64) for xs in (a_bytes, self.b_bytes))
        self.n_b = len(pieces)
        if len(a_bytes) * self.n_b > 1 << 32:
            raise ValueError("the vocabularies have over 2 ** 32 pairs")
        self.chunks = Generations(lambda chunk: self._of(chunk, self.b.encode(chunk[1:])))
        self.words = [f"{i}{end}".encode() for i in range(len(a_bytes)) for end in ",|"] + [f"{i}{end}".encode() for i in range(self.n_b) for end in ",;"]
        self.b_words = 2 * len(a_bytes)

    def _of(self, chunk: str, ids: list[int]) -> bytes | None:
        """A chunk's ids by B, which adds the first space itself; None where they do not spell the chunk."""
        ids = ids if len(chunk) > 1 else [self.space]
        same = b"".join(map(self.b_bytes.__getitem__, ids)) == chunk.encode()
        return np.array(ids, "<u4").tobytes() if same else None

    def learn(self, texts: list[str]) -> None:
        """Encodes the chunks that are new in these texts in one call."""
        new = [c for c in set().union(*map(CHUNK.findall, texts)).difference(self.chunks).difference(self.chunks.old) if len(c) <= self.chunks.longest]
        for chunk, ids in zip(new, self.b.encode([c[1:] for c in new], num_threads=1)):
            self.chunks.put(chunk, self._of(chunk, ids))

    def encode(self, part: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids by A and by B of a text that begins with a space; None where they do not spell it."""
        found = list(map(self.chunks.__getitem__, CHUNK.findall(part)))
        if None in found:
            return None
        try:
            a = self.a.encode_to_numpy(part, disallowed_special=())
        except ValueError:  # very long white space
            a = np.frombuffer(codec(self.a_path)._encode_plain(part), "<u4")
        b = np.frombuffer(b"".join(found), "<u4")
        return (a, b) if self.a_lengths[a].sum() == self.b_lengths[b].sum() else None


@lru_cache(maxsize=2)
def two(a_path: str, b_path: str) -> TwoTokenizers:
    """One pair of tokenizers for each worker process."""
    return TwoTokenizers(a_path, b_path)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens that spell the same bytes: the pairs (a, b) that share bytes, in order, and the byte offsets where both begin anew."""
    a, b = (np.repeat(np.arange(len(x), dtype=np.int32), x) for x in (a_lengths, b_lengths))
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.flatnonzero(new_a | new_b) + 1
    at = np.concatenate(([0], at)) if len(a) else at
    return a[at], b[at], np.flatnonzero(new_a & new_b) + 1


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, from the overlaps in order."""
    new_a, new_b = (np.concatenate(([True], x[1:] != x[:-1])) for x in (a, b))
    group = np.cumsum(new_a & new_b) - 1
    return group[new_a], group[new_b]


def _linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, part_of: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, pair, times): the distinct linked pairs of ids of each part, and how often each is linked there."""
    sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
    first_a, first_b = np.cumsum(sizes_a) - sizes_a, np.cumsum(sizes_b) - sizes_b
    links = sizes_a * sizes_b
    few = np.flatnonzero(links <= MANY)
    which = np.repeat(few, links[few])
    within = np.arange(len(which)) - np.repeat(np.cumsum(links[few]) - links[few], links[few])
    i, j = np.divmod(within, sizes_b[which])
    key = part_of[which] << 32 | a[first_a[which] + i].astype(np.int64) * n_b + b[first_b[which] + j]
    found = [np.unique(key, return_counts=True)]
    for g in np.flatnonzero(links > MANY).tolist():
        own_a, times_a = np.unique(a[first_a[g] : first_a[g] + sizes_a[g]], return_counts=True)
        own_b, times_b = np.unique(b[first_b[g] : first_b[g] + sizes_b[g]], return_counts=True)
        pairs = part_of[g] << 32 | (own_a.astype(np.int64)[:, None] * n_b + own_b).ravel()
        found.append((pairs, np.outer(times_a, times_b).ravel()))
    key, times = summed(found)
    return key >> 32, key & 0xFFFFFFFF, times


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their numbers."""
    if len(found) == 1:
        return found[0]
    keys, times = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def pack_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs by what each adds to the one before, and their times, byte by byte of like weight, compressed."""
    planes = [np.diff(keys, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T, times.astype("<u8").view(np.uint8).reshape(-1, 8).T]
    return zlib.compress(b"".join(p.tobytes() for p in planes), 1) if len(keys) else b""


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(12, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4")[:, 0], dtype=np.int64), np.ascontiguousarray(planes[4:].T).view("<i8")[:, 0]


class Document:
    """What has been found of one text so far."""

    def __init__(self, doc_id: int | None):
        self.doc_id, self.bad, self.digest, self.pairs = doc_id, False, None, []
        self.n_a = self.n_b = self.n_groups = self.n_links = 0

    def add(self, n_a: int, n_b: int, n_groups: int, n_links: int, groups: bytes, keys: np.ndarray, times: np.ndarray) -> None:
        if self.digest is None:
            self.digest = hashlib.sha256(groups)
        else:
            self.digest.update(b";" + groups)
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.n_links + n_links
        self.pairs.append((keys, times))
        if len(self.pairs) > 16:
            self.pairs = [summed(self.pairs)]

    def row(self) -> tuple:
        if self.bad or self.digest is None:
            return self.doc_id, 0, 0, 0, 0, "", 0, b""
        keys, times = summed(self.pairs)
        return self.doc_id, self.n_a, self.n_b, self.n_groups, self.n_links, self.digest.hexdigest(), len(keys), pack_pairs(keys, times)


def _aligned(own: TwoTokenizers, held: list[tuple[Document, str]]) -> None:
    """Aligns the parts together and adds what is found to their documents."""
    own.learn([p for _, p in held])
    encoded = []
    for doc, part in held:
        if not doc.bad and (ids := own.encode(part)) is not None:
            encoded.append((doc, *ids))
        else:
            doc.bad = True
    if not encoded:
        return
    a, b = (np.concatenate(x) for x in list(zip(*encoded))[1:])
    per_a, per_b = (np.array([len(x[k]) for x in encoded]) for k in (1, 2))
    group_a, group_b = groups_of(*overlaps(own.a_lengths[a], own.b_lengths[b])[:2])
    ends_a, ends_b = np.cumsum(per_a), np.cumsum(per_b)
    starts = group_a[ends_a - per_a]
    n_groups = np.diff(np.append(starts, group_a[-1] + 1))
    part_of = np.repeat(np.arange(len(encoded)), n_groups)
    sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
    n_links = np.add.reduceat(sizes_a * sizes_b, starts)
    # each token's word in the text of groups: A's of a group, then B's
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
    words = np.empty(len(a) + len(b), np.int64)
    words[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = 2 * a.astype(np.int64) + last_a
    words[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = own.b_words + 2 * b.astype(np.int64) + last_b
    part, keys, times = _linked(a, b, group_a, group_b, part_of, own.n_b)
    bounds = np.searchsorted(part, np.arange(len(encoded) + 1))
    at = 0
    for k, (doc, _, _) in enumerate(encoded):
        n = int(per_a[k] + per_b[k])
        groups = b"".join(map(own.words.__getitem__, words[at : at + n].tolist()))[:-1]
        at += n
        own_pairs = slice(bounds[k], bounds[k + 1])
        doc.add(int(per_a[k]), int(per_b[k]), int(n_groups[k]), int(n_links[k]), groups, keys[own_pairs], times[own_pairs])


def documents(own: TwoTokenizers, batches: Iterator[pa.RecordBatch]) -> Iterator[Document]:
    """Every row's text aligned, in order."""
    waiting, held, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            waiting.append(doc := Document(doc_id))
            if content := text.as_py():
                for part in parts(" " + content, EDGE, PART):
                    held.append((doc, part))
                    size += len(part)
                    if size >= TOGETHER:
                        _aligned(own, held)
                        yield from waiting[:-1]
                        waiting, held, size = waiting[-1:], [], 0
    _aligned(own, held)
    yield from waiting


def align(docs: DataFrame, a_vocabulary: str | None = None, b_vocabulary: str | None = None) -> DataFrame:
    """(doc_id, a_ids, b_ids, overlaps, cuts): both tokenizers' ids, the positions of tokens that share bytes, and the byte offsets in space + text where both cut."""
    paths = a_vocabulary or default_vocabulary(), b_vocabulary or default_pieces()
    kinds = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int64())), ("b_ids", pa.list_(pa.int64())), ("overlaps", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("cuts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = two(*paths)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = own.encode(" " + text.as_py()) if text.as_py() else None
                a, b = ids or (np.empty(0, np.int64), np.empty(0, np.int64))
                of_a, of_b, cuts = overlaps(own.a_lengths[a], own.b_lengths[b])
                pairs = [{"a": x, "b": y} for x, y in zip(of_a.tolist(), of_b.tolist())]
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id.as_py(), "a_ids": a.tolist(), "b_ids": b.tolist(), "overlaps": pairs, "cuts": cuts.tolist()}], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, a_ids array<long>, b_ids array<long>, overlaps array<struct<a: long, b: long>>, cuts array<long>")


def paired(docs: DataFrame, a_vocabulary: str | None = None, b_vocabulary: str | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Each document's numbers and groups, its block, and its distinct linked pairs of ids, packed."""
    paths = a_vocabulary or default_vocabulary(), b_vocabulary or default_pieces()
    columns = f"{DOCUMENT}, block long, pairs binary"
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for doc in documents(two(*paths), batches):
            *row, n, pairs = doc.row()
            doc.pairs = []
            if rows and held + n > block_pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                block, rows, held = block + 1, [], 0
            rows.append((*row, block, pairs))
            held += n
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, columns)


def block_counts(rows: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(block, pair, n): the documents of each block that hold a pair; a block that several tasks read has rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), at)), pa.array(keys), pa.array(n.astype(np.int64))], ["block", "pair", "n"])

        for batch in batches:
            for block, pairs in zip(batch["block"].to_pylist(), batch["pairs"]):
                keys = unpack_pairs(pairs.as_py())[0]
                if held and (block != at or size + len(keys) > block_pairs):
                    yield out()
                    held, size = [], 0
                at = block
                held.append(keys)
                size += len(keys)
        if held:
            yield out()

    return rows.select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def scored(docs: DataFrame, a_vocabulary: str | None = None, b_vocabulary: str | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Each document's numbers of tokens, groups and links, and how common its links are among all documents.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links that are their A id's most common),
    count_sum (documents that hold a link, summed over links) and groups_sha256.
    """
    paths = a_vocabulary or default_vocabulary(), b_vocabulary or default_pieces()
    rows = storage.table(paired(docs, *paths, block_pairs), "paired")
    blocks = storage.table(block_counts(rows, block_pairs), "block_pairs")
    counts = storage.table(blocks.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a_of = F.floor(F.col("pair") / two(*paths).n_b)
    best = counts.groupBy(a_of.alias("a")).agg(F.max("n").alias("best"))  # a row for each id of A at most
    told = counts.withColumn("a", a_of).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    known = blocks.select("block", "pair").join(told, "pair")
    kinds = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in f"{DOCUMENT}, n_best long, count_sum long".split(", "))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right["pair"].to_numpy()
        order = np.argsort(pairs, kind="stable")
        pairs, n, top = pairs[order], right["n"].to_numpy()[order], right["top"].to_numpy()[order]
        n_best, count_sum = [], []
        for packed in left["pairs"]:
            keys, times = unpack_pairs(packed.as_py())
            at = np.searchsorted(pairs, keys)
            n_best.append(int(times[top[at].astype(bool)].sum()) if len(keys) else 0)
            count_sum.append(int((times * n[at]).sum()) if len(keys) else 0)
        own = left.select([x.split()[0] for x in DOCUMENT.split(", ")])
        return own.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).cast(kinds)

    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"{DOCUMENT}, n_best long, count_sum long")
