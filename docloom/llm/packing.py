"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Every document's ids (with a closing id) are cut into pieces.  A piece as long as a
window fills one by itself.  The shorter rests of a few hundred documents at a time are
dealt to windows by differencing: partial partitions are merged with opposing imbalances,
those of largest spread first, which leaves windows of nearly equal sums.  Long rests give
up a short tail each, as small pieces even the sums out at the end.  If the fullest
window is over its capacity, the number of windows rises by one and the rests are dealt
again.  All of it happens inside the task that reads the documents: no shuffle, and
memory is bounded by one group of rests and one document.

Defined cases: a null or empty text is the closing id alone; a very long text becomes
many full windows and one rest, runs of one character of any length included (where the
library's matcher gives up, this subpackage's own codec gives the ids); ties go by position, so a task that runs again gives
the same rows; repeated rows are packed as often as they occur; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, CLOSING_ID = 2048, 1
#: Windows that a group of rests is gathered for.
GROUP_WINDOWS = 128
#: A rest of over so many tokens is cut once more; tails have these lengths in turn.
LEAST_CUT, TAILS = 400, (8, 16, 32, 64, 128)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> tuple[int, list[list[int]]]:
    """Deals the sizes to windows; returns the fullest window's sum and each window's positions.

    A partial partition is kept as its windows that hold something, fullest first.
    """
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for order in range(len(heap), 2 * len(heap) - 1):
        _, _, a, a_members = heapq.heappop(heap)
        _, _, b, b_members = heapq.heappop(heap)
        alone = windows - len(a)  # so many of b meet an empty window; the next meet a's emptiest
        apart = len(a) - max(0, len(b) - alone)
        sums = a[:apart] + b[:alone] + [x + y for x, y in zip(reversed(a), b[alone:])]
        members = a_members[:apart] + b_members[:alone] + list(zip(reversed(a_members), b_members[alone:]))
        ranked = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, members = [sums[i] for i in ranked], [members[i] for i in ranked]
        heapq.heappush(heap, ((sums[-1] if len(sums) == windows else 0) - sums[0], order, sums, members))
    return (heap[0][2][0], [_flat(m) for m in heap[0][3]]) if heap else (0, [])


def _flat(tree: int | tuple) -> list[int]:
    """The leaves of nested pairs, from left to right."""
    out, todo = [], [tree]
    while todo:
        if isinstance(x := todo.pop(), int):
            out.append(x)
        else:
            todo += reversed(x)
    return out


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of the sizes by window, for the first number of windows that holds them all."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        fullest, members = difference(sizes, count)
        if fullest <= capacity:
            return members
        count += 1


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The vocabulary file's ids, by tiktoken: it gives the same ids in a quarter of the time."""
    import tiktoken

    from .bpe import PATTERN, codec

    tokens = codec(path).token_bytes
    special = {k: int(np.frombuffer(v, "<u4")[0]) for k, v in codec(path).special_ids.items()}
    ranks = {b: i for i, b in enumerate(tokens) if i not in special.values()}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(text: str, path: str) -> np.ndarray:
    """The text's ids; the library's matcher gives up on very long white space, which the codec of ``bpe`` takes."""
    try:
        return tokenizer(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        from .bpe import codec

        return np.frombuffer(codec(path).encode(text), "<u4")


class Packer:
    """Packs one task's documents, in the order in which they come."""

    def __init__(self, task: int, window: int, group_windows: int):
        self.next_id, self.window, self.room = task << 32, window, window * group_windows
        self.rests: list[tuple] = []
        self.held = self.cuts = 0

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[tuple]:
        raw, n = memoryview(ids.astype("<u4", copy=False)).cast("B"), len(ids)

        def piece(start: int, end: int) -> tuple:
            return doc_id, start, end - start, zlib.crc32(raw[4 * start : 4 * end]), n

        whole = n - n % self.window
        for start in range(0, whole, self.window):
            yield (*piece(start, start + self.window), self.next_id, 0)
            self.next_id += 1
        if whole < n:
            cut = n
            if n - whole > LEAST_CUT:
                cut -= TAILS[self.cuts % len(TAILS)]
                self.rests.append(piece(cut, n))
                self.cuts += 1
            self.rests.append(piece(whole, cut))
            self.held += n - whole
        if self.held >= self.room:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for members in windows_for([p[2] for p in self.rests], self.window) if self.rests else []:
            offset = 0
            for i in members:
                yield (*self.rests[i], self.next_id, offset)
                offset += self.rests[i][2]
            self.next_id += 1
        self.rests, self.held = [], 0


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """(doc_id, text) to a row for each piece: where it lies in its document and in its sequence."""
    from .bpe import default_vocabulary

    path = vocabulary or default_vocabulary()
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), window, group_windows)

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                yield from packer.add(doc_id, np.append(ids_of(text.as_py() or "", path), np.uint32(CLOSING_ID)))

        def framed(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            if columns := list(zip(*found)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            yield from framed(rows(batch))
        yield from framed(packer.flush())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
