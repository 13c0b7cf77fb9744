"""Token ids in files of patched frame-of-reference blocks.

A segment is one file: a head, blocks of 1,024 ids, the places where the blocks begin and a table
of its documents.  A block keeps its least id and the others' distances from it, packed at the width of one of
their percentiles, that which makes the block smallest; the wider ones are exceptions, kept in a list of place and
value.  Any run of ids is read from the blocks that hold it alone.

Documents are dealt out by ranges of doc_id and encoded and written in that order, as a stream: a
task holds one segment.  Segments are the rows of Spark's text writer, a file for each, so they lie in
any store that Spark reaches and a task that runs again replaces its own files; the writer's line
end is the format's last byte.  A segment's number puts it in order; where its ids begin follows
from the tables of the segments before it.

Defined cases: a null or empty text is the closing id alone; a null doc_id comes first; rows that
share a doc_id follow each other by a hash of their texts; a document longer than a segment
has one of its own, and its task takes the memory of its ids; an empty table gives no documents;
other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from .bpe import default_vocabulary
from .packing import ids_of

CLOSING_ID = 2
#: Ids of a block, ids of a segment from which it is written, and the shares of a block's ids that its width may hold.
BLOCK, SEGMENT, SHARES = 1024, 8 << 20, (0.75, 0.9, 0.95, 0.98, 0.99, 1.0)
#: Fixed values of the format: the first bytes and the last, and the heads of a segment and of a block.
MAGIC, LAST = b"TOKENS01", b"\n"
#: Magic, segment's number, ids, documents, ids of a block, where block starts and the documents' table begin.
HEAD = struct.Struct("<8sqqqqqq")
#: Least id, ids, exceptions, width.
BLOCK_HEAD = struct.Struct("<IHHB")
ROWS = "segment long, doc_id long, start long, n_tokens long, ids_crc32 long"


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits each number below 2 ** 32 takes."""
    return np.frexp(x.astype(np.float64))[1]


def packed(ids: np.ndarray, block: int = BLOCK, shares: tuple[float, ...] = SHARES) -> list[bytes]:
    """The blocks of these ids, as bytes; those of like width are packed together."""
    whole = len(ids) // block
    found = _packed_rows(ids[: whole * block].reshape(whole, block), shares) if whole else []
    return found + (_packed_rows(ids[whole * block :].reshape(1, -1), shares) if len(ids) % block else [])


def _packed_rows(rows: np.ndarray, shares: tuple[float, ...]) -> list[bytes]:
    n, size = rows.shape
    least = rows.min(axis=1)
    off = rows - least[:, None]
    ranked = np.sort(off, axis=1)
    choices = np.stack([_bits(ranked[:, max(0, int(np.ceil(s * size)) - 1)]) for s in shares])
    over = np.stack([(_bits(ranked) > c[:, None]).sum(axis=1) for c in choices])
    best = np.argmin((size * choices + 7) // 8 + 6 * over, axis=0)
    widths = choices[best, np.arange(n)]
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        values = off[own]
        over = values >> np.uint32(width) if width < 32 else np.zeros_like(values)
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(len(own), size, 4), axis=2, bitorder="little")[:, :, :width]
        body = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        for i, r in enumerate(own.tolist()):
            at = np.flatnonzero(over[i])
            head = BLOCK_HEAD.pack(int(least[r]), size, len(at), width)
            out[r] = b"".join((head, body[i].tobytes(), at.astype("<u2").tobytes(), values[i, at].astype("<u4").tobytes()))
    return out


def unpacked(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at these places."""
    heads = [BLOCK_HEAD.unpack_from(data, s) for s in starts.tolist()]
    ends = np.cumsum([h[1] for h in heads])
    out = np.empty(int(ends[-1]) if len(heads) else 0, np.uint32)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (_, size, _, width) in enumerate(heads):
        kinds.setdefault((size, width), []).append(i)
    for (size, width), own in kinds.items():
        long = (size * width + 7) // 8
        body = np.stack([np.frombuffer(data, np.uint8, long, int(starts[i]) + BLOCK_HEAD.size) for i in own])
        bits = np.zeros((len(own), size, 32), np.uint8)
        bits[:, :, :width] = np.unpackbits(body, axis=1, count=size * width, bitorder="little").reshape(len(own), size, width)
        values = np.packbits(bits, axis=2, bitorder="little").reshape(len(own), -1).view("<u4")
        for k, i in enumerate(own):
            least, _, n, _ = heads[i]
            at = int(starts[i]) + BLOCK_HEAD.size + long
            values[k, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
            out[ends[i] - size : ends[i]] = values[k] + np.uint32(least)
    return out


@dataclass
class Segment:
    """A segment's bytes, read by what is asked for."""

    data: bytes

    def __post_init__(self):
        magic, self.number, self.n_ids, self.n_docs, self.block, self.index, self.table = HEAD.unpack_from(self.data)
        if magic != MAGIC or self.data[-1:] != LAST or zlib.crc32(memoryview(self.data)[:-5]) != struct.unpack_from("<I", self.data, len(self.data) - 5)[0]:
            raise ValueError("not a whole segment of token ids")

    @property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self.data, "<i8", -(-self.n_ids // self.block), self.index)

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self.data, "<i8", self.n_docs, self.table)

    @property
    def doc_ids(self) -> list[int | None]:
        known = np.frombuffer(self.data, np.uint8, self.n_docs, self.table + 16 * self.n_docs)
        ids = np.frombuffer(self.data, "<i8", self.n_docs, self.table + 8 * self.n_docs)
        return [i if k else None for i, k in zip(ids.tolist(), known.tolist())]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from one place to another, by the blocks that hold them."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        first, last = start // self.block, -(-end // self.block)
        return unpacked(self.data, self.starts[first:last])[start - first * self.block : end - first * self.block]

    def documents(self, ids_at_a_time: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, some blocks at a time."""
        at, held, held_from = 0, np.empty(0, np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            if at + n > held_from + len(held):
                held, held_from = self.ids(at, at + max(n, ids_at_a_time)), at
            yield doc_id, at, held[at - held_from : at - held_from + n]
            at += n


def segment(number: int, doc_ids: list[int | None], ids: list[np.ndarray], block: int = BLOCK, shares: tuple[float, ...] = SHARES) -> bytes:
    """The segment of these documents, without its last byte."""
    all_ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    blocks = [b for k in range(0, len(all_ids), 256 * block) for b in packed(all_ids[k : k + 256 * block], block, shares)]
    ends = np.cumsum([HEAD.size, *map(len, blocks)], dtype="<i8")
    table = [np.array([len(x) for x in ids], "<i8"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], np.uint8)]
    parts = [HEAD.pack(MAGIC, number, len(all_ids), len(ids), block, int(ends[-1]), int(ends[-1]) + 8 * len(blocks)), *blocks, ends[:-1].tobytes(), *(t.tobytes() for t in table)]
    data = b"".join(parts)
    return data + struct.pack("<I", zlib.crc32(data))


def write(docs: DataFrame, path: str, vocabulary: str | None = None, closing_id: int = CLOSING_ID, segment_ids: int = SEGMENT, block: int = BLOCK, shares: tuple[float, ...] = SHARES) -> None:
    """Writes every text's ids, each with the closing id, in ascending order of doc_id."""
    place = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, doc_ids, ids, held = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(number, doc_ids, ids, block, shares)], pa.binary())], ["value"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                own = np.append(ids_of(text.as_py() or "", place), np.uint32(closing_id)).astype(np.uint32, copy=False)
                if ids and held + len(own) > segment_ids:
                    yield out()
                    number, doc_ids, ids, held = number + 1, [], [], 0
                doc_ids.append(doc_id)
                ids.append(own)
                held += len(own)
        if ids:
            yield out()

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    files = own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "value binary")
    files.select(F.col("value").cast("string")).write.option("lineSep", LAST.decode()).option("maxRecordsPerFile", 1).mode("append").text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the segments under the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: segment, doc_id, start (in its segment), n_tokens, ids_crc32, and with ``with_ids`` the ids."""
    columns = ROWS + ", ids array<long>" * with_ids
    kinds = pa.schema([(x.split()[0], pa.int64()) for x in ROWS.split(", ")] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                own, rows, held = Segment(content.as_py()), [], 0
                for doc_id, start, ids in own.documents():
                    rows.append((own.number, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int64)] if with_ids else [])))
                    held += len(ids)
                    if with_ids and held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return segments(spark, path).select("content").mapInArrow(run, columns)


def with_starts(documents: DataFrame) -> DataFrame:
    """Rows of ``read`` with ``start`` counted over all segments.

    A segment's number holds its writer's partition in the high bits.  Totals of partitions are
    summed up first, then those of the segments inside one, so no task gets a row for each segment.
    """
    own = documents.groupBy("segment").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.shiftright("segment", 32))
    parts = own.groupBy("part").agg(F.sum("n").alias("n"))
    all_before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(all_before, F.lit(0)).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    starts = own.select("part", "segment", F.coalesce(within, F.lit(0)).alias("within")).join(parts, "part").select("segment", (F.col("before") + F.col("within")).alias("before"))
    return documents.join(starts, "segment").withColumn("start", F.col("start") + F.col("before")).drop("before")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the files into the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    write(docs, where := storage.path(spark, "token_ids"), vocabulary)
    documents = storage.table(read(spark, where), "id_documents")
    return with_starts(documents).select("doc_id", "start", "n_tokens", "ids_crc32")
