"""WARC archives: a deduplicating writer and a salvage reader.

The writer is DataFrame code: of pages with equal payloads the one with the largest id is
a ``response``, the others are ``revisit`` records without a payload.  Records are written by Spark's own
text writer, whose line separator is the format's record terminator, so files can lie in
any store that Spark reaches and a task that runs again replaces its own file.

The reader takes whole files.  Those of the writer hold a bounded number of bytes: pages
are written by classes of size, larger pages fewer to a file.  The reader checks each
record's length, terminator and digest.  Where a check fails it searches for the next
version line or gzip member that begins a valid record, goes on from there, and logs the bytes
between as a quarantined gap.  A gzip member is fed to the engine in blocks, so its cost is its own
length, and one that grows beyond ``most_member`` bytes fails its check.  After a failed check each mark is
searched only once it has been passed, so false marks cost no more than their own bytes.

Defined cases: a null html is the empty payload; a null page_id is the smallest, and a
null url is not written; rows that share a page_id and a payload are all responses if
that id is the largest; a payload may hold anything, lines that look like records too; an
empty table gives an empty result; a page of 2 GB or more fails, as Spark's own reader of whole files does; other columns
of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: Bytes of a file at most, about, and records; a page larger than that has a file of its own.
FILE_BYTES, RECORDS_PER_FILE = 128 << 20, 2000
#: A gzip member's length at most once it is uncompressed, and the bytes that are fed to the engine at a time.
MOST_MEMBER, FED = 1 << 30, 1 << 16
#: Fixed values of the format.
VERSION, TERMINATOR = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MARKS = (b"WARC/1.", b"\x1f\x8b\x08")
ONCE = frozenset(("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"))
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four digits of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) with digest, and refers_to for the revisits of equal payloads of at least so many bytes.

    Payloads that occur once are left out of the table that pages are joined with; it is
    written first, so Spark knows its size when it chooses the join.
    """
    url = F.col("url").cast("string") if "url" in {c.lower() for c in pages.columns} else F.lit(None).cast("string")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    size = [F.col("size_class")] if "size_class" in pages.columns else []
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), *size)
    own = own.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    groups = own.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("kept"))
    shared = storage.table(groups.where("copies > 1 and kept is not null").select("digest", "kept"), "payloads")
    refers = F.when((F.col("page_id") < F.col("kept")) | F.col("page_id").isNull(), F.col("kept"))
    return own.join(shared, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"), *size)


def record_text(least_date: str = "2024-01-01T00:00:00Z") -> Column:
    """A record, without its terminator, from the columns of ``deduplicated``."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(HTTP_HEAD), F.octet_length("html"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    page = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", page("page_id")),
        line("WARC-Date", F.lit(least_date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, page("refers_to"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each page into archive files under the path.

    A class holds pages of up to a power of 16 times the bytes that ``records_per_file``
    pages of a full file have each; it is written by itself, so that no file of many large pages arises.
    """
    least = max(1, file_bytes // records_per_file)
    url = F.octet_length("url") if "url" in {c.lower() for c in pages.columns} else F.lit(0)
    long = F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(url, F.lit(0))
    size = F.ceil(F.log2(F.greatest(long / least, F.lit(1.0))) / 4).cast("int")
    found = sorted(r[0] for r in pages.select(size.alias("size")).distinct().collect())  # a handful
    records = deduplicated(pages.withColumn("size_class", size), least_bytes)
    for k in found or [0]:
        own = records.where(F.col("size_class") == k).select(record_text().alias("value"))
        own.write.option("lineSep", TERMINATOR).option("maxRecordsPerFile", max(1, records_per_file >> 4 * k)).mode("append").text(path)


@dataclass
class Record:
    """A record that passed its checks; payload is None for a revisit, whose size its HTTP head gives."""

    start: int
    end: int
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _plain(data: bytes, at: int) -> Record | None:
    """The uncompressed record that begins there, if it passes its checks."""
    if not data.startswith(b"WARC/1.", at):
        return None
    if data[at : at + 10] not in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"):
        return None
    headers: dict[str, str] = {}
    start = at + 10
    while True:  # as far as the lines are headers, however long they are
        line_end = data.find(b"\r\n", start)
        if line_end < 0:
            return None
        line, start = data[start:line_end].decode("utf-8", "replace"), line_end + 2
        if not line:
            break
        key, colon, value = line.partition(":")
        if line[:1] in " \t":  # a folded line
            continue
        key = key.strip().lower()
        if not colon or key in ONCE and key in headers:  # another record's head has run into this one
            return None
        headers[key] = value.strip()
    size = _number(headers.get("content-length"))
    if size is None or data[start + size : start + size + 4] != b"\r\n\r\n":
        return None
    block = data[start : start + size]
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        head, blank, payload = block.partition(b"\r\n\r\n")
        stated = next((x[15:].strip() for x in head.decode("latin-1").split("\r\n") if x[:15].lower() == "content-length:"), None)
        if not blank or (length := _number(stated)) is None:
            return None
    else:
        length = size
    if headers.get("warc-type") == "revisit":
        return Record(at, start + size + 4, headers, None, length)
    digest = headers.get("warc-payload-digest", "")
    if length != len(payload) or digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        return None
    return Record(at, start + size + 4, headers, payload, length)


def _member(data: bytes, at: int, most_member: int | None) -> list[Record] | None:
    """The records of the gzip member that begins there, if it and all of them pass."""
    engine, fed, blocks, size = zlib.decompressobj(31), at, [], 0
    try:
        while not engine.eof and (fed < len(data) or engine.unconsumed_tail):
            rest = engine.unconsumed_tail
            block = rest or data[fed : fed + FED]
            fed += 0 if rest else len(block)
            blocks.append(engine.decompress(block, 16 * FED))
            size += len(blocks[-1])
            if most_member is not None and size > most_member:
                return None
    except zlib.error:
        return None
    if not engine.eof:
        return None
    inner, end, out, k = b"".join(blocks), fed - len(engine.unused_data), [], 0
    while k < len(inner):
        record = _plain(inner, k)
        if record is None:
            return None
        k = record.end
        out.append(Record(at, end, record.headers, record.payload, record.payload_bytes))
    return out or None


def salvage(data: bytes, most_member: int | None = None) -> Iterator[Record | tuple[int, int]]:
    """The records of an archive file in order, and (start, end) of each quarantined gap."""
    at, gap, most_member = 0, None, MOST_MEMBER if most_member is None else most_member
    places = {mark: -1 for mark in MARKS}  # the next place of each, searched again only once it is passed
    while at < len(data):
        found = _member(data, at, most_member) if data.startswith(b"\x1f\x8b\x08", at) else [r] if (r := _plain(data, at)) else None
        if found:
            if gap is not None:
                yield gap, at
                gap = None
            yield from found
            at = found[-1].end
            continue
        gap = at if gap is None else gap
        for mark in MARKS:
            if places[mark] <= at:
                place = data.find(mark, at + 1)
                places[mark] = place if place >= 0 else len(data)
        at = min(places.values())
    if gap is not None:
        yield gap, len(data)


def read(spark: SparkSession, path: str, payloads: bool = False, most_member: int | None = None) -> DataFrame:
    """A row for each record and each gap of the archive files under the path.

    Returns file, start, end, record_type (null for a gap), page_id, refers_to, url,
    payload_bytes, payload_digest, and with ``payloads`` the payload.
    """
    page = lambda text: int(text[12:-1]) if text and text.startswith("<urn:x-page:") and text[12:-1].lstrip("-").isdigit() else None
    schema = "file string, start long, end long, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])

    def row(file: str, x: Record | tuple[int, int]) -> tuple:
        if isinstance(x, tuple):
            return (file, *x, *[None] * 7)
        h = x.headers
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return (file, x.start, x.end, h.get("warc-type"), page(h.get("warc-record-id")), page(h.get("warc-refers-to")), h.get("warc-target-uri"), x.payload_bytes, digest, x.payload if payloads else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = [row(file.as_py(), x) for x in salvage(content.as_py(), most_member)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def quarantine(records: DataFrame, path: str) -> DataFrame:
    """Writes the gaps among read records (file, start, end) to a table of their own; returns the records without them."""
    records.where("record_type is null").select("file", "start", "end").write.mode("append").parquet(path)
    return records.where("record_type is not null")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes archives of the pages into the shared folder and returns a row for each record read back; a gap is an error."""
    write(pages, where := storage.path(pages.sparkSession, "warc"), least_bytes)
    lost = F.raise_error(F.concat_ws(" ", F.lit("a record was not read back:"), "file", "start", "end"))
    records = read(pages.sparkSession, where).withColumn("record_type", F.coalesce("record_type", lost.cast("string")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
