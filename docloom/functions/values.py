"""Dates, numbers, maps and codecs as column expressions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stamped(date: Column) -> Column:
    """A ``D:yyyyMMddHHmmss`` text as a timestamp; anything else is null.  A zone after it is ignored."""
    digits = F.regexp_extract(date, "^D:([0-9]{14})", 1)
    return F.when(digits != "", F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def exponential(x: Column, c0: float, c1: float, n: float, low: float, high: float) -> Column:
    """c0 + x ** n * (c1 - c0), held within the range."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c0 + F.pow(x, F.lit(n)) * (c1 - c0)))


def stitched(x: Column, bounds: list[float], pieces: list[tuple[float, float]], domain: tuple[float, float]) -> Column:
    """Piecewise linear: between two bounds x is mapped onto the piece's ends."""
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for (low, high), (a, b), last in zip(zip(edges, edges[1:]), pieces, [False] * (len(pieces) - 1) + [True]):
        value = a + (x - low) * ((b - a) / (high - low) if high > low else 0.0)
        if last:
            return value if out is None else out.otherwise(value)
        out = F.when(x < high, value) if out is None else out.when(x < high, value)
    raise ValueError("no piece")


def map_of_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def content_hash(kind: Column, props: Column) -> Column:
    """A digest of a node's type and properties that does not depend on their order."""
    return F.sha2(F.concat(kind, F.lit("|"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(props))))), 256)


@F.pandas_udf(T.BinaryType())
def inflate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Zlib data as it was; what can be read of broken data."""
    for data in parts:
        yield data.map(_inflate, na_action="ignore")


def _inflate(data: bytes) -> bytes:
    engine, out = zlib.decompressobj(), []
    try:
        out = [engine.decompress(data), engine.flush()]
    except zlib.error:
        pass
    return b"".join(out)


@F.pandas_udf(T.BinaryType())
def deflate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in parts:
        yield data.map(zlib.compress, na_action="ignore")


def ascii_hex(text: Column) -> Column:
    """Hex text up to ``>`` as bytes, white space ignored, an odd digit padded with 0."""
    digits = F.regexp_replace(F.substring_index(text, ">", 1), "[\\s<]", "")
    return F.try_to_binary(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits), F.lit("hex"))
