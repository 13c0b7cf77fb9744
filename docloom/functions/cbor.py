"""Maps of strings as CBOR (RFC 8949), and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: major types of text and of maps.
TEXT, MAP = 3, 5


def _head(major: int, n: Column) -> Column:
    """A type and a size, in the fewest bytes."""
    first = lambda info: F.lit(major << 5) + info
    text = (
        F.when(n < 24, F.format_string("%02x", first(n)))
        .when(n < 1 << 8, F.format_string("%02x%02x", first(F.lit(24)), n))
        .when(n < 1 << 16, F.format_string("%02x%04x", first(F.lit(25)), n))
        .otherwise(F.format_string("%02x%08x", first(F.lit(26)), n))
    )
    return F.unhex(text)


def _text(value: Column) -> Column:
    return F.concat(_head(TEXT, F.octet_length(value)), value.cast("binary"))


def encoded(props: Column) -> Column:
    """A map of strings as CBOR, entries in order of their keys; null values are the simple value null."""
    entries = F.array_sort(F.map_entries(props))
    value = lambda v: F.when(v.isNull(), F.lit(b"\xf6")).otherwise(_text(v))
    body = F.aggregate(entries, F.lit(b""), lambda a, e: F.concat(a, _text(e["key"]), value(e["value"])))
    return F.concat(_head(MAP, F.size(props)), body)


def _number(content: Column, at: Column, size: int) -> Column:
    """An unsigned number of so many bytes; 0 where they are not there."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(content, at + 1, F.lit(size))), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long"))


def decoded(content: Column) -> Column:
    """A map of strings from CBOR; null for anything else: other types, indefinite lengths, bytes too few or too many, or keys that occur twice."""

    def head(at: Column) -> tuple[Column, Column, Column]:
        """The major type at a place, its size, and where what follows begins."""
        first = _number(content, at, 1)
        info = first.bitwiseAND(F.lit(31))
        size = F.when(info < 24, info).when(info == 24, _number(content, at + 1, 1)).when(info == 25, _number(content, at + 1, 2)).when(info == 26, _number(content, at + 1, 4)).otherwise(F.lit(-1))
        width = F.when(info < 24, 1).when(info == 24, 2).when(info == 25, 3).otherwise(5)
        return F.shiftright(first, 5), size.cast("long"), (at + width).cast("int")

    zero = F.lit(0)
    major, n, begin = head(zero)
    state = lambda at, values, good: F.struct(at.cast("int").alias("at"), values.alias("values"), good.alias("good"))

    def step(s: Column, i: Column) -> Column:
        kind, size, start = head(s["at"])
        null = (_number(content, s["at"], 1) == 0xF6) & (i % 2 == 0)
        text = F.try_validate_utf8(F.substring(content, start + 1, size.cast("int")).cast("string"))
        good = s["good"] & (null | (kind == TEXT) & (size >= 0) & (start + size <= F.octet_length(content)) & text.isNotNull())
        return F.when(good, state(F.when(null, s["at"] + 1).otherwise(start + size), F.concat(s["values"], F.array(F.when(~null, text))), F.lit(True))).otherwise(state(s["at"], s["values"], F.lit(False)))

    right = (major == MAP) & (n >= 0) & (2 * n <= F.octet_length(content))
    places = F.when(right & (n > 0), F.sequence(F.lit(1), (2 * n).cast("int"))).otherwise(F.array().cast("array<int>"))
    read = F.aggregate(places, state(begin, F.array().cast("array<string>"), right), step)
    keys, values = (F.filter(read["values"], lambda _, i: i % 2 == k) for k in (0, 1))
    whole = read["good"] & (read["at"] == F.octet_length(content)) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(whole, F.map_from_arrays(F.when(whole, keys).otherwise(F.array().cast("array<string>")), F.when(whole, values).otherwise(F.array().cast("array<string>"))))
