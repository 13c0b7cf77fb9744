"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def search(rows: DataFrame, key: str, text: str, wanted: str) -> DataFrame:
    """(key, line_no, line) of lines that contain the wanted text, in either case; lines count from 0."""
    each = rows.select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    return each.where(F.lower("line").contains(wanted.lower()))


def index_terms(text: Column, least_bytes: int = 3, most: int = 100) -> Column:
    """The first so many words of so many bytes, in lower case and order."""
    long = F.filter(words(text), lambda w: F.octet_length(w) >= least_bytes)
    return F.transform(F.slice(long, 1, most), F.lower)


def content_type(text: Column) -> Column:
    """The first of some kinds of content whose marks the text holds."""
    start = F.ltrim(text)
    return (
        F.when(start.startswith("<"), "markup")
        .when(start.startswith("{") | start.startswith("["), "data")
        .when(text.contains("http://") | text.contains("https://"), "links")
        .when(text.contains("function") | text.contains("eval"), "script")
        .otherwise("text")
    )


def tokens(text: Column, pattern: str = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9 \\n\\t\\r]") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def without_slash(name: Column) -> Column:
    return F.regexp_replace(name, "^/", "")


def unescaped_name(name: Column) -> Column:
    """#xx escapes resolved; a broken one leaves the name as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")), "#([0-9A-Fa-f]{2})", "%$1")), name)


def integer(text: Column) -> Column:
    """A signed whole number, null if it is none or too large."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def real(text: Column) -> Column:
    """A signed decimal without an exponent."""
    return F.when(text.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), text.try_cast("double"))


def decoded(content: Column) -> Column:
    """UTF-16 with a byte order mark, else UTF-8 with broken bytes replaced."""
    mark = F.hex(F.substring(content, 1, 2))
    wide = lambda name: F.decode(F.substring(content, 3, 2**31 - 1), name)
    return F.when(mark == "FEFF", wide("UTF-16BE")).when(mark == "FFFE", wide("UTF-16LE")).otherwise(F.make_valid_utf8(content.cast("string")))
