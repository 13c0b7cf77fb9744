"""Elements of pages as rows, by a table function over a partitioned table."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never hold others.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
COLUMNS = "page_id: bigint, node: bigint, parent: bigint, tag: string, depth: bigint"


class _Elements(HTMLParser):
    """Numbers elements as their tags begin; an end tag closes the innermost of its name and what is left open in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int | None, str, int]] = []
        self.open: list[tuple[str, int]] = []
        self.count: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        parent = self.open[-1][1] if self.open else None
        self.rows.append((len(self.rows), parent, tag, len(self.open)))
        if tag not in VOID:
            self.open.append((tag, len(self.rows) - 1))
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        parent = self.open[-1][1] if self.open else None
        self.rows.append((len(self.rows), parent, tag, len(self.open)))

    def handle_endtag(self, tag: str) -> None:
        while self.count.get(tag):
            name, _ = self.open.pop()
            self.count[name] -= 1
            if name == tag:
                break


def elements(html: str | None) -> list[tuple[int, int | None, str, int]]:
    """(node, parent, tag, depth) of each element of a page, in order."""
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    return parser.rows


class Dom:
    """The table function: rows of (page_id, html) in, a row for each element out."""

    def eval(self, row) -> Iterator[tuple]:
        for node, parent, tag, depth in elements(row["html"]):
            yield row["page_id"], node, parent, tag, depth


def dom(pages: DataFrame) -> DataFrame:
    """(page_id, html) to (page_id, node, parent, tag, depth); nodes count from 0 within a page, a topmost element has no parent.

    The table is partitioned by page, so the function's input is dealt out and each page is whole.
    An empty or null html has no elements.
    """
    function = F.udtf(Dom, returnType=COLUMNS)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return function(own.asTable().partitionBy("page_id"))
