"""Page programs and laid-out text.

A program is a postfix sequence: operands, then an operator.  It becomes a row for each
operator by cutting it into symbols and grouping operands under the operator that follows.
Programs are short and many, so arrays within a row serve in place of windows over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operators by what they do.
GROUPS = {
    "text object": ["BT", "ET"],
    "text state": ["Tc", "Tw", "Tz", "TL", "Tf", "Tr", "Ts"],
    "text position": ["Td", "TD", "Tm", "T*"],
    "text show": ["Tj", "TJ", "'", '"'],
    "path build": ["m", "l", "c", "v", "y", "h", "re"],
    "path paint": ["S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"],
    "clipping": ["W", "W*"],
    "graphics state": ["w", "J", "j", "M", "d", "ri", "i", "q", "Q", "cm", "gs"],
    "marked content": ["BMC", "BDC", "EMC", "MP", "DP"],
    "colour": ["CS", "cs", "SC", "SCN", "sc", "scn", "G", "g", "RG", "rg", "K", "k"],
    "objects": ["Do", "sh"],
    "inline image": ["BI", "ID", "EI"],
    "glyph metrics": ["d0", "d1"],
    "compatibility": ["BX", "EX"],
}
SYMBOL = r"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|<<|>>|\[|\]|/[^\s()<>\[\]/%]*|[^\s()<>\[\]/%]+"
OPERAND = r"^(?:[(<\[/\]>].*|[+-]?[0-9]*\.?[0-9]+|[+-]?[0-9]+\.|true|false|null)$"


def operations(programs: DataFrame, key: str = "doc_id", text: str = "program") -> DataFrame:
    """(key, ord, op, operands, group) of each operator, in order; operands that no operator follows are left out."""
    symbols = programs.select(key, F.regexp_extract_all(F.regexp_replace(text, "%[^\\r\\n]*", ""), F.lit(SYMBOL), F.lit(0)).alias("s"))
    at = symbols.withColumn("ends", F.filter(F.transform("s", lambda x, i: F.when(~x.rlike(OPERAND), i)), lambda i: i.isNotNull()))
    each = at.select(key, "s", "ends", F.posexplode("ends").alias("ord", "end"))
    before = F.when(F.col("ord") > 0, F.get("ends", F.col("ord") - 1)).otherwise(F.lit(-1))
    names = F.create_map(*[x for g, ops in GROUPS.items() for op in ops for x in (F.lit(op), F.lit(g))])
    op = F.get("s", F.col("end"))
    return each.select(key, "ord", op.alias("op"), F.slice("s", before + 2, F.col("end") - before - 1).alias("operands"), F.coalesce(F.try_element_at(names, op), F.lit("unknown")).alias("group"))


def shown_text(ops: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the strings that a program shows, in order, joined by spaces."""
    shows = ops.where(F.col("group") == "text show")
    strings = F.array_join(F.transform(F.filter("operands", lambda x: x.startswith("(")), lambda x: F.regexp_replace(x, "^\\(|\\)$", "")), "")
    parts = shows.select(key, "ord", F.regexp_replace(strings, "\\\\([()\\\\])", "$1").alias("t"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda p: p["t"]), " ").alias("text"))


def nesting(ops: DataFrame, begin: list[str], end: list[str], key: str = "doc_id") -> DataFrame:
    """Operations with ``depth``: how many of the begin operators are open, itself included."""
    step = F.when(F.col("op").isin(*begin), 1).when(F.col("op").isin(*end), -1).otherwise(0)
    return ops.withColumn("depth", F.sum(step).over(Window.partitionBy(key).orderBy("ord")))


def carried(ops: DataFrame, op: str, key: str = "doc_id") -> DataFrame:
    """Operations with ``state``: the operands of the last such operator up to each."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return ops.withColumn("state", F.last(F.when(F.col("op") == op, F.col("operands")), ignorenulls=True).over(w))


def text_lines(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, line, text, x, y) of spans (by, x, y, width, height, space, text): a line ends at a step down or a wide gap."""
    w = Window.partitionBy(*by).orderBy("y", "x", "text")
    last = lambda c: F.lag(c).over(w)
    step = (F.abs(F.col("y") - last("y")) > last("height") * 0.3) | (F.col("x") - (last("x") + last("width")) >= last("space") * 3)
    marked = spans.withColumn("_new", F.coalesce(step.cast("int"), F.lit(1)))
    numbered = marked.withColumn("line", F.sum("_new").over(w))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "text"))), lambda p: p["text"]), " ")
    return numbered.groupBy(*by, "line").agg(joined.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"))


def mapped_codes(codes: DataFrame, singles: DataFrame, ranges: DataFrame, key: str = "code") -> DataFrame:
    """Codes with their character: a single mapping first, else the first range that holds the code."""
    own = codes.join(singles.select(key, F.col("char").alias("_one")), key, "left")
    steps = ranges.select(F.explode(F.sequence("low", "high")).alias(key), "low", "start")
    spread = steps.groupBy(key).agg(F.min_by(F.col("start") + F.col(key) - F.col("low"), "low").alias("_point"))
    return own.join(spread, key, "left").withColumn("char", F.coalesce("_one", F.when(F.col("_point").isNotNull(), F.char("_point")))).drop("_one", "_point")


def properties_of(namespace: str, properties: Column) -> Column:
    """The entries of a map of prefixed names that have the prefix."""
    return F.map_filter(properties, lambda k, v: k.startswith(f"{namespace}:"))


def confidence(fragments: Column, mean: Column, recovered: Column, rebuilt: Column) -> Column:
    """How far a reconstruction is to be trusted, from 0 to 1."""
    return F.when(fragments == 0, 0.0).otherwise(F.least(F.lit(1.0), (mean + recovered / fragments) / 2 + F.when(rebuilt, 0.2).otherwise(0.0)))
