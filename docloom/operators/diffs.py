"""Ordered differences of texts by lines, and differences of two versions of a graph.

Lines are matched by patience: in each open segment of a pair the lines that both ends share
are taken off, then lines that occur once on either side become anchors, of which a longest run
that rises on both sides is kept; the segments between anchors are open in the next round.
All segments of all pairs take a round together, so rounds are as many as the deepest nesting,
and each meets only lines that are not matched yet.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

SEGMENT = ["pair_id", "so", "eo", "sn", "en"]


def rising(values: list[int]) -> list[int]:
    """The places of a longest rising run of distinct numbers, by patience: the least end of each length, found by halving."""
    ends, places, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        before.append(places[k - 1] if k else -1)
        ends[k : k + 1], places[k : k + 1] = [v], [i]
    out, at = [], places[-1] if places else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _rising(values: Column) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: rising(x.tolist()))

    return F.pandas_udf(run, "array<int>")(values)


def _lines(pairs: DataFrame) -> DataFrame:
    """An open segment for each pair, a row for each line of either side: (SEGMENT, side, at, h)."""
    own = pairs.select("pair_id", *[F.split(F.coalesce(c, F.lit("")), "\n").alias(c) for c in ("old", "new")])
    ends = [F.lit(0).alias("so"), F.size("old").alias("eo"), F.lit(0).alias("sn"), F.size("new").alias("en")]
    each = [own.select("pair_id", *ends, F.lit(side).alias("side"), F.posexplode(c).alias("at", "line")) for side, c in enumerate(("old", "new"))]
    return each[0].unionByName(each[1]).select(*SEGMENT, "side", "at", F.unhex(F.sha2("line", 256)).alias("h"))


def matched_lines(pairs: DataFrame) -> DataFrame:
    """(pair_id, old, new) texts to (pair_id, o, n): the lines that stay, numbered from 0 and rising on both sides."""
    rows, found = storage.table(_lines(pairs), "open_lines"), []
    start, end = (F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("so", "sn"), ("eo", "en")))
    short = F.least(F.col("eo") - F.col("so"), F.col("en") - F.col("sn"))
    while not rows.isEmpty():
        # what both ends share
        offsets = F.array(F.struct(F.lit(0).alias("kind"), (F.col("at") - start).alias("off")), F.struct(F.lit(1).alias("kind"), (end - 1 - F.col("at")).alias("off")))
        met = rows.select(*SEGMENT, "h", F.explode(offsets).alias("p")).where(F.col("p.off") < short).groupBy(*SEGMENT, "p").agg((F.min("h") != F.max("h")).alias("differ"))
        first = lambda kind: F.min(F.when((F.col("p.kind") == kind) & F.col("differ"), F.col("p.off")))
        trims = met.groupBy(*SEGMENT).agg(first(0).alias("head"), first(1).alias("tail")).withColumn("head", F.coalesce("head", short))
        trims = trims.withColumn("tail", F.least(F.coalesce("tail", short), short - F.col("head")))
        trimmed = storage.table(rows.join(trims, SEGMENT, "left").fillna(0, ["head", "tail"]), "trimmed")
        ends = trimmed.where("side = 0 and (at < so + head or at >= eo - tail)")
        found.append(ends.select("pair_id", F.col("at").alias("o"), F.when(F.col("at") < F.col("so") + F.col("head"), F.col("at") - F.col("so") + F.col("sn")).otherwise(F.col("en") - F.col("eo") + F.col("at")).alias("n")))
        bounds = [(F.col(a) + F.col("head")).alias(a) if a[0] == "s" else (F.col(a) - F.col("tail")).alias(a) for a in SEGMENT[1:]]
        inner = trimmed.where((F.col("at") >= start + F.col("head")) & (F.col("at") < end - F.col("tail"))).select("pair_id", *bounds, "side", "at", "h").where("so < eo and sn < en")
        # lines that occur once on either side, and of these a longest run that rises on both
        of = lambda side: F.max(F.when(F.col("side") == side, F.col("at")))
        once = inner.groupBy(*SEGMENT, "h").agg(F.count("*").alias("c"), F.count_if(F.col("side") == 0).alias("c_old"), of(0).alias("o"), of(1).alias("n")).where("c = 2 and c_old = 1")
        runs = once.groupBy(*SEGMENT).agg(F.sort_array(F.collect_list(F.struct("o", "n"))).alias("a"))
        kept = runs.select(*SEGMENT, "a", F.explode(_rising(F.transform("a", lambda x: x["n"]))).alias("i"))
        anchors = storage.table(kept.select(*SEGMENT, F.get("a", "i").alias("a")).select(*SEGMENT, "a.o", "a.n"), "anchors")
        found.append(anchors.select("pair_id", "o", "n"))
        # the segments between anchors; one without anchors has nothing more to match
        sides = F.array(F.struct(F.lit(0).alias("side"), F.col("o").alias("at")), F.struct(F.lit(1).alias("side"), F.col("n").alias("at")))
        marks = anchors.select(*SEGMENT, F.struct("o", "n").alias("mark"), F.explode(sides).alias("s")).select(*SEGMENT, "mark", "s.*")
        w = Window.partitionBy(*SEGMENT, "side")
        to_here = lambda order: F.last("mark", ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        marked = inner.join(marks, [*SEGMENT, "side", "at"], "left").withColumns({"before": to_here(F.col("at")), "after": to_here(F.col("at").desc())})
        marked = marked.where("mark is null and (before is not null or after is not null)")
        low, high = lambda a, b: F.coalesce(F.col(f"before.{a}") + 1, F.col(b)).alias(b), lambda a, b: F.coalesce(F.col(f"after.{a}"), F.col(b)).alias(b)
        step = marked.select("pair_id", low("o", "so"), high("o", "eo"), low("n", "sn"), high("n", "en"), "side", "at", "h").where("so < eo and sn < en")
        superseded, rows = rows, storage.table(step, "open_lines")
        storage.free(superseded)
    return reduce(DataFrame.unionByName, found) if found else pairs.select("pair_id", F.lit(0).alias("o"), F.lit(0).alias("n")).limit(0)


def script(pairs: DataFrame) -> DataFrame:
    """(pair_id, op, old_start, old_len, new_start, new_len): runs that turn the old text into the new, in order of both.

    ``op`` is equal, delete, insert or replace; lines are counted from 0, a null text is the empty one, which has one empty line.
    """
    lines = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), "\n"))
    w = Window.partitionBy("pair_id").orderBy("o")
    own = matched_lines(pairs)
    apart = (F.col("o") - F.lag("o").over(w) != 1) | (F.col("n") - F.lag("n").over(w) != 1)
    runs = own.withColumn("new_run", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("new_run").over(w))
    runs = runs.groupBy("pair_id", "run").agg(F.min("o").alias("o"), F.min("n").alias("n"), F.count("*").cast("int").alias("len")).drop("run")
    runs = runs.unionByName(pairs.select("pair_id", lines("old").alias("o"), lines("new").alias("n"), F.lit(0).alias("len")))
    before = lambda c: F.coalesce(F.lag(F.col(c) + F.col("len")).over(w.orderBy("o", "n")), F.lit(0))
    runs = runs.withColumns({"po": before("o"), "pn": before("n")})
    run = lambda op, a, b, c, d: F.struct(op.alias("op"), a.alias("old_start"), b.alias("old_len"), c.alias("new_start"), d.alias("new_len"))
    o, n, po, pn, size = (F.col(c) for c in ("o", "n", "po", "pn", "len"))
    op = F.when(o == po, "insert").when(n == pn, "delete").otherwise("replace")
    both = F.array(F.when((o > po) | (n > pn), run(op, po, o - po, pn, n - pn)), F.when(size > 0, run(F.lit("equal"), o, size, n, size)))
    return runs.select("pair_id", F.explode(F.array_compact(both)).alias("r")).select("pair_id", "r.*")


def patched(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """(pair_id, text, old_lines, new_lines): the old text with the script applied, and how many lines of either side the script covers."""
    by = runs.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("new_start", "old_start", "op", "old_len", "new_len"))).alias("runs"), F.sum("old_len").alias("old_lines"), F.sum("new_len").alias("new_lines"))
    sides = {c: F.split(F.coalesce(c, F.lit("")), "\n") for c in ("old", "new")}
    part = lambda r: F.when(r["op"] == "equal", F.slice("old", r["old_start"] + 1, r["old_len"])).otherwise(F.slice("new", r["new_start"] + 1, r["new_len"]))
    return pairs.withColumns(sides).join(by, "pair_id").select("pair_id", F.array_join(F.flatten(F.transform("runs", part)), "\n").alias("text"), "old_lines", "new_lines")


# --- versions of a graph ---


def summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (doc_id, id, node_type, props) of two versions to a row for each document: counts of changes, of pages' changes, and the similarity.

    A node that only one version has is a change of structure, one whose properties differ of
    content; similarity is one less the share of changes in the old version's nodes and pages and ten.
    """
    keys = ["doc_id", "id"]
    side = lambda df, s: df.select(*keys, F.col("node_type").alias(f"type_{s}"), F.sort_array(F.map_entries("props")).alias(f"props_{s}"))
    both = side(old, "o").join(side(new, "n"), keys, "full")
    added, removed = F.col("type_o").isNull(), F.col("type_n").isNull()
    differs = ~added & ~removed & ((F.col("type_o") != F.col("type_n")) | (F.col("props_o") != F.col("props_n")))
    page = F.coalesce("type_n", "type_o") == "Page"
    by = both.groupBy("doc_id").agg(
        F.count_if(added | removed).alias("structure"), F.count_if(differs).alias("content"),
        F.count_if(page & added).alias("pages_added"), F.count_if(page & removed).alias("pages_removed"), F.count_if(page & differs).alias("pages_modified"),
        (F.count_if(~added) + F.count_if(~added & (F.col("type_o") == "Page")) + 10).alias("items"),
    )
    changes = F.col("structure") + F.col("content") + F.col("pages_added") + F.col("pages_removed") + F.col("pages_modified")
    return by.withColumn("changes", changes).withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("changes") / F.col("items"))).drop("items")


#: The lines of a report and the numbers that they give.
REPORT = {"Total Changes": "changes", "Structure Changes": "structure", "Content Changes": "content", "Pages Added": "pages_added", "Pages Removed": "pages_removed", "Pages Modified": "pages_modified"}


def report(changes: DataFrame) -> DataFrame:
    """(doc_id, report): the rows of ``summary`` as text."""
    share: Column = F.concat(F.lit("Similarity Score: "), F.format_string("%.2f", F.col("similarity") * 100), F.lit("%"))
    return changes.select("doc_id", F.concat_ws("\n", share, *[F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in REPORT.items()]).alias("report"))
