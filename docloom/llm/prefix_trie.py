"""The prefix trie of conversations, by binary search for owned chains.

Every prefix of a conversation has a digest, and a digest is owned by the smallest conversation
that has it.  A conversation that owns a prefix owns all its longer ones too, so its first owned
depth is found by binary search: each round asks one depth of every conversation that is still
open, in one join with its prefixes and one with the minima of shared digests.  From the first
owned depth to its end a conversation is a chain of nodes; the chain hangs from the owner of the
prefix before it.  Chains form a tree, whose sums go bottom-up by doubling: after k rounds a chain
holds the sums of all chains less than 2 ** k below it, so the rounds are the logarithm of the
tree's height, and a node's sums are those from it to its chain's end.

No text is shuffled, only a digest and a count of words for each turn.  Turns are ranked by a
range sort, and running values inside a conversation are worked out by blocks with the blocks'
totals before them, so that one conversation with a large part of all rows is many tasks' work.

Defined cases: a null conv_id takes no part; a null role or text is the empty string; turns are
ordered by number, null first, those of one number by the digest of role and text; repeated rows
are turns like others; a conversation without turns after rebuilding ends at the root; a negative
id's remainder has its sign; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

#: A conversation's head comes from that whose id is the next lower multiple of this, and has fewer turns than that.
FAMILY, HEADS = 20, 4
#: Depths of a chain that are summed in one window, and conversation ids of a block of ends, as powers of two.
DEPTHS, ENDS = 10, 12


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, p, t, w): each turn's place from 1, the digest of role and text, and the text's words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("t"), words.alias("w"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t")]
    ranked = own.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = ranked.select("conv_id", "t", "w", F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("i"))
    turns = storage.table(ranked, "turns")
    counts = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("conv_id", "block", before.alias("before")).where("before is not null")
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("i")).cast("long")
    placed = turns.withColumn("within", within).join(counts, ["conv_id", "block"], "left")
    return placed.select("conv_id", "block", (F.col("within") + F.coalesce("before", F.lit(0))).alias("p"), "t", "w")


def own_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, block, depth, t, w) and the lengths (conv_id, len)."""
    return turns.withColumnRenamed("p", "depth"), turns.groupBy("conv_id").agg(F.max("p").alias("len"))


def rebuilt_turns(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first h turns of their family's first conversation in place of their own first h; h is the id's CRC-32 modulo ``heads``."""
    h = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    conv = F.col("conv_id")
    lengths = turns.groupBy("conv_id").agg(F.max("p").alias("own")).withColumns({"h": h(conv), "base": conv - conv % family})
    first = turns.where((conv % family == 0) & (F.col("p") < heads)).groupBy(conv.alias("base")).agg(F.sort_array(F.collect_list(F.struct("p", "t", "w"))).alias("first"))
    joined = lengths.join(first, "base", "left").withColumn("first", F.coalesce(F.slice("first", 1, F.col("h").cast("int")), F.array()))
    joined = storage.table(joined.select("conv_id", "own", "h", "first", F.size("first").cast("long").alias("m")), "heads")
    head = joined.select("conv_id", F.lit(-1).cast("long").alias("block"), F.explode("first").alias("f")).select("conv_id", "block", F.col("f.p").alias("depth"), "f.t", "f.w")
    short = joined.where("m < h").select("conv_id", (F.col("h") - F.col("m")).alias("short"))
    rest = turns.where(F.col("p") > h(conv)).join(short, "conv_id", "left")
    rest = rest.select("conv_id", "block", (F.col("p") - F.coalesce("short", F.lit(0))).alias("depth"), "t", "w")
    return head.unionByName(rest), joined.select("conv_id", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))


def running(rows: DataFrame, key: str, order: Column, values: list[str], fold, plus) -> DataFrame:
    """The values folded from the first row of a key to each row, in ``order``: within a block, and with the totals of the blocks before it."""
    whole = Window.partitionBy(key, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "block").agg(*[fold(v).alias(v) for v in values])
    totals = totals.select(key, "block", *[fold(v).over(earlier).alias(f"before_{v}") for v in values]).where(f"before_{values[0]} is not null")
    own = rows.withColumns({v: fold(v).over(whole) for v in values}).join(totals, [key, "block"], "left")
    return own.withColumns({v: plus(F.col(v), F.coalesce(F.col(f"before_{v}"), F.lit(0))) for v in values}).drop(*[f"before_{v}" for v in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, w): two words of each prefix's digest, which fold the turns' digests with their depths."""
    parts = turns.select("conv_id", "block", "depth", "w", F.xxhash64("depth", "t").alias("x"), F.xxhash64("t", "depth").alias("y"))
    found = running(parts, "conv_id", F.col("depth"), ["x", "y"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return found.select("conv_id", "depth", "x", "y", "w")


def first_owned(lengths: DataFrame, known: DataFrame, nodes: DataFrame, root: int) -> DataFrame:
    """(conv_id, len, first, above): the least depth that each conversation owns (len + 1 if none), and the owner of the depth before it.

    Depth ``low`` is not owned, ``high`` is; the root counts as nobody's.  A digest that only one
    conversation has is not among the shared ones, so the asker owns it.
    """
    shared = nodes.where("n_convs > 1").select("x", "y", "depth", "owner")
    state = lengths.select("conv_id", "len", F.lit(0).cast("long").alias("low"), (F.col("len") + 1).alias("high"), F.lit(root).cast("long").alias("above"))
    state, done = storage.table(state, "search"), []
    while True:
        open_ = F.col("high") - F.col("low") > 1
        done.append(state.where(~open_))
        if state.where(open_).isEmpty():
            break
        asked = state.where(open_).withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        asked = asked.join(known.select("conv_id", "depth", "x", "y"), ["conv_id", "depth"]).join(shared, ["x", "y", "depth"], "left")
        owned = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        step = asked.select("conv_id", "len", F.when(owned, F.col("low")).otherwise(F.col("depth")).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(owned, F.col("above")).otherwise(F.col("owner")).alias("above"))
        state = storage.table(step, "search")
    return storage.table(reduce(DataFrame.unionByName, done).select("conv_id", "len", F.col("high").alias("first"), "above"), "owned")


def totals_below(chains: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, parent, values) to (conv_id, values), summed over each chain and all below it, by doubling.

    A row's ``up`` is the chain 2 ** k above it: what it holds is added there, and then it looks twice as far.
    """
    state = storage.table(chains.select("conv_id", F.col("parent").alias("up"), *values), "sums")
    while not (climbing := state.where("up is not null")).isEmpty():
        gained = climbing.groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        further = climbing.select("conv_id", "up").join(state.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up").where("next is not null").select("conv_id", "next")
        step = state.drop("up").join(gained, "conv_id", "left").join(further, "conv_id", "left")
        step = step.select("conv_id", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(F.col(f"more_{v}"), F.lit(0))).alias(v) for v in values])
        superseded, state = state, storage.table(step, "sums")
        storage.free(superseded)
    return state.select("conv_id", *values)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, depth, conv_id) to (node, depth, ends_sha256): the digest of the ids in order, joined by commas.

    Ids are joined by blocks of 4,096 numbers; a node's blocks then pass through one digest as a
    stream, so that a node where most conversations end takes the memory of one block.
    """
    block = F.shiftright("conv_id", ENDS)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("node", "depth", block.alias("block")).agg(joined.alias("ids"))
    blocks = blocks.repartition("node", "depth").sortWithinPartitions("node", "depth", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for node, depth, ids in zip(batch["node"].to_pylist(), batch["depth"].to_pylist(), batch["ids"]):
                if (node, depth) != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (node, depth), hashlib.sha256(ids.as_py().encode())
                else:
                    digest.update(b"," + ids.as_py().encode())
            yield _rows(out)
        if at:
            yield _rows([(*at, digest.hexdigest())])

    return blocks.select("node", "depth", "ids").mapInArrow(run, "node long, depth long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["node", "depth", "ends_sha256"])


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node of the conversations' prefix trie.

    Takes (conv_id, block, depth, t, w) and (conv_id, len), as ``rebuilt_turns`` and ``own_turns`` give
    them; returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.
    """
    spark = turns.sparkSession
    lengths = storage.table(lengths, "lengths")
    least, n_all = lengths.agg(F.min("conv_id"), F.count("*")).first()
    if not n_all:
        columns = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], columns)
    known = storage.table(prefixes(turns), "prefixes")
    nodes = known.groupBy("x", "y", "depth").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("w").alias("w"))
    nodes = storage.table(nodes, "nodes")
    found = first_owned(lengths, known, nodes, least)
    chains = found.where("first <= len").withColumn("parent", F.when(F.col("first") > 1, F.col("above")))

    # chains bottom-up: a chain's own saving, and a leaf where nothing hangs from its end
    hung = chains.groupBy("above", (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n_hung"))
    hung = storage.table(hung, "hung")  # of the root: depth 0
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("w")).alias("saved"))
    ended = hung.select(F.col("above").alias("conv_id"), F.col("depth").alias("len"), F.lit(0).cast("long").alias("leaf"))
    sums = chains.join(own, "conv_id").join(ended, ["conv_id", "len"], "left").withColumn("leaves", F.coalesce("leaf", F.lit(1)).cast("long"))
    below = totals_below(sums.select("conv_id", "parent", "saved", "leaves"), ["saved", "leaves"])
    below = storage.table(chains.join(below, "conv_id").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n_hung"), F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves")), "below")

    # nodes: what each adds itself, summed from the chain's end up
    ends = found.select(F.when(F.col("first") <= F.col("len"), F.col("conv_id")).otherwise(F.col("above")).alias("node"), F.col("len").alias("depth"), "conv_id")
    digests = storage.table(ends_digests(ends), "ends")
    rows = nodes.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "w").join(chains.select("conv_id", "len", "first", "above"), "conv_id")
    rows = rows.join(below.where("depth > 0"), ["conv_id", "depth"], "left").fillna(0, ["n_hung", "hung_saved", "hung_leaves"])
    more = F.col("depth") < F.col("len")
    saved = (F.col("n_convs") - 1) * F.col("w") + F.col("hung_saved")
    leaves = F.col("hung_leaves") + F.when(~more & (F.col("n_hung") == 0), 1).otherwise(0)
    rows = rows.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        (F.col("n_hung") + more.cast("long")).alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.alias("saved_tokens"), (-F.shiftright("depth", DEPTHS)).alias("block"),
    )
    rows = running(rows, "conv_id", -F.col("depth"), ["n_leaves", "saved_tokens"], F.sum, lambda a, b: a + b).drop("block")
    top = below.where("depth = 0").agg(F.coalesce(F.sum("n_hung"), F.lit(0)).alias("n_children"), F.coalesce(F.sum("hung_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("hung_saved"), F.lit(0)).alias("saved_tokens"))
    zero = lambda v: F.lit(v).cast("long")
    top = top.select(zero(least).alias("conv_id"), zero(0).alias("depth"), zero(None).alias("parent_conv_id"), zero(n_all).alias("n_convs"), *[F.col(c).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    both = rows.unionByName(top).join(digests.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    return both.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(*own_turns(storage.table(numbered_turns(conversations), "placed")))


def rebuilt_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The trie of conversations whose heads come from their family's first."""
    return trie(*rebuilt_turns(storage.table(numbered_turns(conversations), "placed"), family, heads))
