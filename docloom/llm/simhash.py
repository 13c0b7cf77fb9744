"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each distinct fingerprint emits every variant within half the radius.  Fingerprints that
lie within the radius of each other share a variant, so one shuffle on variants brings
them together; a variant meets at most as many fingerprints as its ball has members,
whatever the data.  Colliding pairs are verified, and the links of different fingerprints
are joined into components by alternating star contraction.  Copies never meet as pairs:
documents of one fingerprint are one vertex.

Defined cases: a null text is the empty text; a text without words has fingerprint zero,
which links like any other; fewer words than a shingle give one shingle of all words;
repeated rows share a fingerprint; an empty table gives an empty result; other columns
of the input are not read.

``first_of_each`` is the operator for texts of five-word shingles and a Jaccard similarity
of 0.8 or more.  Fingerprints of that similarity differ in a seventh of their bits, more than any ball over
a whole fingerprint can reach, so a longer fingerprint is cut into key blocks, each of
which is ball-hashed by itself.  Colliding pairs are first held against the whole
fingerprint and then verified on the exact shingle sets.  See there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

SHINGLE, RADIUS, SEED = 3, 2, 42
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority bits of the text's shingle hashes (XXH64), repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) < shingle:
        return digest(b" ".join(words))
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    hashes = map(digest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    for at in range(0, n, BLOCK):
        block = np.fromiter(hashes, "<u8", min(BLOCK, n - at))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to (doc_id, fp), fp being the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def flips(distance: int) -> list[int]:
    """Every pattern of at most so many of 64 bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for d in range(distance + 1) for bits in combinations(range(64), d)]
    return np.array(masks, np.uint64).view(np.int64).tolist()


def links(vertices: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), a < b, that connect all fingerprints ``fp`` within the radius of each other.

    Each variant links its fingerprints to the smallest of them, in place of all pairs, where
    that is within the radius; the rest of its group, bounded by the ball, is paired in full.
    """
    masks = F.array(*[F.lit(m) for m in flips(-(-radius // 2))])
    # rows that are small now and many soon: dealt out first, as one small file would be one long task
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = vertices.repartition(parts, "fp").select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = balls.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    if radius % 2:  # two members of a ball can then lie one further apart than the radius
        star = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    return star.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs to (v, root): the smallest vertex that each vertex of an edge reaches.

    Large-star and small-star steps alternate until nothing changes.  Each step is a
    grouped minimum and a join, and is written to the shared folder.
    """
    edges = storage.table(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")), "links")
    before = None
    while True:
        superseded = edges
        # large star: each vertex's larger neighbours move to its smallest neighbour
        both = edges.select("v", "u").unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = storage.table(large, "large")
        # small star: each vertex's smaller neighbours and itself move to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v > u").distinct()
        small = storage.table(small, "small")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        storage.free(superseded, large)
        if state == before:
            return small.select("v", F.col("u").alias("root"))
        before, edges = state, small


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable)."""
    prints = storage.table(fingerprints(docs, shingle), "fingerprints")
    vertices = storage.table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "vertices")
    roots = storage.table(components(links(vertices.select("fp"), radius)), "roots")
    # a component's id is the smallest first document of its fingerprints
    rooted = vertices.join(roots, vertices.fp == roots.v, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = storage.table(rooted.join(named, "root").select("fp", "component_id"), "classes")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# --- texts of a Jaccard similarity ---

TEXT_SHINGLE, LEAST = 5, 0.8
#: A long fingerprint's words of 64 bits, each of which gives two key blocks of so many bits, and the radius within a block.
WORDS, BLOCK_BITS, BLOCK_RADIUS = 7, 28, 2
#: Bits of the long fingerprint in which texts of the least similarity differ: a mean of 68 of 448, and nearly six deviations of 7.6 more.
MOST_BITS = 112
#: The key blocks are shuffled in so many turns, one after the other, each of which holds that part of all keys on disk.
TURNS = 2
#: Key groups of at most so many texts meet in full: a bounded number of pairs for each text.
FEW = 8
#: A shingle that more members of larger mixed key groups than this have is common; others are rare.
RARE = 16
#: Fixed values of the mixture: two factors, and the step between its streams.
_MIX, _STEP = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)), 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes, as in ``fingerprint``


def shingle_set(words: list[bytes], shingle: int = TEXT_SHINGLE) -> np.ndarray:
    """The distinct hashes (XXH64) of the shingles, in order."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(digest, joined), np.uint64, max(1, len(words) - shingle + 1)))


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The majority bits of ``WORDS`` mixtures (splitmix64) of the hashes, as signed longs."""
    ones = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        for k in range(WORDS):
            z = hashes[at : at + BLOCK] + np.uint64(_STEP * (k + 1) % 2**64)
            z = (z ^ z >> np.uint64(30)) * _MIX[0]
            z = (z ^ z >> np.uint64(27)) * _MIX[1]
            z ^= z >> np.uint64(31)
            ones[k] += np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0]


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(given: the row itself, row: a key of its own, vertex: a hash of its words, prints); written once, so that they stay."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vertices, prints = [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                vertices.append(xxhash.xxh64_intdigest(b" ".join(words), seed=SEED))
                prints.append(long_fingerprint(shingle_set(words, shingle)) if words else None)
            own = [pa.array(np.array(vertices, np.uint64).view(np.int64)), pa.array(prints, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["given"], batch["doc_id"], batch["row"], *own], ["given", "doc_id", "row", "vertex", "prints"])

    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = docs.select(given.alias("given"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{n} {k}" for n, k in numbered.dtypes if n != "text")  # the text stays in the row itself
    return storage.table(numbered.mapInArrow(run, f"{kinds}, vertex long, prints array<long>"), "marked")


def _keys(turn: int = 0, turns: int = 1) -> Column:
    """Every variant of each key block of ``prints`` within half the radius, with the block's number in the high bits; of the turn's blocks."""
    low = (1 << BLOCK_BITS) - 1
    masks = [sum(1 << b for b in bits) for d in range(BLOCK_RADIUS // 2 + 1) for bits in combinations(range(BLOCK_BITS), d)]
    blocks = [F.get("prints", k).bitwiseAND(F.lit(low)).bitwiseOR(F.lit(2 * k << BLOCK_BITS)) for k in range(WORDS)]
    blocks += [F.shiftright(F.get("prints", k), BLOCK_BITS).bitwiseAND(F.lit(low)).bitwiseOR(F.lit(2 * k + 1 << BLOCK_BITS)) for k in range(WORDS)]
    return F.flatten(F.transform(F.array(*blocks[turn::turns]), lambda b: F.transform(F.array(*map(F.lit, masks)), lambda m: b.bitwiseXOR(m))))


def _differing(one: str, other: str) -> Column:
    return sum((F.bit_count(F.get(one, k).bitwiseXOR(F.get(other, k))) for k in range(1, WORDS)), F.bit_count(F.get(one, 0).bitwiseXOR(F.get(other, 0))))


def _close(found: DataFrame, vertices: DataFrame, most_bits: int | None) -> DataFrame:
    """The distinct pairs (a, b) whose whole fingerprints are near; all, where no number of bits is given."""
    prints = lambda v, p: vertices.select(F.col("vertex").alias(v), F.col("prints").alias(p))
    if most_bits is None:
        return found.distinct()
    pairs = found.distinct().join(prints("a", "p"), "a").join(prints("b", "q"), "b")
    return pairs.where(_differing("p", "q") <= most_bits).select("a", "b")


def _text() -> Column:
    return F.col("given.text").cast("string").alias("text")


def _verified(found: DataFrame, vertices: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs whose shingle sets have at least the Jaccard similarity; texts are read from the rows by their key, so no second copy of them is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = []
            for one, other in zip(batch["one"], batch["other"]):
                x, y = (shingle_set(words_of(t.as_py()), shingle) for t in (one, other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                right.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(right, pa.bool_()))

    at = lambda v, r: vertices.select(F.col("vertex").alias(v), F.col("row").alias(r))
    one, other = (rows.select(F.col("row").alias(r), _text().alias(t)) for r, t in (("p", "one"), ("q", "other")))
    placed = found.join(at("a", "p"), "a").join(at("b", "q"), "b")
    return placed.join(one, "p").join(other, "q").select("a", "b", "one", "other").mapInArrow(run, "a long, b long")


def _across(found: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that no links join yet."""
    root = lambda v, r: roots.select(F.col("v").alias(v), F.col("root").alias(r))
    pairs = found.join(root("a", "r"), "a", "left").join(root("b", "s"), "b", "left")
    return pairs.where(F.coalesce("r", "a") != F.coalesce("s", "b")).select("a", "b")


def _shingle_rows(texts: DataFrame, shingle: int) -> DataFrame:
    """(vertex, n, s): a row for each of a text's n shingles, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vertex, text in zip(batch["vertex"].to_pylist(), batch["text"]):
                own = shingle_set(words_of(text.as_py()), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), vertex)), pa.array(np.full(len(own), len(own))), pa.array(own)], ["vertex", "n", "s"])

    return texts.select("vertex", "text").mapInArrow(run, "vertex long, n long, s long")


def _covers(tokens: DataFrame) -> DataFrame:
    """Sets (rep, h, m, s), a row for each of their h shingles, to (rep, cover, both, most): a large set that has ``both`` of rep's shingles and whose text has ``most`` <= h + m in all.

    Each shingle of a set votes for the largest set that has it and whose text is no longer;
    the set of most votes is held against it, a row for each shingle.  Where ``both`` = h, it covers the set.
    """
    upto = Window.partitionBy("s").orderBy("size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    largest = F.max(F.struct("h", (-F.col("size")).alias("most"), F.col("rep").alias("cover"))).over(upto)
    votes = tokens.select("*", (F.col("h") + F.col("m")).alias("size")).select("rep", largest.alias("by")).groupBy("rep", "by").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("rep").agg(F.max(F.struct("votes", "by")).alias("best"))
    chosen = chosen.select("rep", F.col("best.by.cover").alias("cover"), (-F.col("best.by.most")).alias("most")).where("rep <> cover")
    found = tokens.select("rep", "s").join(chosen, "rep").join(tokens.select(F.col("rep").alias("cover"), "s"), ["cover", "s"])
    return found.groupBy("rep", "cover", "most").agg(F.count("*").alias("both"))


def exact_search(sets: DataFrame, least: float = LEAST, rare: int = RARE) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Texts' shingles (vertex, n, s) to links (a, b) that are sure, and what gives the pairs (a, b) to verify, from roots (v, root) that hold those links.

    Together they connect all pairs of at least the similarity, and no pair is made because texts are alike:

    - Texts that share a rare shingle share one among the first of each, in order of how many have
      it: as many as they may differ in, and one.  A rare shingle has ``rare`` texts at most.
    - Texts that share none have their whole overlap in common shingles, so most of each text is
      common.  Texts of the same common shingles, h of them, are as like as the numbers of their other
      shingles say, so each is held against the one that has the fewest; these links need no text.
    - A set of common shingles may lie in another, its cover, whose text is no longer.  What is
      like a text of the set by common shingles is then at least as like the cover's text.  So a text that
      is like the cover needs that link alone, which needs no text; one that is not can only be
      like texts of fewer shingles than the cover's, which lie in no cover that they are like.
    - Sets that lie in no other are linked to the one that has most of them, if that is like them.
      What is left is searched as the texts were, by the first shingles in order of how many sets have
      each: sets of different roots meet, unless both are covered, and the texts of one set meet the
      text with the fewest others of another.  At a shingle all but the sets of its most frequent root
      meet the rest.  Only here could pairs grow with a square: that of the number of sets that are
      like each other, are of different roots and lie in no other.
    """
    counts = sets.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    marked = storage.table(sets.join(counts, "s"), "shared_shingles")
    common = F.col("df") > rare
    first = lambda n: n - F.ceil(n * least - 1e-9) + 1
    by = marked.groupBy("vertex").agg(
        F.max("n").alias("n"), F.count_if(common).alias("h"), F.bit_xor(F.when(common, F.col("s"))).alias("x"), F.bit_xor(F.when(common, F.xxhash64("s"))).alias("y"),
        F.sort_array(F.collect_list(F.when(~common, F.struct("df", "s")))).alias("rare"),
    )
    by = storage.table(by, "by_shingles")
    alike = lambda m, n, more=0: F.least(m, n) >= least * (F.greatest(F.col(m), F.col(n)) + more) - 1e-9
    pair = lambda v, w: (F.least(v, w).alias("a"), F.greatest(v, w).alias("b"))

    mostly = by.where((F.col("h") > 0) & (F.col("h") >= least * F.col("n") - 1e-9)).select("vertex", "h", "x", "y", (F.col("n") - F.col("h")).alias("others"))
    fewest = mostly.groupBy("h", "x", "y").agg(F.min(F.struct("others", "vertex")).alias("best"))
    fewest = storage.table(fewest.select("h", "x", "y", F.col("best.others").alias("m"), F.col("best.vertex").alias("rep")), "common_sets")
    tokens = marked.where(common).join(fewest.select(F.col("rep").alias("vertex"), "h", "m"), "vertex").select(F.col("vertex").alias("rep"), "h", "m", "s")
    tokens = storage.table(tokens, "set_tokens")
    own = mostly.join(fewest, ["h", "x", "y"]).join(_covers(tokens), "rep", "left")
    like = F.coalesce(F.col("both") >= least * (F.col("h") + F.col("others") + F.col("most") - F.col("both")) - 1e-9, F.lit(False))
    covered = F.col("both") == F.col("h")
    own = storage.table(own.select("rep", "vertex", "h", "others", "m", "cover", like.alias("like"), (like & covered).alias("held"), F.when(covered, F.col("most")).alias("most")), "under_covers")
    sure = own.where((F.col("vertex") != F.col("rep")) & (F.col("h") >= least * (F.col("h") + F.col("others") + F.col("m")) - 1e-9)).select(*pair("vertex", "rep"))
    sure = sure.unionByName(own.where("like").select(*pair("vertex", "cover"))).distinct()

    def search(roots: DataFrame) -> DataFrame:
        rooted = lambda df, v: df.join(roots.select(F.col("v").alias(v), "root"), v, "left").withColumn("root", F.coalesce("root", v))
        alone = F.col("n") - F.col("h") - F.size("rare")
        posted = rooted(by, "vertex").select("vertex", "root", "n", F.explode(F.slice("rare", 1, F.greatest(first(F.col("n")) - alone, F.lit(0)).cast("int"))).alias("r")).select("vertex", "root", "n", "r.s")
        one, other = (posted.select("s", F.col("vertex").alias(v), F.col("root").alias(r), F.col("n").alias(n)) for v, r, n in (("a", "ra", "na"), ("b", "rb", "nb")))
        pairs = one.join(other, "s").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & alike("na", "nb")).select("a", "b")

        left = storage.table(rooted(own.where("not held"), "vertex"), "left")
        of_set = left.groupBy("rep").agg(F.max("h").alias("h"), F.min("others").alias("m"), F.max("most").alias("most"), F.when(F.min("root") == F.max("root"), F.min("root")).alias("root"))
        held = tokens.groupBy("s").agg(F.count("*").alias("sets"))
        ordered = tokens.select("rep", "s").join(held, "s").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("sets", "s"))).alias("t")).join(of_set, "rep")
        posted = ordered.select("rep", "h", "m", "most", "root", F.explode(F.slice("t", 1, first(F.col("h")).cast("int"))).alias("t")).where("t.sets > 1").select("rep", "h", "m", "most", "root", "t.s")
        posted = storage.table(posted, "posted_sets")
        usual = posted.where("root is not null").groupBy("s", "root").agg(F.count("*").alias("sets")).groupBy("s").agg(F.max(F.struct("sets", "root"))["root"].alias("usual"))
        names = ("rep", "h", "m", "most", "root")
        one, other = (posted.select("s", *[F.col(c).alias(f"{c}_{k}") for c in names]) for k in "pq")
        one = one.join(usual, "s", "left").where("root_p is null or root_p <> usual").drop("usual")
        smaller = lambda k, o: F.col(f"most_{k}").isNull() | (F.col(f"most_{o}").isNull() & (F.col(f"h_{o}") + F.col(f"m_{o}") < F.col(f"most_{k}")))
        apart = (F.col("rep_p") != F.col("rep_q")) & (F.col("root_p").isNull() | F.col("root_q").isNull() | (F.col("root_p") != F.col("root_q")))
        near = one.join(other, "s").where(apart & smaller("p", "q") & smaller("q", "p") & alike("h_p", "h_q", F.col("m_p") + F.col("m_q"))).select("rep_p", "rep_q").distinct()
        near = near.unionByName(near.select(F.col("rep_q").alias("rep_p"), F.col("rep_p").alias("rep_q"))).distinct()
        met = left.select(F.col("rep").alias("rep_p"), "vertex", F.col("root").alias("r"), F.col("h").alias("h_p"), "others").join(near, "rep_p")
        met = met.join(rooted(fewest.select(F.col("rep").alias("rep_q"), F.col("h").alias("h_q"), F.col("m").alias("m_q")), "rep_q"), "rep_q")
        met = met.where((F.col("r") != F.col("root")) & alike("h_p", "h_q", F.col("others") + F.col("m_q"))).select(*pair("vertex", "rep_q"))
        return pairs.unionByName(met).distinct()

    return sure, search


def exact_candidates(members: DataFrame, sets: DataFrame, least: float = LEAST, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """Members (vertex, root) and their shingles to the links of ``exact_search`` that are sure, and its pairs of different roots to verify."""
    sure, search = exact_search(sets, least, rare)
    joined = members.where("vertex <> root").select(F.least("vertex", "root").alias("a"), F.greatest("vertex", "root").alias("b"))
    return sure, search(storage.table(components(sure.unionByName(joined)), "roots"))


def text_links(rows: DataFrame, shingle: int = TEXT_SHINGLE, least: float = LEAST, most_bits: int | None = MOST_BITS, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """Rows of ``_marked`` to vertices (vertex, first) and (v, root), the components of the links between different texts.

    1. A shuffle on variants, in ``TURNS`` turns of key blocks.  In each key group every text is
       paired with the first, in a window that spills and is never gathered.
    2. Each text's pair of most common keys is verified, if the whole fingerprints are near; then
       those of the groups of two that are not joined yet and near.
    3. The exact way for groups of more than two that still hold texts of different
       components.  Those of at most ``FEW`` texts meet in full, where their whole fingerprints are
       near.  The texts of larger ones are searched by their shingles, see ``exact_search``,
       which finds every link among them, whether they share a key or not.

    So links are lost by neither size nor order of a group, and no step makes all pairs of one.
    ``most_bits`` is where two whole fingerprints are not near; None verifies every pair of step 1.
    """
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first")
    vertices = rows.groupBy("vertex").agg(F.min("row").alias("row"), first, F.min("prints").alias("prints"))
    vertices = storage.table(vertices, "vertices")
    known = vertices.where("prints is not null").select("vertex", "prints")
    # rows that are small now and many soon: dealt out first, as one small file would be one long task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = Window.partitionBy("key")

    def meetings(turn: int) -> DataFrame:
        balls = known.repartition(parts, "vertex").select("vertex", F.explode(_keys(turn, TURNS)).alias("key"))
        met = balls.select("vertex", "key", F.min("vertex").over(group).alias("head"), F.count("*").over(group).alias("n")).where("n > 1")
        return met.select(F.col("vertex").alias("b"), F.col("head").alias("a"), F.when(F.col("n") > 2, F.col("key")).alias("key"), F.col("n"))

    met = reduce(DataFrame.unionByName, [storage.table(meetings(turn), "met") for turn in range(TURNS)])  # a key has its block's number, so no group spans turns
    found = storage.table(met.where("a < b").groupBy("a", "b").agg(F.count("*").alias("keys"), F.min("n").alias("n")), "found")

    likeliest = found.groupBy("b").agg(F.max(F.struct("keys", "a"))["a"].alias("a")).select("a", "b")
    links = storage.table(_verified(_close(likeliest, known, most_bits), vertices, rows, shingle, least), "links")
    roots = storage.table(components(links), "roots")
    others = storage.table(_close(_across(found.where("n = 2"), roots), known, most_bits), "close")
    links = storage.table(links.unionByName(_verified(others, vertices, rows, shingle, least)), "links")
    roots = storage.table(components(links), "roots")

    # a text's keys, a bounded number, take its root together
    keyed = met.where("key is not null").groupBy(F.col("b").alias("v")).agg(F.collect_list(F.struct("key", "n")).alias("keys")).join(roots, "v", "left")
    keyed = keyed.select(F.col("v").alias("vertex"), F.coalesce("root", "v").alias("root"), F.explode("keys").alias("k")).select("vertex", "k.key", "k.n", "root")
    keyed = keyed.select("*", F.min("root").over(group).alias("low"), F.max("root").over(group).alias("high")).where("low < high").drop("low", "high")
    keyed = storage.table(keyed, "mixed_keys")
    few = keyed.where(F.col("n") <= FEW).join(known, "vertex")
    one, other = (few.select("key", F.col("vertex").alias(v), F.col("root").alias(r), F.col("prints").alias(p)) for v, r, p in (("a", "ra", "p"), ("b", "rb", "q")))
    near = F.lit(True) if most_bits is None else _differing("p", "q") <= most_bits
    few = storage.table(one.join(other, "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near).select("a", "b").distinct(), "few")
    members = storage.table(keyed.where(F.col("n") > FEW).select("vertex").distinct(), "members")
    storage.free(met, keyed, found)
    chosen = vertices.join(members, "vertex", "left_semi").select("row")
    sets = storage.table(_shingle_rows(rows.join(chosen, "row", "left_semi").select("vertex", _text()), shingle), "shingle_rows")
    sure, search = exact_search(sets, least, rare)
    links = storage.table(links.unionByName(sure), "links")
    roots = storage.table(components(links), "roots")
    rest = _across(storage.table(search(roots).unionByName(few).distinct(), "pairs"), roots).join(others, ["a", "b"], "left_anti")  # what was verified in vain
    links = links.unionByName(_verified(storage.table(rest, "rest"), vertices, rows, shingle, least))
    storage.free(sets)
    return vertices.select("vertex", "first"), storage.table(components(links), "roots")


def first_of_each(docs: DataFrame, shingle: int = TEXT_SHINGLE, least: float = LEAST, most_bits: int | None = MOST_BITS, rare: int = RARE) -> DataFrame:
    """The row of smallest doc_id of each component of near copies; rows without an id stay.

    Near copies are texts whose sets of word shingles have the Jaccard similarity, and
    rows of the same words.  A text is lower-cased (A-Z); null is the empty text; texts without words are
    copies of each other; fewer words than a shingle give one shingle of all words.  Rows
    are told apart by a key of their own, so repeated ids are rows like others; other columns stay, whatever their names.
    """
    rows = _marked(docs, shingle)
    vertices, roots = text_links(rows, shingle, least, most_bits, rare)
    rooted = vertices.join(roots, vertices.vertex == roots.v, "left").select("first", F.coalesce("root", "vertex").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    named = rows.where("doc_id is not null").join(kept, "row", "left_semi")
    return named.unionByName(rows.where("doc_id is null")).select("given.*")
