"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Statistics of every whole text are built-in expressions.  Texts that pass the fixed limits
give a transformed statistic vector.  Per language and source the minimum-covariance-
determinant estimate is searched for as follows: several deterministic starts (the spreads
of each component, the correlations of squashed components, the spatial signs) take two
concentration steps each (distances, the nearest three quarters, their mean and covariance); the start of
least determinant goes on until its determinant falls no more.  A vector whose squared
Mahalanobis distance is over the cutoff is rejected.  Each step is a grouped sum with
partial aggregation, so a source with a third of all rows costs no single task more than
its share; estimates meet rows by a salted join.  There is no Python on the path.

The nearest three quarters are found by approximate percentiles, whose rank is off by a
ten-thousandth of the rows at most.

A group of fewer than ``MIN_GROUP`` rows has no estimate of its own: its rows are judged by
the estimate of their whole language, or of all rows where the language has too few.

Defined cases: a null or wordless text has zeros and fails the limits; null languages and
sources are groups like others; repeated rows count each; with few rows in all, the
estimate of all rows judges, whatever their number (the least spreads bound it); an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_GROUP, CORE, SALTS = 30, 0.75, 32
#: Concentration steps of each start, and the fall of a logarithmic determinant that counts as none.
FIRST_STEPS, NO_FALL = 2, 1e-4
#: Squared distance beyond which a text is rejected.  By Chebyshev's inequality at most five components in a hundred,
#: 5 %, of any distribution with the estimated mean and covariance lie beyond; clean texts, however long their tails, far fewer.
CUTOFF = 100.0
#: Least standard deviation of each component, so that a group of like texts does not reject small differences.
FLOORS = {"v0": 0.3, "v1": 0.08, "v2": 0.15, "v3": 0.15, "v4": 0.15}
#: Median of the chi-squared distribution with five degrees of freedom.
CHI2_MEDIAN = 4.3515
V = list(FLOORS)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _window_hashes(words: Column) -> Column:
    """The 64-bit hash of each five words in a row."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text) to the counts of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = {x.lower() for x in docs.columns}
    own = [F.col(c).cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    row = F.col("row") if "row" in names else F.lit(None).cast("long")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own, text.alias("text"), row.alias("row"))
    df = df.withColumn("words", F.array_remove(F.split("text", "[ \\t-\\r]+"), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    df = df.withColumn("hashes", _window_hashes(F.col("words")))
    word = F.col("words")
    df = df.select(
        "doc_id", "lang", "source", "row", "hashes",
        F.size(word).cast("long").alias("n_words"),
        F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.octet_length("text") - F.octet_length(_without(F.col("text"), "!"))).cast("long").alias("n_shouts"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(word)).cast("long").alias("n_distinct"),
    )
    # Windows seen twice lie next to each other once sorted; their starts, in order, cover at most five new words each.
    dealt = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), dealt)).drop("hashes")
    twice = F.filter(
        F.transform("sorted", lambda x, k: F.when((F.get(F.col("sorted"), k - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), k + 1)["h"] == x["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(F.array_sort(twice), zero, lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total")), lambda a: a["total"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("sorted")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed vector v0 .. v4 of texts that pass the fixed limits; others have nulls."""
    n = F.col("n_words").cast("double")
    parts = [F.log(n), F.log(F.col("word_chars") / n), F.asinh(20 * F.col("n_symbols") / n), F.asinh(20 * F.col("n_shouts") / n), F.log(F.col("n_distinct") / n)]
    return stats.withColumns({v: F.when(~F.col("base_failed"), p) for v, p in zip(V, parts)})


def _pair(i: int, j: int) -> str:
    return f"c{i}{j}"


def _salted(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their pool's estimates; a hot pool's rows are spread over salts."""
    copies = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(copies, ["pool", "salt"], how)


def _distances(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    df = _salted(rows, estimates, how)
    for i, v in enumerate(V):
        rest = F.col(v) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(1, len(V))), F.col("z0") ** 2))


def _factored(moments: DataFrame) -> DataFrame:
    """Means and the Cholesky factor l of the covariance c, whose diagonal gets the least variances, and its logarithmic determinant."""
    df = moments
    for j, v in enumerate(V):
        square = F.col(_pair(j, j)) + FLOORS[v] ** 2 - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(square, F.lit(FLOORS[v] ** 2 / 4))))
        df = df.withColumns({f"l{i}{j}": (F.col(_pair(j, i)) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, len(V))})
    df = df.withColumn("logdet", 2 * sum((F.log(F.col(f"l{j}{j}")) for j in range(1, len(V))), F.log("l00")))
    return df.drop(*[_pair(i, j) for i in range(len(V)) for j in range(i, len(V))])


PAIRS = [(i, j) for i in range(len(V)) for j in range(i, len(V))]


def _starts(points: DataFrame) -> DataFrame:
    """Three deterministic estimates for each pool, about the medians."""
    quartiles = [F.percentile_approx(v, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, v in enumerate(V)]
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[v])).alias(f"s{i}") for i, v in enumerate(V)]
    middle = points.groupBy("pool").agg(*quartiles).select("pool", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(len(V))], *spread)
    middle = storage.table(middle, "middle")
    scaled = _salted(points, middle).select("pool", *[((F.col(v) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, v in enumerate(V)])
    squashed, norm = [F.tanh(f"z{i}") for i in range(len(V))], F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(1, len(V))), F.col("z0") ** 2))
    signs = [F.col(f"z{i}") / F.greatest(norm, F.lit(1e-9)) for i in range(len(V))]
    kinds = {"squashed": squashed, "signs": signs}
    sums = [F.avg(c[i] * c[j]).alias(f"{k}{i}{j}") for k, c in kinds.items() for i, j in PAIRS] + [F.avg(c).alias(f"squashed{i}") for i, c in enumerate(squashed)]
    shapes = storage.table(scaled.groupBy("pool").agg(*sums).join(middle, "pool"), "shapes")

    def product(kind: str, i: int, j: int) -> Column:
        return F.col(f"{kind}{i}{j}") - (F.col(f"squashed{i}") * F.col(f"squashed{j}") if kind == "squashed" else F.lit(0.0))

    def covariance(kind: str, i: int, j: int) -> Column:
        both = F.col(f"s{i}") * F.col(f"s{j}")
        if i == j or kind == "spreads":
            return both if i == j else F.lit(0.0)
        size = F.sqrt(product(kind, i, i) * product(kind, j, j))
        return both * F.when(size > 1e-12, product(kind, i, j) / size).otherwise(0.0)

    own = [shapes.select("pool", F.lit(k).alias("start"), *[f"m{i}" for i in range(len(V))], *[covariance(k, i, j).alias(_pair(i, j)) for i, j in PAIRS]) for k in ("spreads", *kinds)]
    return storage.table(_factored(own[0].unionByName(own[1]).unionByName(own[2])), "starts")


def _concentrate(points: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step of every estimate."""
    far = _distances(points, now)
    limits = far.groupBy("pool", "start").agg(F.percentile_approx("d2", CORE, 10_000).alias("limit"))
    limited = storage.table(now.drop("logdet").join(limits, ["pool", "start"]), "limit")
    core = _distances(points, limited).where("d2 <= limit")
    shifted = [F.col(v) - F.col(f"m{i}") for i, v in enumerate(V)]  # about the last centre, for exact sums
    sums = [F.avg(shifted[i]).alias(f"s{i}") for i in range(len(V))]
    products = [F.avg(shifted[i] * shifted[j]).alias(_pair(i, j)) for i, j in PAIRS]
    centre = [F.first(f"m{i}").alias(f"o{i}") for i in range(len(V))]
    moments = core.groupBy("pool", "start").agg(*sums, *products, *centre)
    moments = moments.select("pool", "start", *[(F.col(f"o{i}") + F.col(f"s{i}")).alias(f"m{i}") for i in range(len(V))], *[
        (F.col(_pair(i, j)) - F.col(f"s{i}") * F.col(f"s{j}")).alias(_pair(i, j)) for i, j in PAIRS
    ])
    return storage.table(_factored(moments), "estimate")


def estimates(points: DataFrame) -> DataFrame:
    """(pool, salt, v0 .. v4) to one row for each pool: mean, factor, determinant and scale of its concentrated core."""
    now = _starts(points)
    for _ in range(FIRST_STEPS):
        now = _concentrate(points, now)
    columns = now.columns
    least = now.groupBy("pool").agg(F.min(F.struct("logdet", "start", *[c for c in columns if c not in ("pool", "start", "logdet")])).alias("best"))
    now, settled = storage.table(least.select("pool", "best.*").select(columns), "estimate"), []
    while True:  # each turn's determinants fall, or the pool is settled
        new = _concentrate(points, now)
        before = now.select("pool", F.struct(*columns).alias("old"), F.col("logdet").alias("at"))
        both = new.select("pool", F.struct(*columns).alias("new"), F.col("logdet").alias("to")).join(before, "pool")
        falls = F.col("to") < F.col("at") - NO_FALL
        settled.append(both.where(~falls).select(F.when(F.col("to") < F.col("at"), F.col("new")).otherwise(F.col("old")).alias("e")).select("e.*"))
        now = storage.table(both.where(falls).select("new.*"), "estimate")
        if now.isEmpty():
            break
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    found = storage.table(found, "settled")
    middle = _distances(points, found).groupBy("pool").agg(F.percentile_approx("d2", 0.5, 10_000).alias("middle"))
    scale = F.greatest(F.col("middle") / CHI2_MEDIAN, F.lit(1.0)).alias("scale")
    return storage.table(found.join(middle, "pool").select(*columns, scale), "estimates")


def pools(rows: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) to ``pool``, whose estimate judges the group, and ``feeds``, the pools that its rows take part in.

    A group of at least ``min_group`` rows has an estimate of its own; a smaller one is judged by its
    language if that has as many, else by all rows: so few rows have no robust estimate in five components.
    """
    named = lambda kind, *c: F.concat(F.lit(f"{kind}:"), F.to_json(F.struct(*c), {"ignoreNullFields": "false"}))
    sizes = rows.where("v0 is not null").groupBy("lang", "source").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("language_size", F.sum("size").over(Window.partitionBy("lang")))
    pool = F.when(F.col("size") >= min_group, named("source", "lang", "source")).when(F.col("language_size") >= min_group, named("language", "lang"))
    groups = storage.table(sizes.withColumn("pool", F.coalesce(pool, F.lit("all"))), "groups")
    anywhere = not groups.where("pool = 'all'").isEmpty()
    borrowed = F.max(F.col("pool").startswith("language:")).over(Window.partitionBy("lang"))
    feeds = [F.when(F.col("size") >= min_group, F.col("pool")), F.when(borrowed, named("language", "lang")), F.lit("all" if anywhere else None).cast("string")]
    return groups.select(named("name", "lang", "source").alias("name"), "pool", F.array_compact(F.array(*feeds)).alias("feeds"))


def judge(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts of each text, base_failed, kept, and the scaled squared distance (null where there is none)."""
    return _judged(docs, cutoff, min_group).drop("row")


def kept_rows(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of the documents that are kept, each by its own verdict, whatever its id.

    They are written with a key of their own first, which stays the same when a task runs again.
    """
    given, known = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {c.lower() for c in docs.columns}  # whatever their names
    rows = storage.table(docs.select(given.alias("given"), F.monotonically_increasing_id().alias("row")), "numbered")
    kept = _judged(rows.select("row", *[F.col(f"given.{c}").alias(c) for c in ("doc_id", "text", "lang", "source") if c in known]), cutoff, min_group).where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select("given.*")


def _judged(docs: DataFrame, cutoff: float, min_group: int) -> DataFrame:
    rows = vectors(statistics(docs))
    key = F.xxhash64("doc_id", "n_words", "word_chars")
    rows = storage.table(rows.withColumn("salt", F.pmod(key, F.lit(SALTS)).cast("int")), "rule_rows")
    name = F.concat(F.lit("name:"), F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}))
    copies = pools(rows, min_group).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = storage.table(rows.withColumn("name", name).join(copies, ["name", "salt"], "left").drop("name"), "pooled_rows")
    points = rows.where("v0 is not null").select(F.explode("feeds").alias("pool"), "salt", *V)
    judged = _distances(rows, estimates(points), "left").withColumn("distance", F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("row", *own, kept.alias("kept"), "distance")
