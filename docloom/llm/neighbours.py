"""Approximate nearest neighbours by an inverted multi-index.

Vectors are halved and each half is quantised by its own codebook, fitted on a bounded
sample; every row is filed under its pair of codes, and cells are gathered to shards of
bounded size (a large cell has several of its own).  A query is sent to shards, and in a shard it
meets the rows of the cells that it asks for and no others.  Queries meet rows in two rounds.  In the
first, a query goes through pairs in the order of summed nearness (a heap over the two
sorted code lists) until their cells hold ``FIRST`` times as many rows as it wants; the k-th best score among those
is a bound that its neighbours must reach.  In the second it goes through the pairs again, in the
order of what their rows may score at most: a centroid's inner product and ``reach`` times
the spread of the rows around it; it stops where that falls below its bound.  So a query
among near vectors meets a few cells, and one without near vectors meets as many as it must.

``reach`` is measured, on all rows: a bounded number of held queries is searched exactly,
and the reach is chosen that, with their bounds, finds the share ``RECALL`` of their true neighbours that the first round does not find.  With
``recall=1`` the search is exact: every query meets every row.

A shard meets its queries in blocks of bounded size, ranked on the original vectors in
double precision.  Only queries are sent to shards; a shard is copied once for each
``SHARD_QUERIES`` queries that ask for it.  What is broadcast is the codebooks and a row for
each cell: at most ``MAX_CODES`` squared.

Defined cases: vectors that are null, zero, of another length than the first, or that
hold null or non-finite components take no part; ties go to the smaller vec_id; repeated
rows are candidates each; fewer candidates than asked for are all returned; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from .sampling import by_hash

NEIGHBOURS, QUERY_EVERY = 20, 20
#: Rows that codebooks are fitted on, and queries that the reach is measured with, at most; the share of their neighbours to be found.
SAMPLE, HELD, RECALL, SEED = 20_000, 128, 0.96, 5
#: Codes of a half, at least and at most, and rows of a cell on average.
LEAST_CODES, MAX_CODES, CELL_ROWS = 6, 256, 64
#: Rows that a query's first round goes through for each that it wants, rows of a shard, queries of a block, and queries multiplied at a time.
FIRST, SHARD_ROWS, SHARD_QUERIES, AT_ONCE = 4, 4096, 8192, 512


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of usable vectors, all of the most common length."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    lengths = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.where(F.size("embedding") == (lengths["n"] if lengths else 0))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        for j in range(k):
            if (own == j).any():
                centres[j] = x[own == j].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


@dataclass
class Index:
    """Codebooks, spreads and shards: small enough to travel with each task."""

    books: tuple[np.ndarray, np.ndarray]
    spreads: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray  # of each cell
    base: np.ndarray  # a cell's first shard
    parts: np.ndarray  # how many shards a cell has
    reach: float = float("inf")

    @property
    def half(self) -> int:
        return self.books[0].shape[1]

    def near(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.books[0] @ v[: self.half], self.books[1] @ v[self.half :]

    def most(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What rows of each code may score at most, by the reach."""
        halves = v[: self.half], v[self.half :]
        return tuple(n + self.reach * np.linalg.norm(h) * s for n, h, s in zip(self.near(v), halves, self.spreads))

    def first(self, v: np.ndarray, k: int) -> list[int]:
        """Cells of the first round; one shard of each large one is enough."""
        return visited(*self.near(v), self.rows, FIRST * k)

    def rest(self, v: np.ndarray, bound: float) -> list[int]:
        """Cells that may hold a row that scores the bound, those of the first round among them."""
        if np.isfinite(bound) and np.isfinite(self.reach):
            return visited(*self.most(v), self.rows, int(self.rows.sum()), bound)
        return np.flatnonzero(self.rows).tolist()

    def wants(self, v: np.ndarray, k: int, bound: float | None = None) -> tuple[list[tuple[int, list[int]]], int]:
        """The shards of a round, each with the cells that are asked for there, and how many rows that is; the second round leaves out what the first has met."""
        first = set(self.first(v, k))
        shards: dict[int, list[int]] = {}
        met = 0.0
        for cell in first if bound is None else self.rest(v, bound):
            base, parts = int(self.base[cell]), int(self.parts[cell])
            for shard in range(base, base + 1) if bound is None else range(base + (cell in first), base + parts):
                shards.setdefault(shard, []).append(int(cell))
                met += self.rows[cell] / parts
        return sorted(shards.items()), round(met)


def visited(first: np.ndarray, second: np.ndarray, rows: np.ndarray, enough: int, least: float = -np.inf) -> list[int]:
    """Non-empty cells by falling sums of their two codes' values, until they hold enough rows or the sum is under the least.

    A pair is reached from the pairs before it in either list, so the heap holds a frontier.
    """
    a, b, k = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable"), len(second)
    heap, seen, met, cells = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, 0, []
    while heap and met < enough and -heap[0][0] >= least:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if rows[cell]:
            cells.append(cell)
            met += int(rows[cell])
        for i, j in ((i + 1, j), (i, j + 1)):
            if i < len(a) and j < k and (i, j) not in seen:
                seen.add((i, j))
                heapq.heappush(heap, (-(first[a[i]] + second[b[j]]), i, j))
    return cells


def _best_rows(q: np.ndarray, own: int, at: np.ndarray, values: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the rows at some places for one query, itself left out, from products by matrix (``values``), the best again row by row.

    Sums by row are alike for like rows, so that copies tie; those that might be among the best are all looked at.
    """
    values[ids[at] == own] = -np.inf
    few = np.partition(values, len(values) - k)[len(values) - k] if len(values) > k else -np.inf
    near = at[(values >= few - 1e-9 * (1 + abs(few))) & (values > -np.inf) if few > -np.inf else values > -np.inf]
    scores = (rows[near] * q).sum(axis=1)
    order = np.lexsort((ids[near], -scores))[:k]
    return ids[near][order], scores[order]


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best of the rows."""
    for start in range(0, len(queries), AT_ONCE):
        some, own_ids = queries[start : start + AT_ONCE], query_ids[start : start + AT_ONCE]
        for q, own, values in zip(some, own_ids, some @ rows.T):
            yield (int(own), *_best_rows(q, own, np.arange(len(rows)), values, rows, ids, k))


FOUND = "query_id long, vec_id long, score double"


def _block(asked: pd.DataFrame, some: pd.DataFrame, k: int) -> pd.DataFrame:
    """A shard's rows, cell by cell, against the queries that ask for each cell; of every query its k best of the shard."""
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    if not len(some) or not len(asked):
        return none
    by_cell = some.sort_values(["cell", "vec_id"])
    rows, ids, cells = np.stack(by_cell["embedding"]), by_cell["vec_id"].to_numpy(), by_cell["cell"].to_numpy()
    queries, query_ids = np.stack(asked["query"]), asked["query_id"].to_numpy()
    which, wanted = np.repeat(np.arange(len(asked)), asked["cells"].map(len)), np.concatenate(asked["cells"].to_list())
    order = np.argsort(wanted, kind="stable")
    which, wanted = which[order], wanted[order]
    out = []
    for start in range(0, len(queries), AT_ONCE):  # products of so many queries are held
        some = (which >= start) & (which < start + AT_ONCE)
        by, asks = which[some], wanted[some]
        products: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        bounds = np.flatnonzero(np.concatenate(([True], asks[1:] != asks[:-1], [True]))) if len(asks) else np.zeros(1, int)
        for i, j in zip(bounds[:-1], bounds[1:]):
            at = np.arange(*np.searchsorted(cells, (asks[i], asks[i] + 1)))
            if len(at):
                for q, values in zip(by[i:j].tolist(), queries[by[i:j]] @ rows[at].T):
                    products.setdefault(q, []).append((at, values))
        for q, parts in products.items():
            at, values = (np.concatenate(x) for x in zip(*parts))
            near, scores = _best_rows(queries[q], query_ids[q], at, values, rows, ids, k)
            out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": near, "score": scores}))
    return pd.concat(out) if out else none


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(routed: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, query, wants) and the filed rows to each query's k best rows of each shard."""
    asked = routed.select("query_id", "query", F.explode("wants").alias("w")).select("query_id", "query", "w.*")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_QUERIES).cast("int").alias("blocks"))
    blocks = storage.table(blocks, "blocks")  # its size is known when the joins are chosen
    asked = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    filed = index.join(blocks, "shard").select("vec_id", "embedding", "cell", F.col("shard").alias("at"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with_block"))
    met = asked.select("query_id", "query", "cells", "shard", "block").groupBy("shard", "block").cogroup(filed.groupBy("at", "with_block"))
    return met.applyInPandas(lambda a, s: _block(a, s, k), FOUND)


def _reach(index: DataFrame, held: pd.DataFrame, own: Index, k: int, recall: float) -> float:
    """The reach that finds the share ``recall`` of the true neighbours of held queries (vec_id, embedding, bound), searched exactly over all rows.

    A neighbour's cell is met in the second round if what its rows may score reaches the query's
    bound from the first; so each neighbour tells the least reach that finds it.  Those that the first round
    finds anyway tell nothing, so the share holds for queries without near vectors too.
    """
    queries, query_ids = np.stack(held["embedding"]), held["vec_id"].to_numpy()

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                ids, rows = f["vec_id"].to_numpy(), np.stack(f["embedding"])
                cells = dict(zip(ids.tolist(), f["cell"].tolist()))
                for q, near, scores in best_of_block(queries, query_ids, rows, ids, k):
                    yield pd.DataFrame({"query_id": q, "vec_id": near, "score": scores, "cell": [cells[i] for i in near.tolist()]})

    true = _best(index.mapInPandas(exact, f"{FOUND}, cell int"), k).select("query_id", "cell").toPandas()  # k rows for each held query
    needed, codes = [], len(own.books[1])
    for query_id, v, bound in zip(query_ids, queries, held["bound"].fillna(-np.inf)):
        cells = true.loc[true["query_id"] == query_id, "cell"].to_numpy()
        (first, second), halves = own.near(v), (v[: own.half], v[own.half :])
        a, b = cells // codes, cells % codes
        spread = np.linalg.norm(halves[0]) * own.spreads[0][a] + np.linalg.norm(halves[1]) * own.spreads[1][b]
        met = np.isin(cells, own.first(v, k)) & (own.parts[cells] == 1)
        needed += ((bound - first[a] - second[b]) / np.maximum(spread, 1e-12))[~met].tolist()
    return max(0.0, float(np.quantile(needed, recall, method="higher"))) if needed else 0.0


def _shards(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first shard and number of shards; small cells in order are gathered to one."""
    base, parts, shard, held = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), 0, 0
    for cell in np.flatnonzero(rows):
        n = int(rows[cell])
        if held and held + n > SHARD_ROWS:
            shard, held = shard + 1, 0
        base[cell], parts[cell] = shard, -(-n // SHARD_ROWS)
        shard, held = shard + int(parts[cell]) - 1, held + n if n <= SHARD_ROWS else SHARD_ROWS
    return base, parts


def search(vectors: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding) to (query_id, rank, vec_id, score) for queries whose vec_id is divisible by ``every``."""
    return search_and_count(vectors, k, every, recall)[0]


def search_and_count(vectors: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """As ``search``, and (query_id, met): the rows that each query is multiplied with in both rounds."""
    spark = vectors.sparkSession
    usable = storage.table(taking_part(vectors), "vectors")
    total, asked = usable.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), spark.createDataFrame([], "query_id long, met long")
    sample = by_hash(usable, "vec_id", SAMPLE, total).toPandas()  # bounded
    x = np.stack(sample["embedding"])
    half, rng = x.shape[1] // 2, np.random.default_rng(SEED)
    codes = min(len(x), max(LEAST_CODES, min(MAX_CODES, round((total / CELL_ROWS) ** 0.5))))
    books, spreads = [], []
    for part in (x[:, :half], x[:, half:]):
        book = k_means(part, codes, rng)
        code = nearest(part, book)
        square = ((part - book[code]) ** 2).sum(axis=1) / max(1, part.shape[1])
        n = np.bincount(code, minlength=codes)
        # a code with few rows of the sample says little about its spread: the spread of all counts as one row more
        books.append(book)
        spreads.append(np.sqrt((np.bincount(code, square, codes) + square.mean()) / (n + 1)))

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = np.stack(f["embedding"]) if len(f) else np.zeros((0, x.shape[1]))
            yield f.assign(cell=nearest(v[:, :half], books[0]) * codes + nearest(v[:, half:], books[1]))

    filed = storage.table(usable.mapInPandas(file, "vec_id long, embedding array<double>, cell int"), "filed")
    rows = np.zeros(codes * codes, np.int64)
    for cell, n in filed.groupBy("cell").count().collect():  # at most MAX_CODES ** 2
        rows[cell] = n
    own = Index((books[0], books[1]), (spreads[0], spreads[1]), rows, *_shards(rows))
    asks = usable.where(F.col("vec_id") % every == 0)
    cells = np.flatnonzero(rows)
    where = spark.createDataFrame(list(zip(cells.tolist(), own.base[cells].tolist(), own.parts[cells].tolist())), "cell int, base long, parts long")
    shard = F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    index = storage.table(filed.join(F.broadcast(where), "cell").select("vec_id", "embedding", "cell", shard.alias("shard")), "index")  # a row for each cell: bounded
    schema = "query_id long, query array<double>, wants array<struct<shard: long, cells: array<int>>>, met long"

    def routes(f: pd.DataFrame, bounds: list[float | None]) -> pd.DataFrame:
        wants = [own.wants(v, k, t) for v, t in zip(f["embedding"], bounds)]
        return pd.DataFrame({"query_id": f["vec_id"], "query": f["embedding"], "wants": [[{"shard": s, "cells": c} for s, c in w] for w, _ in wants], "met": [n for _, n in wants]})

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield routes(f, [None] * len(f))

    def go_on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield routes(f, f["bound"].fillna(-np.inf).tolist())

    first = storage.table(asks.mapInPandas(begin, schema), "first_round")
    near = storage.table(_best(_met(first, index, k), k).drop("rank"), "near")
    bounds = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("bound"))
    bounded = asks.join(bounds.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    if recall < 1:
        own.reach = _reach(filed, by_hash(bounded, "vec_id", HELD, asked).toPandas(), own, k, recall)  # bounded
    second = storage.table(bounded.mapInPandas(go_on, schema), "second_round")
    met = first.select("query_id", "met").unionByName(second.select("query_id", "met")).groupBy("query_id").agg(F.sum("met").alias("met"))
    return _best(near.unionByName(_met(second, index, k)), k).select("query_id", "rank", "vec_id", "score"), met
