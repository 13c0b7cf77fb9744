"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

A text's statistics, standardised, are mapped to cosines of random projections, whose
inner products approximate a Gaussian kernel.  Each partition of the labelled sample sums
its normal equations, partitions' sums are added on Spark, and the driver solves one small
system.  A fold of the sample that the ridge has not seen calibrates its outputs by
pool-adjacent-violators.  Scoring is a pass over the texts with no shuffle.

The sample is bounded: ``SAMPLE`` labelled ids, those of smallest hash, so that it does
not depend on the order of rows, and one text for each (of rows that share an id, that of smallest hash).  Scores use the text alone: labels, languages, sources and ids are never inputs.

Defined cases: a null text is the empty text, which is scored like any other; without
labelled rows, or with one class only, every score is that class's share (0.5 if none); repeated rows
score alike; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from .sampling import by_hash

#: Labelled rows that the model is fitted on, at most; a row takes part by its id's hash.
SAMPLE = 12_000
FEATURES, RIDGE, BANDWIDTH, SEED, FOLDS = 384, 1e-3, 0.5, 7, 4
THRESHOLD = 0.7
#: Texts that are scored together.
AT_ONCE = 512
DIGIT, LONE_MARKS = re.compile("[0-9]+"), re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
#: Marks that junk is made of, each counted by itself.
MARKS = "#*$%&|<>!?.,;:/\\_=+-@()[]{}~^\"'"


def statistics(text: str) -> list[float]:
    """What the classifier knows of a text."""
    words, lines = text.split(), [x for x in text.split("\n") if x and not x.isspace()]
    n, w, chars = len(words), max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    times = np.fromiter(counts.values(), float, len(counts)) if n else np.ones(1)
    lengths = np.fromiter(map(len, counts), float, len(counts)) if n else np.zeros(1)
    mean = lengths @ times / w
    repeats = sum(map(operator.eq, words, words[1:])) / w
    pairs = len(set(map(operator.concat, words, words[2:]))) / max(1, n - 2)
    return [
        np.log1p(n), np.log1p(chars), mean, np.sqrt(max(0.0, lengths**2 @ times / w - mean**2)), np.log1p(lengths.max()),
        len(counts) / w, times.max() / w, repeats, pairs, (times == 1).sum() / w,
        sum(c for x, c in counts.items() if x.isupper()) / w, sum(c for x, c in counts.items() if x.istitle()) / w,
        sum(map(len, DIGIT.findall(text))) / chars, len(LONE_MARKS.findall(text)) / w,
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)) / 100, len(text.encode()) / chars,
        *(min(1.0, text.count(m) / w) for m in MARKS),
    ]


@dataclass
class Model:
    """A fitted classifier, small enough to travel with each task."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def waves(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant; far statistics are drawn in, so that none dominates."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.projection + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def scores(self, texts: list[str]) -> np.ndarray:
        """A score for each text, some texts at a time: their features take more memory than they do."""
        found = [np.zeros(0)]
        for k in range(0, len(texts), AT_ONCE):
            x = np.array([statistics(t) for t in texts[k : k + AT_ONCE]])
            found.append(np.clip(np.interp(self.waves(x) @ self.weights, *self.steps), 0, 1))
        return np.concatenate(found)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of the best rising fit, at the blocks' mean outputs."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    return np.array([t / n for _, n, t in blocks]), np.array([s / n for s, n, _ in blocks])


def sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, y, fold) of at most ``bound`` labelled rows that may be learnt from.

    A document that is labelled more than once has its mean label; null labels are none.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(crc % 4 != 2).groupBy("doc_id").agg(F.avg("y").alias("y"))
    chosen = by_hash(known, "doc_id", bound, known.count())  # at most ``bound`` rows of 16 bytes
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    own = texts.join(F.broadcast(chosen), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")  # repeats of an id meet in part before they are shuffled
    return own.groupBy("doc_id", "y").agg(first).select(F.col("first.text").alias("text"), "y", fold.alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """Fits on the sample: statistics' moments first, then the normal equations of all folds but the last."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b["text"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b["y"], b["fold"]], ["x", "y", "fold"])

    rows = storage.table(sample(docs, labels, bound).mapInArrow(measure, "x array<double>, y double, fold int"), "statistics")
    width = len(statistics(""))
    moments = rows.agg(F.count("*"), F.sum("y"), *[f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    n, positive = moments[0], moments[1] or 0.0
    r = np.random.default_rng(SEED)
    mean = np.array([v or 0.0 for v in moments[2::2]])
    scale = np.array([max(v or 0.0, 1e-6) for v in moments[3::2]])
    projection = r.normal(0, BANDWIDTH / np.sqrt(width), (width, features))
    model = Model(mean, scale, projection, r.uniform(0, 2 * np.pi, features), np.zeros(features + 1), (np.array([0.0]), np.array([positive / n if n else 0.5])))
    if n < 2 or positive in (0, n):
        return model

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each row of the partition's sum of z z' and z y."""
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            b = b[b["fold"] != FOLDS - 1]
            if len(b):
                z = model.waves(np.stack(b["x"]))
                total += z.T @ np.hstack([z, b["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"i": range(features + 1), "row": total.tolist()})

    cells = rows.mapInPandas(equations, "i int, row array<double>").select("i", F.posexplode("row").alias("k", "v"))
    system = np.zeros((features + 1, features + 2))
    for i, k, v in cells.groupBy("i", "k").agg(F.sum("v")).collect():  # a row for each pair of features
        system[i, k] = v
    model.weights = np.linalg.solve(system[:, :-1] + ridge * n * np.eye(features + 1) / features, system[:, -1])
    unseen = rows.where(F.col("fold") == FOLDS - 1).toPandas()  # a bounded share of the bounded sample
    if len(unseen):
        model.steps = isotonic(model.waves(np.stack(unseen["x"])) @ model.weights, unseen["y"].to_numpy())
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) to (doc_id, held_out, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = (b["text"].slice(k, AT_ONCE) for k in range(0, b.num_rows, AT_ONCE))
            found = np.concatenate([np.zeros(0), *(model.scores([t or "" for t in p.to_pylist()]) for p in parts)])
            columns = [b["doc_id"], pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least the threshold, with all their columns."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(k, AT_ONCE) for k in range(0, len(texts), AT_ONCE))
        return pa.array(np.concatenate([np.zeros(0), *(model.scores([t or "" for t in p.to_pylist()]) for p in parts)]), pa.float64())

    return docs.where(scored(F.col("text").cast("string")) >= threshold)
