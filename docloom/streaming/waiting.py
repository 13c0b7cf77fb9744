"""References that wait in state for their targets, and expire.

A reference that comes before its target is kept until the target comes or its time is up; a
target is kept for as long.  Timers clear both, so state shrinks again, which a join of two
streams without a watermark never does.

Keys share buckets: a bucket's rows of a batch are resolved together, by sorted arrays, and its
state is read and written once, where state and timers of every key by itself take calls to the
state store by the key.  Rows are packed by bucket before they are shuffled, so that no Python
runs by the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BOUND, EXPIRED = "bound", "expired"
COLUMNS = "key long, ref long, target long, state string"
#: What a row is.
REFERENCE, TARGET = range(2)
#: Rows of a bucket and a kind: a key, a value and the end of the wait in microseconds, and so on.
PACKED = "bucket int, kind int, packed binary"
#: So many rows are packed at a time, and so many go to a pack at most.
ROWS, PACK = 1 << 18, 256
#: The end of the wait of a row without a time.
NEVER = 2**63 - 1
#: The store that timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Waiting(StatefulProcessor):
    """Packed references and targets, by bucket.

    A bucket that holds anything has one timer, at the first end of a wait.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "packed binary")
        self.targets = handle.getValueState("targets", "packed binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packs = {REFERENCE: [], TARGET: []}
        for frame in rows:
            for kind, packed in zip(frame["kind"], frame["packed"], strict=True):
                packs[kind].append(packed)
        new, come = (_unpacked(b"".join(packs[k])) for k in (TARGET, REFERENCE))
        held, targets = _got(self.waiting), _got(self.targets)
        before = _first(held, targets)

        new = new[:, np.lexsort((new[1], new[2], new[0]))]  # the first target of a key in this batch, if it has none yet
        new = new[:, np.diff(new[0], prepend=new[0][:1] - 1) != 0]
        new = new[:, ~_found(targets[0], new[0])[1]]
        if new.size:
            targets = np.concatenate([targets, new], 1)
            targets = targets[:, np.argsort(targets[0])]
            _put(self.targets, targets)

        references = np.concatenate([held, come], 1)
        at, found = _found(targets[0], references[0])
        rest = references[:, ~found]
        if rest.shape != held.shape or found[: held.shape[1]].any():
            _put(self.waiting, rest)
        self._timer(before, _first(rest, targets))
        if found.any():
            yield _frame(references[:, found], targets[1][at[found]])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, targets = _got(self.waiting), _got(self.targets)
        over, gone = held[2] // 1000 <= now, targets[2] // 1000 <= now
        if over.any():
            _put(self.waiting, held[:, ~over])
        if gone.any():
            _put(self.targets, targets[:, ~gone])
        self._timer(None, _first(held[:, ~over], targets[:, ~gone]))  # the one that has come is deleted by Spark
        if over.any():
            yield _frame(held[:, over])

    def _timer(self, before: int | None, after: int | None) -> None:
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def close(self) -> None:
        pass


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, key, value, until) by place, twice the bucket and the kind; those without a key or a value are left out."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield _pack(held)
            held, n = [], 0
    if n:
        yield _pack(held)


def _pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    place, *columns = (c.to_numpy() for c in pa.Table.from_batches(batches).drop_null().columns)
    place = place.astype(np.min_scalar_type(place.max(initial=0)))  # short numbers are sorted by radix
    order = np.argsort(place, kind="stable")
    place, rows = place[order], np.stack(columns, 1, dtype="<i8")[order]
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    within = np.arange(len(place)) - np.repeat(starts, np.diff(starts, append=len(place)))
    cuts = np.flatnonzero(within % PACK == 0)
    ends = np.append(cuts, len(place)) * rows.strides[0]
    packed = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.astype("int32")), pa.py_buffer(rows)])
    return pa.RecordBatch.from_arrays([pa.array((place[cuts] // 2).astype("int32")), pa.array((place[cuts] % 2).astype("int32")), packed], ["bucket", "kind", "packed"])


def _unpacked(packed: bytes) -> np.ndarray:
    """Keys, values and ends of the wait."""
    return np.frombuffer(packed, "<i8").reshape(-1, 3).T


def _got(state) -> np.ndarray:
    return _unpacked((state.get() or (b"",))[0])


def _put(state, held: np.ndarray) -> None:
    state.update((held.T.astype("<i8").tobytes(),)) if held.size else state.clear()


def _first(*held: np.ndarray) -> int | None:
    """The first end of a wait, in milliseconds."""
    return min((int(h[2].min()) // 1000 for h in held if h.size), default=None)


def _found(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of these lies among sorted keys, and whether it is there."""
    if not keys.size:
        return np.zeros(len(of), "int64"), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return at, keys[at] == of


def _frame(references: np.ndarray, targets: np.ndarray | None = None) -> pd.DataFrame:
    none = targets is None
    found = pd.arrays.IntegerArray(np.zeros_like(references[0]) if none else targets, np.full(references.shape[1], none))
    return pd.DataFrame({"key": references[0], "ref": references[1], "target": found, "state": EXPIRED if none else BOUND})


@contextmanager
def store(spark: SparkSession) -> Iterator[None]:
    """While it is open, streams that are started keep their state in the store that timers need."""
    key, name = STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, name)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def resolved(references: DataFrame, targets: DataFrame, wait: str, wait_ms: int, buckets: int = 4096) -> DataFrame:
    """Streams (key, ref, at) and (key, target, at) to (key, ref, target, state): bound references, whichever side came first, and expired ones.

    ``wait`` is the watermark's delay, ``wait_ms`` how long either side waits for the other in event
    time; a row without a time waits for ever, and late rows are not dropped.  A row without a key,
    a ref or a target only moves the watermark.  The stream must be started while ``store`` is open.
    A batch reads and writes the state of all keys that share a bucket with one of its own, so much
    state and small batches want more ``buckets``; their number must stay when a stream is started
    again.
    """
    side = lambda df, value, kind: df.select("key", F.col(value).alias("value"), "at", F.lit(kind).alias("kind"))
    both = side(references, "ref", REFERENCE).unionByName(side(targets, "target", TARGET))
    both = both.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", wait)
    rows = both.select(
        (F.pmod(F.xxhash64("key"), F.lit(buckets)) * 2 + F.col("kind")).cast("int").alias("place"),
        *(F.col(c).cast("long").alias(c) for c in ("key", "value")),
        F.coalesce(F.unix_micros("at") + wait_ms * 1000, F.lit(NEVER)).alias("until"),
    )
    return rows.mapInArrow(_packed, PACKED).groupBy("bucket").transformWithStateInPandas(Waiting(), outputStructType=COLUMNS, outputMode="Append", timeMode="EventTime")
