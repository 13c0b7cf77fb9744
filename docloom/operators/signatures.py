"""Signatures of file formats at every place, by one Aho-Corasick automaton over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .security import MAGIC


def automaton(signatures: dict[str, str]):
    """Signatures in hex as an automaton over one character for each byte."""
    import ahocorasick

    own = ahocorasick.Automaton()
    for name, code in signatures.items():
        text = bytes.fromhex(code).decode("latin-1")
        own.add_word(text, (*(own.get(text, ())), (name, len(text))))
    own.make_automaton()
    return own


def hits(rows: DataFrame, key: str, content: str, signatures: dict[str, str] | None = None, batch_rows: int = 1 << 16) -> DataFrame:
    """(key, name, offset) of every place where a signature lies in the content, a string's UTF-8 or binary; hits may overlap.

    One pass, whatever the number of signatures; a null content has no hits.
    """
    known = signatures or MAGIC

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(known)
        for batch in batches:
            keys, names, offsets = [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(offsets, pa.int64())], [key, "name", "offset"])

            for k, data in zip(batch[0], batch[1]):
                for end, found in own.iter((data.as_py() or b"").decode("latin-1")):
                    for name, size in found:
                        keys.append(k.as_py())
                        names.append(name)
                        offsets.append(end - size + 1)
                if len(keys) >= batch_rows:
                    yield out()
                    keys, names, offsets = [], [], []
            yield out()

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col(content).cast("binary")).mapInArrow(run, f"`{key}` {kind}, name string, offset long")
