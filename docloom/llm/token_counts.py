"""Unigram token counts from a trie of distinct pre-tokens.

A pre-token's count is the number of pieces in its best segmentation under a unigram
model.  Best scores of prefixes depend on the prefix alone, so pre-tokens are put into a
trie and each node's forward score is worked out once, whatever number of pre-tokens
share it; a pre-token's last node keeps its count.  A worker keeps its trie between
batches, up to a bounded number of nodes.  Work is per row: no shuffle.

The public vocabularies hold no unigram model, and tokenizers are not trained here: the
pieces of the 32,000-piece vocabulary are given log-probabilities by Zipf's law from their
rank.  A character outside the vocabulary counts as its UTF-8 bytes.

Defined cases: a null or empty text has no tokens; a very long pre-token is scored in
linear time without entering the trie; ties go to fewer pieces; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import parts

#: Nodes of a worker's trie, and characters of a pre-token that enters it.
MAX_NODES, LONGEST = 800_000, 48
#: A line's end is a piece of its own; a run of spaces goes with what follows it.
PRETOKEN, EDGE = re.compile("\n| *[^ \n]+| +"), re.compile("(?<=[^ ])[ \n]")
#: Offset of Zipf's law, and the score of a character that is spelt by its bytes.
OFFSET, BYTE_SCORE = 2.7, -25.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> dict[str, float]:
    """Each piece's log-probability, by its rank in the vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    mass = math.log(sum(1 / (r + OFFSET) for r in range(len(plain))))
    return {model.id_to_piece(i).replace("▁", " "): -math.log(r + OFFSET) - mass for r, i in enumerate(plain)}


class Trie:
    """Forward scores by prefix.  A node is a number; ``edges`` leads from a node and a character to the next."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.pieces, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=1)
        #: What some piece ends with: no piece ends where a longer ending is not here.
        self.endings = {p[i:] for p in scores for i in range(len(p))}
        self.clear()

    def clear(self) -> None:
        self.edges: dict[tuple[int, str], int] = {}
        self.scores, self.counts = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def _step(self, word: str, end: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """The best score of word[:end] and its pieces, from those of all shorter prefixes."""
        size = len(word[end - 1].encode())
        best, count = scores[end - 1] + BYTE_SCORE * size, counts[end - 1] + size
        for start in range(end - 1, -1, -1):
            part = word[start:end]
            if part not in self.endings:
                break
            if (s := self.pieces.get(part)) is not None:
                total, n = scores[start] + s, counts[start] + 1
                if total > best or total == best and n < count:
                    best, count = total, n
        return best, count

    def count(self, word: str) -> int:
        """The pieces of a pre-token, which stays in the trie."""
        if (known := self.terminal.get(word)) is not None:
            return known
        if len(word) > LONGEST:
            return self._alone(word)
        if len(self.scores) > self.max_nodes:  # start anew: memory stays bounded
            self.clear()
        at, edges, scores, counts = 0, self.edges, [0.0], [0]
        for end, c in enumerate(word, 1):
            key = (at, c)
            if (at := edges.get(key, -1)) < 0:
                best, n = self._step(word, end, scores, counts)
                at = edges[key] = len(self.scores)
                self.scores.append(best)
                self.counts.append(n)
            scores.append(self.scores[at])
            counts.append(self.counts[at])
        self.terminal[word] = counts[-1]
        return counts[-1]

    def _alone(self, word: str) -> int:
        """The same recurrence over a window of prefixes, for a word of any length."""
        scores, counts = [0.0], [0]
        for end in range(1, len(word) + 1):
            part = word[max(0, end - self.longest) : end]
            best, n = self._step(part, len(part), scores[-len(part) :], counts[-len(part) :])
            scores, counts = [*scores[-self.longest :], best], [*counts[-self.longest :], n]
        return counts[-1]


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    """One trie for each vocabulary and worker process."""
    return Trie(pieces(path))


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_pretokens, n_tokens)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch["text"]:
                n = total = 0
                for part in parts(text.as_py() or "", EDGE):
                    found, known = PRETOKEN.findall(part), own.terminal
                    n += len(found)
                    total += sum([known[w] if w in known else own.count(w) for w in found])
                words.append(n)
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    schema = "doc_id long, n_pretokens long, n_tokens long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
