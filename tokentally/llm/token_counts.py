"""Token counts under a unigram model, by dynamic programming shared in a trie.

The model is a public vocabulary of byte strings whose log-probabilities follow its ranks
(Zipf's law, -log(rank + 1)). A pre-token's count is that of its most likely segmentation, the
fewest tokens among equals. Distinct pre-tokens are inserted into a trie of their bytes; a node
holds the forward score and count of its prefix, computed when the node is made, so words with a common
prefix share that work, and a pre-token's count is read at its last node. A worker keeps its trie
up to a bounded size. Texts stay where they are: there is no shuffle.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.byte_tokens import ChunkMemo, regular
from tokentally.llm.common import small_batches

_TRIE_MAX = 400_000       # nodes a worker keeps; then it starts again
_GROUP_CHARS = 4_000_000  # text counted at once in a task


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class CountTrie:
    """Trie over bytes with the unigram forward score and token count of every prefix."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.best = array("d", [0.0])
        self.tokens = array("q", [0])

    def count(self, piece: bytes) -> int:
        """Tokens of the most likely segmentation."""
        path, node = [0], 0
        for j, byte in enumerate(piece, 1):
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                nxt = self._grow(node << 8 | byte, piece, j, path)
            path.append(nxt)
            node = nxt
        return self.tokens[node]

    def _grow(self, edge: int, piece: bytes, j: int, path: list[int]) -> int:
        top, fewest = -math.inf, 0
        for i in range(max(0, j - self.longest), j):
            s = self.scores.get(piece[i:j])
            if s is not None:
                s += self.best[path[i]]
                n = self.tokens[path[i]] + 1
                if s > top or s == top and n < fewest:
                    top, fewest = s, n
        node = self.child[edge] = len(self.best)
        self.best.append(top)
        self.tokens.append(fewest)
        return node


class UnigramCounter(ChunkMemo):
    """Counts of texts; chunks of regular texts are counted once under the public pattern."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}
        self.trie = CountTrie({t: -math.log(r + 1) for t, r in ranks.items()})
        self.pattern = regex.compile(pattern)
        self.by_chunk = pattern == default_vocabulary()[1]

    def _encode(self, strings: list[str]) -> list[int]:
        if len(self.trie.best) > _TRIE_MAX:
            self.trie.clear()
        # In byte order, words with a common prefix follow each other.
        pieces = [[m.encode("utf-8", "surrogatepass") for m in self.pattern.findall(s)] for s in strings]
        counts = {p: self.trie.count(p) for p in sorted({p for own in pieces for p in own})}
        return [sum(map(counts.__getitem__, own)) for own in pieces]

    def _whole(self, text: str) -> bool:
        return not self.by_chunk or not regular(text)

    def _assemble(self, values: list, codes: np.ndarray, ends: np.ndarray) -> list:
        total = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[codes])])
        return np.diff(total[ends]).tolist()


_COUNTERS: dict[tuple[str, str], UnigramCounter] = {}


def counter(path: str, pattern: str) -> UnigramCounter:
    """The worker's counter for a vocabulary, made once per process."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = UnigramCounter(path, pattern)
    return _COUNTERS[path, pattern]


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null and empty texts count 0.

    Every row is kept, repeated ones and those without an id too; an empty table gives an empty
    result; other columns are ignored.
    """
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            counts, lo, held = [], 0, 0
            for i, n in enumerate([*sizes, _GROUP_CHARS]):
                if held and held + n > _GROUP_CHARS or i == len(sizes):
                    counts += own.blobs(b.column(1).slice(lo, i - lo).to_pylist())
                    lo, held = i, 0
                held += n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
