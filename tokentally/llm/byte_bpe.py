"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself
a token. Tier two, for the others: its bytes form a linked list, adjacent pairs wait in a heap by rank
(leftmost first among equals), and the best pair is merged until none has a rank. Every
pre-token (match of the pattern) is encoded by itself, so a worker remembers those it has met
(bounded, two generations).
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.byte_tokens import ChunkMemo, regular
from tokentally.llm.common import small_batches

_GROUP_CHARS = 4_000_000  # text encoded at once in a task


class PerfectHash:
    """Minimal perfect hash: n keys -> 0..n-1, by hash and displace.

    Keys are dealt into buckets; from the fullest bucket on, a displacement is searched that sends
    all its keys to free slots; buckets with one key name a free slot directly.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        held: dict[int, list[bytes]] = {}
        for k in keys:
            held.setdefault(xxhash.xxh64_intdigest(k) % self.buckets, []).append(k)
        for bucket, own in sorted(held.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                break
            d = 1
            while True:
                at = [self._slot(k, d) for k in own]
                if len(set(at)) == len(at) and all(self.slots[i] is None for i in at):
                    break
                d += 1
            self.shift[bucket] = d
            for i, k in zip(at, own):
                self.slots[i] = k
        free = (i for i, k in enumerate(self.slots) if k is None)
        for bucket, own in held.items():
            if len(own) == 1:
                i = next(free)
                self.shift[bucket] = -1 - i
                self.slots[i] = own[0]

    def _slot(self, key: bytes, d: int) -> int:
        return xxhash.xxh64_intdigest(key, d) % self.n

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 for bytes that are no key."""
        d = self.shift[xxhash.xxh64_intdigest(key) % self.buckets] if self.n else 0
        if not d:
            return -1
        slot = -1 - d if d < 0 else self._slot(key, d)
        return slot if self.slots[slot] == key else -1


class ByteBpe(ChunkMemo):
    """Vocabulary of one ranks file (lines of base64 token and rank), and its memo.

    Texts are encoded chunk by chunk under the public pattern only, whose matches end where chunks do.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.by_chunk = pattern == default_ranks()[1]
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}
        self.hash = PerfectHash(list(self.ranks))
        self.slot_rank = [self.ranks[k] for k in self.hash.slots]
        self.token = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)

    def pre_token(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        slot = self.hash.find(piece)
        return [self.slot_rank[slot]] if slot >= 0 else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks
        ends = list(range(1, n + 1))  # a part runs from its start to ends[start]; 0: merged away
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i:i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = ends[i]
            if not mid or mid >= n or ends[mid] != end:
                continue  # one of the two parts has changed since
            ends[i], ends[mid] = end, 0
            if end < n:
                before[end] = i
                r = ranks.get(piece[i:ends[end]])
                if r is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            p = before[i]
            if p >= 0:
                r = ranks.get(piece[p:end])
                if r is not None:
                    heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:ends[i]]])
            i = ends[i]
        return out

    def text(self, text: str) -> bytes:
        """Ids of a text as a little-endian unsigned 32-bit blob."""
        ids = array("I")
        for m in self.pattern.findall(text):
            ids.extend(self.pre_token(m.encode("utf-8", "surrogatepass")))
        return ids.tobytes()

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [self.text(s) for s in strings]

    def _whole(self, text: str) -> bool:
        return not self.by_chunk or not regular(text)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's coder for a ranks file, made once per process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _row_groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > _GROUP_CHARS:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, in no special tokens.

    Null and empty texts give an empty array. Every row is kept, repeated ones and those without an
    id too; an empty table gives an empty result; other columns are ignored.
    """
    path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in _row_groups(sizes):
                part = batch.slice(lo, hi - lo)
                blobs = bpe.blobs(part.column(1).to_pylist())
                ends = np.cumsum([0, *(len(b) // 4 for b in blobs)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes of its ids (null and empty ids: no bytes)."""
    path, pattern = path or default_ranks()[0], pattern or default_ranks()[1]
    schema = T.StructType([f for f in encoded.schema if f.name != "decoded"]).add("decoded", "binary")
    kept = [f.name for f in schema if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = batch.column(ids_col)
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
            for lo, hi in _row_groups(np.diff(ends, prepend=0).tolist()):
                out = [bpe.decode(flat[(ends[i - 1] if i else 0):ends[i]]) for i in range(lo, hi)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(out, pa.binary())], [*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)
