"""Audit of how text filters interact: what each of them removes in every order.

Each document becomes one 32-bit truth table: bit S is set if the document survives the filters
in subset S. Positional popcounts of these words, by carry-save adders, give the survivors of
all 32 subsets per part and label in one pass. Whatever an order of the filters keeps, removes
or loses at a step is a difference of two of these counts.

Identical texts meet by their SHA-256 digests, which carry the smallest id of each text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally.llm.common import join_skewed, shared_table, small_batches

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS = 200
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
_PARTS_HELD = 4096  # parts whose counts a task holds before it passes them on

#: Fails mask -> word of the subsets that a document with these fails survives.
SURVIVES = np.array([sum(1 << s for s in range(SUBSETS) if not s & fails) for fails in range(SUBSETS)], np.uint32)


def fails_of(text: bytes, n_chars: int) -> int:
    """Mask of the filters A to D that a text of ``n_chars`` code points fails."""
    words = text.split()
    a = len(words) < MIN_WORDS
    b = 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * n_chars
    d = len(text.translate(None, _MARKS)) < len(text)
    return a | b << 1 | c << 2 | d << 3


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by a tree of carry-save adders.

    A full adder turns three words of weight w into one of weight w (sums) and one of weight
    2w (carries), for all 32 bits at once; the two words that stay at each weight are counted bit by bit.
    """
    counts, weight = np.zeros(32, np.int64), 1
    bits = np.arange(32, dtype=np.uint32)
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third:2 * third], words[2 * third:3 * third], words[3 * third:]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate([half ^ c, rest])
        counts += weight * (words[:, None] >> bits & 1).sum(0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def _judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, fails of A to D, digest) of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)]).add("part", "string").add("fails", "integer").add("digest", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.utf8_length(b.column(2)).to_pylist()
            fails, digests = [], []
            for i, n in enumerate(lengths):
                text = b.column(2)[i].as_buffer().to_pybytes() if n else b""
                fails.append(fails_of(text, n))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())],
                                             [f.name for f in schema.fields])

    text_or_empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), text_or_empty(part_col).alias("part"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(run, schema)


def survival_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, good, toxic, fails, word) of every row, E judged over the whole table.

    A row counts as good (toxic) if any label row of its id has quality (toxic) 1. Rows without an id have no
    label, fail E never and make no other fail it, as no id is smaller; equal ids are not smaller than each other.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    judged = shared_table(_judged(docs, id_col, text_col, part_col), "audit-judged")
    first = judged.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    named = join_skewed(judged, shared_table(first, "audit-first"), "digest", "n", judged.count())
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    full = named.withColumn("fails", F.col("fails") + F.when(late, 1 << FILTERS.index("E")).otherwise(0)).select("doc_id", "part", "fails")
    nameless = full.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    rows = full.where("doc_id is not null").join(known, "doc_id", "left").fillna(False, ["good", "toxic"]).unionByName(nameless)
    word = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in SURVIVES]), F.col("fails") + 1)
    return rows.select("doc_id", "part", "good", "toxic", "fails", word.alias("word"))


def subset_survivors(words: DataFrame) -> DataFrame:
    """(part, subset, n_all, n_good, n_toxic): survivors of each of the 32 subsets, a bit mask over ``FILTERS``."""
    schema = "part string, subset int, n_all long, n_good long, n_toxic long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            part = b.column("part").dictionary_encode()
            code = part.indices.to_numpy()
            word = b.column("word").to_numpy().astype(np.uint32)
            good, toxic = (b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic"))
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(part.dictionary) + 1))
            for i, name in enumerate(part.dictionary.to_pylist()):
                at = order[ends[i]:ends[i + 1]]
                counts = np.stack([positional_popcount(word[x]) for x in (at, at[good[at]], at[toxic[at]])])
                held[name] = held[name] + counts if name in held else counts
            if len(held) > _PARTS_HELD:
                yield _counted(held)
                held = {}
        yield _counted(held)

    partial = words.select("part", "good", "toxic", "word").mapInArrow(run, schema)
    return partial.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_good", "n_toxic")])


def _counted(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = [p for p in held for _ in range(SUBSETS)]
    counts = np.concatenate([*held.values(), np.zeros((3, 0), np.int64)], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(range(SUBSETS)) * len(held), pa.int32()), *map(pa.array, counts)],
                                      ["part", "subset", "n_all", "n_good", "n_toxic"])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with that step's filter and counts.

    Null texts and parts count as empty. Every row counts, repeated rows and rows without an id too (see
    ``survival_words``); an empty table gives no rows; other columns are ignored.
    """
    counts = subset_survivors(survival_words(docs, labels, id_col, text_col, part_col))
    entry = F.struct("subset", F.struct("n_all", "n_good", "n_toxic"))
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("of"),  # 32 entries a part
                                       F.create_map(*[c for x in FILTERS for c in (F.lit(x), F.sum(_all_orders(x)))]).alias("shapley"))
    step = "array<struct<filter_order string, step int, filter string, before int, own int>>"
    rows = parts.select("part", "of", "shapley", F.inline(F.from_json(F.lit(json.dumps(_steps())), step)))
    n = lambda s, kind="n_all": F.col("of")[s][kind]
    before, own, every = F.col("before"), F.col("own"), F.lit(SUBSETS - 1)
    removed = n(before) - n(before + own)
    return rows.select(
        "part", "filter_order", "step", "filter", n(before + own).alias("kept"), removed.alias("removed"),
        (n(F.lit(0)) - n(own) - removed).alias("redundant"),
        (n(every - own) - n(every)).alias("unique_fails"),
        (n(before, "n_good") - n(before + own, "n_good")).alias("good_lost"),
        (n(before, "n_toxic") - n(before + own, "n_toxic")).alias("toxic_lost"),
        F.col("shapley")[F.col("filter")].alias("shapley"))


def _steps() -> list[dict]:
    """All orders of the filters, step by step, with the mask of the filters before."""
    return [{"filter_order": "".join(order), "step": k + 1, "filter": x, "before": sum(1 << FILTERS.index(y) for y in order[:k]), "own": 1 << FILTERS.index(x)}
            for order in permutations(FILTERS) for k, x in enumerate(order)]


def _all_orders(x: str) -> Column:
    """A subset's share of what filter ``x`` removes, summed over all orders.

    A subset S without x comes just before x in |S|! (4 - |S|)! orders; its survivors count for it, those of S and x against it.
    """
    own, last = 1 << FILTERS.index(x), len(FILTERS) - 1
    times = [-factorial(s.bit_count() - 1) * factorial(last + 1 - s.bit_count()) if s & own else factorial(s.bit_count()) * factorial(last - s.bit_count())
             for s in range(SUBSETS)]
    return F.element_at(F.array(*map(F.lit, times)), F.col("subset") + 1) * F.col("n_all")
