"""Spelling variants: words one inserted, deleted or replaced code point apart, by pivotal grams.

A word's bigrams, rarest first, begin with its gram prefix: the three rarest and every other
occurrence as rare as the third. Of the prefix, two disjoint bigrams of least total frequency are its
pivots (dynamic programming). One edit spoils at most three bigrams and at most one of two
disjoint ones, so of two near words one has a pivot that is a gram of the other's prefix: the
one whose prefix ends with the rarer gram, either if they tie.

One edit is on one side of a surviving gram and leaves the other side as it was: the gram keeps its
position from that end of the word. The shorter of both edited sides, cut in two, keeps either the half next to
the gram or the other one. Position, untouched side and one half are part of the index key, so a
bigram that half of the vocabulary has is still dealt out finely. Pairs that meet are verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import shared_table, small_batches

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10          # a form is at least so many times as frequent
DROP_ONE_IN = 31
_HALF = 16                 # characters of a half that enter a key
_REST_CHARS = 48           # longer sides of a gram enter a key by a running hash
_HELD_BYTES = 32_000_000  # distinct words that a task holds before it passes their counts on
_WORDS_A_TASK = 50_000     # whose keys a task makes
_ROUNDS = 64


def add_words(held: dict[str, int], doc_id, text: str, runs: re.Pattern, min_length: int) -> int:
    """Add one text's words, after the keyed deletions, to the counts ``held``; the bytes that this took.

    ``runs`` finds the lower-cased runs of at least ``min_length`` code points; shorter ones give no word.
    """
    key, size = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), 0
    for run, n in Counter(runs.findall(text.encode().lower().decode())).items():  # bytes lower A-Z alone
        h = zlib.crc32(run.encode(), key)
        if h % DROP_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < min_length:
                continue
        if run in held:
            held[run] += n
        else:
            held[run] = n
            size += 120 + 2 * len(run)
    return size


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int) -> DataFrame:
    """(word, n) over all rows: counted per task in bounded memory, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")
        held: dict[str, int] = {}
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                size += add_words(held, doc_id, text.as_py() or "", runs, min_length)
                if size > _HELD_BYTES:
                    yield _table(held)
                    held, size = {}, 0
        yield _table(held)

    def _table(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    rows = small_batches(docs).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def pivots(prefix: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Two disjoint bigrams (frequency, position, gram) of least total frequency, by dynamic programming over positions.

    ``before``: the cheapest gram that ends at or before the current one begins; a pair ends with the current one.
    """
    grams = sorted(prefix, key=lambda g: g[1])
    best, before, j = None, None, 0
    for g in grams:
        while grams[j][1] + 2 <= g[1]:
            before = grams[j] if before is None else min(before, grams[j])
            j += 1
        if before and (best is None or before[0] + g[0] < best[0]):
            best = (before[0] + g[0], before, g)
    return [best[1], best[2]]


def _beginnings(word: str) -> list[int]:
    """Hashes of the first 0, 1, 2, ... code points."""
    h = xxhash.xxh64(seed=42)
    out = [h.intdigest()]
    for c in word:
        h.update(c.encode())
        out.append(h.intdigest())
    return out


def keys_of(word: str, frequency: dict[str, int]) -> tuple[list[int], list[int], str]:
    """Index keys of the word's gram prefix, those that its pivots look up, and the prefix's last gram."""
    n = len(word)
    grams = sorted([(frequency[g := word[i:i + 2]], g, i) for i in range(n - 1)])
    last = grams[2][:2]
    prefix = [(f, i, g) for f, g, i in grams if (f, g) <= last]
    # Side L: the edit is behind the gram, the word before it stays. Side R: the edit is before it.
    if n <= _REST_CHARS:
        left, right = (lambda i: word[:i]), (lambda i: word[i + 2:])
    else:  # one pass hashes all beginnings or ends, so that many keys of a long word take no longer
        heads, tails = _beginnings(word), _beginnings(word[::-1])
        left = lambda i: word[:i] if i <= _REST_CHARS else heads[i]
        right = lambda i: word[i + 2:] if n - i - 2 <= _REST_CHARS else tails[n - i - 2]
    digest = xxhash.xxh64_intdigest

    def keys(i: int, g: str) -> set[int]:
        out = set()
        for side, at, stays, edited in (("L", i, left(i), n - i - 2), ("R", n - i, right(i), i)):
            for m in {max(edited - 1, 0), edited}:  # the shorter of both words' edited sides
                near, far = min(m // 2, _HALF), min(m - m // 2, _HALF)
                half = word[i + 2:i + 2 + near] if side == "L" else word[i - near:i]
                out.add(digest(f"{side}{at}:{near}:{half}:{g}{stays}", 42) - 2**63)
                if near:
                    half = word[n - far:] if side == "L" else word[:far]
                    out.add(digest(f"{side}{at}:{far}-{half}:{g}{stays}", 42) - 2**63)
        return out

    return [k for _, i, g in prefix for k in keys(i, g)], [k for _, i, g in pivots(prefix) for k in keys(i, g)], last[1]


def near_pairs(words: DataFrame) -> DataFrame:
    """Distinct words (id, word) -> (a, b), a < b, for every two that are one edit apart. Words have at least four code points.

    The grams' frequencies, at most a few thousand of a small alphabet, go to every task. Keys travel with a
    word's id and, if it is short, the word, so that pairs are verified where they meet. A long word of one repeated
    bigram has as many keys as letters; its pairs are verified after its text is joined.
    """
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    frequency = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # alphabet squared: 8,100

    rank = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in frequency.items()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, key, probes, last = [], [], [], []
            words_here = b.column(1).to_pylist()
            for i, w in enumerate(words_here):
                index, probe, gram = keys_of(w, frequency)
                own += [i] * (len(index) + len(probe))
                key += index + probe
                probes += [False] * len(index) + [True] * len(probe)
                last.append(rank[gram])
            at = pa.array(own, pa.int64())
            short = pa.array([w if len(w) <= _REST_CHARS else None for w in words_here], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), short.take(at), pa.array(last, pa.int32()).take(at), pa.array(key, pa.int64()), pa.array(probes, pa.bool_())],
                                             ["id", "word", "last", "key", "probe"])

    dealt = words.select("id", "word").repartition(words.count() // _WORDS_A_TASK + 1)  # a word makes some 25 keys
    keys = shared_table(dealt.mapInArrow(run, "id long, word string, last int, key long, probe boolean"), "spelling-keys")
    index = keys.where("not probe").select("key", F.col("id").alias("a"), F.col("word").alias("v"), F.col("last").alias("index_last"))
    probe = keys.where("probe").select("key", F.col("id").alias("b"), F.col("word").alias("w"), F.col("last").alias("probe_last"))
    lengths = F.abs(F.length("v") - F.length("w")) <= 1
    near = F.col("v").isNull() | F.col("w").isNull() | (lengths & (F.levenshtein("v", "w", 1) == 1))
    rarer = F.col("probe_last") <= F.col("index_last")  # the word whose prefix ends with the rarer gram looks up the other
    met = index.join(probe, (index["key"] == probe["key"]) & rarer & (F.col("a") != F.col("b")) & near)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    texts = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("v")), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("w")), "b")
    return texts.where(F.levenshtein("v", "w", 1) == 1).select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the table.

    ``form``: the near word of largest n (ties: smallest) if that is ``ratio`` times the word's; ``root``: the
    end of the chain of forms. Null texts have no words; a null id counts as empty in the key of deletions; repeated
    rows count again; an empty table has no words; other columns are ignored. ``ratio`` above 1 keeps chains finite.
    """
    found = vocabulary(docs, id_col, text_col, max(min_length, 4), min_count)
    words = shared_table(found.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    pairs = shared_table(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best"))
    fits = -F.col("best.m") >= F.col("n") * ratio
    formed = shared_table(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "spelling-formed")
    ends = roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(steps: DataFrame) -> DataFrame:
    """(word, root): each word's next word, followed to the last. Every round doubles the steps taken.

    Counts grow by ``RATIO`` a step, so a chain has at most 19 words and five rounds end it.
    """
    steps = shared_table(steps, "spelling-roots")
    for _ in range(_ROUNDS):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        if steps.join(ahead, "root", "left_semi").isEmpty():
            return steps
        steps = shared_table(steps.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "spelling-roots")
    raise ArithmeticError("chain of forms without an end")
