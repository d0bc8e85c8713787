import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tokentally.llm import substring_dedup as D

SCHEMA = "doc_id long, text string, marks string, start int, text_key string, kept string"


def brute(rows, w=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), own in zip(rows, words):
        for i in range(len(own) - w + 1):
            if d is not None:
                key = tuple(own[i:i + w])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), own in zip(rows, words):
        gone = set()
        for i in range(len(own) - w + 1):
            if d is not None and first[tuple(own[i:i + w])] < d:
                gone.update(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(own) if i not in gone)
        out.append((d, len(own), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, parts=5, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    return sorted(map(tuple, D.remove_repeated(df.repartition(parts), **options).collect()), key=repr)


def corpus(seed=1, n=80):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "中文", "\x1c", "\x85", "x y", "W1"]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 40, 90]))] for _ in range(8)]
    line = [rng.choice(vocab) for _ in range(9)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice([rng.choice(passages), line, [rng.choice(vocab) for _ in range(rng.randint(0, 60))], ["a"] * rng.choice([5, 30, 200]), ["a", "b"] * 40])
        rows.append((d * 7 % n, rng.choice([" ", "  ", "\t\n", "\x0b"]).join(words) + rng.choice(["", " ", "\n"])))
    rows += [(200, None), (201, ""), (202, "  \n"), (None, rows[3][1]), (None, None), (300, rows[5][1]), (300, rows[5][1]), (300, rows[6][1]), (-5, rows[7][1])]
    return rows


@pytest.mark.parametrize("options", [{}, {"gram": 1, "cells": 64}, {"window": 5, "gram": 5}])
def test_equals_brute_force(spark, options):
    rows = corpus()
    want = brute(rows, options.get("window", 13))
    assert run(spark, rows, **options) == want
    assert sum(r[2] for r in want) > 1000 and any(0 < r[2] < r[1] for r in want)


@pytest.mark.parametrize("hot, codes, chunk", [(0, 50, 1), (3, 0, 2000), (30, 5, 10**9)])
def test_hot_cells_rare_words_and_chunks_change_nothing(spark, monkeypatch, hot, codes, chunk):
    monkeypatch.setattr(D, "HOT_STRINGS", hot)
    monkeypatch.setattr(D, "HOT_MEANS", 0)
    monkeypatch.setattr(D, "CODES", codes)
    monkeypatch.setattr(D, "_CHUNK_BYTES", chunk)
    monkeypatch.setattr(D, "_HELD_WORDS", 10)
    rows = corpus(2)
    assert run(spark, rows) == brute(rows)


def test_very_long_text_and_large_groups_of_copies(spark):
    long = " ".join(f"v{i % 5001}" for i in range(40_000))
    rows = [(1, long), (2, long + " end")] + [(d, "copy of one text " * 5) for d in range(10, 400)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == [(None, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_super_kmers_hold_every_window_once():
    texts = [t for _, t in corpus(4)]
    words = D.Words(pa.array(texts, pa.string()))
    spelled = words.distinct.to_pylist()
    own = [[spelled[i] for i in words.ids[a:b]] for a, b in zip(words.ends, words.ends[1:])]
    assert own == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    text, at, n, low = D.super_kmers(words, 13, 3)
    got = sorted((t, a - words.ends[t] + i) for t, a, k in zip(text, at, n) for i in range(k))
    assert got == [(t, i) for t, w in enumerate(own) for i in range(len(w) - 12)]
    assert n.max() <= D.RUN and len(n) < 0.4 * n.sum()


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "_mixed", lambda h: h & np.uint64(1))
    rng = np.random.default_rng(1)
    words, doc = rng.integers(0, 2, 300), rng.integers(0, 50, 296)
    got = D.first_of_equal(words, np.arange(296), doc, 5)
    keys = [tuple(words[i:i + 5]) for i in range(296)]
    assert got.tolist() == [min(d for d, o in zip(doc, keys) if o == k) for k in keys]
