import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tokentally.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, part string, word int, fails string, digest int"
LABELS = "doc_id long, quality int, toxic int, word string"


def flags(text, seen_before):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": seen_before}


def brute(rows, labels):
    """Every document through every order, one after the other."""
    good = {d for d, q, t in labels if q == 1}
    toxic = {d for d, q, t in labels if t == 1}
    docs = []
    for d, text, lang in rows:
        text = text or ""
        docs.append((d, lang or "", flags(text, d is not None and any(e is not None and e < d and (o or "") == text for e, o, _ in rows))))
    out, summed = {}, Counter()
    for part in {p for _, p, _ in docs}:
        mine = [(d, f) for d, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                failing = sum(f[x] for _, f in mine)
                summed[part, x] += len(gone)
                out[part, order, step] = (x, len(left), len(gone), failing - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in mine),
                                          sum(d in good for d, _ in gone if d is not None), sum(d in toxic for d, _ in gone if d is not None))
    return {k: (*v, summed[k[0], v[0]]) for k, v in out.items()}


def sample_rows(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        size = rng.choice([0, 1, 50, 199, 200, 201, 400])
        vocab = [f"{'W' if rng.random() < .2 else 'w'}{i}" for i in range(rng.choice([5, 100, 1000]))]
        text = rng.choice([" ", "  ", "\x0b\t"]).join(rng.choice(vocab) for _ in range(size))
        rows.append((d, text + rng.choice(["", "", "#", " É", " \x1f "]), rng.choice(["en", "de", "", None])))
    rows += [(100 + d, rows[rng.randrange(20)][1], rng.choice(["en", "fr"])) for d in range(30)]
    rows += [(200, None, "en"), (201, "", None), (None, rows[3][1], "en"), (None, None, None), (7, rows[7][1], "en"), (7, rows[8][1], "en")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 130, 2)] + [(2, 1, 0), (2, 1, 1), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)
    return A.filter_audit(docs.repartition(5), spark.createDataFrame([(*r, "z") for r in labels], LABELS))


def test_equals_every_order_one_after_the_other(spark):
    rows, labels = sample_rows()
    out = run(spark, rows, labels)
    got = {(r.part, r.filter_order, r.step): (r["filter"], r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}
    assert got == brute(rows, labels)


def test_hot_text_and_very_long_text(spark):
    rows = [(d, "the same", "en") for d in range(3000)] + [(5000, "word " * 300_000, "en"), (5001, "Ä" * 1_000_000, "en")]
    words = A.survival_words(spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS), spark.createDataFrame([], LABELS))
    late = {r.doc_id for r in words.where("fails >= 16").collect()}
    assert late == set(range(1, 3000))
    assert {r.doc_id: r.fails for r in words.where("doc_id >= 5000").collect()} == {5000: 2, 5001: 1}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 4097])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, np.uint32)
    assert A.positional_popcount(words).tolist() == [sum(int(w) >> b & 1 for w in words) for b in range(32)]


def test_empty_tables(spark):
    assert run(spark, [], []).collect() == []
    out = run(spark, [(1, None, None)], [])
    assert out.count() == 600 and {r.part for r in out.collect()} == {""}
