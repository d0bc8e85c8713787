import random
import zlib
from collections import Counter

import pytest

from tokentally.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, form string"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for d, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                if h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                counts[run] += 1
                run = ""
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    out = {}
    for w in n:
        others = [o for o in n if o != w and near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(df.repartition(5)).collect()}


def corpus(seed=1, docs=400):
    rng = random.Random(seed)
    letters = "aabcdeefghéÉß×"
    vocab = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 12))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    weights = [rng.choice([1, 1, 5, 60, 600]) for _ in vocab]
    rows = []
    for d in range(docs):
        words = rng.choices(vocab, weights, k=rng.randint(0, 120))
        for i, w in enumerate(words):
            if rng.random() < .06 and w:
                at = rng.randrange(len(w))
                words[i] = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]])
            elif rng.random() < .1:
                words[i] = w.upper()
        rows.append((d, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    rows += [(None, rows[3][1]), (None, None), (7, ""), (7, rows[7][1]), (7, rows[7][1]), (900, "1234 -- Ā 中")]
    got, want = run(spark, rows), brute(rows)
    assert got == want
    assert sum(v[3] for v in want.values()) > 100 and any(v[0] for v in want.values()) and any(not v[0] for v in want.values())


def test_chains_of_forms_end_at_the_most_frequent(spark):
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    rows = [(1, " ".join(w for w, n in zip(chain, (2, 25, 260, 2700)) for _ in range(n)))]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({v[1] for w, v in got.items() if w in chain}) == 1 and got["abcdefgh"][0] == "abcdefghi"


def test_index_keys_meet_for_every_edit():
    rng = random.Random(5)
    for _ in range(3000):
        w = "".join(rng.choice("aab") for _ in range(rng.choice([7, 8, 9, 10, 11, 47, 48, 49, 50, 51, 99])))
        at, c = rng.randrange(len(w)), rng.choice("abc")
        v = rng.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]])
        if v == w:
            continue
        frequency = Counter(x[i:i + 2] for x in (w, v) for i in range(len(x) - 1))
        for f in (frequency, {g: rng.randint(1, 3) for g in frequency}, {g: 1 for g in frequency}):
            (wi, wp, wl), (vi, vp, vl) = S.keys_of(w, f), S.keys_of(v, f)
            if (f[wl], wl) <= (f[vl], vl):  # the rarer end looks up the other, both if they tie
                assert set(wp) & set(vi)
            if (f[vl], vl) <= (f[wl], wl):
                assert set(vp) & set(wi)


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = random.Random(2)
    for _ in range(500):
        prefix = [(rng.randint(1, 9), i, "ab") for i in rng.sample(range(12), rng.randint(3, 8))]
        got = S.pivots(prefix)
        disjoint = [(a[0] + b[0]) for a in prefix for b in prefix if a[1] + 2 <= b[1]]
        assert abs(got[0][1] - got[1][1]) >= 2 and got[0][0] + got[1][0] == min(disjoint)


def test_long_runs_and_few_words(spark):
    long = "ab" * 6_000
    rows = [(1, f"{long} {long} {long}x {long}x"), (2, "x " * 10)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {} and run(spark, [(1, None)]) == {}


@pytest.mark.parametrize("held", [1, 500])
def test_counts_do_not_depend_on_what_a_task_holds(spark, monkeypatch, held):
    rows = corpus(4, 30)
    monkeypatch.setattr(S, "_HELD_BYTES", held)
    assert run(spark, rows) == brute(rows)
