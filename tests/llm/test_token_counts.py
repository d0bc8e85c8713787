import base64
import math
import random

import public_tokenizers
import regex

from tokentally.llm import token_counts as C

PATH, PATTERN = C.default_vocabulary()
with open(PATH, "rb") as f:
    SCORES = {base64.b64decode(t): -math.log(int(r) + 1) for t, r in map(bytes.split, f)}
TEXTS = ["", None, " ", "a  b\tc", "it's we'll\nNow then", "norw" * 500, "é" * 40 + " ßü 日本語", "word,\nWord. (x) \"y\" end", "x y ", "banana bandana ban band"]


def brute(text):
    total = 0
    for m in regex.findall(public_tokenizers.PATTERN, text or ""):
        p = m.encode()
        best = [(0.0, 0)] + [None] * len(p)
        for j in range(1, len(p) + 1):
            best[j] = min((-(SCORES[p[i:j]] - best[i][0]), best[i][1] + 1) for i in range(j) if p[i:j] in SCORES)
        total += best[-1][1]
    return total


def texts(n):
    rng = random.Random(1)
    bits = ["a", "bc", " ", "\n", "'s", ".", "9", "é", "  ", "The", " und", "ing", "tion", " re", " ", "!!", " "]
    return TEXTS + ["".join(rng.choice(bits) for _ in range(50)) for _ in range(n)]


def test_counts_equal_plain_dynamic_programming(spark):
    xs = texts(150)
    rows = [(i, x, 7) for i, x in enumerate(xs)] + [(1, xs[4], None), (None, xs[4], None)]
    got = C.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)).collect()
    want = [(d, brute(x)) for d, x, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_trie_shares_prefixes_and_starts_again():
    trie = C.CountTrie(SCORES)
    trie.count(b"banana")
    before = len(trie.best)
    trie.count(b"bananas")
    assert len(trie.best) == before + 1 == 8
    trie.clear()
    assert trie.count(b"") == 0 and trie.count(b"a") == 1


def test_empty_table(spark):
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
