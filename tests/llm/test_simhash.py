import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tokentally.llm import simhash as S
from tokentally.llm.graph import components
from tokentally.llm.xxh import xxh64_ranges

SCHEMA = "doc_id long, text string, fingerprint string, cell int, source string"


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """rows: [(doc_id, fp)] -> smallest non-null id reachable, by row."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    low = {}
    for d, f in rows:
        if d is not None:
            r = root(f)
            low[r] = min(low.get(r, d), d)
    return [(d, f, low.get(root(f))) for d, f in rows]


def texts(n, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 6)):
            v = list(base)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            out.append(" ".join(v))
    return out


def test_vectorised_xxh64_equals_the_library():
    rng = random.Random(0)
    buf = rng.randbytes(5000)
    start = np.array([rng.randrange(4000) for _ in range(2000)])
    size = np.array([rng.choice([0, 1, 3, 4, 5, 8, 12, 31, 32, 37, 64, 71, 600]) for _ in range(2000)])
    got = xxh64_ranges(buf, start, size, 42)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(buf[s:s + n], 42) for s, n in zip(start.tolist(), size.tolist())]


def test_fingerprints_equal_the_definition():
    xs = texts(10) + ["", None, " \t\n", "a", "A b", "a B c", "a b c d", "ÀB c\x0bD\x85e f g", "x " * 50_000, "long" * 5000]
    assert [int(x) for x in S.fingerprints(xs)] == [brute_fp(x) for x in xs]


def test_groups_equal_brute_force_with_nulls_ties_repeats_and_clashing_columns(spark):
    xs = texts(40) + ["", None, "one", "One", "same text here now ok"] + ["same text here now ok"] * 5
    rows = [(i * 7 % 1009, t, "clash", 1, "s") for i, t in enumerate(xs)]
    rows += [rows[3], rows[3], (None, xs[0], None, None, None), (None, "alone by itself without any id", None, None, None)]
    got = S.simhash_groups(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute_components([(r[0], brute_fp(r[1])) for r in rows])
    norm = lambda r: (r[0] is None, r[0] or 0, r[1] % 2 ** 64, r[2] is None, r[2] or 0)
    assert sorted(map(norm, got)) == sorted(map(norm, want))
    kept = S.keep_one_per_group(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fingerprint", "cell", "source"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({w[0] for w in want if w[0] is not None and w[0] == w[2]})
    assert kept.where("doc_id is null").count() == 2


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):  # chains and balls around a centre
            fps.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
            if rng.random() < 0.6:
                x = y
    want = {(f, c) for f, _, c in ((f, f, c) for f, _, c in brute_components([(f, f) for f in fps]))}
    signed = [(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fingerprint long")
    links = S.near_links(nodes)
    roots = {r.node % 2 ** 64: r.root for r in components(links).collect()}
    by_want, by_got = {}, {}
    for f, c in want:
        by_want.setdefault(c, set()).add(f)
        by_got.setdefault(roots.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_rounds_and_cells_do_not_change_links():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    fp = np.unique(np.r_[fp, fp ^ np.uint64(3), fp ^ np.uint64(5 << 40)])
    for m in (8, 10):
        masks = S._masks(2, m)
        d = S._parity_np(fp, m) ^ 5
        own = fp[np.isin(d, list(masks))]
        assert len(S.cell_links(own, 5, m, 2, masks)) == len(S.cell_links(own, 5, m, 2, masks, limit=500))


def test_long_chain_and_empty_components(spark):
    n = 400
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert len({roots[i] for i in range(n + 1)}) == 1 and roots[1000] == roots[1001] != roots[0] and len(roots) == n + 3
    assert components(edges.limit(0)).count() == 0


def test_empty_table_and_odd_radius(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.simhash_groups(empty).count() == 0
    assert S.keep_one_per_group(empty).schema == empty.schema
    with pytest.raises(ValueError):
        S.near_links(spark.createDataFrame([], T.StructType([T.StructField("fingerprint", T.LongType())])), radius=3)


def test_repeated_ids_of_unrelated_texts_and_rows_without_id(spark):
    a, b, c, d = ("alpha one two three four five", "beta six seven eight nine ten", "gamma red green blue white black", "delta sun moon star sky rain")
    rows = [(5, a), (5, b), (7, a), (9, b), (2, c), (5, c), (None, d), (None, d), (None, a)]
    docs = spark.createDataFrame([(i, t, "x", 1, s) for s, (i, t) in enumerate(rows)], "doc_id long, text string, fingerprint string, cell int, source int")
    kept = sorted((r.doc_id or 0, r.text, r.source) for r in S.keep_one_per_group(docs.repartition(3)).collect())
    assert kept == sorted([(5, a, 0), (5, b, 1), (2, c, 4), (0, d, 6), (0, a, 8)])


def test_one_per_group_leaves_all_columns_alone(spark):
    rows = [(1, "a b c d e", 7, 8, "x", "y", 5), (2, "a b c d e", 9, 8, "x", "y", 6), (3, "other words here now", 8, None, None, "z", 7), (3, "other words here now", 1, None, None, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _nth int, _keep int, _keep_hash string, _documents_text string, __id int")
    got = sorted(tuple(r) for r in S.keep_one_per_group(docs).collect())
    assert len(got) == 2 and got[0] == rows[0] and got[1] in rows[2:]
    assert S.keep_one_per_group(docs.limit(0)).count() == 0
