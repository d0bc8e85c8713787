import math

import numpy as np
import pytest

from tokentally.llm import ann, vectors
from tokentally.llm import exact_topk as X

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, x int"


def rows_of(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    if clusters:
        v = 3 * rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.3 * v
    return [(i, [float(x) for x in row], 1, "s", 2) for i, row in enumerate((v / 4).astype(np.float32))]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(1000, None, 1, "a", 1), (1050, [0.1] * 3 + [None], 1, "a", 1), (1100, [nan] * 4, 1, "a", 1), (1150, [inf, 0.0, 0.0, 0.0], 1, "a", 1),
            (None, [1.0, 1.0, 1.0, 1.0], 1, "a", 1), (1200, [], 1, "a", 1), (1201, [], 1, "a", 1), (1250, [1.0, 2.0], 1, "a", 1)]


def usable(rows):
    return [(r[0], np.array(r[1], np.float64)) for r in rows
            if r[0] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


def brute(rows, score, k=5, every=50):
    own = usable(rows)
    out = []
    for qid in sorted({i for i, _ in own if i % every == 0}):
        q = np.array(min(v.tolist() for i, v in own if i == qid))
        found = sorted((-score(q, v), i) for i, v in own if i != qid and len(v) == len(q))[:k]
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def integer(q, v):
    return int((np.floor(256 * q).astype(object) * np.floor(256 * v).astype(object)).sum()) if len(q) else 0


def test_exact_topk_equals_brute_force(spark):
    rows = rows_of(500, 4, 1) + odd_rows() + rows_of(60, 2, 2)[:3]
    rows += [(2000 + i, rows[50][1], 1, "copy", 1) for i in range(20)] + [rows[50], rows[7], rows[7]]  # ties, repeats, a hot vector
    rows = [r for r in rows if r[0] is None or r[0] != 0 or len(r[1]) == 4]
    got = X.exact_topk(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, integer)


def test_exact_topk_refines_over_rounds_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 200)
    rows = [(i, [v * 1000 for v in e], r, s, x) for i, e, r, s, x in rows_of(300, 4, 3)]  # three rounds and more
    got = X.exact_topk(spark.createDataFrame(rows, SCHEMA).repartition(3), k=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, integer, k=3)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = rows_of(3, 4, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in X.exact_topk(df).collect()) == brute(rows, integer)
    for search in (X.exact_topk, ann.nearest):
        assert search(df.limit(0)).count() == 0
        assert search(df.where("vec_id > 0")).count() == 0
    with pytest.raises(ArithmeticError):
        X.exact_topk(spark.createDataFrame([(0, [1e30], 1, "a", 1), (1, [1e30], 1, "a", 1)], SCHEMA))


def cosine(q, v):
    return float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum())))


@pytest.mark.parametrize("clusters", [0, 6])
def test_recall_against_brute_force(spark, clusters):
    rows = rows_of(3000, 32, 5, clusters)
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows, cosine)
    assert len(got) == len(want) == 300
    truth = {(q, v): s for q, _, v, s in want}
    hit = sum((r.query_id, r.vec_id) in truth for r in got)
    assert hit >= 0.93 * len(want)
    vec = dict(usable(rows))
    for r in got:
        assert r.score == pytest.approx(cosine(vec[r.query_id], vec[r.vec_id]), abs=1e-12)
    for q in {r.query_id for r in got}:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and own == sorted(own, key=lambda r: (-r.score, r.vec_id))


def test_nearest_with_odd_rows_ties_and_repeats(spark):
    rows = rows_of(200, 4, 6) + odd_rows() + [(1300, [0.0] * 4, 1, "zero", 1)]
    rows += [(2000 + i, rows[50][1], 1, "copy", 1) for i in range(20)] + [rows[50]]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), confidence=0.999999).collect()]
    live = [r for r in rows if r[1] and any(r[1])]
    want = brute(live, cosine)
    assert [(q, n, v) for q, n, v, _ in sorted(got)] == [(q, n, v) for q, n, v, _ in want]


def test_tree_boxes_and_quantile():
    rng = np.random.default_rng(0)
    p = rng.standard_normal((1000, 6))
    tree = ann.KdTree(p, leaf=10)
    d = tree.box_distances(p[3])
    assert sorted(tree.order.tolist()) == list(range(1000))
    for node, (a, b) in enumerate(tree.span):
        assert ((p[tree.order[a:b]] - p[3]) ** 2).sum(1).min() >= d[node] - 1e-12
    assert ann.KdTree(np.zeros((500, 6)), leaf=10).span == [(0, 500)]
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_nearest_of_very_large_and_very_small_vectors(spark):
    rows = rows_of(200, 4, 8)
    scales = [1.0, 1e200, 1e-200, 1e300, 5e-324]
    scaled = [(i, [float(v) * scales[i % 4] for v in x], *rest) for i, x, *rest in rows]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(scaled, SCHEMA.replace("array<float>", "array<double>")).repartition(3), confidence=0.999999).collect()]
    want = brute(rows, cosine)
    assert [(q, n, v) for q, n, v, _ in sorted(got)] == [(q, n, v) for q, n, v, _ in want]
    assert [s for *_, s in sorted(got)] == pytest.approx([s for *_, s in want], abs=1e-12)
    mixed = [(0, [1e200, 1e-200], 1, "a", 1), (1, [1e200, 1.0], 1, "a", 1), (2, [5e-324, 0.0], 1, "a", 1), (3, [0.0, 1e308], 1, "a", 1)]
    assert [(r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(mixed, SCHEMA.replace("array<float>", "array<double>"))).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 0.0)]
