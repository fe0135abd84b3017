import math
import random

import numpy as np

from affilia.llm import topk


def brute(rows, k):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, u in {(i, tuple(u)) for i, u in usable if i % 20 == 0}:
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(u, w)))), i) for i, w in usable if i != q and len(w) == len(u))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_search_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(300)] + [(1000 + i, [0.5] * 40) for i in range(40)]
    rows += [(2000, None), (2020, [None] * 40), (2040, [float("nan")] * 40), (None, [0.1] * 40), (2060, [1.0, 2.0]), (2061, [1.0, 2.0]), (2080, [])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = topk.search(df, df.where("vec_id % 20 = 0"), row_block=50, query_block=7)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 20)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).count() == 0


def test_block_bounds():
    rng = np.random.default_rng(1)
    q, r = np.floor(rng.normal(size=(9, 30)) * 64), np.floor(rng.normal(size=(200, 30)) * 64)
    qi, ri, s = topk.best_of_block(np.arange(9), q, np.arange(100, 300), r, 5, step=4)
    for k in range(9):
        exact = q[k] @ r.T
        assert sorted(s[qi == k], reverse=True) == sorted(exact, reverse=True)[:5]


def test_bounds_remove_most_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64)) * 64
    r = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 8)
    q = np.floor(centres[rng.integers(0, 40, 50)] + rng.normal(size=(50, 64)) * 8)
    work = {}
    qi, ri, s = topk.best_of_block(np.arange(50), q, np.arange(100, 4100), r, 20, work=work)
    assert work["computed"] < 0.6 * work["all"]
    for k in range(50):
        assert sorted(s[qi == k], reverse=True) == sorted(q[k] @ r.T, reverse=True)[:20]
    floors = np.array([sorted(x, reverse=True)[19] for x in q @ r.T])
    again = {}
    qi2, _, s2 = topk.best_of_block(np.arange(50), q, np.arange(100, 4100), r, 20, floors, work=again)
    assert sorted(zip(qi, s)) == sorted(zip(qi2, s2)) and again["computed"] < work["computed"]


def test_large_components(spark):
    rows = [(0, [3e5, 1.0]), (20, [1.0, 1e12]), (21, [-2e9, 5e8]), (22, [7e6, 1e12]), (23, [1e12, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id % 20 = 0"))
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 20)
