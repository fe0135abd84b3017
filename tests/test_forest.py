"""Blocks by joins against the depth-first search, and forests against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from affilia.operators import connectivity, forest

from . import fixtures


def many_graphs():
    """A disjoint union: paths, stars, cycles, trees, dense and sparse random graphs, cliques joined at vertices."""
    rng, out, base = random.Random(7), list(fixtures.GENERIC), 100

    def add(pairs, n):
        nonlocal base
        names = list(range(base, base + n))
        rng.shuffle(names)
        out.extend((names[a], names[b]) for a, b in pairs)
        base += n

    add([(k, k + 1) for k in range(200)], 201)
    add([(0, k) for k in range(1, 120)], 120)
    add([(k, (k + 1) % 90) for k in range(90)], 90)
    add([(k, rng.randrange(k)) for k in range(1, 150)], 150)
    for n, m in ((30, 29), (30, 34), (60, 75), (25, 120), (80, 88)):
        add([tuple(rng.sample(range(n), 2)) for _ in range(m)], n)
    add([(7 * c + x, 7 * c + y) for c in range(9) for x in range(8) for y in range(x)], 64)
    return out


def test_blocks_by_joins(spark):
    edges = forest.simple(fixtures.edges(spark, many_graphs())).checkpoint()
    labels = connectivity.connected_components(edges).checkpoint()
    rows = lambda df: sorted((r["comp_id"], r["block_a"], r["block_b"], min(r["a"], r["b"]), max(r["a"], r["b"])) for r in df.collect())
    plain = rows(connectivity.block_edges(edges, labels))
    assert rows(connectivity.block_edges(edges, labels, kernel_edges=0)) == plain
    # only components over the limit take the joins
    assert rows(connectivity.block_edges(edges, labels, kernel_edges=90)) == plain
    assert len({r[1:3] for r in plain}) > 300


@pytest.mark.parametrize("weights", [1, 4, 1000])
def test_forest(spark, weights):
    rng = random.Random(weights)
    pairs = sorted({(min(p), max(p)) for p in many_graphs() if p[0] != p[1]})
    rows = [(a, b, rng.randrange(weights)) for a, b in pairs]
    found = sorted((r["w"], r["a"], r["b"]) for r in forest.spanning_forest(spark.createDataFrame(rows, "a long, b long, w long")).collect())
    root, want = {}, []

    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.append((w, a, b))
    assert found == want


def test_empty(spark):
    none = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "vid long, comp_id long")
    assert forest.block_edges(none, labels).count() == 0
    assert forest.spanning_forest(none.withColumn("w", F.lit(0))).count() == 0
