"""Betweenness over the block-cut tree against all shortest paths between members, and against the plain form."""

import numpy as np
import pytest

from affilia.operators import blockcut, lengths, paths

from .fixtures import GENERIC, edges
from .test_graph import _scores_of_members


def _cacti(turns=10):
    """A disjoint union of random sparse graphs, of merged and uncounted classes: (n, x, y, length, mult, counted) each."""
    rng = np.random.default_rng(12)
    for turn in range(turns):
        n = int(rng.integers(6, 16))
        pairs = {(int(rng.integers(0, v)), v) for v in range(1, n)} | {tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(turn % 5)}
        x, y = map(np.array, zip(*sorted(p for p in pairs if p[0] != p[1])))
        yield n, x, y, rng.integers(1, 4, len(x)) if turn % 2 else np.ones(len(x), int), rng.choice([1, 1, 2, 3], n), rng.random(n) < 0.8


@pytest.mark.parametrize("block_edges", [blockcut.BLOCK_EDGES, 4, 0])
def test_block_betweenness(spark, block_edges):
    """All blocks in one task each, some of them by the whole cluster, all of them."""
    rows, classes, want = [], [], {}
    for k, (n, x, y, length, mult, counted) in enumerate(_cacti()):
        rows += [(100 * k + int(b), 100 * k + int(a), int(far)) for a, b, far in zip(x, y, length)]
        classes += [(100 * k + v, int(mult[v]), bool(counted[v])) for v in range(n)]
        want |= {100 * k + v: s for v, s in enumerate(_scores_of_members(n, x, y, length, mult, counted))}
    e = spark.createDataFrame(rows, "a long, b long, length long")
    c = spark.createDataFrame([*classes, (9999, 2, True)], "vid long, mult long, counted boolean")
    got = {r.vid: r.score for r in blockcut.block_betweenness(e, c, block_edges=block_edges).collect()}
    assert got.keys() == want.keys() | {9999} and got[9999] == 0
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_joins_and_wide_lengths(spark, monkeypatch):
    """Large blocks by frontiers, with lengths of several limbs; a chain of blocks with many cut vertices."""
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 0)
    chain = [(3 * k + i, 3 * k + j) for k in range(5) for i, j in ((0, 1), (1, 2), (2, 3), (0, 2))]
    e = edges(spark, chain)
    vids = sorted({v for p in chain for v in p})
    classes = spark.createDataFrame([(v, 1, v % 4 != 1) for v in vids], "vid long, mult long, counted boolean")
    counted = np.array([v % 4 != 1 for v in vids])
    x, y = map(np.array, zip(*chain))
    want = dict(enumerate(_scores_of_members(len(vids), x, y, np.ones(len(x)), np.ones(len(vids), int), counted)))
    got = {r.vid: r.score for r in blockcut.betweenness(e, classes).collect()}
    far = {r.vid: r.score for r in blockcut.block_betweenness(e, classes, block_edges=0).collect()}
    long = e.withColumn("length", lengths.constant(10**40, 3))
    wide = {r.vid: r.score for r in blockcut.block_betweenness(long, classes).collect()}
    for scores in (got, far, wide):
        assert scores.keys() == want.keys() and all(abs(scores[v] - want[v]) < 1e-9 for v in want)


def test_generic_and_empty(spark):
    classes = spark.createDataFrame([(v, 1, True) for v in range(1, 19)], "vid long, mult long, counted boolean")
    plain = {r.vid: r.score for r in paths.betweenness(edges(spark, GENERIC), classes).collect()}
    got = {r.vid: r.score for r in blockcut.block_betweenness(edges(spark, GENERIC), classes).collect()}
    assert all(abs(got[v] - plain[v]) < 1e-9 for v in plain) and abs(got[7] - 132) < 1e-9
    none = blockcut.block_betweenness(edges(spark, []), classes).collect()
    assert len(none) == 18 and not any(r.score for r in none)


@pytest.mark.parametrize("block_edges", [blockcut.BLOCK_EDGES, 6, 0])
def test_without_classes(spark, block_edges):
    """Every vertex counts once, without a table of vertices."""
    classes = spark.createDataFrame([(v, 1, True) for v in range(1, 19)], "vid long, mult long, counted boolean")
    want = {r.vid: r.score for r in paths.betweenness(edges(spark, GENERIC), classes).collect()}
    got = {r.vid: r.score for r in blockcut.block_betweenness(edges(spark, GENERIC), block_edges=block_edges).collect()}
    assert got.keys() == {v for p in GENERIC for v in p} and all(abs(got[v] - want[v]) < 1e-9 for v in got)
    assert blockcut.block_betweenness(edges(spark, [])).count() == 0
