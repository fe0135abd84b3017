"""Whole components in one task, many together, against the forms that hold a component by joins or arrays."""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from affilia.functions import columns as fn
from affilia.operators import components, connectivity, graph, paths
from affilia.operators.kernels import PathGraph, block_scores

from .test_blockcut import _cacti
from .test_graph import _scores_of_members


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def _islands(spark, odd=True):
    """Two-mode edges (even a, odd b) of many components, one of them long."""
    rng = np.random.default_rng(5)
    pairs = {(2 * (100 * k + int(a)), 2 * (100 * k + int(b)) + 1) for k in range(12) for a, b in rng.integers(0, 9, (12, 2))}
    pairs |= {p for k in range(40) for p in ((5000 + 2 * k, 5001 + 2 * k), (5002 + 2 * k, 5001 + 2 * k))}
    return spark.createDataFrame(sorted(pairs), "a long, b long")


def test_norm_of_large_graphs(spark):
    n = 3_000_000
    got = spark.range(1).select(*[fn.betweenness_norm(k, F.lit(n)).alias(f"n{k}") for k in range(3)]).first()
    assert tuple(got) == (0.5, 1.0 / ((n - 2) * (n - 1)), 1.0 / (n * (n - 1)))


def test_two_mode_components(spark):
    e = _islands(spark)
    assert _rows(connectivity.connected_components(e, kernel_edges=0), "vid", "comp_id") == _rows(connectivity.connected_components(e), "vid", "comp_id")


def test_paths_by_component(spark, monkeypatch):
    """More edges than are broadcast: small components together, a large one by itself; no batch per pair of all vertices."""
    e = _islands(spark).withColumn("length", F.lit(1).cast("long"))
    want = _rows(paths.shortest_paths(e), "s", "v", "distance", "n_paths")
    monkeypatch.setattr(components, "PACK_ROWS", 10)
    seen = []
    monkeypatch.setattr(paths, "COMPONENT_EDGES", 60)
    monkeypatch.setattr(paths, "frontier_paths", lambda edges, **given: seen.append(edges.count()) or paths.shortest_paths(edges))
    assert _rows(paths.shortest_paths(e, limit=70), "s", "v", "distance", "n_paths") == want
    assert seen == [80]


def test_members_of_a_graph(spark):
    e = _islands(spark)
    old = connectivity.block_members(connectivity.block_edges(e))
    for limit in (10**6, 20):
        new = connectivity.graph_members(e, kernel_edges=limit)
        assert _rows(new, "comp_id", "block_id", "vid") == _rows(old, "comp_id", "block_id", "vid")
        for f in (connectivity.cut_vertices, connectivity.block_cut_counts, connectivity.block_cut_forest):
            assert _rows(f(new), *sorted(f(old).columns)) == _rows(f(old), *sorted(f(old).columns))


def test_kernels_of_many_components():
    for lengths_alike in (True, False):
        ns, xs, ys, far, mults, weights, comps, want, at = [], [], [], [], [], [], [], [], 0
        for k, (n, x, y, length, mult, counted) in enumerate(_cacti()):
            length = np.ones(len(x), int) if lengths_alike else length
            want += list(_scores_of_members(n, x, y, length, mult, counted))
            xs, ys, far, mults = [*xs, *(x + at)], [*ys, *(y + at)], [*far, *length], [*mults, *mult]
            weights, comps, at = [*weights, *np.where(counted, mult, 0)], [*comps, *[k] * n], at + n
        x, y, far, mult, weight, comp = map(np.array, (xs, ys, far, mults, weights, comps))
        assert np.allclose(block_scores(at, x, y, far, mult.astype(float), weight.astype(float), comp), want)
        one = PathGraph(at, x, y, far, mult)
        one.parts = np.flatnonzero(np.diff(comp, prepend=-1))
        found = {(int(s), int(v)): (d, p) for part in one.search_all(cells=200) for s, v, d, p in zip(*part)}
        for s in range(at):
            for v, d, p in zip(*one.search(s)):
                assert found.pop((s, int(v))) == (d, p)
        assert not found


def test_components_are_never_split(spark, monkeypatch):
    rows = spark.range(0, 1000).select((F.col("id") % 7).alias("k"), "id")
    seen = components.by_component(rows, "k", lambda t: [pa.table({"k": t.column("k").unique(), "n": [t.column("k").to_pylist().count(x) for x in t.column("k").unique().to_pylist()]})], "k long, n long", pack_rows=10)
    assert sorted(r.k for r in seen.collect()) == list(range(7)) and {r.n for r in seen.collect()} <= {142, 143}


def test_hours_of_tied_rows(spark):
    """Of rows with equal row_ids the first in the file counts, however they are dealt."""
    rows = [(8, k, 1, 1 + k % 4, (k, 0)) for k in range(200, 0, -1)] + [(9, 1, 2, 3, (5, 0)), (9, 2, 2, 4, (4, 0)), (8, 3, 2, 1, (1, 0))]
    enrol = spark.createDataFrame(rows, "row_id long, stid long, crsid long, hours long, place struct<row_index: long, file: long>").repartition(16)
    assert {r.crsid: r.hours for r in graph.course_attributes(enrol).collect()} == {1: 2, 2: 4}


def test_parts_together_by_length():
    """Small parts of different lengths go through one search, with the gains of searches one by one."""
    x, y, length = np.array([0, 0, 1, 1, 4, 4, 5]), np.array([1, 2, 3, 2, 5, 6, 6]), np.array([3, 12, 4, 6, 3, 6, 3])
    graph = PathGraph(7, x, y, length)
    graph.parts, got, want = np.array([0, 4]), np.zeros(7), np.zeros(7)
    assert not graph.uniform and len(graph._together(0, 2, graph.weight > 0)[0]) == 4**2 + 3**2
    graph.add_all(got)
    for s in range(7):
        graph.add_dependencies(s, want)
    assert np.allclose(got, want) and graph._together(0, 2, graph.weight > 0)[2].max() == 10
