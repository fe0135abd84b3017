"""Contraction of components, and blocks that leave the task of their component as one row each."""

import os
import re

import pytest

from affilia.operators import connectivity, forest
from affilia.operators.components import settled
from affilia.plans.queries import REGISTRY

from .fixtures import edges
from .test_forest import many_graphs
from .test_queries import SF


@pytest.fixture(scope="module")
def graph(spark):
    return forest.simple(edges(spark, many_graphs())).checkpoint()


@pytest.mark.parametrize("kernel_edges", [0, 60])
def test_contraction(spark, graph, kernel_edges):
    want = {}
    for r in connectivity.connected_components(graph).collect():
        want.setdefault(r.comp_id, set()).add(r.vid)
    got = {}
    for r in connectivity._contracted(settled(graph.select("a", "b")), kernel_edges).collect():
        got.setdefault(r.root, set()).add(r.vid)
    assert all(root in members for root, members in got.items())
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("kernel_edges", [0, 90, 10**6])
def test_block_rows(spark, graph, kernel_edges):
    members = connectivity.block_members(connectivity.block_edges(graph)).checkpoint()
    columns = ["comp_id", "block_id", "n_vertices", "cut_count", "leaf_count", "comp_vertices", "n_students"]
    want = connectivity.block_cut_forest(members).join(connectivity.block_sizes(members).drop("n_vertices"), "block_id").select(*columns)
    got = connectivity.block_rows(graph, kernel_edges=kernel_edges).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert connectivity.block_rows(graph.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["block_cut_forest", "largest_block", "block_cut_counts"])
def test_no_member_is_shuffled_by_block(spark, name):
    plan = REGISTRY[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(block", plan)


def test_contraction_holds_no_table_it_does_not_read(spark, monkeypatch):
    """Only the edges and the links are on disk when the contraction begins, compressed well."""
    tables, seen, write, contract = [], [], connectivity.settled, connectivity._contracted
    folder = lambda t: t.settled_at.removeprefix("file:")
    there = lambda: [t for t in tables if os.path.exists(folder(t))]
    monkeypatch.setattr(connectivity, "settled", lambda df: tables.append(write(df)) or tables[-1])
    monkeypatch.setattr(connectivity, "_contracted", lambda links, limit: seen.append([t.columns for t in there()]) or contract(links, limit))
    pairs = settled(spark.range(200).selectExpr("2 * id as a", "2 * (id div 3) + 1 as b"))
    assert connectivity.grouped_edges(pairs, kernel_edges=0).select("comp").distinct().count() == 67
    assert seen == [[["a", "b"]]]
    assert all(".zstd." in f for t in there() for f in os.listdir(folder(t)) if f.endswith(".parquet"))
