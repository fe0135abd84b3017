"""Connected components, biconnected blocks, cut vertices, block-cut forest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest
from .components import by_component, discard, ensure_checkpoint_dir, settled, star_components
from .graph import both_ways, vid_is_student
from .kernels import block_copies, blocks, least_reachable

#: Up to so many edges one array kernel labels the components; beyond, a distributed loop does.
KERNEL_EDGES = 1_000_000
#: Each round leaves a part of the vertices in expectation, whatever the graph.
MOST_ROUNDS = 200


def _label_all(table: pa.Table) -> pa.Table:
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_reachable(len(ids), where[: len(a)], where[len(a) :])
    return pa.table({"vid": ids, "comp_id": ids[label]})


def _contracted(edges: DataFrame, kernel_edges: int) -> DataFrame:
    """vid, root of all vertices with an edge: root is some vertex of the component, the same for all of it.

    edges: a, b (settled, no loops; discarded here). Every vertex becomes one
    with the first of its neighbours and itself, in an order that is another
    one each round, so edges get fewer from round to round and no numbering
    makes many rounds. The last ``kernel_edges`` edges are one array kernel's.
    """
    now, steps = edges, []
    for seed in range(MOST_ROUNDS):
        if now.count() <= kernel_edges:
            break
        order = lambda c: F.struct((F.xxhash64(F.lit(seed), F.col(c)) if seed else F.lit(0)).alias("x"), F.col(c).alias("vid"))
        first = both_ways(now).groupBy("a").agg(F.min(order("b")).alias("first"))
        step = settled(first.select(F.col("a").alias("vid"), F.least("first", order("a"))["vid"].alias("root")))
        to = lambda c: step.select(F.col("vid").alias(c), F.col("root").alias(f"to_{c}"))
        moved = now.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
        last, now = now, settled(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
        discard(last)
        steps.append(step)
    else:
        raise RuntimeError(f"components have not converged after {MOST_ROUNDS} rounds")
    roots = now.groupBy(F.lit(0).alias("all")).applyInArrow(_label_all, "vid long, comp_id long").toDF("vid", "root")
    roots = settled(roots)
    for step in reversed(steps):
        last, roots = roots, settled(step.join(roots.select(F.col("vid").alias("root"), F.col("root").alias("top")), "root", "left").select("vid", F.coalesce("top", "root").alias("root")))
        discard(last)
        discard(step)
    discard(now)
    return roots


def _two_mode_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(b, m: a smallest neighbour of each b; the a's as edges for ``_contracted``) of a graph whose vertices are either always a or always b of an edge.

    Only the a's of one b are contracted: fewer edges over half the distance.
    """
    least = settled(edges.groupBy("b").agg(F.min("a").alias("m")))
    return least, settled(edges.join(least, "b").where("a <> m").select("a", F.col("m").alias("b")))


def _two_mode_components(edges: DataFrame, kernel_edges: int) -> DataFrame:
    """vid, comp_id of a graph whose vertices are either always a or always b of an edge."""
    least, links = _two_mode_links(edges)
    found = _contracted(links, kernel_edges)
    root = lambda rows, key: rows.join(found.withColumnRenamed("vid", key), key, "left").withColumn("root", F.coalesce("root", key))
    rows = root(edges.select("a").distinct(), "a").select(F.col("a").alias("vid"), "root")
    rows = settled(rows.union(root(least.withColumnRenamed("m", "a"), "a").select(F.col("b").alias("vid"), "root")))
    labels = settled(rows.join(rows.groupBy("root").agg(F.min("vid").alias("comp_id")), "root").select("vid", "comp_id"))
    for table in (least, found, rows):
        discard(table)
    return labels


def _across(edges: DataFrame) -> tuple[int, bool]:
    """(how many edges, whether all lead from an even a to an odd b)."""
    seen = edges.agg(F.count("*").alias("n"), F.count_if((F.col("a") % 2 == 0) & (F.col("b") % 2 == 1)).alias("across")).first()
    return seen["n"], seen["across"] == seen["n"]


def grouped_edges(edges: DataFrame, labels: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """The edges (a, b and more; settled) and comp, which tells components apart: a vertex of each, no particular one.

    A column m, if there is one, is some a of each b, the same for all its edges, which may be repeated; m is dropped.
    """
    n, across = _across(edges)
    kept = [c for c in edges.columns if c != "m"]
    if labels is None and n > kernel_edges and across:
        # where the a's are known the b's need no label
        if "m" in edges.columns:
            links = settled(edges.where("a <> m").select("a", F.col("m").alias("b")))
        else:
            least, links = _two_mode_links(edges)
            discard(least)
        found = _contracted(links, kernel_edges)
        out = settled(edges.join(found.withColumnRenamed("vid", "a"), "a", "left").select(F.coalesce("root", "a").alias("comp"), *kept))
        discard(found)
        return out
    if labels is None:
        labels = connected_components(edges.select("a", "b").distinct() if "m" in edges.columns else edges, kernel_edges=kernel_edges)
    return settled(edges.join(labels.select(F.col("vid").alias("a"), F.col("comp_id").alias("comp")), "a").select("comp", *kept))


def larger(grouped: DataFrame, limit: int) -> DataFrame:
    """comp of the components of more than ``limit`` edges."""
    return settled(grouped.groupBy("comp").count().where(F.col("count") > limit).select("comp"))


def named(grouped: DataFrame) -> DataFrame:
    """vid, comp_id (smallest vid) of the vertices of grouped edges (comp, a, b)."""
    rows = grouped.select("comp", F.explode(F.array("a", "b")).alias("vid")).distinct()
    return settled(rows.join(rows.groupBy("comp").agg(F.min("vid").alias("comp_id")), "comp").select("vid", "comp_id"))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """vid, comp_id (smallest vid). vertices (vid) adds isolated ones as components of their own."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = settled(edges.select("a", "b"))
    n, across = _across(edges)
    if n <= kernel_edges:
        labels = edges.groupBy(F.lit(0).alias("all")).applyInArrow(_label_all, "vid long, comp_id long")
    elif across:
        labels = _two_mode_components(edges, kernel_edges)
        discard(edges)
    else:
        labels = star_components(edges)
    if vertices is None:
        return labels
    return vertices.select("vid").join(labels, "vid", "left").select("vid", F.coalesce("comp_id", "vid").alias("comp_id"))


def nested_components(edges: DataFrame, levels: int) -> list[DataFrame]:
    """vid, comp_id at each of the levels 0 to ``levels`` - 1 of graphs that shrink from level to level.

    edges: a, b, alive; an edge is there at the levels below alive. One spanning
    forest of the longest-lived edges has the components of all levels: from the
    last level to the first each of its edges joins two components once, so
    edges are never copied per level. Vertices without an edge are left out.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = settled(edges.where("alive > 0"))
    tree = settled(forest.spanning_forest(edges.select("a", "b", (-F.col("alive")).alias("w"))))
    ends = edges.select(F.explode(F.array("a", "b")).alias("vid"), "alive")
    now = settled(ends.groupBy("vid").agg(F.max("alive").alias("alive")).select("vid", F.col("vid").alias("comp_id"), "alive"))
    out = []
    for level in reversed(range(levels)):
        joining = tree.where(F.col("w") == -(level + 1))
        of = lambda c: now.select(F.col("vid").alias(c), F.col("comp_id").alias(f"to_{c}"))
        merged = star_components(joining.join(of("a"), "a").join(of("b"), "b").select("to_a", "to_b")).select(F.col("vid").alias("comp_id"), F.col("comp_id").alias("to"))
        now = settled(now.join(merged, "comp_id", "left").select("vid", F.coalesce("to", "comp_id").alias("comp_id"), "alive"))
        out.append(now.where(F.col("alive") > level).select("vid", "comp_id"))
    return out[::-1]


def _simple(table: pa.Table):
    """(low, high, ids, places of the ends in ids) of the different edges, sorted."""
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    key = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y))
    x, y = key // len(ids), key % len(ids)
    return ids[x], ids[y], ids, x, y


def _comp_of(table: pa.Table, ids: np.ndarray) -> np.ndarray:
    """Each vertex's component: the smallest of the vertices that have its comp."""
    comp = np.empty(len(ids), np.int64)
    comp[np.searchsorted(ids, table.column("a").to_numpy())] = comp[np.searchsorted(ids, table.column("b").to_numpy())] = table.column("comp").to_numpy()
    _, first, where = np.unique(comp, return_index=True, return_inverse=True)
    return ids[first][where]


def _label_blocks(table: pa.Table):
    low, high, ids, x, y = _simple(table)
    block = blocks(len(ids), x, y)
    yield pa.table({"comp_id": _comp_of(table, ids)[x], "block_a": low[block], "block_b": high[block], "a": low, "b": high})


def _label_members(table: pa.Table):
    low, high, ids, x, y = _simple(table)
    block, of, vertex, _ = block_copies(len(ids), x, y)
    first = np.unique(block, return_index=True)[1]
    yield pa.table({"comp_id": _comp_of(table, ids)[vertex], "block_a": low[first[of]], "block_b": high[first[of]], "vid": ids[vertex], "n_blocks": np.bincount(vertex, minlength=len(ids))[vertex]})


def _label_sizes(table: pa.Table):
    """A row for each block, as of ``block_rows``."""
    low, high, ids, x, y = _simple(table)
    block, of, vertex, _ = block_copies(len(ids), x, y)
    first = np.unique(block, return_index=True)[1]
    comp = np.searchsorted(ids, _comp_of(table, ids))
    joint = np.bincount(vertex, minlength=len(ids))[vertex] > 1
    cuts, where = np.bincount(of, joint, len(first)).astype(np.int64), comp[x[first]]
    yield pa.table({
        "comp_id": ids[where], "block_a": low[first], "block_b": high[first],
        "n_students": np.bincount(of, ids[vertex] % 2 == 0, len(first)).astype(np.int64), "n_vertices": np.bincount(of, minlength=len(first)),
        "cut_count": cuts, "comp_vertices": np.bincount(comp, minlength=len(ids))[where], "leaf_count": np.bincount(where, cuts <= 1, len(ids)).astype(np.int64)[where],
    })


def _tagged(edges: DataFrame, labels: DataFrame | None, kernel_edges: int):
    """(comp, a, b of all edges, the comp of components of more edges than ``kernel_edges``)."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = settled(edges.select("a", "b"))
    tagged = grouped_edges(edges, labels)
    discard(edges)
    return tagged, larger(tagged, kernel_edges)


def _joined_blocks(tagged: DataFrame, large: DataFrame) -> DataFrame:
    """``block_edges`` of the large components, by joins."""
    rest = settled(tagged.join(large, "comp", "left_semi").select("comp", "a", "b"))
    return forest.block_edges(rest.select("a", "b"), named(rest))


def block_edges(edges: DataFrame, labels: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """comp_id, block_a, block_b, a, b: each edge with its block's smallest edge.

    Components are independent: those of up to ``kernel_edges`` edges are
    searched depth-first, each in one task; larger ones by joins, together.
    """
    tagged, large = _tagged(edges, labels, kernel_edges)
    schema = "comp_id long, block_a long, block_b long, a long, b long"
    if large.isEmpty():
        return by_component(tagged, "comp", _label_blocks, schema)
    small = by_component(tagged.join(large, "comp", "left_anti"), "comp", _label_blocks, schema)
    return small.union(_joined_blocks(tagged, large))


def graph_members(edges: DataFrame, labels: DataFrame | None = None, vertices: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``block_members`` of a graph's ``block_edges`` plus n_blocks, the blocks of each vertex.

    A component searched in one task is never shuffled again.
    """
    tagged, large = _tagged(edges, labels, kernel_edges)
    of = lambda rows: by_component(rows, "comp", _label_members, "comp_id long, block_a long, block_b long, vid long, n_blocks long").select("comp_id", block_id().alias("block_id"), "vid", "n_blocks")
    if large.isEmpty():
        rows = of(tagged)
    else:
        found = settled(block_members(_joined_blocks(tagged, large)))
        counts = found.groupBy("vid").agg(F.count("*").alias("n_blocks"))
        rows = of(tagged.join(large, "comp", "left_anti")).union(found.join(counts, "vid").select("comp_id", "block_id", "vid", "n_blocks"))
    if vertices is None:
        return rows
    alone = vertices.select("vid").join(tagged.select(F.explode(F.array("a", "b")).alias("vid")), "vid", "left_anti")
    return rows.union(alone.select(F.col("vid").alias("comp_id"), block_id("vid", "vid").alias("block_id"), "vid", F.lit(1).cast("long")))


def block_rows(edges: DataFrame, labels: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """One row per block: comp_id, block_id, n_students, n_vertices, cut_count, comp_vertices and leaf_count, as of ``block_sizes`` and ``block_cut_forest``.

    A component searched in one task leaves it as these rows only.
    """
    tagged, large = _tagged(edges, labels, kernel_edges)
    out = ["comp_id", "block_id", "n_students", "n_vertices", "cut_count", "leaf_count", "comp_vertices"]
    of = lambda rows: by_component(rows, "comp", _label_sizes, "comp_id long, block_a long, block_b long, n_students long, n_vertices long, cut_count long, comp_vertices long, leaf_count long").withColumn("block_id", block_id()).select(*out)
    if large.isEmpty():
        return of(tagged)
    members = settled(block_members(_joined_blocks(tagged, large)))
    return of(tagged.join(large, "comp", "left_anti")).union(block_cut_forest(members).join(block_sizes(members).select("block_id", "n_students"), "block_id").select(*out))


def block_id(a="block_a", b="block_b"):
    return F.concat_ws("-", a, b)


def block_members(found: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """comp_id, block_id, vid. vertices (vid) adds isolated ones as blocks of one vertex."""
    rows = found.select("comp_id", block_id().alias("block_id"), F.explode(F.array("a", "b")).alias("vid")).distinct()
    if vertices is None:
        return rows
    alone = vertices.select("vid").join(rows.select("vid"), "vid", "left_anti")
    return rows.union(alone.select(F.col("vid").alias("comp_id"), block_id("vid", "vid").alias("block_id"), "vid"))


def block_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("block_id").agg(F.count_if(vid_is_student(F.col("vid"))).alias("n_students"), F.count("*").alias("n_vertices"))


def _counted(members: DataFrame) -> DataFrame:
    """The members with n_blocks, the number of each vertex's blocks."""
    if "n_blocks" in members.columns:
        return members
    return members.join(members.groupBy("vid").agg(F.count("*").alias("n_blocks")), "vid")


def cut_vertices(members: DataFrame) -> DataFrame:
    """vid, n_blocks of the vertices in several blocks."""
    if "n_blocks" in members.columns:
        return members.where("n_blocks > 1").groupBy("vid").agg(F.count("*").alias("n_blocks"))
    return members.groupBy("vid").agg(F.count("*").alias("n_blocks")).where("n_blocks > 1")


def block_cut_counts(members: DataFrame) -> DataFrame:
    """block_id, cut_count: how many cut vertices each block has."""
    return _counted(members).groupBy("block_id").agg(F.count_if(F.col("n_blocks") > 1).alias("cut_count"))


def block_cut_forest(members: DataFrame) -> DataFrame:
    """One row per block: comp_id, n_vertices, cut_count, and its component's leaf blocks (cut_count <= 1) and vertices."""
    counted = _counted(members)
    cut = F.col("n_blocks") > 1
    rows = settled(counted.groupBy("comp_id", "block_id").agg(F.count("*").alias("n_vertices"), F.count_if(cut).alias("cut_count"), F.count_if(~cut).alias("own")))
    # a component's vertices are those of one block and the cut vertices, each once
    joints = counted.where(cut).groupBy("comp_id", "vid").agg(F.lit(1).alias("one")).groupBy("comp_id").agg(F.count("*").alias("n_joints"))
    comps = rows.groupBy("comp_id").agg(F.count_if(F.col("cut_count") <= 1).alias("leaf_count"), F.sum("own").alias("own_vertices"))
    comps = comps.join(joints, "comp_id", "left").select("comp_id", "leaf_count", (F.col("own_vertices") + F.coalesce("n_joints", F.lit(0))).alias("comp_vertices"))
    return rows.drop("own").join(comps, "comp_id")
