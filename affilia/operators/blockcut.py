"""Betweenness by blocks: what the block-cut tree decides in closed form, and searches inside blocks only.

A path from one block to another passes their cut vertices whatever the
lengths. So a cut vertex is split into one copy per block, each copy with the
weight (sources and targets) of all that lies behind it, and the blocks are
searched on their own; pairs in different branches of a cut vertex are products
of weights. The weights behind come from an Euler tour of the block-cut tree,
so long chains of blocks take no more rounds than bushy ones. A batch of
sources has the states of its block, not of its component.

All this takes rounds of joins for a component that no task should hold. A
small component has the same steps done on arrays in one task, together with
others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import connectivity, forest, lengths, paths
from .components import by_component, discard, ensure_checkpoint_dir, settled
from .kernels import PathGraph, block_scores
from .ordered import running_total

#: A block, or a whole component, of up to so many edges is searched in one task; larger ones are searched by the whole cluster.
BLOCK_EDGES = 20_000


def _behind(members: DataFrame, cuts: DataFrame) -> DataFrame:
    """block, vid, behind, total: the weight at and behind each cut vertex, seen from each of its blocks, and of the component.

    members: comp_id, block (negative), vid, own. cuts: vid.
    """
    tree = members.join(cuts, "vid", "left_semi").select(F.col("block").alias("a"), F.col("vid").alias("b"))
    inner = members.join(cuts, "vid", "left_anti").groupBy(F.col("block").alias("vid")).agg(F.sum("own").alias("own"))
    joints = members.join(cuts, "vid", "left_semi").groupBy("vid").agg(F.any_value("own").alias("own"))
    tops = members.groupBy("comp_id").agg(F.min("block").alias("top"))
    nodes = members.select("comp_id", F.explode(F.array("block", "vid")).alias("vid")).distinct().join(tops, "comp_id")
    placed = forest.rooted(tree, nodes.select("vid", F.col("top").alias("comp_id")))
    weighed = placed.join(inner.union(joints), "vid", "left").fillna(0, ["own"])
    ends = weighed.select("comp_id", "vid", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(False).alias("ends"), "own"), F.struct(F.col("last").alias("at"), F.lit(True).alias("ends"), F.lit(0).cast("long").alias("own")))).alias("e")).select("comp_id", "vid", "e.*")
    sums = running_total(ends, [F.col("comp_id"), F.col("at")], F.col("own"), "sum")
    below = sums.groupBy("vid").agg(F.sum(F.when(F.col("ends"), F.col("sum")).otherwise(F.col("own") - F.col("sum"))).alias("below"))
    known = settled(placed.join(below, "vid").select("comp_id", "vid", "parent", "below"))
    arms = known.where("parent is not null").join(known.where("parent is null").select("comp_id", F.col("below").alias("total")), "comp_id")
    # an arm of the tree leads from a block up to a cut vertex, or from a cut vertex up to a block
    upward = F.col("vid") < 0
    pick = lambda block, cut, weight: F.struct(block.alias("block"), cut.alias("vid"), weight.alias("behind"))
    chosen = F.when(upward, pick(F.col("vid"), F.col("parent"), F.col("total") - F.col("below"))).otherwise(pick(F.col("parent"), F.col("vid"), F.col("below")))
    return arms.select(chosen.alias("x"), "total").select("x.*", "total")


def _search(wide: bool):
    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        ids, first, where = np.unique(np.concatenate([column("a"), column("b")]), return_index=True, return_inverse=True)
        n = table.num_rows
        length = paths.lengths_of(table.column("length"), wide)
        mult, weight = (np.concatenate([column(f"{c}_a"), column(f"{c}_b")])[first] for c in ("mult", "weight"))
        graph = PathGraph(len(ids), where[:n], where[n:], length, mult, weight=weight)
        total = np.zeros(graph.n)
        for run in graph.batches():
            graph.add_batch(*run, total)
        at = np.flatnonzero(total)
        return pa.table({"vid": ids[at], "score": total[at] / mult[at]})

    return run


def _search_components(wide: bool, plain: bool):
    """Scores of whole components; rows without b are their vertices, of which there are none if every vertex is a class of its own (``plain``)."""

    def run(table: pa.Table):
        known, edges = (table.slice(0, 0), table) if plain else (table.filter(table.column("b").is_null()), table.filter(table.column("b").is_valid()))
        a, b, of = (edges.column(c).to_numpy() for c in ("a", "b", "comp"))
        if plain:
            vids, first, where = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
            x, y = where[: len(a)], where[len(a) :]
            mult = weight = np.ones(len(vids))
            comp = np.concatenate([of, of])[first]
        else:
            vids, mult, weight, comp = (known.column(c).to_numpy() for c in ("a", "mult", "weight", "comp"))
            order = np.argsort(vids)
            vids, mult, weight, comp = vids[order], mult[order].astype(float), weight[order].astype(float), comp[order]
            x, y = np.searchsorted(vids, a), np.searchsorted(vids, b)
        comp = np.unique(comp, return_inverse=True)[1]
        yield pa.table({"vid": vids, "score": block_scores(len(vids), x, y, paths.lengths_of(edges.column("length"), wide), mult, weight, comp)})

    return run


def block_betweenness(edges: DataFrame, classes: DataFrame | None = None, block_edges: int | None = None) -> DataFrame:
    """vid, score as of ``paths.betweenness``; edges: a, b (not negative), length, each edge once.

    classes: vid, mult and counted or weight; without any every vertex with an
    edge counts once, and no table of vertices is made. Bridges need no search.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    block_edges = BLOCK_EDGES if block_edges is None else block_edges
    edges = settled(edges.select("a", "b", "length"))
    wide, none = bool(lengths.width(edges)), lambda kind: F.lit(None).cast(kind)
    labels = None if classes is None else settled(connectivity.connected_components(edges))
    tagged = connectivity.grouped_edges(edges, labels)
    discard(edges)
    large = connectivity.larger(tagged, block_edges)
    search = lambda rows: by_component(rows, "comp", _search_components(wide, classes is None), "vid long, score double")
    if classes is None:
        if large.isEmpty():
            return search(tagged)
        rest = settled(tagged.join(large, "comp", "left_semi"))
        labels = connectivity.named(rest)
        of = labels.select("vid", *[F.lit(1).cast("long").alias(c) for c in ("mult", "weight")])
        return search(tagged.join(large, "comp", "left_anti")).union(_joined_betweenness(rest.select("a", "b", "length"), of, labels, block_edges))
    # each class as a row (comp, a) without b
    placed = settled(paths.weighed(classes).join(labels, "vid", "left").select(F.col("comp_id").alias("comp"), F.col("vid").alias("a"), "mult", "weight"))
    rows = tagged.select("*", none("long").alias("mult"), none("long").alias("weight")).unionByName(placed.where("comp is not null").withColumns({"b": none("long"), "length": none(tagged.schema["length"].dataType)}))
    alone = placed.where("comp is null").select(F.col("a").alias("vid"), F.lit(0.0).alias("score"))
    if large.isEmpty():
        return search(rows).union(alone)
    rest = tagged.join(large, "comp", "left_semi").select("a", "b", "length")
    of = placed.join(large, "comp", "left_semi").select(F.col("a").alias("vid"), "mult", "weight")
    return search(rows.join(large, "comp", "left_anti")).union(alone).union(_joined_betweenness(rest, of, labels.join(large.withColumnRenamed("comp", "comp_id"), "comp_id", "left_semi"), block_edges))


def _joined_betweenness(edges: DataFrame, classes: DataFrame, labels: DataFrame, block_edges: int) -> DataFrame:
    """``block_betweenness`` of components of any size, as joins. classes: vid, mult, weight. labels: vid, comp_id."""
    classes = settled(classes)
    edges = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length"))
    found = settled(connectivity.block_edges(edges, labels).join(edges, ["a", "b"]))
    blocks = settled(found.groupBy("comp_id", "block_a", "block_b").agg(F.count("*").alias("n")).withColumn("block", -1 - F.monotonically_increasing_id()))
    rows = settled(found.join(blocks, ["comp_id", "block_a", "block_b"]).select("comp_id", "block", "n", "a", "b", "length"))
    of = classes.select("vid", "mult", F.col("weight").alias("own"))
    members = settled(rows.select("comp_id", "block", "n", F.explode(F.array("a", "b")).alias("vid")).distinct().join(of, "vid"))
    cuts = members.groupBy("vid").agg(F.count("*").alias("n")).where("n > 1").select("vid")
    behind = settled(_behind(members, cuts))
    # what isn't in the branch of one block at a cut vertex is behind the vertex, seen from that block
    arms = behind.join(of, "vid").groupBy("vid", "mult", "own", "total").agg(F.sum((F.col("total") - F.col("behind")).cast("double") ** 2).alias("squares"))
    across = arms.select("vid", (((F.col("total") - F.col("own")).cast("double") ** 2 - F.col("squares")) / F.col("mult")).alias("score"))
    copies = settled(members.where("n > 1").join(behind, ["block", "vid"], "left").select("block", "vid", "n", "mult", F.coalesce("behind", "own").alias("weight")).withColumn("copy", F.monotonically_increasing_id()))
    end = lambda c: copies.select("block", F.col("vid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("copy", "mult", "weight")])
    joined = settled(rows.where("n > 1").join(end("a"), ["block", "a"]).join(end("b"), ["block", "b"]))
    small = joined.where(F.col("n") <= block_edges).groupBy("block").applyInArrow(_search(bool(lengths.width(edges))), "vid long, score double")
    parts = [across, small]
    large = joined.where(F.col("n") > block_edges).select(F.col("copy_a").alias("a"), F.col("copy_b").alias("b"), "length")
    if not large.isEmpty():
        split = copies.where(F.col("n") > block_edges)
        scores = paths.betweenness(large, split.select(F.col("copy").alias("vid"), "mult", "weight"))
        parts.append(scores.withColumnRenamed("vid", "copy").join(split.select("copy", "vid"), "copy").select("vid", "score"))
    sums = parts[0].union(parts[1]) if len(parts) == 2 else parts[0].union(parts[1]).union(parts[2])
    return classes.join(sums.groupBy("vid").agg(F.sum("score").alias("score")), "vid", "left").select("vid", F.coalesce("score", F.lit(0.0)).alias("score"))


def betweenness(edges: DataFrame, classes: DataFrame, limit: int | None = None) -> DataFrame:
    """``paths.betweenness``; a graph too large to broadcast goes block by block."""
    edges = edges.select("a", "b", "length")
    if edges.count() > (paths.BROADCAST_EDGES if limit is None else limit):
        return block_betweenness(edges, classes)
    return paths.betweenness(edges, classes)
