"""Spanning forests and biconnected blocks as joins, for components of any size.

Nothing here gathers a component: Borůvka rounds choose a spanning forest, its
Euler tour is a linked list of arcs ranked by pointer jumping, and a vertex's
subtree is an interval of the tour. Blocks follow from the lowest and highest
vertex that edges outside the forest reach from each subtree (Tarjan and
Vishkin): these say which forest edges share a block, and the components of
that relation are the blocks. Every step is a join or an aggregation with
map-side combine on vertex or arc ids; rounds are logarithmic in the number of
vertices and each ends in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import ensure_checkpoint_dir, settled, star_components
from .graph import both_ways
from .ordered import ranked

#: Children of a node of the tree over tour positions, as a power of two.
FANOUT_BITS = 3
#: Rounds allow for 2**60 vertices.
MOST_ROUNDS = 61


def simple(edges: DataFrame) -> DataFrame:
    """Each edge once, a < b, without loops."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _jumped(parents: DataFrame) -> DataFrame:
    """c, root from c, d: every pointer followed to its end; an end points to itself."""
    now = settled(parents)
    for _ in range(MOST_ROUNDS):
        far = now.select(F.col("c").alias("d"), F.col("d").alias("e"))
        now = settled(now.join(far, "d").select("c", F.col("e").alias("d"), (F.col("e") != F.col("d")).alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("c", F.col("d").alias("root"))
        now = now.drop("moved")
    raise RuntimeError("pointers don't end")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, w: a minimum spanning forest of a simple graph (a, b, w), ties by (a, b).

    Borůvka: every component takes its least edge to another one, and what is
    joined becomes one component. Edges between the same two components are
    reduced to the least, so tables shrink from round to round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = settled(edges.select(F.col("a").alias("c"), F.col("b").alias("d"), F.struct("w", "a", "b").alias("e")))
    taken = None
    for _ in range(MOST_ROUNDS):
        if now.isEmpty():
            break
        both = now.select(F.explode(F.array(F.struct("c", "d", "e"), F.struct(F.col("d").alias("c"), F.col("c").alias("d"), "e"))).alias("x")).select("x.*")
        best = settled(both.groupBy("c").agg(F.min(F.struct("e", "d")).alias("x")).select("c", "x.d", "x.e"))
        chosen = settled(best.select("e.a", "e.b", "e.w").distinct())
        taken = chosen if taken is None else taken.union(chosen)
        back = best.select(F.col("c").alias("d"), F.col("d").alias("its"))
        roots = _jumped(best.join(back, "d").select("c", F.when((F.col("its") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d")).alias("d")))
        moved = now.join(roots.select("c", F.col("root").alias("c2")), "c").join(roots.select(F.col("c").alias("d"), F.col("root").alias("d2")), "d").where("c2 <> d2")
        now = settled(moved.groupBy(F.least("c2", "d2").alias("c"), F.greatest("c2", "d2").alias("d")).agg(F.min("e").alias("e")))
    return edges.select("a", "b", "w").limit(0) if taken is None else taken


def rooted(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """comp_id, vid, parent, first, last of all vertices of a forest (a, b), from its Euler tour.

    labels: vid, comp_id; a tree's root is its vertex comp_id. first and last
    are the places in the tour of the arcs to and from the vertex, so vertices
    below it have a first in between. The root's lie around all others.

    Arcs are numbered by (tail, head) over range partitions, so the arcs of a
    vertex follow each other by number and no vertex's neighbours are gathered.
    """
    numbered = settled(ranked(both_ways(forest), [F.col("a"), F.col("b")], "i"))
    ends = numbered.groupBy("a").agg(F.min("i").alias("least"), F.max("i").alias("most"))
    around = numbered.join(ends, "a").join(labels.select(F.col("vid").alias("a"), "comp_id"), "a")
    wraps = F.col("i") == F.col("most")
    onward = F.when(wraps & (F.col("a") == F.col("comp_id")), F.lit(None)).when(wraps, F.col("least")).otherwise(F.col("i") + 1)
    twins = numbered.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("i").alias("twin"))
    # after the arc to a vertex comes that vertex's next arc after the one back
    arcs = settled(around.withColumn("onward", onward).join(twins, ["a", "b"]).select("comp_id", F.col("twin").alias("i"), F.col("b").alias("tail"), F.col("a").alias("head"), F.col("i").alias("back"), "onward"))
    jumps = settled(arcs.select("i", "onward", F.col("onward").isNotNull().cast("long").alias("left")))
    for _ in range(MOST_ROUNDS):
        if jumps.where("onward is not null").isEmpty():
            break
        far = jumps.select(F.col("i").alias("onward"), F.col("onward").alias("farther"), F.col("left").alias("more"))
        jumps = settled(jumps.join(far, "onward", "left").select("i", F.col("farther").alias("onward"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    most = jumps.agg(F.max("left")).first()[0] or 0
    places = jumps.select("i", (F.lit(most + 1) - F.col("left")).alias("at"))
    placed = arcs.join(places, "i").join(places.select(F.col("i").alias("back"), F.col("at").alias("until")), "back")
    below = placed.where("at < until").select("comp_id", F.col("head").alias("vid"), F.col("tail").alias("parent"), F.col("at").alias("first"), F.col("until").alias("last"))
    tops = below.select("comp_id").distinct().select("comp_id", F.col("comp_id").alias("vid"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("first"), F.lit(most + 2).cast("long").alias("last"))
    return settled(below.union(tops))


def _nodes(first, stop, levels: int):
    """The nodes (level, node) that the positions from first up to stop fall into, at most 14 a level."""
    sequence = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    at = lambda level: lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))
    parts = []
    for level in range(levels):
        size, block = 1 << FANOUT_BITS * level, 1 << FANOUT_BITS
        low, high = F.floor((first + size - 1) / size).cast("long"), F.floor(stop / size).cast("long")
        up = F.least(high, F.ceil(low / block).cast("long") * block)
        down = F.greatest(up, F.floor(high / block).cast("long") * block)
        parts += [F.transform(sequence(low, up), at(level)), F.transform(sequence(down, high), at(level))]
    return F.flatten(F.array(*parts))


def subtree_extremes(vertices: DataFrame, values: DataFrame) -> DataFrame:
    """vid, low, high: the least and greatest value in each vertex's subtree.

    vertices: as from ``rooted``. values: vid, low, high. Values are reduced in
    a tree over the tour's positions; an interval is a few nodes a level.
    """
    last = vertices.agg(F.max("last")).first()[0] or 0
    levels = max(1, -(-(last + 1).bit_length() // FANOUT_BITS))
    held = vertices.join(values, "vid").select("comp_id", "first", "low", "high")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    tree = held.select("comp_id", "first", "low", "high", level).groupBy("comp_id", "level", F.expr(f"shiftright(first, level * {FANOUT_BITS})").alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    asked = vertices.select("comp_id", "vid", F.explode(_nodes(F.col("first"), F.col("last") + 1, levels)).alias("n")).select("comp_id", "vid", "n.level", "n.node")
    return asked.join(tree, ["comp_id", "level", "node"]).groupBy("vid").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def block_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """comp_id, block_a, block_b, a, b: each edge (a < b) with its block's smallest edge.

    edges: a, b, any form. labels: vid, comp_id (the component's smallest vertex).
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = settled(simple(edges))
    tree = settled(spanning_forest(edges.withColumn("w", F.lit(0))).select("a", "b"))
    vertices = rooted(tree, labels)
    end = lambda c: vertices.select(F.col("vid").alias(c), F.col("first").alias(f"first_{c}"), F.col("last").alias(f"last_{c}"))
    others = settled(edges.join(tree, ["a", "b"], "left_anti").join(end("a"), "a").join(end("b"), "b"))
    reach = others.select(F.explode(F.array(F.struct(F.col("a").alias("vid"), F.col("first_b").alias("at")), F.struct(F.col("b").alias("vid"), F.col("first_a").alias("at")))).alias("x")).select("x.*")
    reach = reach.union(vertices.select("vid", F.col("first").alias("at"))).groupBy("vid").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    extremes = subtree_extremes(vertices, reach)
    above = vertices.where("parent is not null").select(F.col("vid").alias("parent"), F.col("first").alias("from"), F.col("last").alias("to"))
    upward = vertices.where("parent is not null").select("vid", "parent").join(above, "parent").join(extremes, "vid").where("low < from or high > to").select(F.col("vid").alias("a"), F.col("parent").alias("b"))
    aside = others.where("not (first_a < first_b and last_b < last_a) and not (first_b < first_a and last_a < last_b)").select("a", "b")
    shared = star_components(upward.union(aside)).withColumnRenamed("comp_id", "block")
    # a forest edge goes by its lower end, any other edge by the end that comes later in the tour
    keyed = vertices.where("parent is not null").select("comp_id", F.least("vid", "parent").alias("a"), F.greatest("vid", "parent").alias("b"), "vid")
    later = others.join(vertices.select(F.col("vid").alias("a"), "comp_id"), "a").select("comp_id", "a", "b", F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("vid"))
    rows = settled(keyed.union(later).join(shared, "vid", "left").select("comp_id", F.coalesce("block", "vid").alias("block"), "a", "b"))
    names = rows.groupBy("block").agg(F.min(F.struct("a", "b")).alias("x"))
    return rows.join(names, "block").select("comp_id", F.col("x.a").alias("block_a"), F.col("x.b").alias("block_b"), "a", "b")
