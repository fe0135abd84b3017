"""Shortest paths and betweenness.

The graph goes to the workers as arrays when it has at most BROADCAST_EDGES
edges (its size is checked). For betweenness hanging trees are folded away first
and runs of sources are searched together; they are dealt over the cluster and
partial vectors are summed. Larger graphs take the frontier form: a batch of
sources at a time, distances by delta-stepping, counts and dependencies by
rounds over the shortest-path edges; no edge passes the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import connectivity, lengths
from .components import by_component, settled
from .kernels import PathGraph

#: A graph of so many edges is 64 MB of arrays in a worker, about, and twice that in the driver.
BROADCAST_EDGES = 2_000_000
#: Rows (source, vertex) of one batch of the frontier form.
BATCH_ROWS = 1 << 28
#: A component of up to so many edges is searched in one task, many small ones together.
COMPONENT_EDGES = 20_000


def weighed(classes: DataFrame) -> DataFrame:
    """vid, mult, weight: what a class counts for as a source and target, its members if it is counted."""
    weight = F.col("weight") if "weight" in classes.columns else F.when(F.col("counted"), F.col("mult")).otherwise(0)
    return classes.select("vid", "mult", weight.cast("long").alias("weight"))


def _arrays(edges: DataFrame, classes: DataFrame | None = None):
    """(vids, x, y, length, mult, weight) of a graph small enough to broadcast."""
    e = edges.select("a", "b", "length").toArrow()
    a, b = (e.column(c).to_numpy() for c in ("a", "b"))
    if lengths.width(edges):
        length = np.array([lengths.number(tuple(x.values())) for x in e.column("length").to_pylist()] + [None], object)[:-1]
    else:
        length = e.column("length").to_numpy()
    if classes is None:
        vids = np.unique(np.concatenate([a, b]))
        mult, weight = np.ones(len(vids)), np.ones(len(vids))
    else:
        c = weighed(classes).toArrow()
        vids = c.column("vid").to_numpy()
        order = np.argsort(vids)
        vids, mult, weight = vids[order], c.column("mult").to_numpy()[order], c.column("weight").to_numpy()[order]
    return vids, np.searchsorted(vids, a), np.searchsorted(vids, b), length, mult, weight


def _sources(spark, vids):
    at = np.arange(len(vids))
    frame = spark.createDataFrame(pa.table({"i": at, "vid": vids[at]})) if len(at) else spark.createDataFrame([], "i long, vid long")
    return frame.repartition(max(1, min(len(at) // 16 + 1, 4 * spark.sparkContext.defaultParallelism)), "i")


def lengths_of(column: pa.ChunkedArray, wide: bool) -> np.ndarray:
    """A column of lengths as 64-bit or Python's numbers."""
    return np.array([lengths.number(tuple(x.values())) for x in column.to_pylist()] + [None], object)[:-1] if wide else column.to_numpy()


def _search_components(wide: bool):
    def run(table: pa.Table):
        a, b, comp = (table.column(c).to_numpy() for c in ("a", "b", "comp_id"))
        vids, at = np.unique(np.concatenate([a, b]), return_index=True)
        order = np.argsort(np.concatenate([comp, comp])[at], kind="stable")
        of = np.concatenate([comp, comp])[at][order]
        place = np.empty(len(vids), np.int64)
        place[order] = np.arange(len(vids))
        graph = PathGraph(len(vids), place[np.searchsorted(vids, a)], place[np.searchsorted(vids, b)], lengths_of(table.column("length"), wide))
        graph.parts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        vids = vids[order]
        for s, v, distance, paths in graph.search_all():
            yield pa.table({"s": vids[s], "v": vids[v], "distance": distance, "n_paths": paths})

    return run


def shortest_paths(edges: DataFrame, limit: int = BROADCAST_EDGES) -> DataFrame:
    """s, v, distance, n_paths for all pairs that are connected; edges: a, b, length.

    More than ``limit`` edges go by components: those of up to COMPONENT_EDGES
    edges many in one task, the others by ``_whole_paths``.
    """
    edges = settled(edges.select("a", "b", "length"))
    if edges.count() <= limit or lengths.width(edges):
        return _whole_paths(edges, limit)
    labels = settled(connectivity.connected_components(edges))
    tagged = settled(edges.join(labels.withColumnRenamed("vid", "a"), "a").select("comp_id", "a", "b", "length"))
    large = settled(tagged.groupBy("comp_id").count().where(F.col("count") > min(limit, COMPONENT_EDGES)).select("comp_id"))
    schema = "s long, v long, distance long, n_paths double"
    if large.isEmpty():
        return by_component(tagged, "comp_id", _search_components(False), schema)
    rest = settled(tagged.join(large, "comp_id", "left_semi"))
    states = labels.join(large, "comp_id", "left_semi").groupBy("comp_id").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    small = by_component(tagged.join(large, "comp_id", "left_anti"), "comp_id", _search_components(False), schema)
    return small.union(_whole_paths(rest.select("a", "b", "length"), limit, states))


def _whole_paths(edges: DataFrame, limit: int, states: int | None = None) -> DataFrame:
    """``shortest_paths`` with the graph as arrays in every worker, or by frontiers; states: pairs that are connected."""
    if edges.count() > limit:
        return frontier_paths(edges, states=states)
    spark = edges.sparkSession
    vids, x, y, length, *_ = _arrays(edges)
    held = spark.sparkContext.broadcast((vids, PathGraph(len(vids), x, y, length)))

    def run(batches):
        vids, graph = held.value
        for batch in batches:
            for i in batch.column("i").to_pylist():
                at, distance, paths = graph.search(i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), vids[i])), pa.array(vids[at]), pa.array(distance), pa.array(paths)], ["s", "v", "distance", "n_paths"])

    return _sources(spark, vids).mapInArrow(run, "s long, v long, distance long, n_paths double")


def _adjacency(edges: DataFrame) -> DataFrame:
    """a, b, length both ways."""
    a, b = F.col("a"), F.col("b")
    return edges.select(F.explode(F.array(F.struct(a.alias("a"), b.alias("b"), "length"), F.struct(b.alias("a"), a.alias("b"), "length"))).alias("e")).select("e.*")


def frontier_distances(near: DataFrame, sources: DataFrame) -> DataFrame:
    """s, v, d of all vertices that the sources (s) reach; near: a, b, length both ways.

    Delta-stepping: a round relaxes the open vertices no farther than ``delta``
    beyond the nearest of them, so few are relaxed twice, and rounds follow the
    edges on paths, not the lengths of edges.
    """
    limbs = lengths.width(near)
    delta = lengths.constant(lengths.number(near.agg(F.max("length")).first()[0] or 0) // 8, limbs)
    best = settled(sources.select("s", F.col("s").alias("v"), lengths.constant(0, limbs).alias("d"), F.lit(True).alias("open")))
    while True:
        nearest = best.where("open").agg(F.min("d")).first()[0]
        if nearest is None:
            return best.select("s", "v", "d")
        ready = F.col("open") & (F.col("d") <= lengths.plus(lengths.constant(lengths.number(nearest), limbs), delta, limbs))
        marked = best.withColumn("ready", ready)
        onward = marked.where("ready").join(near, F.col("v") == F.col("a")).select("s", F.col("b").alias("v"), lengths.plus(F.col("d"), F.col("length"), limbs).alias("d"), F.lit(True).alias("open"))
        rows = marked.select("s", "v", "d", (F.col("open") & ~F.col("ready")).alias("open")).union(onward)
        # of equal distances the one that isn't open is the older one
        best = settled(rows.groupBy("s", "v").agg(F.min(F.struct("d", "open")).alias("x")).select("s", "v", "x.d", "x.open"))


def _counted_rounds(near: DataFrame, sources: DataFrame, mult: DataFrame):
    """(distances, shortest-path edges s, a, b, rounds of s, v, n_paths), each vertex in a round after all before it.

    mult: v, mult of vertices that stand for several; each counts for as many paths.
    """
    limbs = lengths.width(near)
    distance = settled(frontier_distances(near, sources))
    onward = distance.join(near, F.col("v") == F.col("a")).select("s", "a", "b", lengths.plus(F.col("d"), F.col("length"), limbs).alias("d"))
    steps = settled(onward.join(distance.select("s", F.col("v").alias("b"), "d"), ["s", "b", "d"]).select("s", "a", "b"))
    wanted = settled(steps.groupBy("s", F.col("b").alias("v")).agg(F.count("*").alias("wanted")))
    weighed = lambda rows: rows.join(mult, "v", "left").select("s", "v", (F.col("n") * F.coalesce("mult", F.lit(1))).cast("double").alias("n_paths"))
    now, rounds, waiting = settled(weighed(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("n")))), [], None
    while not now.isEmpty():
        rounds.append(now)
        sent = now.join(steps, (now["s"] == steps["s"]) & (now["v"] == steps["a"])).select(now["s"], F.col("b").alias("v"), F.col("n_paths").alias("n"), F.lit(1).cast("long").alias("got"))
        rows = (sent if waiting is None else sent.union(waiting)).groupBy("s", "v").agg(F.sum("n").alias("n"), F.sum("got").alias("got"))
        held = settled(rows.join(wanted, ["s", "v"]))
        now, waiting = settled(weighed(held.where("got = wanted").select("s", "v", "n"))), held.where("got < wanted").select("s", "v", "n", "got")
    return distance, steps, rounds


def _batches(sources: DataFrame, vertices: int, batch_rows: int, states: int | None = None) -> list[DataFrame]:
    """The sources (s) in runs whose states, of ``states`` in all or else each source with all vertices, have about ``batch_rows`` rows each."""
    count = -(-(sources.count() * max(1, vertices) if states is None else states) // batch_rows)
    return [sources.where(F.pmod(F.xxhash64("s"), F.lit(count)) == k) for k in range(count)]


def frontier_paths(edges: DataFrame, sources: DataFrame | None = None, batch_rows: int | None = None, states: int | None = None) -> DataFrame:
    """``shortest_paths`` as joins, for graphs of any size; a batch of sources at a time."""
    near = settled(_adjacency(edges))
    vertices = settled(near.select(F.col("a").alias("s")).distinct())
    sources = vertices if sources is None else sources.select(F.col("vid").alias("s"))
    out = None
    for batch in _batches(sources, vertices.count(), batch_rows or BATCH_ROWS, states):
        distance, _, rounds = _counted_rounds(near, settled(batch), vertices.select(F.col("s").alias("v"), F.lit(1).alias("mult")).limit(0))
        counts = reduce(DataFrame.union, rounds) if rounds else None
        if counts is not None:
            rows = settled(distance.join(counts, ["s", "v"]).select("s", "v", F.col("d").alias("distance"), "n_paths"))
            out = rows if out is None else out.union(rows)
    return out if out is not None else edges.sparkSession.createDataFrame([], "s long, v long, distance long, n_paths double")


def frontier_betweenness(edges: DataFrame, classes: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """vid, score of ``betweenness`` as joins, for graphs of any size.

    Sources go in batches whose states have a bounded number of rows, sources
    times vertices; a batch ends as one row per vertex in the shared folder.
    """
    near, classes = settled(_adjacency(edges)), settled(weighed(classes))
    mult = classes.where("mult <> 1").select(F.col("vid").alias("v"), "mult")
    known = classes.select(F.col("vid").alias("v"), F.col("mult").cast("double").alias("mult"), F.col("weight").cast("double").alias("hit"))
    total = None
    for batch in _batches(classes.where("weight > 0").select(F.col("vid").alias("s")), classes.count(), batch_rows or BATCH_ROWS):
        _, steps, rounds = _counted_rounds(near, settled(batch), mult)
        gains, waiting = [], None
        for now in reversed(rounds):
            rows = now.join(known, "v", "left")
            rows = rows.withColumn("share", F.lit(0.0)) if waiting is None else rows.join(waiting, ["s", "v"], "left")
            here = settled(rows.select("s", "v", "n_paths", "mult", "hit", (F.col("n_paths") * F.coalesce("share", F.lit(0.0))).alias("gain")))
            gains.append(here.where("s <> v").select("s", "v", "gain"))
            share = ((F.col("hit") + F.col("gain")) * F.col("mult") / F.col("n_paths")).alias("share")
            sent = here.select("s", F.col("v").alias("b"), share).join(steps, ["s", "b"]).select("s", F.col("a").alias("v"), "share")
            waiting = settled((sent if waiting is None else sent.union(waiting)).groupBy("s", "v").agg(F.sum("share").alias("share")))
        if gains:
            times = known.select(F.col("v").alias("s"), F.col("hit").alias("times"))
            part = settled(reduce(DataFrame.union, gains).join(times, "s").groupBy(F.col("v").alias("vid")).agg(F.sum(F.col("gain") * F.col("times")).alias("sum")))
            total = part if total is None else total.union(part)
    if total is None:
        return classes.select("vid", F.lit(0.0).alias("score"))
    sums = total.groupBy("vid").agg(F.sum("sum").alias("sum"))
    return classes.join(sums, "vid", "left").select("vid", F.coalesce(F.col("sum") / F.col("mult"), F.lit(0.0)).alias("score"))


def betweenness(edges: DataFrame, classes: DataFrame, limit: int | None = None) -> DataFrame:
    """vid, score: ordered-pair sums of every class, per member.

    edges: a, b, length (whole numbers). classes: vid, mult, counted; counted
    classes are the sources and targets. Pairs inside a class aren't included.
    A column weight in place of counted says how much each class counts.
    """
    edges = edges.select("a", "b", "length")
    if edges.count() > (BROADCAST_EDGES if limit is None else limit):
        return frontier_betweenness(edges, classes)
    spark = edges.sparkSession
    vids, x, y, length, mult, weight = _arrays(edges, classes)
    core, tree = PathGraph(len(vids), x, y, length, mult, weight).folded()
    runs = core.batches()
    held = spark.sparkContext.broadcast((vids[core.kept], core, runs))

    def run(batches):
        vids, core, runs = held.value
        total = np.zeros(core.n)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                core.add_batch(*runs[k], total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vids[at]), pa.array(total[at])], ["vid", "gain"])

    parts = max(1, min(len(runs), 4 * spark.sparkContext.defaultParallelism))
    gains = spark.range(0, len(runs), 1, parts).mapInArrow(run, "vid long, gain double")
    at = np.flatnonzero(tree)
    hanging = spark.createDataFrame(pa.table({"vid": vids[at], "gain": tree[at]})) if len(at) else spark.createDataFrame([], "vid long, gain double")
    sums = gains.union(hanging).groupBy("vid").agg(F.sum("gain").alias("gain"))
    return classes.select("vid", "mult").join(sums, "vid", "left").select("vid", F.coalesce(F.col("gain") / F.col("mult"), F.lit(0.0)).alias("score"))
