"""The analysis of a roster under a sweep of budgets, as one batch.

Removing courses only cuts components into smaller ones: the roster's components
are found once, and small ones are taken through all budgets in one task. All
thresholds of larger ones are one graph: a vertex of threshold t has the id
t * SPAN + vid, so inclusion, components, blocks and betweenness of the whole
sweep run as single jobs instead of a loop over budgets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import betweenness_norm, course_vid, percent, student_vid
from ..operators import connectivity as C
from ..operators import blockcut, contraction, graph, lengths, removal
from ..operators.components import PACK_ROWS, by_component, discard, ensure_checkpoint_dir, settled
from ..operators.kernels import block_copies, least_reachable

SPAN = 1 << 44
STRATEGIES = {"prefix": removal.prefix_removed, "skip_fit": removal.skip_fit_removed}
#: Those by which a larger budget removes all that a smaller one does.
NESTED = frozenset({"prefix"})
#: A component of the roster of up to so many edges is taken through all budgets in one task, many small ones together.
TASK_EDGES = 20_000
#: From so many rows in all budgets' graphs on, their components come from one forest; copies of fewer are quicker (3 million rows: 19 s against 35 s).
NESTED_EDGES = 50_000_000


def contracted_betweenness(pairs: DataFrame, hours: DataFrame, counted_students: DataFrame, counted_courses: DataFrame, grad: DataFrame) -> DataFrame:
    """kind ('s' or 'c'), id, score: raw ordered-pair sums, computed on merged students.

    pairs: stid, crsid. hours: crsid, hours. counted_*: the sources and targets.
    grad: stid, grad; only students of one flag are merged.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    marked = grad.join(counted_students.select("stid", F.lit(True).alias("in_src")), "stid", "left").select("stid", F.struct("grad", F.coalesce("in_src", F.lit(False)).alias("in_src")).alias("grad"))
    member = contraction.student_classes(pairs, marked)
    classes = contraction.class_table(member).select("cid", "mult", F.col("grad.in_src").alias("counted")).checkpoint()
    edges = contraction.class_edges(pairs, member).checkpoint()
    by_course = lengths.with_length(hours.select("crsid", "hours")).select("crsid", "length")
    vertex_edges = edges.join(by_course, "crsid").select((F.col("cid") * 2).alias("a"), (F.col("crsid") * 2 + 1).alias("b"), "length").checkpoint()
    course_rows = pairs.select("crsid").distinct().join(counted_courses.select("crsid", F.lit(True).alias("counted")), "crsid", "left")
    vertices = classes.select((F.col("cid") * 2).alias("vid"), "mult", "counted").union(course_rows.select((F.col("crsid") * 2 + 1).alias("vid"), F.lit(1).cast("long"), F.coalesce("counted", F.lit(False)))).checkpoint()
    external = blockcut.betweenness(vertex_edges, vertices)
    nearest = contraction.shortest_neighbors(classes.where("counted"), edges, hours)
    internal = contraction.internal_pairs(nearest).select((F.col("crsid") * 2 + 1).alias("vid"), "score")
    scores = external.unionByName(internal).groupBy("vid").agg(F.sum("score").alias("score")).checkpoint()  # students and courses both read it
    students = member.join(scores.where("vid % 2 = 0").select((F.col("vid") / 2).cast("long").alias("cid"), "score"), "cid").select(F.lit("s").alias("kind"), F.col("stid").alias("id"), "score")
    courses = scores.where("vid % 2 = 1").select(F.lit("c").alias("kind"), F.expr("vid div 2").alias("id"), "score")
    return students.union(courses)


def _nested_labels(pairs: DataFrame, removed: DataFrame, order: list[int]) -> DataFrame:
    """vid, comp_id of all thresholds' graphs; order: the thresholds by budget, each removes what those before it remove."""
    gone = removed.groupBy("crsid").agg(F.count("*").alias("gone"))
    alive = pairs.join(gone, "crsid", "left").select("stid", "crsid", (F.lit(len(order)) - F.coalesce("gone", F.lit(0))).cast("long").alias("alive"))
    edges = alive.select(student_vid(F.col("stid")).alias("a"), course_vid(F.col("crsid")).alias("b"), "alive")
    shifted = lambda df, t: df.select(*[(F.lit(2 * t * SPAN) + F.col(c)).alias(c) for c in ("vid", "comp_id")])
    return reduce(DataFrame.union, [shifted(df, t) for t, df in zip(order, C.nested_components(edges, len(order)))])


def _swept(order: list[int]):
    """included, max_cc, comp_id, comp and max_bcc of whole components of the roster under each threshold; rows, repeats among them: comp, a, b, gone (the thresholds that remove b)."""

    def run(table: pa.Table):
        ids, where = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        once = np.unique(where[: table.num_rows] * len(ids) + where[table.num_rows :], return_index=True)[1]
        table = table.take(once).combine_chunks()
        a, b, comp = (table.column(c).to_numpy() for c in ("a", "b", "comp"))
        ids, first, where = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
        n, x, y, gone = len(ids), where[: len(a)], where[len(a) :], table.column("gone")
        row, by = np.repeat(np.arange(len(a)), pc.fill_null(pc.list_value_length(gone), 0).to_numpy()), pc.list_flatten(gone).to_numpy()
        stays = np.ones((len(order), len(a)), bool)
        for k, t in enumerate(order):
            stays[k, row[by == t]] = False
        k, edge = np.nonzero(stays)
        if not len(k):
            return
        x, y = k * n + x[edge], k * n + y[edge]
        students = np.unique(x)
        sizes = np.bincount(least_reachable(n * len(order), x, y)[students], minlength=n * len(order)).reshape(len(order), n)
        _, of, vertex, _ = block_copies(n * len(order), x, y)
        inner, blocks = np.bincount(of, ids[vertex % n] % 2 == 0).astype(np.int64), np.zeros(len(order), np.int64)
        np.maximum.at(blocks, vertex[np.unique(of, return_index=True)[1]] // n, inner)
        top = sizes.argmax(1)  # the first of equal ones is the smallest
        some = np.flatnonzero(sizes.any(1))
        ts = np.array(order, np.int64)[some]
        yield pa.table({
            "threshold_id": ts.astype(np.int32), "included": np.bincount(students // n, minlength=len(order))[some], "max_cc": sizes[some, top[some]],
            "comp_id": 2 * SPAN * ts + ids[top[some]], "comp": np.concatenate([comp, comp])[first][top[some]], "max_bcc": blocks[some],
        })

    return run


def _copies(grouped: DataFrame, removed: DataFrame, order: list[int]) -> DataFrame:
    """threshold_id, comp, stid, crsid: the edges (comp, a, b) that stay, each once in a copy for each threshold, with its ids."""
    shift = F.col("threshold_id") * F.lit(SPAN)
    rows = grouped.select("comp", "a", "b").distinct().select("comp", F.expr("a div 2").alias("stid"), F.expr("b div 2").alias("crsid"), F.explode(F.array(*[F.lit(t) for t in order])).alias("threshold_id"))
    live = rows.join(removed.select("threshold_id", "crsid"), ["threshold_id", "crsid"], "left_anti")
    return live.select("threshold_id", "comp", (shift + F.col("stid")).alias("stid"), (shift + F.col("crsid")).alias("crsid"))


def _large_components(grouped: DataFrame, live: DataFrame, removed: DataFrame, order: list[int], strategy: str) -> tuple[DataFrame, DataFrame]:
    """(vid, comp_id; the columns of ``_swept``, comp being null) of components that no task should take through all budgets. live: their copies."""
    edges = graph.vertex_edges(live)
    if strategy in NESTED and live.count() > NESTED_EDGES:
        labels = _nested_labels(grouped.select(F.expr("a div 2").alias("stid"), F.expr("b div 2").alias("crsid")), removed, order).checkpoint()
    else:
        labels = settled(C.connected_components(edges))
    of = F.expr(f"cast(comp_id div {2 * SPAN} as int)").alias("threshold_id")
    top = graph.component_sizes(labels).groupBy(of).agg(F.max(F.struct("n_students", -F.col("comp_id"))).alias("x")).select("threshold_id", F.col("x.n_students").alias("max_cc"), (-F.col("x.col2")).alias("comp_id"))
    blocks = C.block_rows(edges, labels).groupBy(of).agg(F.max("n_students").alias("max_bcc"))
    included = live.groupBy("threshold_id").agg(F.countDistinct("stid").alias("included"))
    return labels, included.join(top, "threshold_id").join(blocks, "threshold_id").select("threshold_id", "included", "max_cc", "comp_id", F.lit(None).cast("long").alias("comp"), "max_bcc")


def swept_courses(enrol: DataFrame) -> DataFrame:
    """crsid, cost, degree and least student of a roster's courses (settled); hours are looked up for the few whose paths are searched."""
    return settled(enrol.groupBy("crsid").agg(F.sum("hours").alias("cost"), F.count("*").alias("degree"), F.min("stid").alias("least")))


def _left_edges(enrol: DataFrame, courses: DataFrame, removed: DataFrame, budgets: int) -> DataFrame:
    """a, b, m, gone (settled): the roster's rows, repeats among them, without the courses that all budgets remove.

    m is the least student of the course, gone the budgets that remove it (null: none).
    """
    by = removed.groupBy("crsid").agg(F.collect_list("threshold_id").alias("gone"))
    left = courses.select("crsid", "least").join(by, "crsid", "left").where(F.coalesce(F.size("gone"), F.lit(0)) < budgets)
    rows = enrol.select("stid", "crsid").join(left, "crsid")
    return settled(rows.select(student_vid(F.col("stid")).alias("a"), course_vid(F.col("crsid")).alias("b"), student_vid(F.col("least")).alias("m"), "gone"))


def sweep(enrol: DataFrame, budgets: DataFrame, n_total: int | None = None, betweenness: bool = True, strategy: str = "prefix", n_courses: int | None = None, courses: DataFrame | None = None) -> DataFrame:
    """One report row per budget: threshold_id, removed_cost, n_vertices, included(_pct), max_cc(_pct), max_bcc(_pct), max_bc.

    Percentages are of all students (n_total, or those with a row), whatever is
    removed. n_vertices are the included students and the courses that stay:
    of n_courses declared ones, or of those with a row. ``strategy`` says which
    courses a budget removes: the prefix of the largest, or all that still fit.
    courses: those of ``swept_courses``, if they are known.
    """
    ensure_checkpoint_dir(enrol.sparkSession)
    enrol = enrol if hasattr(enrol, "settled_at") else settled(enrol)
    courses = swept_courses(enrol) if courses is None else courses
    budgets = budgets.checkpoint()
    removed = STRATEGIES[strategy](courses, budgets)
    removed = settled((removed if "cost" in removed.columns else removed.join(courses.select("crsid", "cost"), "crsid")).select("threshold_id", "crsid", "cost"))
    order = [r["threshold_id"] for r in sorted(budgets.collect(), key=lambda r: (r["max_cost"], r["threshold_id"]))]  # the caller's few budgets
    of = lambda c: F.expr(f"cast({c} div {SPAN} as int)").alias("threshold_id")
    # what a budget removes only cuts components into smaller ones: those of the courses that some budget leaves
    edges = _left_edges(enrol, courses, removed, len(order))
    grouped = C.grouped_edges(edges)
    discard(edges)
    large = C.larger(grouped, TASK_EDGES)
    gone = F.coalesce("gone", F.array().cast("array<int>")).alias("gone")  # Arrow's writer takes a null list's place again for each row after it
    swept = by_component(grouped.join(large, "comp", "left_anti").select("comp", "a", "b", gone), "comp", _swept(order), "threshold_id int, included long, max_cc long, comp_id long, comp long, max_bcc long", PACK_ROWS // max(1, len(order)))
    outer = None
    if not large.isEmpty():
        rest = settled(grouped.join(large, "comp", "left_semi").select("comp", "a", "b").distinct())
        outer = settled(_copies(rest, removed, order))
        outer_labels, found = _large_components(rest, outer, removed, order, strategy)
        swept = swept.union(found)
    sums = swept.groupBy("threshold_id").agg(F.sum("included").alias("included"), F.max(F.struct("max_cc", (-F.col("comp_id")).alias("low"), "comp")).alias("x"), F.max("max_bcc").alias("max_bcc"))
    sums = settled(sums.select("threshold_id", "included", "x.max_cc", (-F.col("x.low")).alias("comp_id"), "x.comp", "max_bcc"))
    gone = removal.removal_summary(removed, budgets)
    n_courses = F.lit(courses.count() if n_courses is None else n_courses)
    n_students = F.lit(enrol.select("stid").distinct().count() if n_total is None else n_total)
    out = gone.join(sums.drop("comp_id", "comp"), "threshold_id", "left")
    if betweenness:
        top = sums.where("comp is not null").select("threshold_id", "comp")
        live = settled(_copies(grouped.join(top, "comp", "left_semi"), removed, order).join(top, ["threshold_id", "comp"], "left_semi"))
        labels = C.connected_components(graph.vertex_edges(live))
        if outer is not None:
            live, labels = live.unionByName(outer), labels.unionByName(outer_labels)
        inside = settled(labels.join(sums.select("comp_id"), "comp_id", "left_semi").select("vid"))
        students = inside.where("vid % 2 = 0").select((F.col("vid") / 2).cast("long").alias("stid"))
        inner_courses = inside.where("vid % 2 = 1").select(F.expr("vid div 2").alias("crsid"))
        live = settled(live.join(students, "stid", "left_semi").select("threshold_id", "stid", "crsid"))  # no path leads out of a component
        of_inside = enrol.join(live.select((F.col("stid") % SPAN).alias("stid")).distinct(), "stid", "left_semi")
        grad = graph.student_attributes(of_inside).select("stid", "grad")
        grad = live.select("stid").distinct().withColumn("own", F.col("stid") % SPAN).join(grad.withColumnRenamed("stid", "own"), "own").select("stid", "grad")
        of_course = enrol.join(live.select((F.col("crsid") % SPAN).alias("crsid")).distinct(), "crsid", "left_semi")
        hours = live.select("crsid").distinct().withColumn("own", F.col("crsid") % SPAN).join(graph.course_attributes(of_course).select(F.col("crsid").alias("own"), "hours"), "own").select("crsid", "hours")
        scores = contracted_betweenness(live.select("stid", "crsid"), hours, students, inner_courses, grad).groupBy(of("id")).agg(F.max("score").alias("raw"))
        out = out.join(scores, "threshold_id", "left")
    else:
        out = out.withColumn("raw", F.lit(None).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero("included") + n_courses - F.col("n_removed")
    return out.select(
        "threshold_id",
        "removed_cost",
        n.cast("long").alias("n_vertices"),
        zero("included").alias("included"),
        percent(zero("included"), n_students).alias("included_pct"),
        zero("max_cc").alias("max_cc"),
        percent(zero("max_cc"), n_students).alias("max_cc_pct"),
        zero("max_bcc").alias("max_bcc"),
        percent(zero("max_bcc"), n_students).alias("max_bcc_pct"),
        F.round(zero("raw") * betweenness_norm(1, n), 9).alias("max_bc"),
    )
