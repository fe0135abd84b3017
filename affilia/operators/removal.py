"""Which courses a cost budget removes, largest first."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import settled
from .ordered import ranked, running_total

#: Courses in a range of the skip-fit rule, about: a few MB in the task that folds one.
RANGE_COURSES = 1 << 18


def _by_size():
    return [F.col("degree").desc(), F.col("crsid")]


def size_thresholds(spark: SparkSession, sizes) -> DataFrame:
    """threshold_id from 0; 0 is the unbounded size that removes nothing."""
    rows = [(0, None), *((k, s) for k, s in enumerate(sizes, 1))]
    return spark.createDataFrame(rows, "threshold_id int, min_size long")


def size_threshold_totals(courses: DataFrame, thresholds: DataFrame) -> DataFrame:
    """threshold_id, min_size, n_courses, cost of courses of at least that size.

    Courses are first summed per degree, so the range join meets a handful of
    rows; the thresholds are a constant relation.
    """
    degrees = courses.groupBy("degree").agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
    joined = F.broadcast(thresholds).join(degrees, F.col("degree") >= F.col("min_size"), "left")
    return joined.groupBy("threshold_id", "min_size").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_courses"), F.coalesce(F.sum("c"), F.lit(0)).alias("cost"))


def budgets_of(courses: DataFrame, sizes, less: int = 0) -> DataFrame:
    """threshold_id, max_cost: what removing all courses of each size would cost, minus ``less``."""
    totals = size_threshold_totals(courses, size_thresholds(courses.sparkSession, sizes))
    return totals.select("threshold_id", F.greatest(F.col("cost") - less, F.lit(0)).cast("long").alias("max_cost"))


def prefix_removed(courses: DataFrame, budgets: DataFrame) -> DataFrame:
    """threshold_id, crsid, cost: courses by size as long as their total stays within the budget.

    The running total never falls, so stopping at the first course that
    doesn't fit is the same as comparing it with the budget. Sizes are added up
    first, a row each: most of them fit as a whole or not at all, and only the
    courses of the size at which a budget ends are put in order.
    """
    sizes = courses.groupBy("degree").agg(F.sum("cost").alias("total"), F.min("cost").alias("least"))
    sizes = running_total(sizes, [F.col("degree").desc()], F.col("total"), "spent")
    met = sizes.withColumn("before", F.col("spent") - F.col("total")).join(F.broadcast(budgets), F.col("before") + F.col("least") <= F.col("max_cost"))
    met = settled(met.select("threshold_id", "max_cost", "degree", "total", "before", (F.col("spent") <= F.col("max_cost")).alias("fits")))
    whole = courses.join(met.where("fits").select("threshold_id", "degree"), "degree").select("threshold_id", "crsid", "cost")
    ends = met.where("not fits")  # a row per budget at most
    if ends.isEmpty():
        return whole
    earlier = F.sum("total").over(Window.orderBy(F.col("degree").desc()).rowsBetween(Window.unboundedPreceding, -1))
    cut = ends.select("degree", "total", "before").distinct().select("degree", (F.col("before") - F.coalesce(earlier, F.lit(0))).alias("before"))
    totals = running_total(courses.select("crsid", "degree", "cost").join(F.broadcast(cut), "degree"), _by_size(), F.col("cost"), "spent")
    part = totals.join(F.broadcast(ends.select("threshold_id", "max_cost", "degree")), "degree").where(F.col("before") + F.col("spent") <= F.col("max_cost"))
    return whole.union(part.select("threshold_id", "crsid", "cost"))


def removal_summary(removed: DataFrame, budgets: DataFrame) -> DataFrame:
    sums = removed.groupBy("threshold_id").agg(F.count("*").alias("n"), F.sum("cost").alias("c"))
    return budgets.join(sums, "threshold_id", "left").select("threshold_id", "max_cost", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("c", F.lit(0)).alias("removed_cost"))


def _folded(table: pa.Table) -> pa.Table:
    """The courses of one range that fit a budget one after the other, of which ``left`` is left before the first."""
    table = table.sort_by([("degree", "descending"), ("crsid", "ascending")])
    left, taken = table.column("left")[0].as_py() if table.num_rows else 0, []
    for k, cost in enumerate(table.column("cost").to_pylist()):
        if cost <= left:
            left -= cost
            taken.append(k)
    return table.select(["threshold_id", "crsid", "cost"]).take(pa.array(taken, pa.int64()))


def skip_fit_removed(courses: DataFrame, budgets: DataFrame, range_courses: int = RANGE_COURSES) -> DataFrame:
    """threshold_id, crsid: like ``prefix_removed``, but a course that doesn't fit is skipped.

    The choice depends on all choices before, but seldom on single courses: the
    courses are cut into ranges of bounded size, and a budget passes over a
    range that fits as a whole, or whose cheapest course doesn't fit, by the
    range's total and minimum (all that the driver sees, a row per range). Only
    the ranges in between are folded course by course, for all budgets in one
    job. A course without a cost counts as free; a budget of null removes nothing.
    """
    spark = courses.sparkSession
    rows = settled(courses.select("crsid", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"), "degree"))
    width = max(1, -(-rows.count() // range_courses))
    ranged = settled(rows.repartitionByRange(width, *_by_size()).withColumn("range", F.spark_partition_id()))
    ranges = ranged.groupBy("range").agg(F.min("cost").alias("least"), F.sum("cost").alias("total")).orderBy("range").collect()
    left = {r["threshold_id"]: r["max_cost"] for r in budgets.where("max_cost is not null").collect()}
    at, whole, folded = dict.fromkeys(left, 0), [], []
    while True:
        opened = []
        for t in left:
            while at[t] < len(ranges):
                r = ranges[at[t]]
                at[t] += 1
                if r["least"] >= 0 and r["total"] <= left[t]:
                    left[t] -= r["total"]
                    whole.append((t, r["range"]))
                elif r["least"] <= left[t]:
                    opened.append((t, r["range"], left[t]))
                    break
        if not opened:
            break
        starts = F.broadcast(spark.createDataFrame(opened, "threshold_id int, range int, left long"))  # a row per budget at most
        some = ranged.where(F.col("range").isin([r for _, r, _ in opened])).join(starts, "range")
        folded.append(settled(some.groupBy("threshold_id", "range").applyInArrow(_folded, "threshold_id int, crsid long, cost long")))
        for r in folded[-1].groupBy("threshold_id").agg(F.sum("cost").alias("spent")).collect():
            left[r["threshold_id"]] -= r["spent"]
    passed = spark.createDataFrame(whole, "threshold_id int, range int")
    return reduce(DataFrame.union, [df.select("threshold_id", "crsid") for df in (ranged.join(passed, "range"), *folded)])


def course_ranks(courses: DataFrame) -> DataFrame:
    return ranked(courses.select("crsid", "degree"), _by_size())
