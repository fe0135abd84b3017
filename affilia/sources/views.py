"""Rosters from the order tables, one row per line item (repeats stay).

``roster``: customers enrol in parts: one dense component. student = o_custkey,
course = l_partkey, grad = every fourth customer.

``islands``: orders enrol in a customer's brands: about one component per
customer, with leaves, cut vertices and equal students. student = l_orderkey,
course = o_custkey and brand, grad = every fourth order.

In both hours = 1 + p_size % 4 (or 1), and the major is by nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Course sizes from which budgets are derived, and the degree from which courses are taken out where a query masks some.
SIZES = (45, 40, 35, 30)
MASKED_DEGREE = 30
#: The same for islands.
ISLAND_SIZES, ISLAND_MASKED_DEGREE = (5, 4, 3), 4


def _lines(spark: SparkSession, sf_dir: str, weighted: bool, where: str, student: str, course: str, grad: str, placed: bool = False) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = table("lineitem")
    if placed:
        # tied rows of an order may be in two files: the earlier one by name comes first, wherever its row is
        lines = lines.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    # the orders come last: rows dealt by order are in place for the distinct (order, course)
    known = table("orders").join(table("customer"), F.expr("o_custkey = c_custkey"))
    # a brand's number is taken once per part, and no line item is shuffled with its name
    part = table("part").withColumn("brand", F.expr("cast(split_part(p_brand, '#', 2) as int)"))
    rows = lines.join(part, F.expr("l_partkey = p_partkey")).join(known, F.expr("l_orderkey = o_orderkey")).where(where)
    return rows.select(
        F.expr("l_orderkey * 8 + l_linenumber").cast("long").alias("row_id"),
        F.expr(student).alias("stid"),
        F.expr(course).alias("crsid"),
        F.expr("cast(c_nationkey % 6 + 1 as int)").alias("major"),
        F.expr(grad).alias("grad"),
        (F.expr("cast(1 + p_size % 4 as bigint)") if weighted else F.lit(1).cast("long")).alias("hours"),
        *(["place"] if placed else []),
    )


def roster(spark: SparkSession, sf_dir: str, weighted: bool = True, where: str = "true") -> DataFrame:
    """row_id, stid, crsid, major, grad, hours of the line items; the scans read just these columns."""
    return _lines(spark, sf_dir, weighted, where, "o_custkey", "l_partkey", "c_custkey % 4 = 0")


def islands(spark: SparkSession, sf_dir: str, weighted: bool = True, where: str = "true") -> DataFrame:
    """The columns of ``roster``, in many components; with ``place``, the row's file and place in it, where hours differ.

    Line numbers repeat within orders, so row_id leaves open which of a course's rows is the last.
    """
    return _lines(spark, sf_dir, weighted, where, "l_orderkey", "cast(o_custkey * 64 + brand as bigint)", "o_orderkey % 4 = 0", weighted)
