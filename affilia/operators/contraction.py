"""Structural equivalence: vertices with the same neighbours become one class.

No neighbourhood is gathered: a set of neighbours goes by its size and a 128-bit
fingerprint that doesn't depend on the order (the exclusive or of its members'
hashes, combined before the shuffle). Members of a class are then compared
with its smallest vertex by counting the neighbours they share; any that came
there by a collision are told apart with other hashes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import settled
from .graph import both_ways


def _print(item: str, seed: int, bits: int):
    return F.bit_xor(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(item)), 64 - bits))


def equal_sets(sets: DataFrame, vertices: DataFrame, bits: int = 64) -> DataFrame:
    """The vertices plus size and cid, the smallest vid of those alike in the other columns and in their set.

    sets: vid, item, each pair once. vertices: vid and any columns, once each;
    one without items has the empty set, and nulls are alike. ``bits`` of the
    two hashes matter for speed only.
    """
    keys, sets, left, seed, done = [c for c in vertices.columns if c != "vid"], settled(sets.select("vid", "item")), vertices, 0, []
    while True:
        prints = sets.groupBy("vid").agg(F.count("*").alias("size"), _print("item", 2 * seed, bits).alias("x"), _print("item", 2 * seed + 1, bits).alias("y"))
        printed = settled(left.join(prints, "vid", "left").fillna(0, ["size", "x", "y"]))
        alike = [*keys, "size", "x", "y"]
        names = printed.groupBy(*alike).agg(F.min("vid").alias("cid")).select("cid", *[F.col(c).alias(f"of_{c}") for c in alike])
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in alike])
        named = settled(printed.join(names, same).select("vid", *keys, "size", "cid"))
        # a member of another set misses one of the smallest vertex's items, as both have equally many
        others = named.where("vid <> cid and size > 0").select("vid", "cid", "size")
        held = sets.join(others.select("cid").distinct().withColumnRenamed("cid", "vid"), "vid", "left_semi").select(F.col("vid").alias("cid"), "item", F.lit(1).alias("hit"))
        shared = others.join(sets, "vid").join(held, ["cid", "item"], "left").groupBy("vid", "size").agg(F.count("hit").alias("hits"))
        strays = settled(shared.where("hits < size").select("vid"))
        if strays.isEmpty():
            return reduce(DataFrame.union, [*done, named])
        done.append(named.join(strays, "vid", "left_anti").select("vid", *keys, "size", "cid"))
        left, seed = named.join(strays, "vid", "left_semi").select("vid", *keys), seed + 1


def student_classes(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """stid, grad, degree, cid: students of equal grad flag and courses have the smallest of them as cid."""
    members = equal_sets(pairs.select(F.col("stid").alias("vid"), F.col("crsid").alias("item")), attributes.select(F.col("stid").alias("vid"), "grad"))
    return members.where("size > 0").select(F.col("vid").alias("stid"), "grad", F.col("size").alias("degree"), "cid")


def class_table(members: DataFrame) -> DataFrame:
    """cid, grad, mult, degree of every class of ``student_classes``."""
    return members.groupBy("cid").agg(F.any_value("grad").alias("grad"), F.count("*").alias("mult"), F.any_value("degree").alias("degree"))


def class_edges(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """cid, crsid: one edge per class and course, those of the class's smallest student."""
    return pairs.join(members.where("stid = cid").select("stid"), "stid", "left_semi").select(F.col("stid").alias("cid"), "crsid")


def compression_map(edges: DataFrame, vertices: DataFrame, bits: int = 64) -> DataFrame:
    """vid, in_src, weight, cid: any vertices alike in all of (in_src, weight, neighbours) have the smallest of them as cid.

    vertices: vid, in_src, weight, live ones only.
    """
    near = both_ways(edges).select(F.col("a").alias("vid"), F.col("b").alias("item")).distinct()
    return equal_sets(near, vertices.select("vid", "in_src", "weight"), bits).select("vid", "in_src", "weight", "cid")


def compressed(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """cid, in_src, weight, mult: the classes of ``compression_map``."""
    return compression_map(edges, vertices).groupBy("cid", "in_src", "weight").agg(F.count("*").alias("mult")).select("cid", "in_src", "weight", "mult")


def shortest_neighbors(classes: DataFrame, edges: DataFrame, courses: DataFrame) -> DataFrame:
    """cid, crsid, mult, hours: each class's nearest courses, those of the most hours."""
    rows = edges.join(courses.select("crsid", "hours"), "crsid")
    most = rows.groupBy("cid").agg(F.max("hours").alias("hours"))
    return rows.join(most, ["cid", "hours"]).join(classes.select("cid", "mult"), "cid").select("cid", "crsid", "mult", "hours")


def internal_pairs(nearest: DataFrame) -> DataFrame:
    """crsid, score: paths between members of one class, shared by its nearest courses."""
    ways = nearest.groupBy("cid").agg(F.count("*").alias("ways"))
    rows = nearest.where("mult > 1").join(ways, "cid")
    return rows.groupBy("crsid").agg(F.sum(F.col("mult") * (F.col("mult") - 1) / F.col("ways")).alias("score"))
