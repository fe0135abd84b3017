"""Filters, joins and aggregates over rosters and vertex graphs.

Rosters: stid, crsid, major, grad, hours (repeats count for cost and degree).
Graphs: undirected edges (a, b), each pair once; vid = 2 * stid or 2 * crsid + 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import course_vid, student_vid, vid_is_student

#: Students in a block of a course's co-enrolment: a pair of blocks is up to 16 million student pairs.
BLOCK_STUDENTS = 4096


def memberships(enrol: DataFrame) -> DataFrame:
    """Distinct (stid, crsid): the topology."""
    return enrol.select("stid", "crsid").distinct()


def vertex_edges(pairs: DataFrame) -> DataFrame:
    """Student-course pairs as edges (a: student vid, b: course vid)."""
    return pairs.select(student_vid(F.col("stid")).alias("a"), course_vid(F.col("crsid")).alias("b"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from one scan."""
    a, b = F.col("a"), F.col("b")
    return edges.select(F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))).alias("e")).select("e.a", "e.b")


def cardinality(enrol: DataFrame) -> DataFrame:
    return enrol.agg(F.max("stid").alias("n_students"), F.max("crsid").alias("n_courses"))


def student_attributes(enrol: DataFrame) -> DataFrame:
    """Each student's major and grad flag: the last row's."""
    last = lambda c: F.max_by(c, "row_id").alias(c)
    return enrol.groupBy("stid").agg(last("major"), last("grad"))


def course_attributes(enrol: DataFrame) -> DataFrame:
    """Each course's hours (the last row's; of equal row_ids the first ``place``'s, if there is one), cost and degree (all rows)."""
    hours = F.min_by("hours", F.struct(-F.col("row_id"), "place")) if "place" in enrol.columns else F.max_by("hours", "row_id")
    return enrol.groupBy("crsid").agg(hours.alias("hours"), F.sum("hours").alias("cost"), F.count("*").alias("degree"))


def neighborhoods(pairs: DataFrame) -> DataFrame:
    """Each student's sorted courses."""
    return pairs.groupBy("stid").agg(F.array_sort(F.collect_set("crsid")).alias("nbr"))


def without_courses(pairs: DataFrame, removed: DataFrame) -> DataFrame:
    """Pairs whose course isn't removed."""
    return pairs.join(removed.select("crsid"), "crsid", "left_anti").select("stid", "crsid")


def included_students(pairs: DataFrame, removed: DataFrame) -> DataFrame:
    """Students with a course left."""
    return pairs.select("stid").distinct().join(without_courses(pairs, removed), "stid", "left_semi")


def induced(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Edges with both ends in live (vid)."""
    return edges.join(live.select(F.col("vid").alias("a")), "a", "left_semi").join(live.select(F.col("vid").alias("b")), "b", "left_semi").select("a", "b")


def with_neighbor(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Live vertices with a live neighbour."""
    return both_ways(induced(edges, live)).select(F.col("a").alias("vid")).distinct()


def masked_degrees(vertices: DataFrame, edges: DataFrame, live: DataFrame) -> DataFrame:
    """Degree of every vertex among live ones; 0 for the others."""
    counts = both_ways(induced(edges, live)).groupBy(F.col("a").alias("vid")).agg(F.count("*").alias("d"))
    return vertices.select("vid").join(counts, "vid", "left").select("vid", F.coalesce("d", F.lit(0)).alias("degree"))


def co_enrolment(pairs: DataFrame, block: int = BLOCK_STUDENTS) -> DataFrame:
    """Student pairs and how many courses they share.

    A course's students are dealt into blocks of about ``block``, and each pair
    of its blocks is a join key, so no key meets the square of a large course;
    what a task counts is summed before it is shuffled. A course of one block
    is one key and its rows stay single.
    """
    blocks = pairs.groupBy("crsid").agg(F.ceil(F.count("*") / block).cast("long").alias("n"))
    dealt = pairs.join(blocks, "crsid").select("crsid", "stid", F.pmod(F.xxhash64("stid"), "n").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    one = dealt.select("crsid", F.col("own").alias("i"), F.col("other").alias("j"), F.col("stid").alias("st1"))
    two = dealt.select("crsid", F.col("other").alias("i"), F.col("own").alias("j"), F.col("stid").alias("st2"))
    return one.join(two, ["crsid", "i", "j"]).where("st1 < st2").groupBy("st1", "st2").agg(F.count("*").alias("n_shared"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """comp_id, n_students, n_vertices from (vid, comp_id)."""
    return labels.groupBy("comp_id").agg(F.count_if(vid_is_student(F.col("vid"))).alias("n_students"), F.count("*").alias("n_vertices"))


def largest(sizes: DataFrame, id_column: str, size: str = "n_students") -> DataFrame:
    """The one row of largest size, ties to the smaller id (a top-1, not a sort)."""
    return sizes.orderBy(F.col(size).desc(), id_column).limit(1)
