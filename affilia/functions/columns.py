"""Scalar expressions of the roster model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_type(major: Column, grad: Column) -> Column:
    """major * 2 + grad; courses have type 0."""
    return major * 2 + grad.cast("int")


def type_major(packed: Column) -> Column:
    return F.shiftright(packed, 1)


def type_is_grad(packed: Column) -> Column:
    return packed.bitwiseAND(1) == 1


def is_student(packed: Column) -> Column:
    return packed != 0


def student_vid(stid: Column) -> Column:
    return stid * 2


def course_vid(crsid: Column) -> Column:
    return crsid * 2 + 1


def vid_is_student(vid: Column) -> Column:
    return vid % 2 == 0


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(total, F.lit(0)), digits)


def betweenness_norm(norm: int, n: Column) -> Column:
    """Factor on ordered-pair sums: 0 is half, 1 leaves the vertex out of the pairs, 2 doesn't; 0 where no pair is left."""
    if norm == 0:
        return F.lit(0.5)
    n = n.cast("double")  # the pairs of 50,000 vertices don't fit an int
    pairs = (n - 2) * (n - 1) if norm == 1 else n * (n - 1)
    return F.when(pairs > 0, 1.0 / pairs).otherwise(0.0)


def report_line(row: dict, total: int) -> str:
    """One printed line: cost, three percentages, betweenness."""
    share = lambda x: f" {100.0 * (row[x] or 0) / total if total else 0.0:5.1f}%"
    return f"{row['removed_cost']:6d}" + share("included") + share("max_cc") + share("max_bcc") + f" {row['max_bc'] or 0.0:7.5f}"
