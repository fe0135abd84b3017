"""Exact edge lengths 1 / hours as whole numbers of any size.

A length is scale / hours, where every value of hours divides the scale. While
distances fit 64 bits a length is a long. Beyond, it is a struct of limbs, the
most significant first: Spark compares structs field by field, so minima,
equality and order need nothing more, and ``plus`` adds with carries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 10**18
#: A scale up to here leaves room for paths of 2**22 edges in a long; beyond, limbs leave room for LIMB edges.
LONG_SCALE = 1 << 40


def distinct_hours(hours: DataFrame) -> list[int]:
    """The different values of hours: a domain of credit values, one number each."""
    return sorted(r["hours"] for r in hours.select("hours").distinct().where("hours >= 1").toLocalIterator())


def limbs(value: int, count: int) -> tuple:
    """A number as ``count`` limbs."""
    out = []
    for _ in range(count):
        value, low = divmod(value, LIMB)
        out.append(low)
    return tuple(reversed(out))


def number(value) -> int:
    """A long or a row of limbs as a number."""
    if isinstance(value, int):
        return value
    total = 0
    for limb in value:
        total = total * LIMB + limb
    return total


def width(df: DataFrame, column: str = "length") -> int:
    """Limbs of a column of lengths; 0 for longs."""
    kind = df.schema[column].dataType
    return len(kind.fields) if hasattr(kind, "fields") else 0


def constant(value: int, count: int) -> Column:
    if not count:
        return F.lit(value).cast("long")
    return F.struct(*[F.lit(x).cast("long").alias(f"l{k}") for k, x in enumerate(limbs(value, count))])


def plus(a: Column, b: Column, count: int) -> Column:
    """a + b, of longs or of limbs."""
    if not count:
        return a + b
    out, carry = [], F.lit(0).cast("long")
    for k in reversed(range(count)):
        total = a[f"l{k}"] + b[f"l{k}"] + carry
        carry = F.when(total >= LIMB, 1).otherwise(0).cast("long") if k else carry
        out.append((total - carry * LIMB if k else total).alias(f"l{k}"))
    return F.struct(*reversed(out))


def with_length(rows: DataFrame, hours: DataFrame | None = None) -> DataFrame:
    """rows (hours, ...) plus ``length``; hours: where the values come from, if not rows."""
    values = distinct_hours(rows if hours is None else hours)
    scale = math.lcm(1, *values)
    if scale <= LONG_SCALE:
        return rows.withColumn("length", F.expr(f"{scale} div hours"))
    count = 2
    while LIMB ** (count - 1) <= scale:
        count += 1
    kind = ", ".join(f"l{k}: long" for k in range(count))
    table = rows.sparkSession.createDataFrame([(h, limbs(scale // h, count)) for h in values], f"hours long, length struct<{kind}>")
    return rows.join(table, "hours")
