"""Bitmaps of fixed size that let most rows of a map side pass by a shuffle.

A bitmap has one bit per slot of a 64-bit number (its low bits). It is built
by an aggregation over at most 2**BITS / 64 words, so its size doesn't depend
on the data; a fuller bitmap only filters less. It never decides: what it lets
through is joined exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, trim

#: 2**BITS bits are 8 MB.
BITS = 26


def build(numbers: DataFrame) -> np.ndarray:
    """Words of the bitmap of the one column of numbers."""
    slot = numbers.select(F.col(numbers.columns[0]).bitwiseAND((1 << BITS) - 1).alias("s"))
    words = slot.select(F.shiftright("s", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    del found
    trim()
    return out


def has(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = numbers & ((1 << BITS) - 1)
    return (words[slot >> 6] >> (slot & 63) & 1).astype(bool)


def rows_in(df: DataFrame, column: str, words, wanted: bool = True) -> DataFrame:
    """Rows of df whose number is (not) in the broadcast bitmap; nulls are not in it."""

    def run(batches):
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(column))
            inside = has(words.value, pc.fill_null(at, 0).to_numpy(zero_copy_only=False)) & ~pc.is_null(at).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(inside == wanted))

    return mapped(df, run, df.schema)
