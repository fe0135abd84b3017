"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import ensure_checkpoint_dir

#: Longest text slice (bytes) that the Arrow kernels vectorise over at once.
KERNEL_BYTES = 1 << 18
#: Spark's setting for the bytes of an Arrow batch, its default, and what these operators set in the default's place.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, as Spark reads it (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Plans that nothing refers to any more are let go of, so that the driver
    frees them and Spark removes their shuffle files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    return out


def trim() -> None:
    """Returns freed memory to the system."""
    ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow over small batches; after each partition the worker returns freed memory to the system.

    A batch counts several times in an executor (JVM, worker, strings, results);
    the session's own batch size, where one is set, is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, BATCH_BYTES)

    def over(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(over, schema)


def held_out(doc_id="doc_id"):
    """The fold that no model may learn from: crc32(doc_id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def slices(texts, limit: int = KERNEL_BYTES):
    """(first row, encoded texts) for runs of rows of about ``limit`` bytes; null counts as empty."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield first, held
            first, held, size = row, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held
