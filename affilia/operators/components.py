"""Connected components of an edge table.

Large-star / small-star contraction: every round is two aggregations with
map-side combine and joins on vertex ids, so a vertex with very many edges is
split by adaptive execution and nothing is gathered on the driver. It ends
when the edges are stars around each component's smallest vertex, after about
log(n) rounds. Lineage is cut in the shared checkpoint folder each round, and
what a round shuffled and the round before it wrote are removed.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of whole components that a kernel takes at once, about.
PACK_ROWS = 100_000
#: Shuffle files go when the job that wrote them is done.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; where none is set, a local master gets one of its own, a cluster is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="affilia-checkpoint-")
    context.setCheckpointDir(folder)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again, for loops.

    A checkpoint keeps the optimizer's estimate of its size; over rounds of
    joins that number squares until planning takes longer than the work. A
    written table has its files' size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/round-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out.settled_at = folder
    return out


def discard(table: DataFrame) -> None:
    """Remove the files of a table from ``settled`` that nothing reads any more."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.settled_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def by_component(rows: DataFrame, key: str, kernel: Callable[[pa.Table], Iterator[pa.Table]], schema: str, pack_rows: int | None = None) -> DataFrame:
    """What ``kernel`` makes of the rows, given as tables of whole components (``key``, never null).

    A component's rows come to one task; many small ones go through the kernel
    together, so a component doesn't cost a call, and results are streamed.
    """
    pack_rows = PACK_ROWS if pack_rows is None else pack_rows

    def run(batches):
        held, size, enough = [], 0, pack_rows
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= enough:
                table = pa.Table.from_batches(held)
                keys = table.column(key).to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    for out in kernel(table.slice(0, whole)):
                        yield from out.to_batches()
                held = table.slice(whole).combine_chunks().to_batches()
                size = table.num_rows - whole
                enough = max(pack_rows, 2 * size)
        if size:
            for out in kernel(pa.Table.from_batches(held)):
                yield from out.to_batches()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.toDF("a", "b")).distinct()


def star_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """vid, comp_id (the component's smallest vertex) of all vertices with an edge.

    edges: two columns of the same ordered type; direction, repeats, loops and
    nulls don't matter (a vertex with nothing but a loop is left out).
    """
    ensure_checkpoint_dir(edges.sparkSession)
    left, right = edges.columns
    now = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now, mark = settled(now), None
    for _ in range(rounds):
        last, now = now, settled(_small_star(_large_star(now)))
        discard(last)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())
        if seen == mark:
            roots = now.select(F.col("b").alias("vid")).distinct().select("vid", F.col("vid").alias("comp_id"))
            return now.select(F.col("a").alias("vid"), F.col("b").alias("comp_id")).union(roots)
        mark = seen
    raise RuntimeError(f"components have not converged after {rounds} rounds")
