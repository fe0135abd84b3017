"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source (map-side combined). Every source's target is its
weighted share of the mix, stopped at ``limit`` times the source; what is cut
off is shared anew by weight until no target is above. A document is then
taken floor(rate) times, plus once more if a hash of its doc_id, seeded, falls
below the rate's fraction. No count depends on row order, so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; repeated rows draw alike, each for itself; an empty table
gives no rows; a source without words has rate 0; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The weights that sources get in turn, by code point.
WEIGHTS = (3, 1, 2)
#: The mix has this many hundredths of all words; a source is repeated at most LIMIT times.
SHARE = 150
LIMIT = 2
SEED = "mix-1"
#: Above this many sources their targets are joined by a shuffle, not broadcast.
BROADCAST_SOURCES = 20_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number from 0 to 1 that only the seed and doc_id decide (52 bits of a digest)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: int = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources stop in the order of limit * size / weight. With k of them stopped
    the rest get (mix - what the k have) / (their weights) per unit of weight;
    the first k at which nobody else has to stop is the answer.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    fills = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "source",
        "source_size",
        "_w",
        (F.sum("source_size").over(everything) * share).alias("_mix"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_open"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_full"),
    ).withColumn("_level", (F.col("_mix") - F.col("_full") * (100 * limit)).cast("double") / (F.col("_open") * 100).cast("double"))
    stops = F.col("_level") * F.col("_w") >= (F.col("source_size") * limit).cast("double")
    level = F.max(F.when(~stops, F.col("_level"))).over(everything)  # levels fall from the first that doesn't stop
    return levels.select("source", "source_size", F.when(stops, (F.col("source_size") * limit).cast("double")).otherwise(level * F.col("_w")).alias("target"))


def rates(docs: DataFrame, **options) -> DataFrame:
    """docs plus size, source_size, target and copies (how often the mix takes the row)."""
    names = docs.columns
    sized = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col("source").cast("string").alias("_source"), n_words().alias("_size"))
    sizes = sized.groupBy("_source").agg(F.sum("_size").alias("source_size")).withColumnRenamed("_source", "source")
    plan = targets(sizes, **options).withColumnRenamed("source", "_to")
    if sizes.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (draw("_row.doc_id") < rate - F.floor(rate)).cast("int")
    return sized.join(plan, F.col("_source").eqNullSafe(F.col("_to"))).select("_row.*", F.col("_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    names = docs.columns
    taken = rates(docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_doc"), F.col("doc_id"), F.col("source"), F.col("text")), **options)
    return taken.where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_doc.*")
