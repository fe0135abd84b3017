"""Sharding by jump consistent hashing, with DataFrame functions only.

The law is ``key``: doc_id and the number of shards decide. A pseudo-random
sequence seeded by the key gives the key's jump points 0 = j0 < j1 < ...; its
shard among n is the last one below n. One more shard therefore takes rows
only into itself, and no ring table exists.

The sequence is the 64-bit linear congruential generator of the published
algorithm. Its i-th state is key * A**i + C_i modulo 2**64 with constants, so
all states are independent expressions; the products are taken in 32-bit
halves because SQL arithmetic refuses to wrap.

Slots are counted in two levels: rows are numbered inside fine buckets of a
shard, and the buckets' sizes are summed up, so that no task sees a whole shard.

Defined results: a null doc_id counts as -1, a null text has size 1 and the
checksum of no bytes; repeated rows get slots of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of jump consistent hashing: the generator's multiplier and increment.
MULTIPLIER = 2862933555777941757
INCREMENT = 1
SHARDS = 8
#: Rows of a shard that are numbered in one task's group, about.
BUCKET_ROWS = 50_000
_MASK = (1 << 64) - 1


def state_constants(step: int) -> tuple[int, int]:
    """(a, c): the generator's state after ``step`` steps is key * a + c modulo 2**64."""
    a, c = 1, 0
    for _ in range(step):
        a, c = a * MULTIPLIER & _MASK, (c * MULTIPLIER + INCREMENT) & _MASK
    return a, c


def _high_half(key: Column, step: int) -> Column:
    """Upper 32 bits of the state after ``step`` steps, in 16-bit limbs that can't overflow."""
    a, c = state_constants(step)
    limbs = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    parts = [a >> 16 * i & 0xFFFF for i in range(4)]
    adds = [c >> 16 * i & 0xFFFF for i in range(4)]
    carry, out = F.lit(0).cast("long"), []
    for k in range(4):
        total = carry + F.lit(adds[k])
        for i in range(k + 1):
            total = total + limbs[i] * F.lit(parts[k - i])
        out.append(total)
        carry = F.shiftright(total, 16)
    return out[3].bitwiseAND(0xFFFF) * 65536 + out[2].bitwiseAND(0xFFFF)


def jump_points(key: Column, most: int) -> Column:
    """Array of the key's jump points below ``most``, and the first one that isn't, at most ``most`` of them."""
    high = F.array(*[_high_half(key, i) for i in range(1, most + 1)])
    longer = lambda points, h: F.when(
        F.element_at(points, -1) >= most, points
    ).otherwise(F.concat(points, F.array(F.floor((F.element_at(points, -1) + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(h, 1) + 1).cast("double"))).cast("long"))))
    return F.aggregate(high, F.array(F.lit(0).cast("long")), longer)


def shard_of(points: Column, shards: int) -> Column:
    return F.array_max(F.filter(points, lambda j: j < shards)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs plus shard, grown_shard (with one more shard) and a gapless slot within the shard."""
    names = docs.columns
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    buckets = max(1, -(-docs.count() // bucket_rows))
    placed = (
        docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), jump_points(key, shards + 1).alias("_points"), key.alias("_key"))
        .select("_row", "_key", shard_of(F.col("_points"), shards).alias("_shard"), shard_of(F.col("_points"), shards + 1).alias("_grown"))
        .withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    )
    sizes = placed.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_shard", "_bucket").orderBy("_key", "_row")
    return (
        placed.withColumn("_at", F.row_number().over(inside))
        .join(offsets, ["_shard", "_bucket"])
        .select("_row.*", F.col("_shard").alias("shard"), F.col("_grown").alias("grown_shard"), (F.col("_before") + F.col("_at") - 1).alias("slot"))
    )


def documents_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size and checksum of the texts: all that sharding by key has to move."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
