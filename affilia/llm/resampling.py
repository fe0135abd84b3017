"""Importance resampling toward a target corpus, with DataFrame functions only.

A text's features are its runs of one to three consecutive words; a feature's
bucket is its crc32 modulo BUCKETS. Buckets are counted over all documents and
all target texts (map-side combine, at most BUCKETS rows a task). Their gains
are a table of BUCKETS rows, whatever the input, so it is broadcast; a
document's weight is the sum of its features' gains. Gumbel noise seeded by
doc_id is added, the scores are sorted over range partitions, and a row's rank
is its place in its partition after the rows of the partitions before.

Defined results: null and empty texts have no features and weight 0; a null
doc_id draws its noise as an empty one; repeated rows count, weigh and rank
each for itself (equal scores go by doc_id, nulls first, then by number of
features); without target texts all gains come from their zero counts; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from .common import cut

BUCKETS = 10_000
#: Hundredths of the documents of at least LEAST_WORDS words that are drawn.
SHARE, LEAST_WORDS = 5, 20
SEED = "42"
#: What stands between words, after A-Z has become a-z; splitting there is a dozen times faster than extracting the words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    """The words of a text, A-Z in lower case."""
    lowered = F.translate(F.col(text).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def feature_buckets(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """rows' other columns, n_words and bucket: a row per word and length of run; bucket is null beyond the last word.

    rows: text and columns of any other name but words, n_words, bucket. The
    n-grams of a text are never in memory together; the expressions compile to
    one loop over its words.
    """
    rest = [c for c in rows.columns if c != "text"]
    worded = rows.select(*rest, words().alias("words")).withColumn("n_words", F.size("words"))
    placed = worded.select(*rest, "n_words", "words", F.posexplode_outer("words").alias("_at", "_1"))
    more = lambda before, k: F.concat(before, F.lit(" "), F.get("words", F.col("_at") + k))  # noqa: E731  null beyond the last word
    runs = placed.withColumn("_2", more(F.col("_1"), 1)).withColumn("_3", more(F.col("_2"), 2))
    return runs.select(*rest, "n_words", F.explode(F.array(*[(F.crc32(F.col(c).cast("binary")) % buckets).cast("int") for c in ("_1", "_2", "_3")])).alias("bucket"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features per bucket over all texts."""
    return feature_buckets(texts.select("text"), buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of all buckets: 1000 times the log of how much likelier the target's smoothed share is, rounded down."""
    count = lambda rows, name: bucket_counts(rows, buckets).withColumnRenamed("n", name)
    table = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(count(docs, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    one = Window.partitionBy()  # over the table's BUCKETS rows
    number = lambda c, more: (c + more).cast("double")
    share = number(F.col("t"), 1) * number(F.sum("s").over(one), buckets) / (number(F.col("s"), 1) * number(F.sum("t").over(one), buckets))
    return table.select("bucket", F.floor(F.lit(1000.0) * F.ln(share)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel draw that only the seed and doc_id decide, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gains: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("_row"))
    weighed = feature_buckets(rows).join(F.broadcast(gains), "bucket", "left").groupBy("_row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return weighed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank (from 1) of those drawn, else null.

    docs: doc_id, text. target: text. Drawn are the highest scores, ``share``
    hundredths of the documents of at least ``least_words`` words.
    """
    rows = cut(scored(docs, gain_table(docs, target), seed))
    able = rows.where(F.col("n_words") >= least_words).drop("n_words")
    drawn = able.count() * share // 100
    placed = ranked(able, [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")], "_place")
    place = F.col("_place").cast("long")
    out = placed.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
    short = rows.where(F.col("n_words") < least_words)
    return out.union(short.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))
