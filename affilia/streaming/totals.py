"""The roster's incremental aggregates over a stream of enrolment rows.

The same column expressions as in batch; state is one row per course or
student. Rows may come in any order, repeats count for cost and degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import parse_wc5


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Roster records from files that arrive in a folder; invalid lines go."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_wc5(lines).where("error is null").drop("error")


def course_totals(rows: DataFrame) -> DataFrame:
    """crsid, cost, degree so far (update or complete mode)."""
    return rows.groupBy("crsid").agg(F.sum("hours").alias("cost"), F.count("*").alias("degree"))


def included_students(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Each student once, when the first row in a course that isn't removed arrives (append mode)."""
    return rows.join(removed.select("crsid"), "crsid", "left_anti").select("stid").dropDuplicates(["stid"])


def start(result: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there now into an in-memory table; ``checkpoint`` is to be a shared folder."""
    return result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
