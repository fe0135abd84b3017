"""Roster files: one record per line, numbers separated by white space.

Layouts: ``WC`` with a ``students courses`` line and rows of five columns,
``WC`` with a name line and rows of two columns, and rows of four columns
without a head. The head tells them apart, so files are read in parallel and
no line number is needed. Lines that are no valid record are kept as errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENROL = "stid long, crsid long, major int, grad boolean, hours long"


def tokens(lines: DataFrame) -> DataFrame:
    """lines: value. Adds t, the line's tokens; empty lines go."""
    return lines.withColumn("t", F.filter(F.split("value", r"\s+"), lambda x: x != "")).where(F.size("t") > 0)


def _number(k: int):
    return F.expr(f"try_cast(get(t, {k}) as bigint)")


def _records(rows: DataFrame, size: int, valid, major, grad, hours) -> DataFrame:
    """The columns of a roster, ``row_id`` where rows have it, and ``error``: the line where it isn't a valid record."""
    good = (F.size("t") == size) & (_number(0) >= 1) & (_number(1) >= 1) & valid
    return rows.select(
        *[c for c in rows.columns if c == "row_id"],
        _number(0).alias("stid"),
        _number(1).alias("crsid"),
        major.cast("int").alias("major"),
        grad.alias("grad"),
        hours.cast("long").alias("hours"),
        F.when(F.coalesce(good, F.lit(False)), F.lit(None)).otherwise(F.col("value")).alias("error"),
    )


def _without(rows: DataFrame, head) -> DataFrame:
    """rows without the lines of the head."""
    return rows.where(~F.col("value").isin(list(head))) if head else rows


def parse_wc5(lines: DataFrame, head=()) -> DataFrame:
    """Rows of the five-column layout. head: the lines before the first row, if they are known; else WC and lines of two tokens are."""
    rows = tokens(lines)
    rows = _without(rows, head) if head else rows.where(~((F.size("t") == 1) & (F.get("t", 0) == "WC")) & (F.size("t") != 2))
    return _records(rows, 5, _number(2).between(1, 6) & _number(3).isin(0, 1) & (_number(4) >= 1), _number(2), _number(3) == 1, _number(4))


def declared_sizes(lines: DataFrame) -> DataFrame:
    """n_students, n_courses of the header line."""
    return tokens(lines).where(F.size("t") == 2).select(_number(0).alias("n_students"), _number(1).alias("n_courses"))


def parse_wc2(lines: DataFrame, head=()) -> DataFrame:
    """Rows of two columns with sparse ids; hours are 1."""
    return _records(_without(tokens(lines), head), 2, F.lit(True), F.lit(1), F.lit(False), F.lit(1))


def parse_wc4(lines: DataFrame, head=()) -> DataFrame:
    """Rows of four columns; hours are 1."""
    return _records(_without(tokens(lines), head), 4, _number(2).between(1, 6) & _number(3).isin(0, 1), _number(2), _number(3) == 1, F.lit(1))


def layout(lines: list[str]):
    """(parser, head) of a file by its first three lines that aren't empty."""
    split = [x.split() for x in lines]
    numbers = [all(t.lstrip("-").isdigit() for t in t_) for t_ in split]
    if split and split[0] == ["WC"]:
        sizes = len(split) > 1 and len(split[1]) == 2 and numbers[1]
        if sizes and (len(split) < 3 or len(split[2]) != 2):
            return parse_wc5, lines[:2]
        return parse_wc2, lines[:2]
    if split and len(split[0]) == 4 and numbers[0]:
        return parse_wc4, []
    raise ValueError(f"unknown roster format: {lines[0].strip() if lines else ''!r}")


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """value, row_id: lines and their order, by file, place of the split in it and place in the split.

    A split is read from its start on, so the order is that of the files,
    however they are split.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("row_id"))


def read_roster(spark: SparkSession, path: str, errors: str = "raise", ordered: bool = False) -> DataFrame:
    """A roster file of any layout.

    ordered: with ``row_id``, the rows' order in the files, by which the last
    row of a student or course gives its attributes.

    errors: "raise" refuses a file with lines that are no valid record, "keep"
    returns them (column ``error``), "drop" leaves them out. A later line that
    equals a line of the head counts as head.
    """
    text = lines_in_order(spark, path) if ordered else spark.read.text(path)
    parser, head = layout([r["value"] for r in text.where("trim(value) <> ''").limit(3).collect()])
    rows = parser(text, head)
    if errors == "keep":
        return rows
    if errors == "raise" and (bad := rows.where("error is not null").select("error").take(1)):
        raise ValueError(f"{rows.where('error is not null').count()} lines are no valid record, such as {bad[0]['error']!r}")
    return rows.where("error is null").drop("error")


def to_lines(enrol: DataFrame) -> DataFrame:
    """The five-column record lines of a roster (the writer's side of ``parse_wc5``)."""
    return enrol.select(F.concat_ws(" ", "stid", "crsid", "major", F.col("grad").cast("int"), "hours").alias("value"))


def random_roster(spark: SparkSession, rows: int, students: int, courses: int, seed: int = 1) -> DataFrame:
    """Uniform random enrolments, made where they are used."""
    return spark.range(rows).select(
        (F.floor(F.rand(seed) * students) + 1).alias("stid"), (F.floor(F.rand(seed + 1) * courses) + 1).alias("crsid"), F.lit(1).alias("major"), F.lit(False).alias("grad"), F.lit(1).cast("long").alias("hours")
    )
