"""Small graphs with known answers."""

WC5 = """WC
3 2
1 1 1 0 1
1 2 1 0 1
2 1 2 1 1
3 1 1 0 1
3 2 1 0 1
"""
#: The same with two hours for course 2.
WC5_HOURS = WC5.replace(" 2 1 0 1\n", " 2 1 0 2\n")
GENERIC = [tuple(map(int, e.split("-"))) for e in "1-2 2-3 2-4 2-5 2-6 3-4 5-6 5-7 6-7 7-8 7-11 8-9 8-11 8-12 8-14 8-15 9-10 9-11 10-11 10-16 10-17 10-18 12-13 13-14 13-15 17-18".split()]
#: Students 1 to 3; courses 1 (2 h): 1, 2; 2 (1 h): 1, 3; 3 (8 h): 2, 3.
MIXED = [(1, 1, 2), (2, 1, 2), (1, 2, 1), (3, 2, 1), (2, 3, 8), (3, 3, 8)]


def roster(spark, rows, grad=()):
    """rows: (stid, crsid, hours)."""
    return spark.createDataFrame([(k, s, c, 1, s in grad, h) for k, (s, c, h) in enumerate(rows)], "row_id long, stid long, crsid long, major int, grad boolean, hours long")


def parsed(spark, text):
    from pyspark.sql import functions as F

    from affilia.sources.readers import parse_wc5

    lines = spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
    return parse_wc5(lines).where("error is null").drop("error").withColumn("row_id", F.col("stid") * 100 + F.col("crsid"))


def edges(spark, pairs, length=1):
    return spark.createDataFrame([(a, b, length) for a, b in pairs], "a long, b long, length long")
