import pytest
from pyspark.sql import functions as F

from affilia.functions.columns import report_line
from affilia.sources import readers

from .fixtures import WC5


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


def test_wc5(spark):
    rows = readers.parse_wc5(lines(spark, WC5 + "\n  9 1 7 0 1\n1 2 3\n4 1 1 0 0\n99999999999 70000 6 1 3\n"))
    good = {tuple(r)[:5] for r in rows.where("error is null").collect()}
    assert (1, 1, 1, False, 1) in good and (2, 1, 2, True, 1) in good and (99999999999, 70000, 6, True, 3) in good and len(good) == 6
    assert {r.error.strip() for r in rows.where("error is not null").collect()} == {"9 1 7 0 1", "1 2 3", "4 1 1 0 0"}
    assert readers.declared_sizes(lines(spark, WC5)).first() == (3, 2)


def test_dispatch(spark, tmp_path):
    (tmp_path / "good.txt").write_text(WC5)
    (tmp_path / "bad.txt").write_text("XY\n1 1\n")
    assert readers.read_roster(spark, str(tmp_path / "good.txt")).count() == 5
    (tmp_path / "two.txt").write_text("WC\n2019 2020\n70 8\n70 9\n71 8\n")
    assert sorted(tuple(r)[:2] for r in readers.read_roster(spark, str(tmp_path / "two.txt")).collect()) == [(70, 8), (70, 9), (71, 8)]
    (tmp_path / "four.txt").write_text("3 2 1 1\n4 2 6 0\n")
    assert sorted(tuple(r) for r in readers.read_roster(spark, str(tmp_path / "four.txt")).collect()) == [(3, 2, 1, True, 1), (4, 2, 6, False, 1)]
    (tmp_path / "flawed.txt").write_text(WC5.strip() + "\n7 8\n1 2 3\n")
    with pytest.raises(ValueError, match="2 lines"):
        readers.read_roster(spark, str(tmp_path / "flawed.txt"))
    assert readers.read_roster(spark, str(tmp_path / "flawed.txt"), errors="drop").count() == 5
    assert {r.error for r in readers.read_roster(spark, str(tmp_path / "flawed.txt"), errors="keep").where("error is not null").collect()} == {"7 8", "1 2 3"}
    with pytest.raises(ValueError, match="XY"):
        readers.read_roster(spark, str(tmp_path / "bad.txt"))


def test_other_layouts(spark):
    assert [tuple(r)[:2] for r in readers.parse_wc2(lines(spark, "WC\nsome name\n70 8\n70 9\n"), ["WC", "some name"]).collect()] == [(70, 8), (70, 9)]
    assert [tuple(r) for r in readers.parse_wc4(lines(spark, "3 2 1 1\n")).drop("error").collect()] == [(3, 2, 1, True, 1)]


def test_lines_round_trip(spark):
    rows = readers.parse_wc5(lines(spark, WC5)).where("error is null").drop("error")
    again = readers.parse_wc5(readers.to_lines(rows)).where("error is null").drop("error")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_random_roster(spark):
    rows = readers.random_roster(spark, 1000, 50, 20)
    assert rows.count() == 1000 and rows.where("stid < 1 or stid > 50 or crsid < 1 or crsid > 20").isEmpty()


def test_report_line():
    row = {"removed_cost": 0, "included": 3, "max_cc": 3, "max_bcc": 2, "max_bc": 7 / 12}
    assert report_line(row, 3) == "     0 100.0% 100.0%  66.7% 0.58333"


def test_last_row_wins_in_any_number_of_splits(spark, tmp_path):
    """Attributes come from the last row of the files, whether they are read in one split or fifty."""
    import random

    from affilia.operators import graph

    rng = random.Random(3)
    rows = [(rng.randint(1, 40), rng.randint(1, 30), rng.randint(1, 6), rng.randint(0, 1), rng.randint(1, 9)) for _ in range(3000)]
    lines = ["WC", "40 30", *(" ".join(map(str, r)) for r in rows)]
    (tmp_path / "roster.txt").write_text("\n".join(lines) + "\n")
    majors, hours = {r[0]: (r[2], bool(r[3])) for r in rows}, {r[1]: r[4] for r in rows}
    size = (tmp_path / "roster.txt").stat().st_size
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for splits in (1, 50):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // splits + 1))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            enrol = readers.read_roster(spark, str(tmp_path / "roster.txt"), ordered=True)
            assert enrol.select(F.spark_partition_id()).distinct().count() >= min(splits, 20)
            assert {r["stid"]: (r["major"], r["grad"]) for r in graph.student_attributes(enrol).collect()} == majors
            assert {r["crsid"]: r["hours"] for r in graph.course_attributes(enrol).collect()} == hours
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
