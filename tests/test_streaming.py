from affilia.streaming import totals

from .fixtures import WC5


def test_streamed_totals_equal_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = WC5.splitlines()
    for k in range(0, len(lines), 2):
        (folder / f"{k}.txt").write_text("\n".join(lines[k : k + 2]) + "\n")
    rows = totals.read_lines(spark, str(folder), files_per_trigger=1)
    totals.start(totals.course_totals(rows), "course_totals", "complete", str(tmp_path / "c1")).awaitTermination()
    assert sorted(map(tuple, spark.table("course_totals").collect())) == [(1, 3, 3), (2, 2, 2)]
    removed = spark.createDataFrame([(1,)], "crsid long")
    totals.start(totals.included_students(rows, removed), "included", "append", str(tmp_path / "c2")).awaitTermination()
    assert sorted(r.stid for r in spark.table("included").collect()) == [1, 3]
