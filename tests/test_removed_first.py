"""A sweep leaves out what all budgets remove, and puts only the courses in order at which a budget ends."""

import random

import pytest
from pyspark.sql import functions as F

from affilia.operators import kernels, removal
from affilia.plans import analysis

from .test_analysis import budgets, roster
from .test_sweep import _rows


def test_no_search_of_courses_that_all_budgets_remove(spark, monkeypatch):
    rows, seen, found = roster(spark, _rows()), [], analysis.C.grouped_edges
    monkeypatch.setattr(analysis.C, "grouped_edges", lambda edges, *args: seen.append({(r.b - 1) // 2 for r in edges.collect()}) or found(edges, *args))
    whole = {r.threshold_id: r for r in analysis.sweep(rows, budgets(spark, 0, 40, 90)).collect()}
    for t in whole:
        one = budgets(spark, 0, 40, 90).where(F.col("threshold_id") == t)
        assert analysis.sweep(rows, one).collect() == [whole[t]]
        gone = {r.crsid for r in removal.prefix_removed(analysis.swept_courses(rows), one).collect()}
        assert seen[-1] == {c for _, c, *_ in _rows()} - gone
    assert len(seen[-1]) < len(seen[0])


@pytest.mark.parametrize("whole", [True, False])
def test_only_the_last_size_is_put_in_order(spark, monkeypatch, whole):
    rng, seen, found = random.Random(3), [], removal.running_total
    courses = [(c, rng.choice([1, 2, 2, 5, 9]), rng.randrange(1, 6)) for c in range(60)]
    monkeypatch.setattr(removal, "running_total", lambda rows, *args: seen.append({r.degree for r in rows.collect() if "crsid" in rows.columns}) or found(rows, *args))
    ordered, spent, want = sorted(courses, key=lambda c: (-c[1], c[0])), 0, set()
    up_to = lambda size: sum(c[2] for c in courses if c[1] >= size)
    costs = [up_to(9), up_to(2), 0, up_to(1) + 7] if whole else [up_to(9) + 4, up_to(5) + 11, up_to(2) + 5, up_to(2) + 6]
    for c in ordered:
        spent += c[2]
        want |= {(t, c[0], c[2]) for t, most in enumerate(costs) if spent <= most}
    got = removal.prefix_removed(spark.createDataFrame(courses, "crsid long, degree long, cost long"), spark.createDataFrame(list(enumerate(costs)), "threshold_id int, max_cost long"))
    assert sorted(map(tuple, got.select("threshold_id", "crsid", "cost").collect())) == sorted(want)
    assert set().union(*seen) == (set() if whole else {5, 2, 1})


def test_hanging_edges():
    import numpy as np

    # a long path, a triangle with a star on it
    x = np.array([*range(40), 50, 51, 50, *[52] * 30])
    y = np.array([*range(1, 41), 51, 52, 52, *range(60, 90)])
    assert kernels._hanging(90, x, y).tolist() == [True] * 40 + [False] * 3 + [True] * 30
    assert kernels.blocks(90, x, y).tolist() == [*range(40), 40, 40, 40, *range(43, 73)]
