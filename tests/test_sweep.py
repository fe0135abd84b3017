"""The sweep by components of the roster: in one task, by joins, and some of either."""

import random

import pytest

from affilia.plans import analysis

from .test_analysis import budgets, roster


def _rows():
    """Components of 1 to 60 rows that share nothing, with repeats; budgets cut them into smaller ones."""
    rng = random.Random(5)
    return [(100 * k + rng.randrange(1 + k), 100 * k + rng.randrange(1 + k // 2), 1) for k in range(12) for _ in range(1 + 5 * k)]


@pytest.mark.parametrize("strategy", ["prefix", "skip_fit"])
def test_sweep_by_components(spark, monkeypatch, strategy):
    rows, costs = roster(spark, _rows()), budgets(spark, 0, 40, 90, 10**6)
    seen, found = [], analysis.C.connected_components

    def components(edges, *args, **kwargs):
        seen.append(edges.count())
        return found(edges, *args, **kwargs)

    monkeypatch.setattr(analysis.C, "connected_components", components)
    report = lambda: sorted(map(tuple, analysis.sweep(rows, costs, strategy=strategy).collect()))
    plain = report()
    # the roster's edges once and the largest components, not a copy of all for each budget
    assert sum(seen) < 2 * len({r[:2] for r in _rows()})
    assert len({r[3:] for r in plain}) == 4 and plain[-1][3:] == (0, 0.0, 0, 0.0, 0, 0.0, 0.0)
    for limit in (30, 0):
        monkeypatch.setattr(analysis, "TASK_EDGES", limit)
        assert report() == plain
    if strategy == "prefix":
        monkeypatch.setattr(analysis, "NESTED_EDGES", 0)
        assert report() == plain
