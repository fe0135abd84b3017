import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from affilia.operators import blockcut, graph, lengths, paths
from affilia.plans import analysis

from .fixtures import MIXED, WC5, WC5_HOURS, parsed, roster


def budgets(spark, *costs):
    return spark.createDataFrame(list(enumerate(costs)), "threshold_id int, max_cost long")


def test_report(spark):
    rows = {r.threshold_id: r for r in analysis.sweep(parsed(spark, WC5), budgets(spark, 0, 3)).collect()}
    a, b = rows[0], rows[1]
    assert (a.removed_cost, a.included, a.max_cc, a.max_bcc) == (0, 3, 3, 2) and abs(a.max_bc - 7 / 12) < 1e-8 and a.max_bcc_pct == 66.7
    assert (b.removed_cost, b.included, b.max_cc, b.max_bcc, b.max_bc) == (3, 2, 2, 1, 1.0)


def scores(spark, enrol):
    pairs = graph.memberships(enrol)
    students, courses = pairs.select("stid").distinct(), pairs.select("crsid").distinct()
    out = analysis.contracted_betweenness(pairs, graph.course_attributes(enrol), students, courses, graph.student_attributes(enrol))
    n = students.count() + courses.count()
    return {(r.kind, r.id): r.score / ((n - 1) * (n - 2)) for r in out.collect()}


def close(got, want):
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want), got


def test_uniform_hours(spark):
    close(scores(spark, parsed(spark, WC5)), {("s", 1): 1 / 6, ("s", 2): 0, ("s", 3): 1 / 6, ("c", 1): 7 / 12, ("c", 2): 1 / 12})


def test_more_hours_are_nearer(spark):
    close(scores(spark, parsed(spark, WC5_HOURS)), {("s", 1): 1 / 6, ("s", 2): 0, ("s", 3): 1 / 6, ("c", 1): 1 / 2, ("c", 2): 1 / 6})


def test_true_shortest_paths_with_mixed_hours(spark):
    close(scores(spark, roster(spark, MIXED)), brute(MIXED))


@pytest.mark.parametrize("hours", [(5, 6), (13, 24), tuple(range(1, 14))])
def test_hours_of_any_size(spark, hours):
    rng = random.Random(sum(hours))
    rows = [(s, c, hours[c % len(hours)]) for s in range(1, 9) for c in rng.sample(range(1, 8), 3)]
    close(scores(spark, roster(spark, rows)), brute(rows))
    both = [(1, 1, hours[0]), (1, 2, hours[-1]), (2, 1, hours[0]), (2, 2, hours[-1])]
    assert scores(spark, roster(spark, both))["c", 1] == 0  # the course of more hours is nearer


@pytest.mark.parametrize("hours", [range(1, 101), (999983, 999979, 999961, 1000003, 1000033, 1000037, 1000039)])
def test_hours_without_a_small_common_multiple(spark, monkeypatch, hours):
    """Lengths of several limbs, in the kernel and by joins."""
    rng = random.Random(9)
    rows = [(s, c, hours[c]) for s in range(1, 11) for c in rng.sample(range(len(hours)), min(len(hours), 40))[:4] + [s % len(hours), (s + 1) % len(hours)]]
    rows = sorted(set(rows))
    want = brute(rows)
    close(scores(spark, roster(spark, rows)), want)
    if len(hours) < 10:
        monkeypatch.setattr(paths, "BROADCAST_EDGES", 0)
        monkeypatch.setattr(paths, "BATCH_ROWS", 60)
        monkeypatch.setattr(blockcut, "BLOCK_EDGES", 0)
        close(scores(spark, roster(spark, rows)), want)


def test_limbs(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(10 ** rng.randint(1, 50)), rng.randrange(10 ** rng.randint(1, 50))) for _ in range(60)] + [(lengths.LIMB - 1, 1), (lengths.LIMB**2 - 1, 1)]
    kind = "struct<l0: long, l1: long, l2: long>"
    df = spark.createDataFrame([(k, lengths.limbs(x, 3), lengths.limbs(y, 3)) for k, (x, y) in enumerate(pairs)], f"k int, x {kind}, y {kind}")
    for r in df.select("k", lengths.plus(F.col("x"), F.col("y"), 3).alias("sum"), (F.col("x") < F.col("y")).alias("less"), F.least("x", "y").alias("least")).collect():
        x, y = pairs[r["k"]]
        assert lengths.number(r["sum"]) == x + y and r["less"] == (x < y) and lengths.number(r["least"]) == min(x, y)


def test_very_unequal_lengths(spark):
    """Lengths 1 and 10**9 in one graph, by joins and by the kernel."""
    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(60)})
    e = spark.createDataFrame([(a, b, rng.choice([1, 1, 10**9])) for a, b in pairs], "a long, b long, length long").coalesce(1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(paths.frontier_paths(e, batch_rows=200)) == rows(paths.shortest_paths(e))


def test_declared_courses_and_strategy(spark):
    rows = roster(spark, [(s, 1, 1) for s in range(9)] + [(s, 2, 1) for s in range(5)] + [(0, 3, 1)])
    one = analysis.sweep(rows, budgets(spark, 6), betweenness=False).first()
    two = analysis.sweep(rows, budgets(spark, 6), betweenness=False, strategy="skip_fit", n_courses=10).first()
    assert (one.removed_cost, one.n_vertices) == (0, 12) and (two.removed_cost, two.n_vertices) == (6, 9 + 8)


def brute(rows):
    """All-pairs betweenness by Floyd-Warshall and path counting, normalised."""
    scale = math.lcm(*(h for *_, h in rows))
    vs = sorted({("s", s) for s, _, _ in rows} | {("c", c) for _, c, _ in rows})
    length = {}
    for s, c, h in rows:
        length["s", s, "c", c] = scale // h
        length["c", c, "s", s] = scale // h
    inf = scale * 10**6
    d = {(u, v): 0 if u == v else length.get((*u, *v), inf) for u in vs for v in vs}
    for k, u, v in itertools.product(vs, vs, vs):
        d[u, v] = min(d[u, v], d[u, k] + d[k, v])
    n_paths = {}
    for u in vs:
        for v in sorted(vs, key=lambda v: d[u, v]):
            n_paths[u, v] = 1 if u == v else sum(n_paths[u, w] for w in vs if (*w, *v) in length and d[u, w] + length[(*w, *v)] == d[u, v] < inf)
    n = len(vs)
    return {v: sum(n_paths[s, v] * n_paths[v, t] / n_paths[s, t] for s in vs for t in vs if len({s, v, t}) == 3 and d[s, t] < inf and d[s, v] + d[v, t] == d[s, t]) / ((n - 1) * (n - 2)) for v in vs}


@pytest.mark.parametrize("seed", range(3))
def test_contraction_changes_nothing(spark, seed):
    rng = random.Random(seed)
    rows = [(s, c, [1, 2, 3, 4][c % 4]) for s in range(1, 13) for c in rng.sample(range(1, 6), rng.choice([1, 1, 2, 2, 3]))]
    close(scores(spark, roster(spark, rows, grad={3, 4, 8})), brute(rows))


def test_mixed_fixture_values():
    want = brute(MIXED)
    assert abs(want["s", 1] - 2 / 5) < 1e-9 or abs(want["s", 2] - 2 / 5) < 1e-9
    assert sorted(round(x, 9) for x in want.values()) == [0, 0.1, 0.2, 0.3, 0.4, 0.4]


def test_edges_of_the_sweep(spark):
    rows = roster(spark, [(1, 1, 1), (2, 1, 1)])
    out = {r.threshold_id: r for r in analysis.sweep(rows, budgets(spark, 0, 100)).collect()}
    assert out[1].included == out[1].max_cc == out[1].max_bcc == 0 and out[1].max_bc == 0
    nothing = analysis.sweep(rows.limit(0), budgets(spark, 5)).collect()
    assert [(r.removed_cost, r.included, r.included_pct) for r in nothing] == [(0, 0, None)]


def test_shares_fall_with_the_budget(spark):
    rng = random.Random(9)
    rows = roster(spark, [(rng.randint(1, 80), int(rng.paretovariate(0.8)) % 40 + 1, 1) for _ in range(220)])
    costs = [0, 20, 60, 120]
    out = [r for r in sorted(analysis.sweep(rows, budgets(spark, *costs), betweenness=False).collect(), key=lambda r: r.threshold_id)]
    for a, b in itertools.pairwise(out):
        assert a.included >= b.included and a.max_cc >= b.max_cc and a.removed_cost <= b.removed_cost
    assert rows.agg(F.countDistinct("stid")).first()[0] >= out[0].included


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    """Merged students and vertices that no source reaches, by joins; the sweep with the limit lowered."""
    e = spark.createDataFrame([(0, 1, 1), (2, 1, 1), (2, 3, 1), (4, 3, 1), (6, 7, 1)], "a long, b long, length long").coalesce(1)
    classes = spark.createDataFrame([(0, 2, True), (1, 1, True), (2, 3, True), (3, 1, False), (4, 1, True), (6, 2, False), (7, 1, False)], "vid long, mult long, counted boolean").coalesce(1)
    near = {r.vid: r.score for r in paths.betweenness(e, classes).collect()}
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 0)
    far = {r.vid: r.score for r in paths.betweenness(e, classes).collect()}
    assert near[2] > 0 and far[7] == 0
    close(far, near)
    row = analysis.sweep(roster(spark, [(1, 1, 1), (2, 1, 1), (3, 9, 1)]), budgets(spark, 0)).first()
    assert row.max_cc == 2 and abs(row.max_bc - 2 / 12) < 1e-8


def test_nested_components(spark, monkeypatch):
    """One forest for all budgets against a copy of the graph per budget, and the sweep by either."""
    from affilia.operators import connectivity

    rng = random.Random(12)
    pairs = sorted({(rng.randint(1, 60), int(rng.paretovariate(0.9)) % 50 + 1) for _ in range(170)})
    rows = roster(spark, [(s, c, 1) for s, c in pairs])
    costs = budgets(spark, 0, 30, 31, 60, 90, 10**6)
    plain = sorted(map(tuple, analysis.sweep(rows, costs, betweenness=False).collect()))
    monkeypatch.setattr(analysis, "NESTED_EDGES", 0)
    assert sorted(map(tuple, analysis.sweep(rows, costs, betweenness=False).collect())) == plain
    assert len({r[5] for r in plain}) >= 4
    lives = [(2 * s, 2 * c + 1, rng.randint(0, 4)) for s, c in pairs]
    edges = spark.createDataFrame(lives, "a long, b long, alive long")
    for level, labels in enumerate(connectivity.nested_components(edges, 4)):
        want = connectivity.connected_components(edges.where(edges["alive"] > level), kernel_edges=10**6)
        assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, want.collect()))
