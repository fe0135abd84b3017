import random

import numpy as np
import pytest

from affilia.operators import connectivity, contraction, graph, kernels, ordered, paths, removal
from affilia.operators.components import star_components

from .fixtures import GENERIC, edges, roster


def component_labels(pairs):
    label = {v: v for e in pairs for v in e}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("kernel_edges", [0, 1000])
def test_components(spark, kernel_edges):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000 + k) for k in range(1, 50)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = connectivity.connected_components(edges(spark, pairs), kernel_edges=kernel_edges).collect()
    assert {r.vid: r.comp_id for r in got} == component_labels(pairs) and len(got) == len(component_labels(pairs))


def test_components_of_nothing(spark):
    assert star_components(edges(spark, []).select("a", "b")).count() == 0
    assert connectivity.connected_components(edges(spark, [])).count() == 0


def test_generic_graph(spark):
    vertices = spark.range(19).withColumnRenamed("id", "vid")
    e = edges(spark, GENERIC)
    labels = connectivity.connected_components(e, vertices)
    assert {r.comp_id for r in labels.collect()} == {0, 1}
    found = connectivity.block_edges(e)
    blocks = {}
    for r in connectivity.block_members(found).collect():
        blocks.setdefault(r.block_id, set()).add(r.vid)
    assert sorted(map(sorted, blocks.values())) == [[1, 2], [2, 3, 4], [2, 5, 6, 7], [7, 8, 9, 10, 11], [8, 12, 13, 14, 15], [10, 16], [10, 17, 18]]
    assert "0-0" in {r.block_id for r in connectivity.block_members(found, vertices).collect()}
    members = connectivity.block_members(found)
    assert {r.vid: r.n_blocks for r in connectivity.cut_vertices(members).collect()} == {2: 3, 10: 3, 7: 2, 8: 2}
    forest = connectivity.block_cut_forest(members).collect()
    assert {r.leaf_count for r in forest} == {5} and {r.comp_vertices for r in forest} == {18}
    assert sum(r.cut_count for r in forest) == 10


def removed_components(pairs, gone):
    rest = [(a, b) for a, b in pairs if gone not in (a, b)]
    vs = {v for e in pairs for v in e} - {gone}
    label = component_labels(rest)
    return len({label.get(v, v) for v in vs})


def test_cut_vertices_by_removal(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = sorted({tuple(sorted((rng.randint(0, 25), rng.randint(0, 25)))) for _ in range(32)})
        pairs = [(a, b) for a, b in pairs if a != b]
        whole = len(set(component_labels(pairs).values()))
        want = {v for v in component_labels(pairs) if removed_components(pairs, v) > whole}
        got = connectivity.cut_vertices(connectivity.block_members(connectivity.block_edges(edges(spark, pairs)))).collect()
        assert {r.vid for r in got} == want


def test_paths_forms_agree(spark):
    rng = random.Random(6)
    pairs = sorted({(rng.randint(0, 9) * 2, rng.randint(0, 9) * 2 + 1) for _ in range(28)})
    e = spark.createDataFrame([(a, b, rng.choice([1, 2, 3])) for a, b in pairs], "a long, b long, length long")
    one = sorted(map(tuple, paths.shortest_paths(e).collect()))
    assert one == sorted(map(tuple, paths.shortest_paths(e, limit=0).collect()))
    vids = sorted({v for p in pairs for v in p})
    classes = spark.createDataFrame([(v, 1, True) for v in vids], "vid long, mult long, counted boolean")
    near = {r.vid: r.score for r in paths.betweenness(e, classes).collect()}
    far = {r.vid: r.score for r in paths.betweenness(e, classes, limit=0).collect()}
    assert all(abs(near[v] - far.get(v, 0)) < 1e-9 for v in near)


def test_generic_betweenness(spark):
    vids = range(1, 19)
    classes = spark.createDataFrame([(v, 1, True) for v in vids], "vid long, mult long, counted boolean")
    scores = {r.vid: r.score for r in paths.betweenness(edges(spark, GENERIC), classes).collect()}
    assert abs(scores[7] - 132) < 1e-9 and max(scores.values()) == scores[7]


def test_watching_the_search():
    seen = []
    kernels.blocks(5, np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), watch=lambda *event: seen.append(event))
    assert seen == [("root", 0, -1), ("tree", 1, 0), ("tree", 2, 2), ("back", 0, 1), ("left", 2, 2), ("left", 1, 0), ("left", 0, -1)]


def _scores_of_members(n, x, y, length, mult, counted):
    """Betweenness of every class by all shortest paths between its members, written out."""
    cls = np.repeat(np.arange(n), mult)
    size = len(cls)
    edge = np.full((size, size), np.inf)
    for a, b, far in zip(x, y, length):
        edge[np.ix_(cls == a, cls == b)] = far
        edge[np.ix_(cls == b, cls == a)] = far
    d = edge.copy()
    np.fill_diagonal(d, 0)
    for k in range(size):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    ways = np.eye(size)
    for s in range(size):
        for v in np.argsort(d[s], kind="stable"):
            if v != s and np.isfinite(d[s, v]):
                ways[s, v] = sum(ways[s, u] for u in range(size) if d[s, u] + edge[u, v] == d[s, v])
    out = np.zeros(n)
    for s in range(size):
        for t in range(size):
            if cls[s] != cls[t] and counted[cls[s]] and counted[cls[t]] and np.isfinite(d[s, t]):
                for v in range(size):
                    if v not in (s, t) and d[s, v] + d[v, t] == d[s, t]:
                        out[cls[v]] += ways[s, v] * ways[v, t] / ways[s, t]
    return out / mult


def test_folded_batches():
    """Trees, merged classes, uncounted vertices and mixed lengths, together and one by one."""
    rng = np.random.default_rng(4)
    for turn in range(40):
        n = int(rng.integers(2, 14))
        edges = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (int(rng.integers(1, 2 * n)), 2)) if a != b}) or [(0, 1)]
        x, y = map(np.array, zip(*edges))
        length = np.full(len(x), 3) if turn % 3 == 0 else rng.integers(1, 4, len(x)) if turn % 3 == 1 else rng.choice([1, 2, 90], len(x))
        mult, counted = rng.choice([1, 1, 2, 3], n), rng.random(n) < 0.8
        core, got = kernels.PathGraph(n, x, y, length, mult, np.where(counted, mult, 0)).folded()
        total = np.zeros(core.n)
        for run in core.batches(cells=40):
            core.add_batch(*run, total)
        got[core.kept] += total
        assert np.allclose(got / mult, _scores_of_members(n, x, y, length, mult, counted)), turn


def test_running_total(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v)) for i, v in enumerate(rng.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "id long, v long")
    got = ordered.running_total(df, [df["v"].desc(), df["id"]], df["v"], "t", 7).collect()
    total = 0
    for r in sorted(got, key=lambda r: (-r.v, r.id)):
        total += r.v
        assert r.t == total
    assert sorted(map(tuple, ordered.dense_codes(df, "v").collect())) == [(v, k) for k, v in enumerate(sorted({v for _, v in rows}))]


def test_removal_rules(spark):
    courses = spark.createDataFrame([(1, 9, 50), (2, 8, 40), (3, 8, 5), (4, 2, 7)], "crsid long, degree long, cost long")
    budgets = spark.createDataFrame([(0, 0), (1, 60), (2, 200)], "threshold_id int, max_cost long")
    prefix = {(r.threshold_id, r.crsid) for r in removal.prefix_removed(courses, budgets).collect()}
    assert prefix == {(1, 1)} | {(2, k) for k in range(1, 5)}
    skip = {(r.threshold_id, r.crsid) for r in removal.skip_fit_removed(courses, budgets).collect()}
    assert skip == {(1, 1), (1, 3)} | {(2, k) for k in range(1, 5)}
    for size in (1, 2):
        assert {(r.threshold_id, r.crsid) for r in removal.skip_fit_removed(courses, budgets, range_courses=size).collect()} == skip
    assert {tuple(r) for r in removal.removal_summary(removal.prefix_removed(courses, budgets), budgets).collect()} == {(0, 0, 0, 0), (1, 60, 1, 50), (2, 200, 4, 102)}


def test_repeats_count_for_cost_only(spark):
    rows = roster(spark, [(1, 1, 2), (1, 1, 2), (2, 1, 2)])
    assert [tuple(r) for r in graph.course_attributes(rows).collect()] == [(1, 2, 6, 3)]
    assert graph.memberships(rows).count() == 2


def test_structural_classes(spark):
    e = edges(spark, GENERIC).select("a", "b")
    vertices = spark.createDataFrame([(v, True, 1) for v in range(1, 19)], "vid long, in_src boolean, weight long")
    classes = contraction.compressed(e, vertices).collect()
    assert len(classes) == 16 and [(r.cid, r.mult) for r in classes if r.mult > 1] == [(12, 3)]
    assert {r.cid for r in contraction.compression_map(e, vertices).where("vid in (12, 14, 15)").collect()} == {12}


def test_skip_fit_by_ranges(spark):
    """Ranges of any size, ties, courses without a cost, budgets of nothing, null and everything, no courses."""
    rng = random.Random(8)
    rows = [(k, rng.randint(1, 30), rng.choice([None, 0, *range(1, 90)])) for k in range(400)]
    limits = {0: 0, 1: 50, 2: 1000, 3: 9000, 4: 10**9, 5: None}
    want = set()
    for t, limit in limits.items():
        for crsid, _, cost in sorted(rows, key=lambda r: (-r[1], r[0])):
            if limit is not None and (cost or 0) <= limit:
                limit -= cost or 0
                want.add((t, crsid))
    courses = spark.createDataFrame(rows, "crsid long, degree long, cost long")
    budgets = spark.createDataFrame(list(limits.items()), "threshold_id int, max_cost long")
    for size in (30, 1000):
        got = [tuple(r) for r in removal.skip_fit_removed(courses, budgets, range_courses=size).collect()]
        assert len(got) == len(want) and set(got) == want
    assert removal.skip_fit_removed(courses.limit(0), budgets).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_co_enrolment_in_blocks(spark, block):
    rng = random.Random(9)
    rows = {(s, 1) for s in range(40)} | {(rng.randint(0, 60), rng.randint(2, 9)) for _ in range(120)}
    by_course = {c: [s for s, x in rows if x == c] for c in range(1, 10)}
    want = {}
    for students in by_course.values():
        for one in students:
            for two in students:
                if one < two:
                    want[one, two] = want.get((one, two), 0) + 1
    got = graph.co_enrolment(spark.createDataFrame(sorted(rows), "stid long, crsid long"), block=block).collect()
    assert {(r.st1, r.st2): r.n_shared for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bits", [1, 64])
def test_equal_sets(spark, bits):
    """With hashes of one bit most classes start as collisions; nulls are alike, and so are vertices without items."""
    rng = random.Random(10)
    sets = {v: frozenset(rng.sample(range(4), rng.randint(0, 3))) for v in range(60)}
    key = {v: rng.choice([None, True, False]) for v in sets}
    least = {}
    for v in sorted(sets):
        least.setdefault((key[v], sets[v]), v)
    items = spark.createDataFrame([(v, x) for v in sets for x in sets[v]], "vid long, item long")
    got = contraction.equal_sets(items, spark.createDataFrame(list(key.items()), "vid long, grad boolean"), bits).collect()
    assert {(r.vid, r.grad, r.size, r.cid) for r in got} == {(v, key[v], len(sets[v]), least[key[v], sets[v]]) for v in sets} and len(got) == 60
    assert contraction.equal_sets(items.limit(0), spark.createDataFrame([], "vid long, grad boolean")).count() == 0
