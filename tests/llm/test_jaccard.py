import random
import re

import numpy as np
import pytest

from affilia.llm import jaccard

from .cases import awkward, frame, words


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        if rows[a][0] is not None:
            least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted(((i, len(s), None if i is None else least[find(k)] if s else i) for k, ((i, *_), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    rows, bases = awkward(seed), [words(rng, rng.choice([4, 9, 30, 80, 200])) for _ in range(8)]
    for i in range(100, 100 + n):
        w = rng.choice(bases).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 30)}"
        if rng.random() < 0.2:
            w = w[: rng.randint(1, len(w))]
        rows.append((i, " ".join(w), "en", "a"))
    return rows + [(None, bases[3], "en", "a")]


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (1, 50, 100, 3)])
def test_join(spark, k, num, den, seed):
    rows = corpus(seed)
    got = jaccard.join(frame(spark, rows), k, num, den).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, num, den)


@pytest.mark.parametrize("seed", [5, 6])
def test_crowded_regions(spark, monkeypatch, seed):
    """Cells, parts and both later passes, forced by small bounds."""
    for name, value in (("PART_ROWS", 7), ("REGION_ROWS", 12), ("PIVOTS", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(seed)
    rows = []
    for i in range(260):  # chains of small changes: most documents are too far from their pivot
        w = words(random.Random(i % 2), 60).split() if i < 40 or rng.random() < 0.1 else rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9)}"
        rows.append((i, " ".join(w), "en", "a"))
    got = jaccard.join(frame(spark, rows), 1, 80, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 1, 80, 100)


def test_cells_keep_links_together(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_ROWS", 10)
    rng = np.random.default_rng(5)
    bases = [rng.integers(1, 2**62, 60, dtype=np.uint64) for _ in range(6)]
    sets = []
    for k in range(240):
        s = bases[k % 6].copy()
        at = rng.integers(0, 60, rng.integers(0, 9))
        s[at] = rng.integers(1, 2**62, len(at), dtype=np.uint64)
        sets.append(np.unique(s))
    df = spark.createDataFrame([(1, 240, i, i, len(s)) for i, s in enumerate(sets)], "region long, n long, node long, comp long, size long")
    points = spark.createDataFrame([(i, bytearray(jaccard.bucket_counts(s))) for i, s in enumerate(sets)], "node long, counts binary")
    cells = {}
    split = jaccard._around_pivots(df).join(points, "node").groupBy("region", "part")
    for r in split.applyInArrow(jaccard._split(90, 100, rows=True), jaccard._CELL).collect():
        cells.setdefault(r.region, {})[r.node] = r.home
    sizes = split.applyInArrow(jaccard._split(90, 100, rows=False), "parent long, region long, n long").groupBy("region").sum("n").collect()
    assert {r.region: r[1] for r in sizes} == {k: len(c) for k, c in cells.items()}
    assert len(cells) > 5 and max(map(len, cells.values())) < 240
    assert sorted(n for c in cells.values() for n, home in c.items() if home) == list(range(240))
    for a in range(240):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                assert any(a in c and b in c and (c[a] or c[b]) for c in cells.values())


def test_bounds():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(1, 400, n, dtype=np.uint64)) for n in (1, 7, 90, 200)]
    counts = np.array([np.frombuffer(jaccard.bucket_counts(s), np.uint16) for s in sets])
    counts[3] = 65535  # more than can be counted
    sizes = np.array([len(s) for s in sets])
    bounds = jaccard.most_common(counts, sizes, counts, sizes)
    assert all(bounds[i, j] >= len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(4))


def test_many_repeated_rows(spark):
    base = words(random.Random(8), 80)
    near = base.split()
    near[3] = "other"
    docs = spark.range(5000).selectExpr("id % 50 as doc_id", f"'{base}' as text").union(spark.createDataFrame([(900, " ".join(near))], "doc_id long, text string"))
    got = jaccard.join(docs, 3, 90, 100).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id, r["count"]) for r in got} == {(i, 0, 100) for i in range(50)} | {(900, 0, 1)}


def test_keys_meet_whenever_sets_link():
    rng = np.random.default_rng(9)
    bitmap = np.zeros(1 << jaccard.SKETCH_BITS - 6, np.int64)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        num = int(rng.choice([50, 80, 90]))
        b = a[rng.random(len(a)) > rng.random() * 0.2]
        b = np.unique(np.concatenate([b, rng.integers(1, 2**63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= num * (len(a) + len(b) - both):
            for bits in (bitmap, ~bitmap, rng.integers(-(2**62), 2**62, len(bitmap))):
                assert len(np.intersect1d(jaccard.region_keys(a, bits, num, 100), jaccard.region_keys(b, bits, num, 100)))


def test_one_of_each(spark):
    rows = corpus(4)
    docs = frame(spark, rows)
    kept = jaccard.one_of_each(docs)
    want = {i for i, _, c in brute(rows, 5, 80, 100) if i is not None and i == c}
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert jaccard.join(docs.limit(0)).count() == 0
