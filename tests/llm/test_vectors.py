import numpy as np
import pytest

from affilia.llm import vectors


def brute(rows, cosine):
    usable = {k: np.array(v, float) for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {k: set() for k in range(len(rows))}
    for k, a in usable.items():
        for m, b in usable.items():
            if k != m and rows[k][2] == rows[m][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine - 1e-12:
                links[k].add(m)
    return links


@pytest.mark.parametrize("block_rows", [16, 512])
def test_links(spark, block_rows):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(60):
            c = rng.normal(size=32)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, (c * rng.uniform(0.5, 2) + rng.normal(size=32) * 0.08 * rng.random()).tolist(), label))
                i += 1
    rows += [(i + k, rows[0][1], 0) for k in range(30)] + [(5000, None, 0), (5001, [0.0] * 32, 0), (5002, rows[0][1], None), (5003, [float("nan")] * 32, 1), (5004, [1.0, 2.0], 0), (5005, [2.0, 4.0], 0), (5006, [None] * 32, 1), (None, rows[0][1], 0), (5007, [], 0)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, block_rows=block_rows).collect()}
    links = brute(rows, 0.98)
    assert len(got) == len(rows)
    total = sum(map(len, links.values()))
    assert 0.95 * total <= sum(r.n_links for r in got.values()) <= total
    for k, (a, _, _) in enumerate(rows):
        assert got[a].n_links <= len(links[k]) and got[a].kept == (got[a].component_id == a)
    assert got[5004].component_id == got[5005].component_id == 5004 and got[5004].n_links == 1
    assert [got[k].n_links for k in (5000, 5001, 5002, 5003, 5006, 5007, None)] == [0] * 7
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_calibration():
    half, need = vectors.calibrated(0.98)
    assert 0.3 < half < 0.5 and 5 <= need < vectors.PROJECTIONS
    assert vectors.table_layout(100, 0.98) == (0, 1) and vectors.table_layout(100_000, 0.98)[0] > 3
