import hashlib
import random
from collections import Counter

import pytest

from affilia.llm import repeats

from .cases import frame


def brute(texts, length):
    """Per text the removed byte positions."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = set()
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone.update(range(s, s + length))
        out.append(gone)
    return data, out


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdé "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (39, 60, 200, 500)]
    rows = [None, "", "ab", make(30), "xy" * 300, "xyz" * 100 + make(20), make(5000)]
    for _ in range(60):
        t = make(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            t += s[a : a + rng.randint(20, 300)] + make(rng.randint(0, 90))
        rows.append(t)
    return rows + rows[10:14] + [make(rng.randint(0, 60)) + shared[2] + make(rng.randint(0, 60)) for _ in range(40)]


@pytest.mark.parametrize(("seed", "most"), [(1, 64), (2, 3)])
def test_matches_brute_force(spark, seed, most):
    rows = texts(seed)
    data, gone = brute(rows, 40)
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    got = {r.doc_id: r for r in repeats.repeated(docs, length=40, anchor=8, most=most).collect()}
    assert len(got) == len(rows)
    for i, (d, g) in enumerate(zip(data, gone)):
        r, spans = got[i], sum(1 for x in g if x - 1 not in g)
        kept = bytes(b for k, b in enumerate(d) if k not in g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), len(g), spans, hashlib.sha256(kept).hexdigest()), i
        assert {x for s in r.spans for x in range(s.start, s.stop)} == g


def test_repeated_rows_and_nulls(spark):
    docs = frame(spark, [(1, "q" * 500, None, None), (1, "q" * 500, None, None), (None, "word " * 200, None, None)])
    got = [(r.doc_id, r.n_removed, r.n_spans) for r in repeats.repeated(docs).collect()]
    assert sorted(got, key=str) == [(1, 500, 1), (1, 500, 1), (None, 1000, 1)]  # whatever the id, a text that repeats itself loses it
    assert repeats.repeated(docs.limit(0)).count() == 0
