"""Small tables with awkward rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, shard string, size long, target long, score string"


def frame(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    full = [(i, t, lang, source, None if t is None else len(t), "x", "y", 7, 8, "z") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps", "zeta", "éta", "theta"]) + str(rng.randint(0, 40)) for _ in range(n))


def awkward(seed=5):
    rng = random.Random(seed)
    base = words(rng, 150)
    rows = [(0, None, "en", None), (1, "", None, "b"), (2, base, "en", "a"), (3, base, "de", "a"), (3, base, "de", "a"), (4, base.upper(), "en", None), (5, "one", "en", "é"), (6, " \t\n ", None, ""), (7, "x" * 70_000, "en", "a"), (8, words(rng, 12_000), "en", "b")]
    for k in range(20, 60):
        changed = base.split()
        for _ in range(rng.randint(0, 5)):
            changed[rng.randrange(len(changed))] = "new" + str(rng.randint(0, 9))
        rows.append((k, " ".join(changed) if k % 3 else words(rng, rng.randint(1, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])))
    return rows
