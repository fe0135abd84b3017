import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affilia.llm import language, quality
from affilia.llm.ngrams import gram_counts

from .cases import frame

SETS = {"en": ["the", "ing", "tion", "wh"], "de": ["sch", "ung", "über", "ß"], "fr": ["eau", "é", "oi", "ç"]}


def text(rng, lang):
    return " ".join("".join(rng.choice(SETS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60)))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang := rng.choice(list(SETS))), lang, "a") for i in range(400)]
    rows += [(1000, None, "en", None), (1001, "", "de", None), (1002, "123 ... !", "en", None), (1003, text(rng, "fr") * 200, None, None), (5, rows[5][1], rows[5][2], "a"), (None, text(rng, "de"), "de", None)]
    return frame(spark, rows).cache()


def test_language(docs):
    model = language.fit(docs, train_rows=150)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect() if r.doc_id is not None and r.doc_id < 1000}
    held = [i for i in truth if got[i].held_out]
    assert held and np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und"] * 3 + ["fr", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_teach_nothing(docs):
    changed = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    one, two = language.fit(docs, train_rows=100), language.fit(changed, train_rows=100)
    assert one["names"] == two["names"] and (one["weights"] == two["weights"]).all()


def test_language_without_training_rows(docs):
    model = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    junk = lambda: " ".join(w + rng.choice(["###", "***", "!!"]) for w in text(rng, "en").split()) if rng.random() < 0.5 else "Same " * rng.randint(30, 300)
    rows = [(i, text(rng, "en") if i % 3 else junk(), "en", "a") for i in range(500)] + [(900, None, None, None), (901, "", None, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (7777, 0, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality.fit(docs, labels, train_rows=200)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [i for i in range(500) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = quality.rejected_removed(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_counts_dont_depend_on_neighbours():
    one = {row: (used.tolist(), n.tolist()) for row, used, n in gram_counts(["abc déf", None, "zz", "abc déf"])}
    two = {row: (used.tolist(), n.tolist()) for row, used, n in gram_counts(["abc déf"])}
    assert one[0] == one[3] == two[0] and one[1] == ([], [])


def test_texts_without_letters(docs):
    model = language.fit(docs, train_rows=100)
    odd = docs.sparkSession.createDataFrame([(1, "½ ² ① _ 12", None), (2, "ª", None), (3, "½ ß", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred == "und" for r in language.predict(odd, model).orderBy("doc_id").collect()] == [True, False, False]


def test_a_repeated_id_takes_one_place(spark, docs):
    """5000 rows of one id leave the sample to the others."""
    hot = docs.where("doc_id = 0").crossJoin(spark.range(5000).select()).select(docs.columns)
    model = language.fit(docs.union(hot), train_rows=50)
    assert model["names"] == ["de", "en", "fr"]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs.union(hot), labels, train_rows=50)["slope"] != 0


def test_ftrl_step_by_step():
    """The learner against the update rules written out for single numbers."""
    rng = np.random.default_rng(6)
    learner = language.FtrlSoftmax(5, 3, alpha=0.4, beta=1.0, l1=0.05, l2=0.1)
    z, n = [[0.0] * 3 for _ in range(5)], [[0.0] * 3 for _ in range(5)]
    for _ in range(60):
        used = np.sort(rng.choice(5, 3, replace=False))
        x, label = rng.random(3), int(rng.integers(0, 3))
        w = [[0.0 if abs(z[i][c]) <= 0.05 else -(z[i][c] - 0.05 * np.sign(z[i][c])) / ((1.0 + n[i][c] ** 0.5) / 0.4 + 0.1) for c in range(3)] for i in used]
        e = np.exp([sum(x[k] * w[k][c] for k in range(3)) for c in range(3)])
        for k, i in enumerate(used):
            for c in range(3):
                g = x[k] * (e[c] / e.sum() - (c == label))
                z[i][c] += g - ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / 0.4 * w[k][c]
                n[i][c] += g * g
        learner.step(used, x, label)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


def test_descent_reaches_the_least_loss():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(40, 6)), np.where(rng.random(40) < 0.5, 1.0, -1.0)
    w = quality.dual_coordinate_descent([(np.arange(6), v) for v in x], y, 6, cost=0.7, epochs=300)
    loss = lambda w: 0.5 * w @ w + 0.7 * (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    assert all(loss(w) <= loss(w + d) + 1e-9 for d in rng.normal(size=(300, 6)) * rng.choice([1e-3, 1e-2, 0.3], (300, 1)))


def test_quality_ties_and_long_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(i, 0, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)  # the smaller label holds: one class only
    assert len({r.score for r in quality.score(docs, model).collect()}) == 1
    model = quality.fit(docs, labels.limit(400))
    long = spark.createDataFrame([(1, "Ab " * 400_000), (1, "Ab " * 400_000), (2, None)], "doc_id long, text string")
    assert len({r.score for r in quality.score(long, model).collect()}) == 2
