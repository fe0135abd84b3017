"""Language identification of whole texts.

Sparse multinomial logistic regression on TF-IDF character n-grams (lengths 1
to 3, hashed), trained with follow-the-regularised-leader and elastic-net
penalties, then calibrated by one temperature.

Document frequencies cover all documents of the training folds. The weights
are fitted on at most ``TRAIN_ROWS`` doc_ids of them, the first in the order of a hash
of doc_id; a fifth of those only sets the temperature. Prediction is one
streaming pass without a shuffle; the model is a table of fixed size.

Defined results: a text that is null or has no letter is ``und`` with score 0;
repeated rows are predicted alike; a doc_id with several rows is fitted by one of
them (all are counted), null ids by none; an empty table gives no rows; without any
training row every text is ``und``; equal probabilities go by the smaller
name; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mapped, trim
from .ngrams import SLOTS, gram_counts

#: Most rows that the weights are fitted on.
TRAIN_ROWS = 4000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002
UNDETERMINED = "und"


class FtrlSoftmax:
    """Multinomial logistic regression, one proximal FTRL step per row."""

    def __init__(self, features: int, classes: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.maximum(np.abs(z) - self.l1, 0) * -np.sign(z)
        return shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, used: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(used)
        logits = values @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[used]
        self.z[used] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[used] = n + g * g


def tf_idf(used: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[used]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood."""
    def loss(t):
        scaled = logits / t
        top = scaled.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(scaled - top).sum(1)) + top[:, 0] - scaled[np.arange(len(labels)), labels]))

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 121))
    return float(min(grid, key=loss)) if len(labels) else 1.0


def _document_frequencies(batches):
    total = np.zeros(SLOTS, np.int64)
    rows = 0
    for batch in batches:
        for _, used, _ in gram_counts(batch.column(0).to_pylist()):
            total[used] += 1
            rows += 1
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1), pa.int32()), pa.array(np.append(total[slots], rows), pa.int64())], ["slot", "n"])


def _features(batches):
    for batch in batches:
        ids, langs, texts = (batch.column(i).to_pylist() for i in range(3))
        found = [(ids[row], langs[row], used.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()) for row, used, counts in gram_counts(texts)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["doc_id", "lang", "used", "counts"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> dict:
    """A model from the rows that aren't held out and have a lang: names, idf, weights, temperature."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    training = docs.where(~held_out() & F.col("lang").isNotNull())
    order = F.xxhash64("doc_id")
    chosen = training.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(train_rows)
    frequencies = dict(mapped(training.select("text"), _document_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False))
    rows_all = frequencies.pop(-1, 0)
    df = np.zeros(SLOTS)
    if frequencies:
        df[list(frequencies)] = list(frequencies.values())
    idf = np.log((1 + rows_all) / (1 + df)) + 1
    rows = mapped(training.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "lang", "text"), _features, "doc_id long, lang string, used binary, counts binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "used", "counts")).alias("_r")).select("doc_id", "_r.*").toArrow().to_pylist()  # one of each id's rows
    rows = sorted(rows, key=lambda r: (r["doc_id"] * 0x9E3779B1 & 0xFFFFFFFF, r["doc_id"]))
    names = sorted({r["lang"] for r in rows})
    data = []
    for r in rows:
        used, counts = np.frombuffer(r["used"], np.int32), np.frombuffer(r["counts"], np.int32)
        data.append((used, tf_idf(used, counts, idf), names.index(r["lang"])))
    learner, cut = FtrlSoftmax(SLOTS, len(names)), -(-len(data) * 4 // 5)
    for _ in range(epochs):
        for used, x, label in data[:cut]:
            learner.step(used, x, label)
    weights = learner.weights()
    rest = data[cut:]
    heat = temperature(np.array([x @ weights[used] for used, x, _ in rest]), np.array([y for *_, y in rest])) if rest else 1.0
    trim()
    return {"names": names, "idf": idf, "weights": weights.astype(np.float32), "temperature": heat}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names, idf, weights, heat = (held.value[k] for k in ("names", "idf", "weights", "temperature"))
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            known = [row for row, t in enumerate(texts) if names and t and any(map(str.isalpha, t))]
            for k, used, counts in gram_counts([texts[row] for row in known]):
                logits = tf_idf(used, counts, idf) @ weights[used] / heat
                best = int(np.argmax(logits))
                langs[known[k]], scores[known[k]] = names[best], 1 / np.exp(logits - logits[best]).sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")), run, "doc_id long, held_out boolean, lang_pred string, score double")
