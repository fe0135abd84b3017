"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Indicators of character n-grams (lengths 1 to 3, case kept, hashed) and of
repeated words are scaled by their class log-count ratios; a linear hinge-loss
model is fitted on them by dual coordinate descent, interpolated towards the
mean ratio as usual, and its margin is mapped to a probability.

The class counts behind the ratios cover all labelled rows. The weights are
fitted on at most ``TRAIN_ROWS`` labelled documents, the first in the order of a
hash of doc_id; every fifth of them only sets the map to a probability. Texts are
never shuffled: what moves are the indicators of labelled rows. Scoring is one
streaming pass.

Defined results: null texts count as empty and get the score of no n-grams;
repeated rows score alike; a doc_id with several labels has the smallest, and
one with several texts is fitted by one of them (all are counted); null
labels teach nothing; without both classes every score is the share of label 1
(0.5 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bitmaps
from .common import cut, held_out, mapped, trim
from .ngrams import SLOTS, gram_counts, word_hashes

#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 8000
EPOCHS = 12
COST = 1.0
INTERPOLATION = 0.9
#: Word repeats at distances 1 to LAGS give an indicator for each doubling of their share.
LAGS, LEVELS = 6, 6
FEATURES = SLOTS + LAGS * LEVELS


def indicators(texts):
    """The features that each text has, as sorted slots."""
    texts = [t or "" for t in texts]
    for row, used, _ in gram_counts(texts):
        words, _ = word_hashes([texts[row].encode("utf-8", "surrogatepass")])
        more = []
        for lag in range(1, LAGS + 1):
            if len(words) > lag:
                share = float(np.mean(words[lag:] == words[:-lag]))
                if share > 0:
                    level = int(min(LEVELS - 1, max(0, LEVELS + np.floor(np.log2(share)))))
                    more.append(SLOTS + (lag - 1) * LEVELS + level)
        yield row, np.concatenate([used, np.array(more, used.dtype)]) if more else used


class _Scaled:
    """Rows of slots (uint16 bytes) as (slots, scaled indicators), made when they are asked for."""

    def __init__(self, used: list[bytes], ratio: np.ndarray):
        self.used, self.ratio = used, ratio

    def __len__(self):
        return len(self.used)

    def __getitem__(self, k: int):
        slots = np.frombuffer(self.used[k], np.uint16).astype(np.int64)
        return np.append(slots, FEATURES), np.append(self.ratio[slots] / np.sqrt(max(1, len(slots))), 1.0)

    def __iter__(self):
        return (self[k] for k in range(len(self)))


def dual_coordinate_descent(rows, labels, features: int, cost: float = COST, epochs: int = EPOCHS, seed: int = 1):
    """Weights of the L2-regularised squared-hinge model; rows: (slots, values), labels: +1 or -1."""
    w, alpha = np.zeros(features), np.zeros(len(rows))
    norms = np.array([v @ v for _, v in rows]) + 0.5 / cost
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slots, values = rows[i]
            gradient = labels[i] * (w[slots] @ values) - 1 + alpha[i] * 0.5 / cost
            changed = max(alpha[i] - gradient / norms[i], 0.0)
            if changed != alpha[i]:
                w[slots] += (changed - alpha[i]) * labels[i] * values
                alpha[i] = changed
    return w


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic map from margins to labels (smoothed), by Newton steps."""
    y = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(p - y) @ margins + 1e-3 * a, (p - y).sum()])
        s = p * (1 - p) + 1e-6
        h = np.array([[s @ margins**2 + 1e-3, s @ margins], [s @ margins, s.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _features(labelled):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bitmaps.has(labelled.value, batch.column(0).to_numpy())))
            ids = batch.column(0).to_pylist()
            found = [(ids[row], used.astype(np.uint16).tobytes()) for row, used in indicators(batch.column(1).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.binary()))], ["doc_id", "used"])

    return run


def _class_counts(batches):
    """(label, slot, n) of one partition; slot -1 counts rows."""
    seen, rows = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for label, used in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen[label][np.frombuffer(used.as_py(), np.uint16)] += 1
            rows[label] += 1
    for label in (0, 1):
        slots = np.flatnonzero(seen[label])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots) + 1, label), pa.int32()), pa.array(np.append(slots, -1), pa.int32()), pa.array(np.append(seen[label][slots], rows[label]))], ["quality", "slot", "n"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """A model from the labelled rows of the folds that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = docs.sparkSession.sparkContext.broadcast(bitmaps.build(known.select("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    rows = cut(mapped(texts, _features(labelled), "doc_id long, used binary").join(known, "doc_id"))

    seen, total = np.zeros((2, FEATURES)), np.zeros(2)
    counts = mapped(rows.select("quality", "used"), _class_counts, "quality int, slot int, n long").groupBy("quality", "slot").agg(F.sum("n").alias("n")).toArrow()
    label, slot, n = (counts.column(c).to_numpy() for c in ("quality", "slot", "n"))
    seen[label[slot >= 0], slot[slot >= 0]], total[label[slot < 0]] = n[slot >= 0], n[slot < 0]
    if not total.all():
        return {"weights": np.zeros(FEATURES, np.float32), "bias": 0.0, "slope": 0.0, "offset": float(np.log((total[1] + 0.5) / (total[0] + 0.5)))}
    ratio = np.log((seen[1] + 1) / (total[1] + 2)) - np.log((seen[0] + 1) / (total[0] + 2))

    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("used").alias("used"))
    sample = sample.select("used", "quality").toArrow()
    sample = sorted(zip(sample.column("used").to_pylist(), sample.column("quality").to_pylist()))
    y, found = np.array([label for _, label in sample]), [used for used, _ in sample]
    fitted = np.arange(len(y)) % 5 > 0
    if len(set(y[fitted])) < 2 or len(set(y[~fitted])) < 2:
        fitted[:] = True
    scaled = _Scaled([used for used, use in zip(found, fitted) if use], ratio)
    w = dual_coordinate_descent(scaled, np.where(y[fitted] == 1, 1.0, -1.0), FEATURES + 1)
    mean = np.abs(w[:FEATURES]).mean()
    mixed = (1 - INTERPOLATION) * mean + INTERPOLATION * w[:FEATURES]
    model = {"weights": (mixed * ratio).astype(np.float32), "bias": float(w[FEATURES])}
    rest = fitted if fitted.all() else ~fitted
    slope, offset = _platt(np.array([_margin(np.frombuffer(s, np.uint16), model) for s, use in zip(found, rest) if use]), y[rest])
    del sample, found, scaled
    trim()
    return model | {"slope": slope, "offset": offset}


def _margin(slots: np.ndarray, model: dict) -> float:
    return float(model["weights"][slots].sum()) / np.sqrt(max(1, len(slots))) + model["bias"]


def score(docs: DataFrame, model: dict, keep: str = "") -> DataFrame:
    """docs' doc_id, held_out, score, predicted; with ``keep`` also that column."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts, scores = batch.column(2).to_pylist(), np.zeros(batch.num_rows)
            for row, slots in indicators(texts):
                scores[row] = held.value["slope"] * _margin(slots, held.value) + held.value["offset"]
            scores = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))] + ([batch.column(3)] if keep else []), ["doc_id", "held_out", "score", "predicted"] + ([keep] if keep else []))

    extra = [F.col(keep)] if keep else []
    schema = StructType.fromDDL("doc_id long, held_out boolean, score double, predicted int")
    if keep:
        schema = schema.add(keep, docs.schema[keep].dataType)
    return mapped(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"), *extra), run, schema)


def rejected_removed(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rows predicted 0, all columns kept."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return score(rows, model, keep="_doc").where("predicted = 1").select("_doc.*")
