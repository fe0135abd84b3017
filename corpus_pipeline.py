"""A corpus pipeline of five stages; each is written and read again by the next.

Every stage works on all rows that its predecessor kept, and all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid


from affilia.llm import jaccard, mixing, packing, quality, secrets
from affilia.llm.common import ensure_checkpoint_dir, read


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go; it learns from all labelled rows of the training folds."""
    return quality.rejected_removed(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def jaccard_join(spark, docs, sf_dir):
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, words=5, num=80, den=100)


def secret_scan(spark, docs, sf_dir):
    """Secrets are replaced in the text; the documents stay."""
    return secrets.redact(docs, secrets.train(secrets.generated_findings(spark)))


def source_mixing(spark, docs, sf_dir):
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.mix(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Every taken document as pieces placed in sequences of 4096 tokens."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]
#: Classifiers and tokenizers can't be put into SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage, each stage written as Parquet in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
