"""Chunked encoding against the tokenizer on whole texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from affilia.llm import chunks, packing
from affilia.llm.common import read
from affilia.llm.queries import op11_chunked_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def whole(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


def odd_texts():
    """Texts from a small set of passages, so that chunks repeat, with odd characters and long runs between."""
    rng = random.Random(5)
    words = ["it's", "Straße", "don't", "2024", "…", "é", "́x", "<|endoftext|>", "x<|startoftext|>y", "東京", "a b", "\x85", "İstanbul", "ﬁn", "K", "​", "!!", "naïve", "we'll", "I'", "　"]
    passages = [" ".join(rng.choice(words) if rng.random() < 0.3 else "".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(90)) for _ in range(12)]
    texts = ["".join(rng.choice(["", " ", "\n\n", "x", "  "]) + rng.choice(passages)[rng.randint(0, 40) :] for _ in range(rng.randint(1, 6))) for _ in range(150)]
    return texts + ["", None, " ", "\n\t ", "x" * 30_000, "y " * 20_000, "ab" * 5000 + " " + passages[0], "́" * 3000, passages[0], passages[0], "<|endoftext|>" * 300]


def test_odd_texts(spark, tokenizer):
    texts = odd_texts()
    docs = spark.createDataFrame([(k if k % 7 else None, t, "x", 3) for k, t in enumerate(texts)], "doc_id long, text string, k1 string, pos int").repartition(5)
    found = chunks.encoded(docs).collect()
    want = sorted((k if k % 7 else -1, *whole(tokenizer, t)) for k, t in enumerate(texts))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found) == want


def test_another_vocabulary(spark):
    """One that prepares texts in its own way is followed by windows and whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for t in odd_texts() if t is None or len(t) < 10_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    other = Tokenizer.from_file(path)
    assert sorted(map(tuple, chunks.encoded(docs, path).collect())) == [(k, *whole(other, t)) for k, t in enumerate(texts)]
    assert not packing.by_words(other)


def test_query(spark, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").select("doc_id", "text").collect()}
    found = op11_chunked_bpe(spark, SF).collect()
    assert len(found) == len(docs)
    assert all(tuple(r[1:]) == whole(tokenizer, docs[r["doc_id"]]) for r in found)


def test_windows_that_do_not_agree(spark, tokenizer, monkeypatch):
    """Then the text is encoded as a whole."""
    monkeypatch.setattr(chunks, "_join_sorted", lambda path: lambda batches: chunks._batches(((*r, None, None, None) for r in {tuple(r.values()) for b in batches for r in b.select(["k1", "k2"]).to_pylist()}), [chunks.pa.int64(), chunks.pa.int64(), *chunks._DIGEST_KINDS], ["k1", "k2", "n_tokens", "ids_sha256", "decoded_sha256"]))
    docs = read(spark, SF, "documents").select("doc_id", "text").limit(40)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(tuple(r[1:]) == whole(tokenizer, texts[r["doc_id"]]) for r in chunks.encoded(docs).collect())


def test_passages_are_cut_alike():
    """A shared passage has the same chunks wherever it stands, after its first cut."""
    rng = random.Random(1)
    passage = bytes(rng.choices(b"abcdefghij klmnop", k=6000))
    texts = [bytes(rng.choices(b"qrstuv ", k=n)) + passage for n in (0, 1, 700, 5001)]
    pieces = [{t[a:b] for a, b in zip([0, *e], e)} for t, e in zip(texts, chunks.cuts(texts))]
    assert all(len(pieces[0] & p) >= len(pieces[0]) - 4 for p in pieces)
    assert all(b"".join(t[a:b] for a, b in zip([0, *e], e)) == t for t, e in zip(texts, chunks.cuts(texts)))
    assert list(chunks.cuts([b"", b"a"])) == [[], [1]]


def test_each_repeated_chunk_is_encoded_once(spark):
    """A passage that a hundred texts of ten partitions share goes through one task."""
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefghij klmnop", k=4000))
    docs = spark.createDataFrame([(k, f"{k} {passage}") for k in range(100)], "doc_id long, text string").repartition(10)
    counts = chunks.mapped(docs.select("text"), chunks._hash_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    words = spark.sparkContext.broadcast(chunks.bitmaps.build(counts.select("h")))
    sent = chunks.mapped(docs.select("text"), chunks._repeated(words), "c1 long, c2 long, chunk binary").repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    made = chunks.mapped(sent, chunks._encode_sorted(None), f"c1 long, c2 long, {chunks.PART}")
    assert made.count() == made.select("c1", "c2").distinct().count() > 5
    assert sent.count() <= 10 * made.count()


def test_empty(spark):
    assert chunks.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
