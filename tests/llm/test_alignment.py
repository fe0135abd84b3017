"""Alignment of two tokenizers against a plain count over all links."""

import hashlib
from collections import Counter

import pytest

from affilia.llm import alignment
from affilia.llm.common import read
from affilia.llm.queries import op13_tokenizer_alignment

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), chars


def brute(encoders, texts):
    """The contract, token by token."""
    a, b, chars = encoders
    names = {k: bytes(chars[c] for c in w) for w, k in a.get_vocab(with_added_tokens=False).items() if all(c in chars for c in w)}
    docs = []
    for text in texts:
        xs = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ys = b.encode(text) if text else []
        pieces = [b.id_to_piece(y) for y in ys]
        bytes_of = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(names[x] for x in xs) != whole or b"".join(bytes_of) != whole:
            docs.append(None)
            continue
        at = lambda sizes: [sum(sizes[: k + 1]) for k in range(len(sizes))]
        if len(xs) > 3000:
            import numpy as np

            at = lambda sizes: np.cumsum(sizes).tolist()
        ends_a, ends_b = at([len(names[x]) for x in xs]), at([len(y) for y in bytes_of])
        where_b = {e: k for k, e in enumerate(ends_b)}
        links = [(xs[k], ys[where_b[e]]) for k, e in enumerate(ends_a) if e in where_b]
        cuts = [e for e in ends_a if e in where_b]
        groups, before = [], 0
        ia = ib = 0
        for cut in cuts:
            ga, gb = [], []
            while ia < len(xs) and ends_a[ia] <= cut:
                ga.append(xs[ia])
                ia += 1
            while ib < len(ys) and ends_b[ib] <= cut:
                gb.append(ys[ib])
                ib += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        docs.append((len(xs), len(ys), links, ";".join(groups)))
    counts = Counter(link for d in docs if d for link in d[2])
    most = {}
    for (x, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[2]), sum(counts[link] == most[link[1]] for link in d[2]), sum(counts[link] for link in d[2]), hashlib.sha256(d[3].encode()).hexdigest())
        for d in docs
    ]


ODD = ["It's 12,345 o'clock …", "<|endoftext|> and <s> </s> <unk> <0x41>", "東京 Straße naïve", "tab\tnew\n\n line  two   spaces ", " lead", "▁ block", "é   \x85 \x00 x", "x" * 9000, "\n" * 5000, "日本語" * 900, "don't we'll I'M", "﻿bom", "👩‍👩‍👧 family", None, "", "a", "the the the", "the the the"]


def check(spark, encoders, texts, **options):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, block string, row int").repartition(4)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, **options).collect()}
    want = brute(encoders, texts)
    assert [found[k] for k in range(len(texts))] == want


def test_odd_texts(spark, encoders):
    check(spark, encoders, ODD)


def test_query_and_parts(spark, encoders, monkeypatch):
    """The whole smallest table; the second time in many blocks, whose frequent ids are dealt into parts."""
    docs = read(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute(encoders, [r["text"] for r in docs])))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op13_tokenizer_alignment(spark, SF).collect()} == want
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 3)
    monkeypatch.setattr(alignment, "BUFFER", 100)
    found = alignment.align(read(spark, SF, "documents"), part_blocks=2).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found} == want


def test_repeated_rows_and_many_of_one_pair(spark, encoders):
    """Multiplicities beyond 16 bits are split, and rows with one id count each."""
    texts = ["the " * 70_000, "the cat", "the cat"]
    check(spark, encoders, texts)
    rows = alignment.align(spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "a cat")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in rows) == [(0, 2, 4), (1, 2, 5), (1, 2, 5)]


def test_fast_encoder_is_the_vocabulary_s(encoders):
    import random

    rng, tool = random.Random(3), alignment.aligner()
    alphabet = [chr(c) for c in range(0x250)] + list(" \n\t'") * 40 + list("abcdefstvmrl0123") * 20
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 60)))
        assert tool.a.encode(text) == encoders[0].encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
