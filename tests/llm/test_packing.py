import random

import public_tokenizers
from tokenizers import Tokenizer

from affilia.llm import packing

from .cases import awkward, frame

ODD = ["it's I'll DON'T café £5 ½ ² x²y _a_ İstanbul ΣΑΣ 東京 á", "a<|endoftext|>b", "$$$ ABC's\x1cfoo\xa0bar", "'S 's"]


def test_word_cache_is_the_tokenizer():
    t, cache = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), packing.word_cache()
    for text in ODD + [r[1] or "" for r in awkward()]:
        assert cache.encode(text) == b"".join(i.to_bytes(4, "little") for i in t.encode(text, add_special_tokens=False).ids)


def test_pack_places_every_token_once(spark):
    rows = awkward()
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    pieces = packing.pack(frame(spark, rows), capacity=256, open_bins=4).collect()
    want = sorted((i, tuple(t.encode(x or "", add_special_tokens=False).ids) + (1,)) for i, x, *_ in rows)
    docs, bins = {}, {}
    for p in pieces:
        ids = [int.from_bytes(p.ids[k : k + 4], "little") for k in range(0, len(p.ids), 4)]
        assert len(ids) == p.length <= 256 and p.start == 256 * p.piece
        docs.setdefault(p.doc_id, []).append((p.piece, ids))
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    got = []
    for i, parts in docs.items():
        parts.sort()
        joined, n = [x for _, ids in parts for x in ids], sum(1 for r in rows if r[0] == i)
        got += [(i, tuple(joined))] if n == 1 else [(i, w) for j, w in want if j == i and len(joined) == n * len(w)]
    assert sorted(got) == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.2 * sum(p.length for p in pieces) / 256 + 8 * 4


def test_best_fit_and_fullest_closes():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    bins.place(9), bins.place(8)  # three would be open: the one with 9 closes
    assert bins.place(1) == (3, 8)


def test_empty(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_ids_of_random_strings():
    """Every character below U+0250, with others mixed in, and the capitals whose lower cases lie beyond."""
    from struct import pack as as_bytes

    rng = random.Random(11)
    cache = packing.word_cache()
    low = [chr(c) for c in range(1, 0x250)]
    mixed = low + [chr(rng.randrange(0x250, 0x3000)) for _ in range(60)] + list("ΣςÅẞſK漢字あ")
    texts = ["AZƏRBAYCAN-BAKI", "BAKI (AZƏRBAYCAN)", '"ƏSAS"', "mixed ДВА three 漢字 " * 3000]
    for k in range(4000):
        letters = low if k % 3 else mixed
        texts.append("".join(rng.choice(letters) if rng.random() < 0.7 else rng.choice("abcdefghij '-.,0123\n\t") for _ in range(rng.randint(1, 40))))
    for text in texts:
        ids = cache.tokenizer.encode(text, add_special_tokens=False).ids
        assert cache.encode(text) == as_bytes(f"<{len(ids)}I", *ids), text[:80]
