"""Importance resampling against its SQL and a plain form."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb

from affilia.llm import resampling
from affilia.llm.queries import OP12_SQL, op12_importance_resampling

SF = "/root/testdata/sf0.001"


def brute(docs, target, share=resampling.SHARE, least=resampling.LEAST_WORDS):
    """(doc_id, n_features, weight, score, rank) sorted."""

    def buckets(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % resampling.BUCKETS for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    found = [buckets(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in buckets(x)[1])
    big_s, big_t, n = sum(s.values()), sum(t.values()), resampling.BUCKETS
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (big_s + n)) / ((s[b] + 1) * (big_t + n)))) for b in range(n)]
    rows = []
    for (doc_id, _), (words, f) in zip(docs, found):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((doc_id, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[2], r[3]))
    drawn = len(able) * share // 100
    ranked = [(r[0], *r[2:], k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(r[0], *r[2:], None) for r in rows if r[1] < least]
    return sorted(ranked, key=str)


def test_query(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    found = sorted(map(tuple, op12_importance_resampling(spark, SF).select(*columns).collect()), key=str)
    assert found == sorted(duck.sql(f"select {', '.join(columns)} from ({OP12_SQL})").fetchall(), key=str)
    assert found == brute(duck.sql("select doc_id, text from documents").fetchall(), [r[0] for r in duck.sql("select text from benchmark").fetchall()])


def test_edges(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    texts = [None, "", "  ", "One", "one two", "ONE two\x00three", "Straße É 東京 x9", "w " * 3000, *["a b c d e f g h i j k l m n o p q r s t u v w"] * 4]
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts)] + [(8, texts[8]), (9, "z " * 30)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, bucket int, words string").repartition(3)
    target = spark.createDataFrame([("A b c",), (None,), ("",)], "text string")
    assert sorted(map(tuple, resampling.resample(docs, target, share=50).collect()), key=str) == brute(rows, ["A b c"], share=50)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, resampling.resample(one, none).collect())) == brute([(1, "a b")], [])
