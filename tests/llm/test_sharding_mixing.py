import hashlib
import zlib

from affilia.llm import mixing, sharding

from .cases import awkward, frame


def jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_slots_and_growth(spark):
    rows = awkward() + [(None, "n", None, None), (-5, "m", None, None), (2**62, "o", None, None)] + [(k, "t", "en", "a") for k in range(1000, 3000)]
    docs = sharding.documents_digest(frame(spark, rows))
    got = sharding.shard(docs, bucket_rows=100).collect()
    slots = {}
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        assert r.shard == jump(key, 8) and r.grown_shard == jump(key, 9) and r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want


def test_columns_of_any_name_survive(spark):
    df = frame(spark, awkward())
    assert sharding.shard(df.drop("shard")).columns == [*df.drop("shard").columns, "shard", "grown_shard", "slot"]
    assert sharding.shard(df.limit(0)).count() == 0
    assert mixing.mix(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0


def fill(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in stopped]
        if not rest:
            return stopped
        level = (total - sum(stopped.values())) / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > 2 * sizes[s]]
        if not over:
            return stopped | {s: level * w[s] for s in rest}
        stopped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = awkward() + [(k, "w " * (k % 7), "en", f"s{k % 5}") for k in range(5000, 5400)]
    got = mixing.rates(frame(spark, rows).select("doc_id", "source", "text")).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, source = fill(sizes), {i: s for i, _, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        u = int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.copies == int(rate) + (u < rate - int(rate)) <= 2
    assert mixing.mix(frame(spark, rows)).count() == sum(r.copies for r in got)
