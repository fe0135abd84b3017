"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, chunks, jaccard, language, mixing, packing, quality, repeats, resampling, secrets, sharding, topk, vectors
from .common import read


def op1_topk_search(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where(F.col("vec_id") % topk.QUERY_EVERY == 0))


def op2_best_fit_packing(spark, sf_dir):
    return packing.digest(packing.pack(read(spark, sf_dir, "documents")))


def op3_jump_sharding(spark, sf_dir):
    placed = sharding.shard(sharding.documents_digest(read(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs))


def op5_repeated_strings(spark, sf_dir):
    return repeats.repeated(read(spark, sf_dir, "documents")).drop("spans")


def op6_secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secrets.findings_per_document(docs, secrets.train(secrets.generated_findings(spark)))


def op7_vector_near_duplicates(spark, sf_dir):
    found = vectors.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op8_source_mixing(spark, sf_dir):
    rows = mixing.rates(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op10_jaccard_join(spark, sf_dir):
    return jaccard.join(read(spark, sf_dir, "documents"))


def op11_chunked_bpe(spark, sf_dir):
    return chunks.encoded(read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark, sf_dir):
    return alignment.align(read(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_topk_search": op1_topk_search,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_jump_sharding": op3_jump_sharding,
        "op4_language_id": op4_language_id,
        "op5_repeated_strings": op5_repeated_strings,
        "op6_secret_scan": op6_secret_scan,
        "op7_vector_near_duplicates": op7_vector_near_duplicates,
        "op8_source_mixing": op8_source_mixing,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_chunked_bpe": op11_chunked_bpe,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


OP1_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as u from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, x.vec_id, list_sum(list_transform(list_zip(q.u, x.u), lambda p: p[1] * p[2]))::bigint as score
      from v q join v x on x.vec_id <> q.vec_id and len(x.u) = len(q.u) where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""

OP8_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3)::int + 1]::bigint as w from s),
l as (select *, (sum(source_size) over () * 150)::bigint as mix,
        (sum(w) over () - coalesce(sum(w) over (order by source_size::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::bigint as open,
        coalesce(sum(source_size) over (order by source_size::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as full_before from w),
n as (select *, (mix - full_before * 200)::double / (open * 100)::double as level from l),
t as (select source, source_size, case when level * w >= (source_size * 2)::double then (source_size * 2)::double
        else max(case when level * w < (source_size * 2)::double then level end) over () * w end as target from n),
r as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when ('0x' || md5('mix-1:' || coalesce(doc_id::varchar, ''))[1:13])::bigint / 4503599627370496.0::double < rate - floor(rate) then 1 else 0 end))::bigint as taken
from r
"""


OP7_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e,
    embedding is not null and label is not null and vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok from embeddings),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and a.ok and b.ok and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
c(v, m) using key (v) as (select vec_id, vec_id from v
  union (select l.b, min(c.m) from c join l on c.v = l.a join recurring.c k on k.v = l.b where c.m < k.m group by l.b)),
n as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.m as component_id, c.m = v.vec_id as kept from v join c on c.v = v.vec_id left join n on n.a = v.vec_id
"""

OP10_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from d),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 90 * (x.n + y.n - common)),
c(v, m) using key (v) as (select doc_id, doc_id from d
  union (select l.b, min(c.m) from c join l on c.v = l.a join recurring.c k on k.v = l.b where c.m < k.m group by l.b))
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.m as component_id from d join c on c.v = d.doc_id left join n on n.doc_id = d.doc_id
"""

#: crc32 byte by byte: its table by the polynomial, then a fold over the bytes of each distinct feature.
OP12_SQL = r"""
with ct as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from range(256) r(i)),
w as (select 'd' as kind, doc_id, rowid_ as r, words from (select doc_id, row_number() over () as rowid_, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents)
  union all select 'b', null, null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
e as (select kind, r, words, unnest(range(1, len(words) + 1)) as i from w),
f as materialized (select kind, r, unnest(case when i + 2 <= len(words) then [words[i], words[i] || ' ' || words[i + 1], words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]]
  when i + 1 <= len(words) then [words[i], words[i] || ' ' || words[i + 1]] else [words[i]] end) as f from e),
n as (select kind, r, f, count(*) as n from f group by all),
x as materialized (select f, (xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda k: ('0x' || h[2 * k + 1 : 2 * k + 2])::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000)::int as bucket from (select f, hex(encode(f)) as h from n group by f), ct),
c as (select bucket, coalesce(sum(n) filter (where kind = 'd'), 0)::bigint as s, coalesce(sum(n) filter (where kind = 'b'), 0)::bigint as t from n join x using (f) group by bucket),
g as (select i::int as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from range(10000) r(i) left join c on c.bucket = i),
gg as (select bucket, floor(1000 * ln(((t + 1)::double * (sum(s) over () + 10000)::double) / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from g),
d as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from n join x using (f) join gg using (bucket) where kind = 'd' group by r),
z as (select doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296::double))))::bigint as score from w left join d using (r) where kind = 'd'),
k as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (where n_words >= 20) over () as able from z)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * able // 100 then place end as rank from k
"""


def oracle_sql():
    return {"op12_importance_resampling": OP12_SQL, "op1_topk_search": OP1_SQL, "op7_vector_near_duplicates": OP7_SQL, "op8_source_mixing": OP8_SQL, "op10_jaccard_join": OP10_SQL}
