"""Exact top-k search by inner product: columnar branch and bound.

Vectors are quantised to integers, so scores are exact. Queries are dealt in
blocks against blocks of rows (fragment and replicate), each pair of blocks
being one bounded group. The first block of rows gives every query a floor: its
k-th score so far. Inside a group the rows lie in vertical layout: dimension
block by dimension block, scores are accumulated; the mass (norm) of what
remains bounds every score from above by Cauchy-Schwarz, and once few pairs
reach their floor they are compacted, after each further block again. Floors
rise from chunk to chunk of rows. Each group gives its k best per query, and a
final ranking merges the groups.

On vectors without structure the mass bound tells little before most dimensions
are in; on clustered ones it removes most pairs early.

Defined results: vectors that are null or hold a null or non-finite component
take no part, neither do rows with a null id; vectors are compared with those
of their own dimension only; equal scores go by the smaller vec_id; a row is
not a candidate for its own id; repeated rows (the same id) are one candidate
each; an id with several query vectors has one ranking over all of them; an
empty table gives no rows; other columns are ignored. Scores are exact in whole
numbers for components of any size; a component or score beyond 64 bits is
given as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Rows and queries of one group, about; a group's working set is their product.
ROW_BLOCK = 8192
QUERY_BLOCK = 4096
#: Rows that are scored at once, and dimensions between two tests of the bounds.
CHUNK, DIMENSION_BLOCK = 512, 8
#: Pairs are compacted once fewer than this share of them survives; before, dense columns are faster.
COMPACT_SHARE = 0.3


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, units: the usable vectors as integers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    usable = x.isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return embeddings.where(usable & (F.size(x) > 0)).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("units"))


def best_of_block(query_ids, queries, row_ids, rows, k: int, floors=None, step: int = DIMENSION_BLOCK, work: dict | None = None):
    """(query position, row position, score) of the k best rows of each query, of those that reach its floor.

    Rows come chunk by chunk; the k-th score of the chunks so far is the floor of
    the next. ``work`` counts cells (query, row, dimension) in all and computed.
    """
    dims = rows.shape[1]
    energy = np.argsort(-(np.abs(queries).sum(0) * np.abs(rows).sum(0)), kind="stable")
    queries, rows = queries[:, energy], rows[:, energy]
    edges = list(range(0, dims, step)) + [dims]
    remaining = lambda x: np.sqrt(np.maximum(0, np.cumsum((x**2)[:, ::-1], 1)[:, ::-1]))
    rest_q, rest_r = remaining(queries), remaining(rows)
    columns = np.ascontiguousarray(rows.T)
    floors = np.full(len(queries), -np.inf) if floors is None else floors.astype(float)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for first in range(0, len(rows), CHUNK):
        chunk = slice(first, min(first + CHUNK, len(rows)))
        scores = np.zeros((len(queries), chunk.stop - first))
        qi = ri = None  # the surviving pairs once they are compacted
        for at, to in zip(edges[:-1], edges[1:]):
            if qi is None:
                scores += queries[:, at:to] @ columns[at:to, chunk]
                done = scores.size
            else:
                for s in range(0, len(qi), 1 << 18):
                    part = slice(s, s + (1 << 18))
                    scores[part] += np.einsum("ij,ij->i", queries[qi[part], at:to], rows[ri[part], at:to])
                done = len(qi)
            if work is not None:
                work["all"] = work.get("all", 0) + len(queries) * (chunk.stop - first) * (to - at)
                work["computed"] = work.get("computed", 0) + done * (to - at)
            if qi is None:
                slack = np.outer(rest_q[:, to], rest_r[chunk, to]) * (1 + 1e-9) + 1e-6 if to < dims else 0
                alive = scores + slack >= floors[:, None]
                if to == dims or alive.mean() < COMPACT_SHARE:
                    qi, ri = np.nonzero(alive)
                    scores = scores[qi, ri]
                    ri += first
            else:
                slack = rest_q[qi, to] * rest_r[ri, to] * (1 + 1e-9) + 1e-6 if to < dims else 0
                alive = scores + slack >= floors[qi]
                qi, ri, scores = qi[alive], ri[alive], scores[alive]
        other = query_ids[qi] != row_ids[ri]
        qi, ri, scores = (np.concatenate([old, new[other]]) for old, new in zip(best, (qi, ri, scores)))
        order = np.lexsort((row_ids[ri], -scores, qi))
        qi, ri, scores = qi[order], ri[order], scores[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = [x[place < k] for x in (qi, ri, scores)]
        last = place == k - 1
        floors[qi[last]] = np.maximum(floors[qi[last]], scores[last])
    return best


def _exactly(query_ids, queries, row_ids, rows, k: int):
    """As best_of_block, in whole numbers of any size; scores are cut off at 64 bits before they are ranked."""
    found, least, most = [], -(2**63), 2**63 - 1
    for q, u in enumerate(queries.tolist()):
        scores = [max(least, min(most, sum(map(int.__mul__, u, v)))) for v in rows.tolist()]
        ranked = sorted((-s, i, r) for r, (s, i) in enumerate(zip(scores, row_ids.tolist())) if i != query_ids[q])
        found += [(q, r, -s) for s, _, r in ranked[:k]]
    return tuple(np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _search_group(k: int):
    def matrix(table):
        flat = table.column("units").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)

    def run(queries, rows):
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        query_ids, q = matrix(queries)
        row_ids, r = matrix(rows)
        most = max(1, int(np.abs(q.astype(float)).max(initial=0))) * max(1, int(np.abs(r.astype(float)).max(initial=0))) * q.shape[1]
        if most < 1 << 52:
            floors = queries.column("floor").to_numpy(zero_copy_only=False).astype(float)
            qi, ri, scores = best_of_block(query_ids, q.astype(float), row_ids, r.astype(float), k, np.where(np.isnan(floors), -np.inf, floors))
            scores = np.rint(scores).astype(np.int64)
        else:
            qi, ri, scores = _exactly(query_ids, q, row_ids, r, k)
        return pa.table({"query_id": query_ids[qi], "vec_id": row_ids[ri], "score": scores})

    return run


def search(embeddings: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest score for every query vector."""
    found = "query_id long, vec_id long, score long"
    rows, asked = quantised(embeddings, scale).withColumn("d", F.size("units")), quantised(queries, scale).distinct().withColumn("d", F.size("units"))
    row_blocks = max(1, -(-embeddings.count() // row_block))
    query_blocks = max(1, -(-asked.count() // query_block))
    rows = rows.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int"))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(query_blocks)).cast("int"))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def meet(asked, rows):
        keys = ("r", "q", "d")
        return asked.groupBy(*keys).cogroup(rows.withColumn("q", everywhere(query_blocks)).groupBy(*keys)).applyInArrow(_search_group(k), found)

    # the first block of rows gives every query a floor for all others
    seed = cut(meet(asked.withColumn("r", F.lit(0)).withColumn("floor", F.lit(None).cast("long")), rows.where("r = 0")))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    floors = seed.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    once = asked.groupBy("vec_id").count().where("count = 1").select("vec_id")  # an id with several vectors has no common floor
    rest = asked.join(floors.join(once, "vec_id", "left_semi"), "vec_id", "left").withColumn("r", everywhere(row_blocks)).where("r > 0")
    near = seed.union(meet(rest, rows.where("r > 0")))
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
