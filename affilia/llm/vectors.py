"""Embedding near-duplicates by collision-counting projections.

Identical vectors are one class. Classes of a label are dealt into tables: a
table's key is the label and the cells that a few random one-dimensional
projections fall into. How many projections a key takes grows with the
logarithm of the label's size, so blocks stay small; how many tables there are
follows from the wanted recall. Crowded blocks are split into pairs of bounded
parts. Inside a part pair the vectors are sorted along further projections,
collisions inside the query-centred windows are counted per pair, and pairs
that reach the calibrated count are verified by cosine in double precision.

Two vectors at the threshold are ``sqrt(2 - 2 * cosine)`` apart once
normalised, so their difference along a Gaussian direction is normal with that
deviation: from it follow the windows' width, the count and the number of
tables. A pair met in several tables counts in the first only. A part pair
returns link counts and one spanning forest, never its pairs.

Defined results: vectors that are null, zero or hold null or non-finite
components, and those with a null label or id, link with nothing; vectors of
different length don't link; repeated rows are vectors like others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from .common import cut, mapped

COSINE = 0.98
#: Share of the pairs at the threshold that the tables, and the counts, may miss.
TABLE_MISS, COUNT_MISS = 0.003, 0.003
#: Width of a table's cells, in deviations of unit vectors' projections.
CELL = 1.2
#: Classes of a block, about, and of one part of a crowded block.
BLOCK_ROWS = 512
PROJECTIONS = 10
SEED = 20240607


def calibrated(cosine: float, projections: int = PROJECTIONS, miss: float = COUNT_MISS) -> tuple[float, int]:
    """(half width of the windows, collisions to reach) that lose at most ``miss`` of the pairs at the threshold."""
    deviation = math.sqrt(max(2 - 2 * cosine, 1e-12))
    half, inside = 1.96 * deviation, math.erf(1.96 / math.sqrt(2))
    below, need = 0.0, 0
    for k in range(projections + 1):
        below += math.comb(projections, k) * inside**k * (1 - inside) ** (projections - k)
        if below > miss:
            need = k
            break
    return half, need


def table_layout(rows: int, cosine: float, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """(projections in a key, tables) for a label of so many classes."""
    deviation = math.sqrt(max(2 - 2 * cosine, 1e-12))
    same, cells = 1 - deviation * math.sqrt(2 / math.pi) / CELL, 2 * math.sqrt(math.pi) / CELL
    width = max(0, math.ceil(math.log(max(1, rows / block_rows)) / math.log(cells)))
    return width, 1 if not width else math.ceil(math.log(TABLE_MISS) / math.log(1 - same**width))


def directions(dims: int, first: int, count: int) -> np.ndarray:
    """Gaussian directions number ``first`` to ``first + count``, alike on every worker."""
    return np.array([np.random.default_rng([SEED, dims, k]).standard_normal(dims) for k in range(first, first + count)]).reshape(count, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(units: np.ndarray, width: int, tables: int) -> np.ndarray:
    """One 64-bit key per row and table: the cells of the table's own projections."""
    out = np.zeros((len(units), tables), np.int64)
    for t in range(tables):
        if width:
            shift = np.random.default_rng([SEED + 1, t]).random(width)
            at = np.floor(units @ directions(units.shape[1], 1000 + t * width, width).T / CELL + shift).astype(np.int64)
            for k in range(width):
                out[:, t] = out[:, t] * 1_000_003 + at[:, k]
    return out


def _deal(cosine: float, kind, vectors: bool):
    """Every row once per table with its cell; with the vector, or only the block and how many rows it has."""
    names = ["label", "dims", "tab", "cell"] + (["rep", "n", "width", "v"] if vectors else ["count"])
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64()] + ([pa.int64(), pa.int64(), pa.int32(), pa.binary()] if vectors else [pa.int64()])

    def run(batches):
        for batch in batches:
            held = [np.array(v.as_py(), kind) for v in batch.column("v")]
            label, rep, n, width, tables = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "rep", "n", "width", "tables"))
            dims = np.array([len(v) for v in held])
            for d, w, t in {*zip(dims.tolist(), width.tolist(), tables.tolist())}:
                rows = np.flatnonzero((dims == d) & (width == w) & (tables == t))
                keys = cells(_unit(np.array([held[r] for r in rows], np.float64)), w, t)
                for k in range(t):
                    block = [label[rows], np.full(len(rows), d), np.full(len(rows), k), keys[:, k]]
                    if vectors:
                        more = [rep[rows], n[rows], np.full(len(rows), w), [held[r].tobytes() for r in rows]]
                    else:
                        pairs, count = np.unique(np.stack([block[0], block[3]]), axis=1, return_counts=True)
                        block, more = [pairs[0], np.full(len(count), d), np.full(len(count), k), pairs[1]], [count]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind_) for c, kind_ in zip(block + more, types)], names)

    return run


def colliding_pairs(projected: np.ndarray, half: float, need: int):
    """Pairs of rows (smaller first) whose projections lie within ``half`` at least ``need`` times."""
    rows, counts = len(projected), np.zeros(len(projected) ** 2, np.uint8)
    steps = np.arange(rows)
    for line in projected.T:
        order = np.argsort(line, kind="stable")
        ends = np.searchsorted(line[order], line[order] + half, "right")
        lengths = ends - steps - 1
        left = np.repeat(steps, lengths)
        right = np.arange(len(left)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + left + 1
        x, y = order[left], order[right]
        counts[np.minimum(x, y) * rows + np.maximum(x, y)] += 1
    return np.divmod(np.flatnonzero(counts >= need), rows)


def forest(n: int, x: np.ndarray, y: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n nodes the node of least ``rank`` that the links x - y lead to."""
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    label, x, y = np.arange(n), place[x], place[y]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return order[label[place]]
        label = new


def _count_part(cosine: float, kind):
    half, need = calibrated(cosine)

    def run(table):
        rep, n, part = (table.column(c).to_numpy() for c in ("rep", "n", "part"))
        width, tab = int(table.column("width")[0].as_py()), int(table.column("tab")[0].as_py())
        dims = int(table.column("dims")[0].as_py())
        v = _unit(np.array([np.frombuffer(x.as_py(), kind) for x in table.column("v")], np.float64).reshape(len(rep), dims))
        x, y = colliding_pairs(v @ directions(dims, 0, PROJECTIONS).T, half, need)
        i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        if i != j:
            across = part[x] != part[y]
            x, y = x[across], y[across]
        linked = np.empty(len(x), bool)
        for s in range(0, len(x), 1 << 16):
            linked[s : s + (1 << 16)] = np.einsum("ij,ij->i", v[x[s : s + (1 << 16)]], v[y[s : s + (1 << 16)]]) >= cosine
        x, y = x[linked], y[linked]
        if tab and len(x):
            before = cells(v, width, tab)
            fresh = np.ones(len(x), bool)
            for t in range(tab):
                fresh &= before[x, t] != before[y, t]
            x, y = x[fresh], y[fresh]
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, x, n[y])
        np.add.at(links, y, n[x])
        root = forest(len(rep), x, y, rep) if len(x) else np.arange(len(rep))
        found = links > 0
        return pa.table({"rep": rep[found], "links": links[found], "root": rep[root[found]]})

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, label, n_links, component_id, kept for every row of embeddings."""
    v = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists(v, lambda a: a != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), F.when(usable, v).alias("v"))
    good = rows.where(F.col("v").isNotNull())
    classes = cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    layouts = classes.groupBy("label").count()
    sizes = F.create_map(*[x for k in range(64) for x in (F.lit(k), F.struct(*[F.lit(n).alias(c) for c, n in zip(("width", "tables"), table_layout(1 << k, cosine, block_rows))]))])
    layouts = layouts.select("label", F.element_at(sizes, F.ceil(F.log2("count")).cast("int")).alias("_l")).select("label", "_l.width", "_l.tables")
    kind = np.float32 if dict(embeddings.dtypes)["embedding"] == "array<float>" else np.float64
    block = ["label", "dims", "tab", "cell"]
    laid_out = classes.join(layouts, "label").select("label", "rep", "n", "width", "tables", "v")
    parts = mapped(laid_out, _deal(cosine, kind, vectors=False), "label long, dims int, tab int, cell long, count long").groupBy(*block).agg(F.sum("count").alias("count"))
    parts = parts.where("count > 1").withColumn("parts", F.ceil(F.col("count") / block_rows).cast("int")).drop("count")
    dealt = mapped(laid_out, _deal(cosine, kind, vectors=True), "label long, dims int, tab int, cell long, rep long, n long, width int, v binary")
    dealt = dealt.join(parts, block).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    pairs = dealt.withColumn("_o", F.explode(others)).withColumn("i", F.least("part", "_o")).withColumn("j", F.greatest("part", "_o")).drop("_o", "parts")
    found = cut(pairs.groupBy(*block, "i", "j").applyInArrow(_count_part(cosine, kind), "rep long, links long, root long"))
    components = star_components(found.select("rep", "root").where("rep <> root"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).join(components.withColumnRenamed("vid", "rep"), "rep", "left")
    members = classes.join(links, "rep", "left").select("label", "v", F.col("rep"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp_id", "rep").alias("component_id"))
    alone = rows.where(F.col("v").isNull()).select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.join(members, ["label", "v"]).select("vec_id", "label", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
