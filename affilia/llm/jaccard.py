"""N-gram Jaccard join: exact links and components over sets of word shingles.

The Jaccard distance is a metric, and documents are joined in regions around
pivot documents. Unrelated documents are all at distance 1 from each other, so
a pivot can tell apart only documents that have something in common with it.
The first regions follow from that: a document's shingles are dealt by hash
into as many buckets as two linked sets of its size may differ in shingles, plus
some. By the pigeonhole two linked documents agree on a whole bucket, so each
has the first such buckets as keys. The least document of a key is a pivot, and
all documents that share a key with a pivot are its region; linked documents
therefore meet in a region. Buckets of very frequent shingles come last, so
common passages make no crowded region. Sizes decide the number of buckets; a
document whose size is within the threshold of the next size class is
replicated into that class.

Inside a region distances are bounded from below by a metric of fixed size: the
Jaccard distance of the documents' counts of shingles in ``BUCKETS`` hash
buckets, which never exceeds the distance of the sets. Regions first fall into
rings of sizes as wide as the radius, with the next smaller ring replicated. A
crowded ring is split by more pivots into Voronoi cells in that metric: every document goes to
its nearest pivot, and by the triangle inequality a linked document lies within
twice the radius of that pivot's distance, so documents in this window are
replicated into the cell. Cells are split again while that saves comparisons;
what is small, or dense beyond splitting, is dealt into pairs of bounded parts.

Pairs are verified on the sets: first documents with their pivots; then, of what
is still apart, a spanning forest of each part's candidates (nearest first);
then all candidates that are still apart, within their parts. A part returns
spanning forests, never its pairs.

Defined results: equal sets are one class throughout; null or empty texts, and
texts without words, have no shingles and link with nothing (each is its own
component); fewer words than a shingle has are one shingle; repeated rows are
copies; a null doc_id links with nothing and has a null component; an empty
table gives no rows; other columns are ignored. Shingles are compared by
64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from . import bitmaps
from .common import cut, mapped, slices
from .ngrams import _BASE, mixed, shingle_sets
from .vectors import forest

WORDS, NUM, DEN = 3, 90, 100
#: Slots of the frequency sketch (bits), the count in one input partition that
#: makes a slot worth reporting, and the share of documents that makes it frequent.
SKETCH_BITS, LOCAL_COUNT, FREQUENT_SHARE, FREQUENT_LEAST = 22, 8, 1e-4, 24
#: Hash buckets of the bounding metric; documents and shingles of one part; a larger region than
#: REGION_ROWS is split around about PIVOTS pivots; a split has to leave at most this share of the region's comparisons.
BUCKETS, PART_ROWS, PART_SHINGLES, REGION_ROWS, PIVOTS, SPLIT_SHARE = 512, 512, 1 << 20, 512, 32, 0.5
_U = np.uint64


def _sets(batch, words: int):
    """(row, sorted set) for every row whose last column is the text."""
    for first, held in slices(batch.column(batch.num_columns - 1).to_pylist()):
        yield from enumerate(shingle_sets(held, words), first)


def _count_frequent(words: int):
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, found in _sets(batch, words):
                counts[(found >> _U(64 - SKETCH_BITS)).astype(np.int64)] += 1
        slots = np.flatnonzero(counts >= LOCAL_COUNT)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(counts[slots], pa.int64())], ["slot", "n"])

    return run


def frequent_slots(texts: DataFrame, words: int) -> np.ndarray:
    """Bitmap of fixed size over the hash slots that many documents fill; it only orders buckets."""
    least = max(FREQUENT_LEAST, FREQUENT_SHARE * texts.count())
    counts = mapped(texts, _count_frequent(words), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bits = counts.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    out = np.zeros(1 << SKETCH_BITS - 6, np.int64)
    for row in bits.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out


def class_size(level: int, num: int, den: int) -> int:
    """Buckets of a size class: more than the shingles in which two linked sets of it can differ."""
    most = ((1 << level) - 1) * (den - num) // num
    return most + 1 + most // 16


def region_keys(found: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys such that two sets with den * intersection >= num * union have one in common."""
    size = len(found)
    need, level = size * (den - num) // num + 1, size.bit_length()
    values, slot = mixed(found), (found >> _U(64 - SKETCH_BITS)).astype(np.int64)
    late = (frequent[slot >> 6] >> (slot & 63) & 1).astype(np.int64)
    keys = []
    for at in [level] + [level + 1] * (den * size >= num << level):
        buckets = class_size(at, num, den)
        where = (found % _U(buckets)).astype(np.int64) + late * buckets
        order = np.argsort(where, kind="stable")
        where = where[order]
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        used = where[starts]
        content = np.add.reduceat(values[order], starts) + used.astype(_U) * _U(_BASE) + _U(at)
        keys.append(mixed(content[:need]))
        if len(used) < need:  # too few buckets in use: an empty one may be all that two sets share
            empty = np.setdiff1d(np.arange(2 * buckets), used).astype(_U)
            keys.append(mixed(empty * _U(_BASE) + _U(at << 32)))
    return np.concatenate(keys).view(np.int64)


def _fingerprint(found: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one, two = mixed(found + _U(1)).sum(dtype=_U), mixed(found ^ _U(_BASE)).sum(dtype=_U)
        return tuple(mixed(np.array([one, two])).view(np.int64).tolist())


def _describe(words: int, num: int, den: int, bitmap):
    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for row, found in _sets(batch, words):
                keyed = len(found) and ids[row] is not None
                rows.append((ids[row], len(found), *_fingerprint(found), region_keys(found, bitmap.value, num, den) if keyed else []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    return run


_PAIR = "a long, b long"
_CELL = "region long, node long, comp long, size long, home boolean"
#: The count that stands for itself and anything above.
_FULL = 65535


def _exploded_keys(wanted=None):
    """(key, node) from the rows' key lists, of keys in the bitmap."""

    def run(batches):
        for batch in batches:
            nodes, keys = batch.column("f1").to_numpy(), batch.column("keys")
            flat, rows = keys.flatten(), pa.array(np.repeat(nodes, np.diff(keys.offsets.to_numpy())))
            if wanted is not None:
                inside = pa.array(bitmaps.has(wanted.value, flat.to_numpy()))
                flat, rows = flat.filter(inside), rows.filter(inside)
            yield pa.RecordBatch.from_arrays([flat, rows], ["key", "node"])

    return run


def pivot_regions(rows: DataFrame) -> DataFrame:
    """(pivot, node): every node with the least node of each key that it shares."""
    lists, entry = rows.select("f1", "keys"), "key long, node long"
    shared = mapped(lists, _exploded_keys(), entry).groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_high")).where("pivot < _high").select("key", "pivot").checkpoint()
    wanted = rows.sparkSession.sparkContext.broadcast(bitmaps.build(shared.select("key")))
    return mapped(lists, _exploded_keys(wanted), entry).join(shared, "key").where("node <> pivot").select("pivot", "node").distinct()


def _hashed(words: int, wanted, what: str, describe):
    """doc_id, fingerprint, size and describe(set) of the texts whose id the bitmap has."""
    names = ["doc_id", "f1", "f2", "size", what]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bitmaps.has(wanted.value, batch.column(0).to_numpy())))
            ids, rows = batch.column(0).to_pylist(), []
            for r, found in _sets(batch, words):
                rows.append((ids[r], *_fingerprint(found), len(found), describe(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def bucket_counts(found: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each bucket; all full if one can't be told."""
    counts = np.bincount((found & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return (counts if counts.max() < _FULL else np.full(BUCKETS, _FULL)).astype(np.uint16).tobytes()


def _matrix(column) -> np.ndarray:
    return np.array([np.frombuffer(c.as_py(), np.uint16) for c in column]).reshape(-1, BUCKETS)


def most_common(one: np.ndarray, sizes: np.ndarray, two: np.ndarray, two_sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of every set of one with every set of two."""
    out = np.empty((len(one), len(two)), np.int64)
    for at in range(0, len(one), 16):
        out[at : at + 16] = np.minimum(one[at : at + 16, None], two[None]).sum(-1, dtype=np.uint32)
    full = (one[:, 0] == _FULL)[:, None] | (two[:, 0] == _FULL)
    return np.where(full, np.minimum(sizes[:, None], two_sizes), out)


def _may_link(num: int, den: int):
    """Pairs (a, b) whose bucket counts allow a link."""

    def run(batches):
        for batch in batches:
            x, y = _matrix(batch.column("counts")), _matrix(batch.column("pivot_counts"))
            size, other = batch.column("size").to_numpy(), batch.column("pivot_size").to_numpy()
            common = np.minimum(x, y).sum(1, dtype=np.int64)
            common = np.where((x[:, 0] == _FULL) | (y[:, 0] == _FULL), np.minimum(size, other), common)
            keep = pa.array(den * common >= num * (size + other - common))
            yield pa.RecordBatch.from_arrays([batch.column("pivot").filter(keep), batch.column("node").filter(keep)], ["a", "b"])

    return run


def _linked(num: int, den: int):
    """The pairs (a, b) that link, decided on their sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(one.as_py(), _U), np.frombuffer(two.as_py(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, fetch, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link; ``fetch`` gives the sets of nodes."""
    pairs = cut(pairs)
    sets, with_sets = fetch(pairs.select("a").union(pairs.select("b"))), pairs
    for end in "ba":  # two projections alike, so that one exchange serves both
        with_sets = with_sets.join(sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}")), end)
    return mapped(with_sets.select("a", "b", "set_a", "set_b"), _linked(num, den), _PAIR)


def _split(num: int, den: int, rows: bool):
    """Voronoi cells of one part of a region around the region's pivots: their rows, or only how many.

    A region without a pivot stays whole.
    """
    window = 2 * (den - num) / den + 1e-9

    def run(table):
        is_pivot = np.array(table.column("pivot"))
        members, pivots = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)
        counts, size, node = _matrix(table.column("counts")), table.column("size").to_numpy(), table.column("node").to_numpy()
        parent = table.column("region").to_numpy()
        if len(pivots) and len(members):
            pivots = pivots[np.argsort(node[pivots])]
            common = most_common(counts[members], size[members], counts[pivots], size[pivots])
            distance = 1 - common / (size[members, None] + size[pivots] - common)
            row, cell = np.nonzero(distance <= distance.min(1)[:, None] + window)
            home = distance.argmin(1)[row] == cell
            with np.errstate(over="ignore"):
                region = mixed(parent[:1].view(_U) * _U(_BASE) + node[pivots].view(_U)).view(np.int64)[cell]
        else:
            row, home, region = np.arange(len(members)), np.ones(len(members), bool), parent[members]
        if not rows:
            region, n = np.unique(region, return_counts=True)
            return pa.table({"parent": np.full(len(region), parent[0]), "region": region, "n": n})
        taken = table.take(pa.array(members[row]))
        return pa.table({"region": pa.array(region, pa.int64()), "node": taken.column("node"), "comp": taken.column("comp"), "size": taken.column("size"), "home": pa.array(home, pa.bool_())})

    return run


def _around_pivots(regions: DataFrame) -> DataFrame:
    """Rows of regions (region, n, node, comp) dealt into parts, with the pivots that a hash chooses in each part."""
    chosen = F.pmod(F.xxhash64("node", "region"), F.lit(1 << 30)) * F.col("n") < F.lit(PIVOTS << 30)
    parts = F.ceil(F.col("n") / REGION_ROWS).cast("int")
    members = regions.withColumn("pivot", F.lit(False)).withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    pivots = regions.where(chosen).withColumn("pivot", F.lit(True)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return members.union(pivots)


def _open(points: DataFrame) -> DataFrame:
    """points of the regions where something can still be linked, with n, the region's rows."""
    found = points.groupBy("region").agg(F.count("*").alias("n"), F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.max("home").alias("_home"))
    found = found.where("_low < _high and _home").select("region", "n")
    return points.join(found, "region")


def _rings(regions: DataFrame, num: int, den: int) -> DataFrame:
    """Every region's rings of sizes; only sets of one ring, or of neighbouring ones, can link."""
    ring = F.floor(F.log(F.col("size").cast("double")) / math.log(den / num) + 1e-9)
    both = F.explode(F.array(F.struct(ring.alias("at"), F.lit(True).alias("home")), F.struct((ring + 1).alias("at"), F.lit(False).alias("home"))))
    return regions.withColumn("_ring", both).select(F.xxhash64("region", "_ring.at").alias("region"), "node", "comp", "size", F.col("_ring.home").alias("home"))


def _parted(leaves: DataFrame) -> DataFrame:
    """leaves with i, j (parts) and side: every row in all pairs of its part with another.

    A component that fills parts of its own isn't compared with itself.
    """
    sizes = leaves.groupBy("region", "comp").agg(F.count("*").alias("_m"), F.sum("size").alias("_s"))
    sizes = sizes.withColumn("_own", F.when(F.col("_m") >= PART_ROWS, F.col("comp")))
    enough = F.ceil(F.greatest(F.sum("_m") / PART_ROWS, F.sum("_s") / PART_SHINGLES)).cast("int")
    groups = sizes.groupBy("region", "_own").agg(enough.alias("_parts"))
    parts = groups.select("region", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_k"))
    parts = parts.groupBy("region").agg(F.collect_list(F.struct(F.xxhash64("_own", "_k").alias("part"), F.col("_own").alias("own"))).alias("_all"))
    groups = groups.select(F.col("region").alias("_r"), F.col("_own").alias("_g"), "_parts")
    placed = leaves.join(sizes.select("region", "comp", "_own"), ["region", "comp"]).join(groups, F.col("_own").eqNullSafe(F.col("_g")) & (F.col("region") == F.col("_r")))
    placed = placed.withColumn("_part", F.xxhash64("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")))
    dealt = placed.join(parts, "region").withColumn("_o", F.explode(F.filter("_all", lambda q: q["own"].isNull() | ~q["own"].eqNullSafe(F.col("_own")))))
    i, j = F.least("_part", "_o.part"), F.greatest("_part", "_o.part")
    return dealt.select("region", i.alias("i"), j.alias("j"), F.when(i == j, -1).otherwise((F.col("_part") == j).cast("int")).alias("side"), "node", "comp", "home")


def _candidates(table, num: int, den: int):
    """Rows x < y of a pair of parts that may link and are still apart, and their bounds."""
    side, home, comp, size = (np.array(table.column(c)) for c in ("side", "home", "comp", "size"))
    counts = _matrix(table.column("counts"))
    common = most_common(counts, size, counts, size)
    fits = np.triu(den * common >= num * (size[:, None] + size - common), 1)
    fits &= (home[:, None] | home) & (comp[:, None] != comp)
    if len(side) and side.min() >= 0:  # sides 0 and 1: only across
        fits &= side[:, None] != side
    x, y = np.nonzero(fits)
    return x, y, 1 - common[x, y] / (size[x] + size[y] - common[x, y])


def _nearest_forest(num: int, den: int):
    """A spanning forest of the candidates over the components, nearest pairs first."""

    def run(table):
        x, y, distance = _candidates(table, num, den)
        node = table.column("node").to_numpy()
        comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1].tolist()
        root = list(range(len(comp)))

        def find(a):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        kept = []
        for k in np.argsort(distance, kind="stable").tolist():
            a, b = find(comp[x[k]]), find(comp[y[k]])
            if a != b:
                root[a] = b
                kept.append(k)
        one, two = node[x[kept]], node[y[kept]]
        return pa.table({"a": pa.array(np.minimum(one, two), pa.int64()), "b": pa.array(np.maximum(one, two), pa.int64())})

    return run


def _still_apart(num: int, den: int):
    """The rows of a pair of parts that are in a candidate."""

    def run(table):
        x, y, _ = _candidates(table, num, den)
        return table.take(pa.array(np.union1d(x, y))).select(["region", "i", "j", "side", "node", "comp", "home"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, by products over the shingles that occur more than once."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    lengths = np.diff(np.append(starts, len(flat)))
    token, shared = np.repeat(np.arange(len(starts)), lengths), np.repeat(lengths, lengths) > 1
    rows, token = rows[shared], token[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    at = 0
    while at < len(token):
        to = np.searchsorted(token, token[at] + 4096)
        block = np.zeros((len(sets), 4096), np.float32)
        block[rows[at:to], token[at:to] - token[at]] = 1
        out += block @ block.T
        at = to
    return out


def _join_parts(num: int, den: int):
    """Links of a pair of parts, decided on the sets, as a spanning forest."""

    def run(table):
        side, node, comp, home = (np.array(table.column(c)) for c in ("side", "node", "comp", "home"))
        sets = [np.frombuffer(s.as_py(), _U) for s in table.column("set")]
        both = overlaps(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        x, y = np.nonzero(np.triu(both, 1))
        common = both[x, y].astype(np.int64)
        linked = (den * common >= num * (sizes[x] + sizes[y] - common)) & (comp[x] != comp[y]) & (home[x] | home[y])
        if side.min() >= 0:
            linked &= side[x] != side[y]
        x, y = x[linked], y[linked]
        root = forest(len(node), x, y, node) if len(x) else np.arange(len(node))
        moved = node[root] != node
        return pa.table({"a": pa.array(node[root[moved]], pa.int64()), "b": pa.array(node[moved], pa.int64())})

    return run


def _named(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with comp: the label of their node, or the node itself."""
    return nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): equal labels are connected by the links (a < b); what is connected may still have several.

    A node takes its least neighbour, and that one the least label among its own nodes.
    """
    near = cut(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
    beyond = links.join(near, links["b"] == near["node"]).groupBy(F.col("a").alias("label")).agg(F.min("label").alias("_next"))
    at_last = F.least(F.col("label"), F.coalesce("_next", "label"))
    roots = beyond.where("_next < label").join(near.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("_next").alias("label"))
    return cut(near.join(beyond, "label", "left").select("node", at_last.alias("label")).union(roots))


def _joined(labels: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """members (with node, comp) whose labels take the least label that a link connects them with."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("_to")).union(links.select("b", "a"))
    ends = _named(_named(ends, labels).toDF("_from", "node", "_comp"), labels).select("_comp", F.col("comp").alias("_next"))
    least = ends.groupBy(F.col("_comp").alias("comp")).agg(F.min("_next").alias("_next"))
    return members.join(least, "comp", "left").withColumn("comp", F.least("comp", F.coalesce("_next", "comp"))).drop("_next")


def region_links(stars: DataFrame, points: DataFrame, fetch, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect whatever links inside a region.

    stars: pivot, node (a pivot is in its own region without a row); points:
    node, size, counts; fetch(nodes): node, set of the nodes and maybe others.
    """
    own = points.toDF("pivot", "pivot_size", "pivot_counts")
    tested = mapped(stars.join(points, "node").join(own, "pivot"), _may_link(num, den), _PAIR)
    links = cut(_verified(tested, fetch, num, den))

    members = stars.select(F.col("pivot").alias("region"), "node").union(stars.select("pivot", "pivot").distinct())
    labels = _labels(links)
    regions = _open(_named(members, labels).withColumn("home", F.lit(True))).join(points.select("node", "size"), "node")
    regions = cut(_open(_rings(regions, num, den)))
    leaves = regions.where(F.col("n") <= REGION_ROWS).drop("n")
    crowded = regions.where(F.col("n") > REGION_ROWS)
    while not crowded.isEmpty():
        crowded = crowded.select("region", "n", "node", "comp", "size")
        dealt = cut(_around_pivots(crowded))
        split = dealt.join(points.drop("size"), "node").groupBy("region", "part")
        work = split.applyInArrow(_split(num, den, rows=False), "parent long, region long, n long").groupBy("parent", "region").agg(F.sum("n").alias("n"))
        work = work.groupBy(F.col("parent").alias("region")).agg(F.sum(F.col("n").cast("double") ** 2).alias("_work"))
        sizes = crowded.select("region", "n").distinct()
        pays = cut(sizes.join(work, "region").where(F.col("_work") <= F.col("n").cast("double") ** 2 * SPLIT_SHARE).select("region"))
        leaves = leaves.union(regions.join(crowded.select("region").distinct(), "region", "left_semi").join(pays, "region", "left_anti").drop("n"))
        if pays.isEmpty():
            break
        split = dealt.join(pays, "region", "left_semi").join(points.drop("size"), "node").groupBy("region", "part")
        regions = cut(_open(split.applyInArrow(_split(num, den, rows=True), _CELL)).select("region", "node", "comp", "size", "home", "n"))
        leaves = leaves.union(regions.where(F.col("n") <= REGION_ROWS).drop("n"))
        crowded = regions.where(F.col("n") > REGION_ROWS)
    leaves = cut(leaves)

    parts = cut(_parted(leaves))
    by_part = lambda parts: parts.join(points, "node").groupBy("region", "i", "j")
    more = cut(_verified(by_part(parts).applyInArrow(_nearest_forest(num, den), _PAIR).distinct(), fetch, num, den))
    apart = cut(by_part(_joined(labels, parts, more)).applyInArrow(_still_apart(num, den), "region long, i long, j long, side int, node long, comp long, home boolean"))
    rest = apart.join(fetch(apart.select("node")), "node").groupBy("region", "i", "j").applyInArrow(_join_parts(num, den), _PAIR)
    return links.union(more).union(rest)


def join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; docs: doc_id, text.

    Two documents link when den * |intersection| >= num * |union| of their
    sets of ``words``-word shingles.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    send = docs.sparkSession.sparkContext.broadcast
    bitmap = send(frequent_slots(texts.select("text"), words))
    rows = cut(mapped(texts, _describe(words, num, den, bitmap), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"))
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    stars = cut(pivot_regions(rows))
    nodes = stars.select("node").union(stars.select("pivot")).distinct().withColumnRenamed("node", "f1")
    named = cut(classes.join(nodes, "f1").select(F.col("rep").alias("doc_id"), "f1", "f2"))

    def hashed(named: DataFrame, what: str, describe) -> DataFrame:
        wanted = send(bitmaps.build(named.select("doc_id")))
        found = mapped(texts.where("doc_id is not null"), _hashed(words, wanted, what, describe), f"doc_id long, f1 long, f2 long, size long, {what} binary")
        return found.dropDuplicates(["doc_id", "f1", "f2"]).join(named, ["doc_id", "f1", "f2"]).withColumnRenamed("f1", "node")

    def fetch(nodes: DataFrame) -> DataFrame:
        asked = nodes.toDF("f1").distinct()
        return cut(hashed(cut(named.join(asked, "f1", "left_semi")), "set", np.ndarray.tobytes).select("node", "set"))

    points = cut(hashed(named, "counts", bucket_counts).select("node", "size", "counts"))
    components = star_components(region_links(stars, points, fetch, num, den)).withColumnRenamed("vid", "f1")
    placed = classes.join(components, "f1", "left").withColumn("comp_id", F.coalesce("comp_id", "f1"))
    least = placed.groupBy("comp_id").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "comp_id").select("f1", "f2", "n_shingles", "component_id")
    plain = rows.select("doc_id", "n_shingles", "f1", "f2")
    out = plain.where("n_shingles > 0 and doc_id is not null").join(placed, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    return out.union(plain.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of every component: the one of smallest doc_id (null ids stay)."""
    found = cut(join(docs, words, num, den))
    gone = found.where("doc_id <> component_id").select("doc_id")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    marked = docs.sparkSession.sparkContext.broadcast(bitmaps.build(gone.union(again)))
    names = docs.columns
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_doc"))
    sure = bitmaps.rows_in(keyed, "_id", marked, wanted=False)
    asked = bitmaps.rows_in(keyed, "_id", marked).join(gone.distinct().withColumnRenamed("doc_id", "_id"), "_id", "left_anti")
    repeated = again.withColumnRenamed("doc_id", "_id")
    once = asked.join(repeated, "_id", "left_anti")
    rest = asked.join(repeated, "_id", "left_semi").dropDuplicates(["_id"])
    return sure.union(once).union(rest.select("_id", "_doc")).select("_doc.*")
