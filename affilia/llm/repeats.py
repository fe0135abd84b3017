"""Removal of repeated byte strings: suffix-array dedup by interval expansion.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere
else too. Whole texts can't be sorted together, so candidates are found first,
exactly: of every window of ``length`` bytes the ``anchor``-gram of least hash
is its anchor, which its content alone decides; equal windows have equal
anchors at equal places. Anchors whose gram occurs once need no more work.
Around the others a context is cut that holds all windows that the anchor
can stand for. Equal contexts are classes (counted with map-side combine):
several members repeat as a whole. Where a gram has several contexts, they are
aligned at the anchor, and intervals of a positional Burrows-Wheeler transform
are extended breadth-first by one symbol per level. Each level gives the rows
that agree so far, in increasing length, until the minimum length is reached;
what is together then repeats.

A gram with very many contexts is not given to one task: its windows are split
into bands by their offset, and within a band contexts are dealt by the bytes
that all its windows share; narrower bands follow until groups are small or
a band is one window, in which case equal contexts have become one class.

Defined results: null texts are empty; texts shorter than ``length`` keep
everything; exact copies of a long enough text remove it whole, in all rows,
repeated rows included; rows with a null doc_id are compared like all others; an
empty table gives no rows; other columns are ignored. A text is held in memory
as a whole, with a few numbers of 64 bits for each of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .common import cut, mapped, slices
from .ngrams import mixed, powers, prefix_sums

LENGTH, ANCHOR = 400, 64
#: Contexts of one gram that are sorted together; more are split into BANDS.
MOST_CONTEXTS, BANDS = 4096, 8
#: Contexts of one transform, about.
BLOCK_CONTEXTS = 4096
#: Bytes of texts that are hashed at once.
SLICE_BYTES = 1 << 20
_POSITION_BITS = 31
_U = np.uint64


def anchors(held: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
    """(positions, gram hashes, lo, hi) of each text's anchors, in order.

    An anchor stands for the windows that start from ``hi`` down to ``lo`` bytes before it.
    """
    data = np.frombuffer(b"".join(held), np.uint8)
    offsets = np.cumsum([0] + [len(x) for x in held])
    grams = max(0, len(data) - anchor + 1)
    window = length - anchor + 1
    sums = prefix_sums(data)
    hashes = mixed((sums[anchor:] - sums[:grams]) * powers(len(data))[1][:grams]) if grams else sums[:0]
    mask = _U((1 << _POSITION_BITS) - 1)
    least = (hashes & ~mask) | (mask - np.arange(grams, dtype=_U))
    span = 1
    while span * 2 <= window and len(least) > span:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if len(least) > window - span:
        least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a < length:
            yield np.zeros(0, np.int64), hashes[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        part = least[a : b - length + 1]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        last = np.append(first[1:], len(part)) - 1
        at = (mask - (part[first] & mask)).astype(np.int64)
        yield at - a, hashes[at], at - a - last, at - a - first


def _describe(length: int, anchor: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, held in slices(texts, SLICE_BYTES):
                rows = []
                for row, (data, (_, grams, _, _)) in enumerate(zip(held, anchors(held, length, anchor)), first):
                    grams, times = np.unique(grams, return_counts=True)
                    digest = hashlib.sha256(data).digest()
                    rows.append((ids[row], len(data), digest, _node(digest), grams.view(np.int64), times))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["doc_id", "n_bytes", "sha", "node", "grams", "times"])

    return run


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


_CONTEXT = "block long, key long, node long, pos long, lo int, hi int, ctx binary"
_MARK = "node long, start long, stop long"


def _contexts(length: int, anchor: int, wanted, unwanted, blocks: int):
    """Contexts of the grams in one bitmap and not in the other.

    What repeats inside one text is sent once; its further places are rows
    without a key, whose windows are known to repeat.
    """
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            for _, held in slices(batch.column(0).to_pylist(), SLICE_BYTES):
                rows = []
                for data, (places, grams, los, his) in zip(held, anchors(held, length, anchor)):
                    keys = grams.view(np.int64)
                    keep = bitmaps.has(wanted.value, keys)
                    if unwanted is not None:
                        keep &= ~bitmaps.has(unwanted.value, keys)
                    keep = np.flatnonzero(keep)
                    if not len(keep):
                        continue
                    node, seen = _node(hashlib.sha256(data).digest()), {}
                    for at, gram, lo, hi in zip(*(x[keep].tolist() for x in (places, keys, los, his))):
                        context = data[at - hi : at - lo + length]
                        block = gram % blocks
                        if (context, lo, hi) in seen:
                            other = seen[context, lo, hi]
                            rows.append(((node ^ at) % blocks, None, node, at, lo, hi, None))
                            if other is not None:
                                rows.append(((node ^ other) % blocks, None, node, other, lo, hi, None))
                                seen[context, lo, hi] = None
                        else:
                            seen[context, lo, hi] = at
                            rows.append((block, gram, node, at, lo, hi, context))
                    if len(rows) > 4000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def extended(classes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Intervals after one more symbol: rows of a class stay together while their symbols agree.

    One step of a positional Burrows-Wheeler transform: rows are kept in the
    order of what has been matched, and sorted stably by the next symbol.
    """
    n = len(classes)
    bits = max(1, n.bit_length())
    both = np.sort(((classes * 257 + symbols) << bits) | np.arange(n))
    order, key = both & ((1 << bits) - 1), both >> bits
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    return out


def repeated_windows(groups: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes], length: int, anchor: int) -> np.ndarray:
    """Matrix (row, d): the window starting d before the row's anchor equals another row's of its group.

    Contexts of a group are aligned at their anchor. Intervals are extended
    breadth-first, one symbol per level, to the right and to the left; at each
    level to the left, what agrees in the d symbols before and in the
    ``length - anchor - d`` symbols after the anchor shares a window.
    """
    n, reach = len(contexts), length - anchor
    table = np.full((n, 2 * reach + anchor), 256, np.int16)  # 256 is no byte: outside the text
    for row, (context, h) in enumerate(zip(contexts, hi.tolist())):
        table[row, reach - h : reach - h + len(context)] = np.frombuffer(context, np.uint8)
    columns = np.ascontiguousarray(table.T)
    start = np.unique(groups, return_inverse=True)[1].astype(np.int64)
    after = np.empty((reach + 1, n), np.int32)
    now = start
    for level in range(reach + 1):
        after[level] = now
        if level < reach:
            now = extended(now, columns[reach + anchor + level])
    out, now = np.zeros((n, reach + 1), bool), start
    for d in range(reach + 1):
        rows = np.flatnonzero((lo <= d) & (d <= hi))
        if len(rows):
            key = now[rows] * (n + 1) + after[reach - d][rows]
            order = np.argsort(key)
            same = np.diff(key[order]) == 0
            out[rows[order], d] = np.append(same, False) | np.concatenate([[False], same])
        if d < reach:
            now = extended(now, columns[reach - 1 - d])
    return out


def _expand(length: int, anchor: int):
    def run(table):
        node, pos, lo, hi = (table.column(c).to_numpy() for c in ("node", "pos", "lo", "hi"))
        found = np.zeros((len(node), length - anchor + 1), bool)
        known = np.array(table.column("key").is_null())
        found[known] = (lo[known, None] <= np.arange(length - anchor + 1)) & (np.arange(length - anchor + 1) <= hi[known, None])
        rows = np.flatnonzero(~known)
        if len(rows):
            key = table.column("key").take(pa.array(rows)).to_numpy()
            found[rows] = repeated_windows(key, lo[rows], hi[rows], [c.as_py() for c in table.column("ctx").take(pa.array(rows))], length, anchor)
        found[np.array(table.column("done"))] = False
        edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edges == 1)
        last = np.nonzero(edges == -1)[1] - 1
        return pa.table({"node": pa.array(node[row], pa.int64()), "start": pa.array(pos[row] - last, pa.int64()), "stop": pa.array(pos[row] - first + length, pa.int64())})

    return run


def _crowded(found: DataFrame, length: int, anchor: int, most: int) -> DataFrame:
    """(node, start, stop) of what repeats, for grams with very many contexts."""
    known = found.where("key is null").select("node", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("stop"))
    marks, width = [known], length - anchor + 1
    found = found.where("key is not null").select("key", "node", "pos", "lo", "hi", "ctx", F.lit(False).alias("done"))
    while True:
        digest = F.xxhash64("lo", "hi", "ctx")
        slim = found.where("not done").select("key", digest.alias("d"), F.md5("ctx").alias("m"), "node", "pos", "lo", "hi")
        # of a class with several members any node and pos will do: its members are marked as a whole
        classes = found.groupBy("key", "lo", "hi", "ctx").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("pos").alias("pos"), F.max("done").alias("done"))
        classes = classes.withColumn("done", F.col("done") | (F.col("n") > 1))
        sizes = classes.groupBy("key").agg(F.count("*").alias("contexts"), F.max("n").alias("most")).where("contexts > 1 or most > 1")
        classes = cut(classes.join(sizes, "key").select("key", "node", "pos", "lo", "hi", "ctx", "n", "done", "contexts"))
        whole = classes.where("n > 1").select("key", digest.alias("d"), F.md5("ctx").alias("m"))
        marks.append(slim.join(whole, ["key", "d", "m"]).select("node", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("stop")))
        small = classes.where(f"contexts between 2 and {most}")
        blocks = max(1, -(-small.count() // BLOCK_CONTEXTS))
        dealt = small.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", "node", "pos", "lo", "hi", "ctx", "done")
        marks.append(_expanded(dealt, blocks, length, anchor))
        large = classes.where(f"contexts > {most}")
        if large.isEmpty():
            break
        width = max(1, -(-width // BANDS))
        bands = F.explode(F.sequence((F.col("lo") / width).cast("int"), (F.col("hi") / width).cast("int")))
        dealt = large.withColumn("band", bands)
        low, high = F.greatest("lo", F.col("band") * width), F.least("hi", F.col("band") * width + (width - 1))
        dealt = dealt.select("key", "node", "pos", "band", low.alias("lo"), high.alias("hi"), F.expr("hi").alias("was"), "ctx", "done")
        core = F.substring("ctx", F.col("was") - F.col("band") * width + 1, F.lit(length - (width - 1)))
        narrow = F.substring("ctx", F.col("was") - F.col("hi") + 1, F.col("hi") - F.col("lo") + length)
        found = cut(dealt.select(F.xxhash64("key", "band", core).alias("key"), "node", "pos", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), narrow.alias("ctx"), "done"))
    out = marks[0]
    for more in marks[1:]:
        out = out.union(more)
    return out


def _expanded(dealt: DataFrame, blocks: int, length: int, anchor: int) -> DataFrame:
    """Marks from blocks of contexts; rows of classes that are done serve as partners only."""
    if "done" not in dealt.columns:
        dealt = dealt.withColumn("done", F.lit(False))
    return dealt.repartition(blocks, "block").groupBy("block").applyInArrow(_expand(length, anchor), _MARK)


def _with_node(asked):
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            nodes = np.array([_node(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()) for t in texts], np.int64)
            keep = pa.array(bitmaps.has(asked.value, nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes).filter(keep), batch.column(0).filter(keep)], ["node", "text"])

    return run


def _remove(batches):
    for batch in batches:
        rows = []
        for node, text, marks in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
            data, spans = (text or "").encode("utf-8", "surrogatepass"), []
            for m in sorted((m["start"], m["stop"]) for m in marks):
                if spans and m[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m[1])
                else:
                    spans.append([*m])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            rows.append((node, sum(b - a for a, b in spans), len(spans), [{"start": a, "stop": b} for a, b in spans], kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()))], ["node", "n_removed", "n_spans", "spans", "kept_sha256"])


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256 for every row; docs: doc_id, text."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    rows = cut(mapped(texts, _describe(length, anchor), "doc_id long, n_bytes long, sha binary, node long, grams array<long>, times array<long>"))
    copies = rows.groupBy("node").agg(F.count("*").alias("copies"))
    counts = rows.select(F.explode(F.arrays_zip("grams", "times")).alias("g")).groupBy(F.col("g.grams").alias("gram")).agg(F.sum("g.times").alias("n")).where("n > 1").checkpoint()
    shared = send(bitmaps.build(counts.select("gram")))
    hot = counts.where(F.col("n") > most)
    crowded = None if hot.isEmpty() else send(bitmaps.build(hot.select("gram")))
    blocks = max(1, -(-(counts.where(F.col("n") <= most).agg(F.sum("n")).first()[0] or 0) // BLOCK_CONTEXTS))
    marks = _expanded(mapped(texts.select("text"), _contexts(length, anchor, shared, crowded, blocks), _CONTEXT), blocks, length, anchor)
    if crowded is not None:
        marks = marks.union(_crowded(cut(mapped(texts.select("text"), _contexts(length, anchor, crowded, None, 1), _CONTEXT)), length, anchor, most))
    per_text = cut(marks.groupBy("node").agg(F.collect_set(F.struct("start", "stop")).alias("marks")))
    partly = per_text.join(rows.select("node").join(copies, "node").where("copies = 1").select("node"), "node", "left_semi")
    asked = send(bitmaps.build(partly.select("node")))
    spans = mapped(mapped(texts.select("text"), _with_node(asked), "node long, text string").join(partly, "node").select("node", "text", "marks"), _remove, "node long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept_sha256 string")
    out = rows.select("doc_id", "n_bytes", "sha", "node").join(copies, "node").join(spans, "node", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("long")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", zero)).cast("long").alias("n_spans"),
        F.when(gone, F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("stop")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>"))).alias("spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
