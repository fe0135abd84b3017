"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last WINDOW bytes says so, so a
passage that many documents share falls into the same chunks in all of them.
Chunk hashes are counted; a bitmap of fixed size tells which occur again.

* A chunk that occurs again is sent to its hash's task (once per sending task)
  and encoded there, once for the corpus.
* What lies between such chunks is encoded where it is read, as one piece.
  Texts without repeated chunks are finished there.

Pieces and encoded chunks meet by text and are joined in order. Tokens beside
a join may differ from those of the whole text, so every join is repaired: the
words on both sides of it (a cut word and up to two whole ones each way) are
encoded again as one string, and their outer whole words have to come out as
they did in the pieces. Pieces too short for that run on into the next window.
Where a window doesn't agree the text is encoded as a whole in a last pass, so
the ids are those of the whole text whatever the vocabulary.

Equal texts are encoded once per task and joined once; every row gets its
text's result by a 128-bit hash of the text.

Defined results: a null text is an empty one (no tokens, hashes of the empty
string); repeated rows have equal results; an empty table gives no rows; other
columns are ignored; a chunk's hash has 128 bits.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps, packing
from .common import KERNEL_BYTES, cut, mapped, slices

#: Bytes that the rolling hash sees, the least size of a chunk, and (as a power of two) the mean distance of cuts.
WINDOW, LEAST, MEAN_BITS = 32, 96, 8
#: Keys that a task remembers as sent, before it starts anew.
REMEMBERED = 1 << 17

_GEAR = np.random.default_rng(19920417).integers(0, 2**32, 256, dtype=np.uint32)
_HEAD = re.compile(r"[^ \t\n\r]*[ \t\n\r]+(?=([^ \t\n\r]+))\1(?:[ \t\n\r]+(?=([^ \t\n\r]+))\2)?(?=[ \t\n\r])")
_TAIL = re.compile(r"(?<=[ \t\n\r])[^ \t\n\r]+(?:[ \t\n\r]+[^ \t\n\r]+)?[ \t\n\r]+([^ \t\n\r]*)\Z")
_SPACE = re.compile(r"[ \t\n\r]+")

PART = "ids binary, n_left int, k_left int, n_right int, k_right int, left string, right string"
_PART_KINDS = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST_KINDS = [pa.int64(), pa.string(), pa.string()]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def cuts(held: list[bytes], mean_bits: int = MEAN_BITS, least: int = LEAST):
    """For every text the byte positions where its chunks end; none for an empty text."""
    data = np.frombuffer(b"".join(held) + b"\0", np.uint8)
    rolled, width = _GEAR[data[:-1]], 1
    while width < WINDOW:  # sums over windows of twice the width
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint32(width))
        width *= 2
    found = np.flatnonzero(rolled >> np.uint32(32 - mean_bits) == 0) + 1
    found = found[data[found] & 0xC0 != 0x80]  # not inside a character
    start = 0
    edges = np.searchsorted(found, np.cumsum([0] + [len(x) for x in held]))
    for text, low, high in zip(held, edges[:-1].tolist(), edges[1:].tolist()):
        ends, last = [], 0
        for at in (found[low:high] - start).tolist():
            if at - last >= least and at < len(text):
                ends.append(at)
                last = at
        yield ends + [len(text)] if text else []
        start += len(text)


def chunk_key(chunk: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _chunks(batches, first: int = 0):
    """(row's other columns, text, chunk ends, chunk keys) of every row; the last column is the text."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        others = list(zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns - 1)])) or [()] * batch.num_rows
        for start, held in slices((t.as_py() for t in texts), KERNEL_BYTES):
            for row, (text, ends) in enumerate(zip(held, cuts(held)), start):
                yield others[row], text, ends, [chunk_key(text[a:b]) for a, b in zip([0, *ends], ends)]


class Encoder:
    """The tokenizer, and parts of texts that can be joined."""

    def __init__(self, path: str | None):
        self.words = packing.word_cache(path)
        self.tokenizer = self.words.tokenizer
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.words.encode(text), "<u4").tolist()

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        decoded = self.tokenizer.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def part(self, text: str) -> tuple:
        """A piece as (ids, tokens of its left margin, of the whole words in it, the same on the right, the margins).

        A piece without both margins, or whose margins alone have other ids,
        has no ids and its whole text on the left.
        """
        whole = None, 0, 0, 0, 0, text, ""
        head = _HEAD.match(text)
        tail = _TAIL.search(text, max(0, len(text) - 256)) or _TAIL.search(text)
        if head is None or tail is None or head.end() > tail.start():
            return whole
        left, right = head.group(), tail.group()
        ids, first, last = self.ids(text), self.ids(left), self.ids(right)
        begun, ended = self.ids(left[: _SPACE.search(left).start()]), self.ids(tail.group(1))
        middle = len(ids) - len(last)
        if len(first) > middle or ids[: len(first)] != first or ids[middle:] != last or first[: len(begun)] != begun or last[len(last) - len(ended) :] != ended:
            return whole
        return np.array(ids, self.kind).tobytes(), len(first), len(first) - len(begun), len(last), len(last) - len(ended), left, right

    def joined(self, parts) -> list[int] | None:
        """The ids of the parts' whole text; None where a window doesn't agree with its parts."""
        out: list[int] = []
        last, held, right = None, "", []  # the part before and its last tokens, the text since
        for data, n_left, k_left, n_right, k_right, left, after in parts:
            if data is None:
                held += left
                continue
            ids = np.frombuffer(data, self.kind).tolist()
            if last is None and not held:
                out += ids[: len(ids) - n_right]
            else:
                window = self.ids((last[1] if last else "") + held + left)
                if last and window[: last[0]] != right[: last[0]] or window[len(window) - k_left :] != ids[n_left - k_left : n_left]:
                    return None
                out += window
                out += ids[n_left : len(ids) - n_right]
            last, held, right = (k_right, after), "", ids[len(ids) - n_right :]
        if last is None or held:
            window = self.ids((last[1] if last else "") + held)
            if last and window[: last[0]] != right[: last[0]]:
                return None
            return out + window
        return out + right


@lru_cache(1)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)


def _batches(rows, kinds, names, size: int = 1 << 20):
    """Record batches of tuples, of about ``size`` bytes of text and ids."""
    held, filled = [], 0
    for row in rows:
        held.append(row)
        filled += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if filled > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, filled = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _once(rows, key):
    """Rows whose key hasn't come up lately."""
    seen: set = set()
    for row in rows:
        if (k := key(row)) not in seen:
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(k)
            yield row


def _again(words, keys) -> list[bool]:
    return bitmaps.has(words.value, np.array([k for k, _ in keys], np.int64)).tolist() if keys else []


def _hash_counts(batches):
    """h, n: chunk hashes of a few thousand texts and how often they occur there."""
    held: list[int] = []

    def counted():
        h, n = np.unique(np.array(held, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    for _, _, _, keys in _chunks(batches):
        held += [k for k, _ in keys]
        if len(held) > 1 << 17:
            yield counted()
            held = []
    if held:
        yield counted()


def _repeated(words):
    """c1, c2, chunk of the chunks in the bitmap."""

    def run(batches):
        rows = ((*key, text[a:b]) for _, text, ends, keys in _chunks(batches) for a, b, key, again in zip([0, *ends], ends, keys, _again(words, keys)) if again)
        return _batches(_once(rows, lambda r: r[:2]), [pa.int64(), pa.int64(), pa.binary()], ["c1", "c2", "chunk"])

    return run


def _encode_sorted(path):
    """Sorted (c1, c2, chunk) to (c1, c2) and the part, each chunk once."""

    def rows(batches):
        tool, last = encoder(path), None
        for batch in batches:
            for c1, c2, chunk in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if (c1, c2) != last:
                    last = c1, c2
                    yield c1, c2, *tool.part(chunk.decode())

    return lambda batches: _batches(rows(batches), [pa.int64(), pa.int64(), *_PART_KINDS], ["c1", "c2", *_names(PART)])


def _places(words):
    """k1, k2, pos, c1, c2 of the chunks in the bitmap, for each text."""

    def run(batches):
        texts = _once(_chunks(batches), lambda r: r[0])
        rows = ((*of, pos, *key) for of, _, _, keys in texts for pos, (key, again) in enumerate(zip(keys, _again(words, keys))) if again)
        return _batches(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], ["k1", "k2", "pos", "c1", "c2"])

    return run


def _pieces(words, path):
    """k1, k2, pos and the part for each run of other chunks; or the result of a text that has none in the bitmap."""

    def rows(batches):
        tool, no_part, no_digest = encoder(path), (None,) * len(_PART_KINDS), (None,) * len(_DIGEST_KINDS)
        for of, text, ends, keys in _once(_chunks(batches), lambda r: r[0]):
            again = _again(words, keys)
            if not any(again):
                yield *of, 0, *no_part, *tool.digest(tool.ids(text.decode()))
                continue
            start = pos = None
            for k, (a, b) in enumerate(zip([0, *ends], ends)):
                if not again[k]:
                    start, pos = (a, k) if start is None else (start, pos)
                if start is not None and (again[k] or k + 1 == len(ends)):
                    yield *of, pos, *tool.part(text[start : a if again[k] else b].decode()), *no_digest
                    start = None

    return lambda batches: _batches(rows(batches), [pa.int64(), pa.int64(), pa.int32(), *_PART_KINDS, *_DIGEST_KINDS], ["k1", "k2", "pos", *_names(PART), *_names(DIGEST)])


def _join_sorted(path):
    """Sorted parts to the result of each text; null numbers where a join couldn't be repaired."""
    width = len(_PART_KINDS)

    def rows(batches):
        tool, of, last, parts = encoder(path), None, None, []

        def done():
            ids = tool.joined(parts)
            return (*of, None, None, None) if ids is None else (*of, *tool.digest(ids))

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)]):
                if row[:2] != of:
                    if parts:
                        yield done()
                    of, last, parts = row[:2], None, []
                    if row[3 + width] is not None:
                        yield *of, *row[3 + width :]
                if row[3 + width] is None and row[2] != last:  # copies of a text come from several tasks
                    parts.append(row[3 : 3 + width])
                    last = row[2]
        if parts:
            yield done()

    return lambda batches: _batches(rows(batches), [pa.int64(), pa.int64(), *_DIGEST_KINDS], ["k1", "k2", *_names(DIGEST)])


def _whole(path):
    def rows(batches):
        tool = encoder(path)
        for batch in batches:
            for k1, k2, text in zip(*[batch.column(k) for k in range(3)]):
                yield k1.as_py(), k2.as_py(), *tool.digest(tool.ids(text.as_py()))

    return lambda batches: _batches(rows(batches), [pa.int64(), pa.int64(), *_DIGEST_KINDS], ["k1", "k2", *_names(DIGEST)])


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text); path: the vocabulary file."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    texts = rows.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("chunks"), "text").alias("k2"), "text")
    counts = mapped(rows.select("text"), _hash_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    words = spark.sparkContext.broadcast(bitmaps.build(counts.where("n > 1").select("h")))
    chunks = mapped(rows.select("text"), _repeated(words), "c1 long, c2 long, chunk binary").repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    parts = mapped(chunks, _encode_sorted(path), f"c1 long, c2 long, {PART}")
    placed = mapped(texts, _places(words), "k1 long, k2 long, pos int, c1 long, c2 long").join(parts.hint("merge"), ["c1", "c2"])
    columns = ["k1", "k2", "pos", *_names(PART)]
    pieces = mapped(texts, _pieces(words, path), f"k1 long, k2 long, pos int, {PART}, {DIGEST}")
    ordered = pieces.unionByName(placed.select(*columns), allowMissingColumns=True).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "pos")
    found = cut(mapped(ordered, _join_sorted(path), f"k1 long, k2 long, {DIGEST}"))
    open_texts = found.where("n_tokens is null").select("k1", "k2")
    if not open_texts.isEmpty():
        once = texts.join(open_texts, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        found = found.where("n_tokens is not null").union(mapped(once, _whole(path), f"k1 long, k2 long, {DIGEST}"))
    return rows.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("chunks"), "text").alias("k2")).join(found, ["k1", "k2"], "left").select("doc_id", *_names(DIGEST))
