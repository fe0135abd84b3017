"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often.

Every text is encoded by both tokenizers in one pass over the documents. Byte
offsets where tokens of both end cut the text into groups; the pair of tokens
that ends a group is a link.

Postings cogroup: a document's pairs with their multiplicities are posted under
the pair's B id, many documents' postings in one row (a block). Counts of pairs
are summed per block first, then by pair. Blocks and counts are shuffled by B
id and sorted; in that stream an id's counts come first, so its maximum and
counts are at hand for its postings, which follow one block at a time. The
contributions are summed by document, many documents' sums in one row, too. A B id with more than PART_BLOCKS blocks
is dealt into parts, each of which gets the id's counts (at most one row entry
per A id), so no task holds or reads all postings of a frequent id; sorting
spills, and nothing but one block and one id's counts is in memory.

Defined results: null and empty texts, and texts that either tokenizer doesn't
give back byte by byte, have no tokens: all numbers 0 and no hash; repeated
rows count each; ties for the best count all are best; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped

BYTE_BPE, BYTE_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Postings of a block, about; blocks of one part of a B id.
BLOCK_POSTINGS, PART_BLOCKS = 1 << 20, 1024
#: Documents of a block (their place in it has 16 bits).
BLOCK_DOCS = 1 << 16
#: Contributions that a task sums up before it passes them on.
BUFFER = 1 << 20
#: A posting: A id, document of the block, multiplicity (larger ones are split).
POSTING = np.dtype([("a", "<u4"), ("d", "<u2"), ("m", "<u2")])
SUMS = np.dtype([("d", "<u2"), ("best", "<i8"), ("total", "<i8")])

TOKENS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b int, block long, postings binary"
#: Texts without characters from here on, and without very long runs, take the fast encoder of the same vocabulary.
_PLAIN = re.compile("[^\x00-ɏ]")
_LONG_RUN = 2000


def _path(name: str, folder: str | None) -> str:
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteTokens:
    """Encoder A: byte-level BPE over a space and the text."""

    def __init__(self, folder: str | None):
        import public_tokenizers
        import tiktoken

        self.file, self._whole = _path(BYTE_BPE, folder), None
        with open(_path(BYTE_RANKS, folder), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 2)
        for word, rank in ranks.items():
            self.bytes[rank] = word

    @property
    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.file)
            self._whole.encode_special_tokens = True
        return self._whole

    def encode(self, text: str) -> list[int]:
        words = text.split()
        runs = max(map(len, words), default=0) > _LONG_RUN or len(text) - sum(map(len, words)) > 2 * len(words) + _LONG_RUN
        if runs or not text.isascii() and _PLAIN.search(text):
            return self.whole.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)


class PieceTokens:
    """Encoder B: BPE pieces with byte fallback; it adds the space itself."""

    def __init__(self, folder: str | None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=_path(PIECES, folder))
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Aligner:
    """Both encoders and what their ids stand for."""

    def __init__(self, folder: str | None):
        self.a, self.b = ByteTokens(folder), PieceTokens(folder)
        self.a_size, self.b_size = len(self.a.bytes), len(self.b.bytes)
        self.a_length, self.b_length = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        # an id's decimal number and what follows it inside a group or at its end
        self.shown = [f"{k}{c}" for side, size in ((",|", self.a_size), (",;", self.b_size)) for k in range(size) for c in side]

    def tokens(self, text: str):
        """(A ids, B ids) as lists, or None where the text has no tokens."""
        if not text:
            return None
        a, b, data = self.a.encode(text), self.b.encode(text), b" " + text.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != data or b"".join(map(self.b.bytes.__getitem__, b)) != data:
            return None
        return a, b

    def align(self, text: str):
        """(A ids, B ids, places of the links in each, the groups as text); None where the text has no tokens."""
        found = self.tokens(text)
        if found is None:
            return None
        a, b = (np.array(x, np.int64) for x in found)
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        place = np.full(a_ends[-1] + 1, -1, np.int64)
        place[b_ends] = np.arange(len(b))
        ends = place[a_ends]
        at_a = np.flatnonzero(ends >= 0)
        at_b = ends[at_a]
        # where a token stands when groups are written one after the other, A before B
        a_sizes, b_sizes = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        order[np.arange(len(a)) + np.repeat(at_b + 1 - b_sizes, a_sizes)] = a * 2 + last_a
        order[np.arange(len(b)) + np.repeat(at_a + 1, b_sizes)] = (b + self.a_size) * 2 + last_b
        return a, b, at_a, at_b, "".join(map(self.shown.__getitem__, order.tolist()))[:-1]


@lru_cache(1)
def aligner(folder: str | None = None) -> Aligner:
    return Aligner(folder)


def _tokenize(folder: str | None):
    """Every document as a row of its numbers, and blocks of postings by B id."""
    names = [x.split()[0] for x in TOKENS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def block(first: int, held: list):
        """Rows of postings of the documents from ``first`` on: per document its pairs (b * 2**32 + a) and their counts."""
        pairs = np.concatenate([p for _, p, _ in held])
        rows = np.zeros(len(pairs), POSTING)
        rows["a"], rows["d"] = pairs & 0xFFFFFFFF, np.repeat([d for d, *_ in held], [len(p) for _, p, _ in held])
        rows["m"] = np.concatenate([m for *_, m in held])
        order = np.argsort(pairs, kind="stable")
        rows, b = rows[order], pairs[order] >> 32
        starts = np.flatnonzero(np.diff(b, prepend=-1))
        data, edges = rows.tobytes(), np.append(starts, len(rows)) * POSTING.itemsize
        blobs = [data[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        n = len(starts)
        return [None] * n, [None] * n, [None] * n, [None] * n, [None] * n, [None] * n, [None] * n, b[starts], np.full(n, first), blobs

    def batch(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        tool, first, count, held, size = aligner(folder), TaskContext.get().partitionId() << 36, 0, [], 0
        for rows in batches:
            out = []
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                found = tool.align(text.as_py())
                if found is None:
                    out.append((first + count, doc_id, 0, 0, 0, 0, "", None, None, None))
                else:
                    a, b, at_a, at_b, shown = found
                    pairs, times = np.unique((b[at_b] << 32) + a[at_a], return_counts=True)
                    out.append((first + count, doc_id, len(a), len(b), len(at_a), len(at_a), hashlib.sha256(shown.encode()).hexdigest(), None, None, None))
                    while (times > 0xFFFF).any():
                        held.append((count, pairs[times > 0xFFFF], np.full((times > 0xFFFF).sum(), 0xFFFF)))
                        times = np.where(times > 0xFFFF, times - 0xFFFF, times)
                    held.append((count, pairs, times))
                    size += len(pairs)
                count += 1
                if size >= BLOCK_POSTINGS or count >= BLOCK_DOCS:
                    if held:
                        yield batch(block(first, held))
                    first, count, held, size = first + count, 0, [], 0
            if out:
                yield batch(zip(*out))
        if held:
            yield batch(block(first, held))

    return run


def _block_counts(batches):
    """Postings to one row per block and pair: b, a, n."""
    for rows in batches:
        for b, data in zip(rows.column(0).to_pylist(), rows.column(1)):
            found = np.frombuffer(data.as_buffer(), POSTING)
            starts = np.flatnonzero(np.diff(found["a"].astype(np.int64), prepend=-1))
            n = np.add.reduceat(found["m"].astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b, np.int32)), pa.array(found["a"][starts].astype(np.int32)), pa.array(n)], ["b", "a", "n"])


def _contributions(batches):
    """A sorted stream of an id's counts and then its blocks, to sums per block and document: block, sums."""
    held, size, counts, most = [], 0, None, 0

    def summed():
        block, row, best, total = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(row, kind="stable")
        starts = np.flatnonzero(np.diff(row[order], prepend=-1))
        block, sums = block[order][starts], np.zeros(len(starts), SUMS)
        sums["d"] = row[order][starts] - block
        sums["best"], sums["total"] = np.add.reduceat(best[order], starts), np.add.reduceat(total[order], starts)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        data, edges = sums.tobytes(), (np.append(first, len(sums)) * SUMS.itemsize).tolist()
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array([data[x:y] for x, y in zip(edges[:-1], edges[1:])], pa.binary())], ["block", "sums"])

    for rows in batches:
        columns = [rows.column(rows.schema.get_field_index(c)) for c in ("block", "postings", "pairs")]
        for first, data, pairs in zip(columns[0].to_pylist(), *columns[1:]):
            if first is None:
                fields = pairs.values
                a, n = fields.field("a").to_numpy(), fields.field("n").to_numpy()
                counts, most = np.zeros(a.max() + 1, np.int64), n.max()
                counts[a] = n
                continue
            found = np.frombuffer(data.as_buffer(), POSTING)
            m, n = found["m"].astype(np.int64), counts[found["a"]]
            held.append((np.full(len(found), first), first + found["d"].astype(np.int64), m * (n == most), m * n))
            size += len(found)
            if size >= BUFFER:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()


def _document_sums(batches):
    """Sums sorted by block to one row per document: row, n_best, count_sum."""
    block, best, total = None, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)

    def done():
        d = np.flatnonzero(total)
        out = pa.RecordBatch.from_arrays([pa.array(block + d), pa.array(best[d]), pa.array(total[d])], ["row", "n_best", "count_sum"])
        best[:], total[:] = 0, 0
        return out

    for rows in batches:
        for of, data in zip(rows.column(0).to_pylist(), rows.column(1)):
            if of != block and block is not None:
                yield done()
            block, found = of, np.frombuffer(data.as_buffer(), SUMS)
            best[found["d"]] += found["best"]
            total[found["d"]] += found["total"]
    if block is not None:
        yield done()


def align(docs: DataFrame, folder: str | None = None, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text).

    folder: where the vocabulary files are; by default the public ones'.
    """
    both = cut(mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _tokenize(folder), TOKENS))
    postings = both.where("b is not null").select("b", "block", "postings")
    pairs = mapped(postings.select("b", "postings"), _block_counts, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))
    counts = pairs.groupBy("b").agg(F.collect_list(F.struct("a", "n")).alias("pairs"))  # at most A's vocabulary
    parts = postings.groupBy("b").agg(F.ceil(F.count("*") / part_blocks).cast("int").alias("parts"))  # at most B's vocabulary
    dealt = postings.join(F.broadcast(parts), "b").select("b", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), "block", "postings", F.lit(None).cast(dict(counts.dtypes)["pairs"]).alias("pairs"))
    tables = counts.join(F.broadcast(parts), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("postings"), "pairs")
    streams = dealt.union(tables).repartition("b", "part").sortWithinPartitions("b", "part", F.col("block").asc_nulls_first())
    given = mapped(streams, _contributions, "block long, sums binary").repartition("block").sortWithinPartitions("block")
    sums = mapped(given, _document_sums, "row long, n_best long, count_sum long")
    numbers = both.where("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return numbers.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
