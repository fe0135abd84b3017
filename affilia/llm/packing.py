"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit. Every input partition keeps at most
``open_bins`` open sequences in a bitset keyed by free space: the best fit for
a piece is the lowest set bit at or above its length, found with two integer
operations. When one sequence too many is open, the fullest closes first.

Tokenising and packing run in one streaming pass over the input partitions:
nothing is shuffled, memory is bounded by the open sequences' counters and a
bounded word cache, and a lost executor costs only its own partitions, which
are recomputed alike (for an input whose partitions are read in a fixed order,
such as files).

Defined results: a null text is empty; an empty document is one piece that
holds only the end id; repeated rows are packed each; equal lengths go by
arrival; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from struct import pack as pack_ids

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, trim

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 512
VOCABULARY = "word_bpe_49k.json"
#: Entries of the word cache of one partition; when it is full it starts anew beside the one before.
CACHE_WORDS = 150_000

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"

#: Characters below this code are handled word by word; texts with others go to the tokenizer whole.
_SIMPLE = 0x250
#: White space on which the tokenizer and str.split() may differ, a letter whose lower case is two, special tokens.
UNUSUAL = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u0130", "<|")


#: How a vocabulary has to prepare texts for its words to be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(tokenizer) -> bool:
    """Whether this tokenizer prepares texts in the way that ``WordCache`` follows word by word."""
    state = lambda x: None if x is None else json.loads(x.__getstate__())
    added = tokenizer.get_added_tokens_decoder().values()
    return state(tokenizer.normalizer) == NORMALIZER and state(tokenizer.pre_tokenizer) == PRE_TOKENIZER and tokenizer.model.dropout is None and all(t.content.startswith("<|") for t in added)


def _char_class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(_SIMPLE) if test(unicodedata.category(chr(c))))


class WordCache(dict):
    """Encoded ids (little-endian uint32) of white-space separated words.

    For plain text this vocabulary's pre-tokenizer never joins two words, so a
    word's ids don't depend on its neighbours, and frequent words are encoded
    once per worker. Texts with unusual characters are encoded whole, and so
    are all texts with a vocabulary that prepares them in another way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.before: dict[str, bytes] = {}  # the words until the cache was last full; those still in use come over
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = by_words(self.tokenizer)
        trim()  # what parsing the file took
        letters, numbers = _char_class(lambda k: k[0] == "L"), _char_class(lambda k: k[0] == "N")
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")
        self.beyond = re.compile("[^\x00-\u024f]")
        # the printable stand-ins that byte-level vocabularies use for bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.byte_chars = {b: chr(256 + k) for k, b in enumerate(rest)}

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.byte_chars)
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        data = self.before.get(word)
        if data is not None:
            pass
        elif word.isalpha():
            data = self._part(word)
        elif word[:-1].isalpha():
            data = self[word[:-1]] + self[word[-1]]
        else:
            found = self.parts.findall(word)
            data = self._part(word) if found == [word] else b"".join(map(self.__getitem__, found))
        if len(self) >= CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = data
        return data

    def encode(self, text: str) -> bytes:
        lowered = text.lower()
        # what counts is the lower-cased text: some letters below _SIMPLE have lower cases beyond it
        if not self.by_words or any(x in text for x in UNUSUAL) or not lowered.isascii() and self.beyond.search(lowered):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return pack_ids(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, lowered.split()))


def word_cache(path: str | None = None) -> WordCache:
    """A cache for the vocabulary file ``path`` (default: the public word-BPE vocabulary)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return WordCache(path)


class OpenBins:
    """At most ``limit`` open sequences; their free space is a bitset."""

    def __init__(self, capacity: int, limit: int, first_id: int = 0):
        self.capacity, self.limit, self.next_id = capacity, limit, first_id
        self.free_bits, self.open, self.by_free = 0, 0, {}

    def place(self, length: int) -> tuple[int, int]:
        """(sequence id, offset) for a piece of 1 to ``capacity`` tokens."""
        fits = self.free_bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            bins = self.by_free[free]
            found = bins.pop()
            if not bins:
                self.free_bits ^= 1 << free
            self.open -= 1
        else:
            free, found = self.capacity, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            if not self.free_bits >> left & 1:
                self.free_bits |= 1 << left
                self.by_free[left] = []
            self.by_free[left].append(found)
            self.open += 1
            if self.open > self.limit:
                fullest = (self.free_bits & -self.free_bits).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.free_bits ^= 1 << fullest
                self.open -= 1
        return found, self.capacity - free


def _pack_partition(capacity: int, end_id: int, open_bins: int, vocabulary: str | None):
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches):
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 36)
        cache, end = word_cache(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = cache.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    held.append((doc_id, piece, at // 4, len(part) // 4, part, *bins.place(len(part) // 4)))
                    size += len(part)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their token ids (little-endian uint32) and place.

    docs: doc_id, text. Only documents longer than ``capacity`` tokens are cut.
    """
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _pack_partition(capacity, end_id, open_bins, vocabulary), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
