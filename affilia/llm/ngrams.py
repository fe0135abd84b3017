"""Hashed character n-grams and word hashes of whole texts, vectorised over batches."""

from __future__ import annotations

import numpy as np

#: Hash slots of the character n-grams and their longest length.
SLOTS = 1 << 15
LONGEST = 3


def _slot(codes: np.ndarray, shift: int) -> np.ndarray:
    return (codes * np.uint32(2654435761)) >> np.uint32(shift)


def gram_counts(texts, slots: int = SLOTS, longest: int = LONGEST, limit: int = 1 << 20):
    """(row, slots in use, their counts) for every text; the grams at its end run into two end marks."""
    shift, pad = 33 - slots.bit_length(), "\0" * (longest - 1)
    held, size, first = [], 0, 0

    def flush():
        codes = np.frombuffer((pad.join(held) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
        grams, code, last = [], np.zeros(len(codes) - longest + 1, np.uint32), len(codes) - longest + 1
        for n in range(longest):
            code = code * np.uint32(0x01000193) + codes[n : n + last] + np.uint32(0x9E3779B9)
            grams.append(_slot(code ^ (code >> np.uint32(15)), shift).astype(np.int32))
        at = 0
        for row, text in enumerate(held, first):
            counts = np.bincount(np.concatenate([g[at : at + len(text)] for g in grams]), minlength=slots)
            used = np.flatnonzero(counts)
            yield row, used, counts[used]
            at += len(text) + len(pad)

    for row, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > limit:
            yield from flush()
            held, size, first = [], 0, row
        held.append(text)
        size += len(text)
    if held:
        yield from flush()


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, up to ``length``."""
    if not _powers or len(_powers[0]) <= length:
        with np.errstate(over="ignore"):
            both = [np.full(length + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
            for p in both:
                p[0] = 1
                np.cumprod(p, out=p)
        _powers[:] = both
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """Sums of value(byte) * base**position before every position, modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def word_hashes(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, and each text's first word."""
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    space = _IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    sums = prefix_sums(_LOWER[data])
    hashes = mixed((sums[ends] - sums[starts]) * powers(len(data))[1][starts])
    offsets = np.cumsum([0] + [len(x) + 1 for x in held])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(held: list[bytes], words: int):
    """For every text its sorted set of hashed shingles of ``words`` words (fewer words: one shingle)."""
    hashes, first = word_hashes(held)
    rolled = mixed(hashes + np.uint64(words))
    if words > 1:
        last = max(0, len(hashes) - words + 1)
        rolled = rolled[:last]
        for n in range(1, words):
            rolled = mixed(rolled * np.uint64(_BASE) + hashes[n : n + last])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            h = mixed(hashes[a : a + 1] + np.uint64(b - a))
            for n in range(a + 1, b):
                h = mixed(h * np.uint64(_BASE) + hashes[n : n + 1])
            yield h
        else:
            yield hashes[:0]
