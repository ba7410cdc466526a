"""Word shingles of many texts at once, as numpy arrays.

Words are runs without white space, lower-cased. A word's 64-bit hash sums random values of its
bytes times powers of an odd number; a shingle's combines those of five words in a row and is
mixed down to 48 bits. A text with one to four words has one shingle of them all; a text
without words has none. Texts of one call are hashed together, so there is no Python work for
a word.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
HASH_BITS = 48
#: Texts of one call: their number in the call is kept beside the hash in 64 bits.
MOST_TEXTS = 1 << (64 - HASH_BITS)

_random = np.random.Generator(np.random.PCG64(27))
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; every bit of x changes half of the result."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of its text, and the hash, of every word in order."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
    solid = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid)).view(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = stops - starts
    inside = np.flatnonzero(solid)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    values = _BYTES[data[inside]] * _powers(_BASE, int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, first))
    ends = np.cumsum([len(c) + 1 for c in coded])
    return np.searchsorted(ends, starts, "right"), hashes


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, those of a text in its order; short texts come last."""
    text, words = word_hashes(texts)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    powers = _powers(_STEP, WORDS)
    last = max(0, n - WORDS + 1)
    total = np.zeros(last, np.uint64)
    for k in range(WORDS):
        total += words[k : k + last] * powers[k]
    whole = text[:last] == text[WORDS - 1 :] if last else np.zeros(0, bool)
    of, hashed = text[:last][whole], mix(total[whole])
    counts = np.bincount(text, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        firsts = np.searchsorted(text, short)
        few = np.array([mix((words[a : a + c] * powers[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c))[0] for a, c in zip(firsts, counts[short], strict=True)])
        of, hashed = np.concatenate((of, short)), np.concatenate((hashed, few))
    return of, hashed >> np.uint64(64 - HASH_BITS)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of each distinct shingle of each text, sorted by text and hash."""
    of, hashed = windows(texts)
    if not len(of):
        return of, hashed, np.zeros(0, np.int64)
    packed = np.sort((of.astype(np.uint64) << np.uint64(HASH_BITS)) | hashed)
    fresh = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    times = np.diff(np.concatenate((fresh, [len(packed)])))
    packed = packed[fresh]
    return (packed >> np.uint64(HASH_BITS)).astype(np.int64), packed & np.uint64((1 << HASH_BITS) - 1), times
