"""Word shingles of many texts at once: exact copies, and the smallest shingle hashes of each."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str) -> list[str]:
    """The words of a text: case, spacing, line breaks and punctuation don't count."""
    if "-\n" in text:
        text = text.replace("-\n", "")
    return _WORD.findall(text.lower())


class Hashes(dict):
    """The 64-bit hash of each word, worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashed: np.ndarray, width: int = 5) -> np.ndarray:
    """The hash of each run of ``width`` words (of the whole text, if it is shorter)."""
    n = max(1, len(hashed) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(hashed))):
        out += hashed[k : k + n] * _ODD[k % len(_ODD)]
    return _mixed(out)


def smallest(texts: list[str], size: int, hashes: Hashes) -> list[tuple[bytes, int, np.ndarray]]:
    """(digest of the words, their number, the ``size`` smallest distinct shingle hashes) of each text.

    A text without words has none. All texts' shingles are hashed and sorted together.
    """
    return sketched(texts, size, hashes)[0]


def occurrences(hashed: np.ndarray) -> np.ndarray:
    """The words' hashes with the same word's second, third ... occurrence told apart, sorted."""
    x = np.sort(hashed)
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))[: len(x)]
    nth = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
    return np.sort(_mixed(x + nth.astype(np.uint64) * _ODD[0]))


def parities(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Four 64-bit words a text: whether an odd number of its words falls on each of 256 bits.

    Two texts differ in no more bits than their bags of words in words.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = owner * 256 + ((flat >> np.uint64(20)) & np.uint64(255)).astype(np.int64)
    odd = np.bincount(at, minlength=256 * len(lengths)).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(-1, 4)


def sketched(texts: list[str], size: int, hashes: Hashes) -> tuple[list[tuple[bytes, int, np.ndarray]], np.ndarray, np.ndarray]:
    """What ``smallest`` gives; beside it the hashes of all texts' words, and the number of each text's."""
    split = [words(t) for t in texts]
    lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    digests = [xxhash.xxh3_128_digest(flat[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    many = np.maximum(lengths - 4, np.minimum(lengths, 1))
    padded = np.concatenate([flat, np.zeros(5, dtype=np.uint64)])
    all_hashes = shingle_hashes(padded, 5)[: len(flat)]
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(flat)) - starts[owner]
    inside = place < many[owner]
    # a text of few words is one shingle, whatever follows it
    for i in np.flatnonzero((lengths > 0) & (lengths < 5)):
        all_hashes[starts[i]] = shingle_hashes(flat[starts[i] : starts[i] + lengths[i]], 5)[0]
    # only hashes low enough to be among the smallest are sorted; texts left with too few are done again
    bound = np.where(many > 4 * size, np.floor(2.0**64 * np.minimum(1.0, 2.5 * size / np.maximum(many, 1))), 2.0**64)
    low = inside & (all_hashes.astype(np.float64) < bound[owner])
    out: list[np.ndarray] = []
    h, o = all_hashes[low], owner[low]
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[fresh], o[fresh]
    begin, end = np.searchsorted(o, np.arange(len(texts))), np.searchsorted(o, np.arange(len(texts)), side="right")
    for i in range(len(texts)):
        own = h[begin[i] : end[i]]
        if len(own) < size and many[i] > 4 * size:
            own = np.unique(all_hashes[starts[i] : starts[i] + many[i]])
        out.append(own[:size])
    return [(d, int(n), s) for d, n, s in zip(digests, lengths, out, strict=True)], flat, lengths
