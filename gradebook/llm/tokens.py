"""Words of whole Arrow batches as numpy arrays: the small helper under the word operators.

Texts are looked at as UTF-8 bytes. Both word classes in use are sets of bytes (every
byte of a non-ASCII character counts as a word byte), so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Words of more bytes are hashed by a digest.
LONG_WORD = 32
#: Bytes worked on at once; a longer text is a piece of its own.
PIECE = 1 << 19

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: ``[^\x20\x09-\x0D]`` and ``[0-9a-z\x80-]`` after lower-casing A-Z.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. n - 1`` modulo 2^64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = max(n, PIECE + 1)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = _powers[int(base)] = np.cumprod(known)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * BASE
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    """Words of one piece. ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, a: int, b: int) -> str:
        """Words a .. b - 1 with one space between them."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])).decode("utf-8", "replace")


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, "right")) - 1)
        yield at, whole[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        at = to
    pa.default_memory_pool().release_unused()


def words_of(data: np.ndarray, bounds: np.ndarray, word_byte: np.ndarray) -> Words:
    """Lower-cased (A-Z) maximal runs of word bytes, never across texts."""
    data = LOWER[data]
    n = len(data)
    inside = word_byte[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.concatenate(([False], inside))[:n]
    after = np.concatenate((inside, [False]))[1:n + 1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(BASE, n), out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * powers(INVERSE, n + 1)[start] + (end - start).astype(np.uint64))
    # A sum of powers modulo 2^64 is the same for some long words that are made for it; those get a digest.
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(data, start, end, hashes, np.searchsorted(start, bounds))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether they lie in one text)."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = words.hash[:n - k + 1].copy()
    for j in range(1, k):
        h = h * _STEP + words.hash[j:n - k + 1 + j]
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    return mixed(h + np.uint64(k)), text[:n - k + 1] == text[k - 1:]
