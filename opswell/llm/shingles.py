"""Sets of word shingles of whole texts as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time.
SLAB = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the non-empty strings that stand in the bytes one after the other.

    Eight bytes at a time are mixed with their place in the string before they are
    added up, so that no sum of bytes by places can be equal for different strings
    but by chance.
    """
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    first = np.flatnonzero((place & 7) == 0)
    eight = np.add.reduceat(data.astype(np.uint64) << ((place & 7).astype(np.uint64) << np.uint64(3)), first)
    number = (place[first] >> 3).astype(np.uint64)
    mixed = mix64(eight ^ mix64((number + np.uint64(1)) * _ODD))
    blocks = (lengths + 7) // 8
    return mix64(np.add.reduceat(mixed, np.cumsum(blocks) - blocks) ^ mix64(lengths.astype(np.uint64)))


def _hashes(b: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word in the bytes; a word also ends before each position of `breaks`."""
    space = _SPACE[b]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(b))]
    begins[inner] = ~space[inner]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), at
    letters = _LOWER[b[~space]]
    # Letters before each word begins, so that words that touch at a break stay apart.
    before = np.cumsum(~space)[at] - 1
    return hashes(letters, np.diff(np.append(before, len(letters)))), at


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, of all texts one after the other, and how many each text has. Null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, counts = [], np.zeros(n, np.int64)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        until = min(end, at + SLAB)
        # A slab ends where a word ends, or a text.
        stop = int(offsets[np.searchsorted(offsets, until)])
        while until < stop:
            space = np.flatnonzero(_SPACE[data[until : min(stop, until + SLAB)]])
            if len(space):
                until += int(space[0])
                break
            until = min(stop, until + SLAB)
        h, where = _hashes(data[at:until], offsets - at)
        out.append(h)
        np.add.at(counts, np.searchsorted(offsets, where + at, "right") - 1, 1)
        at = until
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words, and how many each text has.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    words, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    sets, sizes = [], np.zeros(len(counts), np.int64)
    salt = [mix64(np.array([k + 1], np.uint64) * _ODD) for k in range(width)]
    for i, (s, n) in enumerate(zip(starts.tolist(), counts.tolist())):
        if not n:
            continue
        w, k = words[s : s + n], min(n, width)
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += mix64(w[j : n - k + 1 + j] ^ salt[j])
        own = np.unique(mix64(h + np.uint64(k)))
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes
