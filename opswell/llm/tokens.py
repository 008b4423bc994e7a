"""Token ids of whole texts, batch by batch: distinct words are encoded once and their ids gathered."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time, bytes of words and their ids that are remembered from one slab to the next, and those of
#: an entry in their dictionary.
SLAB = 4 << 20
REMEMBERED = 64 << 20
ENTRY = 100

# A word of Latin letters between signs. Its three parts are encoded apart by every tokenizer here, as signs and letters
# never share a token; a leading apostrophe could, so it is not taken.
_PARTS = r"^(?P<a>[!-&(-/:-@\[-`{-~]*)(?P<b>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<c>[!-/:-@\[-`{-~]*)$"


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the slices [start, start + length) one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def whole(texts: pa.Array, most: int = SLAB):
    """Runs of rows of about `most` bytes of text; texts stay whole."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    first = 0
    while first < len(texts):
        until = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right")))
        yield np.arange(first, until), texts.slice(first, until - first)
        first = until


def slabs(texts: pa.Array, most: int = SLAB):
    """(rows, array of texts) of at most `most` bytes; a longer text comes alone, cut at white space into several with the same row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.asarray(pc.binary_length(texts))
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > most and i > first:
            yield np.arange(first, i), texts.slice(first, i - first)
            first, held = i, 0
        if n > most:
            whole, at = texts[i].as_py(), 0
            while at < len(whole):
                cut = re.compile(r"[ \n\t\r]").search(whole, at + most // 4)
                end = cut.end() if cut else len(whole)
                yield np.array([i]), pa.array([whole[at:end]], pa.large_string())
                at = end
            first, held = i + 1, 0
        else:
            held += int(n)
    if first < len(sizes):
        yield np.arange(first, len(sizes)), texts.slice(first)


class Store:
    """Ids of strings, each string's as one binary, found by the strings themselves; what is remembered is not hashed again."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids = pa.array([], pa.large_binary())
        self.bytes = 0

    def find(self, names: pa.Array, learn: Callable[[list[str]], pa.Array]) -> np.ndarray:
        """Places in `ids` of distinct strings. Those that are not known are given to `learn` and remembered."""
        words = names.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            some = [words[i] for i in new]
            ids, first = learn(some), len(self.ids)
            self.ids = pa.concat_arrays([self.ids, ids])
            self.known.update(zip(some, range(first, len(self.ids))))
            at[new] = np.arange(first, len(self.ids))
            self.bytes += ids.nbytes + sum(map(getsizeof, some)) + ENTRY * len(some)
        return at


class Encoder:
    """Ids by a tokenizer file whose normalizer and splitter never look across ASCII white space (as word_bpe_49k)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers as P

        self.whole = Tokenizer.from_file(path)
        # For parts that are already in lower case and split: the same model and byte alphabet.
        self.part = Tokenizer(self.whole.model)
        self.part.pre_tokenizer = P.Sequence([P.WhitespaceSplit(), P.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self):
        self.parts, self.others = Store(), Store()

    def _learn_parts(self, names: list[str]) -> pa.Array:
        """Ids of parts of words, which hold no white space, many in one call."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(names), 1000):
            some = names[i : i + 1000]
            e = self.part.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.asarray(e.ids, np.uint32))
            # An empty part has no ids and no number in the joined text.
            full = np.array([bool(x) for x in some])
            n = np.zeros(len(some), np.int64)
            n[full] = np.bincount(np.asarray(e.word_ids, np.int64), minlength=int(full.sum()))
            lengths.append(n)
        return binaries(np.concatenate(ids), np.concatenate(lengths))

    def _learn_others(self, names: list[str]) -> pa.Array:
        encoded = [e.ids for e in self.whole.encode_batch(names, add_special_tokens=False)]
        return binaries(np.array([i for ids in encoded for i in ids], np.uint32), np.array([len(ids) for ids in encoded], np.int64))

    def _ids(self, words: pa.Array) -> pa.Array:
        """The ids of each distinct word, as a binary."""
        if self.parts.bytes + self.others.bytes > REMEMBERED:
            self.forget()
        found = pc.extract_regex(words, _PARTS)
        simple = pc.and_(found.is_valid(), pc.invert(pc.match_substring(words, "<|")))
        found = found.filter(simple)
        split = [found.field(0), pc.utf8_lower(found.field(1)), found.field(2)]
        d = pa.concat_arrays([s.cast(pa.large_string()) for s in split]).dictionary_encode()
        at = self.parts.find(d.dictionary, self._learn_parts)[np.asarray(d.indices)].reshape(3, -1)
        joined = pc.binary_join_element_wise(*(self.parts.ids.take(pa.array(a)) for a in at), pa.scalar(b"", pa.large_binary()))
        at = self.others.find(words.filter(pc.invert(simple)), self._learn_others)
        # Words of parts come first; each word takes its place among them or behind them.
        simple = np.asarray(simple)
        place = np.where(simple, np.cumsum(simple) - 1, len(joined) + np.cumsum(~simple) - 1)
        return pa.concat_arrays([joined, self.others.ids.take(pa.array(at))]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has. Null is empty."""
        counts, out = np.zeros(len(texts), np.int64), []
        for rows, slab in slabs(texts):
            lists = pc.ascii_split_whitespace(slab)
            d = lists.flatten().dictionary_encode()
            if not len(d):
                continue
            ids = self._ids(d.dictionary).take(d.indices)
            ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8) // 4
            out.append(np.frombuffer(ids.buffers()[2] or b"", "<u4")[ends[0] : ends[-1]])
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            np.add.at(counts, rows, np.diff(ends[offsets]))
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the id `end` to each text's ids."""
    n = counts + 1
    out = np.full(int(n.sum()), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(n) - 1] = False
    out[keep] = ids
    return out, n


def binaries(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary per text: its ids as little-endian unsigned 32-bit integers."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
