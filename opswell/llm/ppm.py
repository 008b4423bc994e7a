"""Prediction by partial matching: code lengths of texts by a byte-context trie over the whole training corpus.

The trie's levels are the counts of a byte after its last 0 to ORDER bytes. A byte
that was not seen after a context costs an escape (distinct bytes seen there against
all bytes seen there) and is sought after the next shorter one, without the bytes the
longer one has had. As those are always a part of the shorter one's, what is left
of a context depends on itself and the context one byte longer alone.

A text's probability depends on its runs of ORDER + 1 bytes only. So groups of texts
of a bounded size ask once for each run they hold, the trie is walked once for each
distinct run of the corpus, and the answers go back to the groups.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from opswell.session import settle

#: Bytes of the longest context. Runs that share their last two context bytes meet in one place: 2 ** 24 runs at most.
ORDER = 4
#: Bytes that no UTF-8 text holds: what stands before a text, and its end.
BEFORE, END = b"\xfe", b"\xff"
SYMBOLS = 256
#: Bytes of text that are worked on at a time, and of a group; a text longer than a part is cut at white space into several.
PART, GROUP = 4 << 20, 24 << 20
#: A longer word is named by its hash.
WORD = 64
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Runs that are walked through the trie in one go, and those of one pair of last context bytes more.
WALK = 1 << 20

PARTS = pa.schema(
    [
        ("group", pa.int64()), ("part", pa.int64()), ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
        ("size", pa.list_(pa.int64())), ("last", pa.list_(pa.bool_())), ("packed", pa.binary()),
        ("runs", pa.list_(pa.int64())), ("run_counts", pa.list_(pa.int64())), ("words", pa.list_(pa.binary())), ("word_counts", pa.list_(pa.int64())),
    ]
)
PART_COLUMNS = (
    "group long, part long, row array<long>, doc_id array<long>, held_out array<boolean>, size array<long>, last array<boolean>, packed binary,"
    " runs array<long>, run_counts array<long>, words array<binary>, word_counts array<long>"
)


def held_out(c: str = "doc_id") -> Column:
    """True for the seventh of doc_ids that are not learned from; a null doc_id is learned from."""
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def cut(text: bytes, most: int) -> list[tuple[bytes, bytes, bool]]:
    """(the ORDER bytes before, the bytes, whether the text ends) of a text's pieces; words stay whole."""
    out, at = [], 0
    while True:
        found = SPACE.search(text, at + most) if len(text) - at > most else None
        end = found.end() if found else len(text)
        before = text[max(0, at - ORDER) : at]
        out.append((BEFORE * (ORDER - len(before)) + before, text[at:end], end == len(text)))
        if end == len(text):
            return out
        at = end


def runs_of(padded: bytes, sizes: np.ndarray) -> pa.DictionaryArray:
    """The run that ends at each byte but the first ORDER of each piece, as a number with its last byte lowest."""
    x = np.frombuffer(padded, np.uint8)
    codes = np.zeros(max(0, len(x) - ORDER), np.int64)
    for i in range(ORDER + 1):
        codes <<= 8
        codes |= x[i : len(x) - ORDER + i]
    own = np.ones(len(codes), bool)
    later = np.cumsum(sizes + ORDER)[:-1]  # where the other pieces begin
    own[(later[:, None] - np.arange(ORDER) - 1).ravel()] = False
    return pa.array(codes[own]).dictionary_encode()


def words_of(bodies: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all pieces one after the other, and how many each has."""
    b = pa.array(bodies, pa.large_binary())
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(b), b.buffers()))
    words = lists.flatten()
    full = np.asarray(pc.binary_length(words)) > 0
    piece = np.repeat(np.arange(len(bodies)), np.diff(np.asarray(lists.offsets)))
    return words.filter(pa.array(full)).dictionary_encode(), np.bincount(piece[full], minlength=len(bodies))


def _named(words: pa.Array) -> list[bytes]:
    """The words' bytes; of a long word a zero byte and a hash, which is longer than a name that is its own and no shorter word."""
    names = [w.as_buffer().to_pybytes() if w.is_valid else b"" for w in words]
    return [w if len(w) <= WORD else b"\0" * (WORD - 31) + hashlib.sha256(w).digest() for w in names]


class Dictionary:
    """The distinct runs, and the distinct words, of a group's parts; their places are the same whenever the parts are read in order."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, pa.Array]] = []

    def add(self, runs: pa.DictionaryArray, words: pa.DictionaryArray):
        self.parts.append((runs.dictionary.to_numpy(), words.dictionary))

    def runs(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The runs in order, and the place of each part's."""
        every = np.unique(np.concatenate([r for r, _ in self.parts]))
        return every, [np.searchsorted(every, r) for r, _ in self.parts]

    def words(self) -> tuple[pa.Array, list[np.ndarray]]:
        every = pa.concat_arrays([w for _, w in self.parts]).dictionary_encode()
        ends = np.cumsum([0, *(len(w) for _, w in self.parts)])
        at = np.asarray(every.indices)
        return every.dictionary, [at[a:b] for a, b in zip(ends, ends[1:])]


def _parts(most: int, most_of_group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = row = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        known, ends, bytes_, of_group = Dictionary(), 0, 0, 0

        def one(**values):
            return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in PARTS], schema=PARTS)

        def part():
            rows, docs, out, heads, bodies, last = zip(*held)
            padded = b"".join(h + b + (END if e else b"") for h, b, e in zip(heads, bodies, last))
            sizes, trained = np.array([len(b) for b in bodies], np.int64) + np.array(last), ~np.array(out)
            runs, (words, n) = runs_of(padded, sizes), words_of(bodies)
            known.add(runs, words)
            tally = lambda d, n: np.bincount(np.asarray(d.indices)[np.repeat(trained, n)], minlength=len(d.dictionary))
            counts.append((tally(runs, sizes), tally(words, n)))
            packed = zstandard.ZstdCompressor().compress(padded)
            return one(group=group, part=len(counts), row=rows, doc_id=docs, held_out=out, size=sizes, last=last, packed=packed)

        def whole():
            (runs, run_places), (words, word_places) = known.runs(), known.words()
            of_runs, of_words = np.zeros(len(runs), np.int64), np.zeros(len(words), np.int64)
            for (r, w), a, b in zip(counts, run_places, word_places):
                of_runs[a] += r
                of_words[b] += w
            # The end of a text is the word without letters.
            return one(group=group, runs=runs, run_counts=of_runs, words=[*_named(words), b""], word_counts=[*of_words.tolist(), ends])

        for batch in batches:
            for doc, out, text in zip(*(batch.column(c) for c in ("doc_id", "held_out", "text"))):
                out, body = out.as_py(), (text.as_buffer().to_pybytes() if text.is_valid else b"").lower()
                for piece in cut(body, most):
                    held.append((row, doc.as_py(), out, *piece))
                    ends += piece[2] and not out
                    bytes_ += len(piece[1])
                    if bytes_ >= most:
                        yield part()
                        held, bytes_, of_group = [], 0, of_group + bytes_
                    if of_group >= most_of_group:
                        yield whole()
                        group, known, counts, ends, of_group = group + 1, Dictionary(), [], 0, 0
                row += 1
        if held:
            yield part()
        if counts:
            yield whole()

    return run


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def _at(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sought numbers among sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    i = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return i, keys[i] == sought


class Level:
    """The trie's contexts of one length: bytes seen after them, how often, and what the next shorter context has of them."""

    def __init__(self, order: int, edges: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.edges, self.counts, self.mask = edges, counts, (1 << 8 * (order + 1)) - 1
        self.contexts, self.total = _sums(edges >> 8, counts)
        self.distinct = _sums(edges >> 8, np.ones(len(edges), np.int64))[1]
        if shorter is None:
            self.shared = np.zeros(len(self.contexts), np.int64)
        else:
            i, _ = _at(shorter.edges, edges & shorter.mask)
            self.shared = _sums(edges >> 8, shorter.counts[i])[1] if len(edges) else np.zeros(0, np.int64)


def log_probabilities(runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each run's last byte after the others.

    runs: all runs, seen in training or not, that share the last two context bytes
    with any of them. counts: how often each was seen. pairs: SYMBOLS * SYMBOLS
    counts of a byte after another one, in the whole corpus.
    """
    levels: dict[int, Level] = {}
    for order in range(ORDER + 1):
        if order < 2:
            by_pair = pairs.reshape(SYMBOLS, SYMBOLS).sum(axis=0) if order == 0 else pairs
            edges = np.flatnonzero(by_pair)
            sums = by_pair[edges]
        else:
            edges, sums = _sums((runs & ((1 << 8 * (order + 1)) - 1))[counts > 0], counts[counts > 0])
        levels[order] = Level(order, edges, sums, levels.get(order - 1))
    out, sought = np.zeros(len(runs)), np.ones(len(runs), bool)
    gone, gone_distinct = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
    for order in range(ORDER, -1, -1):
        level = levels[order]
        node, known = _at(level.contexts, (runs & level.mask) >> 8)
        edge, seen = _at(level.edges, runs & level.mask)
        if not known.any():
            continue
        total, distinct = level.total[node] - gone, level.distinct[node] - gone_distinct
        here = sought & known & (distinct > 0)
        hit, miss = here & seen, here & ~seen
        out[hit] += np.log10(level.counts[edge[hit]] / (total[hit] + distinct[hit]))
        out[miss] += np.log10(distinct[miss] / (total[miss] + distinct[miss]))
        sought &= ~hit
        gone, gone_distinct = np.where(known, level.shared[node], 0), np.where(known, level.distinct[node], 0)
    out[sought] -= np.log10(SYMBOLS - len(levels[0].edges)) if sought.any() else 0
    return out


def _walk(pairs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def some(columns):
            runs, counts = columns
            logs = log_probabilities(runs, counts, pairs)
            return pa.RecordBatch.from_arrays([pa.array(runs), pa.array(logs)], ["run", "value"])

        for batch in batches:
            runs, counts = (batch.column(c).to_numpy() for c in ("run", "n"))
            held.append((runs, counts))
            size += len(runs)
            if size >= WALK:
                runs, counts = (np.concatenate(c) for c in zip(*held))
                # Runs of the last pair of context bytes may still come.
                last = (runs >> 8) & 0xFFFF
                ends = int(np.flatnonzero(last != last[-1])[-1]) + 1 if (last != last[-1]).any() else 0
                if ends:
                    yield some((runs[:ends], counts[:ends]))
                held, size = [(runs[ends:], counts[ends:])], len(runs) - ends
        if size:
            yield some(tuple(np.concatenate(c) for c in zip(*held)))

    return run


SCORES = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def _scores(train_tokens: int, vocabulary: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word, at, value = (right.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("is_word", "at", "value"))
        tables = []
        for kind in (False, True):
            table = np.zeros(int((is_word == kind).sum()))
            table[at[is_word == kind]] = value[is_word == kind]
            tables.append(table)
        logs, seen = tables
        known, read, found = Dictionary(), [], []
        for i in np.argsort(left.column("part").to_numpy()).tolist():
            row, doc, out, size, last, packed = (left.column(c)[i].as_py() for c in ("row", "doc_id", "held_out", "size", "last", "packed"))
            padded, size, last = zstandard.ZstdDecompressor().decompress(packed), np.array(size, np.int64), np.array(last)
            ends = np.cumsum(size + ORDER)
            runs, (words, n) = runs_of(padded, size), words_of([padded[b - s : b - e] for b, s, e in zip(ends.tolist(), size.tolist(), last.tolist())])
            known.add(runs, words)
            read.append((row, doc, out, size, last, np.asarray(runs.indices), np.asarray(words.indices), n))
        for (row, doc, out, size, last, runs, words, n), of_runs, of_words in zip(read, known.runs()[1], known.words()[1]):
            score = np.bincount(np.repeat(np.arange(len(row)), size), logs[of_runs][runs], len(row))
            counts = np.append(seen[of_words][words], np.full(int(last.sum()), seen[-1]))
            piece = np.append(np.repeat(np.arange(len(row)), n), np.flatnonzero(last))
            base = np.bincount(piece, np.log10((counts + 1) / (train_tokens + vocabulary + 1)), len(row))
            some = np.bincount(piece, counts > 0, len(row)).astype(np.int64)
            found.append(pa.Table.from_arrays([pa.array(v, t) for v, t in zip((row, doc, out, n + last, some, base, score), SCORES.types)], schema=SCORES))
        return pa.concat_tables(found)

    return run


def score(docs: DataFrame, part: int = PART, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text).

    Learned from the rows that are not held_out(). Null texts are empty; A-Z counts
    as lower case. Tokens are words between ASCII white space and one end per text.
    base_score: by counts of single tokens, plus one. score: by the trie, over the
    text's bytes and its end; an empty text has that of an end alone. Repeated rows
    are learned from and scored each. Where nothing is learned, every byte costs the
    same. Without rows the result is empty.

    Texts are written once, compressed, and moved once, to their groups' answers.
    Questions and answers are as many as distinct runs and words in each group. Runs
    with the same last two context bytes meet in one task, once each whatever their
    number of places: at most 2 ** 24 by their nature. A word's rows are one for each
    group that has it.
    """
    parts = settle(docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_parts(part, group), PART_COLUMNS))
    whole = parts.filter("runs IS NOT NULL")
    asked = lambda names, counts: whole.select("group", F.posexplode(F.arrays_zip(names, counts)).alias("at", "_")).select("group", "at", F.col(f"_.{names}").alias("name"), F.col(f"_.{counts}").alias("n"))
    runs, words = asked("runs", "run_counts"), asked("words", "word_counts")

    same = Window.partitionBy("name")
    total, first = F.sum("n").over(same).alias("total"), F.min(F.struct("group", "at")).over(same) == F.struct("group", "at")
    counted = settle(words.select("group", "at", total, first.alias("first")))
    tokens = counted.filter("first AND total > 0").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("kinds")).first()

    every = settle(runs.groupBy("name").agg(F.sum("n").alias("n")))
    # At most SYMBOLS * SYMBOLS rows.
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for r in every.filter("n > 0").groupBy(F.col("name").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():
        pairs[r.pair] = r.n
    context = F.shiftright("name", 8).bitwiseAND(0xFFFF)
    dealt = every.select(F.col("name").alias("run"), "n", context.alias("context")).repartition("context").sortWithinPartitions("context", "run")
    logs = settle(dealt.select("run", "n").mapInArrow(_walk(pairs), "run long, value double"))

    answers = runs.join(logs, F.col("name") == F.col("run")).select("group", F.lit(False).alias("is_word"), "at", "value")
    known = counted.select("group", F.lit(True).alias("is_word"), "at", F.col("total").cast("double").alias("value"))
    texts = parts.filter("packed IS NOT NULL").select(F.col("group").alias("of"), "part", "row", "doc_id", "held_out", "size", "last", "packed")
    found = texts.groupBy("of").cogroup(answers.unionByName(known).groupBy("group")).applyInArrow(
        _scores(tokens.n, tokens.kinds), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    scored = found.groupBy("row", "doc_id", "held_out").agg(*sums)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens.n).cast("long").alias("train_tokens"), "base_score", "score")
