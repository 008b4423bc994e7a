"""Best-fit packing of token sequences in bulk-synchronous rounds over sizes; items find their places by their ranks."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from opswell.llm import tokens
from opswell.operators.segments import Ordered
from opswell.session import settle

#: Tokens of a sequence.
CAPACITY = 2048

PIECES = "piece_key long, doc_id long, piece int, start long, length long, ids binary"


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for rows, texts in tokens.whole(batch.column("text")):
                part = batch.slice(rows[0], len(rows))
                ids, counts = tokens.with_end(*tokens.encoder(path).encode(texts), end)
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(counts[row] - piece * capacity, capacity)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + np.arange(len(row))),
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(piece * capacity),
                        pa.array(length),
                        tokens.binaries(ids, length).cast(pa.binary()),
                    ],
                    [f.split()[0] for f in PIECES.split(", ")],
                )
                key += len(row)

    return run


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The token ids of docs (doc_id, text), `end` after each text, cut into pieces of at most `capacity`, each with a key of its own."""
    return settle(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end, capacity), PIECES))


class Plan:
    """Best-fit decreasing over counts of equal sizes.

    A round takes the items of one size, the largest first, all at once. They
    propose to their successor, the smallest room that holds them, in the order of
    their ranks: a sequence takes as many as it holds, then the next sequence of that
    room does, then the next larger room, and items without a successor open
    sequences. Rooms are updated and the next size follows. This is what placing item
    after item does, but sequences that have had the same history are one run of
    numbers, and a round splits at most two runs.

    places: per run of items of one size (size, first rank, first sequence, items in
    each sequence, offset of the first). A size splits few runs and a sequence holds
    at most sqrt(2 * capacity) different sizes, so the places are bounded by the
    capacity, however many items there are: by some 650,000 for 2,048 tokens.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.places: list[tuple[int, int, int, int, int]] = []
        # Runs (first sequence, how many) by room.
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        for size in sorted(counts, reverse=True):
            self._round(size, counts[size])

    def _add(self, room: int, first: int, n: int):
        if room and n:
            if room not in self.gaps:
                self.gaps[room] = []
                insort(self.rooms, room)
            self.gaps[room].append((first, n))

    def _take(self, size: int) -> tuple[int, int, int]:
        """A run of the smallest room that holds the size, as (room, first sequence, how many)."""
        room = self.rooms[bisect_left(self.rooms, size)]
        first, n = self.gaps[room].pop()
        if not self.gaps[room]:
            del self.gaps[room]
            self.rooms.remove(room)
        return room, first, n

    def _round(self, size: int, items: int):
        rank, waiting = 0, []
        while rank < items:
            left = items - rank
            if bisect_left(self.rooms, size) < len(self.rooms):
                room, first, n = self._take(size)
            else:
                room, first, n = self.capacity, self.sequences, -(-left // (self.capacity // size))
                self.sequences += n
            each = room // size
            full, rest = divmod(min(left, n * each), each)
            if full:
                self.places.append((size, rank, first, each, self.capacity - room))
                waiting.append((room - each * size, first, full))
            if rest:
                self.places.append((size, rank + full * each, first + full, rest, self.capacity - room))
                waiting.append((room - rest * size, first + full, 1))
            # Sequences that nothing was left for keep their room.
            untouched = full + (rest > 0)
            waiting.append((room, first + untouched, n - untouched))
            rank += full * each + rest
        # No room of this round holds another item of its size, but for the last one's.
        for room, first, n in waiting:
            self._add(room, first, n)


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """key, sequence_id and offset for items (key, size; keys are unique), no sequence longer than `capacity`.

    Items are range-sorted by size and numbered within it by prefix counts over the
    ranges; the counts of the at most `capacity` sizes make the plan, and an item's
    rank among those of its size says which place in it is the item's. So ties are
    settled by rank, a size that most items have is no single task, and the result
    is best-fit decreasing at any number of partitions.
    """
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return items.select("key", F.col("key").alias("sequence_id"), F.lit(0).alias("offset"))
    plan = np.array(Plan(counts, capacity).places, np.int64)
    # Places by size and first rank, so that the last one at or before an item's is its own.
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    size, first_rank, first, each, offset = plan.T
    begin = np.searchsorted(size, np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = batch.column("size").to_numpy().astype(np.int64), batch.column("rank").to_numpy() - 1
            low, high = begin[own], begin[own + 1]
            while (high - low > 1).any():
                middle = (low + high) // 2
                before = first_rank[middle] <= rank
                low, high = np.where(before, middle, low), np.where(before, high, middle)
            nth = rank - first_rank[low]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(first[low] + nth // each[low]), pa.array((offset[low] + nth % each[low] * own).astype(np.int32))],
                ["key", "sequence_id", "offset"],
            )

    ranked = Ordered(items.select("key", F.col("size").cast("long").alias("size")), ["size"], ["key"]).row_numbers("rank").df
    return ranked.select("key", "size", "rank").mapInArrow(run, "key long, sequence_id long, offset int")


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of each piece of the packed documents.

    docs: doc_id, text. Only documents longer than `capacity` are cut. ids: binary of
    little-endian unsigned 32-bit integers. Pieces fill their sequences from 0 on
    without gaps between them.

    Null and empty texts are one piece that holds the end id only. Null and equal
    doc_ids are documents each. Without rows the result is empty.
    """
    cut = pieces(docs, tokenizer, end, capacity)
    placed = place(cut.select(F.col("piece_key").alias("key"), F.col("length").alias("size")), capacity)
    return cut.join(placed, cut["piece_key"] == placed["key"]).select("doc_id", "piece", "start", "length", "ids", "sequence_id", F.col("offset").cast("long").alias("offset"))
