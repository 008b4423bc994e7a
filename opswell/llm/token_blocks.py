"""Token ids in files of patched frame-of-reference blocks, in the order of the documents.

A file is a run of documents: a header, the documents' ids and lengths, the
starts of its blocks, and the blocks. A block holds BLOCK token ids: the block's
minimum is subtracted, the differences are packed at the width that holds the
chosen percentile of them, and those that are wider are patched from a list of
places and values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opswell.llm import tokens

MAGIC = b"PFORIDS1"
#: magic, part, place in the part, documents, tokens, blocks
HEADER = struct.Struct("<8sIIQQQ")
#: minimum, width in bits, exceptions
BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "<u2"), ("more", "<u2")])
ROWS = COLUMNS = 32
BLOCK = ROWS * COLUMNS
#: Share of a block's ids that its width must hold, and tokens after which a file ends.
PERCENTILE = 90
TOKENS_PER_FILE = 4 << 20
#: Blocks packed or unpacked at a time.
AT_ONCE = 256


def _packed(v: np.ndarray, width: int) -> np.ndarray:
    """Blocks (n, ROWS, COLUMNS) of values below 2^width as (n, width, COLUMNS) words of 32 bits."""
    out = np.zeros((len(v), max(width, 1), COLUMNS), np.uint32)
    for row in range(ROWS if width else 0):
        word, shift = divmod(row * width, 32)
        out[:, word] |= v[:, row] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, row] >> np.uint32(32 - shift)
    return out[:, :width]


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), ROWS, COLUMNS), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for row in range(ROWS if width else 0):
        word, shift = divmod(row * width, 32)
        v = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            v = v | (words[:, word + 1] << np.uint32(32 - shift))
        out[:, row] = v & mask
    return out


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks, and the blocks. The last block is filled up with its last id."""
    starts, blocks, size = [np.zeros(0, "<u8")], [], 0
    for at in range(0, len(ids), AT_ONCE * BLOCK):
        own, data = _encode_some(ids[at : at + AT_ONCE * BLOCK], percentile)
        starts.append(own + np.uint64(size))
        blocks.append(data)
        size += len(data)
    return np.concatenate(starts).astype("<u8"), b"".join(blocks)


def _encode_some(ids: np.ndarray, percentile: int) -> tuple[np.ndarray, bytes]:
    n = -(-len(ids) // BLOCK)
    v = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).astype(np.uint32).reshape(n, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    held = np.partition(v, (BLOCK * percentile - 1) // 100, axis=1)[:, (BLOCK * percentile - 1) // 100]
    width = np.ceil(np.log2(held.astype(np.float64) + 1)).astype(np.int64)
    over = v >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0
    over &= (width < 32)[:, None]
    more = over.sum(axis=1)
    size = BLOCK_HEAD.itemsize + 4 * COLUMNS * width + 6 * more
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    heads = np.zeros(n, BLOCK_HEAD)
    heads["low"], heads["width"], heads["more"] = low, width, more
    out[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)] = heads.view(np.uint8).reshape(n, -1)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        words = _packed((v[of] & np.uint32((1 << int(w)) - 1)).reshape(-1, ROWS, COLUMNS), int(w))
        out[(starts[of] + BLOCK_HEAD.itemsize)[:, None] + np.arange(4 * COLUMNS * w)] = words.reshape(len(of), -1).astype("<u4").view(np.uint8)
    block, place = np.nonzero(over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(more) - more, more)
    lists = starts + BLOCK_HEAD.itemsize + 4 * COLUMNS * width
    out[(lists[block] + 2 * nth)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[(lists[block] + 2 * more[block] + 4 * nth)[:, None] + np.arange(4)] = v[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts.astype("<u8"), out.tobytes()


def decode_blocks(starts: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The first `count` ids of the blocks."""
    out = np.zeros(len(starts) * BLOCK, np.uint32)
    for at in range(0, len(starts), AT_ONCE):
        own = starts[at : at + AT_ONCE]
        out[at * BLOCK : (at + len(own)) * BLOCK] = _decode_some(own, data)
    return out[:count]


def _decode_some(starts: np.ndarray, data: np.ndarray) -> np.ndarray:
    n, starts = len(starts), starts.astype(np.int64)
    heads = np.ascontiguousarray(data[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)]).view(BLOCK_HEAD).ravel()
    width, more = heads["width"].astype(np.int64), heads["more"].astype(np.int64)
    v = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        words = np.ascontiguousarray(data[(starts[of] + BLOCK_HEAD.itemsize)[:, None] + np.arange(4 * COLUMNS * w)]).view("<u4")
        v[of] = _unpacked(words.reshape(len(of), w, COLUMNS), int(w)).reshape(len(of), BLOCK)
    block = np.repeat(np.arange(n), more)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(more) - more, more)
    lists = starts + BLOCK_HEAD.itemsize + 4 * COLUMNS * width
    place = np.ascontiguousarray(data[(lists[block] + 2 * nth)[:, None] + np.arange(2)]).view("<u2").ravel()
    value = np.ascontiguousarray(data[(lists[block] + 2 * more[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    v[block, place] = value
    return (v + heads["low"][:, None]).ravel()


def encode_file(part: int, place: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    starts, blocks = encode_blocks(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [
            HEADER.pack(MAGIC, part, place, len(doc_ids), len(ids), len(starts)),
            null.tobytes(),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            counts.astype("<u8").tobytes(),
            starts.tobytes(),
            blocks,
        ]
    )


def decode_file(content: bytes):
    """part, place, ids of the documents, their lengths, and all token ids."""
    magic, part, place, docs, count, blocks = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a file of token blocks")
    at = HEADER.size
    null = np.frombuffer(content, np.uint8, docs, at)
    doc_ids = pa.array(np.frombuffer(content, "<i8", docs, at + docs), mask=null.astype(bool))
    counts = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
    starts = np.frombuffer(content, "<u8", blocks, at + 17 * docs)
    data = np.frombuffer(content, np.uint8, offset=at + 17 * docs + 8 * blocks)
    return part, place, doc_ids, counts, decode_blocks(starts, data, count)


def _files(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        docs, counts, ids, held = [], [], [], 0

        def file():
            content = encode_file(part, place, docs, np.concatenate(counts), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for batch in batches:
            for rows, slab in tokens.whole(batch.column("text")):
                more, n = tokens.with_end(*tokens.encoder(path).encode(slab), end)
                docs += batch.column("doc_id").slice(rows[0], len(rows)).to_pylist()
                counts.append(n)
                ids.append(more)
                held += len(more)
                if held >= TOKENS_PER_FILE:
                    yield file()
                    docs, counts, ids, held, place = [], [], [], 0, place + 1
        if docs:
            yield file()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Writes the token ids of docs (doc_id, text), each text's ids with `end` after them, in ascending order of doc_id.

    Documents are range-sorted (null doc_ids first; equal doc_ids by a hash of
    their texts, so that repeated rows are no single range). Each range becomes
    files of some TOKENS_PER_FILE tokens, whose headers number them in order. Spark
    commits the files, so those of lost tasks do not count. Null texts are empty
    and have the end id only. Without rows no file holds documents.
    """
    order = ["doc_id", "_tie"]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    files = ranged.select("doc_id", "text").mapInArrow(_files(tokenizer, end), "content binary")
    # The text writer puts out the bytes of a column as they are; one row is one file.
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            if not len(content.as_buffer()):
                continue
            part, place, doc_ids, counts, ids = decode_file(content.as_buffer().to_pybytes())
            starts = np.cumsum(counts) - counts
            first = 0
            while first < len(counts):
                until = max(first + 1, int(np.searchsorted(starts + counts, starts[first] + (1 << 20), "right")))
                n = until - first
                own = tokens.binaries(ids[starts[first] : starts[until - 1] + counts[until - 1]], counts[first:until]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(first, n), pa.array(np.full(n, part, np.int64)), pa.array(np.full(n, place, np.int64)), pa.array(starts[first:until]), own],
                    ["doc_id", "part", "place", "file_start", "ids"],
                )
                first = until


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of files written by `write`: doc_id, part and place of the file, file_start (token ids before it in the file), ids (binary of unsigned 32-bit integers)."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(_read, "doc_id long, part long, place long, file_start long, ids binary")


def starts(rows: DataFrame) -> DataFrame:
    """Adds `start` to rows (part, place, file_start, n_tokens): the token ids of all documents before. One row per file is summed up."""
    files = rows.groupBy("part", "place").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    begun = files.select("part", "place", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(begun, ["part", "place"]).withColumn("start", F.col("_before") + F.col("file_start")).drop("_before")
