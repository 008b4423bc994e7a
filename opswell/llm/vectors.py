"""Vectors as blocks of numpy rows: equal vectors once, with the smallest of their ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def finite(vector: str) -> Column:
    """Whether a vector has components and all are finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, good)


def distinct(rows: DataFrame, ids: int) -> DataFrame:
    """(vector, ids) of rows (vec_id, vector): each vector once, with its `ids` smallest vec_ids in order.

    Spark keeps so many of a vector's rows in each task before the shuffle, so a
    vector that a third of all rows share is a few rows by then.
    """
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.withColumn("_place", place).filter(F.col("_place") <= ids)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(lists: pa.Array, dim: int, dtype) -> np.ndarray:
    """Rows of numbers from lists, zeros after a shorter one's end."""
    counts = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), dim), dtype)
    row = np.repeat(np.arange(len(lists)), counts)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = np.asarray(lists.flatten())
    return out


BLOCK = "block long, n int, numbers binary, ids binary"


def _blocks(dim: int, width: int, dtype: str, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            ids = np.full((len(t), width), -1, np.int64)
            lists = t.column("ids").chunk(0)
            counts = np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(len(t)), counts)
            ids[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = np.asarray(lists.flatten())
            numbers = matrix(t.column("vector").chunk(0), dim, dtype)
            more = [pa.array([np.asarray(t.column(c)).astype(np.float64).tobytes()], pa.binary()) for c in extra]
            return pa.RecordBatch.from_arrays(
                [t.column("block").chunk(0)[:1], pa.array([len(t)], pa.int32()), pa.array([numbers.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary()), *more],
                [*(f.split()[0] for f in BLOCK.split(", ")), *extra],
            )

        for batch in batches:
            if not len(batch):
                continue
            of = np.asarray(batch.column("block"))
            starts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            if held and held[-1].column("block")[0].as_py() != of[0]:
                yield block()
                held = []
            for a, b in zip(starts[:-1], starts[1:]):
                if a:
                    yield block()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield block()

    return run


def blocked(rows: DataFrame, dim: int, width: int, dtype: str, extra: list[str] = ()) -> DataFrame:
    """One row for each block of rows (block, vector, ids): its matrix of numbers and its matrix of ids, -1 where a row has fewer than `width`."""
    schema = ", ".join([BLOCK, *(f"{c} binary" for c in extra)])
    chosen = rows.select("block", "vector", "ids", *extra)
    return chosen.repartition("block").sortWithinPartitions("block", F.element_at("ids", 1)).mapInArrow(_blocks(dim, width, dtype, list(extra)), schema)
