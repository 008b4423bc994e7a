"""Rows that Spark has sorted, read group by group without holding more than one group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns as lists) of each run of rows with equal keys, also across batches."""
    held, key = None, None
    for batch in batches:
        if not len(batch):
            continue
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        marks = list(zip(*(columns[k] for k in keys)))
        starts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1])]
        for a, b in zip(starts, [*starts[1:], len(marks)]):
            part = {n: c[a:b] for n, c in columns.items()}
            if held is not None and marks[a] == key:
                for n, c in part.items():
                    held[n] += c
                continue
            if held is not None:
                yield key, held
            held, key = part, marks[a]
    if held is not None:
        yield key, held


def emitted(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most `size`."""
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)
