import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from frames import clashing, frame, hard_rows
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from opswell.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(sizes, capacity):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect_left(gaps, s)
        if i == len(gaps):
            n, room = n + 1, capacity - s
        else:
            room = gaps.pop(i) - s
        if room:
            insort(gaps, room)
    return n


def gapless(rows, capacity):
    """rows: (sequence, offset, length). The number of sequences."""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    return len(by)


def placed(spark, sizes, capacity, partitions=3):
    items = spark.createDataFrame([(i * 7 - 5, s) for i, s in enumerate(sizes)], "key long, size long").repartition(partitions)
    got = packing.place(items, capacity).collect()
    assert sorted(r.key for r in got) == [i * 7 - 5 for i in range(len(sizes))]
    return gapless([(r.sequence_id, r.offset, sizes[(r.key + 5) // 7]) for r in got], capacity)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=200))
def test_rounds_are_best_fit_decreasing(spark, sizes):
    assert placed(spark, sizes, 100) == best_fit_decreasing(sizes, 100)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=300), st.integers(1, 12))
def test_plan_is_best_fit_decreasing(capacity, sizes, kinds):
    sizes = [1 + s % capacity for s in sizes]
    sizes = [sizes[i % kinds % len(sizes)] for i in range(len(sizes))] if kinds % 2 else sizes
    plan = packing.Plan(Counter(sizes), capacity)
    rows = [(first + k // each, offset + k % each * size, size) for size, rank, first, each, offset in plan.places for k in range(_items(plan, size, rank, Counter(sizes)))]
    assert len(rows) == len(sizes) and gapless(rows, capacity) == best_fit_decreasing(sizes, capacity) == plan.sequences


def _items(plan, size, rank, counts):
    """Items of a run of places: up to the next run of their size, or their last one."""
    later = [r for s, r, *_ in plan.places if s == size and r > rank]
    return min(later, default=counts[size]) - rank


def test_partitions_do_not_matter_and_the_plan_stays_small(spark):
    sizes = [int(x) for x in np.random.default_rng(1).integers(1, 2048, 6000)]
    assert placed(spark, sizes, 2048, 1) == placed(spark, sizes, 2048, 40) == best_fit_decreasing(sizes, 2048)
    plan = packing.Plan({size: 10**9 + size for size in range(1, 2049)}, 2048)
    assert len(plan.places) < 10_000


@pytest.mark.parametrize("sizes", [[1] * 3000, [65] * 2000, [2048] * 5, [1025] * 40 + [1023] * 40, [2047, 1]])
def test_ties(spark, sizes):
    assert placed(spark, sizes, 2048) == best_fit_decreasing(sizes, 2048)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_hold_all_tokens(spark, capacity):
    tok = Tokenizer.from_file(PATH)
    rows = packing.pack(clashing(frame(spark, hard_rows())), PATH, capacity=capacity).collect()
    want = []
    for doc_id, text, *_ in hard_rows():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc_id, k // capacity, k, np.array(ids[k : k + capacity], "<u4").tobytes()) for k in range(0, len(ids), capacity)]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows), key=key) == sorted(want, key=key)
    assert all(r.length == len(r.ids) // 4 for r in rows)
    assert gapless([(r.sequence_id, r.offset, r.length) for r in rows], capacity) == best_fit_decreasing([r.length for r in rows], capacity)


def test_no_documents(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_whole_table(spark, tables):
    from opswell.llm.queries import QUERIES

    tok = Tokenizer.from_file(PATH)
    rows = QUERIES["op6_best_fit_packing"](spark, tables.folder).collect()
    want = {}
    for d in tables.documents.collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = np.array(ids[k : k + 2048], "<u4")
            want[d.doc_id, k // 2048] = (k, len(own), zlib.crc32(own.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert gapless([(r.sequence_id, r.offset, r.length) for r in rows], 2048) == best_fit_decreasing([r.length for r in rows], 2048)
