import hashlib
import re

import numpy as np
import pytest
from frames import clashing, frame, hard_rows, words
from hypothesis import given, settings, strategies as st

from opswell.llm import mixing


def water(sizes, weights, most=3):
    """Targets by sharing again and again what is above the bounds."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        live = [i for i in range(len(sizes)) if i not in full]
        share = left / max(1, sum(weights[i] for i in live))
        for i in live:
            target[i] = share * weights[i]
        over = {i for i in live if target[i] > most * sizes[i]}
        if not over:
            for i in full:
                target[i] = float(most * sizes[i])
            return target
        full |= over


def plain(rows):
    """doc_id, size, source_size, target, taken."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sums = [sum(size(r[1]) for r in rows if r[3] == s) for s in order]
    targets = water(sums, [1 + i % 3 for i in range(len(order))])
    out = []
    for s, total, target in zip(order, sums, targets):
        own = [r for r in rows if r[3] == s]
        key = lambda r: (hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or 0, size(r[1]))
        left = int(np.floor(target + 1e-9))
        epochs = left // total if total else 0
        left -= epochs * total
        for r in sorted(own, key=key):
            more = min(left, size(r[1]))
            left -= more
            out.append((r[0], size(r[1]), total, round(target, 6), epochs * size(r[1]) + more))
    return out


def nulls_last(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def check(spark, rows, **more):
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(frame(spark, rows), ["doc_id"], **more).collect()]
    assert nulls_last(got) == nulls_last(plain(rows))
    return got


SOURCES = ["b", "a", "", None, "é", "\U0001f600", "src0"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SOURCES), st.integers(0, 30)), max_size=80))
def test_targets_and_cuts(spark, drawn):
    check(spark, [(i, words(i, n), None, s, None) for i, (s, n) in enumerate(drawn)], rows_per_range=7)


def test_sources_that_reach_their_bound_together(spark):
    """Bound over weight is 30 for both sources with words, and neither is full."""
    drawn = [("b", 20), ("a", 0), (None, 30)]
    got = check(spark, [(i, words(i, n), None, s, None) for i, (s, n) in enumerate(drawn)], rows_per_range=7)
    assert sorted(r[3] for r in got) == [0.0, 20.0, 30.0]


def test_hot_source_in_ranges(spark):
    rows = [(i, words(i, 1 + i % 17), None, "hot" if i % 3 else f"s{i % 5}", None) for i in range(900)]
    assert sorted(check(spark, rows, rows_per_range=20)) == sorted(check(spark, rows))


def test_taken_words_meet_the_targets(spark, tables):
    got = mixing.mix(tables.documents, ["doc_id", "source"]).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target) and all(r.taken <= 3 * r["size"] for r in own)


def test_hard_rows(spark):
    rows = [r if r[0] != 7 or r[1] != "another text of the same id" else (77, *r[1:]) for r in hard_rows() if r[0] is not None]
    check(spark, rows)
    assert mixing.mix(frame(spark, []), ["doc_id"]).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None, None, None)]), ["doc_id"]).collect()] == [0]


def test_documents_of_the_mix(spark):
    docs = clashing(frame(spark, [(i, words(i, 3 + i % 7), None, f"s{i % 4}", i) for i in range(60)] + hard_rows()))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    plan, texts = {}, {r.text for r in docs.collect()}
    for r in mixing.mix(docs.select("doc_id", "source", "text"), ["doc_id"]).collect():
        if r["size"]:
            # Whole copies only: the last one if half of it or more is within the budget.
            plan[r.doc_id] = plan.get(r.doc_id, 0) + int(r.taken / r["size"] + 0.5)
    got = {}
    for r in copies.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r["size"] == "own size" and r.text in texts
    assert got == {k: v for k, v in plan.items() if v}


def test_main_path_is_native(spark):
    plan = mixing.mix(frame(spark, hard_rows()), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("again", [4, 9])
def test_reruns_agree(spark, again):
    docs = frame(spark, [(i, words(i, 5), None, f"s{i % 3}", None) for i in range(200)])
    assert sorted(mixing.mix(docs, ["doc_id"]).collect()) == sorted(mixing.mix(docs.repartition(again), ["doc_id"]).collect())
