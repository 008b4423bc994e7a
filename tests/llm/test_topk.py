import numpy as np
import pytest
from frames import frame
from pyspark.sql import functions as F

from opswell.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def plain(rows, k, every):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, v in asked.items():
        best = sorted((-dot(v, c), j) for j, c in good if j != q)[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, k, every):
    df = frame(spark, [(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    got = topk.search(topk.quantised(df), F.col("vec_id") % every == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def some(n, dim, seed):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.standard_normal(dim).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("blocks", [(7, 3, 2), (topk.CANDIDATES, topk.QUERIES, topk.AT_A_TIME)])
def test_equals_all_products(spark, monkeypatch, blocks):
    for name, n in zip(("CANDIDATES", "QUERIES", "AT_A_TIME"), blocks):
        monkeypatch.setattr(topk, name, n)
    rows = some(150, 9, 1)
    assert found(spark, rows, 10, 10) == plain(rows, 10, 10)


def test_many_equal_vectors_and_ties(spark):
    one = some(1, 6, 2)[0][1]
    rows = [(i, one) for i in range(200)] + [(i + 200, v) for i, v in some(40, 6, 3)] + [(500, [-x for x in one])]
    assert found(spark, rows, 5, 50) == plain(rows, 5, 50)


def test_odd_rows_take_no_part(spark):
    rows = [(i, v) for i, v in some(12, 4, 4)]
    odd = [(100, None), (110, []), (120, [1.0, None, 0.0, 0.0]), (130, [float("nan")] * 4), (140, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    assert found(spark, rows + odd, 3, 10) == plain(rows, 3, 10)


def test_few_none_repeated_and_short(spark):
    assert found(spark, [], 3, 10) == []
    assert found(spark, [(10, [1.0, 2.0])], 3, 10) == []
    rows = [(10, [1.0, 2.0]), (10, [0.5, 2.0]), (3, [1.0]), (4, [0.0, 0.0])]
    assert found(spark, rows, 9, 10) == plain(rows, 9, 10)


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(np.float32(3e5 + i)), float(np.float32(-2e5 + 7 * i))] * 3) for i in range(30)]
    assert found(spark, rows, 4, 10) == plain(rows, 4, 10)


def test_cutoff_leaves_few_entries(spark):
    """Phase 2 puts out little more than the answer."""
    rows = some(400, 8, 6)
    numbers = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    total = sum(topk._partial(numbers, numbers))
    assert (total == numbers @ numbers.T).all()


def test_blocks_meet_without_a_join(spark, monkeypatch):
    """No block goes through the driver, however large a side may be that counts as small; a group may hold one block or many."""
    for name, n in (("CANDIDATES", 7), ("QUERIES", 3), ("AT_A_TIME", 2), ("HELD_MB", 0)):
        monkeypatch.setattr(topk, name, n, raising=False)
    rows = some(150, 9, 7)
    df = frame(spark, [(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    answer = topk.search(topk.quantised(df), F.col("vec_id") % 10 == 0, 10)
    assert "Join Inner" not in answer._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, answer.collect())) == plain(rows, 10, 10)


def test_distinct_keeps_the_smallest_ids(spark):
    rows = [(i, [1]) for i in (5, 3, 9, 1)] + [(7, [2])]
    got = vectors.distinct(spark.createDataFrame(rows, "vec_id long, vector array<long>"), 2).collect()
    assert {tuple(r.vector): r.ids for r in got} == {(1,): [1, 3], (2,): [7]}
