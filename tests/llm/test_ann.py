import numpy as np
import pytest
from frames import frame
from pyspark.sql import functions as F

from opswell.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, list string"


def found(spark, rows, k, every, **more):
    df = frame(spark, [(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    got = ann.search(df, F.col("vec_id") % every == 0, k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def plain(rows, k, every):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if q % every == 0:
            best = sorted((-round(float(v @ c / np.linalg.norm(v) / np.linalg.norm(c)), 12), j) for j, c in good if j != q)[:k]
            out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def clustered(n, dim, groups, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, dim))
    return [(i, [float(x) for x in (centres[r.integers(groups)] + 0.7 * r.standard_normal(dim)).astype(np.float32)]) for i in range(n)]


def recall(got, want):
    a, b = {(q, v) for q, _, v, _ in got}, {(q, v) for q, _, v, _ in want}
    return len(a & b) / len(b)


@pytest.mark.parametrize("groups", [1, 12])
def test_recall_and_scores(spark, groups):
    rows = clustered(3000, 32, groups, 1)
    got, want = found(spark, rows, 5, 50), plain(rows, 5, 50)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    by = dict(rows)
    for q, _, v, s in got:
        a, b = (np.array(by[i], np.float32).astype(float) for i in (q, v))
        assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    for q in {g[0] for g in got}:
        own = [(g[1], -g[3], g[2]) for g in got if g[0] == q]
        assert [o[0] for o in sorted(own)] == [1, 2, 3, 4, 5] and sorted(o[1:] for o in own) == [o[1:] for o in sorted(own)]


def test_small_tight_groups_and_lone_vectors(spark):
    """Trios whose list holds nothing else, and vectors far from all, get k neighbours as good as the others'."""
    r = np.random.default_rng(7)
    rows = clustered(3000, 32, 12, 8)
    for g in range(100):
        centre = 3 * r.standard_normal(32)
        rows += [(10_000 + 50 * (3 * g + i), [float(x) for x in (centre + 1e-4 * r.standard_normal(32)).astype(np.float32)]) for i in range(3)]
    rows += [(50_000 + 50 * i, [float(x) for x in (8 * r.standard_normal(32)).astype(np.float32)]) for i in range(40)]
    got, want = found(spark, rows, 5, 50), plain(rows, 5, 50)
    assert len(got) == len(want)
    for low, high in ((0, 10_000), (10_000, 50_000), (50_000, 60_000)):
        assert recall([g for g in got if low <= g[0] < high], [w for w in want if low <= w[0] < high]) >= 0.9, low


def test_more_neighbours_than_a_list_holds(spark):
    rows = clustered(700, 8, 5, 9)
    got = found(spark, rows, 400, 50)
    assert len(got) == 14 * 400
    rows = [(i % 40, v) for i, v in rows]  # repeated vec_ids are one neighbour each
    assert len(found(spark, rows, 60, 20)) == 2 * 39


def test_reading_all_lists_is_exact(spark):
    rows = clustered(900, 8, 5, 2)
    got, want = found(spark, rows, 5, 50, read_ratio=1e9, most_read=10_000), plain(rows, 5, 50)
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_equal_vectors_and_ties(spark):
    one = clustered(1, 6, 1, 3)[0][1]
    rows = [(i, one) for i in range(120)] + [(i + 200, v) for i, v in clustered(30, 6, 2, 4)]
    assert [g[:3] for g in found(spark, rows, 5, 50)] == [w[:3] for w in plain(rows, 5, 50)]


def test_odd_rows_take_no_part(spark):
    rows = clustered(20, 4, 1, 5)
    odd = [(100, None), (150, []), (200, [1.0, None, 0.0, 0.0]), (250, [float("nan")] * 4), (300, [float("inf"), 0.0, 0.0, 0.0]), (350, [0.0] * 4), (None, [1.0] * 4)]
    assert [g[:3] for g in found(spark, rows + odd, 3, 10)] == [w[:3] for w in plain(rows, 3, 10)]


def test_few_none_repeated_short_and_extreme(spark):
    assert found(spark, [], 3, 10) == [] and found(spark, [(10, [1.0, 2.0])], 3, 10) == []
    rows = [(10, [1.0, 2.0]), (3, [1.0]), (3, [1.0]), (4, [3e38, 3e38]), (5, [1e-40, 1e-40])]
    got = found(spark, rows, 9, 10)
    assert [g[2] for g in sorted(got, key=lambda g: g[1])] == [4, 5, 3] and all(abs(g[3] - (3 / 10**0.5)  # cosine of (1, 2) and (1, 1)
                                                                                  ) < 1 for g in got)


def test_graph_finds_what_brute_force_finds():
    x = ann.unit(np.array([v for _, v in clustered(4000, 16, 20, 6)]))
    graph = ann.fit(x)
    counts = np.bincount(ann._nearest(x, graph.centroids), minlength=len(graph.centroids))
    assert counts.max() <= 4 * ann.ROWS_PER_LIST and len(graph.centroids) <= ann.MOST_LISTS
    at, d = graph.search(x[:200])
    assert (at[:, 0] == ann._nearest(x[:200], graph.centroids)).mean() >= 0.99 and (np.diff(d, axis=1) >= 0).all()


def test_recall_on_the_given_table(spark, tables):
    from opswell.llm.queries import QUERIES

    rows = [(r.vec_id, list(r.embedding)) for r in tables.embeddings.collect()]
    got = sorted(map(tuple, QUERIES["op8_posting_list_ann"](spark, tables.folder).collect()))
    assert recall(got, plain(rows, 5, 50)) >= 0.9
