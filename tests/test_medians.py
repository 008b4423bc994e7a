"""Running medians against sorting what has been seen so far."""

import random
import statistics

import pytest

from opswell.operators import medians


def plain(rows):
    out = {}
    for key in {k for k, *_ in rows}:
        seen = []
        for _, at, x in sorted(r for r in rows if r[0] == key):
            seen += [] if x is None else [x]
            out[key, at] = statistics.median(seen) if seen else None
    return out


@pytest.mark.parametrize(
    "block, kind", [(None, "random"), (1, "random"), (4, "random"), (4, "rising"), (4, "falling"), (4, "few values"), (4, "alternating"), (50, "alternating")]
)
def test_running_median(spark, block, kind):
    r = random.Random(block)
    value = {
        "random": lambda i: r.choice([None, r.uniform(-100, 100)]),
        "rising": float,
        "falling": lambda i: -float(i),
        "few values": lambda i: float(r.randrange(3)),
        "alternating": lambda i: float(i if i % 2 else -i),
    }[kind]
    rows = [("hot", i, value(i)) for i in range(400)] + [(f"k{i % 5}", i, value(i)) for i in range(40)] + [("none", i, None) for i in range(3)]
    got = medians.running_median(spark.createDataFrame(rows, "k string, at long, x double"), ["k"], ["at"], "x", "m", block)
    assert got.columns == ["k", "at", "x", "m"]
    assert {(g.k, g["at"]): g.m for g in got.collect()} == pytest.approx(plain(rows))


def test_null_keys_and_no_rows(spark):
    frame = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1)], "k string, at long, x int")
    assert sorted((g.x, g.m) for g in medians.running_median(frame, ["k"], ["at"], "x", "m").collect()) == [(1, 1.0), (5, 5.0), (7, 6.0)]
    assert medians.running_median(frame.limit(0), ["k"], ["at"], "x", "m").count() == 0
