"""Spread windows against plain windows, on rows where one key holds a third of the table and some keys are null."""

import random
import re

import pytest
from pyspark.sql import Window, functions as F

from opswell.operators import segments as S
from opswell.plans import load


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.34 else (None if rng.random() < 0.05 else f"k{rng.randrange(40)}")
        x = None if rng.random() < 0.02 else rng.randrange(500)
        v = None if rng.random() < 0.2 else rng.randrange(-20, 20)
        data.append((i, key, x, v))
    return spark.createDataFrame(data, "id long, k string, x long, v long").repartition(5).cache()


def O(rows):
    return S.Ordered(rows, ["k"], ["x", "id"])


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    left = sorted((tuple(r) for r in a.select(cols).collect()), key=repr)
    right = sorted((tuple(r) for r in b.select(cols).collect()), key=repr)
    assert left == right


def ordered():
    return Window.partitionBy("k").orderBy("x", "id")


def test_row_numbers(rows):
    got = O(rows).row_numbers("rn", total="n").df
    want = rows.withColumn("rn", F.row_number().over(ordered()).cast("long")).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("k"))
    )
    same(got, want)


def test_row_numbers_descending(rows):
    got = O(rows).row_numbers("rn", descending=True).df
    want = rows.withColumn(
        "rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("x"), F.desc("id"))).cast("long")
    )
    same(got, want)


def test_running_sums(rows):
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    same(O(rows).running_sums({"s": "v"}).df, rows.withColumn("s", F.sum("v").over(w)))
    peers = Window.partitionBy("k").orderBy("x")
    same(S.sums_upto_value(rows, ["k"], "x", {"s": "v"}), rows.withColumn("s", F.sum("v").over(peers)))


def span_sizes(cut):
    return [r["n"] for r in cut.rows.groupBy(S.SPAN).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize(
    "case, x",
    [
        ("one far outlier", "if(id = 5, 1000000000000000, id)"),
        ("a burst", "if(id % 3 > 0, 1000000000 + id, id * 1000000)"),
        ("one value held by half the rows", "if(id % 2 = 0, 700, id)"),
        ("nulls held by half the rows", "if(id % 2 = 0, id, NULL)"),
        ("one value alone", "3"),
    ],
)
@pytest.mark.parametrize("spans", [8, 100])
def test_no_span_is_above_twice_the_mean(spark, case, x, spans):
    rows = spark.range(20_000).select("id", (F.col("id") % 7).alias("k"), F.expr(x).cast("long").alias("x"), F.lit(1).alias("v"))
    cut = S.Ordered(rows, ["k"], ["x", "id"], rows_per_span=20_000 // spans)
    sizes = span_sizes(cut)
    assert len(sizes) >= spans * 0.9 and max(sizes) <= 2 * 20_000 / spans
    w = Window.partitionBy("k").orderBy("x", "id")
    same(cut.row_numbers("rn").df, rows.withColumn("rn", F.row_number().over(w).cast("long")))


def test_ties_are_split_by_all_the_order(spark):
    """Half the rows share the first two columns, a third of all rows the first three."""
    rows = spark.range(9000).select(
        F.lit("hot").alias("k"),
        F.when(F.col("id") % 2 == 0, 1.5).otherwise(F.col("id") / 7).alias("x"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("a text of its own "), F.lpad("id", 5, "0"))).alias("name"),
        F.when(F.col("id") % 5 > 0, F.lit("2024-01-01").cast("date")).otherwise(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int"))).alias("day"),
        "id",
    )
    order = ["x", "name", "day", "id"]
    cut = S.Ordered(rows, ["k"], order, rows_per_span=300)
    assert max(span_sizes(cut)) <= 2 * 300
    w = Window.partitionBy("k").orderBy(*order)
    same(cut.row_numbers("rn").df, rows.withColumn("rn", F.row_number().over(w).cast("long")))
    same(cut.previous({"p": "id"}).df, rows.withColumn("p", F.lag("id").over(w)))
    down = Window.partitionBy("k").orderBy(*[F.desc(c) for c in order])
    same(cut.row_numbers("rn", descending=True).df, rows.withColumn("rn", F.row_number().over(down).cast("long")))


@pytest.mark.parametrize(
    "dtype, values",
    [
        ("string", ["", None, "a", "aaaaaa", "aaaaaaa", "aaaaaab", "é", "日本", "Z", "\U0001f600", "b" * 40, "b" * 41]),
        ("double", [float("nan"), float("-inf"), float("inf"), None, -0.0, 1e308, -1e308, 5e-324]),
        ("boolean", [True, False, None]),
        ("binary", [b"", b"\xff", b"\x00", None, b"\x00\x01"]),
    ],
)
def test_every_type_is_cut_in_its_order(spark, dtype, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values * 6)], f"id long, x {dtype}")
    cut = S.Ordered(rows, [], ["x", "id"], rows_per_span=2)
    assert len(span_sizes(cut)) >= 8
    got = {r.id: r.rn for r in cut.row_numbers("rn").df.collect()}
    assert got == {r.id: r.rn for r in rows.withColumn("rn", F.row_number().over(Window.orderBy("x", "id"))).collect()}


def test_no_rows_and_columns_without_an_order_of_numbers(rows, spark):
    assert O(rows.limit(0)).row_numbers("rn").df.count() == 0
    nested = rows.withColumn("x", F.array("id"))
    w = Window.partitionBy("k").orderBy("x")
    same(S.Ordered(nested, ["k"], ["x"]).row_numbers("rn").df, nested.withColumn("rn", F.row_number().over(w).cast("long")))


def test_running_least(rows):
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    same(O(rows).running_least({"m": "v"}).df, rows.withColumn("m", F.min("v").over(w)))
    same(
        O(rows).running_least({"m": "v"}, greatest=True).df,
        rows.withColumn("m", F.max("v").over(w)),
    )


def test_previous_and_last_known(rows):
    same(O(rows).previous({"p": "v"}).df, rows.withColumn("p", F.lag("v").over(ordered())))
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    same(
        O(rows).last_known({"p": "v"}).df,
        rows.withColumn("p", F.last("v", ignorenulls=True).over(before)),
    )
    upto = ordered().rowsBetween(Window.unboundedPreceding, 0)
    same(
        O(rows).last_known(upto={"p": "v"}).df,
        rows.withColumn("p", F.last("v", ignorenulls=True).over(upto)),
    )


def test_value_ranks(rows):
    w = Window.partitionBy("k").orderBy("x")
    want = rows.select(
        "id",
        F.rank().over(w).cast("long").alias("r"),
        F.dense_rank().over(w).cast("long").alias("d"),
        F.cume_dist().over(w).alias("c"),
    )
    got = S.attach(rows, S.value_ranks(rows, ["k"], "x"), ["k", "x"]).select(
        "id",
        (F.col("below") + 1).alias("r"),
        F.col("distinct").alias("d"),
        ((F.col("below") + F.col("n")) / F.col("total")).alias("c"),
    )
    same(got, want)


def test_exact_percentiles(rows):
    got = S.exact_percentiles(rows, ["k"], "v", {"p": 0.5, "q": 0.9}).select("k", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))
    want = rows.groupBy("k").agg(
        F.round(F.percentile("v", F.lit(0.5)), 9).alias("p"), F.round(F.percentile("v", F.lit(0.9)), 9).alias("q")
    )
    same(got, want)


def test_sliding(rows):
    known = rows.where("x is not null")
    w = Window.partitionBy("k").orderBy("x").rangeBetween(-30, 7)
    got = S.sliding(
        known, ["k"], "x", 30, 7, {"s": F.sum("v"), "m": F.max("v")},
        {"s": lambda f: F.sum("s").over(f), "m": lambda f: F.max("m").over(f)},
    )
    want = known.select("k", "x", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m")).distinct()
    same(got, want)


def test_sliding_folds_equal_the_frames(rows):
    known = rows.where("x is not null")
    for before, after in ((30, 7), (0, 0), (3, 90), (1, 1)):
        w = Window.partitionBy("k").orderBy("x").rangeBetween(-before, after)
        got = S.sliding(
            known, ["k"], "x", before, after, {"s": F.sum("v"), "m": F.max("v"), "l": F.min("v")},
            {"s": F.col("s"), "m": F.col("m"), "l": F.col("l")}, {"s": F.sum, "m": F.max, "l": F.min},
        )
        want = known.select("k", "x", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.min("v").over(w).alias("l")).distinct()
        same(got, want)


@pytest.mark.parametrize("name", ["win10", "win10_hours", "win11"])
def test_frames_of_the_queries_only_grow(name, spark):
    """A frame that moves at both ends is worked through anew for every row."""
    plan = load()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", plan)
    assert frames and set(frames) == {"unboundedpreceding$()"}


def test_a_hot_key_is_spread(rows):
    spans = O(rows)
    sizes = [r["n"] for r in spans.rows.where("k = 'hot'").groupBy(S.SPAN).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < sum(sizes) / 4
