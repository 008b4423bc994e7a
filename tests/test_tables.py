"""Failures that must fail, writers that must not lose rows, plans that must stay as they are."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from opswell.operators import tables as T
from opswell.plans import load
from opswell.session import scratch, tune
from opswell.sources import readers, writers
from opswell.sources.keyed import KeyedTable
from opswell.streaming import files

SMALL = "/root/testdata/sf0.001"


def test_a_name_of_both_sides_is_refused(spark):
    a = spark.range(3).select("id", F.lit(1).alias("v"))
    b = spark.range(3).select("id", F.lit(2).alias("v"))
    with pytest.raises(AnalysisException):
        a.join(b, a.id == b.id).select("v")


def test_wrong_types_fail_when_read_not_when_declared(spark):
    path = scratch(spark, "bad")
    spark.createDataFrame([(1, "text")], "id long, summary string").write.json(path)
    rows = readers.documents(spark, path, schema="id BIGINT, summary BIGINT", strict=True)
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        rows.collect()


def test_union_on_common_columns_wants_the_required_ones(spark):
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(1)
    assert T.common_columns([a, b]).columns == ["id"]
    with pytest.raises(ValueError):
        T.common_columns([a, b], required=["x"])


def test_upsert_twice_gives_the_same_table(spark):
    table = KeyedTable(spark, scratch(spark, "keyed"), "id", ["seq"])
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y")], "id string, seq long, v string")
    second = spark.createDataFrame([("b", 0, "old"), ("c", 5, "z")], "id string, seq long, v string")
    for rows in (first, second, second):
        table.upsert(rows)
    got = {(r["id"], r["seq"], r["v"]) for r in table.read().collect()}
    assert got == {("a", 2, "y"), ("b", 1, "x"), ("c", 5, "z")}


def test_the_first_row_of_a_key_is_created(spark):
    path = scratch(spark, "created")
    schema = "id string, seq long"
    writers.create_only(spark, path, spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], schema), "id", ["seq"])
    writers.create_only(spark, path, spark.createDataFrame([("a", 0), ("c", 9), ("c", 8)], schema), "id", ["seq"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 3), ("c", 8)]


def test_finished_runs_are_added_one_by_one(spark):
    path = scratch(spark, "timing")
    for i in range(3):
        writers.append_timing(spark, path, "2024-01-01", "abc", f"chapter {i}", "ok", 1.5 * i)
    read = readers.delimited(spark, path, schema=writers.TIMING)
    assert sorted((r.chapter, r.elapsed_s) for r in read.collect()) == [("chapter 0", 0.0), ("chapter 1", 1.5), ("chapter 2", 3.0)]


def test_one_file_holds_all_rows(spark):
    path = scratch(spark, "one")
    assert writers.attempt(writers.csv_single, spark.range(50), path)
    assert spark.read.option("header", True).csv(path).count() == 50
    assert not writers.attempt(writers.csv_single, spark.range(5).withColumn("id", F.raise_error(F.lit("no"))), scratch(spark, "one"))


def test_numbered_lines_keep_file_order(spark):
    path = scratch(spark, "lines")
    spark.range(0, 5000, 1, 1).select(F.format_string("%06d", "id").alias("value")).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = readers.numbered_lines(spark, path).orderBy("line_no").select("value").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r["value"]) for r in rows] == list(range(5000))


def test_one_json_array_is_read_in_splits(spark):
    path = scratch(spark, "array")
    schema = "id long, name string, tags array<struct<k:string,v:array<long>>>"
    hard = ['"', "\\\\", '\\"}', "[{", "],", "a\nb", "", "é{", None]
    rows = [(i, hard[i % len(hard)], [(hard[(i + j) % len(hard)], list(range(j))) for j in range(i % 4)]) for i in range(600)]
    docs = spark.createDataFrame(rows, schema).coalesce(1).orderBy("id")
    texts = docs.select(F.to_json(F.struct(*docs.columns), {"pretty": "true"}).alias("value"))
    files.json_arrays(texts.coalesce(1)).write.option("lineSep", "\n").text(path)
    want = sorted(map(repr, readers.documents(spark, path, multi_line=True, schema=schema).collect()))
    assert len(want) == 600
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert readers.numbered_lines(spark, path).select("path").rdd.getNumPartitions() > 1
        assert sorted(map(repr, readers.array_documents(spark, path, schema=schema).collect())) == want
        # Several documents in a line, and documents one after the other.
        packed, apart = scratch(spark, "packed"), scratch(spark, "apart")
        spark.createDataFrame([('[1, "x", {"id":1},{"id":2,"name":"]"}',), (',{"id":3}, [], {"id":',), ("4}]",)], "value string").coalesce(1).write.text(packed)
        spark.createDataFrame([('{"id":1}{"id":2', ), ('} {"id":3}',)], "value string").coalesce(1).write.text(apart)
        assert sorted(r.id for r in readers.array_documents(spark, packed, schema="id long").collect() if r.id) == [1, 2, 3, 4]
        assert sorted(r.id for r in readers.array_documents(spark, apart, schema="id long", in_array=False).collect()) == [1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    queries = load()
    text = plan(queries["joi04"](spark, SMALL))
    assert "GreaterThan(o_totalprice,300000.0)" in text and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text
    text = plan(queries["agg09"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_returnflag:string>" in text


LAZY = ["agg01", "agg09", "agg16", "agg40", "joi03", "joi14", "joi19", "joi23", "win03", "win05", "win11", "cls05", "rec04", "rec05", "rec09", "ent02", "inc06"]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_of_all_rows(spark, name):
    tune(spark)
    text = plan(load()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_copies_shrink_before_they_are_moved(spark):
    """The newest row per key is an aggregate with a partial step, not a window over all copies."""
    text = plan(T.newest(spark.range(100).select((F.col("id") % 3).alias("k"), "id"), ["k"], ["id"]))
    assert "partial_max_by" in text and "Window" not in text
