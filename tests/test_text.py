"""Parsers and text functions on lines of every form."""

import pytest
from pyspark.sql import functions as F

from opswell.functions import numbers as N, text as X, times as D, udfs
from opswell.operators import logs, stages
from opswell.sources import writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_gc_lines(spark):
    lines = [
        "[2021-02-03T04:05:06.007+0100][88.250s][info][gc] GC(7) Pause Mixed (Prepare) (Humongous Allocation) 900M->250M(2048M) 12.500ms",
        "[2021-02-03T04:05:07.100+0100][89.343s][info][gc] GC(8) Pause Cleanup 300M->299M(2048M) 0.125ms",
        "[2021-02-03T04:05:08.200+0100][90.443s][info][gc,start] GC(9) Pause Full (System)",
        "[2021-02-03T04:05:08.200+0100][90.443s][info][gc,start] GC(9) Pause Full (System) (Diagnostic Command)",
        "[2021-02-03T04:05:08.300+0100][90.543s][info][gc,heap] Eden regions: 3->0(5)",
    ]
    rows = logs.gc_records(spark.createDataFrame(list(enumerate(lines)), "i int, value string")).orderBy("i").collect()
    got = [(r["type"], r["kind"], r["before"], r["after"], r["reclaimed"], r["millis"], r["stats"], r["level"]) for r in rows]
    assert got == [
        ("Mixed", "Humongous Allocation", 900, 250, 650, 12.5, "paused", "info"),
        ("Cleanup", None, 300, 299, 1, 0.125, "paused", "info"),
        ("Full", "System", None, None, None, None, None, "info"),
        ("Full", "Diagnostic Command", None, None, None, None, None, "info"),
        (None, None, None, None, None, None, None, None),
    ]
    assert rows[0]["uptime"] == 88.25 and rows[0]["cycle"] == 7 and rows[2]["gc_tags"] == "gc,start"


def test_long_records_are_whole_in_their_chunks(spark):
    head = "2024-01-01 00:00:00 INFO A:1 - x"
    lines = ["lost"] + [head] + [f"at {i}" for i in range(700)] + [head, "tail"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "f string, n long, value string").repartition(4)
    rows = {(r["record"], r["chunk"]): r for r in logs.stitch(df, "f", "n", "value").collect()}
    assert sorted(rows, key=str) == [(1, 0), (1, 1), (702, 0), (None, 0)]
    assert rows[None, 0]["text"] == "lost" and rows[None, 0]["head"] is None and rows[702, 0]["text"] == head + "\ntail"
    assert rows[1, 0]["lines"] == rows[1, 1]["lines"] == 701 and rows[1, 1]["head"] == head
    assert rows[1, 0]["text"].split("\n") == lines[1:501] and rows[1, 1]["text"].split("\n") == lines[501:702]


def test_application_records(spark):
    rows = [
        (0, "2024-01-01 10:00:00 ERROR com.a.B$C:42 - boom\njava.lang.X: <a> & 'b'\n\tat com.a.B(C.java:1)"),
        (1, "2024-01-01T10:00:00,123 warn  B:7 - low\nshort at"),
        (2, "no layout at all"),
    ]
    got = logs.application_records(spark.createDataFrame(rows, "i int, value string")).orderBy("i").collect()
    assert [(r["level"], r["class"], r["line_number"], r["event_type"]) for r in got] == [
        ("ERROR", "com.a.B$C", 42, "error"), ("WARN", "B", 7, "warning"), ("INFO", None, None, "info"),
    ]
    assert got[0]["stack_trace"] == "java.lang.X: &lt;a&gt; &amp; &#39;b&#39;\n\tat com.a.B(C.java:1)"
    assert got[1]["stack_trace"] is None and got[2]["message"] == "no layout at all"
    assert got[0]["message"].startswith("com.a.B$C:42 - 2024-01-01 10:00:00 ERROR")


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, X.label(lit("-- Spark (Master) v1.")) ) == "Spark-Master-v1"
    assert one(spark, X.host_label(lit("LAB1.Example.org"))) == "lab1"
    assert one(spark, X.text_of(lit('{"display_value":"","value":"v"}'))) == "v"
    assert one(spark, X.text_of(lit(None).cast("string"))) == ""
    assert one(spark, X.last_part(lit("a|||b||| HOST-1 "))) == "HOST-1"
    assert one(spark, X.entity_part(lit("feed|||HOST-1A|||extra"))) == "HOST-1A"
    assert one(spark, X.entity_part(lit("feed|||pod-00ff||| SERVICE-9 |||x"))) == "SERVICE-9"
    assert one(spark, X.entity_part(lit("feed|||plain "))) == "plain" and one(spark, X.entity_part(lit(" alone "))) == "alone"
    assert one(spark, X.ui_base(lit("https://a.apps.corp.example/API/"), ".corp.example")) == "https://a.live.corp.example"
    assert one(spark, X.ui_base(lit("https://a.apps.corp.example/x"), ".corp.example")) == "https://a.apps.corp.example/x"
    assert one(spark, X.entity_type(lit(""), lit("CLOUD_APPLICATION_INSTANCE-1"))) == "CLOUD_APPLICATION_INSTANCE"
    assert one(spark, X.clock_seconds(lit("01:02:03.5"))) == 3723
    assert one(spark, X.clock_seconds(lit(""))) is None
    assert one(spark, X.clock_seconds_anywhere(lit(""))) == 0
    assert one(spark, X.record_link(lit("https://x/"), lit("t"), lit(""))) == ""
    assert one(spark, X.service_stamp(lit("x service_instance=late sn-service_instance: First"))) == "First"
    assert one(spark, D.millis_in_id(lit("P_1700000000000V2"))) == 1700000000000
    assert one(spark, D.millis_in_id(lit("P_17000000000V2"))) is None
    assert one(spark, D.date_of_parts(lit(2023), lit(2), lit(29))) is None


@pytest.mark.parametrize("value", [0.0, 1.0, 65.5, -3.25, 1234567.891, 999999.5, 0.0001234567, 1.5e-7, 12345.678, 1e21, 100000.0])
def test_six_significant_digits(spark, value):
    assert one(spark, writers.significant(F.lit(value))) == f"{value:.6g}"


def test_fractions(spark):
    cases = {(35, 21): [5, 3], (9, 0): None, (7, 7): [1, 1], (-10, 4): [-5, 2], (12, -18): [-2, 3], (0, -11): [0, 1]}
    for (n, d), want in cases.items():
        assert one(spark, N.fraction(F.lit(n).cast("long"), F.lit(d).cast("long"))) == want
    assert udfs.divided([17, 5]) == [3, 2] and udfs.divided([4, 0]) is None
    assert udfs.reach.func([3, 11, -2]) == 13.0 and udfs.reach.func([]) is None


def test_stage_scores(spark):
    rows = [
        (0, "count at A.scala:3", "ShuffledRDD"), (1, "join at A.scala:3", "ShuffledRDD,CoGroupedRDD"), (2, "map at A.scala:3", None),
        (3, "odd at A.scala:3", None), (4, "filter at A.scala:1", "MapPartitionsRDD"), (5, "plain", "UnionRDD"),
    ]
    df = spark.createDataFrame(rows, "i int, stage_name string, rdd_types string")
    got = [(r["operation"], r["confidence"], r["low_confidence"]) for r in stages.scored(stages.named(df), "i").orderBy("i").collect()]
    assert got == [
        ("aggregation", 0.7, False), ("join", 0.7, False), ("transformation", 0.4, True),
        (None, None, None), ("filter", 0.4, True), ("union", 0.3, True),
    ]
