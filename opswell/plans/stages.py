"""Stage classification and hints."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswell.operators import stages as C
from opswell.plans.ctes import cte, sql
from opswell.registry import query
from opswell.sources import standins as S

cte("runs", """
SELECT stage, CASE line WHEN 1 THEN 'count at Job.scala:' || num_tasks WHEN 2 THEN 'join at Pipe.scala:' || num_tasks WHEN 3 THEN 'map at somewhere'
    WHEN 4 THEN 'sortByKey at Sort.scala:12' WHEN 5 THEN 'Exchange hashpartitioning' WHEN 6 THEN 'WholeStagedCodegen (3)' ELSE 'repartition at X.scala:9' END AS stage_name,
  CASE line WHEN 1 THEN 'count' WHEN 2 THEN 'join' WHEN 3 THEN 'map' WHEN 4 THEN 'sortByKey' WHEN 7 THEN 'repartition' END AS op,
  line, num_tasks, CASE WHEN flag <> 'R' THEN bytes * 20 ELSE 0 END AS written, CASE WHEN flag = 'N' THEN 0 ELSE quantity END AS readb, quantity * 2000000000 AS duration_ns,
  CASE WHEN line IN (1, 2) THEN 'aggregation' WHEN line = 3 THEN 'transformation' END AS x,
  CASE priority WHEN '1-URGENT' THEN 'join' WHEN '2-HIGH' THEN 'aggregation' WHEN '3-MEDIUM' THEN 'transformation' WHEN '5-LOW' THEN 'union' END AS lineage_vote
FROM stages""", "stages")
cte("scored", """
SELECT *, coalesce(nv, lineage_vote) AS operation, CASE WHEN nv = lineage_vote THEN 0.4::DOUBLE + 0.3::DOUBLE WHEN nv IS NOT NULL THEN 0.4::DOUBLE WHEN lineage_vote IS NOT NULL THEN 0.3::DOUBLE END AS confidence,
  CASE WHEN written > 0 AND readb > 0 THEN 'shuffle_exchange' WHEN written > 0 THEN 'shuffle_producer' WHEN readb > 0 THEN 'shuffle_consumer' ELSE 'narrow_transformation' END AS shuffle
FROM (SELECT *, CASE line WHEN 1 THEN 'aggregation' WHEN 2 THEN 'join' WHEN 3 THEN 'transformation' END AS nv FROM runs)""", "runs")


def runs(t):
    """Stages of orders with the name their line number stands for and a lineage by the order's priority."""
    line, pri = F.col("line"), F.col("priority")
    n = F.col("num_tasks")
    name = (
        F.when(line == 1, F.concat(F.lit("count at Job.scala:"), n))
        .when(line == 2, F.concat(F.lit("join at Pipe.scala:"), n))
        .when(line == 3, F.lit("map at somewhere"))
        .when(line == 4, F.lit("sortByKey at Sort.scala:12"))
        .when(line == 5, F.lit("Exchange hashpartitioning"))
        .when(line == 6, F.lit("WholeStagedCodegen (3)"))
        .otherwise(F.lit("repartition at X.scala:9"))
    )
    lineage = (
        F.when(pri == "1-URGENT", F.lit("ShuffledRDD,CoGroupedRDD"))
        .when(pri == "2-HIGH", F.lit("ShuffledRDD"))
        .when(pri == "3-MEDIUM", F.lit("FileScanRDD,MapPartitionsRDD"))
        .when(pri == "5-LOW", F.lit("UnionRDD"))
    )
    return S.stages(t).select(
        "stage",
        name.alias("stage_name"),
        lineage.alias("rdd_types"),
        F.when(F.col("flag") != "R", F.col("bytes") * 20).otherwise(0).alias("written"),
        F.when(F.col("flag") == "N", 0).otherwise(F.col("quantity")).alias("read"),
        (F.col("quantity") * 2_000_000_000).alias("duration_ns"),
    )


def classified(t):
    rows = C.scored(C.named(runs(t)), "stage")
    return rows.withColumn("shuffle", C.shuffle_class("written", "read"))


@query("cls01", sql("runs", """
SELECT stage, op AS operation_type, CASE line WHEN 1 THEN 'Job.scala' WHEN 2 THEN 'Pipe.scala' WHEN 4 THEN 'Sort.scala' WHEN 7 THEN 'X.scala' END AS source_file,
  CASE line WHEN 1 THEN num_tasks WHEN 2 THEN num_tasks WHEN 4 THEN 12 WHEN 7 THEN 9 END AS source_line FROM runs"""))
def stage_names(t):
    return C.named(runs(t)).select("stage", "operation_type", "source_file", "source_line")


@query("cls02", sql("scored", "SELECT stage, operation, confidence, confidence < 0.7::DOUBLE AS low_confidence FROM scored"))
def operations(t):
    return classified(t).select("stage", "operation", "confidence", "low_confidence")


@query("cls03", sql("scored", "SELECT stage, shuffle FROM scored"))
def shuffle_classes(t):
    return classified(t).select("stage", "shuffle")


@query("cls04", sql("runs", """
SELECT stage, CASE WHEN written > 100000000 THEN 'very_high' WHEN written > 10000000 THEN 'high' WHEN written > 1000000 THEN 'medium' WHEN written > 0 THEN 'low' ELSE 'none' END AS intensity FROM runs"""))
def intensities(t):
    return runs(t).select("stage", C.shuffle_intensity("written").alias("intensity"))


@query("cls05", sql("scored", """
SELECT stage, CASE WHEN (shuffle = 'shuffle_producer' AND operation IN ('aggregation', 'join')) OR (shuffle = 'shuffle_consumer' AND operation = 'join')
  OR (shuffle = 'narrow_transformation' AND operation IN ('transformation', 'filter')) THEN least(confidence + 0.3::DOUBLE, 1.0::DOUBLE) ELSE confidence END AS confidence FROM scored"""))
def refined(t):
    return classified(t).select("stage", C.refined("operation", "shuffle", "confidence").alias("confidence"))


@query("cls06", sql("scored", """
SELECT stage, CASE WHEN shuffle = 'shuffle_producer' THEN CASE WHEN operation = 'aggregation' THEN 'groupby' WHEN operation = 'join' THEN 'join'
  WHEN line = 4 THEN 'sort' WHEN line = 7 THEN 'repartition' END WHEN shuffle = 'narrow_transformation' THEN 'none' END AS reason FROM scored"""))
def reasons(t):
    return classified(t).select("stage", C.shuffle_reason("operation", "shuffle", "stage_name").alias("reason"))


@query("cls07", sql("runs", """
SELECT stage, CASE line WHEN 5 THEN 'shuffle_exchange' WHEN 6 THEN 'codegen' END AS mode, CASE line WHEN 5 THEN 'hash' END AS partitioning FROM runs"""))
def modes(t):
    return runs(t).select("stage", C.execution_mode("stage_name").alias("mode"), C.partitioning("stage_name").alias("partitioning"))


@query("cls08", sql("scored", """
SELECT stage, nullif(array_to_string(list_filter([CASE WHEN written > 100000000 AND operation = 'aggregation' THEN 'High-cardinality groupBy - consider pre-aggregation' END,
  CASE WHEN written > 500000000 AND operation = 'join' THEN 'Large join shuffle - consider broadcast join if one side is small' END,
  CASE WHEN duration_ns > 60000000000 THEN 'Long-running stage (' || duration_ns // 1000000 || 'ms) - investigate task skew' END], lambda x: x IS NOT NULL), '; '), '') AS hint FROM scored"""))
def hints(t):
    return classified(t).select("stage", C.hints("operation", "written", "duration_ns").alias("hint"))
