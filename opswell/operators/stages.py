"""Classes and hints for execution stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opswell.functions import text as X

# Operation in a stage name to operation class. Fixed values.
NAME_CLASSES = {
    "aggregation": ["count", "groupby", "reducebykey", "aggregatebykey"],
    "join": ["join", "cogroup", "leftjoin", "rightjoin", "outerjoin"],
    "filter": ["filter"],
    "transformation": ["map", "mappartitions", "flatmap", "mapvalues"],
    "union": ["union"],
    "distinct": ["distinct"],
}
NAME_WEIGHT, LINEAGE_WEIGHT, SHUFFLE_WEIGHT, SURE = 0.4, 0.3, 0.3, 0.7

# Lower ends of the written bytes of an intensity, highest first. Fixed values.
INTENSITIES = [(100_000_000, "very_high"), (10_000_000, "high"), (1_000_000, "medium"), (0, "low")]

# Shuffle classes that confirm an operation class. Fixed values.
CONFIRMED = {
    "shuffle_producer": ["aggregation", "join"],
    "shuffle_consumer": ["join"],
    "narrow_transformation": ["transformation", "filter"],
}


def named(df: DataFrame, name: str = "stage_name") -> DataFrame:
    """Adds operation, source file and line of "op at File:line"; of any other "op at ..." only the operation."""
    out = X.once(df, _g=X.groups(name, "^(\\w+)\\s+at\\s+([^:]+):(\\d+)", 3))
    g = F.col("_g")
    loose = F.when(F.col(name).contains(" at "), F.trim(F.split(F.col(name), " at ")[0]))
    return out.select(
        *df.columns,
        F.coalesce(g[0], loose).alias("operation_type"),
        g[1].alias("source_file"),
        g[2].try_cast("int").alias("source_line"),
    )


def scored(df: DataFrame, key: str, operation: str = "operation_type", lineage: str = "rdd_types") -> DataFrame:
    """Adds the operation class with the highest score, its confidence, and whether that is low.

    The name and the lineage each vote for one class; with no vote there is no
    class. On equal scores the class that comes first in the alphabet wins.
    """
    by_name = F.lit(None).cast("string")
    for cls, names in NAME_CLASSES.items():
        by_name = F.when(F.lower(operation).isin(names), F.lit(cls)).otherwise(by_name)
    has = lambda text: F.col(lineage).contains(text)
    by_lineage = (
        F.when(has("ShuffledRDD"), F.when(has("CoGroupedRDD"), F.lit("join")).otherwise(F.lit("aggregation")))
        .when(has("MapPartitionsRDD"), F.lit("transformation"))
        .when(has("UnionRDD"), F.lit("union"))
    )
    out = df.withColumns({"_name": by_name, "_lineage": by_lineage})
    a, b = F.col("_name"), F.col("_lineage")
    # Two votes at most: they agree, or the heavier one wins, or only one is there.
    return out.select(
        *df.columns,
        F.coalesce(a, b).alias("operation"),
        F.when(a.isNotNull() & b.isNotNull() & (a == b), F.lit(NAME_WEIGHT + LINEAGE_WEIGHT))
        .when(a.isNotNull(), F.lit(NAME_WEIGHT))
        .when(b.isNotNull(), F.lit(LINEAGE_WEIGHT))
        .alias("confidence"),
    ).withColumn("low_confidence", F.col("confidence") < SURE)


def shuffle_class(written: Column | str, read: Column | str) -> Column:
    w, r = X.col(written) > 0, X.col(read) > 0
    return (
        F.when(w & ~r, F.lit("shuffle_producer"))
        .when(~w & r, F.lit("shuffle_consumer"))
        .when(w & r, F.lit("shuffle_exchange"))
        .otherwise(F.lit("narrow_transformation"))
    )


def shuffle_intensity(written: Column | str) -> Column:
    out = F.lit("none")
    for above, name in reversed(INTENSITIES):
        out = F.when(X.col(written) > above, F.lit(name)).otherwise(out)
    return out


def refined(operation: Column | str, shuffle: Column | str, confidence: Column | str) -> Column:
    """Confidence raised where the shuffle fits the operation, 1 at most."""
    fits = F.lit(False)
    for cls, operations in CONFIRMED.items():
        fits = fits | ((X.col(shuffle) == cls) & X.col(operation).isin(operations))
    return F.when(F.coalesce(fits, F.lit(False)), F.least(X.col(confidence) + SHUFFLE_WEIGHT, F.lit(1.0))).otherwise(X.col(confidence))


def shuffle_reason(operation: Column | str, shuffle: Column | str, name: Column | str) -> Column:
    producer = X.col(shuffle) == "shuffle_producer"
    says = lambda word: F.lower(X.col(name)).contains(word)
    return (
        F.when(producer & (X.col(operation) == "aggregation"), F.lit("groupby"))
        .when(producer & (X.col(operation) == "join"), F.lit("join"))
        .when(producer & says("sort"), F.lit("sort"))
        .when(producer & says("repartition"), F.lit("repartition"))
        .when(X.col(shuffle) == "narrow_transformation", F.lit("none"))
    )


def execution_mode(name: Column | str) -> Column:
    """The spelling of the first word is that of the records this is matched against."""
    text = F.lower(X.col(name))
    return F.when(text.contains("wholestagedcodegen"), F.lit("codegen")).when(text.contains("exchange"), F.lit("shuffle_exchange"))


def partitioning(name: Column | str) -> Column:
    text = F.lower(X.col(name))
    return F.when(
        execution_mode(name) == "shuffle_exchange",
        F.when(text.contains("hashpartitioning"), F.lit("hash")).when(text.contains("rangepartitioning"), F.lit("range")),
    )


def hints(operation: Column | str, written: Column | str, duration_ns: Column | str) -> Column:
    """Advice joined by "; ", null when there is none."""
    op, w, d = X.col(operation), X.col(written), X.col(duration_ns)
    found = F.array_compact(
        F.array(
            F.when((w > 100_000_000) & (op == "aggregation"), F.lit("High-cardinality groupBy - consider pre-aggregation")),
            F.when((w > 500_000_000) & (op == "join"), F.lit("Large join shuffle - consider broadcast join if one side is small")),
            F.when(
                d > 60_000_000_000,
                F.concat(F.lit("Long-running stage ("), F.call_function("div", d, F.lit(1_000_000)), F.lit("ms) - investigate task skew")),
            ),
        )
    )
    return X.present(F.array_join(found, "; "))
