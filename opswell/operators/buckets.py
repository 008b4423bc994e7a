"""Aggregates over fixed time buckets. A bucket is named by the epoch second it starts at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from opswell.functions.text import col


def bucket_of(ts: Column | str, seconds: int) -> Column:
    """Start of the bucket an instant falls in."""
    return bucket_of_seconds(F.unix_seconds(col(ts)), seconds)


def bucket_of_seconds(at: Column | str, seconds: int) -> Column:
    return F.floor(col(at) / seconds) * F.lit(seconds).cast("long")


def by_bucket(df: DataFrame, ts: str, seconds: int, keys: Sequence[str], **aggs: Column) -> DataFrame:
    return df.groupBy(bucket_of(ts, seconds).alias("bucket"), *keys).agg(*[e.alias(n) for n, e in aggs.items()])


def top_groups(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The n values of a key with the most rows; equal counts go by the value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.asc(key)).limit(n)


def within_top(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Rows of the n largest groups. The side that is broadcast has n rows."""
    top = F.broadcast(top_groups(df, key, n).select(F.col(key).alias("_top")))
    return df.join(top, F.col(key) == F.col("_top"), "left_semi")


def fill_gaps(df: DataFrame, keys: Sequence[str], seconds: int, fill: dict[str, object]) -> DataFrame:
    """Adds the buckets that no row fell in, for every group, between the first and last bucket of all."""
    ends = df.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    spine = df.select(*keys).distinct().select(
        *keys,
        F.explode(
            F.sequence(ends.select("lo").scalar(), ends.select("hi").scalar(), F.lit(seconds).cast("long"))
        ).alias("bucket"),
    )
    return spine.join(df, [*keys, "bucket"], "left").fillna(fill)


def earlier_bucket(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Value of the bucket before. Rows are one per bucket, so a group is as long as the calendar, not the data."""
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy("bucket")))


def capped_derivative(df: DataFrame, keys: Sequence[str], column: str, name: str, cap: float = 100.0) -> DataFrame:
    """Difference to the bucket before: null when negative, at most cap."""
    out = earlier_bucket(df, keys, column, "_prev")
    d = F.col(column) - F.col("_prev")
    return out.withColumn(name, F.when(d >= 0, F.least(d.cast("double"), F.lit(float(cap))))).drop("_prev")


def derivative_or_share(df: DataFrame, keys: Sequence[str], column: str, name: str, seconds: float = 60.0) -> DataFrame:
    """Difference to the bucket before; on a restart or in the first bucket the value itself over the seconds."""
    out = earlier_bucket(df, keys, column, "_prev")
    d = F.col(column) - F.col("_prev")
    return out.withColumn(
        name, F.when(d >= 0, d.cast("double")).otherwise(F.col(column).cast("double") / seconds)
    ).drop("_prev")


def difference_or_zero(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    out = earlier_bucket(df, keys, column, "_prev")
    return out.withColumn(name, F.coalesce(F.col(column) - F.col("_prev"), F.lit(0))).drop("_prev")


def violations(
    df: DataFrame, keys: Sequence[str], violated: Column, needed: int, samples: int, clear: int
) -> DataFrame:
    """Alert state over the last samples: raised when enough of them violate, cleared after enough good ones.

    Expects one row per key and bucket.
    """
    w = Window.partitionBy(*keys).orderBy("bucket")
    bad = violated.cast("int")
    out = df.withColumn("violating", F.sum(bad).over(w.rowsBetween(-(samples - 1), 0)))
    out = out.withColumn("raised", F.col("violating") >= needed)
    recent = w.rowsBetween(-(clear - 1), 0)
    return out.withColumn(
        "cleared", (F.sum(bad).over(recent) == 0) & (F.count(F.lit(1)).over(recent) == clear)
    )
