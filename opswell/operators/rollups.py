"""Rollups from partial results that can be added up again, retention, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opswell.operators import segments
from opswell.operators.buckets import bucket_of

DAY = 86_400

# Age from which a bucket is kept at a width, and age at which it goes. Fixed values (seconds).
TIERS = [(0, 300), (4 * DAY, 900), (8 * DAY, 3600)]
KEEP = 730 * DAY


def partials(df: DataFrame, ts: str, seconds: int, keys: Sequence[str], measure: str) -> DataFrame:
    """Count, sum, least and greatest per bucket: enough to build any wider bucket."""
    return df.groupBy(bucket_of(ts, seconds).alias("bucket"), *keys).agg(
        F.count(measure).alias("n"), F.sum(measure).alias("s"), F.min(measure).alias("lo"), F.max(measure).alias("hi")
    )


def widen(parts: DataFrame, width: Column | int, keys: Sequence[str]) -> DataFrame:
    """Wider buckets out of narrower ones."""
    width = F.lit(width) if isinstance(width, int) else width
    bucket = (F.floor(F.col("bucket") / width) * width).cast("long")
    return parts.groupBy(bucket.alias("bucket"), width.alias("width"), *keys).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def tiered(
    df: DataFrame,
    ts: str,
    keys: Sequence[str],
    measure: str,
    as_of: int,
    tiers: Sequence[tuple[int, int]] = TIERS,
    keep: int = KEEP,
) -> DataFrame:
    """Buckets that grow wider with age, the oldest dropped; as_of is an epoch second."""
    narrow = partials(df, ts, tiers[0][1], keys, measure)
    age = F.lit(as_of).cast("long") - F.col("bucket")
    width = F.lit(tiers[0][1])
    for from_age, seconds in tiers[1:]:
        width = F.when(age >= from_age, F.lit(seconds)).otherwise(width)
    return widen(narrow.where(age < keep).withColumn("_width", width), F.col("_width"), keys)


def retained(df: DataFrame, ts: str, dataset: str, days: dict[str, int], as_of: Column) -> DataFrame:
    """Rows younger than their dataset's number of days; datasets without a rule stay."""
    oldest = F.lit(None).cast("timestamp")
    for name, n in days.items():
        oldest = F.when(F.col(dataset) == name, as_of - F.expr(f"INTERVAL {n} DAYS")).otherwise(oldest)
    return df.where(oldest.isNull() | (F.col(ts) >= oldest))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, tie: str, gap_seconds: int, **cut) -> DataFrame:
    """Rows of a key with at most the gap between them as one session: first and last row, number of rows."""
    rows = segments.Ordered(df, keys, [ts, tie], **cut).previous({"_before": ts})
    apart = F.unix_micros(ts) - F.unix_micros("_before")
    starts = F.when(F.col("_before").isNull() | (apart > gap_seconds * 1_000_000), 1).otherwise(0).cast("long")
    rows = rows.plus(_starts=starts).settled().running_sums({"session": "_starts"})
    return rows.df.groupBy(*keys, "session").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")
    )


