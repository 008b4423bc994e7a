"""Table-to-table operators: shares, failure rates, lifetimes, lookups, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from opswell import session
from opswell.functions.numbers import ratio
from opswell.functions.text import col


def weighted_share(
    df: DataFrame, keys: Sequence[str], amount: Column | str, code: Column | str, weights: dict[str, float]
) -> DataFrame:
    """Per group: amount of the weighted codes, amount of all, and their ratio (null when all is 0).

    Codes that are not named weigh 0.
    """
    weight = F.lit(0.0)
    for value, w in weights.items():
        weight = F.when(F.trim(col(code)) == value, F.lit(float(w))).otherwise(weight)
    return (
        df.groupBy(*keys)
        .agg(F.sum(col(amount) * weight).alias("part"), F.sum(col(amount)).alias("whole"))
        .withColumn("share", ratio("part", "whole"))
    )


def failure_rates(df: DataFrame, keys: Sequence[str], failure: str) -> DataFrame:
    """Days on duty, failures and failures per day of duty in one pass."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("drive_days"), F.sum(failure).alias("failures"))
        .withColumn("failure_rate", ratio("failures", "drive_days"))
    )


def failure_rates_by_join(df: DataFrame, keys: Sequence[str], failure: str) -> DataFrame:
    """The same from two tables: days of all rows and a count of the failed ones."""
    days = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("drive_days"))
    failed = df.where(F.col(failure) == 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("failures"))
    return (
        days.join(failed, list(keys), "left")
        .fillna(0, ["failures"])
        .withColumn("failure_rate", ratio("failures", "drive_days"))
    )


def lifetimes(df: DataFrame, key: str, day: str, failure: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count(F.lit(1)).alias("days"),
        F.sum(failure).alias("failures"),
        F.date_diff(F.max(day), F.min(day)).alias("span_days"),
    )


def most_common(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group, the smaller one on a tie. Counted before it is compared."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col("_n"), (-F.col(value)).alias("v"))).alias(name), F.max("_n").alias("n")
    )


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key. An aggregate, so a key's rows shrink to one before they are moved."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def oldest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_columns(frames: Sequence[DataFrame], required: Sequence[str] = ()) -> DataFrame:
    """Union on the columns that all tables have; the required ones must be among them."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"columns missing from a table: {missing}")
    return reduce(lambda a, b: a.union(b), [f.select(*names) for f in frames])


def schema_difference(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Columns only in a, columns only in b."""
    return sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns the table lacks as nulls of the given type."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def cast_prefixed(df: DataFrame, prefix: str, dtype: str) -> DataFrame:
    """Casts every column whose name starts with the prefix; text that does not fit becomes null."""
    return df.select(*[F.col(c).try_cast(dtype).alias(c) if c.startswith(prefix) else F.col(c) for c in df.columns])


def top_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """All rows with their place in the group (sample_no), the group's size (of_total), and whether they are among the first k (shown)."""
    from opswell.operators import segments

    return segments.Ordered(session.settle(df), keys, order).row_numbers("sample_no", total="of_total").df.withColumn("shown", F.col("sample_no") <= k)


def batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """All rows with the number, from 0, of the batch of `size` rows that takes them, the first in order first."""
    from opswell.operators import segments

    placed = segments.Ordered(session.settle(df), [], order).row_numbers("_place").df
    return placed.withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")
