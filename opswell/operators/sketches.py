"""Sketches kept per bucket and merged into wider ones, and checks of their answers against exact ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opswell.operators.segments import attach

#: Numbers that a quantile sketch keeps, and the share of the rows by which a rank it answers may be off (with 99 % chance).
KEPT, RANK_ERROR = 1024, 0.006
#: Bits of a distinct sketch's places, and the share by which its count may be off: four standard errors.
PLACES, COUNT_ERROR = 14, 4 * 0.0065


def quantile_sketches(df: DataFrame, keys: Sequence[str], x: str, name: str = "sketch") -> DataFrame:
    """One row per key: n values that are not null, lo, hi, and a sketch of their quantiles."""
    value = F.col(x).cast("double")
    return df.where(value.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.kll_sketch_agg_double(value, F.lit(KEPT)).alias(name)
    )


def merged_quantiles(sketches: DataFrame, keys: Sequence[str], name: str = "sketch") -> DataFrame:
    """The sketches of narrow buckets as one per wider key; the values are not read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double(name, F.lit(KEPT)).alias(name))


def quantiles(sketches: DataFrame, at: dict[str, float], name: str = "sketch") -> DataFrame:
    """The sketch replaced by its quantiles; at: result name -> share."""
    found = {n: F.kll_sketch_get_quantile_double(name, F.lit(p)) for n, p in at.items()}
    return sketches.withColumns(found).drop(name)


def ranks_within(df: DataFrame, keys: Sequence[str], x: str, answers: DataFrame, at: dict[str, float], error: float = RANK_ERROR) -> DataFrame:
    """Adds <name>_within: whether the share of values below an answer and that up to it hold the wanted share, give or take `error`.

    The values are counted against their key's answers in one pass; a merged sketch
    counts once more for what was lost before merging, so its error is twice.
    """
    value = F.col(x).cast("double")
    asked = answers.select(*keys, *[F.col(n).alias(f"_at_{n}") for n in at])
    met = attach(df.where(value.isNotNull()).select(*keys, value.alias("_x")), asked, keys, "inner")
    counts = []
    for n in at:
        counts += [F.count_if(F.col("_x") < F.col(f"_at_{n}")).alias(f"_below_{n}"), F.count_if(F.col("_x") <= F.col(f"_at_{n}")).alias(f"_upto_{n}")]
    counted = attach(answers, met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *counts), keys)
    inside = {f"{n}_within": (F.col(f"_below_{n}") <= (p + 2 * error) * F.col("_n") + 1) & (F.col(f"_upto_{n}") >= (p - 2 * error) * F.col("_n") - 1) for n, p in at.items()}
    return counted.withColumns(inside).select(*answers.columns, *inside)


def distinct_sketches(df: DataFrame, keys: Sequence[str], x: Column, name: str = "sketch") -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_sketch_agg(x, F.lit(PLACES)).alias(name))


def merged_distinct(sketches: DataFrame, keys: Sequence[Column | str], result: str, name: str = "sketch") -> DataFrame:
    """Distinct values of wider keys, from the sketches of narrower ones."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(result))


def count_within(estimate: str, exact: str, error: float = COUNT_ERROR) -> Column:
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), error * F.col(exact))

