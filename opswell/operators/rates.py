"""Cumulative counters: per-second rates and deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opswell.operators import segments


def counter_rates(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    measures: Sequence[str],
    idle_seconds: int | None = None,
    **cut,
) -> DataFrame:
    """Adds <measure>_rate per key in the order of (at, tie); at is in whole seconds.

    A rate needs time to have passed since the row before and a value not below
    the last one taken up; so the first row and a restart have none. A value is
    taken up by the first row and by every row for which time has passed. With
    idle_seconds, a longer silence makes the next row a first row again.
    """
    rows = segments.Ordered(df, keys, [at, tie], **cut).previous({"_prev_at": at})
    rows = rows.plus(_gap=F.col(at) - F.col("_prev_at"))
    first = F.col("_gap").isNull()
    if idle_seconds is not None:
        first = first | (F.col("_gap") > idle_seconds)
    rows = rows.plus(_first=first).settled()
    # What a row hands on: its value and when it was taken up.
    taken = lambda m: F.when(
        (F.col("_first") | (F.col("_gap") > 0)) & F.col(m).isNotNull(), F.struct(F.col(at).alias("at"), F.col(m).alias("v"))
    )
    rows = rows.plus(_since=F.when(F.col("_first"), F.col(at)), **{f"_taken_{m}": taken(m) for m in measures})
    rows = rows.last_known(before={f"_held_{m}": f"_taken_{m}" for m in measures}, upto={"_start": "_since"})

    def rate(m):
        held = F.col(f"_held_{m}")
        # A value from before the last start does not count; a start comes after a gap, so times tell.
        usable = ~F.col("_first") & (F.col("_gap") > 0) & (held["at"] >= F.col("_start")) & (F.col(m) >= held["v"])
        return F.when(usable, (F.col(m) - held["v"]).cast("double") / F.col("_gap"))

    return rows.df.select(*df.columns, *[rate(m).alias(f"{m}_rate") for m in measures])


def deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], measure: str, name: str, **cut) -> DataFrame:
    """Cumulative to delta: the increase since the row before, the value itself after a restart, null at first."""
    out = segments.Ordered(df, keys, order, **cut).previous({"_prev": measure}).df
    return out.withColumn(
        name,
        F.when(F.col("_prev").isNotNull(), F.when(F.col(measure) >= F.col("_prev"), F.col(measure) - F.col("_prev")).otherwise(F.col(measure))),
    ).drop("_prev")


def range_rates(
    df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], measure: str, seconds: int, **cut
) -> DataFrame:
    """Increase inside each bucket of the given length and increase per second, one row per series and bucket."""
    rows = deltas(df.where(F.col(measure).isNotNull()), keys, order, measure, "_delta", **cut)
    bucket = F.floor(F.col(at) / seconds) * F.lit(seconds).cast("long")
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.sum("_delta").alias("increase"), (F.sum("_delta").cast("double") / seconds).alias("rate")
    )
