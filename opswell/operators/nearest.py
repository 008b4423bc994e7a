"""The newest rows inside a time range, for many ranges at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opswell import session
from opswell.operators import segments


def newest_between(
    lines: DataFrame,
    line_id: str,
    at: str,
    asks: DataFrame,
    ask_id: str,
    lo: str,
    hi: str,
    keys: Sequence[str],
    k: int,
    **cut,
) -> DataFrame:
    """For every ask, the k newest lines of its keys with lo <= at <= hi, newest first.

    Joining every line in range and cutting afterwards would pair a hot key's
    lines with all its asks. Instead lines are numbered per key, the ends of the
    ranges are turned into numbers in the same count, and only the k numbers an
    ask wants are looked up.
    """
    # At equal times a range opens before and closes after the lines.
    opening, line, closing = 0, 1, 2

    def mark(df, time, kind, key, n):
        return df.select(*keys, F.col(time).alias("_at"), F.lit(kind).alias("_kind"), F.col(key).alias("_id"), F.lit(n).alias("_n"))

    marks = mark(lines, at, line, line_id, 1).unionByName(mark(asks, lo, opening, ask_id, 0)).unionByName(mark(asks, hi, closing, ask_id, 0))
    counted = segments.Ordered(marks, keys, ["_at", "_kind", "_id"], measured=lines.select(F.col(at).alias("_at")), **cut)
    counted = session.settle(counted.running_sums({"_pos": "_n"}).df)
    numbers = counted.where(F.col("_kind") == line).select(
        *keys, F.col("_pos").alias("_number"), F.col("_id").alias(line_id), F.col("_at").alias(at)
    )
    first = F.max(F.when(F.col("_kind") == opening, F.col("_pos")))
    last = F.max(F.when(F.col("_kind") == closing, F.col("_pos")))
    wanted = counted.where(F.col("_kind") != line).groupBy(*keys, F.col("_id").alias(ask_id)).agg(first.alias("_lo"), last.alias("_hi"))
    wanted = wanted.where(F.col("_hi") > F.col("_lo")).select(
        *keys,
        ask_id,
        "_hi",
        F.explode(F.sequence(F.greatest(F.col("_lo"), F.col("_hi") - k) + 1, F.col("_hi"))).alias("_number"),
    )
    return wanted.join(numbers, [*keys, "_number"]).select(
        *keys, ask_id, line_id, at, (F.col("_hi") - F.col("_number") + 1).alias("place")
    )
