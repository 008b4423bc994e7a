"""Running medians per key when one key may hold a large share of all rows."""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from opswell.operators import segments
from opswell.session import settle

LEAST_BLOCK = 1024


def _medians(table: pa.Table) -> pa.Table:
    """Medians of the rows of one block of time, which have a row number, from them and the earlier values around."""
    rows = table.to_pylist()
    values = {r["_rank"]: r["_x"] for r in rows}
    own = sorted((r["_time"], r["_rank"], r["_row"]) for r in rows if r["_row"] is not None)
    earlier = [r for r in rows if r["_row"] is None]
    # `below` earlier values are smaller than all that are here.
    seen = sorted(r["_rank"] for r in earlier)
    below = min((r["_below"] for r in earlier), default=0)
    out = []
    for time, rank, _ in own:
        insort(seen, rank)
        out.append((values[seen[(time - 1) // 2 - below]] + values[seen[time // 2 - below]]) / 2)
    return pa.table({"_row": pa.array([row for _, _, row in own], pa.int64()), "_median": pa.array(out, pa.float64())})


def running_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, name: str, block: int | None = None) -> DataFrame:
    """Adds the median of x over the key's rows up to and including each, in an order that is unique within the key.

    Nulls of x do not count; before the first value the median is null.

    A key's values get their places in time and in rank. Both orders are cut into
    blocks of about the root of the largest key's size, and one row per pair of
    blocks counts the values. The median of a block's rows can only be one of them or
    an earlier value that stands, among the earlier ones, within a block's length of
    the earlier median; the counts tell in which blocks of ranks those are. So each
    block of time fetches a few blocks of ranks, early ones more of them: n log n
    rows for n of a key, and no task holds more than a few blocks.
    """
    rows = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    known = rows.where(F.col(x).isNotNull()).select(*keys, *order, F.col(x).cast("double").alias("_x"), "_row")
    timed = settle(segments.Ordered(known, keys, order).row_numbers("_time", total="_n").df)
    ranked = segments.Ordered(timed, keys, ["_x", "_row"]).row_numbers("_rank").df
    largest = timed.agg(F.max("_n")).first()[0] or 0
    size = block or max(LEAST_BLOCK, int(largest**0.5) + 1)
    part = lambda c: F.floor((F.col(c) - 1) / size).cast("long")
    # One text stands for the keys, so that nulls among them meet as well.
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    placed = settle(ranked.select(key.alias("_key"), "_row", "_x", "_time", "_rank", "_n", part("_time").alias("_span"), part("_rank").alias("_block")))

    parts = placed.groupBy("_key").agg(F.max("_span").alias("_last")).where("_last > 0")
    counts = placed.groupBy("_key", "_span", "_block").agg(F.count(F.lit(1)).alias("_c"))
    spans = parts.select("_key", "_last", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_span"))
    grid = spans.select("_key", "_span", F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_block"))
    over_time = Window.partitionBy("_key", "_block").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    over_rank = Window.partitionBy("_key", "_span").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(counts, ["_key", "_span", "_block"], "left")
    filled = filled.withColumn("_earlier", F.coalesce(F.sum("_c").over(over_time), F.lit(0)))
    filled = filled.withColumn("_below", F.coalesce(F.sum("_earlier").over(over_rank), F.lit(0)))
    middle = F.floor(F.col("_span") * size / 2)
    wanted = filled.where((F.col("_earlier") > 0) & (F.col("_below") <= middle + size) & (F.col("_below") + F.col("_earlier") > middle - size))
    wanted = wanted.select("_key", F.col("_span").alias("_for"), "_block", "_below")
    around = placed.join(wanted, ["_key", "_block"]).where(F.col("_span") < F.col("_for")).select(
        "_key", F.col("_for").alias("_span"), F.lit(None).cast("long").alias("_row"), "_x", "_time", "_rank", "_below"
    )
    own = placed.select("_key", "_span", "_row", "_x", "_time", "_rank", F.lit(0).cast("long").alias("_below"))
    found = own.unionByName(around).groupBy("_key", "_span").applyInArrow(_medians, "_row long, _median double")
    joined = settle(rows.join(found, "_row", "left").select(*df.columns, "_median"))
    # A row without a value has the median of the rows before it.
    return segments.Ordered(joined, keys, order).last_known(upto={name: "_median"}).df.select(*df.columns, name)
