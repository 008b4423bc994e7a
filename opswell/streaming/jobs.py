"""The operators as continuous jobs. Each gives what its batch twin gives on the rows it has seen."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Groups that starts and ends meet in, by a hash of their key, and rows that are put out at a time.
BUCKETS, AT_A_TIME = 512, 100_000


def _dealt(rows: DataFrame, is_start: bool, late: str, until, texts: Sequence, width: int) -> DataFrame:
    """Rows (uid, time) of one side as they go into their groups, further columns as text."""
    # Rows without a time meet nothing. pandas has no times beyond these years; what is compared is `at`.
    dated = rows.where("time IS NOT NULL").withColumn("_time", F.least(F.greatest("time", F.lit("1700-01-01").cast("timestamp")), F.lit("2260-01-01").cast("timestamp")))
    carried = [*texts, *[F.lit(None)] * (width - len(texts))]
    return dated.withWatermark("_time", late).select(
        "_time",
        F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.lit(is_start).alias("is_start"),
        "uid",
        F.unix_micros("time").alias("at"),
        (F.lit(0) if until is None else F.unix_micros(until)).cast("long").alias("until"),
        *[c.cast("string").alias(f"c{i}") for i, c in enumerate(carried)],
    )


class _Meeting(StatefulProcessor):
    """Keeps the starts and ends of one group of keys that later rows may still meet, as one table.

    unmatched: a start is put out when no end can come any more and none has come,
    and forgotten when one comes; otherwise every pair is put out once.
    """

    def __init__(self, width: int, unmatched: bool):
        self.width, self.unmatched = width, unmatched

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.columns = ["is_start", "uid", "at", "until", *(f"c{i}" for i in range(self.width))]
        self.schema = pa.schema([("is_start", pa.bool_()), ("uid", pa.string()), ("at", pa.int64()), ("until", pa.int64()), *((f"c{i}", pa.string()) for i in range(self.width))])
        fields = [T.StructField("timer", T.LongType()), T.StructField("rows", T.BinaryType())]
        self.handle, self.state = handle, handle.getValueState("held", T.StructType(fields))

    def _read(self) -> tuple[int | None, pa.Table]:
        held = self.state.get()
        if held is None:
            return None, self.schema.empty_table()
        with pa.ipc.open_stream(held[1]) as rows:
            return held[0], rows.read_all()

    def _keep(self, rows: pa.Table, before: pa.Table, timer: int | None) -> None:
        """Holds the rows in place of those before; the group is called again when the first start can be put out."""
        ends = rows["until"].to_numpy()[rows["is_start"].to_numpy()] if self.unmatched else []
        due = -(-int(ends.min()) // 1000) if len(ends) else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if not len(rows):
            if len(before):
                self.state.clear()
            return
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_table(rows.combine_chunks())
        self.state.update((due, out.getvalue().to_pybytes()))

    def _put_out(self, rows: pa.Table) -> Iterator[pd.DataFrame]:
        for a in range(0, len(rows), AT_A_TIME):
            yield rows.slice(a, AT_A_TIME).to_pandas()

    def _waiting(self, rows: pa.Table, watermark: int) -> tuple[pa.Table, pa.Table]:
        """What later rows, all of them after the watermark, may meet, and the starts that they may not."""
        is_start, at, until = (rows[c].to_numpy() for c in ("is_start", "at", "until"))
        waits = np.where(is_start, until, at) > watermark
        return rows.filter(pa.array(waits)), rows.filter(pa.array(is_start & ~waits))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, held = self._read()
        new = [pa.Table.from_pandas(x[self.columns], self.schema, preserve_index=False) for x in rows]
        both = pa.concat_tables([held, *new]).combine_chunks()
        is_start, at, until = (both[c].to_numpy() for c in ("is_start", "at", "until"))
        uid = both["uid"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        starts, ends = np.flatnonzero(is_start & (uid >= 0)), np.flatnonzero(~is_start & (uid >= 0))
        # An end's place is its key and then its rank in time, so the ends that a start meets follow one another.
        times = np.sort(at[ends])
        place = uid[ends].astype(np.int64) * (len(ends) + 1) + np.searchsorted(times, at[ends])
        order = np.argsort(place, kind="stable")
        ends, place = ends[order], place[order]
        base = uid[starts].astype(np.int64) * (len(ends) + 1)
        low = np.searchsorted(place, base + np.searchsorted(times, at[starts]))
        high = np.maximum(low, np.searchsorted(place, base + np.searchsorted(times, until[starts], "right")))
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.unmatched:
            open_ = np.ones(len(both), bool)
            open_[starts[high > low]] = False
            waiting, over = self._waiting(both.filter(pa.array(open_)), watermark)
            found = self._put_out(over.select(self.columns[4:]))
        else:
            waiting, _ = self._waiting(both, watermark)
            found = self._pairs(both, len(held), starts, low, high, ends)
        self._keep(waiting, held, timer)
        return found

    def _pairs(self, both: pa.Table, held: int, starts, low, high, ends) -> Iterator[pd.DataFrame]:
        """The pairs of which one side is not among the first `held` rows."""
        carried = both.select(self.columns[4:])
        counts = high - low
        # Cut where the pairs so far pass the next AT_A_TIME; a start has its pairs in one part.
        number = (np.cumsum(counts) - counts) // AT_A_TIME
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(starts)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            n = counts[a:b]
            s = np.repeat(starts[a:b], n)
            e = ends[np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            fresh = (s >= held) | (e >= held)
            left, right = carried.take(pa.array(s[fresh])), carried.take(pa.array(e[fresh]))
            yield from self._put_out(pa.table([*left.columns, *right.columns], [*(f"s{i}" for i in range(self.width)), *(f"e{i}" for i in range(self.width))]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, held = self._read()
        waiting, over = self._waiting(held, timerValues.getCurrentWatermarkInMs() * 1000)
        # Spark drops the timer that has called.
        self._keep(waiting, held, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        return self._put_out(over.select(self.columns[4:]))

    def close(self) -> None:
        pass


def _met(starts: DataFrame, ends: DataFrame, late: str, longest: str, of_start: Sequence, of_end: Sequence, unmatched: bool) -> DataFrame:
    """Starts and ends (uid, time) with the columns named, as text: c0, c1, ... of starts without an end, or s0, ... and e0, ... of pairs.

    A group of keys holds its rows as one table, which is read and written once a
    batch, however many of its rows meet in the batch. So most never get into the
    state, and none is looked up there by itself.
    """
    width = max(len(of_start), len(of_end))
    both = _dealt(starts, True, late, F.expr(f"time + INTERVAL {longest}"), of_start, width).unionByName(_dealt(ends, False, late, None, of_end, width))
    names = [f"c{i}" for i in range(width)] if unmatched else [f"{side}{i}" for side in "se" for i in range(width)]
    return both.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Meeting(width, unmatched),
        outputStructType=", ".join(f"{n} string" for n in names),
        outputMode="Append",
        timeMode="EventTime",
    )


def match(starts: DataFrame, ends: DataFrame, late: str, longest: str) -> DataFrame:
    """Ends joined to their starts as both arrive; a start is forgotten when no end can come any more.

    starts, ends: normalised events as streams, other kinds do not count; late: how much too late a row may come;
    longest: the longest interval.
    """
    starts = starts.where("event_kind = 'Start'").select(F.col("event_uid").alias("uid"), F.col("ts").alias("time"), "start_millis", "trace_id")
    ends = ends.where("event_kind = 'End'").select(F.col("start_event_uid").alias("uid"), F.col("ts").alias("time"), "start_millis", "class")
    met = _met(starts.where("uid IS NOT NULL"), ends.where("uid IS NOT NULL"), late, longest, [F.col("start_millis"), F.col("trace_id")], [F.col("start_millis"), F.col("class")], unmatched=False)
    pairs = met.select(F.col("s1").alias("trace_id"), F.col("e1").alias("class"), F.col("s0").cast("long").alias("start_ms"), F.col("e0").cast("long").alias("end_ms"))
    return pairs.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def rollup(df: DataFrame, ts: str, keys: Sequence[str], late: str = "60 seconds", width: str = "1 minute") -> DataFrame:
    """Rows and newest time per bucket; a bucket is given once, when no row of it can come any more."""
    return (
        df.withWatermark(ts, late)
        .groupBy(F.window(ts, width), *keys)
        .agg(F.count(F.lit(1)).alias("log_count"), F.max(ts).alias("bucket_end"))
        .select(F.unix_seconds("window.start").alias("bucket"), *keys, "log_count", "bucket_end")
    )


def once(df: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return (
        df.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"))
        .select(key, "first_ts", "n")
    )


def open_counts(points: DataFrame, keys: Sequence[str], change: str) -> DataFrame:
    """What is open per key after every batch; to be written in complete or update mode."""
    return points.groupBy(*keys).agg(F.sum(change).alias("open"))


class _Rates(StatefulProcessor):
    """Keeps the last time and the last value taken up per measure of one key, until the key has been silent for too long."""

    def __init__(self, keys: list[str], at: str, tie: str, measures: list[str], idle: int | None):
        self.keys, self.at, self.tie, self.measures, self.idle = keys, at, tie, measures, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("at", T.LongType())] + [T.StructField(m, T.LongType()) for m in self.measures]
        self.handle, self.state = handle, handle.getValueState("last", T.StructType(fields))

    def _ends(self, at: int) -> int:
        """The first millisecond at which a key last seen at `at` is idle."""
        return (at + self.idle) * 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The rows of one key in one batch; the size of a batch is bounded by the source's trigger.
        # Rows without a time come first, as in the batch twin; those without a tie last.
        place = lambda r: (r[self.at] is not None, r[self.at], r[self.tie] is None, r[self.tie])
        held = self.state.get()
        before = None if held is None else held[0]
        last, known = before, [None] * len(self.measures) if held is None else list(held[1:])
        result = Row(*self.keys, self.tie, *[f"{m}_rate" for m in self.measures])
        out = []
        for row in sorted(rows, key=place):
            at, values = row[self.at], [row[m] for m in self.measures]
            gap = None if at is None or last is None else at - last
            if gap is None or (self.idle is not None and gap > self.idle):
                known, found = values, [None] * len(values)
            elif gap > 0:
                found = [None if v is None or k is None or v < k else float(v - k) / gap for v, k in zip(values, known)]
                known = [k if v is None else v for v, k in zip(values, known)]
            else:
                found = [None] * len(values)
            last = at
            out.append(result(*[row[k] for k in self.keys], row[self.tie], *found))
        if self.idle is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            if last is not None:
                self.handle.registerTimer(self._ends(last))
        if last is not None:
            self.state.update((last, *known))
        elif held is not None:
            self.state.clear()
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The key has been silent for too long: its next row is a first row, so nothing is kept of it."""
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def counter_rates(
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    tie: str,
    measures: Sequence[str],
    idle_seconds: int | None = 300,
    late: str = "1 second",
) -> DataFrame:
    """Rates with state per key; at is in whole seconds of event time. A key's rows come in time order.

    A row that is older than the newest of all by `late` or more is dropped; less
    than a second would drop rows of the newest second.

    After idle_seconds of silence the next row is a first row. The state of a silent
    key is dropped by a timer as soon as the watermark is past that time.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in [*keys, tie]] + [f"{m}_rate double" for m in measures])
    # A batch has many keys with few rows each, so the fold goes row by row: columns of one key would cost more to make than to read.
    wanted = rows.select(*keys, tie, at, *[F.col(m).cast("long").alias(m) for m in measures], F.timestamp_seconds(at).alias("_event_time"))
    return wanted.withWatermark("_event_time", late).groupBy(*keys).transformWithState(
        statefulProcessor=_Rates(list(keys), at, tie, list(measures), idle_seconds),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime",
    )


def open_starts(starts: DataFrame, ends: DataFrame, late: str, longest: str) -> DataFrame:
    """Starts that no end names, given once none can come any more: `longest` after the start, by the watermark.

    starts, ends: normalised events as streams, other kinds do not count; late: how much too late a row may come.
    An end that comes within that time is in no result, nor is its start.
    """
    starts = starts.where("event_kind = 'Start'").select(F.col("event_uid").alias("uid"), F.col("ts").alias("time"), "class", "service_id", "start_millis")
    ends = ends.where("event_kind = 'End' AND start_event_uid IS NOT NULL").select(F.col("start_event_uid").alias("uid"), F.col("ts").alias("time"))
    carried = [F.col("class"), F.col("service_id"), F.col("start_millis")]
    left = _met(starts, ends, late, longest, carried, [], unmatched=True)
    return left.select(F.col("c0").alias("class"), F.col("c1").alias("service_id"), F.col("c2").cast("long").alias("start_millis"))
