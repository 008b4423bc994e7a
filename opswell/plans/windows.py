"""Window results: extremes, ranks, neighbours, running and sliding frames, rates and thresholds.

A station has one reading per day, so its rows are as many as the calendar has
days and plain windows hold them. Windows over a month or a kind of event hold a
share of the whole table and go through operators.segments.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from opswell.functions.numbers import cents
from opswell.functions.times import month_ordinal
from opswell.operators import buckets, medians as M, rates, segments, tables
from opswell.plans.aggregates import DAY, HOUR, gauges
from opswell.plans.ctes import sql
from opswell.registry import query
from opswell.sources import standins as S


@query("win01", sql("weather", """
SELECT stn, mo, da, temp, temp = lo AS is_lowest FROM (
  SELECT *, min(temp) OVER (PARTITION BY year, mo) AS lo, max(temp) OVER (PARTITION BY year, mo) AS hi FROM weather) WHERE temp = lo OR temp = hi"""))
def extremes(t):
    w = S.readings(t)
    ends = w.groupBy("year", "mo").agg(F.min("temp").alias("lo"), F.max("temp").alias("hi"))
    rows = segments.attach(w, ends, ["year", "mo"]).where("temp = lo OR temp = hi")
    return rows.select("stn", "mo", "da", "temp", (F.col("temp") == F.col("lo")).alias("is_lowest"))


@query("win02", sql("weather", """
SELECT stn, year, mo, da, temp FROM (SELECT *, max(temp) OVER (PARTITION BY year, mo, da) AS hi FROM weather) WHERE temp = hi"""))
def warmest_station(t):
    w = S.readings(t)
    day = ["year", "mo", "da"]
    top = w.groupBy(*day).agg(F.max("temp").alias("hi"))
    return segments.attach(w, top, day).where("temp = hi").select("stn", *day, "temp")


def ranked(t):
    w = S.readings(t)
    return segments.attach(w, segments.value_ranks(w, ["mo"], "count_temp"), ["mo", "count_temp"])


@query("win03", sql("weather", """
SELECT stn, mo, da, count_temp, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM weather WINDOW w AS (PARTITION BY mo ORDER BY count_temp)"""))
def ranks(t):
    return ranked(t).select(
        "stn", "mo", "da", "count_temp", (F.col("below") + 1).alias("rank"), F.col("distinct").alias("dense_rank")
    )


@query("win04", sql("weather", """
SELECT stn, mo, da, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist FROM weather WINDOW w AS (PARTITION BY mo ORDER BY count_temp)"""))
def relative_ranks(t):
    share = F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return ranked(t).select(
        "stn", "mo", "da", share.alias("percent_rank"), ((F.col("below") + F.col("n")) / F.col("total")).alias("cume_dist")
    )


def tile(tiles: int):
    """Number of the tile of a row, from its place and the size of its group; the first tiles take the remainder."""
    n, place = F.lit(tiles).cast("long"), F.col("place") - 1
    div = lambda a, b: F.call_function("div", a, F.greatest(b, F.lit(1).cast("long")))
    base, rest = div(F.col("size"), n), F.col("size") % n
    wide = rest * (base + 1)
    return F.when(place < wide, div(place, base + 1)).otherwise(rest + div(place - wide, base)) + 1


@query("win05", sql("weather", """
SELECT stn, mo, da, ntile(2) OVER w AS halves, ntile(1000) OVER w AS thousandths FROM weather WINDOW w AS (PARTITION BY mo ORDER BY temp, stn, date)"""))
def tiles(t):
    rows = segments.Ordered(S.readings(t), ["mo"], ["temp", "stn", "date"]).row_numbers("place", total="size").df
    return rows.select("stn", "mo", "da", tile(2).alias("halves"), tile(1000).alias("thousandths"))


@query("win06", sql("weather", """
SELECT stn, mo, da, row_number() OVER (PARTITION BY mo ORDER BY temp, stn, date) AS up,
  row_number() OVER (PARTITION BY mo ORDER BY temp DESC, stn DESC, date DESC) AS down FROM weather"""))
def places(t):
    rows = segments.Ordered(S.readings(t), ["mo"], ["temp", "stn", "date"]).row_numbers("up", total="size").df
    # The order has no ties, so counting from the other end is a subtraction.
    return rows.select("stn", "mo", "da", "up", (F.col("size") - F.col("up") + 1).alias("down"))


@query("win06_desc", """
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS newest_first FROM events""")
def newest_first(t):
    rows = t.events.select("event_id", "event_type", "ts")
    out = segments.Ordered(rows, ["event_type"], ["ts", "event_id"]).row_numbers("newest_first", descending=True)
    return out.df.select("event_id", "newest_first")


@query("win07", sql("weather", """
SELECT stn, mo, da, lag(temp, 1) OVER s AS day_before, lag(temp, 2) OVER s AS two_days_before,
  lag(temp, 1) OVER m AS colder, lag(temp, 2) OVER m AS colder_still
FROM weather WINDOW s AS (PARTITION BY stn ORDER BY date), m AS (PARTITION BY mo ORDER BY temp, stn, date)"""))
def neighbours(t):
    s = Window.partitionBy("stn").orderBy("date")
    rows = S.readings(t).withColumns({"day_before": F.lag("temp", 1).over(s), "two_days_before": F.lag("temp", 2).over(s)})
    rows = segments.Ordered(rows, ["mo"], ["temp", "stn", "date"]).previous({"colder": "temp"})
    rows = rows.settled().previous({"colder_still": "colder"})
    return rows.df.select("stn", "mo", "da", "day_before", "two_days_before", "colder", "colder_still")


@query("win08", sql("weather", """
SELECT stn, mo, da, sum(temp) OVER (PARTITION BY year)::DOUBLE / count(*) OVER (PARTITION BY year) AS whole,
  sum(temp) OVER (PARTITION BY year ORDER BY date)::DOUBLE / count(*) OVER (PARTITION BY year ORDER BY date) AS running FROM weather"""))
def averages(t):
    """Average of the whole group, and of the group up to the row's day with all rows of that day."""
    w = S.readings(t).withColumn("one", F.lit(1).cast("long"))
    whole = w.groupBy("year").agg((F.sum("temp") / F.count(F.lit(1))).alias("whole"))
    rows = segments.sums_upto_value(w, ["year"], "date", {"s": "temp", "n": "one"})
    return segments.attach(rows, whole, ["year"]).select(
        "stn", "mo", "da", "whole", (F.col("s") / F.col("n")).alias("running")
    )


@query("win09", sql("weather", """
SELECT stn, mo, da, sum(temp) OVER (PARTITION BY stn ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)::BIGINT AS all_rows,
  sum(temp) OVER (PARTITION BY stn ORDER BY da RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM weather"""))
def explicit_frames(t):
    rows = Window.partitionBy("stn").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.partitionBy("stn").orderBy("da").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return S.weather(t).select("stn", "mo", "da", F.sum("temp").over(rows).alias("all_rows"), F.sum("temp").over(upto).alias("upto"))


MONTH_SECONDS = 30 * DAY


@query("win10", sql("weather", f"""
SELECT stn, mo, da, sum(temp) OVER w::DOUBLE / count(*) OVER w AS around FROM (SELECT *, epoch(date)::BIGINT AS x FROM weather)
WINDOW w AS (PARTITION BY year ORDER BY x RANGE BETWEEN {MONTH_SECONDS} PRECEDING AND {MONTH_SECONDS} FOLLOWING)"""))
def month_around(t):
    w = S.readings(t).withColumn("x", F.unix_seconds(F.col("date").cast("timestamp")))
    around = segments.sliding(
        w, ["year"], "x", MONTH_SECONDS, MONTH_SECONDS,
        {"s": F.sum("temp"), "n": F.count(F.lit(1))},
        {"around": F.col("s") / F.col("n")}, {"s": F.sum, "n": F.sum},
    )
    return w.join(around, ["year", "x"]).select("stn", "mo", "da", "around")


@query("win10_hours", """
SELECT event_id, sum(c) OVER w::DOUBLE / count(*) OVER w AS around, max(c) OVER w AS top
FROM (SELECT event_id, event_type, epoch_us(ts) // 1000000 AS x, CAST(round(value * 100) AS BIGINT) AS c FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY x RANGE BETWEEN 10800 PRECEDING AND 3600 FOLLOWING)""")
def hours_around(t):
    """Single events by the second: five kinds of event hold the whole table."""
    rows = t.events.select("event_id", "event_type", F.unix_seconds("ts").alias("x"), cents("value").alias("c"))
    around = segments.sliding(
        rows, ["event_type"], "x", 10800, 3600,
        {"s": F.sum("c"), "n": F.count(F.lit(1)), "m": F.max("c")},
        {"around": F.col("s") / F.col("n"), "top": F.col("m")},
        {"s": F.sum, "n": F.sum, "m": F.max},
    )
    return rows.join(around, ["event_type", "x"]).select("event_id", "around", "top")


@query("win11", """
SELECT o_orderkey, sum(c) OVER w::DOUBLE / count(*) OVER w AS around
FROM (SELECT o_orderkey, o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS x, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def months_around(t):
    rows = t.orders.select(
        "o_orderkey", "o_orderpriority", month_ordinal("o_orderdate").alias("x"), cents("o_totalprice").alias("c")
    )
    around = segments.sliding(
        rows, ["o_orderpriority"], "x", 1, 1, {"s": F.sum("c"), "n": F.count(F.lit(1))},
        {"around": F.col("s") / F.col("n")}, {"s": F.sum, "n": F.sum},
    )
    return rows.join(around, ["o_orderpriority", "x"]).select("o_orderkey", "around")


@query("win12", sql("weather", """
SELECT stn, mo, da, temp, temp = max(temp) OVER (PARTITION BY stn ORDER BY x RANGE BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS is_peak
FROM (SELECT *, date_diff('day', DATE '1970-01-01', date) AS x FROM weather)"""))
def weekly_peaks(t):
    w = Window.partitionBy("stn").orderBy(F.unix_date("date")).rangeBetween(-7, 7)
    return S.weather(t).select("stn", "mo", "da", "temp", (F.col("temp") == F.max("temp").over(w)).alias("is_peak"))


@query("win13", sql("weather", """
SELECT stn, mo, da, round(m.median, 6) AS median, round(quantile_cont(temp::DOUBLE, 0.5) OVER (PARTITION BY stn ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running
FROM weather JOIN (SELECT mo, quantile_cont(temp::DOUBLE, 0.5) AS median FROM weather GROUP BY mo) m USING (mo)"""))
def medians(t):
    """Median of the month, and running median of the station."""
    w = S.readings(t)
    month = segments.exact_percentiles(w, ["mo"], "temp", {"median": 0.5})
    rows = M.running_median(w, ["stn"], ["date"], "temp", "running").withColumn("running", F.round("running", 6))
    return rows.join(month, "mo").select("stn", "mo", "da", F.round("median", 6).alias("median"), "running")


@query("win14", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest(t):
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    return tables.newest(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


BUCKET_MAX = """
SELECT bucket, namespace, x, lag(x) OVER (PARTITION BY namespace ORDER BY bucket) AS p FROM (
  SELECT ms // 3600000 * 3600 AS bucket, event_type AS namespace, max(k) AS x, sum(c)::BIGINT AS s FROM ev GROUP BY 1, 2)"""


def hourly(t, agg):
    return buckets.by_bucket(gauges(t), "ts", HOUR, ["namespace"], x=agg)


@query("win15", sql("ev", f"""
SELECT bucket, namespace, CASE WHEN x - p >= 0 THEN least((x - p)::DOUBLE, 100.0::DOUBLE) END AS derivative FROM ({BUCKET_MAX})"""))
def capped_derivative(t):
    return buckets.capped_derivative(hourly(t, F.max("k")), ["namespace"], "x", "derivative").drop("x")


MEASURES = ["in_bytes", "out_bytes", "in_packets", "out_packets", "in_dropped", "out_dropped", "in_errors", "out_errors"]
RATE_SQL = "SELECT host, seq, " + ", ".join(
    f"CASE WHEN gap > 0 AND {m} >= last_value(CASE WHEN gap IS NULL OR gap > 0 THEN {m} END IGNORE NULLS) OVER b THEN "
    f"({m} - last_value(CASE WHEN gap IS NULL OR gap > 0 THEN {m} END IGNORE NULLS) OVER b)::DOUBLE / gap END AS {m}_rate"
    for m in MEASURES
) + """
FROM (SELECT *, at_s - lag(at_s) OVER (PARTITION BY host ORDER BY at_s, seq) AS gap FROM counters)
WINDOW b AS (PARTITION BY host ORDER BY at_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("win16", sql("counters", RATE_SQL))
def counter_rates(t):
    out = rates.counter_rates(S.counters(t), ["host"], "at_s", "seq", MEASURES)
    return out.select("host", "seq", *[f"{m}_rate" for m in MEASURES])


DISK = {
    "read_bytes": "in_bytes", "write_bytes": "out_bytes", "read_time": "in_packets", "write_time": "out_packets",
    "read_count": "in_dropped", "write_count": "out_dropped", "io_ops": "in_errors", "io_time": "out_errors",
}


@query("win16_disk", sql("counters", RATE_SQL.replace("SELECT host, seq, ", "SELECT host, seq, 'sda' AS device, ", 1)
    .replace("in_bytes_rate", "read_bytes_rate").replace("out_bytes_rate", "write_bytes_rate")
    .replace("in_packets_rate", "read_time_rate").replace("out_packets_rate", "write_time_rate")
    .replace("in_dropped_rate", "read_count_rate").replace("out_dropped_rate", "write_count_rate")
    .replace("in_errors_rate", "io_ops_rate").replace("out_errors_rate", "io_time_rate")))
def disk_rates(t):
    rows = S.counters(t).select("host", "seq", "at_s", F.lit("sda").alias("device"), *[F.col(c).alias(n) for n, c in DISK.items()])
    out = rates.counter_rates(rows, ["host", "device"], "at_s", "seq", list(DISK))
    return out.select("host", "seq", "device", *[f"{m}_rate" for m in DISK])


@query("win17", sql("ev", f"""
SELECT bucket, namespace, d AS inbound, -d AS outbound FROM (
  SELECT bucket, namespace, CASE WHEN x - p >= 0 THEN (x - p)::DOUBLE ELSE x::DOUBLE / 60 END AS d FROM ({BUCKET_MAX}))"""))
def derivative_pair(t):
    out = buckets.derivative_or_share(hourly(t, F.max("k")), ["namespace"], "x", "inbound")
    return out.select("bucket", "namespace", "inbound", (-F.col("inbound")).alias("outbound"))


@query("win18", sql("ev", f"""
SELECT bucket, namespace, coalesce(x - p, 0)::BIGINT AS change FROM ({BUCKET_MAX.replace('max(k) AS x, sum(c)::BIGINT AS s', 'sum(c)::BIGINT AS x')})"""))
def sum_difference(t):
    return buckets.difference_or_zero(hourly(t, F.sum("c")), ["namespace"], "x", "change").drop("x")


@query("win19", sql("counters", """
SELECT host, seq, CASE WHEN p IS NULL THEN NULL WHEN out_packets >= p THEN out_packets - p ELSE out_packets END AS delta FROM (
  SELECT host, seq, out_packets, lag(out_packets) OVER (PARTITION BY host ORDER BY at_s, seq) AS p FROM counters)"""))
def deltas(t):
    return rates.deltas(S.counters(t), ["host"], ["at_s", "seq"], "out_packets", "delta").select("host", "seq", "delta")


@query("win20", sql("ev", """
SELECT bucket, host, violating::BIGINT AS violating, violating >= 1 AS raised, (recent = 0 AND n = 3) AS cleared FROM (
  SELECT bucket, host, sum(v) OVER w AS violating, sum(v) OVER w AS recent, count(*) OVER w AS n FROM (
    SELECT ms // 86400000 * 86400 AS bucket, user_id AS host, CASE WHEN max(c) > 10000 THEN 1 ELSE 0 END AS v FROM ev GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY host ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""))
def threshold_state(t):
    per_day = buckets.by_bucket(gauges(t), "ts", DAY, ["host"], top=F.max("c"))
    return buckets.violations(per_day, ["host"], F.col("top") > 10000, 1, 3, 3).drop("top")


@query("win21", sql("counters", """
SELECT at_s // 3600 * 3600 AS bucket, coalesce(sum(delta)::DOUBLE / 3600, 0.0::DOUBLE) AS per_second FROM (
  SELECT host, at_s, CASE WHEN p IS NULL THEN NULL WHEN out_packets >= p THEN out_packets - p ELSE out_packets END AS delta FROM (
    SELECT host, at_s, out_packets, lag(out_packets) OVER (PARTITION BY host ORDER BY at_s, seq) AS p FROM counters)) GROUP BY 1"""))
def change_per_second(t):
    rows = rates.deltas(S.counters(t), ["host"], ["at_s", "seq"], "out_packets", "delta")
    bucket = buckets.bucket_of_seconds("at_s", HOUR).alias("bucket")
    return rows.groupBy(bucket).agg(F.coalesce(F.sum("delta").cast("double") / HOUR, F.lit(0.0)).alias("per_second"))
