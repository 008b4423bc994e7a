"""Sorts, limits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswell.operators import tables
from opswell.plans.aggregates import dated, sized
from opswell.plans.ctes import sql
from opswell.registry import query
from opswell.sources import standins as S


@query("srt01", sql("words", "SELECT word, count(*) AS count FROM words GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_words(t):
    return S.words(t).groupBy("word").count().orderBy(F.desc("count"), "word").limit(10)


def closest(rows, column: str, wanted: float, tolerance: float, ranked, k: int):
    """The k best by `ranked` of the rows whose column is within `tolerance` of the wanted value."""
    return rows.where(F.abs(F.col(column) - wanted) <= tolerance).orderBy(*ranked).limit(k)


@query("srt02", sql("drives", """
SELECT model, gib, failure_rate FROM (
  SELECT model, CAST(capacity_bytes // 1073741824 AS BIGINT) AS gib, sum(failure)::DOUBLE / count(*)::DOUBLE AS failure_rate
  FROM drives WHERE capacity_bytes > 0 GROUP BY 1, 2)
WHERE abs(gib - 18) <= 6 ORDER BY failure_rate, abs(gib - 18), model LIMIT 5"""))
def reliable_drives(t):
    """Five models of 18 GiB or 6 more or less that fail the least, those nearer to 18 first among equals."""
    rates = tables.failure_rates(sized(t), ["model", "gib"], "failure")
    return closest(rates, "gib", 18, 6, ["failure_rate", F.abs(F.col("gib") - 18), "model"], 5).select("model", "gib", "failure_rate")


@query("srt03", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_rows(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("srt04", """
SELECT *, sample_no <= 50 AS shown FROM (
  SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS sample_no, count(*) OVER (PARTITION BY c_nationkey) AS of_total
  FROM customer)""")
def sample_and_total(t):
    rows = t.customer.select("c_nationkey", "c_custkey")
    return tables.top_sample(rows, ["c_nationkey"], ["c_custkey"], 50)


@query("srt05", sql("alerts", """
SELECT alert_id, severity, (row_number() OVER (ORDER BY created_on, alert_id) - 1) // 75 AS batch FROM alerts WHERE source = 'feed' AND incident IS NULL"""))
def oldest_first(t):
    """All pending alerts in batches of 75, the oldest in batch 0."""
    pending = S.alerts(t).where("source = 'feed' AND incident IS NULL").select("alert_id", "severity", "created_on")
    return tables.batches(pending, ["created_on", "alert_id"], 75).select("alert_id", "severity", "batch")


@query("srt05_matches", sql("jobs", """
SELECT job, start_ms, end_ms, (row_number() OVER (ORDER BY end_ms, job) - 1) // 500 AS batch FROM jobs WHERE end_ms IS NOT NULL"""))
def oldest_matches(t):
    ended = S.jobs(t).where("end_ms IS NOT NULL").select("job", "start_ms", "end_ms")
    return tables.batches(ended, ["end_ms", "job"], 500).select("job", "start_ms", "end_ms", "batch")


def quarters(t):
    """Drive rows by quarter; the last quarter has two columns more than the others."""
    rows = dated(t).withColumn("quarter", F.quarter("day"))
    base = ["date", "serial_number", "model", "capacity_bytes", "failure", "smart_1_raw"]
    old = [rows.where(F.col("quarter") == q).select(*base) for q in (1, 2, 3)]
    new = rows.where(F.col("quarter") == 4).select(*base, "smart_9_raw", F.lit("4").alias("smart_254_raw"))
    return old, new


@query("set01", sql("drives", """
SELECT model, smart_254_raw, count(*) AS n, sum(failure)::BIGINT AS failures, count(smart_9) AS smart_9 FROM (
  SELECT model, failure, CASE WHEN quarter(day) = 4 THEN '4' END AS smart_254_raw, CASE WHEN quarter(day) = 4 THEN smart_9_raw END AS smart_9 FROM drives)
GROUP BY 1, 2"""))
def union_by_position(t):
    """Older quarters get the missing columns as nulls, then all are put behind each other by position."""
    old, new = quarters(t)
    extra, _ = tables.schema_difference(new, old[0])
    out = new
    for q in old:
        out = out.union(tables.with_missing(q, {c: "string" for c in extra}).select(*new.columns))
    return out.groupBy("model", "smart_254_raw").agg(
        F.count(F.lit(1)).alias("n"), F.sum("failure").alias("failures"), F.count("smart_9_raw").alias("smart_9")
    )


@query("set02", sql("drives", """
SELECT serial_number, count(*) AS n, count(*) FILTER (quarter(day) = 4) AS with_new_column FROM drives GROUP BY 1"""))
def union_by_name(t):
    old, new = quarters(t)
    return tables.aligned([*old, new]).groupBy("serial_number").agg(
        F.count(F.lit(1)).alias("n"), F.count("smart_254_raw").alias("with_new_column")
    )


@query("set03", """
SELECT n_regionkey, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
JOIN nation ON k = n_nationkey GROUP BY 1""")
def sql_union(t):
    for name in ("customer", "supplier", "nation"):
        getattr(t, name).createOrReplaceTempView(f"opswell_{name}")
    return t.spark.sql(
        "SELECT n_regionkey, count(*) AS n FROM (SELECT c_nationkey AS k FROM opswell_customer UNION ALL"
        " SELECT s_nationkey FROM opswell_supplier) JOIN opswell_nation ON k = n_nationkey GROUP BY n_regionkey"
    )


@query("set04", sql("drives", "SELECT model, count(*) AS n, count(smart_1_raw) AS smart FROM drives GROUP BY 1"))
def union_of_common(t):
    old, new = quarters(t)
    out = tables.common_columns([new, *old], required=["model", "capacity_bytes", "date", "failure"])
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("smart_1_raw").alias("smart"))


@query("set05", """
SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def difference(t):
    return t.customer.select(F.col("c_custkey").alias("key")).subtract(
        t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key"))
    )


@query("set05_all", """
SELECT l_linenumber, l_returnflag FROM lineitem EXCEPT ALL SELECT l_linenumber, l_returnflag FROM lineitem WHERE l_linestatus = 'O'""")
def difference_keeping_copies(t):
    both = ["l_linenumber", "l_returnflag"]
    return t.lineitem.select(*both).exceptAll(t.lineitem.where("l_linestatus = 'O'").select(*both))


@query("set06", sql("drives", """
SELECT name, CASE WHEN name LIKE 'smart_1%' THEN n1 ELSE n9 END AS filled FROM (SELECT unnest(['smart_254_raw', 'smart_9_raw']) AS name),
  (SELECT count(smart_1_raw) AS n1, count(smart_9_raw) AS n9 FROM drives WHERE quarter(day) = 4)"""))
def schema_difference(t):
    """Columns that only the newest table has, with the number of rows that fill them."""
    old, new = quarters(t)
    only_new, _ = tables.schema_difference(new, old[0])
    return new.select(*only_new).unpivot([], only_new, "name", "value").groupBy("name").agg(F.count("value").alias("filled"))
