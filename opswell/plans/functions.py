"""The Python function surface, over groups whose size the calendar bounds."""

from __future__ import annotations

from pyspark.sql import Window, functions as F, types as T

from opswell.functions import udfs as U
from opswell.functions.numbers import cents
from opswell.plans.ctes import sql
from opswell.registry import query
from opswell.session import spread
from opswell.sources import standins as S


def pairs(t):
    rows = spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"))
    return rows.withColumn("parts", F.array("l_partkey", cents("l_discount")))


PAIRS = "(SELECT *, l_partkey AS n, CAST(round(l_discount * 100) AS BIGINT) AS q FROM lineitem)"


@query("fun01", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q <> 0 THEN n // q END AS quotient, CASE WHEN q <> 0 THEN n % q END AS remainder FROM {PAIRS}""")
def array_function(t):
    rows = pairs(t).withColumn("f", U.divided_udf("parts"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("f")[0].alias("quotient"), F.col("f")[1].alias("remainder"))


@query("fun02", f"""
SELECT l_orderkey, l_linenumber, l_partkey, abs(n - q)::DOUBLE AS reach, CAST(NULL AS BIGINT) AS wrong FROM {PAIRS}""")
def scalar_function(t):
    """A function declared with its type, and one whose declared type is not what it returns: that gives null."""
    wrong = F.udf(lambda parts: parts[0] + 0.5, T.LongType())
    return pairs(t).select("l_orderkey", "l_linenumber", "l_partkey", U.reach("parts").alias("reach"), wrong("parts").alias("wrong"))


@query("fun03", "SELECT event_id, sign(value) * sqrt(abs(value)) AS damped FROM events")
def series(t):
    return t.events.select("event_id", U.damped("value").alias("damped"))


@query("fun04", """
SELECT event_id, CASE WHEN value >= 100 THEN 4 WHEN value >= 50 THEN 3 WHEN value >= 25 THEN 2 WHEN value >= 10 THEN 1 WHEN value IS NOT NULL THEN 0 END::BIGINT AS grade FROM events""")
def series_batches(t):
    return t.events.select("event_id", U.graded("value").alias("grade"))


@query("fun05", """
SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS of_day FROM events""")
def several_series(t):
    return t.events.select("event_id", U.second_of_day(F.hour("ts"), F.minute("ts"), F.second("ts")).alias("of_day"))


@query("fun06", sql("weather", """
SELECT stn, mo, round(regr_slope(temp, da), 6) AS slope, round(regr_slope(temp, da), 6) AS built_in FROM weather GROUP BY 1, 2"""))
def grouped_aggregate(t):
    """Slope per station and month: at most 31 readings meet in Python. The built-in beside it needs no Python."""
    w = S.weather(t)
    mine = w.groupBy("stn", "mo").agg(U.slope(F.col("da"), F.col("temp")).alias("slope"))
    theirs = w.groupBy("stn", "mo").agg(F.regr_slope("temp", "da").alias("built_in"))
    return mine.join(theirs, ["stn", "mo"]).withColumns({c: F.round(c, 6) for c in ("slope", "built_in")})


def scaled_sql(group):
    return sql("weather", f"""
SELECT stn, mo, da, round(CASE WHEN wide = 0 THEN 0.0::DOUBLE ELSE (temp - middle) / wide END, 6) AS scaled FROM (
  SELECT *, avg(temp::DOUBLE) OVER (PARTITION BY {group}) AS middle, stddev_pop(temp::DOUBLE) OVER (PARTITION BY {group}) AS wide FROM weather)""")


SCALED = "stn long, mo int, da int, temp long, scaled double"


@query("fun07", scaled_sql("stn, mo"))
def group_map(t):
    """Standard scores within station and month: a group has at most 31 rows."""
    rows = S.weather(t).select("stn", "mo", "da", "temp").groupBy("stn", "mo")
    return rows.applyInPandas(U.standard_scores("temp", "scaled"), SCALED).select("stn", "mo", "da", F.round("scaled", 6).alias("scaled"))


@query("fun08", scaled_sql("stn"))
def coarser_group_map(t):
    """Standard scores within the station: other answers, and as many rows per group as there are days."""
    rows = S.weather(t).select("stn", "mo", "da", "temp").groupBy("stn")
    return rows.applyInPandas(U.standard_scores("temp", "scaled"), SCALED).select("stn", "mo", "da", F.round("scaled", 6).alias("scaled"))


@query("fun09", sql("weather", """
SELECT w.stn, w.mo, w.da, round(m, 6) AS median FROM weather w JOIN (SELECT stn, mo, quantile_cont(temp::DOUBLE, 0.5) AS m FROM weather GROUP BY 1, 2) x ON w.stn = x.stn AND w.mo = x.mo"""))
def function_over_window(t):
    w = Window.partitionBy("stn", "mo")
    return S.weather(t).select("stn", "mo", "da", F.round(U.median("temp").over(w), 6).alias("median"))


@query("fun10", sql("ev", """
SELECT event_id, CASE event_type WHEN 'click' THEN k + 1 END AS plus_one, event_type = 'click' AND k <> 0 AS truthy FROM ev"""))
def mixed_values(t):
    """Values of several types in one column of the open type: mapped where the type allows, else null."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    text = F.when(kind == "click", k).when(kind == "view", F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.lit("null"))
    rows = t.events.select("event_id", F.parse_json(text).alias("v"))
    is_number = F.schema_of_variant("v").isin("BIGINT", "INT", "DOUBLE")
    number = F.when(is_number, F.try_variant_get("v", "$", "bigint"))
    return rows.select("event_id", (number + 1).alias("plus_one"), F.coalesce(number != 0, F.lit(False)).alias("truthy"))


@query("fun10_batches", """
SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1""")
def python_filter(t):
    def keep(batches):
        for batch in batches:
            yield batch[batch["value"] > 50]

    return t.events.select("event_type", "value").mapInPandas(keep, "event_type string, value double").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("fun11", sql("weather", "SELECT stn, mo, da, temp FROM weather WHERE stn = (SELECT min(stn) FROM weather) ORDER BY date LIMIT 20"))
def local_sample(t):
    """A few rows of one group, as they are taken to try a function out by hand."""
    w = S.weather(t)
    one = w.agg(F.min("stn").alias("stn"))
    return w.where(F.col("stn") == one.select("stn").scalar()).orderBy("date").limit(20).select("stn", "mo", "da", "temp")
