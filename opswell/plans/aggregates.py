"""Aggregations: words, programme logs, drives, nested rows, weather, logs, open work, buckets, panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswell import session
from opswell.functions.numbers import cents, percent, ratio
from opswell.functions.text import clock_seconds, clock_seconds_anywhere
from opswell.functions.times import first_date
from opswell.operators import buckets, lifecycle, logs, rates, segments, sketches, tables
from opswell.plans.ctes import sql
from opswell.registry import query
from opswell.sources import standins as S

# Words

@query("agg01", sql("words", "SELECT word, count(*) AS count FROM words GROUP BY word"))
def word_count(t):
    return S.words(t).groupBy("word").count()


@query("agg02", sql("words", """
SELECT length(word) AS length, count(*) AS words, count(DISTINCT word) AS distinct_words FROM words GROUP BY 1"""))
def words_by_length(t):
    per_word = S.words(t).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return per_word.groupBy(F.length("word").alias("length")).agg(
        F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words")
    )


@query("agg03", sql("words", "SELECT count(*) AS total FROM words"))
def grand_total(t):
    return S.words(t).groupBy("word").count().agg(F.sum("count").alias("total"))


@query("agg04", sql("words", "SELECT word FROM words GROUP BY word HAVING count(*) = 1"))
def seen_once(t):
    return S.words(t).groupBy("word").count().where("count = 1").select("word")


@query("agg05", sql("words", "SELECT substr(word, 1, 1) AS letter, count(*) AS count FROM words GROUP BY 1"))
def first_letters(t):
    return S.words(t).groupBy(F.substring("word", 1, 1).alias("letter")).count()


@query("agg06", sql("words", "SELECT count(DISTINCT word) AS distinct_words FROM words"))
def distinct_words(t):
    return S.words(t).groupBy("word").count().agg(F.count(F.lit(1)).alias("distinct_words"))


LANGS = ["de", "en", "es", "fr"]


@query("agg07", sql("words", """
SELECT word, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en,
  count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM words GROUP BY word"""))
def pivoted_words(t):
    counted = S.words(t).groupBy("word", "lang").count()
    return counted.groupBy("word").pivot("lang", LANGS).sum("count").fillna(0, LANGS)


# Programme logs

@query("agg08", sql("logs", """
SELECT program, category, CAST(sum(seconds) AS BIGINT) AS seconds FROM logs GROUP BY 1, 2 ORDER BY 3 DESC"""))
def duration_by_codes(t):
    return (
        S.programme_logs(t)
        .groupBy("program", "category")
        .agg(F.sum(clock_seconds("duration")).alias("seconds"))
        .orderBy(F.desc("seconds"))
    )


@query("agg09", """
SELECT n_name, sum(CASE WHEN l_returnflag IN ('R', 'A') THEN c ELSE 0 END)::BIGINT AS part, sum(c)::BIGINT AS whole,
  sum(CASE WHEN l_returnflag IN ('R', 'A') THEN c ELSE 0 END)::DOUBLE / nullif(sum(c), 0)::DOUBLE AS share
FROM (SELECT l_orderkey, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY share DESC""")
def share_by_nation(t):
    """Conditional sum, total and ratio per nation."""
    c = cents("l_extendedprice")
    # Lines are added up per order before they meet the orders: the wide table is moved once, already small.
    per_order = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag").isin("R", "A"), c).otherwise(0)).alias("part"), F.sum(c).alias("whole")
    )
    return (
        per_order.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))
        .withColumn("share", ratio("part", "whole"))
        .orderBy(F.desc("share"))
    )


@query("agg10", sql("logs", """
SELECT service, sum(seconds * CASE trim(program) WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.75 ELSE 0 END)::DOUBLE AS part,
  sum(seconds)::BIGINT AS whole,
  sum(seconds * CASE trim(program) WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.75 ELSE 0 END)::DOUBLE / sum(seconds)::DOUBLE AS share
FROM logs GROUP BY service"""))
def weighted_shares(t):
    rows = S.programme_logs(t).withColumn("seconds", clock_seconds_anywhere("duration").cast("long"))
    return tables.weighted_share(rows, ["service"], "seconds", "program", {"R": 1.0, "A": 0.75})


@query("agg11", sql("logs", """
SELECT round(share, 1) AS share, count(*) AS n FROM (
  SELECT order_key, sum(CASE WHEN trim(program) = 'R' THEN seconds ELSE 0 END)::DOUBLE / sum(seconds)::DOUBLE AS share
  FROM logs GROUP BY order_key) GROUP BY 1"""))
def share_histogram(t):
    rows = S.programme_logs(t).withColumn("seconds", clock_seconds("duration").cast("long"))
    shares = tables.weighted_share(rows, ["order_key"], "seconds", "program", {"R": 1.0})
    return shares.groupBy(F.round("share", 1).alias("share")).agg(F.count(F.lit(1)).alias("n"))


# Drives

@query("agg12", """
SELECT p_type, count(*) AS n FROM part WHERE p_size > 10 AND p_type <> 'SMALL' GROUP BY p_type""")
def filtered_counts(t):
    t.part.createOrReplaceTempView("opswell_part")
    return t.spark.sql(
        "SELECT p_type, count(*) AS n FROM opswell_part WHERE p_size > 10 AND p_type <> 'SMALL' GROUP BY 1"
    )


@query("agg13", sql("drives", """
SELECT model, min(capacity_bytes / pow(1024, 3)) AS min_gib, max(capacity_bytes / pow(1024, 3)) AS max_gib FROM drives GROUP BY model"""))
def capacity_range(t):
    gib = F.col("capacity_bytes") / F.pow(F.lit(1024.0), F.lit(3.0))
    return S.drives(t).groupBy("model").agg(F.min(gib).alias("min_gib"), F.max(gib).alias("max_gib"))


@query("agg14", sql("drives", """
SELECT serial_number, min(capacity_bytes) AS lo, max(capacity_bytes) AS hi FROM drives GROUP BY 1 HAVING min(capacity_bytes) <> max(capacity_bytes)"""))
def inconsistent_capacity(t):
    return (
        S.drives(t)
        .groupBy("serial_number")
        .agg(F.min("capacity_bytes").alias("lo"), F.max("capacity_bytes").alias("hi"))
        .where("lo <> hi")
    )


FAILURES = sql("drives", """
SELECT model, CAST(capacity_bytes // 1073741824 AS BIGINT) AS gib, count(*) AS drive_days, sum(failure)::BIGINT AS failures,
  sum(failure)::DOUBLE / count(*)::DOUBLE AS failure_rate FROM drives WHERE capacity_bytes > 0 GROUP BY 1, 2""")


def sized(t):
    rows = S.drives(t).where("capacity_bytes > 0")
    return rows.withColumn("gib", F.call_function("div", F.col("capacity_bytes"), F.lit(1 << 30)))


@query("agg15", FAILURES)
def failure_rate_by_join(t):
    return tables.failure_rates_by_join(sized(t), ["model", "gib"], "failure")


@query("agg16", FAILURES)
def failure_rate(t):
    return tables.failure_rates(sized(t), ["model", "gib"], "failure")


def dated(t):
    return S.drives(t).withColumn("day", first_date("date", ["yyyy-MM-dd", "M/d/yy"]))


@query("agg17", sql("drives", """
SELECT serial_number, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS days,
  sum(failure)::BIGINT AS failures, date_diff('day', min(day), max(day)) AS span_days FROM drives GROUP BY 1"""))
def drive_lifetimes(t):
    out = tables.lifetimes(dated(t), "serial_number", "day", "failure")
    return out.withColumn("first_day", F.col("first_day").cast("string")).withColumn("last_day", F.col("last_day").cast("string"))


@query("agg18", sql("drives", """
SELECT model, sum(days)::BIGINT AS days, count(*) AS drives, round(sum(days)::DOUBLE / count(*), 6) AS mean_days,
  format('{:,}', sum(days)::BIGINT) AS days_text FROM (
  SELECT model, serial_number, count(*) AS days FROM drives GROUP BY 1, 2 HAVING sum(failure) > 0) GROUP BY model"""))
def mean_life_of_failed(t):
    per_drive = S.drives(t).groupBy("model", "serial_number").agg(
        F.count(F.lit(1)).alias("days"), F.sum("failure").alias("failures")
    )
    return (
        per_drive.where("failures > 0")
        .groupBy("model")
        .agg(F.sum("days").alias("days"), F.count(F.lit(1)).alias("drives"))
        .withColumn("mean_days", F.round(F.col("days") / F.col("drives"), 6))
        .withColumn("days_text", F.format_number("days", 0))
    )


@query("agg19", sql("drives", """
SELECT year, month, sum(top)::BIGINT AS bytes FROM (
  SELECT year(day) AS year, month(day) AS month, serial_number, max(capacity_bytes) AS top FROM drives GROUP BY ALL) GROUP BY 1, 2"""))
def monthly_capacity(t):
    per_drive = dated(t).groupBy(F.year("day").alias("year"), F.month("day").alias("month"), "serial_number").agg(
        F.max("capacity_bytes").alias("top")
    )
    return per_drive.groupBy("year", "month").agg(F.sum("top").alias("bytes"))


@query("agg20", sql("drives", """
SELECT model, gib AS common_gib, n FROM (
  SELECT model, floor(capacity_bytes / 1073741824.0)::BIGINT AS gib, count(*) AS n,
    row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, floor(capacity_bytes / 1073741824.0)::BIGINT) AS r
  FROM drives WHERE capacity_bytes >= 0 GROUP BY 1, 2) WHERE r = 1"""))
def common_capacity(t):
    rows = S.drives(t).where(~(F.col("capacity_bytes") < 0))
    rows = rows.withColumn("gib", F.floor(F.col("capacity_bytes") / F.pow(F.lit(1024.0), F.lit(3.0))))
    return tables.most_common(rows, ["model"], "gib", "common_gib")


@query("agg20_sizes", sql("drives", """
SELECT model, capacity_bytes, count(*) AS n FROM drives GROUP BY 1, 2"""))
def capacity_distribution(t):
    return S.drives(t).groupBy("model", "capacity_bytes").agg(F.count(F.lit(1)).alias("n"))


@query("agg21", sql("drives", """
SELECT date AS raw, CASE WHEN date LIKE '____-__-__' THEN date END AS iso, strftime(day, '%Y-%m-%d') AS parsed, count(*) AS n FROM drives GROUP BY ALL"""))
def date_format_audit(t):
    iso = first_date("date", ["yyyy-MM-dd"])
    return (
        dated(t)
        .groupBy(F.col("date").alias("raw"), iso.cast("string").alias("iso"), F.col("day").cast("string").alias("parsed"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Nested rows

@query("agg22", """
SELECT conv_id AS id, turn // 1000 AS chunk, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles,
  string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1, 2""")
def folded_turns(t):
    """Rows folded into an array of structs, and that array seen as parallel arrays."""
    turns = F.col("_embedded.episodes")
    return S.shows(t).select(
        "id",
        "chunk",
        F.size(turns).cast("long").alias("n"),
        F.array_join(turns["role"], ",").alias("roles"),
        F.array_join(turns["turn"].cast("array<string>"), ",").alias("turns"),
        F.aggregate(turns, F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"])).alias("chars"),
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


@query("agg23", " UNION ALL ".join(f"""
SELECT '{c}' AS name, count({c}) AS count, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
  round(quantile_cont({c}::DOUBLE, 0.1), 6) AS p10, round(quantile_cont({c}::DOUBLE, 0.9), 6) AS p90 FROM lineitem""" for c in MEASURES))
def column_summary(t):
    """Count, ends and exact 10% and 90% points of every measure in one table."""
    long = t.lineitem.select([F.col(c).cast("double").alias(c) for c in MEASURES]).unpivot([], MEASURES, "name", "value")
    ends = long.groupBy("name").agg(F.count("value").alias("count"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    points = segments.exact_percentiles(long, ["name"], "value", {"p10": 0.1, "p90": 0.9})
    return ends.join(points, "name").withColumns({p: F.round(p, 6) for p in ("p10", "p90")})


@query("agg23_summary", " UNION ALL ".join(f"""
SELECT '{c}' AS name, count({c}) AS count, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, true AS p10_within, true AS p90_within FROM lineitem""" for c in MEASURES))
def described(t):
    """Count, ends and approximate points of every measure, from sketches per day merged into one; each point checked against the rows."""
    days = t.lineitem.select(F.to_date("l_shipdate").alias("day"), *[F.col(c).cast("double").alias(c) for c in MEASURES]).unpivot(["day"], MEASURES, "name", "value")
    at = {"p10": 0.1, "p90": 0.9}
    daily = session.settle(sketches.quantile_sketches(days, ["name", "day"], "value"))
    points = session.settle(sketches.quantiles(sketches.merged_quantiles(daily, ["name"]), at))
    return sketches.ranks_within(days, ["name"], "value", points, at).select("name", F.col("n").alias("count"), "lo", "hi", "p10_within", "p90_within")


# Weather

@query("agg24", sql("weather", """
SELECT mo, da, round(quantile_cont(temp::DOUBLE, 0.5), 6) AS median, round(quantile_cont(temp::DOUBLE, 0.9), 6) AS p90 FROM weather GROUP BY 1, 2"""))
def daily_percentiles(t):
    out = segments.exact_percentiles(S.readings(t), ["mo", "da"], "temp", {"median": 0.5, "p90": 0.9})
    return out.withColumns({c: F.round(c, 6) for c in ("median", "p90")})


@query("agg24_approx", sql("weather", "SELECT mo, count(temp) AS n, true AS median_within, true AS p90_within FROM weather GROUP BY 1"))
def monthly_percentiles_approx(t):
    """Sketches of each day, merged into months; each point checked against the month's readings."""
    w, at = S.readings(t), {"median": 0.5, "p90": 0.9}
    daily = session.settle(sketches.quantile_sketches(w, ["mo", "da"], "temp"))
    points = session.settle(sketches.quantiles(sketches.merged_quantiles(daily, ["mo"]), at))
    return sketches.ranks_within(w, ["mo"], "temp", points, at).select("mo", "n", "median_within", "p90_within")


@query("agg25", sql("weather", """
SELECT w.stn, w.mo, w.da, w.temp FROM weather w JOIN (SELECT mo, min(temp) AS lo, max(temp) AS hi FROM weather GROUP BY mo) m
  ON w.mo = m.mo AND (w.temp = lo OR w.temp = hi)"""))
def extreme_days(t):
    w = S.readings(t)
    ends = w.groupBy("mo").agg(F.array(F.min("temp"), F.max("temp")).alias("ends"))
    ends = ends.select("mo", F.explode(F.array_distinct("ends")).alias("temp"))
    return w.join(ends, ["mo", "temp"], "left_semi").select("stn", "mo", "da", "temp")


@query("agg26", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2""")
def multiplicity(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))


@query("agg27", "SELECT user_id AS stn, count(*) AS readings FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def busiest_stations(t):
    return (
        t.events.groupBy(F.col("user_id").alias("stn"))
        .agg(F.count(F.lit(1)).alias("readings"))
        .orderBy(F.desc("readings"), "stn")
        .limit(20)
    )


@query("agg27_mean", sql("weather", """
SELECT stn, year, mo, sum(temp)::DOUBLE / count(*) AS mean_temp FROM weather GROUP BY 1, 2, 3"""))
def monthly_means(t):
    return S.weather(t).groupBy("stn", "year", "mo").agg((F.sum("temp") / F.count(F.lit(1))).alias("mean_temp"))


@query("agg28", sql("weather", """
SELECT stn, round(regr_slope(temp, da), 6) AS slope, round(regr_intercept(temp, da), 6) AS intercept FROM weather GROUP BY stn"""))
def trend_lines(t):
    """Least-squares slope, and slope and intercept as one array."""
    line = F.array(F.regr_slope("temp", "da"), F.regr_intercept("temp", "da"))
    out = S.weather(t).groupBy("stn").agg(line.alias("line"))
    return out.select("stn", F.round(F.col("line")[0], 6).alias("slope"), F.round(F.col("line")[1], 6).alias("intercept"))


@query("agg29", "SELECT sum(l_linenumber)::BIGINT AS total, count(*) AS n FROM lineitem")
def reductions(t):
    return t.lineitem.agg(F.sum(F.col("l_linenumber").cast("long")).alias("total"), F.sum(F.lit(1).cast("long")).alias("n"))


# Logs and open work

@query("agg30", sql("log_lines", """
SELECT ms // 60000 * 60 AS bucket, level, pod AS pod_name, 'host-' || user_id AS hostname, count(*) AS log_count,
  max(epoch_us(ts)) AS bucket_end_micros
FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM log_lines) WHERE level IS NOT NULL AND pod IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def log_counts(t):
    rows = logs.located(logs.application_records(S.log_lines(t)))
    # Grouping by a field leaves out the records that lack it.
    rows = rows.where("parsed_level IS NOT NULL AND pod_name IS NOT NULL").drop("level")
    rows = rows.withColumn("hostname", F.concat(F.lit("host-"), F.regexp_extract("pod_name", "(\\d+)", 1)))
    return buckets.by_bucket(
        rows.withColumnRenamed("parsed_level", "level"), "ts", 60, ["level", "pod_name", "hostname"],
        log_count=F.count(F.lit(1)), bucket_end_micros=F.unix_micros(F.max("ts")),
    )


# An instant to look back from. Fixed, so that results do not depend on the clock.
AS_OF_MS = 896_659_200_000  # 1998-06-01
DAY_MS = 86_400_000


@query("agg31", sql("ops", f"""
SELECT {AS_OF_MS} AS at_ms, kind AS operation_type, app AS application, count(*) AS count FROM ops
WHERE start_ms BETWEEN {AS_OF_MS - DAY_MS} AND {AS_OF_MS} AND (end_ms IS NULL OR end_ms > {AS_OF_MS}) GROUP BY 2, 3"""))
def open_operations(t):
    """Operations open at an instant, started in the day before it, by type and application."""
    found = lifecycle.open_at(S.operations(t), F.lit(AS_OF_MS), DAY_MS)
    return found.groupBy(
        F.lit(AS_OF_MS).alias("at_ms"), F.col("kind").alias("operation_type"), F.col("app").alias("application")
    ).count()


@query("agg32", sql("ops", f"""
SELECT 'Spark' AS realm, kind AS class, count(*) AS count FROM ops
WHERE start_ms <= {AS_OF_MS} AND (end_ms IS NULL OR end_ms > {AS_OF_MS}) GROUP BY 2"""))
def unmatched_starts(t):
    found = lifecycle.open_at(S.operations(t), F.lit(AS_OF_MS))
    return found.groupBy(F.lit(lifecycle.REALM).alias("realm"), F.col("kind").alias("class")).count()


# Time buckets

def gauges(t):
    """Events as gauge samples: host, namespace, value in hundredths, a second measure k."""
    return t.events.select(
        "event_id", "ts", F.col("user_id").alias("host"), F.col("event_type").alias("namespace"),
        cents("value").alias("c"), S.props_k().alias("k"),
    )


HOUR = 3600
DAY = 86_400


@query("agg33", sql("ev", """
SELECT ms // 86400000 * 86400 AS bucket, user_id AS host, sum(c)::DOUBLE / count(*) AS mean, sum(c)::BIGINT AS total, max(c) AS top, count(*) AS n
FROM ev WHERE user_id IN (SELECT user_id FROM ev GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 10) GROUP BY 1, 2"""))
def host_panels(t):
    rows = buckets.within_top(gauges(t), "host", 10)
    return buckets.by_bucket(
        rows, "ts", DAY, ["host"],
        mean=F.sum("c") / F.count(F.lit(1)), total=F.sum("c"), top=F.max("c"), n=F.count(F.lit(1)),
    )


@query("agg34", sql("ev", """
SELECT ms // 86400000 * 86400 AS bucket, user_id AS host, CASE WHEN sum(c) > 0 THEN 100.0::DOUBLE * sum(k)::DOUBLE / sum(c)::DOUBLE END AS used_percent
FROM ev GROUP BY 1, 2"""))
def used_share(t):
    out = buckets.by_bucket(gauges(t), "ts", DAY, ["host"], used=F.sum("k"), whole=F.sum("c"))
    return out.select("bucket", "host", percent("used", "whole").alias("used_percent"))


@query("agg35", sql("ev", """
SELECT ms // 3600000 * 3600 AS bucket, event_type AS namespace, sum(c)::DOUBLE / count(DISTINCT ms // 60000)::DOUBLE AS per_scrape FROM ev GROUP BY 1, 2"""))
def per_scrape(t):
    """Sum per bucket over the number of scrapes in it; a scrape is one distinct minute."""
    rows = gauges(t).withColumn("scrape", buckets.bucket_of("ts", 60))
    per = buckets.by_bucket(rows, "ts", HOUR, ["namespace", "scrape"], c=F.sum("c"))
    return per.groupBy("bucket", "namespace").agg((F.sum("c") / F.count(F.lit(1))).alias("per_scrape"))


@query("agg36", sql("ev", """
SELECT ms // 86400000 * 86400 AS bucket, count(DISTINCT ms // 60000) AS scrapes FROM ev GROUP BY 1"""))
def scrapes(t):
    rows = gauges(t).select(buckets.bucket_of("ts", DAY).alias("bucket"), buckets.bucket_of("ts", 60).alias("minute"))
    return rows.distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("scrapes"))


@query("agg36_approx", sql("ev", "SELECT ms // 86400000 * 86400 AS bucket, count(DISTINCT ms // 60000) AS scrapes, true AS within FROM ev GROUP BY 1"))
def scrapes_approx(t):
    """Distinct minutes of a day from the sketches of its hours, checked against the exact number."""
    hours = sketches.distinct_sketches(gauges(t).withColumn("hour", buckets.bucket_of("ts", HOUR)), ["hour"], buckets.bucket_of("ts", 60))
    days = sketches.merged_distinct(hours, [(F.col("hour") - F.col("hour") % DAY).alias("bucket")], "estimate")
    return scrapes(t).join(days, "bucket").select("bucket", "scrapes", sketches.count_within("estimate", "scrapes").alias("within"))


@query("agg37", sql("ev", """
SELECT ms // 86400000 * 86400 AS bucket, k, count(*) AS n, max(c) AS top FROM ev
WHERE k IN (SELECT k FROM ev GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 20) GROUP BY 1, 2"""))
def largest_groups(t):
    return buckets.by_bucket(buckets.within_top(gauges(t), "k", 20), "ts", DAY, ["k"], n=F.count(F.lit(1)), top=F.max("c"))


def gc(t):
    rows = logs.gc_located(logs.gc_records(S.gc_lines(t)))
    # Microseconds as a whole number, so that sums are exact.
    return rows.where("stats = 'paused'").withColumn("micros", F.round(F.col("millis") * 1000).cast("long"))


@query("agg38", sql("gc", """
SELECT epoch_us(ts) // 86400000000 * 86400 AS bucket, pod_name, sum(micros)::BIGINT AS pause_micros, sum(before - after)::BIGINT AS reclaimed, count(*) AS pauses
FROM gc WHERE form = 'paused' GROUP BY 1, 2"""))
def gc_by_pod(t):
    return buckets.by_bucket(
        gc(t), "ts", DAY, ["pod_name"],
        pause_micros=F.sum("micros"), reclaimed=F.sum("reclaimed"), pauses=F.count(F.lit(1)),
    )


@query("agg38_component", sql("gc", """
SELECT component, sum(before)::DOUBLE / count(*) AS before, sum(after)::DOUBLE / count(*) AS after, sum(heapsize)::DOUBLE / count(*) AS heapsize,
  sum(before - after)::DOUBLE / count(*) AS reclaimed, sum(micros)::DOUBLE / count(*) AS micros FROM gc WHERE form = 'paused' GROUP BY 1"""))
def gc_by_component(t):
    mean = lambda c: (F.sum(c) / F.count(F.lit(1))).alias(c)
    return gc(t).groupBy("component").agg(*[mean(c) for c in ("before", "after", "heapsize", "reclaimed", "micros")])


@query("agg39", sql("ev", """
SELECT ms // 3600000 * 3600 AS bucket, sum(c)::DOUBLE / count(*) AS mean, sum(c)::BIGINT AS total, sum(k)::BIGINT AS second FROM ev GROUP BY 1"""))
def cluster_totals(t):
    return buckets.by_bucket(
        gauges(t), "ts", HOUR, [], mean=F.sum("c") / F.count(F.lit(1)), total=F.sum("c"), second=F.sum("k")
    )


@query("agg40", sql("ev", """
SELECT b AS bucket, namespace, coalesce(n, 0) AS n, coalesce(total, 0)::BIGINT AS total
FROM (SELECT DISTINCT event_type AS namespace FROM ev)
CROSS JOIN (SELECT unnest(generate_series(min(ms) // 3600000 * 3600, max(ms) // 3600000 * 3600, 3600)) AS b FROM ev)
LEFT JOIN (SELECT ms // 3600000 * 3600 AS bucket, event_type, count(*) AS n, sum(c) AS total FROM ev GROUP BY 1, 2) x
  ON x.bucket = b AND x.event_type = namespace"""))
def filled_buckets(t):
    out = buckets.by_bucket(gauges(t), "ts", HOUR, ["namespace"], n=F.count(F.lit(1)), total=F.sum("c"))
    return buckets.fill_gaps(out, ["namespace"], HOUR, {"n": 0, "total": 0})


DELTAS = """
SELECT host, at_s, CASE WHEN p IS NULL THEN NULL WHEN x >= p THEN x - p ELSE x END AS delta FROM (
  SELECT host, at_s, {m} AS x, lag({m}) OVER (PARTITION BY host ORDER BY at_s, seq) AS p FROM counters WHERE {m} IS NOT NULL)"""


@query("agg41", sql("counters", f"""
SELECT bucket, sum(increase)::DOUBLE / 86400 AS rate, count(*) AS series, sum(gauge)::BIGINT AS gauge FROM (
  SELECT at_s // 86400 * 86400 AS bucket, host, sum(delta)::BIGINT AS increase FROM ({DELTAS.format(m='out_packets')}) GROUP BY 1, 2) r
JOIN (SELECT at_s // 86400 * 86400 AS bucket, host, max(in_errors) AS gauge FROM counters GROUP BY 1, 2) g USING (bucket, host)
GROUP BY 1"""))
def summed_rates(t):
    """Rate per series over a range, summed; a gauge summed and the series counted beside it.

    Increases are whole numbers, so they are summed first and divided once.
    """
    rows = S.counters(t)
    rate = rates.range_rates(rows, ["host"], "at_s", ["at_s", "seq"], "out_packets", DAY)
    gauge = rows.groupBy("host", buckets.bucket_of_seconds("at_s", DAY).alias("bucket")).agg(F.max("in_errors").alias("gauge"))
    return rate.join(gauge, ["host", "bucket"]).groupBy("bucket").agg(
        (F.sum("increase") / DAY).alias("rate"), F.count(F.lit(1)).alias("series"), F.sum("gauge").alias("gauge")
    )


@query("agg42", sql("ops", """
SELECT kind, ms // 5000 * 5 AS bucket, max(opened)::BIGINT AS opened, max(closed)::BIGINT AS closed, (max(opened) - max(closed))::BIGINT AS active,
  max(opened - closed)::BIGINT AS peak FROM (
  SELECT kind, ms, sum(o) OVER (PARTITION BY kind ORDER BY ms) AS opened, sum(c) OVER (PARTITION BY kind ORDER BY ms) AS closed
  FROM (SELECT kind, ms, sum(o) AS o, sum(c) AS c FROM (
    SELECT kind, start_ms AS ms, 1 AS o, 0 AS c FROM ops UNION ALL SELECT kind, end_ms, 0, 1 FROM ops WHERE end_ms IS NOT NULL) GROUP BY 1, 2))
GROUP BY 1, 2"""))
def active_per_type(t):
    """Cumulative opened and closed counters per type, and what is active per 5 seconds."""
    points = S.edges(S.operations(t), ["kind"])
    per_ms = points.groupBy("kind", "ms").agg(
        F.count_if(F.col("event") == "start").alias("o"), F.count_if(F.col("event") == "end").alias("c")
    )
    run = segments.Ordered(session.settle(per_ms), ["kind"], ["ms"]).running_sums({"opened": "o", "closed": "c"}).df
    bucket = F.floor(F.col("ms") / 5000) * F.lit(5).cast("long")
    return run.groupBy("kind", bucket.alias("bucket")).agg(
        F.max("opened").alias("opened"), F.max("closed").alias("closed"),
        (F.max("opened") - F.max("closed")).alias("active"), F.max(F.col("opened") - F.col("closed")).alias("peak"),
    )


@query("agg43", sql("stages", """
SELECT priority, count(*) AS completed, count(*) FILTER (flag = 'R') AS failures, sum(bytes)::BIGINT AS shuffle_read, sum(quantity)::BIGINT AS shuffle_write,
  sum(CASE WHEN num_tasks > 1 THEN bytes ELSE 0 END)::BIGINT AS memory_spill, sum(CASE WHEN line > 5 THEN bytes ELSE 0 END)::BIGINT AS disk_spill
FROM stages WHERE end_ms IS NOT NULL GROUP BY 1"""))
def stage_outcomes(t):
    done = S.stages(t).where("end_ms IS NOT NULL")
    when = lambda cond: F.sum(F.when(cond, F.col("bytes")).otherwise(0))
    return done.groupBy("priority").agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.col("flag") == "R").alias("failures"),
        F.sum("bytes").alias("shuffle_read"),
        F.sum("quantity").alias("shuffle_write"),
        when(F.col("num_tasks") > 1).alias("memory_spill"),
        when(F.col("line") > 5).alias("disk_spill"),
    )


@query("agg47", sql("ev", """
SELECT event_type AS class, round(quantile_cont(c::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(c::DOUBLE, 0.95), 6) AS p95 FROM ev GROUP BY 1"""))
def ingest_latency(t):
    """Milliseconds from event time to first sight, by class. Five classes hold all rows, so none may meet one task."""
    rows = t.events.select(
        F.col("event_type").alias("class"),
        F.unix_millis("ts").alias("event_ms"),
        (F.unix_millis("ts") + cents("value")).alias("seen_ms"),
    )
    late = rows.select("class", (F.col("seen_ms") - F.col("event_ms")).alias("latency"))
    out = segments.exact_percentiles(late, ["class"], "latency", {"p50": 0.5, "p95": 0.95})
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


FRESH_AT = "2024-01-31 00:00:00"
CONTINUOUS = ["click", "view", "error"]


@query("agg48", f"""
SELECT event_type AS dataset, event_type IN ('click', 'view', 'error') AS continuous, epoch_us(max(ts)) // 1000000 AS last_seen,
  CASE WHEN event_type NOT IN ('click', 'view', 'error') OR max(ts) >= TIMESTAMP '{FRESH_AT}' - INTERVAL 30 MINUTE THEN 'ok' ELSE 'stale' END AS status
FROM events GROUP BY event_type""")
def freshness(t):
    """Continuous datasets must have rows in the last 30 minutes, the others only need to have any."""
    steady = F.col("event_type").isin(CONTINUOUS)
    recent = F.max("ts") >= F.lit(FRESH_AT).cast("timestamp") - F.expr("INTERVAL 30 MINUTES")
    return t.events.groupBy(F.col("event_type").alias("dataset"), steady.alias("continuous")).agg(
        F.unix_seconds(F.max("ts")).alias("last_seen"), recent.alias("recent")
    ).select(
        "dataset", "continuous", "last_seen",
        F.when(~F.col("continuous") | F.col("recent"), F.lit("ok")).otherwise(F.lit("stale")).alias("status"),
    )


@query("agg49", """
SELECT r_name, n, dup FROM (SELECT n_regionkey, count(*) AS n, count(*) - count(DISTINCT name) AS dup FROM (
  SELECT c_nationkey AS nk, 'c' || c_custkey AS name FROM customer UNION ALL SELECT s_nationkey, 'c' || s_suppkey FROM supplier)
  JOIN nation ON nk = n_nationkey GROUP BY 1) JOIN region ON n_regionkey = r_regionkey""")
def merged_sources(t):
    """Specification sources of a region put behind each other; duplicates stay."""
    a = t.customer.select(F.col("c_nationkey").alias("nk"), F.concat(F.lit("c"), F.col("c_custkey")).alias("name"))
    b = t.supplier.select(F.col("s_nationkey").alias("nk"), F.concat(F.lit("c"), F.col("s_suppkey")).alias("name"), F.lit("supplier").alias("extra"))
    rows = tables.aligned([a, b]).join(t.nation, F.col("nk") == F.col("n_nationkey"))
    per = rows.groupBy("n_regionkey", "name").agg(F.count(F.lit(1)).alias("copies"))
    out = per.groupBy("n_regionkey").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") - 1).alias("dup"))
    return out.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n", "dup")


@query("agg50", sql("counters", f"""
SELECT i.host, round(1 - idle, 6) AS cpu_used, round(1 - avail / whole, 6) AS memory_used FROM (
  SELECT host, sum(CAST(round(rate * 1000000000) AS BIGINT))::DOUBLE / count(rate) / 1000000000 AS idle FROM (
    SELECT host, CASE WHEN at_s > pa AND x >= p THEN (x - p)::DOUBLE / (at_s - pa) END AS rate FROM (
      SELECT host, at_s, in_dropped AS x, lag(in_dropped) OVER w AS p, lag(at_s) OVER w AS pa FROM (
        SELECT host, at_s, max(in_dropped) AS in_dropped FROM counters GROUP BY 1, 2) WINDOW w AS (PARTITION BY host ORDER BY at_s))) GROUP BY 1) i
JOIN (SELECT host, sum(in_errors)::DOUBLE AS avail, sum(in_dropped)::DOUBLE AS whole FROM counters GROUP BY 1) m ON i.host = m.host"""))
def node_use(t):
    """1 - idle rate and 1 - available / total per node."""
    rows = S.counters(t)
    samples = rows.groupBy("host", "at_s").agg(F.max("in_dropped").alias("idle"))
    rate = rates.counter_rates(samples, ["host"], "at_s", "at_s", ["idle"])
    # Added up in whole billionths: the sum does not depend on the order of adding.
    billionths = F.round(F.col("idle_rate") * 1_000_000_000).cast("long")
    idle = rate.groupBy("host").agg((F.sum(billionths) / F.count("idle_rate") / 1_000_000_000).alias("idle"))
    memory = rows.groupBy("host").agg(F.sum("in_errors").alias("avail"), F.sum("in_dropped").alias("whole"))
    return idle.join(memory, "host").select(
        "host",
        F.round(1 - F.col("idle"), 6).alias("cpu_used"),
        F.round(1 - ratio("avail", "whole"), 6).alias("memory_used"),
    )


@query("agg51", sql("ev", """
SELECT k AS namespace, count(*) FILTER (event_type = 'signup') AS created, count(*) FILTER (event_type = 'error') AS failed FROM ev GROUP BY 1"""))
def pods_by_namespace(t):
    return gauges(t).groupBy(F.col("k").alias("namespace")).agg(
        F.count_if(F.col("namespace") == "signup").alias("created"),
        F.count_if(F.col("namespace") == "error").alias("failed"),
    )


@query("agg52", sql("ev gc stages", """
SELECT bucket, total, mean, top, gc_micros, errors FROM (
  SELECT ms // 86400000 * 86400 AS bucket, sum(c)::BIGINT AS total, sum(k)::DOUBLE / count(*) AS mean, max(c) AS top, count(*) FILTER (level = 'ERROR') AS errors FROM ev GROUP BY 1)
LEFT JOIN (SELECT epoch_us(ts) // 86400000000 * 86400 AS bucket, sum(micros)::BIGINT AS gc_micros FROM gc WHERE form = 'paused' GROUP BY 1) USING (bucket)"""))
def cluster_panels(t):
    """Sums, averages and maxima of the whole cluster per bucket, with pause time and error records beside them."""
    rows = gauges(t)
    base = buckets.by_bucket(
        rows, "ts", DAY, [], total=F.sum("c"), mean=F.sum("k") / F.count(F.lit(1)), top=F.max("c"),
        errors=F.count_if(F.col("namespace") == "error"),
    )
    pauses = buckets.by_bucket(gc(t), "ts", DAY, [], gc_micros=F.sum("micros"))
    return base.join(pauses, "bucket", "left").select("bucket", "total", "mean", "top", "gc_micros", "errors")


@query("agg52_completed", sql("stages", """
SELECT bucket, n, CASE WHEN n - p >= 0 THEN least((n - p)::DOUBLE, 100.0::DOUBLE) END AS derivative FROM (
  SELECT bucket, n, lag(n) OVER (ORDER BY bucket) AS p FROM (SELECT end_ms // 86400000 * 86400 AS bucket, count(*) AS n FROM stages WHERE end_ms IS NOT NULL GROUP BY 1))"""))
def completed_derivative(t):
    done = S.stages(t).where("end_ms IS NOT NULL")
    per_day = done.groupBy((F.floor(F.col("end_ms") / DAY_MS) * F.lit(DAY)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return buckets.capped_derivative(per_day, [], "n", "derivative")
