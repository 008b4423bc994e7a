"""Lifecycle events and streams: each stream runs until it has caught up and must agree with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswell import session
from opswell.functions.numbers import cents
from opswell.operators import lifecycle as L, rates, rollups, trees
from opswell.plans.ctes import cte, sql
from opswell.plans.windows import MEASURES
from opswell.registry import query
from opswell.sources import readers, standins as S
from opswell.streaming import files, jobs

cte("norm", """
SELECT 'App' AS class, 'Start' AS event_kind, 'host-' || nation || ':/events/app-' || app AS key, name AS service_name, 'app-' || app AS service_id,
  'app-' || app AS app_id, CAST(NULL AS VARCHAR) AS parent, start_ms AS start_millis FROM apps
UNION ALL SELECT 'App', 'End', 'host-' || nation || ':/events/app-' || app, 'NO_APP_END_NAME', 'NO_APP_END_ID', 'unknown', NULL, end_ms FROM apps WHERE end_ms IS NOT NULL
UNION ALL SELECT 'Job', 'Start', a.base || ':' || job, '' || job, '' || job, 'app-' || j.app, 'App:' || a.base, start_ms FROM jobs j JOIN base a ON j.app = a.app
UNION ALL SELECT 'Job', 'End', a.base || ':' || job, '' || job, '' || job, 'unknown', NULL, end_ms FROM jobs j JOIN base a ON j.app = a.app WHERE end_ms IS NOT NULL
UNION ALL SELECT 'Stage', 'Start', a.base || ':' || stage || ':0', 'count at Job.scala:' || line, '' || stage, 'app-' || j.app, 'App:' || a.base, start_ms FROM stages j JOIN base a ON j.app = a.app
UNION ALL SELECT 'Stage', 'End', a.base || ':' || stage || ':0', 'count at Job.scala:' || line, '' || stage, 'unknown', NULL, end_ms FROM stages j JOIN base a ON j.app = a.app WHERE end_ms IS NOT NULL
UNION ALL SELECT 'Task', 'Start', a.base || ':' || stage || ':0:' || task || ':0', '' || task, '' || task, 'unknown', 'Stage:' || a.base || ':' || stage || ':0', start_ms FROM tasks j JOIN base a ON j.app = a.app
UNION ALL SELECT 'Task', 'End', a.base || ':' || stage || ':0:' || task || ':0', '' || task, '' || task, 'unknown', NULL, end_ms FROM tasks j JOIN base a ON j.app = a.app WHERE end_ms IS NOT NULL
UNION ALL SELECT 'SQLQuery', 'Start', 'host-sql:/events/app-' || user_id || ':' || event_id, '' || event_id, '' || event_id, 'unknown', 'App:host-sql:/events/app-' || user_id, ms FROM ev
UNION ALL SELECT 'SQLQuery', 'End', 'host-sql:/events/app-' || user_id || ':' || event_id, '' || event_id, '' || event_id, 'unknown', NULL, ms + (c // 100) * 1000 FROM ev WHERE event_type <> 'error'
UNION ALL SELECT 'ExecutorAdded', 'Point', 'host-' || s_nationkey || ':/events/app-' || s_suppkey || ':' || s_name, s_name, s_name, 'unknown', NULL, s_suppkey * 1000 + 1700000000000 FROM supplier
UNION ALL SELECT 'Indeterminable', 'Indeterminable', 'Indeterminable', 'Indeterminable', 'Indeterminable', 'unknown', NULL, 0 FROM nation
""", "apps", "jobs", "stages", "tasks", "ev", "base")
cte("base", "SELECT c_custkey AS app, 'host-' || c_nationkey || ':/events/app-' || c_custkey AS base FROM customer")


@query("str01", sql("norm", """
SELECT class, event_kind, service_name, service_id, app_id, start_millis, sha1(event_kind || ':Spark:' || class || ':' || key) AS event_id,
  CASE WHEN event_kind = 'End' THEN sha1('Start:Spark:' || class || ':' || key) END AS start_event_id, sha1('Spark:' || parent) AS trace_parent_id FROM norm"""))
def normalised(t):
    rows = L.normalise(S.raw_events(t))
    return rows.select(
        "class", "event_kind", "service_name", "service_id", "app_id", "start_millis", "event_id", "start_event_id", "trace_parent_id"
    )


@query("str02", sql("jobs", "SELECT job AS service_id, start_ms AS event_ms, start_ms + 250 AS arrived_ms FROM jobs"))
def two_times(t):
    """Event time takes the place of arrival time; arrival is kept beside it."""
    rows = L.normalise(S.raw_events(t, ("job",))).where("event_kind = 'Start'")
    return rows.select(
        F.col("service_id").cast("long").alias("service_id"), F.unix_millis("ts").alias("event_ms"), F.unix_millis("log_timestamp").alias("arrived_ms")
    )


JOB_PAIRS = sql("jobs base", """
SELECT sha1('Spark:Job:' || a.base || ':' || job) AS trace_id, 'Job' AS class, start_ms, end_ms, end_ms - start_ms AS duration_ms
FROM jobs j JOIN base a ON j.app = a.app WHERE end_ms IS NOT NULL""")


@query("str03", JOB_PAIRS)
def matched_stream(t):
    """Raw lines in the order of their arrival."""
    return files.replayed(t, S.raw_events(t, ("job",)), "ingest_ts", lambda lines: jobs.match(L.normalise(lines, "Start"), L.normalise(lines, "End"), "10 days", "2 days"))


@query("str03_batch", JOB_PAIRS)
def matched_batch(t):
    return L.match(L.deliver_once(L.normalise(S.raw_events(t, ("job",)))), columns=["trace_id", "class", "start_ms", "end_ms", "duration_ms"])


FLAGGED = """
SELECT class, event_kind, matched, count(*) AS n FROM (
  SELECT 'App' AS class, 'Start' AS event_kind, end_ms IS NOT NULL AS matched FROM apps UNION ALL SELECT 'App', 'End', true FROM apps WHERE end_ms IS NOT NULL
  UNION ALL SELECT 'Job', 'Start', end_ms IS NOT NULL FROM jobs UNION ALL SELECT 'Job', 'End', true FROM jobs WHERE end_ms IS NOT NULL
  UNION ALL SELECT 'ExecutorAdded', 'Point', false FROM supplier) GROUP BY 1, 2, 3"""


def flagged(t):
    return L.flag_matched(L.normalise(S.raw_events(t, ("app", "job", "executor"))))


@query("str04", sql("apps jobs", FLAGGED))
def matched_flags(t):
    return flagged(t).groupBy("class", "event_kind", "matched").agg(F.count(F.lit(1)).alias("n"))


@query("str05", sql("apps jobs", f"""
SELECT class, CAST(sum(CASE WHEN matched OR event_kind = 'Point' THEN n ELSE 0 END) AS BIGINT) AS would_go, CAST(sum(CASE WHEN matched OR event_kind = 'Point' THEN 0 ELSE n END) AS BIGINT) AS stay FROM ({FLAGGED}) GROUP BY 1"""))
def cleared(t):
    """What a clean-up would remove (the dry run), and what the rewritten table of open events keeps."""
    path = t.scratch("flagged")
    flagged(t).select("class", "event_kind", "matched", "event_id").write.parquet(path)
    rows = t.spark.read.parquet(path)
    kept = L.keep_unmatched(rows)
    counts = rows.groupBy("class").agg(F.count(F.lit(1)).alias("all"))
    stay = kept.groupBy("class").agg(F.count(F.lit(1)).alias("stay"))
    out = counts.join(stay, "class", "left").fillna(0, ["stay"])
    return out.select("class", (F.col("all") - F.col("stay")).alias("would_go"), "stay")


OPEN_STARTS = sql("apps jobs", """
SELECT 'App' AS class, 'app-' || app AS service_id, start_ms AS start_millis FROM apps WHERE end_ms IS NULL
UNION ALL SELECT 'Job', '' || job, start_ms FROM jobs WHERE end_ms IS NULL""")


@query("str06", OPEN_STARTS)
def open_operations(t):
    rows = L.normalise(S.raw_events(t, ("app", "job")))
    return L.open_starts(rows).select("class", "service_id", "start_millis")


@query("str06_stream", OPEN_STARTS)
def open_operations_stream(t):
    """Raw lines in the order of their arrival; two events of a later time close the stream, as no end can come any more."""
    lines = S.raw_events(t, ("app", "job"))
    later = F.lit(4_102_444_800_000)  # the year 2100
    event = lambda name, key, ms: F.to_json(F.struct(F.lit(name).alias("Event"), F.lit(key).alias("Job ID"), later.alias(ms)))
    closing = t.spark.range(2).select(
        F.lit("host-later").alias("host"),
        F.lit("/events/later").alias("file_path"),
        F.timestamp_millis(later).alias("ingest_ts"),
        F.when(F.col("id") == 0, event("SparkListenerJobStart", 0, "Submission Time")).otherwise(event("SparkListenerJobEnd", 1, "Completion Time")).alias("line"),
    )
    # An application runs for as long as it has orders.
    found = lambda stream: jobs.open_starts(L.normalise(stream, "Start"), L.normalise(stream, "End"), "10 days", "4000 days")
    return files.replayed(t, lines, "ingest_ts", found, closing=closing)


OPEN_TOTALS = sql("ops", "SELECT kind, CAST(count(*) - count(end_ms) AS BIGINT) AS open FROM ops GROUP BY 1")


def changes(t):
    points = S.edges(S.operations(t), ["kind"])
    return points.withColumn("change", F.when(F.col("event") == "start", 1).otherwise(-1).cast("long"))


@query("str07", sql("ops", """
SELECT kind, cell, sum(change) OVER (PARTITION BY kind ORDER BY cell)::BIGINT AS open FROM (
  SELECT kind, ms // 5000 * 5000 AS cell, sum(change) AS change FROM (
    SELECT kind, start_ms AS ms, 1 AS change FROM ops UNION ALL SELECT kind, end_ms, -1 FROM ops WHERE end_ms IS NOT NULL) GROUP BY 1, 2)"""))
def open_counts(t):
    """Open operations per type at the end of every 5-second cell in which their number changes."""
    return L.open_on_grid(changes(t), ["kind"], "ms", "change", 5000)


@query("str07_stream", OPEN_TOTALS)
def open_counts_stream(t):
    """Snapshots of the open counts after every batch; the last one counts."""
    snapshots = t.scratch("snapshots")

    def keep(rows, number):
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{snapshots}/batch_id={number}")

    points = changes(t).select("kind", "event", "ms", "change")
    files.replayed(t, points, "ms", lambda stream: jobs.open_counts(stream, ["kind"], "change"), "complete", keep)
    return t.spark.read.parquet(snapshots).groupBy("kind").agg(F.max_by("open", "batch").alias("open"))


IDLE = 43_200
IDLE_SQL = """
SELECT host, seq, """ + ", ".join(
    f"CASE WHEN NOT first AND gap > 0 AND {m} >= p_{m} THEN ({m} - p_{m})::DOUBLE / gap END AS {m}_rate" for m in MEASURES
) + """ FROM (SELECT *, """ + ", ".join(
    f"last_value(CASE WHEN first OR gap > 0 THEN {m} END IGNORE NULLS) OVER b AS p_{m}" for m in MEASURES
) + f""" FROM (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY at_s, seq) AS epoch FROM (
  SELECT *, gap IS NULL OR gap > {IDLE} AS first FROM (SELECT *, at_s - lag(at_s) OVER (PARTITION BY host ORDER BY at_s, seq) AS gap FROM counters)))
WINDOW b AS (PARTITION BY host, epoch ORDER BY at_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("str08", sql("counters", IDLE_SQL))
def rates_stream(t):
    """Counters as a stream in time order, with state per host that a timer drops when the host falls silent."""
    rates_of = lambda stream: jobs.counter_rates(stream, ["host"], "at_s", "seq", MEASURES, IDLE)
    return files.replayed(t, S.counters(t), "at_s", rates_of)


@query("str08_batch", sql("counters", IDLE_SQL))
def rates_batch(t):
    out = rates.counter_rates(S.counters(t), ["host"], "at_s", "seq", MEASURES, IDLE)
    return out.select("host", "seq", *[f"{m}_rate" for m in MEASURES])


@query("str09", """
SELECT app, job, event, (s - least(0, min(s) OVER w))::BIGINT AS active FROM (
  SELECT *, sum(change) OVER w AS s FROM (
    SELECT o_custkey AS app, o_orderkey AS job, 'start' AS event, epoch_ms(o_orderdate) AS ms, 1 AS change, 1 AS turn FROM orders WHERE o_orderpriority <> '1-URGENT'
    UNION ALL SELECT o_custkey, o_orderkey, 'end', epoch_ms(o_orderdate) + 86400000, -1, 0 FROM orders WHERE o_orderstatus <> 'O')
  WINDOW w AS (PARTITION BY app ORDER BY ms, turn, job ROWS UNBOUNDED PRECEDING))
WINDOW w AS (PARTITION BY app ORDER BY ms, turn, job ROWS UNBOUNDED PRECEDING)""")
def guarded_counts(t):
    """Active jobs per application; ends whose start was lost find none open and are ignored."""
    points = S.edges(S.jobs(t).join(t.orders.select(F.col("o_orderkey").alias("job"), "o_orderpriority"), "job"), ["app", "job", "o_orderpriority"])
    points = points.where("NOT (event = 'start' AND o_orderpriority = '1-URGENT')").select(
        "app", "job", "event", "ms",
        F.when(F.col("event") == "start", 1).otherwise(-1).cast("long").alias("change"),
        F.when(F.col("event") == "start", 1).otherwise(0).alias("turn"),
    )
    # Days are the only times here, so many points of an application may share one; spans cut through them.
    return L.active_counts(session.settle(points), ["app"], ["ms", "turn", "job"], "change").select("app", "job", "event", "active")


@query("str10", sql("ops", """
SELECT o.kind, o.app, o.job, o.stage, o.task, coalesce(o.end_ms, p) AS closed_ms, CASE WHEN o.end_ms IS NOT NULL THEN 'end' WHEN p IS NOT NULL THEN 'parent' END AS closed_by FROM (
  SELECT o.*, least(CASE WHEN o.kind <> 'app' AND a.end_ms >= o.start_ms THEN a.end_ms END, CASE WHEN o.kind IN ('stage', 'task') AND j.end_ms >= o.start_ms THEN j.end_ms END,
    CASE WHEN o.kind = 'task' AND s.end_ms >= o.start_ms THEN s.end_ms END) AS p
  FROM ops o LEFT JOIN apps a ON o.app = a.app LEFT JOIN jobs j ON o.job = j.job LEFT JOIN stages s ON o.stage = s.stage) o"""))
def closed_by_parent(t):
    keys = {"app": "app", "job": "job", "stage": "stage"}
    above = {"job": ["app"], "stage": ["app", "job"], "task": ["app", "job", "stage"]}
    out = L.close(session.settle(S.operations(t)), keys, above)
    return out.select("kind", "app", "job", "stage", "task", "closed_ms", "closed_by")


@query("str11", sql("jobs", """
SELECT j.job, CASE WHEN o_orderpriority <> '1-URGENT' THEN (end_ms - start_ms) * 1000000 END AS duration_ns, o_orderpriority = '1-URGENT' AS start_missing
FROM jobs j JOIN orders ON job = o_orderkey WHERE end_ms IS NOT NULL"""))
def durations(t):
    starts = t.orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("job"), S.millis("o_orderdate").alias("ms"))
    ends = S.jobs(t).where("end_ms IS NOT NULL").select("job", F.col("end_ms").alias("ms"))
    return L.durations(starts, ends, "job").select("job", "duration_ns", "start_missing")


@query("str12", """
SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'SUCCESS' END AS result, o_orderpriority = '1-URGENT' AS is_retry FROM orders""")
def outcomes(t):
    attempt = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    return t.orders.select(
        F.col("o_orderkey").alias("job"), L.outcome(F.col("o_orderstatus") == "P").alias("result"), (attempt > 0).alias("is_retry")
    )



@query("str13", sql("ev", """
SELECT ms // 60000 * 60 AS bucket, event_type AS level, user_id AS pod, count(*) AS log_count, max(epoch_us(ts)) AS last_micros FROM ev
GROUP BY 1, 2, 3 HAVING (any_value(ms) // 60000 * 60 + 60) * 1000 <= (SELECT max(ms) FROM ev) - 60000"""))
def minute_rollup(t):
    """Counts per minute as a stream; the minutes that may still get rows are held back."""
    rows = t.events.select("event_id", "ts", F.col("event_type").alias("level"), F.col("user_id").alias("pod"))
    out = files.replayed(t, rows, "ts", lambda stream: jobs.rollup(stream, "ts", ["level", "pod"]))
    return out.select("bucket", "level", "pod", "log_count", F.unix_micros("bucket_end").alias("last_micros"))


AS_OF = 1_706_745_600  # 2024-02-01


@query("str14", sql("ev", f"""
SELECT s // w * w AS bucket, w AS width, event_type, count(*) AS n, sum(c)::BIGINT AS s, min(c) AS lo, max(c) AS hi FROM (
  SELECT *, CASE WHEN age >= 691200 THEN 3600 WHEN age >= 345600 THEN 900 ELSE 300 END AS w FROM (
    SELECT event_type, c, ms // 1000 AS s, {AS_OF} - ms // 300000 * 300 AS age FROM ev)) GROUP BY 1, 2, 3"""))
def tiers(t):
    rows = t.events.select("ts", "event_type", cents("value").alias("c"))
    return rollups.tiered(rows, "ts", ["event_type"], "c", AS_OF)


RETENTION = {"click": 5, "view": 10, "error": 730}


@query("str15", """
SELECT event_id FROM events WHERE NOT (event_type = 'click' AND ts < TIMESTAMP '2024-02-01' - INTERVAL 5 DAY) AND NOT (event_type = 'view' AND ts < TIMESTAMP '2024-02-01' - INTERVAL 10 DAY)
  AND NOT (event_type = 'error' AND ts < TIMESTAMP '2024-02-01' - INTERVAL 730 DAY)""")
def retained(t):
    return rollups.retained(t.events, "ts", "event_type", RETENTION, F.lit("2024-02-01").cast("timestamp")).select("event_id")


ONCE = "SELECT l_orderkey AS id FROM lineitem GROUP BY 1"


# No delivery of an order comes later than this after another one.
LONGEST_WAIT = "4000 days"


@query("str16", ONCE)
def delivered_once_stream(t):
    """Line items as deliveries of their order, by the order's time; repeats come in any later batch, up to the wait."""
    ordered = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    rows = t.lineitem.join(ordered, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), "ts", F.col("l_shipdate").cast("timestamp").alias("arrived")
    )
    return files.replayed(t, rows, "arrived", lambda stream: jobs.once(stream, "ts", "id", LONGEST_WAIT)).select("id")


@query("str16_batch", ONCE)
def delivered_once(t):
    return L.deliver_once(t.lineitem.select(F.col("l_orderkey").alias("id")), "id")


def sessions_sql(key, more=""):
    """Sessions with a gap of 15 minutes, per key."""
    return f"""
SELECT {key}, epoch_us(min(ts)) AS first_micros, count(*) AS n{more} FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS session FROM (
    SELECT *, lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS p FROM events)) GROUP BY {key}, session"""


@query("str17", sessions_sql("event_type"))
def reopened_alerts(t):
    """Events of one identifier less than 15 minutes apart are one; five identifiers hold the whole table."""
    rows = t.events.select("event_type", "ts", "event_id")
    out = rollups.sessions(rows, ["event_type"], "ts", "event_id", 900)
    return out.select("event_type", F.unix_micros("first_ts").alias("first_micros"), "n")


@query("str17_stream", f"""
SELECT user_id, first_micros, n FROM ({sessions_sql("user_id", ", epoch_us(max(ts)) + 900000000 AS ends")})
WHERE ends // 1000 <= (SELECT epoch_us(max(ts)) // 1000 - 900000 FROM events)""")
def reopened_alerts_stream(t):
    out = files.replayed(t, t.events.select("user_id", "ts"), "ts", lambda stream: jobs.sessions(stream, "ts", "user_id", "15 minutes", "15 minutes"))
    return out.select("user_id", F.unix_micros("first_ts").alias("first_micros"), "n")


@query("str18", """
SELECT n_name AS "group", 'c' || c_custkey AS member FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT r_name, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'all', 'c' || c_custkey FROM customer""")
def nested_members(t):
    groups = t.region.select(F.lit("all").alias("parent"), F.col("r_name").alias("child")).unionByName(
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    )
    direct = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.concat(F.lit("c"), F.col("c_custkey")).alias("member"))
    return trees.members(groups, direct, "parent", "child", "n_name", "member")


def spans(t):
    """Operations as spans that only know their parent."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}"), F.col(c))
    parts = [
        S.applications(t).select(name("a", "app").alias("span_id"), F.lit(None).cast("string").alias("parent_id")),
        S.jobs(t).select(name("j", "job").alias("span_id"), name("a", "app").alias("parent_id")),
        S.stages(t).select(name("s", "stage").alias("span_id"), name("j", "job").alias("parent_id")),
        S.tasks(t).select(F.concat(name("t", "stage"), F.lit("-"), F.col("task")).alias("span_id"), name("s", "stage").alias("parent_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("str19", sql("apps jobs stages tasks", """
SELECT 'a' || app AS span_id, 1 AS level, 'a' || app AS path, 'a' || app AS root, (SELECT count(*) FROM jobs j WHERE j.app = a.app) AS children FROM apps a
UNION ALL SELECT 'j' || job, 2, 'a' || app || '/j' || job, 'a' || app, coalesce(n, 0) FROM jobs LEFT JOIN (SELECT job AS pj, count(*) AS n FROM stages GROUP BY 1) ON job = pj
UNION ALL SELECT 's' || stage, 3, 'a' || app || '/j' || job || '/s' || stage, 'a' || app, coalesce(n, 0) FROM stages LEFT JOIN (SELECT stage AS ps, count(*) AS n FROM tasks GROUP BY 1) ON stage = ps
UNION ALL SELECT 't' || stage || '-' || task, 4, 'a' || app || '/j' || job || '/s' || stage || '/t' || stage || '-' || task, 'a' || app, 0 FROM tasks"""))
def span_tree(t):
    return trees.levels(session.settle(spans(t), "zstd")).drop("parent_id")
