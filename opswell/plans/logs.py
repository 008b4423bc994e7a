"""Log lines to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswell.operators import buckets, logs as G
from opswell.plans.aggregates import DAY, gc
from opswell.plans.ctes import cte, sql
from opswell.registry import query
from opswell.sources import readers, standins as S

cte("short", """
SELECT event_id, user_id, k, event_type, level, pod, path, CASE WHEN level IS NOT NULL THEN 'com.acme.Svc' || k END AS log_class,
  CASE WHEN level IS NOT NULL THEN user_id END AS log_line, CASE WHEN level IS NOT NULL THEN 'com.acme.Svc' || k || ':' || user_id ELSE ':' END AS signature,
  CASE WHEN level = 'ERROR' THEN 2 ELSE 3 END AS severity FROM log_lines""", "log_lines")


def log_file_rows(t):
    """Documents as log files: one file per source, each document a record that begins with a time."""
    head = F.concat(F.lit("2024-01-01 00:00:00 INFO Doc:"), F.col("doc_id"), F.lit(" - start"))
    return t.documents.select("source", "doc_id", F.concat(head, F.lit("\n"), F.col("text")).alias("value"))


@query("log01", """
WITH lines AS (
  SELECT source, doc_id, '2024-01-01 00:00:00 INFO Doc:' || doc_id || ' - start' AS first_line, '2024-01-01 00:00:00 INFO Doc:' || doc_id || ' - start' AS value, 0 AS pos FROM documents
  UNION ALL SELECT source, doc_id, '2024-01-01 00:00:00 INFO Doc:' || doc_id || ' - start', unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) FROM documents)
SELECT source, first_line, any_value(n) AS lines, pos // 500 AS chunk, sha1(string_agg(value, chr(10) ORDER BY pos)) AS digest
FROM (SELECT *, count(*) OVER (PARTITION BY source, doc_id) AS n FROM lines) GROUP BY source, doc_id, first_line, pos // 500""")
def stitched(t):
    """Records of many lines read back from files, where no line knows its record."""
    path = t.scratch("log-files")
    log_file_rows(t).select("source", "value").write.partitionBy("source").option("lineSep", "\n").text(path)
    lines = readers.numbered_lines(t.spark, path + "/*")
    records = G.stitch(lines, "path", "line_no", "value")
    return records.select(
        F.regexp_extract("path", "source=([^/]+)", 1).alias("source"),
        F.col("head").alias("first_line"),
        "lines",
        "chunk",
        F.sha1("text").alias("digest"),
    )


def records(t):
    return G.application_records(S.log_lines(t))


@query("log02", sql("log_lines", """
SELECT event_id, CASE WHEN level IS NOT NULL THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS log_timestamp, level AS parsed_level,
  CASE WHEN level IS NOT NULL THEN 'com.acme.Svc' || k END AS class, CASE WHEN level IS NOT NULL THEN user_id END AS line_number,
  CASE WHEN level IS NOT NULL THEN 'took ' || c END AS log_message FROM log_lines"""))
def parsed(t):
    return records(t).select("event_id", "log_timestamp", "parsed_level", "class", "line_number", "log_message")


@query("log03", sql("log_lines", """
SELECT event_id, CASE WHEN level IS NOT NULL THEN 'com.acme.Svc' || k || ':' || user_id || ' - ' || head ELSE head END AS message,
  replace(replace(replace(replace(replace(trace, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS stack_trace FROM log_lines"""))
def messages(t):
    return records(t).select("event_id", "message", "stack_trace")


@query("log04", sql("log_lines", """
SELECT event_id, coalesce(level, 'INFO') AS level, CASE coalesce(level, 'INFO') WHEN 'ERROR' THEN 'error' WHEN 'WARN' THEN 'warning' WHEN 'DEBUG' THEN 'debug' ELSE 'info' END AS event_type FROM log_lines"""))
def levels(t):
    return records(t).select("event_id", "level", "event_type")


@query("log05", sql("gc", """
SELECT event_id, type, kind, before, after, heapsize, micros, before - after AS reclaimed FROM gc WHERE form = 'paused'"""))
def pauses(t):
    return gc(t).select(
        "event_id", "type", "kind", F.col("before").cast("long"), F.col("after").cast("long"), F.col("heapsize").cast("long"),
        "micros", F.col("reclaimed").cast("long"),
    )


@query("log06", sql("gc", """
SELECT event_id, type, kind, CASE WHEN form = 'paused' THEN 'paused' END AS stats, CASE WHEN form IS NOT NULL THEN 'info' END AS level,
  CASE WHEN form IS NOT NULL THEN event_id END AS cycle, CASE WHEN form = 'start' THEN 'gc,start' WHEN form = 'paused' THEN 'gc' END AS gc_tags FROM gc"""))
def gc_lines(t):
    return G.gc_records(S.gc_lines(t)).select("event_id", "type", "kind", "stats", "level", F.col("cycle").cast("long"), "gc_tags")


@query("log07", sql("gc", "SELECT event_id, pod_name, component, rotate_id FROM gc"))
def gc_paths(t):
    return G.gc_located(S.gc_lines(t)).select("event_id", "pod_name", "component", "rotate_id")


@query("log08", sql("log_lines", """
SELECT event_id, pod AS pod_name, CASE WHEN pod IS NULL THEN 'inst-' || user_id END AS driver_instance, CASE WHEN pod IS NULL THEN 'Client' ELSE 'Cluster' END AS mode,
  CASE event_type WHEN 'error' THEN 'master' WHEN 'click' THEN 'worker' WHEN 'view' THEN 'history' WHEN 'signup' THEN 'client' ELSE 'driver' END AS component FROM log_lines"""))
def places(t):
    return G.located(S.log_lines(t)).select("event_id", "pod_name", "driver_instance", "mode", "component")


def signed(t):
    rows = G.located(G.signatures(S.log_lines(t)))
    return rows.withColumn("service_instance", G.service_of_pod(F.coalesce("pod_name", F.lit(""))))


@query("log09", sql("short", """
SELECT event_id, level AS log_level, log_class, log_line, signature, severity AS impact, severity AS urgency FROM short"""))
def signatures(t):
    return signed(t).select("event_id", "log_level", "log_class", F.col("log_line").cast("long"), "signature", "impact", "urgency")


@query("log10", sql("log_lines", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'Spark-Master' WHEN 'click' THEN 'Spark-Worker' WHEN 'view' THEN 'Spark-History-Server' ELSE '' END AS service_instance,
  CASE WHEN k > 80 THEN 'wl-' || k WHEN k > 60 THEN 'dep-' || k ELSE CASE event_type WHEN 'error' THEN 'spark-master' WHEN 'view' THEN 'spark-history-server' ELSE '' END END AS workload,
  CASE WHEN k > 90 THEN 'statefulset' ELSE 'deployment' END AS kind FROM log_lines WHERE pod IS NOT NULL"""))
def services(t):
    rows = G.located(S.log_lines(t).join(t.events.select("event_id", "props"), "event_id")).where("pod_name IS NOT NULL")
    k = S.props_k()
    workload = F.when(k > 80, F.concat(F.lit("wl-"), k))
    deployment = F.when(k > 60, F.concat(F.lit("dep-"), k)).otherwise(F.lit(""))
    return rows.select(
        "event_id",
        G.service_of_pod("pod_name").alias("service_instance"),
        G.workload_of_pod("pod_name", workload, deployment).alias("workload"),
        G.workload_kind(F.when(k > 90, F.lit("statefulset"))).alias("kind"),
    )


@query("log11", sql("short", """
SELECT event_id, 'Critical ' || level || ' at ' || log_class || ':' || log_line AS event_name,
  'K8s critical ' || level || ' at ' || log_class || ':' || log_line || ' on ' || pod || ' sn-event_kind=CRITICAL_LOG_EVENT sn-log-signature=' || signature || ' sn-environment=lab sn-service_instance='
    || CASE event_type WHEN 'error' THEN 'Spark-Master' ELSE '' END || ' sn-impact=' || severity || ' sn-urgency=' || severity AS event_description,
  'lab|' || CASE event_type WHEN 'error' THEN 'Spark-Master' ELSE '' END || '|K8s Critical ' || level || ' ' || signature AS unique_id
FROM short WHERE level IN ('WARN', 'ERROR')"""))
def critical(t):
    return G.critical_events(signed(t), "lab", "K8s").select("event_id", "event_name", "event_description", "unique_id")


@query("log12", sql("short", """
SELECT event_id, 'K8s log missing k8s.pod.name on ' || path AS event_name, 'lab|enrichment-missing|' || path AS unique_id FROM short WHERE level IN ('WARN', 'ERROR') AND k < 10"""))
def missing_pods(t):
    """Records whose pod name got lost; here those with a small k."""
    lost = t.events.where(S.props_k() < 10).select(F.col("event_id").alias("_lost"))
    rows = signed(t).join(lost, F.col("event_id") == F.col("_lost"), "left")
    rows = rows.withColumn("pod_name", F.when(F.col("_lost").isNull(), F.col("pod_name")))
    # Records of clients never have a pod; they are not container output.
    rows = rows.where("mode = 'Cluster'")
    return G.missing_pod_events(rows, "lab", "path").select("event_id", "event_name", "unique_id")


@query("log13", sql("log_lines", """
SELECT epoch_us(ts) // 86400000000 * 86400 AS bucket, coalesce(level, 'INFO') AS level, CASE WHEN pod IS NULL THEN 'Client' ELSE 'Cluster' END AS mode, count(*) AS n FROM log_lines GROUP BY 1, 2, 3"""))
def volumes(t):
    return buckets.by_bucket(G.located(records(t)), "ts", DAY, ["level", "mode"], n=F.count(F.lit(1)))



@query("log14", sql("log_lines", """
SELECT event_id, pod FROM log_lines WHERE ts >= TIMESTAMP '2024-01-10 10:00:00' AND ts < TIMESTAMP '2024-01-10 11:00:00' AND level IN ('ERROR', 'WARN')"""))
def drill_down(t):
    """Records of exactly the chosen bucket; the time range goes to the scan before anything is parsed."""
    lo, hi = F.lit("2024-01-10 10:00:00").cast("timestamp"), F.lit("2024-01-10 11:00:00").cast("timestamp")
    inside = S.log_lines(t).where((F.col("ts") >= lo) & (F.col("ts") < hi))
    rows = G.located(G.application_records(inside)).where(F.col("level").isin("ERROR", "WARN"))
    return rows.select("event_id", F.col("pod_name").alias("pod"))


@query("log15", sql("log_lines", """
SELECT event_id, 'h' || user_id || ':' || CASE WHEN pod IS NULL THEN 'inst-' || user_id ELSE 'unknown' END AS instance FROM log_lines"""))
def instances(t):
    host = F.concat(F.lit("h"), F.regexp_extract("path", "-(\\d+)", 1))
    return G.located(S.log_lines(t)).select("event_id", G.instance_id(host, "driver_instance").alias("instance"))


