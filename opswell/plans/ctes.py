"""The derived tables once more as SQL, for the comparison engine."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(names: str, body: str) -> str:
    """The body with the named derived tables, and those they need, in front."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, text = CTES[name]
        for n in needs:
            add(n)
        done[name] = f"{name} AS ({text.strip()})"

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(done.values()) + "\n" + body.strip()


cte("words", r"""
SELECT doc_id, source, lang, regexp_extract(lower(w), '[a-z]+') AS word
FROM (SELECT doc_id, source, lang, unnest(string_split_regex(text, '[ \n]')) AS w FROM documents)
WHERE regexp_extract(lower(w), '[a-z]+') <> ''""")

cte("lines", r"""
SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS value
FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)""")

cte("logs", r"""
SELECT l_orderkey AS order_key, l_partkey AS part_key, l_suppkey AS service, l_linestatus AS category,
  rpad(l_returnflag, 3, ' ') AS program, CAST(l_shipdate AS DATE) AS log_date, l_linenumber AS sequence_no,
  printf('%02d:%02d:%02d.0000000', s // 3600, (s // 60) % 60, s % 60) AS duration, s AS seconds,
  CASE WHEN l_tax > 0 THEN l_suppkey END AS producer1, CASE WHEN l_discount > 0 THEN l_linenumber END AS producer2
FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS s FROM lineitem)""")

cte("weather", r"""
SELECT user_id AS stn, CAST(ts AS DATE) AS date, year(ts) AS year, month(ts) AS mo, day(ts) AS da,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) // count(*) AS BIGINT) AS temp, count(*) AS count_temp
FROM events GROUP BY ALL""")

cte("drives", r"""
SELECT CASE WHEN l_linestatus = 'F' AND year(l_shipdate) >= 2000 THEN strftime(l_shipdate, '%-m/%-d/%y') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
  CAST(l_shipdate AS DATE) AS day, 'S' || l_partkey AS serial_number, p_brand AS model,
  CASE WHEN l_quantity = 1 THEN -1 ELSE CAST(p_size AS BIGINT) * 1073741824 END AS capacity_bytes,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS failure,
  CASE WHEN l_tax > 0 THEN CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) END AS smart_1_raw,
  CASE WHEN l_discount > 0 THEN 'n/a' ELSE '7' END AS smart_9_raw
FROM lineitem JOIN part ON l_partkey = p_partkey""")

cte("apps", r"""
SELECT o_custkey AS app, c_name AS name, c_nationkey AS nation, min(epoch_ms(o_orderdate)) AS start_ms,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN max(epoch_ms(o_orderdate)) + 864000000 END AS end_ms
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_name, c_nationkey, c_mktsegment""")

cte("jobs", r"""
SELECT o_custkey AS app, o_orderkey AS job, epoch_ms(o_orderdate) AS start_ms,
  CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + 86400000 END AS end_ms, o_orderstatus AS status
FROM orders""")

cte("stages", r"""
SELECT o_custkey AS app, o_orderkey AS job, o_orderkey * 10 + l_linenumber AS stage,
  epoch_ms(o_orderdate) + l_linenumber * 3600000 AS start_ms,
  CASE WHEN last_status = 'F' THEN epoch_ms(o_orderdate) + l_linenumber * 3600000 + 1800000 END AS end_ms,
  bytes, quantity, flag, num_tasks, l_linenumber AS line, o_orderpriority AS priority
FROM (SELECT l_orderkey, l_linenumber, max(l_linestatus) AS last_status,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS bytes,
        CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS quantity, min(l_returnflag) AS flag, count(*) AS num_tasks
      FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey""")

cte("tasks", r"""
SELECT o_custkey AS app, o_orderkey AS job, o_orderkey * 10 + l_linenumber AS stage, l_partkey AS task,
  epoch_ms(o_orderdate) + l_linenumber * 3600000 + 60000 AS start_ms,
  CASE WHEN last_status = 'F' THEN epoch_ms(o_orderdate) + l_linenumber * 3600000 + 60000 + quantity * 60000 END AS end_ms, bytes
FROM (SELECT l_orderkey, l_linenumber, l_partkey, max(l_linestatus) AS last_status,
        CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS quantity,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS bytes
      FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey""")

cte("ops", r"""
SELECT 'app' AS kind, app, CAST(NULL AS BIGINT) AS job, CAST(NULL AS BIGINT) AS stage, CAST(NULL AS BIGINT) AS task, start_ms, end_ms FROM apps
UNION ALL SELECT 'job', app, job, NULL, NULL, start_ms, end_ms FROM jobs
UNION ALL SELECT 'stage', app, job, stage, NULL, start_ms, end_ms FROM stages
UNION ALL SELECT 'task', app, job, stage, task, start_ms, end_ms FROM tasks""", "apps", "jobs", "stages", "tasks")

cte("counters", r"""
SELECT 'h' || user_id AS host, event_id AS seq, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS at_s,
  CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN c ELSE event_id * 1000 + c END AS in_bytes,
  CASE event_type WHEN 'click' THEN NULL WHEN 'signup' THEN 0 ELSE event_id * 500 + c END AS out_bytes,
  CASE WHEN event_type <> 'view' THEN event_id * 10 END AS in_packets,
  CASE WHEN event_type = 'purchase' THEN c ELSE event_id * 7 END AS out_packets,
  event_id // 3 AS in_dropped, event_id // 5 AS out_dropped, event_id // 11 AS in_errors, user_id AS out_errors
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)""")

cte("ev", r"""
SELECT *, CAST(round(value * 100) AS BIGINT) AS c, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ms,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' WHEN 'purchase' THEN 'WARN' END AS level
FROM events""")

cte("log_lines", r"""
SELECT event_id, ts, user_id, k, c, event_type,
  CASE WHEN event_type = 'signup' THEN '/mnt/spark/client-logs/inst-' || user_id || '/spark-app.log'
    ELSE '/mnt/spark/logs/' || pod || '/spark-app.log' END AS path,
  CASE WHEN event_type <> 'signup' THEN pod END AS pod, level,
  CASE WHEN event_type = 'signup' THEN 'plain line of ' || user_id
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || level || '  com.acme.Svc' || k || ':' || user_id || ' - took ' || c END AS head,
  CASE WHEN event_type = 'error' THEN 'java.lang.IllegalStateException: bad <' || k || '> & "x" isn''t' || chr(10) || chr(9) || 'at Svc' || k || '.run(Svc.java:12)' END AS trace
FROM (SELECT *, CASE event_type WHEN 'error' THEN 'spark-master-' || user_id WHEN 'click' THEN 'spark-worker-' || user_id
    WHEN 'view' THEN 'spark-history-' || user_id ELSE 'etl-' || user_id || '-driver' END AS pod FROM ev)""", "ev")

cte("gc", r"""
SELECT event_id, ts, user_id, 'pod-' || user_id AS pod_name,
  CASE event_type WHEN 'view' THEN 'worker' WHEN 'click' THEN 'driver' ELSE 'executor' END AS component,
  CASE WHEN event_type = 'purchase' THEN CAST(k // 10 AS VARCHAR) END AS rotate_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'paused' WHEN event_type IN ('purchase', 'signup') THEN 'start' END AS form,
  CASE WHEN event_type = 'click' THEN 'Remark' WHEN event_type <> 'error' THEN 'Young' END AS type,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'G1 Evacuation Pause' WHEN event_type = 'signup' THEN 'Normal' END AS kind,
  CASE WHEN event_type IN ('view', 'click') THEN c + 10 END AS before, CASE WHEN event_type IN ('view', 'click') THEN k END AS after,
  CASE WHEN event_type IN ('view', 'click') THEN c + 600 END AS heapsize,
  CASE WHEN event_type IN ('view', 'click') THEN (c // 100) * 1000 + c % 100 END AS micros
FROM ev""", "ev")

cte("alerts", r"""
SELECT event_id AS alert_id, ts AS created_on, CASE WHEN event_type = 'signup' THEN 'manual' ELSE 'feed' END AS source,
  CASE WHEN event_type = 'purchase' THEN 'CPU_SATURATED' ELSE 'ERROR_EVENT' END AS type,
  CAST(least(c // 1500 + 1, 5) AS INT) AS severity,
  CASE WHEN k >= 90 THEN 'Secondary' ELSE 'Primary' END AS correlation_group,
  CASE WHEN k < 5 THEN 'INC' || event_id END AS incident, event_type, user_id, k,
  'Svc' || (k // 10) || ':' || (k // 25) AS signature, user_id // 10 AS svc
FROM ev""", "ev")
