"""Threshold alerts, entity resolution and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswell import session
from opswell.functions import text as X
from opswell.operators import alerts as A, buckets, tables
from opswell.operators.logs import service_of_pod
from opswell.plans.aggregates import HOUR, gauges
from opswell.plans.ctes import cte, sql
from opswell.registry import query
from opswell.sources import standins as S


@query("alr01", sql("ev", """
SELECT bucket, host, v > 0 AS raised, v = 0 AND n = 3 AS cleared FROM (SELECT bucket, host, sum(v) OVER w AS v, count(*) OVER w AS n FROM (
    SELECT ms // 21600000 * 21600 AS bucket, user_id AS host, CASE WHEN sum(k)::DOUBLE / count(*) > 50.0 THEN 1 ELSE 0 END AS v FROM ev GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY host ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""))
def cpu_threshold(t):
    """Above 50 in 1 of 3 samples raises, 3 good samples clear; a sample is the average of a bucket."""
    samples = buckets.by_bucket(gauges(t), "ts", 6 * HOUR, ["host"], mean=F.sum("k") / F.count(F.lit(1)))
    return buckets.violations(samples, ["host"], F.col("mean") > 50.0, 1, 3, 3).select("bucket", "host", "raised", "cleared")


def rule_of(t):
    """Events as samples of the rules: which rule by the kind of event, the entity by groups of users."""
    kind = F.col("event_type")
    rule = F.when(kind == "click", F.lit("highCpuUsage")).when(kind == "view", F.lit("highMemoryUsage")).otherwise(F.lit("podsSaturation"))
    area = F.when(kind.isin("click", "view"), F.lit("workload")).when(kind == "error", F.lit("node")).otherwise(F.lit("cluster"))
    entity = F.call_function("div", F.col("user_id"), F.lit(50))
    return t.events.select("ts", area.alias("area"), rule.alias("rule"), entity.alias("entity"), S.props_k().cast("double").alias("value"))


@query("alr02", sql("ev", """
SELECT area, rule, entity, m AS minute, count(*) AS violating FROM (
  SELECT DISTINCT area, rule, entity, need, unnest(generate_series(minute, minute + need - 1)) AS m, minute FROM (
    SELECT ms // 3600000 AS minute, user_id // 50 AS entity, k,
      CASE WHEN event_type IN ('click', 'view') THEN 'workload' WHEN event_type = 'error' THEN 'node' ELSE 'cluster' END AS area,
      CASE event_type WHEN 'click' THEN 'highCpuUsage' WHEN 'view' THEN 'highMemoryUsage' ELSE 'podsSaturation' END AS rule,
      CASE event_type WHEN 'click' THEN 40 WHEN 'view' THEN 50 WHEN 'error' THEN 50 ELSE 60 END AS threshold,
      CASE WHEN event_type IN ('click', 'view') THEN 3 ELSE 2 END AS need FROM ev) WHERE k > threshold)
GROUP BY area, rule, entity, m, need HAVING count(*) >= need"""))
def saturated(t):
    return A.saturation(rule_of(t), unit_seconds=HOUR)


@query("alr03", sql("ev", """
SELECT 'workload' AS area, rule, user_id AS entity, w AS window_start, count(*) AS n FROM (
  SELECT *, CASE event_type WHEN 'error' THEN 'containerRestarts' ELSE 'oomKills' END AS rule, CASE event_type WHEN 'error' THEN ms // 120000 * 120 ELSE ms // 60000 * 60 END AS w
  FROM ev WHERE event_type IN ('error', 'purchase')) GROUP BY 2, 3, 4"""))
def counted(t):
    kind = F.col("event_type")
    rows = t.events.where(kind.isin("error", "purchase")).select(
        "ts", F.lit("workload").alias("area"), F.col("user_id").alias("entity"),
        F.when(kind == "error", F.lit("containerRestarts")).otherwise(F.lit("oomKills")).alias("rule"),
    )
    return A.count_events(rows)


@query("alr04", sql("ev", """
SELECT event_id, due AS level, ms // 1000 AS due_s FROM (SELECT *, CASE event_type WHEN 'error' THEN 'ERRORS' WHEN 'purchase' THEN 'PERFORMANCE' WHEN 'view' THEN 'CUSTOM_ALERT' END AS due FROM ev) WHERE due IS NOT NULL"""))
def profiled(t):
    kind = F.col("event_type")
    level = F.when(kind == "error", F.lit("ERRORS")).when(kind == "purchase", F.lit("PERFORMANCE")).when(kind == "view", F.lit("CUSTOM_ALERT")).otherwise(F.lit("MONITORING"))
    rows = t.events.select("event_id", "ts", level.alias("level"))
    return A.profiled(rows, "level", "ts").select("event_id", "level", F.unix_seconds("due_on").alias("due_s"))


# Entities

cte("entities", """
SELECT alert_id, event_type, user_id, k, CASE event_type WHEN 'purchase' THEN 'HOST' WHEN 'view' THEN 'CLOUD_APPLICATION' WHEN 'click' THEN 'CUSTOM_DEVICE' WHEN 'signup' THEN 'HOST' END AS entity_type,
  CASE event_type WHEN 'purchase' THEN 'HOST-' || to_hex(user_id + 4096) WHEN 'view' THEN 'CLOUD_APPLICATION-' || to_hex(k + 4096) WHEN 'click' THEN 'CUSTOM_DEVICE-' || to_hex(user_id)
    WHEN 'signup' THEN 'HOST-' || to_hex(user_id + 4096) END AS entity_id,
  CASE event_type WHEN 'view' THEN 'wl-' || k WHEN 'error' THEN NULL ELSE 'host' || user_id END AS entity_name FROM alerts""", "alerts")


@query("ent01", sql("entities", "SELECT alert_id, entity_type, entity_id, entity_name FROM entities"))
def entities(t):
    return A.primary_entity(S.alerts(t)).select("alert_id", "entity_type", "entity_id", "entity_name")


def host_links(t):
    """Links of host entities to records, for some of the nations."""
    rows = t.customer.where("c_nationkey < 12")
    return rows.select(F.concat(F.lit("HOST-"), F.hex(F.col("c_custkey") + 4096)).alias("key"), F.concat(F.lit("srv-"), F.col("c_custkey")).alias("sys_id"))


def host_names(t):
    rows = t.customer.where("c_acctbal > 0")
    return rows.select(F.concat(F.lit("host"), F.col("c_custkey")).alias("key"), F.concat(F.lit("cmp-"), F.col("c_custkey")).alias("sys_id"))


@query("ent02", sql("entities", """
SELECT alert_id, CASE WHEN c_nationkey < 12 THEN 'srv-' || c_custkey WHEN c_acctbal > 0 THEN 'cmp-' || c_custkey END AS sys_id,
  CASE WHEN c_nationkey < 12 THEN 'link' WHEN c_acctbal > 0 THEN 'name' END AS how FROM entities LEFT JOIN customer ON user_id = c_custkey WHERE entity_type = 'HOST'"""))
def hosts(t):
    rows = A.primary_entity(S.alerts(t)).where("entity_type = 'HOST'")
    out = A.cascade(rows, [A.Step("link", F.col("entity_id"), host_links(t)), A.Step("name", F.col("entity_name"), host_names(t))])
    return out.select("alert_id", "sys_id", "how")


@query("ent03", sql("entities", """
SELECT alert_id, coalesce('svc-link-' || a.s_suppkey, 'svc-tag-' || b.s_suppkey, 'svc-name-' || c.c_custkey) AS sys_id,
  CASE WHEN a.s_suppkey IS NOT NULL THEN 'link' WHEN b.s_suppkey IS NOT NULL THEN 'tag' WHEN c.c_custkey IS NOT NULL THEN 'name' END AS how
FROM entities e LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 10) a ON e.user_id = a.s_suppkey
LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey >= 15) b ON e.user_id = b.s_suppkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON e.user_id = c.c_custkey
WHERE entity_type = 'CUSTOM_DEVICE'"""))
def devices(t):
    """A device by its link, by the tag that names it, or by a service of its name."""
    rows = A.primary_entity(S.alerts(t)).where("entity_type = 'CUSTOM_DEVICE'")
    device = F.concat(F.lit("CUSTOM_DEVICE-"), F.hex("s_suppkey"))
    sys_id = lambda kind, c: F.concat(F.lit(f"svc-{kind}-"), F.col(c))
    links = t.supplier.where("s_nationkey < 10").select(device, sys_id("link", "s_suppkey"))
    tags = t.supplier.where("s_nationkey >= 15").select(device, sys_id("tag", "s_suppkey"))
    names = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("host"), F.col("c_custkey")), sys_id("name", "c_custkey"))
    steps = [A.Step("link", F.col("entity_id"), links), A.Step("tag", F.col("entity_id"), tags), A.Step("name", F.col("entity_name"), names)]
    return A.cascade(rows, steps).select("alert_id", "sys_id", "how")


def pods(t):
    """Customers as pods; some are members of a service."""
    return t.customer.select(
        F.concat(F.lit("spark-worker-"), F.col("c_custkey")).alias("name"),
        F.concat(F.lit("pod-"), F.col("c_custkey")).alias("sys_id"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("svc-"), F.col("c_nationkey"))).alias("service"),
    )


POD_SERVICES = {"Spark Master": "svc-master", "Spark Worker": "svc-worker", "Spark History Server": "svc-history"}


@query("ent03_pod", sql("alerts", """
SELECT alert_id, CASE WHEN c_custkey IS NOT NULL THEN 'pod-' || c_custkey END AS pod_id, CASE WHEN c_acctbal > 0 THEN 'svc-' || c_nationkey ELSE 'svc-worker' END AS sys_id,
  CASE WHEN c_acctbal > 0 THEN 'membership' ELSE 'pod name' END AS how FROM alerts LEFT JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'"""))
def pod_services(t):
    """A pod by name, its service by membership, else by what its name begins with."""
    pod = X.first_match("description", X.stamp_patterns(X.POD_KEYS, X.NAME_VALUE))
    rows = X.once(S.alerts(t), pod=pod).where("pod IS NOT NULL")
    rows = A.cascade(rows, [A.Step("name", F.col("pod"), pods(t).select("name", "sys_id"))], "pod_id", "pod_how")
    members = pods(t).where("service IS NOT NULL").select("sys_id", "service")
    named = t.spark.createDataFrame(list(POD_SERVICES.items()), "name string, sys_id string")
    service_name = F.replace(service_of_pod("pod"), F.lit("-"), F.lit(" "))
    out = A.cascade(rows, [A.Step("membership", F.col("pod_id"), members), A.Step("pod name", service_name, named)])
    return out.select("alert_id", "pod_id", "sys_id", "how")


def workloads(t):
    """Parts as workloads, several classes sharing a name."""
    cls = F.lit("cmdb_ci_kubernetes_job")
    for kind, name in (("ECONOMY", "deployment"), ("SMALL", "statefulset"), ("MEDIUM", "daemon_set"), ("LARGE", "cron_job")):
        cls = F.when(F.col("p_type") == kind, F.lit(f"cmdb_ci_kubernetes_{name}")).otherwise(cls)
    return t.part.select(
        F.concat(F.lit("wl-"), F.col("p_size")).alias("name"),
        cls.alias("class"),
        F.concat(F.lit("w"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("sys_id"),
        F.col("p_brand"),
        F.col("p_size"),
    )


cte("workloads", """
SELECT 'wl-' || p_size AS name, 'cmdb_ci_kubernetes_' || CASE p_type WHEN 'ECONOMY' THEN 'deployment' WHEN 'SMALL' THEN 'statefulset' WHEN 'MEDIUM' THEN 'daemon_set' WHEN 'LARGE' THEN 'cron_job' ELSE 'job' END AS class,
  'w' || lpad('' || p_partkey, 10, '0') AS sys_id, p_brand, p_size FROM part""")


@query("ent03_workload", sql("entities workloads", """
SELECT alert_id, coalesce(a.s, b.s, c.s) AS sys_id, CASE WHEN a.s IS NOT NULL THEN 'link' WHEN b.s IS NOT NULL THEN 'correlation id' WHEN c.s IS NOT NULL THEN 'name' END AS how FROM entities
LEFT JOIN (SELECT p_size, min(sys_id) AS s FROM workloads WHERE p_brand = 'Brand#1' GROUP BY 1) a ON k = a.p_size
LEFT JOIN (SELECT p_size, min(sys_id) AS s FROM workloads WHERE p_brand = 'Brand#2' GROUP BY 1) b ON k = b.p_size
LEFT JOIN (SELECT p_size, min(sys_id) AS s FROM workloads GROUP BY 1) c ON k = c.p_size WHERE entity_type = 'CLOUD_APPLICATION'"""))
def workload_records(t):
    rows = A.primary_entity(S.alerts(t)).where("entity_type = 'CLOUD_APPLICATION'")
    entity = F.concat(F.lit("CLOUD_APPLICATION-"), F.hex(F.col("p_size").cast("long") + 4096))
    w = workloads(t)
    steps = [
        A.Step("link", F.col("entity_id"), w.where("p_brand = 'Brand#1'").select(entity, "sys_id")),
        A.Step("correlation id", F.col("entity_id"), w.where("p_brand = 'Brand#2'").select(entity, "sys_id")),
        A.Step("name", F.col("entity_name"), w.select("name", "sys_id")),
    ]
    return A.cascade(rows, steps).select("alert_id", "sys_id", "how")


cte("resolved", """
SELECT a.*, CASE event_type WHEN 'error' THEN 'Svc-' || svc WHEN 'click' THEN 'svc-id-' || svc WHEN 'view' THEN 'Svc.' || svc END AS stamp,
  CASE WHEN event_type IN ('error', 'click') AND s_suppkey IS NOT NULL THEN 'sys-' || svc END AS service,
  CASE WHEN s_suppkey IS NULL THEN NULL WHEN event_type = 'error' THEN 'name with blanks' WHEN event_type = 'click' THEN 'identifier' END AS how
FROM alerts a LEFT JOIN supplier ON svc = s_suppkey""", "alerts")


def resolved(t):
    rows = X.once(S.alerts(t), stamp=X.service_stamp("description"))
    return A.cascade(rows, A.service_steps(F.col("stamp"), S.services(t)), "service", "how")


@query("ent04", sql("resolved", "SELECT alert_id, stamp, service, how FROM resolved"))
def services(t):
    return resolved(t).select("alert_id", "stamp", "service", "how")


cte("one", """
SELECT r.*, coalesce(service, CASE WHEN event_type = 'purchase' AND c_acctbal > 0 THEN 'svc-' || c_nationkey WHEN event_type = 'purchase' THEN 'svc-worker'
    WHEN event_type = 'signup' AND k % 3 = 0 AND s_suppkey IS NOT NULL THEN 'sys-' || svc WHEN event_type = 'signup' AND k % 3 = 1 AND c_nationkey < 12 THEN 'svc-' || c_nationkey
    WHEN event_type = 'view' AND k BETWEEN 1 AND 50 THEN 'svc-wl-' || k WHEN event_type = 'view' AND k > 50 AND c_acctbal > 0 THEN 'svc-' || c_nationkey END) AS sys_id,
  coalesce(how, CASE WHEN event_type = 'purchase' AND c_acctbal > 0 THEN 'pod membership' WHEN event_type = 'purchase' THEN 'pod name'
    WHEN event_type = 'signup' AND k % 3 = 0 AND s_suppkey IS NOT NULL THEN 'record itself' WHEN event_type = 'signup' AND k % 3 = 1 AND c_nationkey < 12 THEN 'record membership'
    WHEN event_type = 'view' AND k BETWEEN 1 AND 50 THEN 'application' WHEN event_type = 'view' AND k > 50 AND c_acctbal > 0 THEN 'application instance' END) AS found_by
FROM resolved r LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON svc = s_suppkey""", "resolved")


def grouped_alerts(t):
    """Alerts with a record, and every tenth as what the next nine belong to; some of these are group alerts."""
    kind, k, alert = F.col("event_type"), F.col("k"), F.col("alert_id")
    service = F.concat(F.lit("sys-"), F.call_function("div", F.col("user_id"), F.lit(10)))
    instance = F.format_string(
        '{"ImpactedEntity":{"type":"CLOUD_APPLICATION_INSTANCE","entity":"CLOUD_APPLICATION_INSTANCE-%s","name":"spark-worker-%d"}}', F.hex(k + 4096), F.col("user_id")
    )
    kinds = t.events.select(F.col("event_id").alias("_event"), "event_type")
    rows = S.alerts(t).join(kinds, alert == F.col("_event"))
    return rows.withColumns(
        {
            "record": F.when((kind == "signup") & (k % 3 == 0), service).when((kind == "signup") & (k % 3 == 1), F.concat(F.lit("srv-"), "user_id")),
            "additional_info": F.when((kind == "view") & (k > 50), instance).otherwise(F.col("additional_info")),
            "parent": F.when(alert % 10 != 0, alert - alert % 10),
            "is_group": (kind == "signup") & (k % 3 == 2) & (alert % 10 == 0),
        }
    ).drop("_event", "event_type")


@query("ent05", sql("one", """
SELECT alert_id, coalesce(sys_id, m_sys) AS sys_id, CASE WHEN sys_id IS NULL AND m_sys IS NOT NULL THEN 'group member' ELSE found_by END AS how, CASE WHEN sys_id IS NULL THEN m_id END AS via
FROM one LEFT JOIN (SELECT alert_id - alert_id % 10 AS parent, sys_id AS m_sys, alert_id AS m_id FROM one WHERE alert_id % 10 <> 0 AND sys_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY alert_id - alert_id % 10 ORDER BY created_on, alert_id) = 1) m
  ON one.alert_id = m.parent AND event_type = 'signup' AND k % 3 = 2"""))
def service_of_alert(t):
    """Service instance of an alert: by stamp, by pod, by its record, by the entity it is about, and of a group by its members, in this order."""
    rows = X.once(
        grouped_alerts(t),
        stamp=X.service_stamp("description"),
        pod=X.first_match("description", X.stamp_patterns(X.POD_KEYS, X.NAME_VALUE)),
    )
    rows = A.primary_entity(rows)
    members = pods(t).where("service IS NOT NULL").select("name", "service")
    named = t.spark.createDataFrame(list(POD_SERVICES.items()), "name string, sys_id string")
    of_entity = workloads(t).select("name", F.concat(F.lit("svc-"), F.col("name"))).distinct()
    services_ = S.services(t)
    # Infrastructure records of some nations are members of a service.
    of_record = t.customer.where("c_nationkey < 12").select(F.concat(F.lit("srv-"), "c_custkey"), F.concat(F.lit("svc-"), "c_nationkey"))
    named_by = lambda entity: F.when(F.col("entity_type") == entity, F.col("entity_name"))
    steps = [
        *A.service_steps(F.col("stamp"), services_),
        A.Step("pod membership", F.col("pod"), members),
        A.Step("pod name", F.replace(service_of_pod(F.coalesce("pod", F.lit(""))), F.lit("-"), F.lit(" ")), named),
        A.Step("record itself", F.col("record"), services_.select("sys_id", F.col("sys_id").alias("of"))),
        A.Step("record membership", F.col("record"), of_record),
        A.Step("application", named_by("CLOUD_APPLICATION"), of_entity),
        A.Step("application instance", named_by("CLOUD_APPLICATION_INSTANCE"), members),
    ]
    found = session.settle(A.cascade(rows, steps).select("alert_id", "created_on", "parent", "is_group", "sys_id", "how"))
    return A.by_members(found, "alert_id", "parent", "is_group", "created_on").select("alert_id", "sys_id", "how", "via")


@query("ent06", sql("alerts workloads", """
SELECT alert_id, (list_sort(list({'o': CASE WHEN class = pref THEN 0 ELSE o END, 'c': class, 's': s}))[1]).c AS workload_class, (list_sort(list({'o': CASE WHEN class = pref THEN 0 ELSE o END, 'c': class, 's': s}))[1]).s AS workload_id FROM (
  SELECT alert_id, class, o, s, CASE event_type WHEN 'click' THEN 'cmdb_ci_kubernetes_cron_job' WHEN 'view' THEN 'cmdb_ci_kubernetes_statefulset' WHEN 'error' THEN 'cmdb_ci_kubernetes_deployment' END AS pref
  FROM alerts LEFT JOIN (SELECT p_size, class, min(sys_id) AS s, list_position(['cmdb_ci_kubernetes_deployment', 'cmdb_ci_kubernetes_statefulset', 'cmdb_ci_kubernetes_daemon_set', 'cmdb_ci_kubernetes_cron_job', 'cmdb_ci_kubernetes_job'], class) AS o FROM workloads GROUP BY 1, 2) ON k = p_size) GROUP BY alert_id"""))
def workload_classes(t):
    kind = F.col("event_type")
    preferred = F.when(kind == "click", F.lit("CronJob")).when(kind == "view", F.lit("statefulsets")).when(kind == "error", F.lit("deployment")).otherwise(F.lit(""))
    rows = t.events.select(F.col("event_id").alias("alert_id"), F.concat(F.lit("wl-"), S.props_k()).alias("workload"), preferred.alias("kind"))
    return A.workload_by_kind(rows, "workload", "kind", workloads(t)).select("alert_id", "workload_class", "workload_id")


cte("prioritised", """
SELECT *, CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 2 WHEN 'purchase' THEN 2 ELSE CASE severity WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 3 END END AS impact,
  CASE event_type WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE CASE severity WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END END AS urgency FROM resolved""", "resolved")


@query("ent07", sql("prioritised", "SELECT alert_id, impact, urgency FROM prioritised"))
def priorities(t):
    return A.priorities(S.alerts(t)).select("alert_id", "impact", "urgency")


@query("ent08", sql("alerts workloads", """
SELECT alert_id, CASE event_type WHEN 'view' THEN 'wl-' || k END AS workload, CASE event_type WHEN 'purchase' THEN 'spark-worker-' || user_id END AS pod,
  CASE event_type WHEN 'view' THEN w.s WHEN 'purchase' THEN CASE WHEN c_custkey IS NOT NULL THEN 'pod-' || c_custkey END END AS ci,
  CASE WHEN event_type = 'view' AND w.s IS NOT NULL THEN 'workload' WHEN event_type = 'purchase' AND c_custkey IS NOT NULL THEN 'pod' END AS how
FROM alerts LEFT JOIN (SELECT name, min(sys_id) AS s FROM workloads GROUP BY 1) w ON 'wl-' || k = w.name LEFT JOIN customer ON user_id = c_custkey WHERE source = 'feed'"""))
def stamped(t):
    """Aliases set only where the alert lacks them, then the record by workload, cron job, job or pod."""
    rows = A.primary_entity(S.alerts(t).where("source = 'feed'"))
    given = lambda keys: X.first_match("description", X.stamp_patterns(keys, X.NAME_VALUE))
    workload = F.when(F.col("entity_type") == "CLOUD_APPLICATION", F.col("entity_name"))
    rows = A.stamped(
        rows,
        {"workload": given(X.WORKLOAD_KEYS), "pod": given(X.POD_KEYS), "cron": given(X.CRON_KEYS), "job": given(X.JOB_KEYS)},
        {"workload": F.coalesce(workload, F.lit("")), "pod": F.lit(""), "cron": F.lit(""), "job": F.lit("")},
    )
    by_class = lambda c: workloads(t).where(F.col("class") == c).select("name", "sys_id")
    steps = [
        A.Step("workload", F.col("workload"), workloads(t).select("name", "sys_id")),
        A.Step("cron job", F.col("cron"), by_class("cmdb_ci_kubernetes_cron_job")),
        A.Step("job", F.col("job"), by_class("cmdb_ci_kubernetes_job")),
        A.Step("pod", F.col("pod"), pods(t).select("name", "sys_id")),
    ]
    return A.cascade(rows, steps, "ci").select("alert_id", "workload", "pod", "ci", "how")


@query("ent09", sql("alerts", """
SELECT alert_id, CASE event_type WHEN 'purchase' THEN 'CPU_SATURATED' WHEN 'signup' THEN 'ERROR_EVENT' ELSE 'CRITICAL_LOG_EVENT' END AS type FROM alerts"""))
def renamed(t):
    pod = X.first_match("description", X.stamp_patterns(X.POD_KEYS, X.NAME_VALUE))
    kind = A.renamed_type(X.kind_stamp("description"), F.col("type"), X.service_stamp("description"), pod)
    return S.alerts(t).select("alert_id", kind.alias("type"))


@query("ent10", sql("entities workloads", """
SELECT alert_id, ci IS NOT NULL AS bound, kind, ci, CASE WHEN ci IS NOT NULL THEN 'bound' WHEN kind = 'k8s_pod_name' THEN 'no pod by name' WHEN kind = 'standalone_host' THEN 'no host for alert' WHEN kind = 'none' THEN 'no entity' ELSE 'no record' END AS note FROM (
  SELECT alert_id, CASE event_type WHEN 'purchase' THEN 'k8s_pod_name' WHEN 'signup' THEN 'host' ELSE 'standalone_host' END AS kind,
    CASE event_type WHEN 'purchase' THEN CASE WHEN c_custkey IS NOT NULL THEN 'pod-' || c_custkey END
      WHEN 'signup' THEN CASE WHEN c_nationkey < 12 THEN 'srv-' || c_custkey WHEN c_acctbal > 0 THEN 'cmp-' || c_custkey END END AS ci
  FROM entities LEFT JOIN customer ON user_id = c_custkey)"""))
def bound(t):
    """Record an alert is bound to: its pod; else the host of a stamped service; else the primary entity."""
    rows = X.once(
        S.alerts(t),
        pod=X.first_match("description", X.stamp_patterns(X.POD_KEYS, X.NAME_VALUE)),
        stamp=X.service_stamp("description"),
    )
    rows = A.primary_entity(rows)
    kind = (
        F.when(F.col("pod").isNotNull(), F.lit("k8s_pod_name"))
        .when(F.col("stamp").isNotNull(), F.lit("standalone_host"))
        .when(F.col("entity_type") == "HOST", F.lit("host"))
        .when(F.col("entity_type") == "CLOUD_APPLICATION", F.lit("cloud_application"))
        .when(F.col("entity_type") == "CLOUD_APPLICATION_INSTANCE", F.lit("cai"))
        .otherwise(F.lit("none"))
    )
    rows = rows.withColumn("kind", kind)
    only = lambda kinds, c: F.when(F.col("kind").isin(kinds) & F.col("entity_type").isin("HOST", "CLOUD_APPLICATION"), F.col(c))
    host = lambda c: F.when(F.col("entity_type") == "HOST", only(["host", "standalone_host"], c))
    steps = [
        A.Step("pod", F.when(F.col("kind") == "k8s_pod_name", F.col("pod")), pods(t).select("name", "sys_id")),
        A.Step("host link", host("entity_id"), host_links(t)),
        A.Step("host name", host("entity_name"), host_names(t)),
        A.Step("workload", only(["cloud_application"], "entity_name"), workloads(t).select("name", "sys_id")),
    ]
    out = A.cascade(rows, steps, "ci")
    note = (
        F.when(F.col("ci").isNotNull(), F.lit("bound"))
        .when(F.col("kind") == "k8s_pod_name", F.lit("no pod by name"))
        .when(F.col("kind") == "standalone_host", F.lit("no host for alert"))
        .when(F.col("kind") == "none", F.lit("no entity"))
        .otherwise(F.lit("no record"))
    )
    return out.select("alert_id", F.col("ci").isNotNull().alias("bound"), "kind", "ci", note.alias("note"))


# Incidents

cte("logged", """
SELECT *, 'Critical log event — ' || signature AS short_description, CASE WHEN source <> 'feed' THEN 'other source' WHEN incident IS NOT NULL THEN 'already linked' WHEN severity > 3 THEN 'severity'
  WHEN correlation_group = 'Secondary' THEN 'secondary member' WHEN service IS NULL THEN 'no service instance' END AS skipped FROM prioritised""", "prioritised")


def logged(t):
    rows = A.priorities(resolved(t)).withColumn("signature", X.signature_stamp("description"))
    return A.promoted(rows.withColumn("short_description", A.short_description("signature")))


def incident_alerts(t):
    rows = logged(t).where("skipped IS NULL")
    # Reading the stamps out of the text is the costly part; what follows reads its rows several times.
    return session.settle(rows.select("alert_id", "created_on", "service", "short_description", "impact", "urgency"))


KEY = ["service", "short_description"]


@query("inc01", sql("logged", """
SELECT alert_id, place, CASE WHEN place = 1 THEN 'create' ELSE 'correlate' END AS action, incident_of FROM (
  SELECT alert_id, row_number() OVER w AS place, first_value(alert_id) OVER w AS incident_of FROM logged WHERE skipped IS NULL WINDOW w AS (PARTITION BY service, short_description ORDER BY created_on, alert_id))"""))
def incidents(t):
    return A.correlate(incident_alerts(t), KEY, "created_on", "alert_id").select("alert_id", "place", "action", "incident_of")


@query("inc02", sql("logged", """
SELECT alert_id, place, greatest(1, min(lead) OVER w - place) AS incident_urgency, min(impact) OVER w AS incident_impact FROM (
  SELECT *, CASE WHEN place = 1 THEN urgency + 1 ELSE urgency - 1 + place END AS lead FROM (
    SELECT *, row_number() OVER (PARTITION BY service, short_description ORDER BY created_on, alert_id) AS place FROM logged WHERE skipped IS NULL))
WINDOW w AS (PARTITION BY service, short_description ORDER BY created_on, alert_id ROWS UNBOUNDED PRECEDING)"""))
def escalated(t):
    out = A.escalate(incident_alerts(t), KEY, "created_on", "alert_id")
    return out.select("alert_id", "place", "incident_urgency", "incident_impact")


@query("inc03", sql("logged", "SELECT alert_id, skipped FROM logged WHERE skipped IS NOT NULL"))
def skipped(t):
    return logged(t).where("skipped IS NOT NULL").select("alert_id", "skipped")


@query("inc04", sql("alerts", """
SELECT alert_id, (row_number() OVER (ORDER BY created_on, alert_id) - 1) // 75 AS batch FROM alerts WHERE source = 'feed' AND incident IS NULL AND event_type IN ('error', 'click', 'view') AND correlation_group <> 'Secondary'"""))
def pending(t):
    rows = S.alerts(t).where("source = 'feed' AND incident IS NULL AND correlation_group <> 'Secondary'")
    pending = rows.where(F.col("description").contains(A.CRITICAL)).select("alert_id", "created_on")
    return tables.batches(pending, ["created_on", "alert_id"], 75).select("alert_id", "batch")


@query("inc05", sql("resolved", """
SELECT user_id AS parent, (min({'n': n, 's': service, 'g': signature, 'a': alert_id})).s AS service, (min({'n': n, 's': service, 'g': signature, 'a': alert_id})).g AS signature, (min({'n': n, 's': service, 'g': signature, 'a': alert_id})).a AS member FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_on, alert_id) AS n FROM resolved) WHERE service IS NOT NULL GROUP BY 1"""))
def group_alerts(t):
    """Group alerts take over what their first resolvable member says; a user's alerts are a group."""
    members = resolved(t).select(
        F.col("user_id").alias("parent"), "created_on", "alert_id", "service", X.signature_stamp("description").alias("signature")
    )
    return A.inherited(members, "parent", "created_on", "alert_id", "service", "signature")


@query("inc06", sql("resolved", "SELECT count(*) AS n, count(service) AS bound, count(service)::DOUBLE / count(*)::DOUBLE AS share FROM resolved WHERE created_on >= TIMESTAMP '2024-01-25'"))
def binding_coverage(t):
    recent = resolved(t).where("created_on >= TIMESTAMP '2024-01-25 00:00:00'")
    return A.coverage(recent, F.col("service").isNotNull())
