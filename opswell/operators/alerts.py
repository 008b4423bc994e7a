"""Threshold alerts, entity resolution, and alerts becoming incidents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from opswell.functions import numbers as N, text as X
from opswell.operators import segments

# Saturation rules: area, rule, threshold, minutes that must violate, minutes looked at. Fixed values.
SATURATION = [
    ("workload", "pendingPods", 1.0, 5, 5),
    ("workload", "highMemoryUsage", 50.0, 3, 3),
    ("workload", "highCpuUsage", 40.0, 3, 3),
    ("workload", "highCpuThrottling", 40.0, 3, 3),
    ("node", "cpuRequestsSaturation", 40.0, 2, 2),
    ("node", "memoryRequestsSaturation", 50.0, 2, 2),
    ("node", "podsSaturation", 50.0, 2, 2),
    ("namespace", "cpuRequestsQuotaSaturation", 40.0, 3, 3),
    ("namespace", "cpuLimitsQuotaSaturation", 40.0, 3, 3),
    ("namespace", "memoryRequestsQuotaSaturation", 50.0, 3, 3),
    ("namespace", "memoryLimitsQuotaSaturation", 50.0, 3, 3),
    ("namespace", "podsQuotaSaturation", 50.0, 3, 3),
    ("cluster", "cpuRequestsSaturation", 40.0, 3, 3),
    ("cluster", "memoryRequestsSaturation", 50.0, 3, 3),
    ("cluster", "podsSaturation", 60.0, 2, 2),
    ("pvc", "lowDiskSpaceCritical", 100.0, 2, 2),
    ("pvc", "lowDiskSpaceCriticalPercentage", 40.0, 2, 2),
]
SATURATION_SCHEMA = "area string, rule string, threshold double, sample_minutes int, observation_minutes int"

# Count rules: area, rule, least number of events, minutes they are counted in. Fixed values.
COUNTS = [
    ("workload", "containerRestarts", 1, 2),
    ("workload", "oomKills", 1, 1),
    ("workload", "jobFailureEvents", 1, 1),
    ("workload", "podBackoffEvents", 1, 1),
    ("workload", "podEvictionEvents", 1, 1),
    ("workload", "podPreemptionEvents", 1, 1),
]

# Severity levels that are passed on, with their delay in minutes. Fixed values.
PROFILE = [("AVAILABILITY", 0), ("ERRORS", 0), ("PERFORMANCE", 0), ("RESOURCE_CONTENTION", 0), ("CUSTOM_ALERT", 0)]

# Problem severity to (impact, urgency), and alert severity to the same where the problem names none. Fixed values.
BY_PROBLEM = {
    "AVAILABILITY": (1, 2),
    "ERROR": (2, 2),
    "RESOURCE_CONTENTION": (2, 2),
    "PERFORMANCE": (2, 3),
    "CUSTOM_ALERT": (3, 3),
}
BY_ALERT = {1: (1, 1), 2: (2, 2), 3: (2, 3)}
OTHERWISE = (3, 3)

CRITICAL = "CRITICAL_LOG_EVENT"
CPU = "CPU_EVENT"

# Classes of workload records in the order they are tried, with the kinds that name them. Fixed values.
WORKLOAD_CLASSES = {
    "cmdb_ci_kubernetes_deployment": ["deployment", "deployments"],
    "cmdb_ci_kubernetes_statefulset": ["statefulset", "statefulsets"],
    "cmdb_ci_kubernetes_daemon_set": ["daemonset", "daemonsets"],
    "cmdb_ci_kubernetes_cron_job": ["cronjob", "cronjobs"],
    "cmdb_ci_kubernetes_job": ["job", "jobs"],
}


# Thresholds

def saturation(samples: DataFrame, unit_seconds: int = 60, rules: Sequence[tuple] = SATURATION) -> DataFrame:
    """Minutes in which a rule holds: enough of the minutes looked at have a value above the threshold.

    samples: area, rule, entity, ts, value. A violating minute is counted once
    into each of the few windows it belongs to, so no rows need to be ordered.
    """
    table = F.broadcast(samples.sparkSession.createDataFrame(rules, SATURATION_SCHEMA))
    minute = F.floor(F.unix_seconds("ts") / unit_seconds)
    violating = (
        samples.join(table, ["area", "rule"])
        .where(F.col("value") > F.col("threshold"))
        .select("area", "rule", "entity", minute.alias("minute"), "sample_minutes", "observation_minutes")
        .distinct()
    )
    ends = F.explode(F.sequence(F.col("minute"), F.col("minute") + F.col("observation_minutes") - 1))
    return (
        violating.select("area", "rule", "entity", "sample_minutes", ends.alias("minute"))
        .groupBy("area", "rule", "entity", "minute", "sample_minutes")
        .agg(F.count(F.lit(1)).alias("violating"))
        .where("violating >= sample_minutes")
        .drop("sample_minutes")
    )


def count_events(events: DataFrame, unit_seconds: int = 60, rules: Sequence[tuple] = COUNTS) -> DataFrame:
    """Windows with at least as many events as their rule wants; events: area, rule, entity, ts."""
    table = F.broadcast(events.sparkSession.createDataFrame(rules, "area string, rule string, least long, minutes long"))
    width = F.col("minutes") * unit_seconds
    start = F.floor(F.unix_seconds("ts") / width) * width
    return (
        events.join(table, ["area", "rule"])
        .groupBy("area", "rule", "entity", start.alias("window_start"), "least")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= least")
        .drop("least")
    )


def profiled(alerts: DataFrame, level: str, created: str, profile: Sequence[tuple[str, int]] = PROFILE) -> DataFrame:
    """Alerts of the levels in the profile, with the instant they are due."""
    table = F.broadcast(alerts.sparkSession.createDataFrame(profile, "_level string, _delay int"))
    due = F.timestamp_seconds(F.unix_seconds(created) + F.col("_delay") * 60)
    return alerts.join(table, F.col(level) == F.col("_level")).withColumn("due_on", due).drop("_level", "_delay")


# Entities

_part = "STRUCT<type: STRING, entity: STRING, entityId: STRING, name: STRING, entityName: STRING>"
INFO = f"ImpactedEntity {_part}, ImpactedEntities ARRAY<{_part}>"
INFO_LOWER = f"impactedEntities ARRAY<{_part}>"  # the other spelling of the list
ENTITY_PATTERNS = ["CUSTOM_DEVICE", "CLOUD_APPLICATION_INSTANCE", "CLOUD_APPLICATION", "HOST"]


def _entity(kind: Column, entity_id: Column, name: Column) -> Column:
    found = F.struct(
        X.entity_type(kind, entity_id).alias("type"), entity_id.alias("id"), F.coalesce(name, F.lit("")).alias("name")
    )
    return F.when(X.present(entity_id).isNotNull(), found)


def _listed(x: Column) -> Column:
    return _entity(
        x["type"],
        F.coalesce(X.present(x["entity"]), X.present(x["entityId"])),
        F.coalesce(X.present(x["name"]), X.present(x["entityName"])),
    )


def primary_entity(alerts: DataFrame) -> DataFrame:
    """Adds entity_type, entity_id and entity_name of what an alert is about.

    In order: the one impacted entity; of several the first workload, else the
    first; the resource when it is a known type; else an id found in the text.
    """
    out = alerts.withColumns(
        {
            "_i": F.from_json("additional_info", INFO),
            "_l": F.when(F.col("additional_info").contains('"impactedEntities"'), F.from_json("additional_info", INFO_LOWER)),
        }
    )
    one = F.col("_i.ImpactedEntity")
    lists = F.coalesce(F.col("_i.ImpactedEntities"), F.col("_l.impactedEntities"))
    known = F.filter(F.transform(lists, _listed), lambda e: e.isNotNull())
    workload = F.get(F.filter(known, lambda e: e["type"] == "CLOUD_APPLICATION"), F.lit(0))
    none = F.lit(None).cast("string")
    resource = _entity(F.lit(""), F.col("resource"), F.col("node"))
    resource = F.when(resource["type"].isin(X.ENTITY_TYPES), resource)
    blob = F.concat_ws(" ", F.coalesce("resource", F.lit("")), "node", "description")
    by_text = [
        _entity(F.lit(kind), X.extract(blob, f"\\b({kind}-[A-F0-9]+)\\b"), F.col("node")) for kind in ENTITY_PATTERNS
    ]
    entity = F.coalesce(
        _entity(one["type"], F.coalesce(X.present(one["entity"]), X.present(one["entityId"])), one["name"]),
        workload,
        F.get(known, F.lit(0)),
        resource,
        *by_text,
    )
    out = X.once(out, _e=entity)
    return out.select(
        *alerts.columns,
        F.coalesce(F.col("_e.type"), none).alias("entity_type"),
        F.col("_e.id").alias("entity_id"),
        F.col("_e.name").alias("entity_name"),
    )


@dataclass(frozen=True)
class Step:
    """One way to find a record: look the key up in a table of (key, sys_id)."""

    how: str
    key: Column
    table: DataFrame


def cascade(df: DataFrame, steps: Sequence[Step], result: str = "sys_id", how: str = "how") -> DataFrame:
    """Adds the record of the first step that finds one, and how it was found; rows without one stay.

    A table with several records for a key gives the one with the least sys_id.
    Rows without a key are given one of many values that nothing matches, by the
    hash of their first column, so that they do not all meet in one task.
    """
    out, found, said = df, [], []
    nobody = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(df.columns[0]), F.lit(997)).cast("string"))
    out = out.select("*", *[F.coalesce(step.key, nobody).alias(f"_q{i}") for i, step in enumerate(steps)])
    for i, step in enumerate(steps):
        table = step.table.toDF(f"_k{i}", f"_s{i}").where(F.col(f"_k{i}").isNotNull())
        table = table.groupBy(f"_k{i}").agg(F.min(f"_s{i}").alias(f"_s{i}"))
        out = out.join(table, F.col(f"_q{i}") == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_s{i}"))
        said.append(F.when(F.col(f"_s{i}").isNotNull(), F.lit(step.how)))
    return out.select(*df.columns, F.coalesce(*found).alias(result), F.coalesce(*said).alias(how))


def by_members(found: DataFrame, row: str, parent: str, is_group: str, order: str, result: str = "sys_id", how: str = "how") -> DataFrame:
    """A group that no step has found a record for gets the record of its first member that has one; `via` is that member.

    found: a cascade's rows with the row each belongs to. The member's record comes
    from the same steps, so it is looked up in their results; one aggregate with a
    partial step brings the members of a group together.
    """
    first = F.min_by(F.struct(F.col(result).alias("record"), F.col(row).alias("member")), F.struct(order, row)).alias("_first")
    members = found.where(F.col(parent).isNotNull() & F.col(result).isNotNull()).groupBy(F.col(parent).alias("_group")).agg(first)
    asks = F.col(is_group) & F.col(result).isNull()
    joined = found.join(members, (F.col(row) == F.col("_group")) & asks, "left")
    given = F.col("_first").isNotNull()
    return joined.select(
        *[c for c in found.columns if c not in (result, how)],
        F.coalesce(result, F.col("_first.record")).alias(result),
        F.when(given, F.lit("group member")).otherwise(F.col(how)).alias(how),
        F.col("_first.member").alias("via"),
    )


def service_steps(stamp: Column, services: DataFrame) -> list[Step]:
    """A service by its stamp: name, name with blanks for dashes, name in label characters, identifier."""
    by_name = services.select("name", "sys_id")
    return [
        Step("name", stamp, by_name),
        Step("name with blanks", F.replace(stamp, F.lit("-"), F.lit(" ")), by_name),
        Step("label of name", stamp, services.select(X.label("name").alias("label"), "sys_id")),
        Step("identifier", stamp, services.select("identifier", "sys_id")),
    ]


def workload_by_kind(df: DataFrame, name: str, kind: str, workloads: DataFrame) -> DataFrame:
    """Workload record by name: the class of the given kind first, then the classes in their order.

    workloads: name, class, sys_id. Records are first brought to one row per name.
    """
    per_name = workloads.groupBy(F.col("name").alias("_name")).agg(
        *[F.min(F.when(F.col("class") == c, F.col("sys_id"))).alias(f"_{c}") for c in WORKLOAD_CLASSES]
    )
    ordered = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_{c}").alias("sys_id")) for c in WORKLOAD_CLASSES])
    wanted = F.lit(None).cast("string")
    for cls, kinds in WORKLOAD_CLASSES.items():
        wanted = F.when(F.lower(kind).isin(kinds), F.lit(cls)).otherwise(wanted)
    out = df.join(per_name, F.col(name) == F.col("_name"), "left")
    there = F.filter(ordered, lambda x: x["sys_id"].isNotNull())
    preferred = F.get(F.filter(there, lambda x: x["class"] == wanted), F.lit(0))
    pick = F.coalesce(preferred, F.get(there, F.lit(0)))
    return out.select(*df.columns, pick["class"].alias("workload_class"), pick["sys_id"].alias("workload_id"))


def priorities(alerts: DataFrame) -> DataFrame:
    """Adds impact and urgency: as stamped in the text, else by problem severity, else by alert severity."""
    text = F.col("description")
    severity = F.upper(X.first_match(text, ["(?i)[\"']ProblemSeverity[\"']\\s*:\\s*[\"']([^\"']+)[\"']", "(?i)ProblemSeverity\\s*[=:]\\s*([A-Z_]+)"]))
    kind = X.kind_stamp(text)

    def choice(at: int) -> Column:
        by_alert = F.lit(OTHERWISE[at])
        for level, pair in BY_ALERT.items():
            by_alert = F.when(F.col("severity") == level, pair[at]).otherwise(by_alert)
        out = F.when(kind == CPU, 2).otherwise(by_alert)
        for name, pair in BY_PROBLEM.items():
            out = F.when(severity == name, pair[at]).otherwise(out)
        return out

    return alerts.withColumns(
        {
            "impact": F.coalesce(X.choice_stamp(text, "sn-impact"), choice(0)),
            "urgency": F.coalesce(X.choice_stamp(text, "sn-urgency"), choice(1)),
        }
    )


def renamed_type(kind: Column, current: Column, service: Column, pod: Column) -> Column:
    """Type by the kind in the text; a saturated CPU keeps its type; a plain error with service or pod is a critical log."""
    return (
        F.when(current == "CPU_SATURATED", current)
        .when(kind == CRITICAL, F.lit(CRITICAL))
        .when(kind == CPU, F.lit(CPU))
        .when((current == "ERROR_EVENT") & (service.isNotNull() | pod.isNotNull()), F.lit(CRITICAL))
        .otherwise(current)
    )


def stamped(alerts: DataFrame, given: dict[str, Column], found: dict[str, Column]) -> DataFrame:
    """Properties that the alert does not carry yet are set to what was found; what it carries stays."""
    return alerts.select("*", *[F.coalesce(X.present(given.get(n, F.lit(None).cast("string"))), X.present(c)).alias(n) for n, c in found.items()])


# Incidents

def promoted(alerts: DataFrame) -> DataFrame:
    """Adds the reason an alert is not made an incident, null when it is."""
    reason = (
        F.when(F.col("source") != "feed", F.lit("other source"))
        .when(F.col("incident").isNotNull(), F.lit("already linked"))
        .when(F.col("severity") > 3, F.lit("severity"))
        .when(F.col("correlation_group") == "Secondary", F.lit("secondary member"))
        .when(F.col("service").isNull(), F.lit("no service instance"))
    )
    return alerts.withColumn("skipped", reason)


def short_description(signature: Column | str) -> Column:
    return F.when(X.present(signature).isNotNull(), F.concat(F.lit("Critical log event — "), X.col(signature))).otherwise(
        F.lit("Critical log event")
    )


def correlate(alerts: DataFrame, keys: Sequence[str], created: str, tie: str, **cut) -> DataFrame:
    """The first alert of a key creates the incident, later ones join it: place, action and incident of every alert."""
    out = segments.Ordered(alerts, keys, [created, tie], **cut).row_numbers("place").df
    first = alerts.groupBy(*keys).agg(F.min_by(tie, F.struct(created, tie)).alias("incident_of"))
    out = segments.attach(out, first, keys)
    return out.withColumn("action", F.when(F.col("place") == 1, F.lit("create")).otherwise(F.lit("correlate")))


def escalate(alerts: DataFrame, keys: Sequence[str], created: str, tie: str, **cut) -> DataFrame:
    """Impact and urgency of the incident after each of its alerts.

    A repeat makes the urgency one step more severe than the more severe of the
    incident's and the alert's own; impact never becomes less severe. Written out
    over n alerts, the urgency is the least of (first + 1) and (k-th - 1 + k) for
    2 <= k <= n, less n, and never below 1.
    """
    rows = segments.Ordered(alerts, keys, [created, tie], **cut).row_numbers("place")
    lead = F.when(F.col("place") == 1, F.col("urgency") + 1).otherwise(F.col("urgency") - 1 + F.col("place"))
    rows = rows.plus(_lead=lead.cast("long")).settled()
    return rows.running_least({"_least": "_lead", "incident_impact": "impact"}).df.select(
        *alerts.columns,
        "place",
        F.greatest(F.lit(1).cast("long"), F.col("_least") - F.col("place")).alias("incident_urgency"),
        "incident_impact",
    )


def inherited(members: DataFrame, group: str, created: str, tie: str, service: str, signature: str) -> DataFrame:
    """Service and signature of the oldest resolvable member of every group alert."""
    first = F.min_by(F.struct(service, signature, F.col(tie).alias("member")), F.struct(created, tie))
    return members.where(F.col(service).isNotNull()).groupBy(group).agg(first.alias("_m")).select(group, "_m.*")


def coverage(df: DataFrame, bound: Column) -> DataFrame:
    """Rows, rows bound to a record, and their share."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bound).alias("bound")).withColumn("share", N.ratio("bound", "n"))
