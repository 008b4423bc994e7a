"""Log lines to tables: stitched records, application records, garbage-collection lines, log-derived events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opswell import session
from opswell.functions import text as X
from opswell.operators import segments

# Layouts of the lines. Fixed values.
RECORD_START = "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_TIME = "\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:?\\d{2}(?::?\\d{2}(?:[.,]\\d+)?)?(?:Z|[+-]\\d{2}:?\\d{2})?"
LEVEL = "(?i:alert|trace|debug|notice|info|warning|warn|error|err|critical|crit|fatal|severe|emergency|emerg)"
JAVA_CLASS = "(?:[A-Za-z$_][A-Za-z$_0-9]*\\.)*[A-Za-z$_][A-Za-z$_0-9]*"
APP_LINE = f"({ISO_TIME}) ({LEVEL})\\s*({JAVA_CLASS}):(\\d+) - ([^\\n]*)"
SHORT_LINE = "^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2} +(\\w+) +([^\\n]*?):(\\d+)"
GC_HEAD = f"\\[({ISO_TIME})\\]\\[([\\d.]+)s\\]\\[(\\w+)\\]\\[(.*?)\\] GC\\((\\d+)\\) Pause "
GC_HEAP = "(\\d+)M->(\\d+)M\\((\\d+)M\\) ([\\d.]+)ms"
GC_PAUSE_KIND = f"{GC_HEAD}([^(]*?) \\(.*?\\) \\((.*?)\\) {GC_HEAP}"
GC_PAUSE = f"{GC_HEAD}([^(]*?)() {GC_HEAP}"
GC_START_KIND = f"{GC_HEAD}([^(]*?) \\(.*?\\) \\((.*?)\\)"
GC_START = f"{GC_HEAD}([^(]*?) \\((.*?)\\)"
CHUNK_LINES = 500

# Level names by the type of event they stand for. Fixed values.
EVENT_TYPES = {
    "info": ["INFO"],
    "error": ["ERROR", "CRITICAL", "FATAL"],
    "warning": ["WARN", "WARNING"],
    "debug": ["DEBUG", "TRACE"],
}

# Component by the start of a pod name, then by a part of it; first hit wins. Fixed values.
COMPONENT_STARTS = [("spark-master", "master"), ("spark-worker", "worker"), ("spark-history", "history")]
COMPONENT_PARTS = [("driver", "driver"), ("executor", "executor")]

# Service instance by the start of a pod name. Fixed values.
SERVICE_STARTS = [
    ("spark-master", "Spark-Master"),
    ("spark-worker", "Spark-Worker"),
    ("spark-history", "Spark-History-Server"),
]

# Workload name by the start of a pod name, more specific first. Fixed values.
WORKLOAD_STARTS = [
    ("spark-worker-lab1", "spark-worker-lab1"),
    ("spark-worker-lab2", "spark-worker-lab2"),
    ("spark-master", "spark-master"),
    ("spark-history", "spark-history-server"),
]


def _by_start(c: Column, pairs: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    out = otherwise
    for start, value in reversed(pairs):
        out = F.when(c.startswith(start), F.lit(value)).otherwise(out)
    return out


def stitch(df: DataFrame, file: str, line_no: str, value: str, chunk_lines: int = CHUNK_LINES, **cut) -> DataFrame:
    """Records of several lines: a line that does not begin with a time belongs to the record before it.

    A row for each chunk of chunk_lines lines of a record: the number and text of
    the record's first line (record, head), the chunk's number from 0, its text, and
    the record's number of lines. A record of any length is whole in its chunks, and
    no task needs more than a chunk at a time. Lines before the first time of a file
    form a record of their own, with no number and no head.
    """
    begins = F.col(value).rlike(RECORD_START)
    marked = df.withColumns({"_start": F.when(begins, F.col(line_no)), "_head": F.when(begins, F.col(value))})
    known = segments.Ordered(marked, [file], [line_no], **cut).last_known(upto={"record": "_start", "head": "_head"}).settled()
    placed = segments.Ordered(known.df, [file, "record"], [line_no], **cut).row_numbers("_n", total="lines").df
    chunked = placed.withColumn("chunk", F.floor((F.col("_n") - 1) / chunk_lines).cast("long"))
    return chunked.groupBy(file, "record", "head", "lines", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]), "\n").alias("text")
    )


def application_records(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds the fields of application log records; a record in no known layout keeps its raw text as message."""
    out = X.once(df, _g=X.groups(value, APP_LINE, 5))
    g = F.col("_g")
    parts = F.split(F.col(value), "\n", 2)
    head, rest = parts[0], F.try_element_at(parts, F.lit(2))
    looks_like_trace = (F.length(rest) > 20) & (
        rest.contains("at ") | rest.contains("Exception") | rest.contains("Error") | rest.contains("Caused by")
    )
    level = F.upper(F.coalesce(g[1], F.lit("INFO")))
    kind = F.lit(None).cast("string")
    for name, levels in EVENT_TYPES.items():
        kind = F.when(level.isin(levels), F.lit(name)).otherwise(kind)
    return out.select(
        *df.columns,
        g[0].alias("log_timestamp"),
        F.upper(g[1]).alias("parsed_level"),
        level.alias("level"),
        g[2].alias("class"),
        g[3].try_cast("int").alias("line_number"),
        g[4].alias("log_message"),
        F.when(g.isNotNull(), F.concat(g[2], F.lit(":"), g[3], F.lit(" - "), head)).otherwise(head).alias("message"),
        F.when(looks_like_trace, X.html_escape(rest)).alias("stack_trace"),
        kind.alias("event_type"),
    )


def located(df: DataFrame, path: str = "path", root: str = "/mnt/spark") -> DataFrame:
    """Adds pod or driver instance, mode and component from the path of an application log."""
    client = X.extract(path, f"^{root}/client-logs/([^/]+)/[^/]+$")
    pod = X.extract(path, f"^{root}/logs/([^/]+)/[^/]+$")
    component = F.lit(None).cast("string")
    for part, name in reversed(COMPONENT_PARTS):
        component = F.when(F.col("pod_name").contains(part), F.lit(name)).otherwise(component)
    component = _by_start(F.col("pod_name"), COMPONENT_STARTS, component)
    out = df.withColumns({"driver_instance": client, "pod_name": pod})
    return out.withColumns(
        {
            "mode": F.when(F.col("driver_instance").isNotNull(), F.lit("Client")).when(
                F.col("pod_name").isNotNull(), F.lit("Cluster")
            ),
            "component": F.when(F.col("driver_instance").isNotNull(), F.lit("client")).otherwise(component),
        }
    )


def gc_located(df: DataFrame, path: str = "path", root: str = "/mnt/spark") -> DataFrame:
    """Adds pod, component and rotation number from the path of a garbage-collection log, rotated form first."""
    rotated = X.groups(path, f"^{root}/logs/([^/]+)/gc-([^/]*?)\\.log\\.([^/]+)$", 3)
    active = X.groups(path, f"^{root}/logs/([^/]+)/gc-([^/]*?)\\.log$", 2)
    out = X.once(df, _g=F.coalesce(rotated, active))
    return out.select(
        *df.columns,
        F.col("_g")[0].alias("pod_name"),
        F.col("_g")[1].alias("component"),
        F.get("_g", F.lit(2)).alias("rotate_id"),
    )


def gc_records(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds the fields of garbage-collection lines: pauses with heap sizes, and starts without them."""
    pause = F.coalesce(X.groups(value, GC_PAUSE_KIND, 11), X.groups(value, GC_PAUSE, 11))
    # A start has the same head; its kind follows in one or two brackets.
    two, one = X.groups(value, GC_START_KIND, 7), X.groups(value, GC_START, 7)
    out = X.once(df, _g=F.when(F.col(value).contains(") Pause "), F.coalesce(pause, two, one)))
    g = F.col("_g")
    paused, found = F.size(g) == 11, g.isNotNull()
    either = lambda i: X.present(F.get(g, F.lit(i)))
    number = lambda i, t: F.get(g, F.lit(i)).try_cast(t)
    return out.select(
        *df.columns,
        either(0).alias("gc_timestamp"),
        either(1).try_cast("double").alias("uptime"),
        either(3).alias("gc_tags"),
        either(4).try_cast("int").alias("cycle"),
        either(5).alias("type"),
        either(6).alias("kind"),
        number(7, "int").alias("before"),
        number(8, "int").alias("after"),
        number(9, "int").alias("heapsize"),
        number(10, "double").alias("millis"),
        (number(7, "int") - number(8, "int")).alias("reclaimed"),
        F.when(paused, F.lit("paused")).alias("stats"),
        F.when(found, F.lit("info")).alias("level"),
    )


def signatures(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds level, class, line and Class:Line of the short layout, and the impact and urgency of the level."""
    out = X.once(df, _g=X.groups(value, SHORT_LINE, 3))
    g = F.col("_g")
    severe = F.when(g[0] == "ERROR", 2).otherwise(3)
    return out.select(
        *df.columns,
        g[0].alias("log_level"),
        g[1].alias("log_class"),
        g[2].try_cast("int").alias("log_line"),
        F.concat(F.coalesce(g[1], F.lit("")), F.lit(":"), F.coalesce(g[2], F.lit(""))).alias("signature"),
        severe.alias("impact"),
        severe.alias("urgency"),
    )


def service_of_pod(pod: Column | str) -> Column:
    """Service instance of a pod by its name; empty for other pods."""
    return _by_start(X.col(pod), SERVICE_STARTS, F.lit(""))


def workload_of_pod(pod: Column | str, workload: Column | str, deployment: Column | str) -> Column:
    """Workload name: as given, else the deployment, else by the start of the pod name, else empty."""
    return F.coalesce(
        X.present(workload), X.present(deployment), _by_start(X.col(pod), WORKLOAD_STARTS, F.lit(""))
    )


def workload_kind(kind: Column | str) -> Column:
    return F.coalesce(X.present(kind), F.lit("deployment"))


def critical_events(df: DataFrame, environment: str, title: str) -> DataFrame:
    """Events for warnings and errors with a signature: name, description and the id that makes repeats one event.

    Expects log_level, log_class, log_line, signature, impact, urgency, pod_name and service_instance.
    """
    known = df.where(
        F.col("log_level").isin("WARN", "ERROR")
        & F.col("log_class").isNotNull()
        & F.col("log_line").isNotNull()
        & F.col("pod_name").isNotNull()
    )
    place = F.concat(F.col("log_class"), F.lit(":"), F.col("log_line").cast("string"))
    return known.select(
        "*",
        F.concat(F.lit("Critical "), F.col("log_level"), F.lit(" at "), place).alias("event_name"),
        F.concat(
            F.lit(f"{title} critical "), F.col("log_level"), F.lit(" at "), place, F.lit(" on "), F.col("pod_name"),
            F.lit(" sn-event_kind=CRITICAL_LOG_EVENT sn-log-signature="), F.col("signature"),
            F.lit(f" sn-environment={environment} sn-service_instance="), F.col("service_instance"),
            F.lit(" sn-impact="), F.col("impact"), F.lit(" sn-urgency="), F.col("urgency"),
        ).alias("event_description"),
        F.concat(
            F.lit(f"{environment}|"), F.col("service_instance"), F.lit(f"|{title} Critical "), F.col("log_level"),
            F.lit(" "), F.col("signature"),
        ).alias("unique_id"),
    )


def missing_pod_events(df: DataFrame, environment: str, source: str) -> DataFrame:
    """Events that make it visible that a warning or error came without its pod name."""
    gaps = df.where(F.col("log_level").isin("WARN", "ERROR") & F.col("pod_name").isNull())
    return gaps.select(
        "*",
        F.concat(F.lit("K8s log missing k8s.pod.name on "), F.col(source)).alias("event_name"),
        F.concat(F.lit(f"{environment}|enrichment-missing|"), F.col(source)).alias("unique_id"),
    )


def instance_id(host: Column | str, driver: Column | str) -> Column:
    unknown = F.lit("unknown")
    return F.concat(F.coalesce(X.present(host), unknown), F.lit(":"), F.coalesce(X.present(driver), unknown))
