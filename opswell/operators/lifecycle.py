"""Lifecycle events: normalising, matching starts with ends, open work, closure by the parent, active counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from opswell import session
from opswell.functions.numbers import whole_number
from opswell.functions.text import once
from opswell.operators import segments
from opswell.operators.tables import newest

REALM = "Spark"
SQL_PACKAGE = "org.apache.spark.sql.execution.ui."

# Events without a time of their own; they are dropped. Fixed values.
TIMELESS = [
    "SparkListenerBlockManagerAdded",
    "SparkListenerEnvironmentUpdate",
    "SparkListenerLogStart",
    "SparkListenerResourceProfileAdded",
    SQL_PACKAGE + "SparkListenerDriverAccumUpdates",
    SQL_PACKAGE + "SparkListenerSQLAdaptiveExecutionUpdate",
]


# Per kind of event: class, end point, class of the trace it belongs to, class of its parent. Fixed values.
FORMS = [
    ("SparkListenerApplicationStart", "App", "Start", "App", None),
    ("SparkListenerApplicationEnd", "App", "End", "App", None),
    ("SparkListenerExecutorAdded", "ExecutorAdded", "Point", "App", None),
    ("SparkListenerJobStart", "Job", "Start", "Job", "App"),
    ("SparkListenerJobEnd", "Job", "End", "Job", None),
    ("SparkListenerStageSubmitted", "Stage", "Start", "Stage", "App"),
    ("SparkListenerStageCompleted", "Stage", "End", "Stage", None),
    ("SparkListenerTaskStart", "Task", "Start", "Task", "Stage"),
    ("SparkListenerTaskEnd", "Task", "End", "Task", None),
    (SQL_PACKAGE + "SparkListenerSQLExecutionStart", "SQLQuery", "Start", "SQLQuery", "App"),
    (SQL_PACKAGE + "SparkListenerSQLExecutionEnd", "SQLQuery", "End", "SQLQuery", None),
]
UNKNOWN = "Indeterminable"

_accumulables = T.ArrayType(
    T.StructType([T.StructField("Name", T.StringType()), T.StructField("Value", T.StringType()), T.StructField("Update", T.StringType())])
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n.replace("_", " "), t) for n, t in fields.items()])


_long, _text = T.LongType(), T.StringType()
EVENT_SCHEMA = T.StructType(
    [
        *_struct(
            Event=_text, Timestamp=_long, App_Name=_text, App_ID=_text, Executor_ID=_text, Job_ID=_long,
            Submission_Time=_long, Completion_Time=_long, Stage_ID=_long, Stage_Attempt_ID=_long,
            executionId=_long, time=_long,
            Stage_Info=_struct(Stage_ID=_long, Stage_Attempt_ID=_long, Stage_Name=_text, Submission_Time=_long, Completion_Time=_long, Accumulables=_accumulables),
            Task_Info=_struct(Task_ID=_long, Attempt=_long, Launch_Time=_long, Finish_Time=_long, Accumulables=_accumulables),
        ).fields,
        T.StructField("Properties", T.MapType(_text, _text)),
    ]
)


def parse(raw: DataFrame, line: str = "line", kind: str | None = None) -> DataFrame:
    """JSON lines with the name of the event beside its fields under e; events without a time are dropped unparsed.

    kind: Start, End or Point, for the events of this kind only; the others are dropped unparsed, too.
    """
    # Each of the conditions below would extract the name again.
    named = once(raw, event=F.regexp_extract(line, '"Event"\\s*:\\s*"([^"]+)"', 1))
    known = named.where((F.col("event") != "") & ~F.col("event").isin(TIMELESS))
    if kind is not None:
        known = known.where(F.col("event").isin([event for event, _, k, _, _ in FORMS if k == kind]))
    return known.withColumn("e", F.from_json(line, EVENT_SCHEMA)).drop(line)


def _by_class(otherwise: Column | str | None = None, **values: Column) -> Column:
    out = F.lit(otherwise)
    for cls, value in values.items():
        out = F.when(F.col("class") == cls, value).otherwise(out)
    return out


def normalise(raw: DataFrame, kind: str | None = None) -> DataFrame:
    """Raw lines (host, file_path, ingest_ts, line) to one shape for all kinds of event, or for one kind only.

    An event file holds one application, so host and path stand for it in all
    keys; the attempt is part of the key of stages and tasks.
    """
    forms = raw.sparkSession.createDataFrame(FORMS, "event string, class string, event_kind string, _trace string, _parent string")
    # The table of forms is a fixed list of eleven rows.
    rows = parse(raw, kind=kind).join(F.broadcast(forms), "event", "left").fillna(
        UNKNOWN, ["class", "event_kind", "_trace"]
    )
    at = lambda path: F.col(f"e.{path}")
    part = lambda *paths: F.concat_ws(":", *[at(p).cast("string") for p in paths])
    stage = part("`Stage Info`.`Stage ID`", "`Stage Info`.`Stage Attempt ID`")
    task_stage = part("`Stage ID`", "`Stage Attempt ID`")
    started = F.col("event_kind") == "Start"
    either = lambda start, end: F.when(started, at(start)).otherwise(at(end))
    app = F.concat_ws(":", "host", "file_path")
    below_app = lambda c: F.concat_ws(":", app, c)
    text = lambda path: at(path).cast("string")
    rows = rows.select(
        "*",
        _by_class(
            UNKNOWN,
            App=app,
            ExecutorAdded=below_app(at("`Executor ID`")),
            Job=below_app(text("`Job ID`")),
            Stage=below_app(stage),
            Task=F.concat_ws(":", app, task_stage, part("`Task Info`.`Task ID`", "`Task Info`.`Attempt`")),
            SQLQuery=below_app(text("executionId")),
        ).alias("_key"),
        _by_class(
            0,
            App=at("Timestamp"),
            ExecutorAdded=at("Timestamp"),
            Job=either("`Submission Time`", "`Completion Time`"),
            Stage=either("`Stage Info`.`Submission Time`", "`Stage Info`.`Completion Time`"),
            Task=either("`Task Info`.`Launch Time`", "`Task Info`.`Finish Time`"),
            SQLQuery=at("time"),
        ).cast("long").alias("start_millis"),
        _by_class(
            UNKNOWN,
            App=F.when(started, at("`App ID`")).otherwise(F.lit("NO_APP_END_ID")),
            ExecutorAdded=at("`Executor ID`"),
            Job=text("`Job ID`"),
            Stage=text("`Stage Info`.`Stage ID`"),
            Task=text("`Task Info`.`Task ID`"),
            SQLQuery=text("executionId"),
        ).alias("service_id"),
        F.when(F.col("_parent") == "Stage", below_app(task_stage)).otherwise(app).alias("_parent_key"),
    )
    uid = lambda kind: F.concat_ws(":", kind, F.lit(REALM), "class", "_key")
    out = rows.select(
        F.timestamp_millis("start_millis").alias("ts"),
        F.lit(REALM).alias("realm"),
        "class",
        "event_kind",
        "event",
        _by_class(
            None,
            App=F.when(started, at("`App Name`")).otherwise(F.lit("NO_APP_END_NAME")),
            Stage=at("`Stage Info`.`Stage Name`"),
        ).alias("_name"),
        "service_id",
        F.coalesce(
            F.when(F.col("event") == FORMS[0][0], at("`App ID`")),
            F.try_element_at(at("Properties"), F.lit("spark.app.id")),
            F.lit("unknown"),
        ).alias("app_id"),
        F.lit(False).alias("matched"),
        F.col("ingest_ts").alias("log_timestamp"),
        "start_millis",
        F.when(F.col("class") == "ExecutorAdded", app).otherwise(F.col("_key")).alias("_trace_key"),
        "_trace",
        uid(F.col("event_kind")).alias("event_uid"),
        F.when(F.col("event_kind") == "End", uid(F.lit("Start"))).alias("start_event_uid"),
        F.when(F.col("_parent").isNotNull(), F.concat_ws(":", F.lit(REALM), "_parent", "_parent_key")).alias("trace_parent_uid"),
        numeric_accumulables(F.coalesce(at("`Task Info`.Accumulables"), at("`Stage Info`.Accumulables"))).alias("accumulables"),
    )
    out = out.withColumns(
        {
            "service_name": F.coalesce("_name", "service_id"),
            "trace_uid": F.concat_ws(":", F.lit(REALM), "_trace", "_trace_key"),
            "routing_uid": F.coalesce("start_event_uid", "event_uid"),
        }
    )
    return with_ids(out.drop("_name", "_trace", "_trace_key"))


def numeric_accumulables(c: Column) -> Column:
    """Values and updates of the accumulables as numbers; text that is no number becomes null."""
    return F.transform(
        c,
        lambda x: F.struct(
            x["Name"].alias("Name"), whole_number(x["Value"]).alias("Value"), whole_number(x["Update"]).alias("Update")
        ),
    )


def with_ids(df: DataFrame) -> DataFrame:
    """Fixed-length ids of the uids, so that a second delivery of an event gets the same id."""
    return df.withColumns(
        {
            "event_id": F.sha1("event_uid"),
            "routing_id": F.sha1("routing_uid"),
            "start_event_id": F.sha1("start_event_uid"),
            "trace_id": F.sha1("trace_uid"),
            "trace_parent_id": F.sha1("trace_parent_uid"),
        }
    )


def known(events: DataFrame) -> DataFrame:
    """Events of a kind that the table of forms has. The others have no key of their own and take no part in what follows."""
    return events.where(F.col("event_kind") != UNKNOWN) if "event_kind" in events.columns else events


def unknown(events: DataFrame) -> DataFrame:
    """How many events of each name the table of forms does not have, every delivery counted."""
    return events.where(F.col("event_kind") == UNKNOWN).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def deliver_once(df: DataFrame, key: str = "event_id") -> DataFrame:
    return known(df).dropDuplicates([key])


def _packed(c: str) -> Column:
    """An id as the 20 bytes that its 40 hexadecimal digits stand for; any other text behind 21 zero bytes, so that no two are equal."""
    plain = F.concat(F.lit(bytes(21)), F.col(c).cast("binary"))
    return F.when(F.col(c).rlike("^[0-9a-f]{40}$"), F.unhex(c)).otherwise(plain)


def _unpacked(c: Column) -> Column:
    return F.when(F.length(c) == 20, F.lower(F.hex(c))).otherwise(F.substring(c, 22, 2**31 - 1).cast("string"))


PAIR = ["start_time", "end_time", "realm", "class", "service_name", "trace_id", "parent_id", "start_ms", "end_ms", "duration_ms", "start_event_id", "end_event_id"]


def match(events: DataFrame, on: str = "id", columns: Sequence[str] = PAIR) -> DataFrame:
    """Every end with the start it names as one interval row, with its duration.

    A start and its end have the same routing key: the start's id (on="id") or
    uid (on="uid"). So both meet by grouping on that key, in one pass and one
    shuffle; a group holds one pair and its repeated deliveries. The shuffle takes
    only what the columns asked for are made of, ids as bytes.
    """
    key = {"id": _packed("routing_id"), "uid": F.col("routing_uid")}[on]
    ids = ["trace_id", "trace_parent_id", "event_id"]
    starts = {"start_ms": "start_millis", "start_time": "ts", "service_name": "service_name", "trace_id": "trace_id", "parent_id": "trace_parent_id", "start_event_id": "event_id"}
    ends = {"end_ms": "start_millis", "end_time": "ts", "realm": "realm", "class": "class", "end_event_id": "event_id"}

    def side(kind, made_of):
        # The time always comes first: of several deliveries the one with the latest counts.
        fields = [c for name, c in made_of.items() if c == "start_millis" or name in columns]
        return F.max(F.when(F.col("event_kind") == kind, F.struct(*[_packed(c).alias(c) if c in ids else F.col(c) for c in fields])))

    pairs = events.groupBy(key.alias("_key")).agg(side("Start", starts).alias("s"), side("End", ends).alias("e")).where("s IS NOT NULL AND e IS NOT NULL")
    found = {"duration_ms": F.col("e.start_millis") - F.col("s.start_millis")}
    for at, made_of in (("s", starts), ("e", ends)):
        for name, c in made_of.items():
            found[name] = _unpacked(F.col(f"{at}.{c}")) if c in ids else F.col(f"{at}.{c}")
    return pairs.select(*[found[name].alias(name) for name in PAIR if name in columns])


def flag_matched(events: DataFrame) -> DataFrame:
    """Known events, of which both sides of a pair get matched = true. A group is one pair, so its window is small."""
    events = known(events)
    pair = Window.partitionBy("routing_id")
    has = lambda kind: F.max(F.col("event_kind") == kind).over(pair)
    return events.withColumn("matched", has("Start") & has("End"))


def keep_unmatched(flagged: DataFrame) -> DataFrame:
    """What stays after matched and point events are cleared away."""
    return flagged.where(~(F.col("matched") | (F.col("event_kind") == "Point")))


def open_starts(events: DataFrame) -> DataFrame:
    """Starts that no end names."""
    return flag_matched(events).where((F.col("event_kind") == "Start") & ~F.col("matched"))


def open_at(ops: DataFrame, at_ms: Column, within_ms: int | None = None) -> DataFrame:
    """Operations that have started and not ended at an instant, optionally started no longer ago than within_ms."""
    started = F.col("start_ms") <= at_ms
    if within_ms is not None:
        started = started & (F.col("start_ms") >= at_ms - F.lit(within_ms))
    return ops.where(started & (F.col("end_ms").isNull() | (F.col("end_ms") > at_ms)))


def close(ops: DataFrame, keys: dict[str, str], ancestors: dict[str, Sequence[str]]) -> DataFrame:
    """How each operation was closed: by its own end, else by the earliest end of an ancestor from its start on.

    ops has kind, the keys of all ancestors, start_ms and end_ms. keys maps a
    kind to the column with its key, ancestors a kind to the kinds above it.
    Keys are compared as whole values, never by prefix. Open operations meet the
    ends of one kind of ancestor after the other, all kinds below it at once. Those
    that are not below it, or lack its key, match nothing and are spread by a hash.
    """
    ended = ops.where(F.col("end_ms").isNotNull())
    rows = ops.where(F.col("end_ms").isNull()).withColumn("_closed", F.lit(None).cast("long"))
    for up in dict.fromkeys(a for above in ancestors.values() for a in above):
        below = F.col("kind").isin([k for k, above in ancestors.items() if up in above]) & F.col(keys[up]).isNotNull()
        ends = ended.where(F.col("kind") == up).select(F.lit(True).alias("_below"), F.hash(keys[up]).alias("_hash"), F.col(keys[up]).alias("_up"), F.col("end_ms").alias("_up_end"))
        asked = rows.withColumns({"_asks": below, "_spread": F.when(below, F.hash(keys[up])).otherwise(F.hash("kind", "start_ms", *keys.values()))})
        same = (F.col("_asks") == F.col("_below")) & (F.col("_spread") == F.col("_hash")) & (F.col(keys[up]) == F.col("_up"))
        found = F.when(F.col("_up_end") >= F.col("start_ms"), F.col("_up_end"))
        rows = asked.join(ends, same, "left").withColumn("_closed", F.least("_closed", found)).select(*ops.columns, "_closed")
    by_parent = rows.withColumns({"closed_ms": F.col("_closed"), "closed_by": F.when(F.col("_closed").isNotNull(), F.lit("parent"))}).drop("_closed")
    by_end = ended.withColumns({"closed_ms": F.col("end_ms"), "closed_by": F.lit("end")})
    return by_end.unionByName(by_parent)


def active_counts(points: DataFrame, keys: Sequence[str], order: Sequence[str], change: str, **cut) -> DataFrame:
    """Open operations after each start (+1) or end (-1); an end that finds none open is ignored.

    The count is the plain running sum less its lowest value so far, if that is below 0.
    """
    rows = segments.Ordered(points, keys, order, **cut).running_sums({"_sum": change})
    rows = rows.settled().running_least({"_low": "_sum"})
    active = F.col("_sum") - F.least(F.lit(0), F.col("_low"))
    return rows.df.select(*points.columns, active.cast("long").alias("active"))


def open_on_grid(points: DataFrame, keys: Sequence[str], at_ms: str, change: str, grid_ms: int, **cut) -> DataFrame:
    """Operations open at the end of each grid cell in which something happened."""
    cell = F.floor(F.col(at_ms) / grid_ms) * F.lit(grid_ms).cast("long")
    per_cell = points.groupBy(*keys, cell.alias("cell")).agg(F.sum(change).alias("_change"))
    return segments.Ordered(session.settle(per_cell), keys, ["cell"], **cut).running_sums({"open": "_change"}).df.drop("_change")


def durations(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Nanoseconds from start to end for every end; null, and counted as an anomaly, where the start is missing."""
    begun = starts.select(F.col(key).alias("_key"), F.col("ms").alias("start_ms"))
    out = ends.join(begun, F.col(key) == F.col("_key"), "left").drop("_key")
    return out.withColumns(
        {
            "duration_ns": (F.col("ms") - F.col("start_ms")) * F.lit(1_000_000),
            "start_missing": F.col("start_ms").isNull(),
        }
    )


def outcome(failure: Column) -> Column:
    return F.when(failure, F.lit("FAILED")).otherwise(F.lit("SUCCESS"))


def last_state(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """State per key after all its changes; a change whose start never came is left out by the caller's join."""
    return newest(changes, [key], order)
