"""Operational tables that Spark derives from the given ones.

The operators work on event logs, counters, log lines, inventories and alerts.
Each function below reads given tables whole and shapes them into one of these,
so every query's work grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opswell.functions.numbers import cents
from opswell.functions.text import first_word
from opswell.session import settle, spread
from opswell.sources.tables import Tables

HOUR = 3_600_000
MINUTE = 60_000
DAY = 24 * HOUR


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def words(t: Tables) -> DataFrame:
    """Every word of every document, in lower case."""
    docs = spread(t.documents.select("doc_id", "source", "lang", "text"))
    split = docs.select("doc_id", "source", "lang", F.explode(F.split("text", "[ \\n]")).alias("word"))
    return split.withColumn("word", first_word("word")).where("word <> ''")


def lines(t: Tables) -> DataFrame:
    """Every line of every document with its place."""
    return spread(t.documents.select("doc_id", "source", "text")).select("doc_id", "source", F.posexplode(F.split("text", "\\n")).alias("pos", "value"))


def programme_logs(t: Tables) -> DataFrame:
    """Line items as a log of programmes: service, padded class code, category, date, duration text."""
    s = F.floor("l_extendedprice")
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("service"),
        F.col("l_linestatus").alias("category"),
        F.rpad("l_returnflag", 3, " ").alias("program"),
        F.col("l_shipdate").cast("date").alias("log_date"),
        F.col("l_linenumber").alias("sequence_no"),
        F.format_string(
            "%02d:%02d:%02d.0000000",
            F.call_function("div", s, F.lit(3600)),
            F.call_function("div", s, F.lit(60)) % 60,
            s % 60,
        ).alias("duration"),
        F.when(F.col("l_tax") > 0, F.col("l_suppkey")).alias("producer1"),
        F.when(F.col("l_discount") > 0, F.col("l_linenumber")).alias("producer2"),
    )


def weather(t: Tables) -> DataFrame:
    """One reading per station and day: temp in whole hundredths, count_temp readings behind it."""
    day = F.col("ts").cast("date")
    daily = (
        t.events.select(F.col("user_id").alias("stn"), day.alias("date"), cents("value").alias("c"))
        .groupBy("stn", "date")
        .agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("count_temp"))
    )
    return daily.select(
        "stn",
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("mo"),
        F.dayofmonth("date").alias("da"),
        F.call_function("div", F.col("s"), F.col("count_temp")).alias("temp"),
        "count_temp",
    )


def readings(t: Tables) -> DataFrame:
    """The daily readings written once, for queries that pass over them several times.

    They are far fewer than the events, which so are read a single time.
    """
    return settle(weather(t))


def drives(t: Tables) -> DataFrame:
    """Line items with their part as daily drive statistics, dates written in two formats."""
    day = F.col("l_shipdate").cast("date")
    gib = 1 << 30
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.when((F.col("l_linestatus") == "F") & (F.year(day) >= 2000), F.date_format(day, "M/d/yy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
        .alias("date"),
        F.concat(F.lit("S"), F.col("l_partkey")).alias("serial_number"),
        F.col("p_brand").alias("model"),
        F.when(F.col("l_quantity") == 1, F.lit(-1).cast("long"))
        .otherwise(F.col("p_size").cast("long") * gib)
        .alias("capacity_bytes"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("failure"),
        F.when(F.col("l_tax") > 0, F.format_string("%d", F.round(F.col("l_tax") * 100).cast("int"))).alias("smart_1_raw"),
        F.when(F.col("l_discount") > 0, F.lit("n/a")).otherwise(F.lit("7")).alias("smart_9_raw"),
    )


def shows(t: Tables) -> DataFrame:
    """Conversations as nested documents, folded in chunks of 1,000 turns so that no row grows without bound."""
    chunk = F.call_function("div", F.col("turn"), F.lit(1000))
    turn = F.struct("turn", "role", "text")
    return (
        t.conversations.groupBy("conv_id", chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            F.col("conv_id").alias("id"),
            "chunk",
            F.struct(F.col("turns").alias("episodes")).alias("_embedded"),
            F.array_distinct(F.transform("turns", lambda x: x["role"])).alias("genres"),
        )
    )


def applications(t: Tables) -> DataFrame:
    """Customers with orders as applications; those of one market segment never end."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("o_custkey", "c_name", "c_nationkey", "c_mktsegment")
        .agg(F.min(millis("o_orderdate")).alias("start_ms"), F.max(millis("o_orderdate")).alias("last_ms"))
        .select(
            F.col("o_custkey").alias("app"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("nation"),
            "start_ms",
            F.when(F.col("c_mktsegment") != "MACHINERY", F.col("last_ms") + 10 * DAY).alias("end_ms"),
        )
    )


def jobs(t: Tables) -> DataFrame:
    """Orders as jobs; those with status O are still open, those with P have failed."""
    start = millis("o_orderdate")
    return t.orders.select(
        F.col("o_custkey").alias("app"),
        F.col("o_orderkey").alias("job"),
        start.alias("start_ms"),
        F.when(F.col("o_orderstatus") != "O", start + DAY).alias("end_ms"),
        F.col("o_orderstatus").alias("status"),
    )


def order_lines(t: Tables) -> DataFrame:
    """Line items dealt by their order: groups below the order and the join to it then move them no second time.

    `_line` is cents, whole quantity, number and status of a usual line as one number;
    other lines have them as they are in `_odd`. `line` reads both. As no part of
    them can be left out, all who ask for lines without `l_returnflag` move the same
    columns, and Spark moves these once.
    """
    usual = F.col("l_linenumber").between(0, 255) & (F.col("l_quantity") >= 0) & (F.col("l_quantity") < 1000) & (F.col("l_extendedprice") >= 0) & (F.col("l_extendedprice") < 1e10)
    place = F.when(F.col("l_linestatus") == "F", 2).when(F.col("l_linestatus") < "F", 1).when(F.col("l_linestatus") > "F", 3).otherwise(0)
    packed = ((cents("l_extendedprice") * 1024 + F.floor("l_quantity")) * 256 + F.col("l_linenumber")) * 4 + place
    rows = t.lineitem.where("l_orderkey IS NOT NULL").select(
        "l_orderkey",
        "l_partkey",
        "l_returnflag",
        F.when(usual, packed).alias("_line"),
        F.when(~F.coalesce(usual, F.lit(False)), F.array(F.col("l_linenumber").cast("double"), "l_quantity", "l_extendedprice", place.cast("double"))).alias("_odd"),
    )
    # Four partitions for each split of the files, so that a task's groups stay as many when the input grows.
    parts = 4 * rows.rdd.getNumPartitions()
    few = parts <= int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition("l_orderkey") if few else rows.repartition(parts, "l_orderkey")


def line(c: str) -> Column:
    """A column of dealt order lines: number, place (of the status: none, before F, F or after it, 0 to 3), quantity or cents."""
    line_, odd = F.col("_line"), lambda i: F.element_at("_odd", i)
    usual, other = {
        "number": (F.shiftright(line_, 2).bitwiseAND(255).cast("int"), odd(1).cast("int")),
        "quantity": (F.shiftright(line_, 10).bitwiseAND(1023), F.floor(odd(2))),
        "cents": (F.shiftright(line_, 20), cents(odd(3))),
        "place": (line_.bitwiseAND(3).cast("int"), odd(4).cast("int")),
    }[c]
    return F.when(line_.isNotNull(), usual).otherwise(other)


def _order_tasks(t: Tables) -> DataFrame:
    """Dealt order lines by order, line and part."""
    return order_lines(t).groupBy("l_orderkey", line("number").alias("l_linenumber"), "l_partkey").agg(
        F.max(line("place")).alias("last_place"),
        F.sum(line("cents")).alias("bytes"),
        F.sum(line("quantity")).alias("quantity"),
        F.min("l_returnflag").alias("flag"),
        F.count(F.lit(1)).alias("num_tasks"),
    )


def stages(t: Tables, orders: DataFrame | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Order lines as stages with their byte counts; a stage is open while one of its lines is.

    orders: the given orders with further columns, of which `more` are kept.
    """
    lines_ = _order_tasks(t).groupBy("l_orderkey", "l_linenumber").agg(
        F.max("last_place").alias("last_place"),
        F.sum("bytes").alias("bytes"),
        F.sum("quantity").alias("quantity"),
        F.min("flag").alias("flag"),
        F.sum("num_tasks").alias("num_tasks"),
    )
    start = millis("o_orderdate") + F.col("l_linenumber") * HOUR
    return lines_.join(t.orders if orders is None else orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *more,
        F.col("o_custkey").alias("app"),
        F.col("o_orderkey").alias("job"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("stage"),
        start.alias("start_ms"),
        F.when(F.col("last_place") == 2, start + 30 * MINUTE).alias("end_ms"),
        "bytes",
        "quantity",
        "flag",
        "num_tasks",
        F.col("l_linenumber").alias("line"),
        F.col("o_orderpriority").alias("priority"),
    )


def tasks(t: Tables, orders: DataFrame | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Line items as tasks of their stage; a task is open unless all its rows are finished. orders, more: as for stages."""
    rows = _order_tasks(t)
    start = millis("o_orderdate") + F.col("l_linenumber") * HOUR + MINUTE
    return rows.join(t.orders if orders is None else orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *more,
        F.col("o_custkey").alias("app"),
        F.col("o_orderkey").alias("job"),
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("stage"),
        F.col("l_partkey").alias("task"),
        start.alias("start_ms"),
        F.when(F.col("last_place") == 2, start + F.col("quantity") * MINUTE).alias("end_ms"),
        "bytes",
    )


def operations(t: Tables) -> DataFrame:
    """Applications, jobs, stages and tasks in one table, each with the keys of all its ancestors."""
    none = F.lit(None).cast("long")
    parts = [
        applications(t).select(F.lit("app").alias("kind"), "app", none.alias("job"), none.alias("stage"), none.alias("task"), "start_ms", "end_ms"),
        jobs(t).select(F.lit("job").alias("kind"), "app", "job", none.alias("stage"), none.alias("task"), "start_ms", "end_ms"),
        stages(t).select(F.lit("stage").alias("kind"), "app", "job", "stage", none.alias("task"), "start_ms", "end_ms"),
        tasks(t).select(F.lit("task").alias("kind"), "app", "job", "stage", "task", "start_ms", "end_ms"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Start and end rows of operations: one row per end point, from one pass over the operations."""
    point = lambda name, at: F.struct(F.lit(name).alias("event"), F.col(at).alias("ms"))
    both = ops.select(*keys, F.inline(F.array(point("start", "start_ms"), point("end", "end_ms"))))
    return both.where("ms IS NOT NULL")


ALL_EVENTS = ("app", "job", "stage", "task", "sql", "executor", "odd")


def raw_events(t: Tables, kinds: tuple[str, ...] = ALL_EVENTS) -> DataFrame:
    """One JSON line per lifecycle event of the given kinds, as an event log holds them."""
    apps = applications(t).select(
        "app",
        "name",
        F.concat(F.lit("host-"), F.col("nation")).alias("host"),
        F.concat(F.lit("/events/app-"), F.col("app")).alias("file_path"),
        "start_ms",
        "end_ms",
    )
    host = F.concat(F.lit("host-"), F.col("c_nationkey")).alias("host")
    file_path = F.concat(F.lit("/events/app-"), F.col("app")).alias("file_path")

    def event(name: str, ms: str, *fields: Column) -> Column:
        line = F.to_json(F.struct(F.lit(name).alias("Event"), *fields))
        return F.struct(F.col(ms).alias("ms"), F.when(F.col(ms).isNotNull(), line).alias("line"))

    def emit(df: DataFrame, *events: Column) -> DataFrame:
        """The lines of all end points from one pass over the operations."""
        points = df.select("host", "file_path", F.inline(F.array(*events))).where("ms IS NOT NULL")
        return points.select("host", "file_path", F.timestamp_millis(F.col("ms") + 250).alias("ingest_ts"), "line")

    def at(ms: str, name: str) -> Column:
        return F.col(ms).alias(name)

    app_id = F.concat(F.lit("app-"), F.col("app"))
    properties = F.struct(app_id.alias("spark.app.id"), F.lit("scope").alias("spark.rdd.scope")).alias("Properties")
    # Orders meet their customer once for jobs, stages and tasks, each with its start and whether it has ended as one number;
    # the names of their place are made after the last move. Stages and tasks ask for the same columns, so Spark moves these once.
    span = millis("o_orderdate") * 2 + F.when(F.col("o_orderstatus") != "O", 1).otherwise(0)
    started = F.shiftright("_span", 1)
    placed = (
        t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", span.alias("_span"))
        .join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_custkey", "o_orderkey", "o_orderpriority", "_span", "c_nationkey", F.timestamp_millis(started).alias("o_orderdate"))
    )
    job = placed.select(
        F.col("o_custkey").alias("app"),
        "c_nationkey",
        F.col("o_orderkey").alias("job"),
        started.alias("start_ms"),
        F.when(F.col("_span").bitwiseAND(1) == 1, started + DAY).alias("end_ms"),
    ).select("*", host, file_path)
    stage = stages(t, placed, ("c_nationkey",)).select("*", host, file_path)
    task = tasks(t, placed, ("c_nationkey",)).select("*", host, file_path)
    sql = spread(t.events).select(
        F.lit("host-sql").alias("host"),
        F.concat(F.lit("/events/app-"), F.col("user_id")).alias("file_path"),
        "event_id",
        millis("ts").alias("start_ms"),
        F.when(F.col("event_type") != "error", millis("ts") + F.floor("value") * 1000).alias("end_ms"),
    )
    executor = t.supplier.select(
        F.concat(F.lit("host-"), F.col("s_nationkey")).alias("host"),
        F.concat(F.lit("/events/app-"), F.col("s_suppkey")).alias("file_path"),
        F.col("s_name").alias("executor"),
        (F.col("s_suppkey") * 1000 + 1_700_000_000_000).alias("start_ms"),
    )
    odd = t.nation.select(
        F.concat(F.lit("host-"), F.col("n_nationkey")).alias("host"),
        F.lit("/events/app-odd").alias("file_path"),
        F.col("n_nationkey").cast("long").alias("start_ms"),
    )

    def stage_info(ms: str, name: str) -> Column:
        return F.struct(
            F.col("stage").alias("Stage ID"),
            F.lit(0).alias("Stage Attempt ID"),
            F.concat(F.lit("count at Job.scala:"), F.col("line")).alias("Stage Name"),
            at(ms, name),
        ).alias("Stage Info")

    def task_info(*more: Column) -> Column:
        return F.struct(F.col("task").alias("Task ID"), F.lit(0).alias("Attempt"), at("start_ms", "Launch Time"), *more)

    of_stage = [F.col("stage").alias("Stage ID"), F.lit(0).alias("Stage Attempt ID")]
    counts = F.array(
        F.struct(F.lit("bytes").alias("Name"), F.col("bytes").cast("string").alias("Value"), F.lit("1").alias("Update"))
    ).alias("Accumulables")
    sql_package = "org.apache.spark.sql.execution.ui."
    parts = {
        "app": emit(
            apps,
            event("SparkListenerApplicationStart", "start_ms", F.col("name").alias("App Name"), app_id.alias("App ID"), at("start_ms", "Timestamp")),
            event("SparkListenerApplicationEnd", "end_ms", at("end_ms", "Timestamp")),
        ),
        "job": emit(
            job,
            event("SparkListenerJobStart", "start_ms", F.col("job").alias("Job ID"), at("start_ms", "Submission Time"), properties),
            event("SparkListenerJobEnd", "end_ms", F.col("job").alias("Job ID"), at("end_ms", "Completion Time")),
        ),
        "stage": emit(
            stage,
            event("SparkListenerStageSubmitted", "start_ms", stage_info("start_ms", "Submission Time"), properties),
            event("SparkListenerStageCompleted", "end_ms", stage_info("end_ms", "Completion Time")),
        ),
        "task": emit(
            task,
            event("SparkListenerTaskStart", "start_ms", *of_stage, task_info().alias("Task Info")),
            event("SparkListenerTaskEnd", "end_ms", *of_stage, task_info(at("end_ms", "Finish Time"), counts).alias("Task Info")),
        ),
        "sql": emit(
            sql,
            event(sql_package + "SparkListenerSQLExecutionStart", "start_ms", F.col("event_id").alias("executionId"), at("start_ms", "time")),
            event(sql_package + "SparkListenerSQLExecutionEnd", "end_ms", F.col("event_id").alias("executionId"), at("end_ms", "time")),
        ),
        "executor": emit(
            executor,
            event("SparkListenerExecutorAdded", "start_ms", F.col("executor").alias("Executor ID"), at("start_ms", "Timestamp")),
            event("SparkListenerBlockManagerAdded", "start_ms", at("start_ms", "Timestamp")),
        ),
        "odd": emit(odd, event("SparkListenerUnheardOf", "start_ms")),
    }
    chosen = [parts[kind] for kind in kinds]
    out = chosen[0]
    for p in chosen[1:]:
        out = out.unionByName(p)
    return out


def counters(t: Tables) -> DataFrame:
    """Cumulative counters per host with missing measures, restarts and equal times (whole hours)."""
    kind, c, n = F.col("event_type"), cents("value"), F.col("event_id")
    none = F.lit(None).cast("long")
    return t.events.select(
        F.concat(F.lit("h"), F.col("user_id")).alias("host"),
        F.col("event_id").alias("seq"),
        (F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("at_s"),
        F.when(kind == "error", none).when(kind == "signup", c).otherwise(n * 1000 + c).alias("in_bytes"),
        F.when(kind == "click", none).when(kind == "signup", F.lit(0).cast("long")).otherwise(n * 500 + c).alias("out_bytes"),
        F.when(kind != "view", n * 10).alias("in_packets"),
        F.when(kind == "purchase", c).otherwise(n * 7).alias("out_packets"),
        F.call_function("div", n, F.lit(3)).alias("in_dropped"),
        F.call_function("div", n, F.lit(5)).alias("out_dropped"),
        F.call_function("div", n, F.lit(11)).alias("in_errors"),
        F.col("user_id").alias("out_errors"),
    )


# Log levels that the kinds of event are written with.
LEVELS = {"error": "ERROR", "click": "INFO", "view": "DEBUG", "purchase": "WARN"}
LOG_ROOT = "/mnt/spark"


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def log_lines(t: Tables) -> DataFrame:
    """Events written as application log records, with stack traces on errors."""
    kind, user, k = F.col("event_type"), F.col("user_id"), props_k()
    level = F.lit(None).cast("string")
    for name, text in LEVELS.items():
        level = F.when(kind == name, F.lit(text)).otherwise(level)
    pod = (
        F.when(kind == "error", F.concat(F.lit("spark-master-"), user))
        .when(kind == "click", F.concat(F.lit("spark-worker-"), user))
        .when(kind == "view", F.concat(F.lit("spark-history-"), user))
        .otherwise(F.concat(F.lit("etl-"), user, F.lit("-driver")))
    )
    path = F.when(
        kind == "signup", F.concat(F.lit(f"{LOG_ROOT}/client-logs/inst-"), user, F.lit("/spark-app.log"))
    ).otherwise(F.concat(F.lit(f"{LOG_ROOT}/logs/"), pod, F.lit("/spark-app.log")))
    trace = F.format_string(
        '\njava.lang.IllegalStateException: bad <%d> & "x" isn\'t\n\tat Svc%d.run(Svc.java:12)', k, k
    )
    head = F.format_string(
        "%s %s  com.acme.Svc%d:%d - took %d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, k, user, cents("value")
    )
    value = (
        F.when(kind == "signup", F.format_string("plain line of %d", user))
        .when(kind == "error", F.concat(head, trace))
        .otherwise(head)
    )
    return spread(t.events).select("event_id", "ts", path.alias("path"), value.alias("value"))


def gc_lines(t: Tables) -> DataFrame:
    """Events written as garbage-collection log lines of the four known forms and one unknown form."""
    kind, k, user = F.col("event_type"), props_k(), F.col("user_id")
    c = cents("value")
    head = F.format_string(
        "[%s.%03d+0000][%d.%03ds][info][",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        (F.unix_millis("ts") % 1000).cast("int"),
        F.col("event_id"),
        (c % 1000).cast("int"),
    )
    heap = F.format_string(
        "%dM->%dM(%dM) %d.%03dms", c + 10, k, c + 600, F.call_function("div", c, F.lit(100)), (c % 100).cast("int")
    )
    cycle = F.format_string("GC(%d) Pause ", F.col("event_id"))
    value = (
        F.when(kind == "view", F.concat(head, F.lit("gc] "), cycle, F.lit("Young (Normal) (G1 Evacuation Pause) "), heap))
        .when(kind == "click", F.concat(head, F.lit("gc] "), cycle, F.lit("Remark "), heap))
        .when(kind == "purchase", F.concat(head, F.lit("gc,start] "), cycle, F.lit("Young (Normal) (G1 Evacuation Pause)")))
        .when(kind == "signup", F.concat(head, F.lit("gc,start] "), cycle, F.lit("Young (Normal)")))
        .otherwise(F.concat(head, F.lit("gc,heap] nothing to report")))
    )
    component = F.when(kind == "view", F.lit("worker")).when(kind == "click", F.lit("driver")).otherwise(F.lit("executor"))
    path = F.concat(
        F.lit(f"{LOG_ROOT}/logs/pod-"), user, F.lit("/gc-"), component, F.lit(".log"),
        F.when(kind == "purchase", F.concat(F.lit("."), F.call_function("div", k, F.lit(10)))).otherwise(F.lit("")),
    )
    return spread(t.events).select("event_id", "ts", path.alias("path"), value.alias("value"))


def alerts(t: Tables) -> DataFrame:
    """Events as alerts whose text carries stamps in the different spellings."""
    kind, user, k = F.col("event_type"), F.col("user_id"), props_k()
    c = cents("value")
    signature = F.format_string("Svc%d:%d", F.call_function("div", k, F.lit(10)), F.call_function("div", k, F.lit(25)))
    service = F.call_function("div", user, F.lit(10))
    description = (
        F.when(
            kind == "error",
            F.format_string(
                "Critical ERROR at %s sn-event_kind=CRITICAL_LOG_EVENT sn-log-signature=%s sn-service_instance=Svc-%d sn-impact=2",
                signature, signature, service,
            ),
        )
        .when(
            kind == "click",
            F.format_string(
                '{"sn.event_kind":"CRITICAL_LOG_EVENT","sn.log.signature":"%s","sn.service_instance":"svc-id-%d","ProblemSeverity":"ERROR"}',
                signature, service,
            ),
        )
        .when(
            kind == "view",
            F.format_string("log.event_kind: CRITICAL_LOG_EVENT; log.signature: %s, l2i.service_instance=Svc.%d", signature, service),
        )
        .when(kind == "purchase", F.format_string("cpu high ProblemSeverity=PERFORMANCE k8s-pod-name=spark-worker-%d", user))
        .otherwise(F.format_string("seen HOST-%s on host%d", F.upper(F.hex(user + 4096)), user))
    )
    info = F.when(
        kind == "purchase",
        F.format_string('{"ImpactedEntity":{"type":"HOST","entity":"HOST-%s","name":"host%d"}}', F.hex(user + 4096), user),
    ).when(
        kind == "view",
        F.format_string(
            '{"ImpactedEntities":[{"type":"HOST","entity":"HOST-%s","name":"host%d"},{"type":"CLOUD_APPLICATION","entity":"CLOUD_APPLICATION-%s","name":"wl-%d"}]}',
            F.hex(user + 4096), user, F.hex(k + 4096), k,
        ),
    )
    return spread(t.events).select(
        F.col("event_id").alias("alert_id"),
        F.col("ts").alias("created_on"),
        F.when(kind == "signup", F.lit("manual")).otherwise(F.lit("feed")).alias("source"),
        F.when(kind == "purchase", F.lit("CPU_SATURATED")).otherwise(F.lit("ERROR_EVENT")).alias("type"),
        F.least(F.call_function("div", c, F.lit(1500)) + 1, F.lit(5)).cast("int").alias("severity"),
        F.when(kind == "click", F.concat(F.lit("CUSTOM_DEVICE-"), F.hex(user))).alias("resource"),
        F.concat(F.lit("host"), user).alias("node"),
        description.alias("description"),
        info.alias("additional_info"),
        F.when(k >= 90, F.lit("Secondary")).otherwise(F.lit("Primary")).alias("correlation_group"),
        F.when(k < 5, F.concat(F.lit("INC"), F.col("event_id"))).alias("incident"),
        user.alias("user_id"),
        k.alias("k"),
    )


def services(t: Tables) -> DataFrame:
    """Suppliers as service instances."""
    return t.supplier.select(
        F.concat(F.lit("sys-"), F.col("s_suppkey")).alias("sys_id"),
        F.concat(F.lit("Svc "), F.col("s_suppkey")).alias("name"),
        F.concat(F.lit("svc-id-"), F.col("s_suppkey")).alias("identifier"),
        F.col("s_nationkey").alias("location"),
    )
