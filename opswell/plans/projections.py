"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from opswell.functions import text as X
from opswell.functions.numbers import cents
from opswell.functions.text import clock_seconds
from opswell.operators import reconcile, tables
from opswell.plans.aggregates import AS_OF_MS, DAY_MS, dated, gc
from opswell.plans.ctes import sql
from opswell.registry import query
from opswell.sources import standins as S


def chunks(names, size=3):
    """Column names in groups of three."""
    return [names[i : i + size] for i in range(0, len(names), size)]


@query("prj01", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def by_name(t):
    rows = t.lineitem
    return rows.select(["l_orderkey", F.col("l_linenumber"), rows.l_quantity])


@query("prj02", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def in_chunks(t):
    """Columns chosen three at a time, the pieces put side by side again."""
    rows = t.part
    return rows.select(*[c for group in chunks(rows.columns) for c in rows.select(*group).columns])


@query("prj03", "SELECT s_suppkey, s_name FROM supplier")
def dropped(t):
    """Columns dropped; a name the table does not have is ignored."""
    return t.supplier.drop("s_acctbal", "s_nationkey", "no_such_column")


@query("prj04", "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def by_predicate(t):
    rows = t.lineitem
    return rows.select([c for c in rows.columns if c not in ["l_shipdate"] and not c.endswith("key")])


@query("prj05", sql("logs", "SELECT order_key, sequence_no, seconds, seconds * 2 AS twice FROM logs"))
def derived(t):
    rows = S.programme_logs(t).withColumn("seconds", clock_seconds("duration").cast("long"))
    return rows.withColumn("twice", F.col("seconds") * 2).select("order_key", "sequence_no", "seconds", "twice")


@query("prj06", "SELECT o_custkey AS customer, o_orderkey AS id, o_orderstatus AS status FROM orders")
def renamed(t):
    """One column renamed, all in lower case, then in alphabetical order."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey").withColumnRenamed("o_orderstatus", "STATUS").toDF("ID", "STATUS", "CUSTOMER")
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    return rows.select(sorted(rows.columns))


@query("prj07", "SELECT p_partkey, p_size * 2 AS twice, p_retailprice / 2 AS half FROM part WHERE p_size > 10")
def expressions(t):
    return t.part.where("p_size > 10").selectExpr("p_partkey", "p_size * 2 AS twice").join(
        t.part.select("p_partkey", F.expr("p_retailprice / 2 AS half")), "p_partkey"
    )


@query("prj08", sql("drives", """
SELECT model, sum(try_cast(smart_1_raw AS BIGINT))::BIGINT AS smart_1, count(try_cast(smart_9_raw AS BIGINT)) AS smart_9 FROM drives GROUP BY 1"""))
def cast_by_prefix(t):
    rows = tables.cast_prefixed(S.drives(t), "smart_", "bigint")
    return rows.groupBy("model").agg(F.sum("smart_1_raw").alias("smart_1"), F.count("smart_9_raw").alias("smart_9"))


@query("prj09", "SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS BIGINT) AS size FROM orders")
def typed_nulls(t):
    return tables.with_missing(t.orders.select("o_orderkey", "o_orderstatus"), {"comment": "string", "size": "bigint", "o_orderstatus": "string"})


@query("prj10", sql("logs", "SELECT DISTINCT duration, seconds FROM logs"))
def distinct_rows(t):
    return S.programme_logs(t).select("duration", clock_seconds("duration").cast("long").alias("seconds")).distinct()


@query("prj11", "SELECT l.o_orderkey AS id, r.o_orderstatus AS status_after FROM orders l JOIN orders r ON r.o_orderkey = l.o_orderkey + 1")
def qualified(t):
    """Names that both sides of a join have, told apart by alias."""
    joined = t.orders.alias("l").join(t.orders.alias("r"), F.col("r.o_orderkey") == F.col("l.o_orderkey") + 1)
    return joined.select(F.col("l.o_orderkey").alias("id"), F.col("r.o_orderstatus").alias("status_after"))


@query("prj12", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'kn-' || user_id ELSE 'n-' || user_id END AS namespace, 'cg-' || event_id AS cgroup_path FROM events""")
def renamed_attributes(t):
    """First attribute present wins, then the old names go."""
    rows = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "click", F.concat(F.lit("kn-"), F.col("user_id"))).alias("kubernetes_namespace"),
        F.concat(F.lit("n-"), F.col("user_id")).alias("plain_namespace"),
        F.concat(F.lit("cg-"), F.col("event_id")).alias("id"),
    )
    return rows.withColumns(
        {"namespace": F.coalesce("kubernetes_namespace", "plain_namespace"), "cgroup_path": F.col("id")}
    ).drop("kubernetes_namespace", "plain_namespace", "id")


@query("prj13", sql("counters", "SELECT host, seq, coalesce(in_bytes, 0) AS in_bytes, coalesce(out_bytes, 0) AS out_bytes FROM counters"))
def defaulted(t):
    return S.counters(t).select("host", "seq", "in_bytes", "out_bytes").fillna(0, ["in_bytes", "out_bytes"])


@query("prj14", """
SELECT event_id, CASE WHEN event_type <> 'signup' THEN 'spark' END AS application, CASE WHEN event_type <> 'signup' THEN event_type END AS operation_type FROM events""")
def split_kind(t):
    """Kind "Application.operation" in two; a kind without a dot gives neither."""
    kind = F.when(F.col("event_type") == "signup", F.lit("signup")).otherwise(F.concat(F.lit("Spark."), F.col("event_type")))
    parts = F.split(F.col("kind"), "\\.")
    two = F.size(parts) >= 2
    return t.events.select("event_id", kind.alias("kind")).select(
        "event_id", F.when(two, F.lower(parts[0])).alias("application"), F.when(two, F.get(parts, F.lit(1))).alias("operation_type")
    )


@query("prj15", """
SELECT event_id, 's-' || event_id AS start_id, CASE WHEN event_type <> 'error' THEN 'e-' || event_id END AS end_id FROM events""")
def promoted(t):
    """Nested correlation ids as columns of their own."""
    ids = F.map_from_arrays(
        F.array(F.lit("correlation.event.start.id"), F.lit("correlation.event.end.id")),
        F.array(
            F.concat(F.lit("s-"), F.col("event_id")),
            F.when(F.col("event_type") != "error", F.concat(F.lit("e-"), F.col("event_id"))),
        ),
    )
    rows = t.events.select("event_id", ids.alias("attributes"))
    return rows.select(
        "event_id",
        F.col("attributes")["correlation.event.start.id"].alias("start_id"),
        F.col("attributes")["correlation.event.end.id"].alias("end_id"),
    )


@query("prj16", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'https://cmdb.example/nav_to.do?uri=cmdb_ci.do%3Fsys_id%3Dsys-' || c_custkey END AS record,
  'https://x.live.example/ui/nav/HOST-' || c_custkey AS entity FROM customer""")
def deep_links(t):
    key = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("sys-"), F.col("c_custkey")))
    entity = F.concat(F.lit("feed|||HOST-"), F.col("c_custkey"), F.lit("|||extra"))
    return t.customer.select(
        "c_custkey",
        X.record_link(F.lit("https://cmdb.example/"), F.lit("cmdb_ci"), key).alias("record"),
        X.entity_link(F.lit("https://x.apps.example/api/"), entity, ".example").alias("entity"),
    )


@query("prj17", "SELECT user_id, sum(CASE WHEN event_type = 'click' THEN c ELSE 0 END)::BIGINT AS inbound, -sum(CASE WHEN event_type = 'view' THEN c ELSE 0 END)::BIGINT AS outbound FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY 1")
def mirrored(t):
    c = cents("value")
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, c).otherwise(0))
    return t.events.groupBy("user_id").agg(of("click").alias("inbound"), (-of("view")).alias("outbound"))


@query("prj18", "SELECT event_id, 'k8s-short' AS sn_pipeline, 'lab' AS environment, 'main' AS cluster FROM events")
def stamped(t):
    return t.events.select("event_id").withColumns(
        {"sn_pipeline": F.lit("k8s-short"), "environment": F.lit("lab"), "cluster": F.lit("main")}
    )


# Filters

@query("flt01", "SELECT event_id FROM events WHERE event_type = 'click' AND props <> '' AND value IS NOT NULL")
def equal_and_present(t):
    return t.events.where("event_type = 'click'").where((F.col("props") != "") & F.col("value").isNotNull()).select("event_id")


@query("flt02", sql("counters", "SELECT host, seq FROM counters WHERE in_bytes IS NOT NULL AND in_packets IS NOT NULL"))
def complete_rows(t):
    return S.counters(t).dropna(subset=["in_bytes", "in_packets"]).select("host", "seq")


@query("flt03", sql("logs", "SELECT order_key, sequence_no, coalesce(producer1, 0) AS producer1, coalesce(producer2, 0) AS producer2 FROM logs"))
def filled_nulls(t):
    return S.programme_logs(t).select("order_key", "sequence_no", "producer1", "producer2").fillna(0)


@query("flt04", sql("weather", "SELECT stn, mo, da, temp FROM weather WHERE temp <> 999900 AND stn <> 0"))
def without_sentinels(t):
    return S.weather(t).where("temp <> 999900 AND stn <> 0").select("stn", "mo", "da", "temp")


@query("flt05", sql("logs", "SELECT order_key, sequence_no, program FROM logs WHERE trim(program) IN ('R', 'A')"))
def trimmed_codes(t):
    return S.programme_logs(t).where(F.trim("program").isin("R", "A")).select("order_key", "sequence_no", "program")


@query("flt06", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 20 / (1 + 0.25) AND 20 * (1 + 0.25)")
def about(t):
    return t.part.where(F.col("p_size").between(20 / 1.25, 20 * 1.25)).select("p_partkey", "p_size")


@query("flt07", "SELECT p_partkey FROM part WHERE NOT (p_brand = 'Brand#1' OR p_size < 5)")
def negated(t):
    return t.part.where(~((F.col("p_brand") == "Brand#1") | (F.col("p_size") < 5))).select("p_partkey")


@query("flt08", sql("logs", "SELECT order_key, sequence_no, CASE trim(program) WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM logs"))
def weights(t):
    code = F.trim("program")
    weight = F.when(code == "R", 1.0).when(code == "A", 0.75).otherwise(0.0)
    return S.programme_logs(t).select("order_key", "sequence_no", weight.alias("weight"))


@query("flt09", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def after_grouping(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("flt10", "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND regexp_matches(source, '^(src1|src2)') AND n_chars IS NOT NULL AND NOT (source = 'src10')")
def search_predicate(t):
    """Field in list, start of a name, field exists, not."""
    keep = F.col("lang").isin("en", "fr") & F.col("source").rlike("^(src1|src2)")
    return t.documents.where(keep & F.col("n_chars").isNotNull() & ~(F.col("source") == "src10")).select("doc_id", "source")


# Names of the metrics that go to the one or the other receiver. Fixed values.
OWN_METRICS = "^executions\\.|^spark\\."
EXECUTION_COUNTERS = "^spark\\.executions\\.(opened|closed)\\."
KNOWN_COUNTERS = "^spark\\.executions\\.(opened|closed)\\.(app|job|stage|task|sql)$"


def metric_names(t):
    name = (
        F.when(F.col("event_type") == "click", F.lit("spark.executions.opened.job"))
        .when(F.col("event_type") == "view", F.lit("spark.executions.opened.other"))
        .when(F.col("event_type") == "error", F.lit("spark.stage.shuffle.read"))
        .otherwise(F.lit("system.load"))
    )
    return t.events.select("event_id", name.alias("metric"))


@query("flt11", """
SELECT event_id, event_type = 'click' OR event_type = 'error' OR event_type = 'view' AS own, event_type <> 'view' AS accepted FROM events""")
def by_metric_name(t):
    name = F.col("metric")
    return metric_names(t).select(
        "event_id",
        name.rlike(OWN_METRICS).alias("own"),
        (~(name.rlike(EXECUTION_COUNTERS) & ~name.rlike(KNOWN_COUNTERS))).alias("accepted"),
    )


@query("flt12", """
SELECT 'odd' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'executor', count(*) FROM supplier""")
def timed_events(t):
    """Raw events of the kinds that carry no time are dropped; a kind nobody knows stays."""
    from opswell.operators.lifecycle import parse

    kept = parse(S.raw_events(t, ("executor", "odd")))
    kind = F.when(F.col("event").endswith("UnheardOf"), F.lit("odd")).otherwise(F.lit("executor"))
    return kept.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("flt13", sql("gc", "SELECT event_id, micros FROM gc WHERE micros >= 100000"))
def long_pauses(t):
    return gc(t).where("millis >= 100").select("event_id", "micros")


@query("flt14", sql("jobs", f"""
SELECT job, start_ms >= {AS_OF_MS - DAY_MS} AS last_day, start_ms <= {AS_OF_MS - 300000} AS older_than_5_min FROM jobs
WHERE start_ms <= {AS_OF_MS} AND end_ms IS NULL"""))
def relative_times(t):
    """Open starts seen from a given instant: of the last 24 hours, and open for more than 5 minutes."""
    open_ = S.jobs(t).where((F.col("start_ms") <= AS_OF_MS) & F.col("end_ms").isNull())
    return open_.select(
        "job", (F.col("start_ms") >= AS_OF_MS - DAY_MS).alias("last_day"), (F.col("start_ms") <= AS_OF_MS - 300_000).alias("older_than_5_min")
    )


@query("flt15", sql("log_lines", "SELECT event_id FROM log_lines WHERE level = 'ERROR' AND path LIKE '/mnt/spark/logs/%/spark-app.log'"))
def wildcards(t):
    return S.log_lines(t).where(F.col("value").like("% ERROR %") & F.col("path").like("/mnt/spark/logs/%/spark-app.log")).select("event_id")


@query("flt16", """
SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'owned_by' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'environment' END], lambda x: x IS NOT NULL)) AS field FROM customer""")
def missing_fields(t):
    """Required fields that are missing or blank; a blank operational_status still counts as declared."""
    items = t.customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("owned_by"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("  ")).otherwise(F.lit("lab")).alias("environment"),
        F.lit("").alias("operational_status"),
    )
    return reconcile.required_fields(items, "c_custkey", ["owned_by", "environment", "operational_status"], ["operational_status"])


@query("flt17", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_scope(t):
    zones = F.array(F.col("c_mktsegment"), F.concat(F.lit("zone-"), F.col("c_nationkey")))
    entities = t.customer.join(t.nation.where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("zones", zones)
    return entities.where(F.array_contains("zones", "BUILDING") | F.array_contains("zones", "MACHINERY")).select("c_custkey")
