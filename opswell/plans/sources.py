"""Sources and sinks: every query writes given rows, whole, and reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from opswell.functions.numbers import cents
from opswell.operators import lifecycle, tables
from opswell.plans.ctes import sql
from opswell.registry import query
from opswell.sources import keyed, readers, standins as S, writers
from opswell.streaming import files


def text_folder(t, by=None):
    """All lines of all documents as text files."""
    path = t.scratch("text")
    lines = S.lines(t)
    writer = (lines.select("source", "value").repartition("source") if by else lines.select("value")).write
    (writer.partitionBy("source") if by else writer).option("lineSep", "\n").text(path)
    return path


LINES = sql("lines", "SELECT value, count(*) AS n FROM lines GROUP BY 1")


@query("src01", LINES)
def text(t):
    return readers.text_lines(t.spark, text_folder(t)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("src02", sql("lines", "SELECT 'source=' || source AS file, count(*) AS n, sum(length(value))::BIGINT AS chars FROM lines GROUP BY 1"))
def named_text(t):
    """Many files, each row with the name of the book it comes from (here the folder of the source)."""
    rows = readers.named_lines(t.spark, text_folder(t, by="source") + "/*", depth=2)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


def log_csv(t):
    path = t.scratch("csv")
    t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", cents("l_extendedprice").alias("price"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
    ).write.option("sep", "|").option("header", True).csv(path)
    return path


@query("src03", """
SELECT l_returnflag, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS price, year(min(l_shipdate)) AS first_year, year(max(l_shipdate)) AS last_year FROM lineitem GROUP BY 1""")
def separated(t):
    rows = readers.delimited(t.spark, log_csv(t), sep="|", timestamp_format="yyyy-MM-dd")
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"),
        F.year(F.min("l_shipdate")).alias("first_year"), F.year(F.max("l_shipdate")).alias("last_year"),
    )


@query("src04", """
SELECT replace(p_name, ' ', ', ') AS item, p_size AS quantity, count(*) AS n, sum(CAST(round(p_retailprice * 100) AS BIGINT))::BIGINT AS price FROM part GROUP BY 1, 2""")
def quoted(t):
    """Fields quoted by a character of their own, read with a schema and, to the same types, without."""
    path = t.scratch("quoted")
    t.part.select(F.replace("p_name", F.lit(" "), F.lit(", ")).alias("item"), F.col("p_size").alias("quantity"), cents("p_retailprice").alias("price")).write.option(
        "quote", "$"
    ).option("header", True).csv(path)
    declared = readers.delimited(t.spark, path, quote="$", schema="item STRING, quantity INT, price BIGINT")
    inferred = readers.delimited(t.spark, path, quote="$")
    inferred = inferred.select("item", F.col("quantity").cast("int"), F.col("price").cast("long"))
    both = declared.intersectAll(inferred)
    return both.groupBy("item", "quantity").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))


@query("src05", """
SELECT '_c0' AS name, count(*) AS n, count(DISTINCT v) AS distinct_rows FROM (
  SELECT l_orderkey || '|' || l_linenumber || '|' || l_returnflag || '|' || CAST(round(l_extendedprice * 100) AS BIGINT) || '|' || strftime(l_shipdate, '%Y-%m-%d') AS v FROM lineitem)""")
def unparsed(t):
    """Without options a file of another separator is one column of raw text."""
    path = t.scratch("raw")
    t.lineitem.select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_returnflag", cents("l_extendedprice"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("value")
    ).write.text(path)
    rows = t.spark.read.csv(path)
    per_value = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(F.lit(",".join(rows.columns)).alias("name"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_rows"))


# Meanings of the return flags. Fixed values.
FLAGS = [("R", "returned"), ("A", "accepted"), ("N", "none")]


@query("src06", "SELECT CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS meaning, count(*) AS n FROM lineitem GROUP BY 1")
def python_rows(t):
    flags = t.spark.createDataFrame(FLAGS, "l_returnflag string, meaning string")
    counted = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(flags), "l_returnflag").select("meaning", "n")


TURNS = "SELECT conv_id AS id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1"


def turns_of(docs):
    rows = docs.select("id", F.explode("_embedded.episodes").alias("e"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("e.text")).alias("chars"))


@query("src07", TURNS)
def json_lines(t):
    path = t.scratch("json")
    S.shows(t).write.json(path)
    return turns_of(readers.documents(t.spark, path))


@query("src08", TURNS)
def pretty_json(t):
    """Documents spread over many lines, in many files; a file is an array of the documents of one partition, read in splits."""
    path = t.scratch("pretty")
    docs = S.shows(t)
    text_ = docs.select(F.to_json(F.struct(*docs.columns), {"pretty": "true"}).alias("value"))
    files.json_arrays(text_).write.option("lineSep", "\n").text(path)
    return turns_of(readers.array_documents(t.spark, path, schema=docs.schema))


@query("src09", "SELECT conv_id AS id, count(*) AS turns FROM conversations GROUP BY 1")
def strict_json(t):
    """A partial schema whose types must fit, else the read fails."""
    path = t.scratch("json")
    S.shows(t).write.json(path)
    partial = "id BIGINT, _embedded STRUCT<episodes: ARRAY<STRUCT<turn: BIGINT, role: STRING>>>"
    rows = readers.documents(t.spark, path, schema=partial, strict=True)
    return rows.groupBy("id").agg(F.sum(F.size("_embedded.episodes")).alias("turns"))


@query("src10", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def parquet(t):
    return t.spark.read.parquet(t.path("embeddings")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("src11", """
SELECT year(o_orderdate) AS year, count(*) AS n, CASE WHEN year(o_orderdate) >= 1998 THEN count(o_orderpriority) ELSE 0 END AS priorities FROM orders GROUP BY 1""")
def year_by_year(t):
    """One table per year; the later ones have a column more."""
    path = t.scratch("years")
    rows = t.orders.withColumn("year", F.year("o_orderdate"))
    years = sorted(r["year"] for r in rows.select("year").distinct().collect())  # a handful of calendar years
    old = rows.where("year < 1998").drop("o_orderpriority")
    new = rows.where("year >= 1998")
    for name, part in (("old", old), ("new", new)):
        part.withColumn("y", F.col("year")).write.partitionBy("y").parquet(f"{path}/{name}")
    paths = [f"{path}/{'old' if y < 1998 else 'new'}/y={y}" for y in years]
    return readers.yearly(t.spark, paths).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("priorities")
    )


@query("src12", sql("words", """
SELECT 'parts' AS target, 10 AS files, count(DISTINCT word) AS n FROM words UNION ALL
SELECT 'single', 1, count(DISTINCT length(word)) FROM words"""))
def csv_targets(t):
    counts = S.words(t).groupBy("word").count()
    by_length = S.words(t).groupBy(F.length("word").alias("length")).count()
    many, one = t.scratch("csv-parts"), t.scratch("csv-single")
    writers.attempt(writers.csv_parts, counts, many, 10)
    writers.attempt(writers.csv_single, by_length, one)

    def seen(name, path):
        rows = t.spark.read.option("header", True).csv(path).select(F.col("_metadata.file_path").alias("f"))
        per_file = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
        return per_file.agg(F.lit(name).alias("target"), F.count(F.lit(1)).cast("int").alias("files"), F.sum("n").alias("n"))

    return seen("parts", many).unionByName(seen("single", one))


@query("src13", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def parquet_modes(t):
    """A second write that overwrites, and a third that leaves what is there."""
    path = t.scratch("orders")
    writers.parquet(t.orders.where("o_orderstatus = 'O'"), path)
    writers.parquet(t.orders, path, "overwrite")
    writers.parquet(t.orders.where("o_orderstatus = 'F'"), path, "ignore")
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("src14", "SELECT count(*) AS rows_written, count(*) AS rows_read, true AS agree FROM lineitem")
def round_trip(t):
    return writers.round_trip(t.lineitem, t.scratch("roundtrip"))


EVENT_COUNTS = sql("apps jobs", """
SELECT 'SparkListenerApplicationStart' AS event, count(*) AS n FROM apps UNION ALL
SELECT 'SparkListenerApplicationEnd', count(end_ms) FROM apps UNION ALL
SELECT 'SparkListenerJobStart', count(*) FROM jobs UNION ALL SELECT 'SparkListenerJobEnd', count(end_ms) FROM jobs""")


def event_log(t):
    """Event lines of applications and jobs as files, one folder per host."""
    path = t.scratch("events")
    rows = S.raw_events(t, ("app", "job"))
    rows.select("host", F.col("line").alias("value")).repartition("host").write.partitionBy("host").text(path)
    return path


def event_counts(lines):
    named = lines.select(F.regexp_extract("value", '"Event":"([^"]+)"', 1).alias("event"))
    return named.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("src15", EVENT_COUNTS)
def tailed_events(t):
    """Stream over a folder of event lines, run until it has caught up."""
    stream = readers.growing_lines(t.spark, event_log(t))
    return event_counts(files.caught_up(t, stream))


@query("src15_batch", EVENT_COUNTS)
def tailed_events_batch(t):
    return event_counts(readers.recent_lines(t.spark, event_log(t), "part-*"))


@query("src16", sql("log_lines", "SELECT level, count(*) AS n FROM log_lines WHERE event_type IN ('error', 'click') GROUP BY 1"))
def rotating_logs(t):
    """Log files by name pattern: packed and temporary files beside them are not read, nor files past their age."""
    path = t.scratch("logs")
    rows = S.log_lines(t)
    take = lambda kind: rows.where(F.col("value").contains(f" {kind} ")).select(F.split("value", "\n")[0].alias("value"))
    take("ERROR").write.text(f"{path}/a/spark-app.log")
    take("INFO").write.text(f"{path}/b/spark-app.log.1")
    take("WARN").write.option("compression", "gzip").text(f"{path}/c/spark-app.log.2")
    at = t.scratch("stream"), t.scratch("progress")
    stream = lambda: readers.growing_lines(t.spark, path, glob="*.txt", max_age="24h")
    files.caught_up(t, stream(), at=at)
    # A file that comes later but was last written two days before the others.
    take("DEBUG").write.text(f"{path}/d/spark-app.log")
    writers.set_age(t.spark, f"{path}/d/spark-app.log", 48 * 3600)
    level = F.regexp_extract("value", "^\\S+ \\S+ (\\w+)", 1).alias("level")
    return files.caught_up(t, stream(), at=at).groupBy(level).agg(F.count(F.lit(1)).alias("n"))


@query("src17", sql("jobs", "SELECT 'Start' AS event_kind, count(*) AS n FROM jobs UNION ALL SELECT 'End', count(end_ms) FROM jobs"))
def appended_events(t):
    """Normalised events appended as JSON lines."""
    path = t.scratch("normalised")
    rows = lifecycle.normalise(S.raw_events(t, ("job",)))
    rows.select("event_id", "class", "event_kind", "start_millis").write.mode("append").json(path)
    read = t.spark.read.schema("event_id STRING, class STRING, event_kind STRING, start_millis BIGINT").json(path)
    return read.groupBy("event_kind").agg(F.count(F.lit(1)).alias("n"))


def deliveries(t):
    """Line items as deliveries of events: the order is the key, so most keys are delivered several times."""
    return t.lineitem.select(
        F.sha1(F.col("l_orderkey").cast("string")).alias("id"),
        F.struct(F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ms"), "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        "l_orderkey", "l_returnflag",
    )


LAST_DELIVERY = """
SELECT l_orderkey, l_returnflag FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1"""


@query("src18", LAST_DELIVERY)
def keyed_write(t):
    """Deliveries as a stream into a keyed table of versions: the newest row of a key stays."""
    table = keyed.KeyedTable(t.spark, t.scratch("keyed"), "id", ["seq"])
    rows = deliveries(t)
    files.replayed(t, rows.withColumn("at", F.col("seq.ms")), "at", lambda stream: stream.drop("at"), write=table.upsert)
    read = table.read()
    return (rows.limit(0) if read is None else read).select("l_orderkey", "l_returnflag")


@query("src18_batch", LAST_DELIVERY)
def keyed_rows(t):
    return tables.newest(deliveries(t), ["id"], ["seq"]).select("l_orderkey", "l_returnflag")


@query("src19", sql("jobs", """
SELECT coalesce(status, 'no start') AS state, count(*) AS n FROM (
  SELECT CASE WHEN a.o_orderkey IS NULL THEN 'no start' WHEN e.job IS NULL THEN 'open' ELSE 'closed by end' END AS status
  FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT') a FULL JOIN (SELECT job FROM jobs WHERE end_ms IS NOT NULL) e ON a.o_orderkey = e.job) GROUP BY 1"""))
def closed_rows(t):
    """Close messages folded onto starts; one whose start never came is counted, not applied."""
    starts = t.orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("step"), F.lit("open").alias("state"))
    closes = S.jobs(t).where("end_ms IS NOT NULL").select(F.col("job").alias("id"), F.lit(1).alias("step"), F.lit("closed by end").alias("state"))
    folded = starts.unionByName(closes).groupBy("id").agg(
        F.max_by("state", "step").alias("state"), F.min("step").alias("first")
    )
    state = F.when(F.col("first") == 1, F.lit("no start")).otherwise(F.col("state"))
    return folded.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("src20", """
SELECT l_orderkey, first_seen FROM (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END) AS first_seen FROM lineitem GROUP BY 1)""")
def created_once(t):
    """Rows whose id is taken are refused."""
    path = t.scratch("created")
    for step, test in ((1, "l_returnflag = 'R'"), (2, "l_returnflag <> 'R'")):
        writers.create_only(t.spark, path, t.lineitem.where(test).select("l_orderkey", F.lit(step).alias("first_seen")), "l_orderkey", ["first_seen"])
    return t.spark.read.parquet(path).select("l_orderkey", "first_seen")


@query("src21", """
SELECT CASE WHEN event_type = 'error' THEN 'alerts' WHEN event_type IN ('click', 'view') THEN 'usage' ELSE 'other' END AS route, count(*) AS n FROM events GROUP BY 1""")
def routed(t):
    path = t.scratch("routed")
    writers.route(t.events, path, [("alerts", F.col("event_type") == "error"), ("usage", F.col("event_type").isin("click", "view"))])
    return t.spark.read.parquet(path).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("src21_stream", """
SELECT sink, count(*) AS n, count(DISTINCT event_id) AS ids FROM (
  SELECT 'alerts' AS sink, event_id FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'usage', event_id FROM events WHERE event_type IN ('click', 'view')
  UNION ALL SELECT 'large', event_id FROM events WHERE value > 100
  UNION ALL SELECT 'other', event_id FROM events WHERE event_type NOT IN ('error', 'click', 'view') AND NOT coalesce(value > 100, false)) GROUP BY 1""")
def routed_stream(t):
    """One stream of events into several sinks; an event may be in more than one."""
    rules = {"alerts": F.col("event_type") == "error", "usage": F.col("event_type").isin("click", "view"), "large": F.col("value") > 100}
    sinks = keyed.Routes(t.spark, t.scratch("sinks"), rules)
    rows = t.events.select("event_id", "event_type", "value", "ts")
    files.replayed(t, rows, "ts", lambda stream: stream, write=sinks.write)
    read = [sinks.read(s, rows.schema).select(F.lit(s).alias("sink"), "event_id") for s in (*rules, sinks.otherwise)]
    found = reduce(lambda a, b: a.unionByName(b), read)
    return found.groupBy("sink").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("src22", "SELECT event_type AS dataset, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2")
def dataset_folders(t):
    path = t.scratch("datasets")
    rows = t.events.withColumns(
        {"type": F.lit("logs"), "dataset": F.col("event_type"), "namespace": F.lit("default"), "date": F.date_format("ts", "yyyy-MM-dd")}
    )
    writers.dataset_layout(rows, path)
    one = t.spark.read.parquet(path).where("dataset = 'click' AND date >= '2024-01-15'")
    return one.groupBy("dataset", F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("src23", """
SELECT 'system.gpu.value,gpu.card="card' || user_id || '",host.name="h\\"' || (user_id // 10) || '" ' || printf('%.6g', value * 1000) AS value FROM events""")
def metric_lines(t):
    path = t.scratch("lines")
    host = F.concat(F.lit('h"'), F.call_function("div", F.col("user_id"), F.lit(10)))
    writers.metric_lines(
        t.events, F.lit("system.gpu.value"), {"gpu.card": F.concat(F.lit("card"), F.col("user_id")), "host.name": host}, F.col("value") * 1000
    ).write.text(path)
    return t.spark.read.text(path)


@query("src24", "SELECT n_nationkey AS nation, count(*) AS customers, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS in_debt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def report(t):
    """A report as JSON documents: one nested document per unit."""
    path = t.scratch("report")
    per = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).alias("in_debt")
    )
    per.select("nation", F.struct("customers", "in_debt").alias("summary")).write.json(path)
    read = t.spark.read.schema("nation INT, summary STRUCT<customers: BIGINT, in_debt: BIGINT>").json(path)
    return read.select("nation", "summary.customers", "summary.in_debt")


@query("src25", """
SELECT o_orderstatus AS chapter, count(*) AS runs, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'ok' END AS status FROM orders GROUP BY 1""")
def timings(t):
    """Run timings appended batch by batch, then summed up."""
    path = t.scratch("timings")
    rows = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("abc123").alias("commit"), F.col("o_orderstatus").alias("chapter"),
        F.when(F.col("o_orderstatus") == "P", F.lit("failed")).otherwise(F.lit("ok")).alias("status"), F.col("o_totalprice").alias("elapsed_s"),
    )
    for status in ("ok", "failed"):
        writers.append_timings(rows.where(F.col("status") == status), path)
    schema = "date STRING, commit STRING, chapter STRING, status STRING, elapsed_s DOUBLE"
    return readers.delimited(t.spark, path, schema=schema).groupBy("chapter", "status").agg(F.count(F.lit(1)).alias("runs"))
