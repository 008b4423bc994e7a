"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from opswell.functions import numbers as N, text as X, times as D
from opswell.operators import segments
from opswell.operators.lifecycle import numeric_accumulables
from opswell.plans.ctes import sql
from opswell.registry import query
from opswell.session import spread
from opswell.sources import standins as S


@query("scl01", r"""
SELECT doc_id, len(string_split(text, ' ')) AS parts, regexp_extract(lower(text), '[a-z]+') AS first_word, length(text) AS length,
  substr(text, 1, 3) AS start, length(trim(text)) AS trimmed FROM documents""")
def strings(t):
    return t.documents.select(
        "doc_id",
        F.size(F.split("text", " ")).alias("parts"),
        X.first_word("text").alias("first_word"),
        F.length("text").alias("length"),
        F.substring("text", 1, 3).alias("start"),
        F.length(F.trim("text")).alias("trimmed"),
    )


@query("scl02", sql("logs", "SELECT order_key, sequence_no, part_key, duration, seconds FROM logs"))
def clock_at_offsets(t):
    return S.programme_logs(t).select(
        "order_key", "sequence_no", "part_key", "duration", X.clock_seconds("duration").cast("long").alias("seconds")
    )


@query("scl03", sql("logs", "SELECT order_key, sequence_no, part_key, CASE WHEN category = 'F' THEN seconds ELSE 0 END AS seconds FROM logs"))
def clock_anywhere(t):
    """A duration at the end of the text counts, anything else is 0."""
    text = F.when(F.col("category") == "F", F.concat(F.lit("about "), F.col("duration"))).otherwise(F.concat(F.col("duration"), F.lit(" h")))
    return S.programme_logs(t).select(
        "order_key", "sequence_no", "part_key", X.clock_seconds_anywhere(text).cast("long").alias("seconds")
    )


@query("scl04", "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price FROM orders")
def formatted(t):
    return t.orders.select("o_orderkey", F.format_number("o_totalprice", 2).alias("price"))


@query("scl05", sql("log_lines", "SELECT event_id, 'spark-app.log' AS file, split_part(path, '/', 5) AS folder FROM log_lines"))
def path_parts(t):
    return S.log_lines(t).select("event_id", X.base_name("path").alias("file"), X.extract("path", "([^/]+)/[^/]+$").alias("folder"))


@query("scl06", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def escaped_html(t):
    return t.pages.select("page_id", X.html_escape("html").alias("escaped"))


@query("scl07", r"""
SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS label FROM pages""")
def labels(t):
    return t.pages.select("page_id", X.label("url").alias("label"))


@query("scl08", "SELECT page_id, lower(split_part(regexp_extract(url, '//([^/]+)', 1), '.', 1)) AS host FROM pages")
def host_labels(t):
    return t.pages.select("page_id", X.host_label(F.regexp_extract("url", "//([^/]+)", 1)).alias("host"))


@query("scl09", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'MACHINERY' THEN 'v' || c_custkey WHEN 'HOUSEHOLD' THEN '' ELSE c_name END AS text FROM customer""")
def display_values(t):
    """A field that is an object gives its display value, else its value; a plain one gives itself; none gives empty text."""
    seg = F.col("c_mktsegment")
    value = F.concat(F.lit("v"), F.col("c_custkey"))
    field = (
        F.when(seg == "BUILDING", F.to_json(F.struct(F.col("c_name").alias("display_value"), value.alias("value"))))
        .when(seg == "MACHINERY", F.to_json(F.struct(F.lit("").alias("display_value"), value.alias("value"))))
        .when(seg != "HOUSEHOLD", F.col("c_name"))
    )
    return t.customer.select("c_custkey", X.text_of(field).alias("text"))


@query("scl10", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'HOST' WHEN 'view' THEN 'CLOUD_APPLICATION_INSTANCE' WHEN 'error' THEN 'CLOUD_APPLICATION' WHEN 'purchase' THEN 'OTHER' ELSE 'UNKNOWN' END AS entity_type FROM events""")
def entity_types(t):
    kind = F.col("event_type")
    id_of = (
        F.when(kind == "click", F.lit("HOST-"))
        .when(kind == "view", F.lit("CLOUD_APPLICATION_INSTANCE-"))
        .when(kind == "error", F.lit("CLOUD_APPLICATION-"))
        .otherwise(F.lit("X-"))
    )
    given = F.when(kind == "purchase", F.lit("OTHER")).otherwise(F.lit(""))
    return t.events.select("event_id", X.entity_type(given, F.concat(id_of, F.hex("event_id"))).alias("entity_type"))


@query("scl11", sql("tasks", """
SELECT 'App:' || app || '|Job:' || job || '|Stage:' || stage || '|Task:' || task AS key, 'App:' || app || '|Job:' || job AS job_key, 'App:' || app || '|Job:' || job || '|Stage:' || stage AS stage_key FROM tasks"""))
def composite_keys(t):
    """Keys of a task and of its ancestors as values of their own, so that Job:1 is never taken for Job:10."""
    part = lambda name, c: F.concat(F.lit(f"{name}:"), F.col(c))
    app, job, stage, task = part("App", "app"), part("Job", "job"), part("Stage", "stage"), part("Task", "task")
    return S.tasks(t).select(
        F.concat_ws("|", app, job, stage, task).alias("key"),
        F.concat_ws("|", app, job).alias("job_key"),
        F.concat_ws("|", app, job, stage).alias("stage_key"),
    )


@query("scl12", "SELECT o_orderkey, sha1('Start:Spark:Job:' || o_custkey || ':' || o_orderkey) AS id, sha1('Spark:App:' || o_custkey) AS parent_id FROM orders")
def hashed_ids(t):
    return t.orders.select(
        "o_orderkey",
        F.sha1(F.concat_ws(":", F.lit("Start:Spark:Job"), "o_custkey", "o_orderkey")).alias("id"),
        F.sha1(F.concat_ws(":", F.lit("Spark:App"), "o_custkey")).alias("parent_id"),
    )


@query("scl13", "SELECT page_id, url_encode(url) AS encoded, regexp_replace(url, '/+$', '') AS base FROM pages")
def encoded_urls(t):
    # Spark writes a blank as plus; the links here write it as %20.
    encoded = F.replace(F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return t.pages.select("page_id", encoded.alias("encoded"), F.regexp_replace("url", "/+$", "").alias("base"))


@query("scl14", "SELECT s_suppkey, 'Agent on ' || s_name || ' (' || lower(s_name) || ')' AS name FROM supplier")
def expanded_templates(t):
    return t.supplier.select("s_suppkey", X.expand(F.lit("Agent on {host} ({host_lower})"), "s_name").alias("name"))


@query("scl15", sql("drives", "SELECT serial_number, date AS raw, strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM drives GROUP BY ALL"))
def two_formats(t):
    rows = S.drives(t).select("serial_number", "date", D.first_date("date", ["yyyy-MM-dd", "M/d/yy"]).cast("string").alias("day"))
    return rows.groupBy("serial_number", F.col("date").alias("raw"), "day").agg(F.count(F.lit(1)).alias("n"))


@query("scl16", """
SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days,
  epoch(o_orderdate)::BIGINT AS seconds, CAST(try_cast(format('{:04d}-{:02d}-{:02d}', year(o_orderdate), month(o_orderdate), o_orderkey % 32) AS DATE) AS VARCHAR) AS made FROM orders""")
def date_parts(t):
    """Parts of a date, and a date made of parts that is null where there is no such day."""
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.date_diff(d.cast("date"), F.lit("1995-01-01").cast("date")).alias("days"),
        F.unix_timestamp(d.cast("timestamp")).alias("seconds"),
        D.date_of_parts(F.year(d), F.month(d), F.col("o_orderkey") % 32).cast("string").alias("made"),
    )


@query("scl17", sql("jobs", "SELECT job, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d %H:%M:%S') AS at, start_ms * 1000000 AS nanos FROM jobs"))
def instants(t):
    return S.jobs(t).select(
        "job",
        F.date_format(D.instant_of_millis("start_ms"), "yyyy-MM-dd HH:mm:ss").alias("at"),
        D.nanos_of_millis("start_ms").alias("nanos"),
    )


@query("scl18", """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS iso, CASE WHEN event_type <> 'error' THEN epoch_us(ts) // 1000 END AS millis FROM events""")
def iso_and_ids(t):
    """ISO text of an instant, and the instant inside a problem id when it is plausible."""
    ms = F.when(F.col("event_type") == "error", F.lit(99_999_999_999).cast("long")).otherwise(F.unix_millis("ts"))
    problem = F.concat(F.lit("P-"), F.col("event_id"), F.lit("_"), ms, F.lit("V2"))
    return t.events.select("event_id", D.iso_utc("ts").alias("iso"), D.millis_in_id(problem).alias("millis"))


@query("scl19", "SELECT p_partkey, pow(p_size, 2) AS square, round(p_retailprice / 7, 2) AS seventh, CAST(floor(p_retailprice) AS BIGINT) AS whole FROM part")
def arithmetic(t):
    return t.part.select(
        "p_partkey",
        F.pow("p_size", F.lit(2)).alias("square"),
        F.round(F.col("p_retailprice") / 7, 2).alias("seventh"),
        F.floor("p_retailprice").alias("whole"),
    )


@query("scl20", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax / nullif(l_discount, 0) AS ratio FROM lineitem")
def safe_ratios(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.ratio("l_tax", "l_discount").alias("ratio"))


@query("scl21", sql("ev", """
SELECT event_id, least(greatest(value - 50, 0), 100) AS clamped, CASE WHEN k > 0 THEN 100.0::DOUBLE * c::DOUBLE / k::DOUBLE END AS percent,
  coalesce(CASE WHEN event_type <> 'view' THEN c END, k) AS watts FROM ev"""))
def guarded(t):
    """Value held in 0..100, share in percent with a guard, and a second measure where the first is missing."""
    rows = t.events.select("event_id", "value", "event_type", N.cents("value").alias("c"), S.props_k().alias("k"))
    return rows.select(
        "event_id",
        N.clamp(F.col("value") - 50).alias("clamped"),
        N.percent("c", "k").alias("percent"),
        F.coalesce(F.when(F.col("event_type") != "view", F.col("c")), "k").alias("watts"),
    )


@query("scl22", """
SELECT event_id, (value - 32.0) * 5.0 / 9.0 AS celsius, value + 273.15::DOUBLE AS kelvin, value + 459.67::DOUBLE AS rankine FROM events""")
def temperatures(t):
    return t.events.select(
        "event_id",
        N.fahrenheit_to_celsius("value").alias("celsius"),
        N.celsius_to_kelvin("value").alias("kelvin"),
        N.fahrenheit_to_rankine("value").alias("rankine"),
    )


@query("scl23", sql("weather", """
SELECT stn, mo, da, CASE WHEN lo = hi THEN 0.5::DOUBLE ELSE (temp - lo)::DOUBLE / (hi - lo)::DOUBLE END AS scaled FROM (
  SELECT *, min(temp) OVER (PARTITION BY year, mo, da) AS lo, max(temp) OVER (PARTITION BY year, mo, da) AS hi FROM weather)"""))
def scaled(t):
    w = S.readings(t)
    group = ["year", "mo", "da"]
    ends = w.groupBy(*group).agg(F.min("temp").alias("lo"), F.max("temp").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    scaled_ = F.when(lo == hi, F.lit(0.5)).otherwise((F.col("temp") - lo) / F.nullif(hi - lo, F.lit(0)))
    return segments.attach(w, ends, group).select("stn", "mo", "da", scaled_.alias("scaled"))


@query("scl24", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q <> 0 THEN n // gcd(n, q) END AS numerator, CASE WHEN q <> 0 THEN q // gcd(n, q) END AS denominator,
  CASE WHEN q <> 0 THEN n::DOUBLE / q::DOUBLE END AS value, n + 1 AS plus_numerator, q + 2 AS plus_denominator
FROM (SELECT *, l_linenumber::BIGINT AS n, CAST(round(l_discount * 100) AS BIGINT) AS q FROM lineitem)""")
def fractions(t):
    """Fractions in lowest terms, as numbers, and added by parts to 1/2, which is not the sum of fractions."""
    rows = spread(t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").cast("long").alias("n"), N.cents("l_discount").alias("q")
    ))
    rows = rows.withColumn("f", N.fraction("n", "q"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("f")[0].alias("numerator"), F.col("f")[1].alias("denominator"), N.ratio("n", "q").alias("value"),
        (F.col("n") + 1).alias("plus_numerator"), (F.col("q") + 2).alias("plus_denominator"),
    )


def turn_texts(t):
    return S.shows(t).select("id", "chunk", F.col("_embedded.episodes").alias("e"), "genres")


@query("scl25", """
SELECT conv_id AS id, turn // 1000 AS chunk, min_by(role, turn) AS first_role, count(*) AS size, count(DISTINCT role) AS roles,
  CASE WHEN count(*) FILTER (role = 'user') > 0 THEN 1 ELSE 0 END AS shared,
  'Comedy,Comedy,Comedy' AS repeated FROM conversations GROUP BY 1, 2""")
def arrays(t):
    wanted = F.array(F.lit("user"), F.lit("nobody"))
    return turn_texts(t).select(
        "id",
        "chunk",
        F.col("e")[0]["role"].alias("first_role"),
        F.size("e").cast("long").alias("size"),
        F.size(F.array_distinct(F.col("e")["role"])).cast("long").alias("roles"),
        F.size(F.array_intersect("genres", wanted)).alias("shared"),
        F.array_join(F.array_repeat(F.lit("Comedy"), 3), ",").alias("repeated"),
    )


@query("scl26", """
SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id, turn // 1000 ORDER BY turn) - 1 AS pos, turn, role, length(text) AS length FROM conversations""")
def exploded(t):
    """Array of structs back to rows with their places."""
    rows = turn_texts(t).select("id", F.posexplode("e").alias("pos", "x"))
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "x.turn", "x.role", F.length("x.text").alias("length"))


@query("scl26_map", """
SELECT event_id, unnest([0, 1]) AS pos, unnest(['type', 'k']) AS key, unnest([event_type, json_extract_string(props, '$.k')]) AS value FROM events""")
def exploded_map(t):
    pairs = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return t.events.select("event_id", F.posexplode(pairs).alias("pos", "key", "value"))


@query("scl27", """
SELECT conv_id AS id, turn // 1000 AS chunk, min_by(length(text), turn)::BIGINT AS first_length, min_by(length(text), turn)::BIGINT AS same, min_by(length(text), turn)::BIGINT AS again
FROM conversations GROUP BY 1, 2""")
def maps(t):
    """Map of two parallel arrays, looked up in three ways."""
    rows = turn_texts(t).select(
        "id", "chunk", F.col("e")[0]["turn"].alias("first"),
        F.map_from_arrays(F.col("e")["turn"], F.transform("e", lambda x: F.length(x["text"]).cast("long"))).alias("m"),
    )
    return rows.select(
        "id", "chunk",
        F.col("m")[F.col("first")].alias("first_length"),
        F.element_at("m", F.col("first")).alias("same"),
        F.try_element_at("m", F.col("first")).alias("again"),
    )


@query("scl28", """
SELECT conv_id AS id, turn // 1000 AS chunk, string_agg(role, ',' ORDER BY turn) AS roles, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1, 2""")
def structs(t):
    """A nested field promoted, a field projected through an array of structs, a struct built anew."""
    rows = S.shows(t).withColumn("episodes", F.col("_embedded.episodes")).drop("_embedded")
    rows = rows.withColumn("last", F.struct(F.element_at("episodes.turn", -1).alias("turn"), F.element_at("episodes.role", -1).alias("role")))
    return rows.select("id", "chunk", F.array_join("episodes.role", ",").alias("roles"), F.col("last.turn").alias("last_turn"), F.col("last.role").alias("last_role"))


@query("scl29", """
SELECT conv_id AS id, turn // 1000 AS chunk, count(*) AS n FROM conversations GROUP BY 1, 2""")
def schema_round_trip(t):
    """A schema written to JSON and read back parses the documents it describes."""
    docs = S.shows(t)
    schema = T.StructType.fromJson(docs.schema.jsonValue())
    parsed = docs.select(F.from_json(F.to_json(F.struct(*docs.columns)), schema).alias("d"))
    return parsed.select("d.id", "d.chunk", F.size("d._embedded.episodes").cast("long").alias("n"))


@query("scl30", sql("ev", """
SELECT event_id, k, CASE WHEN event_type = 'click' THEN 'old-' || k WHEN event_type = 'view' THEN NULL ELSE 'new-' || k END AS pod FROM ev"""))
def nested_json(t):
    """A JSON text inside a JSON text, and a property that goes by one of several keys."""
    key = F.when(F.col("event_type") == "click", F.lit("k8s.pod.name")).when(F.col("event_type") == "view", F.lit("other")).otherwise(F.lit("k8s-pod-name"))
    value = F.concat(F.when(F.col("event_type") == "click", F.lit("old-")).otherwise(F.lit("new-")), S.props_k())
    inner = F.to_json(F.struct(F.array(F.struct(F.create_map(key, value).alias("customProperties"))).alias("rankedEvents"), F.col("props").alias("raw")))
    rows = t.events.select("event_id", F.to_json(F.struct(inner.alias("ProblemDetailsJSON"))).alias("info"))
    outer = F.from_json("info", "ProblemDetailsJSON STRING")
    details = F.from_json(F.col("o.ProblemDetailsJSON"), "rankedEvents ARRAY<STRUCT<customProperties: MAP<STRING, STRING>>>, raw STRING")
    rows = rows.select("event_id", outer.alias("o")).select("event_id", details.alias("d"))
    props = F.col("d.rankedEvents")[0]["customProperties"]
    return rows.select(
        "event_id",
        F.from_json("d.raw", "k BIGINT")["k"].alias("k"),
        F.coalesce(F.try_element_at(props, F.lit("k8s-pod-name")), F.try_element_at(props, F.lit("k8s.pod.name"))).alias("pod"),
    )


@query("scl30_variant", sql("ev", "SELECT event_id, k FROM ev"))
def variant(t):
    """The same property through the open type for JSON."""
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("scl31", sql("tasks", "SELECT stage, task, bytes AS value, CAST(NULL AS BIGINT) AS odd FROM tasks"))
def numbers_in_structs(t):
    """Numbers written as text inside an array of structs; what is no number becomes null."""
    one = lambda name, v: F.struct(F.lit(name).alias("Name"), v.alias("Value"), F.lit("1").alias("Update"))
    acc = F.array(one("bytes", F.col("bytes").cast("string")), one("odd", F.concat(F.lit("x"), F.col("bytes"))))
    rows = S.tasks(t).select("stage", "task", numeric_accumulables(acc).alias("a"))
    return rows.select("stage", "task", F.col("a")[0]["Value"].alias("value"), F.col("a")[1]["Value"].alias("odd"))


@query("scl32", sql("alerts", """
SELECT alert_id, CASE event_type WHEN 'error' THEN 'Svc-' || svc WHEN 'click' THEN 'svc-id-' || svc WHEN 'view' THEN 'Svc.' || svc END AS service,
  CASE WHEN event_type IN ('error', 'click', 'view') THEN signature END AS signature,
  CASE WHEN event_type IN ('error', 'click', 'view') THEN 'CRITICAL_LOG_EVENT' END AS kind FROM alerts"""))
def first_of_patterns(t):
    return S.alerts(t).select(
        "alert_id",
        X.service_stamp("description").alias("service"),
        X.signature_stamp("description").alias("signature"),
        X.kind_stamp("description").alias("kind"),
    )


@query("scl33", sql("alerts", "SELECT alert_id, least(severity, 3) AS more_severe, greatest(severity - 1, 1) AS bumped FROM alerts"))
def severities(t):
    return S.alerts(t).select("alert_id", N.more_severe("severity", F.lit(3)).alias("more_severe"), N.bump("severity").alias("bumped"))
