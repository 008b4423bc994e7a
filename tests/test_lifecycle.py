"""Lifecycle operators against plain Python folds on small hand-made cases."""

import inspect
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opswell import session
from opswell.functions import numbers
from opswell.operators import alerts, lifecycle, nearest, rates, rollups, trees
from opswell.streaming import files


def fold_active(points):
    """The guarded counter one event after the other."""
    active, out = {}, {}
    for key, seq, change in points:
        n = active.get(key, 0)
        active[key] = n + 1 if change > 0 else max(n - 1, 0)
        out[(key, seq)] = active[key]
    return out


def test_active_counts_ignore_orphan_ends(spark):
    rng = random.Random(1)
    points = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i, rng.choice([1, -1])) for i in range(600)]
    df = spark.createDataFrame(points, "k string, seq long, change long").repartition(4)
    got = {(r["k"], r["seq"]): r["active"] for r in lifecycle.active_counts(df, ["k"], ["seq"], "change").collect()}
    assert got == fold_active(points)
    assert min(got.values()) == 0


def test_escalation_is_the_ordered_fold(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randrange(1, 4), rng.randrange(1, 4)) for i in range(300)]
    rows += [("c", 300, 3, 3), ("c", 301, 3, 1), ("c", 302, 2, 3)]
    want, state = {}, {}
    for key, i, impact, urgency in rows:
        if key in state:
            old_impact, old_urgency = state[key]
            urgency = min(max(old_urgency - 1, 1), max(urgency - 1, 1))
            impact = min(old_impact, impact)
        state[key] = (impact, urgency)
        want[i] = (urgency, impact)
    df = spark.createDataFrame(rows, "k string, id long, impact int, urgency int").withColumn("at", F.timestamp_seconds("id"))
    out = alerts.escalate(df, ["k"], "at", "id")
    got = {r["id"]: (r["incident_urgency"], r["incident_impact"]) for r in out.collect()}
    assert got == want


def fold_rates(rows, idle=None):
    """The stateful filter: previous time always moves, values only when time has passed."""
    state, out = {}, {}
    for key, at, seq, v in rows:
        prev = state.get(key)
        if prev is None or (idle is not None and at - prev[0] > idle):
            state[key] = [at, v]
            out[seq] = None
            continue
        gap, rate = at - prev[0], None
        if gap > 0:
            if v is not None and prev[1] is not None and v >= prev[1]:
                rate = (v - prev[1]) / gap
            if v is not None:
                prev[1] = v
        prev[0] = at
        out[seq] = rate
    return out


CASES = [
    ("a", 0, 1, 10), ("a", 10, 2, 30), ("a", 20, 3, None), ("a", 30, 4, 50),  # null measure
    ("a", 40, 5, 5), ("a", 50, 6, 15),  # restart
    ("a", 50, 7, 99), ("a", 60, 8, 25),  # equal time: no rate, value not taken up
    ("a", 1000, 9, 1000), ("a", 1010, 10, 1100),  # silence of more than 300 s
    ("b", 5, 11, None), ("b", 15, 12, 7), ("b", 25, 13, 8),  # first value missing
]


def test_counter_rates_on_the_hard_cases(spark):
    df = spark.createDataFrame(CASES, "k string, at long, seq long, v long").repartition(3)
    for idle in (None, 300):
        out = rates.counter_rates(df, ["k"], "at", "seq", ["v"], idle)
        assert {r["seq"]: r["v_rate"] for r in out.collect()} == fold_rates(CASES, idle)


def test_counter_rates_at_random(spark):
    rng = random.Random(3)
    rows, at = [], {}
    for seq in range(800):
        k = rng.choice(["hot", "hot", "x", "y"])
        at[k] = at.get(k, 0) + rng.choice([0, 1, 5, 400])
        rows.append((k, at[k], seq, rng.choice([None, rng.randrange(1000)])))
    df = spark.createDataFrame(rows, "k string, at long, seq long, v long").repartition(3)
    for idle in (None, 300):
        out = rates.counter_rates(df, ["k"], "at", "seq", ["v"], idle)
        assert {r["seq"]: r["v_rate"] for r in out.collect()} == fold_rates(rows, idle)


def raw(spark, *events):
    rows = [("h", "/e/app-1", json.dumps(e)) for e in events]
    return spark.createDataFrame(rows, "host string, file_path string, line string").withColumn("ingest_ts", F.lit("2024-01-01").cast("timestamp"))


def test_attempts_unknown_events_and_repeated_deliveries(spark):
    stage = lambda attempt, **t: {"Event": "SparkListenerStage" + ("Submitted" if "Submission Time" in t else "Completed"),
                                  "Stage Info": {"Stage ID": 1, "Stage Attempt ID": attempt, "Stage Name": "s", **t}}
    events = [
        stage(0, **{"Completion Time": 50}),  # the end stands before its start in the file
        stage(0, **{"Submission Time": 10}),
        stage(1, **{"Submission Time": 60}),
        stage(1, **{"Completion Time": 90}),
        stage(1, **{"Completion Time": 90}),  # delivered twice
        {"Event": "SparkListenerJobStart", "Job ID": 1, "Submission Time": 5},
        {"Event": "SparkListenerJobEnd", "Job ID": 10, "Completion Time": 99},  # 10 is not 1
        {"Event": "SparkListenerLogStart", "Spark Version": "4"},
        {"Event": "SomethingNew", "x": 1},
    ]
    rows = lifecycle.normalise(raw(spark, *events))
    assert rows.where("class = 'Indeterminable'").count() == 1
    assert rows.where("event LIKE '%LogStart'").count() == 0
    pairs = lifecycle.match(rows).select("class", "duration_ms").collect()
    assert sorted((r["class"], r["duration_ms"]) for r in pairs) == [("Stage", 30), ("Stage", 40)]
    assert [r["service_id"] for r in lifecycle.open_starts(rows).collect()] == ["1"]
    assert lifecycle.deliver_once(rows).count() == rows.count() - 2  # the repeat, and the event that nobody knows


def test_closure_by_the_earliest_ended_ancestor(spark):
    ops = spark.createDataFrame(
        [
            ("app", 1, None, None, 0, 100), ("job", 1, 1, None, 1, 50), ("job", 1, 10, None, 1, None),
            ("task", 1, 1, 7, 2, None), ("task", 1, 1, 8, 2, 30), ("task", 1, 10, 9, 2, None), ("task", 1, 1, 11, 60, None),
            ("app", 2, None, None, 0, None), ("job", 2, 20, None, 5, None),
        ],
        "kind string, app long, job long, task long, start_ms long, end_ms long",
    )
    out = lifecycle.close(ops, {"app": "app", "job": "job"}, {"job": ["app"], "task": ["app", "job"]})
    got = {(r["kind"], r["app"], r["job"], r["task"]): (r["closed_ms"], r["closed_by"]) for r in out.collect()}
    assert got[("task", 1, 1, 7)] == (50, "parent")
    assert got[("task", 1, 1, 8)] == (30, "end")
    assert got[("task", 1, 10, 9)] == (100, "parent")  # Job:1 ending does not close Job:10
    assert got[("task", 1, 1, 11)] == (100, "parent")  # started after its job had ended
    assert got[("job", 1, 10, None)] == (100, "parent")
    assert got[("job", 2, 20, None)] == (None, None)


def test_rollup_of_rollups(spark):
    rows = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 37).alias("ts"), (F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    five = rollups.partials(rows, "ts", 300, ["k"], "v")
    direct = rollups.partials(rows, "ts", 900, ["k"], "v")
    widened = rollups.widen(five, 900, ["k"]).select(direct.columns)
    assert widened.exceptAll(direct).count() == 0 and direct.exceptAll(widened).count() == 0
    assert five.agg(F.sum("n")).first()[0] == 5000


def test_sessions_against_session_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a"]), i, rng.randrange(200_000)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    mine = rollups.sessions(df, ["k"], "ts", "id", 300).select("k", "first_ts", "n")
    theirs = df.groupBy("k", F.session_window("ts", "300 seconds").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).select("k", "first_ts", "n")
    assert mine.exceptAll(theirs).count() == 0 and mine.count() == theirs.count()


def test_newest_lines_in_range(spark):
    rng = random.Random(5)
    lines = [(i, "hot" if rng.random() < 0.6 else "b", rng.randrange(300)) for i in range(500)]
    asks = [(i, rng.choice(["hot", "b", "none"]), lo := rng.randrange(300), lo + rng.randrange(60)) for i in range(60)]
    want = set()
    for a, key, lo, hi in asks:
        found = sorted(((at, i) for i, k, at in lines if k == key and lo <= at <= hi), reverse=True)[:5]
        want |= {(a, i, place + 1) for place, (_, i) in enumerate(found)}
    out = nearest.newest_between(
        spark.createDataFrame(lines, "id long, k string, at long"), "id", "at",
        spark.createDataFrame(asks, "ask long, k string, lo long, hi long"), "ask", "lo", "hi", ["k"], 5,
    )
    assert {(r["ask"], r["id"], r["place"]) for r in out.collect()} == want


def test_closure_of_groups_takes_the_shortest_way(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("x", "y")], "p string, c string")
    got = {(r["ancestor"], r["descendant"]): r["depth"] for r in trees.closure(edges, "p", "c").collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1, ("a", "c"): 1, ("x", "y"): 1, ("b", "d"): 2, ("a", "d"): 2}


def test_unknown_events_are_counted_and_kept_apart(spark):
    line = lambda event, **more: json.dumps({"Event": event, "Timestamp": 1_700_000_000_000, **more})
    rows = [("h", "f", line("SparkListenerNobodyKnows", n=i)) for i in range(25)] + [("h", "f", line("SparkListenerApplicationStart", **{"App ID": "a"}))] * 2
    raw = spark.createDataFrame(rows, "host string, file_path string, line string").withColumn("ingest_ts", F.timestamp_millis(F.lit(0)))
    events = lifecycle.normalise(raw)
    assert [(r["event"], r["n"]) for r in lifecycle.unknown(events).collect()] == [("SparkListenerNobodyKnows", 25)]
    assert lifecycle.deliver_once(events).count() == 1 and lifecycle.flag_matched(events).count() == 2
    assert lifecycle.match(events).count() == 0


def test_deep_trees_rings_and_missing_parents(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    odd = [("x", "gone"), ("y", "x"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("below", "r1"), ("self", "self")]
    df = spark.createDataFrame(chain + odd, "span_id string, parent_id string").repartition(3)
    got = {r["span_id"]: r for r in trees.levels(df).collect()}
    assert all((got[f"n{i}"]["level"], got[f"n{i}"]["root"]) == (i + 1, "n0") for i in range(40))
    assert got["n39"]["path"] == "/".join(f"n{i}" for i in range(40)) and got["n38"]["children"] == 1
    assert (got["y"]["level"], got["y"]["root"], got["y"]["path"]) == (3, "gone", "gone/x/y")
    assert all(got[k]["level"] is None and got[k]["root"] is None and got[k]["path"] is None for k in ("r1", "r2", "r3", "below", "self"))


def paths_to(spans):
    """All paths of each id by its rows (id, parent), None for one that meets a ring."""
    parents = {}
    for i, p in spans:
        parents.setdefault(i, []).append(p)

    def up(i, seen):
        if i in seen:
            return [None]
        if i not in parents:
            return [[i]]
        out = []
        for p in parents[i]:
            out += [[i]] if p is None else [above and [*above, i] for above in up(p, {*seen, i})]
        return out

    return {i: up(i, set()) for i in parents if i is not None}


@pytest.mark.parametrize("again", [False, True])
def test_forests_of_all_shapes(spark, again):
    """Leaves at every height, chains, rings, missing parents, spans without an id, and ids that repeat."""
    r = random.Random(7)
    rows = [("n0", None), ("m0", None), ("lone", None)] + [(f"n{i}", f"n{r.randrange(max(0, i - 40), i)}") for i in range(1, 300)]
    rows += [(f"m{i}", f"m{i - 1}") for i in range(1, 25)] + [(f"leaf{i}", f"m{i}") for i in range(25)]
    rows += [(f"o{i}", f"gone{i % 3}") for i in range(9)] + [("o/x", "o1"), ("r1", "r2"), ("r2", "r1"), ("r3", "r1"), ("r4", "r3"), ("self", "self"), (None, "n0"), (None, None)]
    if again:
        rows += [("m24", "m23"), ("n7", "lone"), ("n0", None), ("o1", "gone1"), ("leaf3", "m3")]
    paths, children = paths_to(rows), Counter(p for _, p in rows)
    want = Counter()
    for i, p in rows:
        for path in paths[i] if i is not None else []:
            want[i, p, path and len(path), path and "/".join(path), path and path[0], children[i]] += 1
    out = trees.levels(spark.createDataFrame(rows, "span_id string, parent_id string").repartition(5))
    assert out.columns == ["span_id", "parent_id", "level", "path", "root", "children"] and dict(out.dtypes)["level"] == "int"
    assert Counter(tuple(x) for x in out.collect()) == want


def test_leaves_take_part_in_no_round(spark, monkeypatch):
    """What is written in between is less than twice the spans, whatever the tree's height."""
    rows = [("a", None)] + [(f"j{i}", "a") for i in range(10)] + [(f"s{i}", f"j{i % 10}") for i in range(100)] + [(f"t{i}", f"s{i % 100}") for i in range(1000)]
    written = []

    def counted(df, *a, settle=trees.session.settle):
        out = settle(df, *a)
        written.append(out.count())
        return out

    monkeypatch.setattr(trees.session, "settle", counted)
    got = trees.levels(spark.createDataFrame(rows, "span_id string, parent_id string")).collect()
    assert len(got) == len(rows) and {x["level"] for x in got} == {1, 2, 3, 4}
    assert sum(written) < 2 * len(rows)


def test_no_spans(spark):
    out = trees.levels(spark.createDataFrame([], "span_id string, parent_id string"))
    assert out.count() == 0


def test_closure_of_a_long_chain_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(55)] + [(100, 101), (101, 100)]
    pairs = trees.closure(spark.createDataFrame(edges, "p int, c int"), "p", "c").collect()
    assert sum(r["ancestor"] < 100 for r in pairs) == 55 * 56 // 2
    assert {(r["ancestor"], r["descendant"]) for r in pairs if r["ancestor"] >= 100} == {(100, 100), (100, 101), (101, 100), (101, 101)}


def test_ways_double(spark, monkeypatch):
    """A chain of 300 links in nine rounds and one that finds nothing, a short cut counting before the long way."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(0, 250)], "p int, c int")
    rounds, kind = [], type(edges)
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, f=kind.checkpoint: rounds.append(1) or f(self, *a))
    pairs = trees.closure(edges, "p", "c").collect()
    assert len(rounds) <= 1 + 10 and len(pairs) == 300 * 301 // 2
    assert all(r["depth"] == (min(r["descendant"], abs(r["descendant"] - 250) + 1) if r["ancestor"] == 0 and r["descendant"] >= 250 else r["descendant"] - r["ancestor"]) for r in pairs)


def test_the_thirtieth_member_can_speak_for_its_group(spark):
    rows = [("g", i, i, "svc" if i == 29 else None, "sig") for i in range(30)]
    got = alerts.inherited(spark.createDataFrame(rows, "g string, created int, tie int, service string, signature string"), "g", "created", "tie", "service", "signature")
    assert [(r["service"], r["member"]) for r in got.collect()] == [("svc", 29)]


def test_matching_keeps_any_id_and_moves_only_what_is_asked_for(spark):
    hexed, near = "0123456789abcdef0123456789abcdef01234567", "0123456789ABCDEF0123456789abcdef01234567"
    rows = [
        (kind, i, f"u{i}", kind + i, "n", f"t{i}", None, hexed, "r", "Job", at)
        for i in (hexed, near, "", "0" * 19, "x") for kind, at in (("Start", 1000), ("Start", 1000), ("End", 3000))
    ]
    schema = "event_kind string, routing_id string, routing_uid string, event_uid string, service_name string, trace_id string, trace_parent_id string, event_id string, realm string, class string, start_millis long"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("start_millis"))
    for on in ("id", "uid"):
        pairs = lifecycle.match(events, on)
        assert pairs.columns == lifecycle.PAIR
        got = sorted((r.trace_id, r.parent_id, r.start_event_id, r.end_event_id, r.duration_ms) for r in pairs.collect())
        assert got == sorted((f"t{i}", None, hexed, hexed, 2000) for i in (hexed, near, "", "0" * 19, "x"))
        few = lifecycle.match(events, on, ["trace_id", "duration_ms"])
        assert sorted(few.collect()) == sorted(pairs.select("trace_id", "duration_ms").collect())
        grouping = [line for line in few._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
        assert len(grouping) == 1 and "trace_id" in grouping[0] and "service_name" not in grouping[0]


@pytest.mark.parametrize("name, scans", [("joi14", 2), ("joi15", 2), ("str01", 2), ("str07_stream", 0), ("scl31", 1)])
def test_line_items_are_read_and_moved_once_per_kind(name, scans, spark):
    """A start and an end come from one pass, and order lines meet their order where they were grouped."""
    from opswell.plans import load

    if not scans:  # its stream has run by then; its rows are made of operations
        from opswell.sources import standins
        from opswell.sources.tables import Tables

        plan, scans = standins.operations(Tables(spark, "/root/testdata/sf0.001")), 2
    else:
        plan = load()[name](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet .*lineitem.parquet", text)) == scans
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", text)) == scans


def test_stages_and_tasks_share_one_move_of_lines_and_of_orders(spark):
    from opswell.plans import load

    rows = load()["str01"](spark, "/root/testdata/sf0.001")
    rows.collect()
    ran = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in ran.splitlines() if "Exchange hashpartitioning(l_orderkey" in line]
    assert ["Reused" in line for line in moved] in ([False, True], [True, False])


def test_dealt_lines_hold_what_the_given_ones_do(spark, tmp_path):
    """Lines that do not fit one number, and those at its bounds."""
    from opswell.sources import standins
    from opswell.sources.tables import SCHEMAS, Tables

    usual = [(1, 10, 2, 255, 999.9, 9999999999.99, "F"), (1, 11, 2, 0, 0.0, 0.0, "O"), (2, 2**62, 2, 7, 49.0, 24386.67, None), (2, -5, 2, 1, 1.0, 0.005, "A")]
    odd = [(3, 1, 2, 256, 1.0, 1.0, "F"), (3, 1, 2, -1, 1.0, 1.0, "F"), (3, 1, 2, None, 1.0, 1.0, "O"), (3, 1, 2, 1, -1.0, 1.5, "F"), (3, 1, 2, 2, 1000.0, 1e10, "F"), (4, None, 2, 3, None, -7.25, "f"), (4, 1, 2, 3, 5.0, None, "")]
    nan = [(5, 1, 2, 3, 2.0, float("nan"), "F")]  # its cents cannot be told, as before; the rest can
    rows = [(o, p, s, n, q, e, 0.0, 0.0, "N", st, None) for o, p, s, n, q, e, st in usual + odd + nan]
    spark.createDataFrame(rows, SCHEMAS["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    dealt = standins.order_lines(Tables(spark, str(tmp_path)))
    got = dealt.select("l_orderkey", "l_partkey", *[standins.line(c).alias(c) for c in ("number", "quantity", "place")]).collect()
    place = lambda st: 0 if st is None else 2 if st == "F" else 1 if st < "F" else 3
    none_first = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))
    want = [(o, p, n, None if q is None else int(q // 1), place(st)) for o, p, s, n, q, e, st in usual + odd + nan]
    assert none_first(map(tuple, got)) == none_first(want)
    cents = dealt.where("l_orderkey < 5").select("l_orderkey", "l_partkey", standins.line("cents").alias("c")).collect()
    direct = spark.createDataFrame(rows[:-1], SCHEMAS["lineitem"]).select("l_orderkey", "l_partkey", numbers.cents("l_extendedprice").alias("c")).collect()
    assert none_first(map(tuple, cents)) == none_first(map(tuple, direct))


def test_numbers_as_text_give_what_a_cast_gives(spark):
    """Text that is no number is told by its signs, before a cast would fail on it row by row."""
    texts = ["12", "-7", "+7", " 5 ", "\t\n9\r", "\x00\x1f3\x7f", "x12", "", " ", "+", "1.5", "1e3", "9223372036854775807", "9223372036854775808", "1 2", "٣", "12 ", " 5", "007", "1L", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", F.col("t").try_cast("long").alias("cast"), numbers.whole_number("t").alias("n")).collect()
    assert all(r["cast"] == r["n"] for r in got) and sum(r["n"] is not None for r in got) >= 7
    acc = F.array(F.struct(F.lit("n").alias("Name"), F.col("t").alias("Value"), F.lit("1").alias("Update")))
    plan = rows.select(lifecycle.numeric_accumulables(acc).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("RLIKE") == plan.count("try_cast") == 2


def test_the_name_of_an_event_is_extracted_once(spark):
    """Neither the filters on the name nor the join with the forms extract it again."""
    lines = ['{"Event":"SparkListenerJobEnd","Job ID":7,"Completion Time":5}', '{"Event":""}', '{"Event":"SparkListenerLogStart"}', '{"x":1, "Event" : "Other"}', "no event", None]
    raw = spark.createDataFrame([("h", "/p", x) for x in lines], "host string, file_path string, line string").withColumn("ingest_ts", F.timestamp_millis(F.lit(1)))
    for kind, names in ((None, ["Other", "SparkListenerJobEnd"]), ("End", ["SparkListenerJobEnd"])):
        rows = lifecycle.normalise(raw, kind)
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
        assert sorted(r["event"] for r in rows.collect()) == names


def test_a_task_gets_no_more_order_lines_when_the_input_grows(spark, tmp_path):
    """Partitions follow the splits of the files where these ask for more than the setting does."""
    from opswell.sources import standins
    from opswell.sources.tables import SCHEMAS, Tables

    rows = [(i, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "F", None) for i in range(40)] + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "F", None)]
    spark.createDataFrame(rows, SCHEMAS["lineitem"]).repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    t, held = Tables(spark, str(tmp_path)), spark.conf.get("spark.sql.shuffle.partitions")
    splits = t.lineitem.rdd.getNumPartitions()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        dealt = standins.order_lines(t)
        assert dealt.rdd.getNumPartitions() == 4 * splits > 1 and dealt.count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_parts_of_a_replay_are_written_without_sorting(spark, tmp_path):
    """As many files may be open as a replay has parts, so a task need not sort its rows by part."""
    session.tune(spark)
    spark.range(20).select("id", (F.col("id") % 6).alias("_slice")).write.partitionBy("_slice").parquet(f"{tmp_path}/parts")
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > inspect.signature(files.replayed).parameters["slices"].default
    assert spark.read.parquet(f"{tmp_path}/parts").groupBy("_slice").count().count() == 6
