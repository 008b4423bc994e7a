"""Streams whose state must go, and sinks that must hold each row once whatever fails."""

import datetime
import random
import re
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from opswell.operators import rates
from opswell.session import scratch
from opswell.sources import keyed as keyed_tables
from opswell.sources.keyed import KeyedTable, Routes
from opswell.streaming import jobs

COUNTERS = "host string, seq long, at_s long, v long, w long"


def fed(spark, batches, schema, build, mode="append"):
    """Runs the stream after each batch; the rows it put out, and its checkpoint."""
    source, out, state = (scratch(spark, n) for n in ("in", "out", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), state


def held(spark, state):
    return {r.key.host: r.value.at for r in spark.read.format("statestore").option("stateVarName", "last").load(state).collect()}


def test_state_of_a_silent_key_goes(spark):
    build = lambda s: jobs.counter_rates(s, ["host"], "at_s", "seq", ["v", "w"], 300)
    first = [("a", 1, 1000, 5, None), ("b", 2, 1000, 7, 1), ("a", 3, 1100, 15, 2)]
    _, state = fed(spark, [first], COUNTERS, build)
    assert held(spark, state) == {"a": 1100, "b": 1000}
    # b is silent for more than 300 s when a goes on; its state is dropped, not kept as an old one.
    second = [("a", 4, 1303, 25, 4)]
    _, state = fed(spark, [first, second], COUNTERS, build)
    assert held(spark, state) == {"a": 1303}
    out, state = fed(spark, [first, second, [("a", 5, 1303, 26, 5), ("b", 6, 1304, 9, 3)]], COUNTERS, build)
    assert held(spark, state) == {"a": 1303, "b": 1304}
    got = {r.seq: (r.v_rate, r.w_rate) for r in out.collect()}
    none = (None, None)
    assert got == {1: none, 2: none, 3: (0.1, None), 4: (10 / 203, 2 / 203), 5: none, 6: none}


def test_rates_over_batches_equal_the_batch_form(spark):
    r = random.Random(1)
    rows, at = [], {}
    for seq in range(600):
        host = r.choice("abcde")
        at[host] = at.get(host, 1000) + r.choice([0, 0, 10, 60, 300, 301, 900])
        rows.append((host, seq, at[host], r.choice([None, seq * 10, 3]), r.choice([None, seq, 2**60 + seq])))
    rows.sort(key=lambda x: (x[2], x[1]))
    times = sorted({x[2] for x in rows})
    cuts = [times[len(times) * i // 5] for i in range(5)] + [times[-1] + 1]
    batches = [[x for x in rows if a <= x[2] < b] for a, b in zip(cuts, cuts[1:])]
    out, _ = fed(spark, batches, COUNTERS, lambda s: jobs.counter_rates(s, ["host"], "at_s", "seq", ["v", "w"], 300))
    want = rates.counter_rates(spark.createDataFrame(rows, COUNTERS), ["host"], "at_s", "seq", ["v", "w"], 300)
    row = lambda x: (x.host, x.seq, x.v_rate, x.w_rate)
    assert sorted(map(row, out.collect()), key=lambda x: x[1]) == sorted(map(row, want.collect()), key=lambda x: x[1])


EVENTS = "class string, service_id string, event_kind string, event_uid string, start_event_uid string, start_millis long, ts timestamp"


def events(spark, *rows):
    """(kind, id, seconds)"""
    return [("Job", i, kind, f"{kind}:{i}", f"Start:{i}" if kind == "End" else None, s * 1000, datetime.datetime.fromtimestamp(s)) for kind, i, s in rows]


def test_open_starts_wait_for_late_ends(spark):
    build = lambda s: jobs.open_starts(s, s, "10 seconds", "100 seconds")
    batches = [
        events(spark, ("Start", "a", 1000), ("Start", "b", 1001), ("Start", "c", 1002)),
        events(spark, ("End", "a", 1050), ("Start", "d", 1060)),
        events(spark, ("End", "b", 1090), ("Start", "e", 1095)),  # late, but still in time
        events(spark, ("End", "x", 5000), ("Start", "y", 5000)),
    ]
    names = lambda n: sorted(r.service_id for r in fed(spark, batches[:n], EVENTS, build)[0].collect())
    assert names(3) == []
    assert names(4) == ["c", "d", "e"]


def starts_held(spark, state):
    """Starts that the groups of a stream hold after its last batch."""
    tables = [pa.ipc.open_stream(bytes(r.value.rows)).read_all() for r in spark.read.format("statestore").option("stateVarName", "held").load(state).collect()]
    return sorted(row["uid"] for t in tables for row in t.to_pylist() if row["is_start"])


def test_a_start_whose_end_has_come_is_not_kept(spark):
    """An end may come longest after its start; until then the state would hold every operation there was."""
    build = lambda s: jobs.open_starts(s, s, "10 seconds", "100000 seconds")
    batches = [events(spark, ("Start", "a", 1000), ("Start", "b", 1001), ("End", "a", 1002)), events(spark, ("End", "b", 1010), ("Start", "c", 1011), ("End", "c", 1012), ("Start", "d", 1013))]
    assert starts_held(spark, fed(spark, batches[:1], EVENTS, build)[1]) == ["Start:b"]
    assert starts_held(spark, fed(spark, batches, EVENTS, build)[1]) == ["Start:d"]


def test_each_pair_comes_once_whichever_batch_its_sides_come_in(spark):
    """Repeated starts and ends, ends before their starts' batch, missing keys and times, and times that pandas does not have."""
    r = random.Random(3)
    rows = [(r.choice(["Start", "End"]), r.choice("abcdefgh"), r.randrange(0, 900)) for _ in range(160)]
    batches = [events(spark, *rows[i : i + 40]) for i in range(0, 160, 40)]
    none = [("Job", "x", "Start", None, None, 5000, datetime.datetime.fromtimestamp(5)), ("Job", "x", "End", None, None, 5000, datetime.datetime.fromtimestamp(5)), ("Job", "y", "Start", "Start:y", None, None, None)]
    far = [("Job", "z", kind, f"{kind}:z", "Start:z" if kind == "End" else None, ms, datetime.datetime(9999, 12, 1, 0, 0, s)) for kind, ms, s in (("Start", 7, 1), ("End", 2**60 + 1, 2))]
    batches = [batches[0] + none, *batches[1:], far]
    out, _ = fed(spark, batches, EVENTS, lambda s: jobs.match(s.withColumn("trace_id", F.concat(F.lit("t"), "service_id")), s, "1000 seconds", "100 seconds"))
    assert out.columns == ["trace_id", "class", "start_ms", "end_ms", "duration_ms"]
    want = [("t" + i, "Job", s * 1000, e * 1000, (e - s) * 1000) for k, i, s in rows for k2, i2, e in rows if (k, k2) == ("Start", "End") and i == i2 and s <= e <= s + 100]
    assert len(want) > 50 and sorted(map(tuple, out.collect())) == sorted([*want, ("tz", "Job", 7, 2**60 + 1, 2**60 - 6)])


def test_pairs_wait_in_one_table_for_each_group(spark, monkeypatch):
    """The state has an entry for each group of keys, not some for each row."""
    monkeypatch.setattr(jobs, "BUCKETS", 2, raising=False)
    batch = events(spark, *[("Start", f"{i}", 1000 + i) for i in range(50)])
    _, state = fed(spark, [batch], EVENTS, lambda s: jobs.match(s.withColumn("trace_id", F.col("service_id")), s, "1000 seconds", "100 seconds"))
    assert len(starts_held(spark, state)) == 50
    assert spark.read.format("statestore").option("stateVarName", "held").load(state).count() == 2


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


@pytest.mark.parametrize("at_a_time", [1, 3, 100_000])
def test_a_group_is_read_and_written_once_and_gives_its_rows_in_parts(monkeypatch, at_a_time):
    monkeypatch.setattr(jobs, "AT_A_TIME", at_a_time)
    handle, r = _Held(), random.Random(at_a_time)
    for unmatched in (False, True):
        group = jobs._Meeting(1, unmatched)
        group.init(handle)
        handle.key, seen, found = unmatched, [], []
        for batch in range(4):
            new = [(r.random() < 0.5, r.choice([None, "a", "b"]), r.randrange(50) * 10**6, str(batch * 100 + i)) for i in range(30)]
            frame = pd.DataFrame([(s, u, at, at + 20 * 10**6 if s else 0, n) for s, u, at, n in new], columns=["is_start", "uid", "at", "until", "c0"])
            # Nothing is late before the last batch; then the watermark is past all.
            parts = list(group.handleInputRows((0,), iter([frame[:13], frame[13:]]), _At(-1 if batch < 3 else 10**9)))
            assert not unmatched or batch == 3 or not parts
            found += [row for p in parts for row in p.itertuples(index=False)]
            seen += new
        assert handle.key not in handle.rows and not handle.timers
        met = [(s, e) for s in seen for e in seen if s[0] and not e[0] and s[1] is not None and s[1] == e[1] and s[2] <= e[2] <= s[2] + 20 * 10**6]
        want = [(s[3],) for s in seen if s[0] and s not in {m[0] for m in met}] if unmatched else [(s[3], e[3]) for s, e in met]
        assert sorted(map(tuple, found)) == sorted(want) and len(want) > 3


def test_a_start_is_put_out_by_its_groups_timer():
    handle, group = _Held(), jobs._Meeting(1, True)
    group.init(handle)
    rows = pd.DataFrame([(True, "a", 0, 5_000_000, "1"), (True, "b", 0, 9_000_001, "2"), (False, "c", 0, 0, "")], columns=["is_start", "uid", "at", "until", "c0"])
    assert list(group.handleInputRows((0,), iter([rows]), _At(-1))) == [] and handle.timers == {(None, 5000)}
    handle.timers.clear()  # as Spark does
    assert [list(p["c0"]) for p in group.handleExpiredTimer((0,), _At(5000), _At(5000))] == [["1"]] and handle.timers == {(None, 9001)}
    handle.timers.clear()
    assert [list(p["c0"]) for p in group.handleExpiredTimer((0,), _At(9001), _At(9001))] == [["2"]] and not handle.timers and not handle.rows


ROWS = "id string, seq long, v string"


def keyed(spark, **how):
    return KeyedTable(spark, scratch(spark, "keyed"), "id", ["seq"], **how)


def content(table):
    rows = table.read()
    return {} if rows is None else {r.id: (r.seq, r.v) for r in rows.collect()}


class Stopped(Exception):
    pass


def stop_at(name):
    def fail(step):
        if step == name:
            raise Stopped

    return fail


@pytest.mark.parametrize("step", ["data", "draft", "version"])
def test_a_stopped_write_leaves_the_old_or_the_new_table(spark, step):
    table = keyed(spark)
    table.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], ROWS), 0, "s")
    before, more = content(table), spark.createDataFrame([("a", 2, "y"), ("c", 1, "y")], ROWS)
    with pytest.raises(Stopped):
        table.upsert(more, 1, "s", stop_at(step))
    after = {"a": (2, "y"), "b": (1, "x"), "c": (1, "y")}
    assert content(table) == (after if step == "version" else before)
    # The stream delivers the batch again.
    assert table.upsert(more, 1, "s") == (step != "version")
    assert content(table) == after
    assert not table.upsert(spark.createDataFrame([("a", 9, "z")], ROWS), 1, "s") and content(table) == after
    assert table.upsert(spark.createDataFrame([("a", 9, "z")], ROWS), 1, "another stream") and content(table)["a"] == (9, "z")


def test_buckets_split_as_they_grow_and_untouched_ones_stay(spark):
    table = keyed(spark, rows_per_bucket=50, first_bits=1)
    want = {}
    for batch in range(4):
        rows = [(f"k{i % (100 + 200 * batch)}", batch * 1000 + i, f"{batch}") for i in range(300)]
        table.upsert(spark.createDataFrame(rows, ROWS), batch)
        want |= {k: (s, v) for k, s, v in rows}
        assert content(table) == want
        assert all(b["rows"] <= 50 for b in table.state()["buckets"])
    folders = {b["folder"] for b in table.state()["buckets"]}
    table.upsert(spark.createDataFrame([("k1", 10**6, "last")], ROWS))
    assert len(folders - {b["folder"] for b in table.state()["buckets"]}) <= 2
    table.upsert(spark.createDataFrame([("k1", 5, "older"), ("k1", 6, "older")], ROWS))
    assert content(table)["k1"] == (10**6, "last")


def test_two_writers_of_one_version_and_empty_updates(spark):
    table = keyed(spark)
    assert table.read() is None
    table.upsert(spark.createDataFrame([], ROWS), 0)
    assert content(table) == {}
    first = spark.createDataFrame([("a", 1, "x")], ROWS)
    with pytest.raises(FileExistsError):
        table.upsert(first, fail=lambda step: table.upsert(first) if step == "draft" else None)
    assert content(table) == {"a": (1, "x")}


def test_a_stream_into_a_keyed_table_goes_on_after_a_restart(spark):
    table, source, state = keyed(spark), scratch(spark, "in"), scratch(spark, "progress")
    for batch in range(5):
        spark.createDataFrame([("a", batch, f"{batch}"), (f"k{batch}", 0, "")], ROWS).write.mode("append").parquet(source)
        table.follow(spark.readStream.schema(ROWS).parquet(source), state, "s").trigger(availableNow=True).start().awaitTermination()
    assert content(table) == {"a": (4, "4"), **{f"k{i}": (0, "") for i in range(5)}}
    assert table.state()["batches"] == {"s": 4}


def routes(spark):
    return Routes(spark, scratch(spark, "routes"), {"even": F.col("seq") % 2 == 0, "big": F.col("seq") > 5, "none": F.lit(False)})


def sinks(found):
    return {s: sorted(r.seq for r in found.read(s, ROWS).collect()) for s in ("even", "big", "none", "other")}


@pytest.mark.parametrize("sink", ["even", "big", "none", "other"])
def test_each_row_is_once_in_the_sinks_its_rules_name(spark, sink):
    found = routes(spark)
    rows = spark.createDataFrame([("a", i, "") for i in range(9)], ROWS)
    found.write(rows.where("seq < 3"), 0)
    with pytest.raises(Stopped):
        found.write(rows.where("seq >= 3"), 1, stop_at(sink))
    found.write(rows.where("seq >= 3"), 1)
    found.write(rows.where("seq >= 3"), 1)
    assert sinks(found) == {"even": [0, 2, 4, 6, 8], "big": [6, 7, 8], "none": [], "other": [1, 3, 5]}


def test_a_stream_to_several_sinks_goes_on_after_a_restart(spark):
    found, source, state = routes(spark), scratch(spark, "in"), scratch(spark, "progress")
    for batch in range(3):
        spark.createDataFrame([("a", i, "") for i in range(batch * 3, batch * 3 + 3)], ROWS).write.mode("append").parquet(source)
        found.follow(spark.readStream.schema(ROWS).parquet(source), state).trigger(availableNow=True).start().awaitTermination()
    assert sinks(found) == {"even": [0, 2, 4, 6, 8], "big": [6, 7, 8], "none": [], "other": [1, 3, 5]}


class _Held:
    """The state of one key after the other, in place of the one that Spark keeps."""

    def __init__(self):
        self.rows, self.key, self.timers = {}, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.rows.get(self.key)

    def exists(self):
        return self.key in self.rows

    def update(self, row):
        self.rows[self.key] = row

    def clear(self):
        self.rows.pop(self.key)

    def registerTimer(self, at):
        self.timers.add((self.key, at))

    def deleteTimer(self, at):
        self.timers.remove((self.key, at))


def test_many_keys_with_few_rows_are_folded_row_by_row():
    """A key's fold must not cost tens of milliseconds: a batch has as many keys as the table has hosts."""
    names = [f"m{i}" for i in range(8)]
    handle, fold = _Held(), jobs._Rates(["host"], "at", "seq", names, 300)
    fold.init(handle)
    row = Row("host", "at", "seq", *names)
    begun = time.process_time()
    for key in range(2000):
        handle.key = key
        first = list(fold.handleInputRows((key,), iter([row(key, 100, 2, *[7] * 8), row(key, 90, 1, *[None, *[2] * 7])]), None))
        then = list(fold.handleInputRows((key,), iter([row(key, None, 4, *[1] * 8), row(key, 110, 3, *[8] * 8)]), None))
        assert [r.seq for r in first] == [1, 2] and first[1].m0_rate is None and first[1].m1_rate == 0.5
        # A row without a time ends what was before, as in the batch form.
        assert [(r.seq, r.m0_rate) for r in then] == [(4, None), (3, None)]
    assert time.process_time() - begun < 10
    assert handle.timers == {(k, 410_001) for k in range(2000)} and set(handle.rows.values()) == {(110, *[8] * 8)}


def test_a_batch_is_moved_once_into_its_buckets(spark, monkeypatch):
    """Old and new rows are dealt by bucket and grouped by key where they then are."""
    plans, plain = [], keyed_tables.newest

    def spied(*given):
        out = plain(*given)
        plans.append(re.findall(r"Exchange hashpartitioning\((\w+)", out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(keyed_tables, "newest", spied)
    table = keyed(spark)
    table.upsert(spark.createDataFrame([(f"k{i}", 1, "x") for i in range(50)], ROWS))
    table.upsert(spark.createDataFrame([(f"k{i}", n, "y") for i in range(40) for n in (2, 3)], ROWS))
    assert plans == [["id"], ["id"], ["bucket"]]
    assert content(table) == {f"k{i}": (3, "y") if i < 40 else (1, "x") for i in range(50)}
