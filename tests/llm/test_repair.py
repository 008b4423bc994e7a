"""Repair against an exhaustive search for the cheapest edits, whole conversations and in parts."""

import hashlib
import heapq
import random
import zlib

import pytest
from frames import clashing
from pyspark.sql import functions as F

from opswell.llm import queries, repair

CHATS = "conv_id long, turn long, role string, text string"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def plain(rows):
    """Cheapest first search over (rows used, last role); rows: (turn, role, text)."""
    rows = [(t, r or "", x or "") for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if state == "end":
            break
        if i == len(rows) and state in ("", "a"):
            heapq.heappush(queue, (cost, audit, i, "end", out))
        heapq.heappush(queue, (cost + 2, audit + "I", i, NEXT[state], (*out, (NAMES[NEXT[state]], ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "t"):
                more = cost + (faults[i] == "t")
                if role[:1] == NEXT[state] or role[:1] == "s" and state == "":
                    heapq.heappush(queue, (more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                heapq.heappush(queue, (more + 2, audit + "R", i + 1, NEXT[state], (*out, (NAMES[NEXT[state]], text))))
    turns, initials = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in "bdt"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    )


def random_chats(seed, n, longest):
    r = random.Random(seed)
    texts = ["", " \n", "a.", "b", "c!", "déjà?", None, "a. \t"]
    rows = []
    for c in [None, -3, *range(n)]:
        size = r.choice([1, 2, 3, 5, longest])
        for i in range(size):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher", "U"])
            rows.append((c, r.choice([None, i, i, i, i + 1]), role, r.choice([*texts, f"text {i}.", f"text {i}"])))
    return rows


def found(spark, rows, **how):
    frame = spark.createDataFrame(rows, CHATS)
    out = repair.digest(frame, repair.repair(frame, **how))
    assert out.dtypes == [("conv_id", "bigint"), *[(n, "bigint") for n in NUMBERS[:-2]], ("audit", "string"), ("repaired_sha256", "string")]
    got = out.collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[n] for n in NUMBERS) for r in got}


@pytest.mark.parametrize("chunk", [repair.CHUNK, 1, 3])
def test_equals_an_exhaustive_search(spark, chunk):
    rows = random_chats(chunk, 120, 14)
    want = {c: plain([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert found(spark, rows, chunk=chunk) == want


def test_long_conversation_in_parts(spark):
    """Roles that leave many cheapest repairs open over a long stretch; parts give what one part gives."""
    r = random.Random(3)
    rows = [(1, i, r.choice(["user", "user", "assistant"]), f"{i}.") for i in range(3000)]
    assert found(spark, rows, chunk=64) == found(spark, rows)


def test_audits_compare_like_strings_and_survive_equal_hashes():
    r = random.Random(1)
    for factor in (repair.FACTOR, 0):  # with factor 0 all hashes are equal
        audits = repair.Audits(factor)
        nodes = [0]
        for _ in range(12):
            nodes = [audits.add(n, label) for n in nodes[-40:] for label in r.sample(["D", "IK", "IIR", "K", "R"], 2)]
            texts = ["".join(audits.path(n)) for n in nodes]
            for _ in range(100):
                i, j = r.sample(range(len(nodes)), 2)
                if texts[i] != texts[j]:
                    assert audits.less(nodes[i], nodes[j]) == (texts[i] < texts[j])


def test_turns_are_the_repaired_conversation(spark):
    rows = [(5, 0, "system", "s."), (5, 1, "assistant", "a."), (5, 2, "user", "x"), (5, 2, "user", "x"), (6, 0, "tool", "")]
    turns = repair.repair(spark.createDataFrame(rows, CHATS)).turns.orderBy("place", "step").collect()
    assert [(t.edit, t.role, t.text) for t in turns] == [("K", "system", "s."), ("I", "user", ""), ("K", "assistant", "a.")]


def test_damage_by_hash_and_empty_tables(spark, tables):
    given = tables.conversations
    hurt = repair.damage(given)
    fault = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).cast("binary")) % 20
    per = {r.fault: r.n for r in given.groupBy(fault.alias("fault")).agg(F.count("*").alias("n")).collect()}
    assert hurt.count() == given.count() - per.get(0, 0) + per.get(3, 0)
    empty = given.limit(0)
    assert repair.digest(empty, repair.repair(repair.damage(empty))).count() == 0


def test_lost_rows_nulls_and_other_columns(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given = spark.createDataFrame([(dropped, 0, "user", "x."), (None, None, None, None)], CHATS)
    hurt = repair.damage(clashing(given))
    out = {r.conv_id: r for r in repair.digest(given, repair.repair(hurt)).collect()}
    assert (out[dropped].audit, out[dropped].cost, out[dropped].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert set(out) == {dropped, None}


def test_query_keeps_every_conversation(spark, tables):
    out = queries.QUERIES["op11_audit_repair"](spark, tables.folder)
    assert out.count() == tables.conversations.select("conv_id").distinct().count()
