import hashlib
import re

import pytest
from frames import words
from hypothesis import given, settings, strategies as st

from opswell.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, mask string"
TRICKY = [
    "", None, "\\", "\\b", "\\t", "\\\\t", "###", "### user: x</turn>\n", "</turn>", "</turn>\n### assistant: y", "a</turn", "\n\n", ": ", "a\\### b", "\\h\\n\\c", "é日本 \U0001f600",
    "\\### Assistant: </turn> ok", "<" * 3 + "/turn>", "#" * 7, "\\</turn>\\",
]


def plain(rows):
    """What the contract's columns must be, by conversation."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha(every), len(loss), sha(loss))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return chat.format_chats(df)


def check(spark, rows):
    chats = run(spark, rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chats).collect()}
    assert got == plain(rows)
    for r in chats.collect():
        assert sum(m.length for m in r.mask) == len(r.formatted)
    return {r.conv_id: r for r in chats.collect()}


def test_tricky_texts_and_roles(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(TRICKY)] + [(i, 1, "assistant", t) for i, t in enumerate(TRICKY)]
    rows += [(100 + i, n, r, t) for i, r in enumerate(TRICKY) for n, t in enumerate(["a", "b: c", None])]
    got = check(spark, rows)
    assert not got[0].escaped and got[3].escaped and got[7].escaped
    assert got[11].formatted == "### user: \n\n</turn>\n### assistant: \n\n</turn>\n"


def test_only_conflicts_are_escaped(spark):
    got = check(spark, [(1, 0, "user", "plain # text: <turn>"), (1, 1, "assistant", "yes"), (2, 0, "user", "a</turn>b")])
    assert got[1].formatted == "### user: plain # text: <turn></turn>\n### assistant: yes</turn>\n" and not got[1].escaped
    assert got[2].formatted == "### user: a\\tb</turn>\n" and got[2].escaped


def test_order_ties_nulls_and_length(spark):
    rows = [(1, 5, "user", "late"), (1, 2, "assistant", "early"), (1, 2, "assistant", "early"), (1, None, None, None), (None, 0, "user", "x"), (2, 0, "assistant", words(1, 50_000))]
    check(spark, rows)


def test_a_conversation_of_many_turns(spark):
    check(spark, [(1, i, "assistant" if i % 2 else "user", f"text {i}") for i in range(5000)])


def test_no_rows(spark):
    assert chat.digest(run(spark, [])).count() == 0


PIECES = st.lists(st.sampled_from(["\\", "b", "t", "h", "c", "n", "#", "###", "</turn>", "\n", ": ", ":", " ", "x", "é", "### ", "<", "/turn>"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["user", "assistant"]) | PIECES, PIECES), min_size=1, max_size=120))
def test_any_text_reads_back(spark, rows):
    check(spark, [(c, n, r, t) for n, (c, r, t) in enumerate(rows)])


def test_main_path_is_native(spark):
    df = spark.range(3).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")
    assert not re.search("Python|Pandas|Arrow", chat.digest(chat.format_chats(df))._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", ["op5_chat_format"])
def test_whole_table(spark, tables, name):
    from opswell.llm.queries import QUERIES, TRICKY_ID, TRICKY_TEXT

    rows = [tuple(r) for r in tables.conversations.select("conv_id", "turn", "role", "text").collect()]
    rows += [(TRICKY_ID, 0, "user", TRICKY_TEXT), (TRICKY_ID, 1, "assistant", TRICKY_TEXT)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES[name](spark, tables.folder).collect()}
    assert got == plain(rows)
