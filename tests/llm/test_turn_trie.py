"""The trie against counting every beginning in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from opswell.llm import radix, turn_trie

CHATS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + t[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def found(spark, rows, **how):
    out = turn_trie.trie(turn_trie.rebuilt(spark.createDataFrame(rows, CHATS)), **how)
    assert out.columns == list(COLUMNS)
    return sorted(tuple(-99 if r[c] is None else r[c] for c in COLUMNS) for r in out.collect())


def chats(seed, n, texts, longest):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.15:  # so some have no conversation to share turns with
            continue
        for t in range(r.choice([1, 2, 4, longest])):
            rows.append((c, None if t == 0 and r.random() < 0.3 else t, r.choice(["user", "assistant", None]), r.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [turn_trie.BLOCK_KEYS, 1, 7])
def test_equals_plain_counts(spark, block):
    rows = chats(block, 300, ["", None, "a", "é", "long " * 50], 12)
    rows += [(c, t, "user", "same") for c in range(1000, 3200) for t in range(3)]  # copies, more than one string of ids holds
    assert found(spark, rows, block=block) == plain(rows)


def test_long_conversations_nulls_and_empty_tables(spark):
    rows = [(5 * c, t, "user", f"t{t}") for c in range(3) for t in range(2000 + c)]
    assert found(spark, rows, block=1) == plain(rows)
    assert found(spark, rows + [(None, 1, "user", "x"), (None, None, None, None)]) == plain(rows)
    assert found(spark, [(1, 0, "user", "x")][:0]) == []


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert found(spark, [(c, 0, "user", "x")]) == [(c, 0, -99, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_tree_layouts_grow_and_keep_every_key():
    r = random.Random(2)
    for kinds in (2, 5, 20, 60, 256):
        keys = list({bytes(r.randrange(kinds) for _ in range(r.choice([0, 3, 6]))) for _ in range(2000)})
        r.shuffle(keys)
        seen, stack, widest = [], [(radix.tree((k, k) for k in keys), b"")], None
        while stack:
            node, before = stack.pop()
            if node.entry is not None:
                assert node.entry == before + node.path
                seen.append(node.entry)
            children = list(node.items())
            assert [m for m, _ in children] == sorted(m for m, _ in children)
            assert len(children) != 1 or node.entry is not None or before + node.path == b""
            if len(children) > 48:
                widest = type(node.children)
            stack += [(n, before + node.path + bytes([m])) for m, n in children]
        assert sorted(seen) == sorted(keys)
        assert (widest is radix.Direct) == (kinds > 48)
