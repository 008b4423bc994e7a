"""Prefix trie of conversations: radix trees over sorted blocks of keys, joined where they border on each other.

A turn is an id of fixed width, a conversation the string of its ids. Equal
conversations are counted first; the distinct ones are range-sorted, so a beginning
that very many share spreads over many blocks. A block's tree knows everything about
its nodes but those on the paths to its first and last key; these few rows meet by a
hash of their prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from opswell.llm.radix import Node, common, tree
from opswell.llm.repair import CRC, CRC_TABLE
from opswell.llm.streams import emitted
from opswell.session import settle

#: Bytes of a turn's id: its text's size, big-endian, and a hash of role and text.
SIZE_BYTES, HASH_BYTES = 4, 16
WIDTH = SIZE_BYTES + HASH_BYTES
#: A tree is built over so many keys, or so many bytes of keys and one key more.
BLOCK_KEYS, BLOCK_BYTES = 20_000, 16 << 20
#: Conversations of one key whose ids are joined to one string, as bits of conv_id.
ID_BITS = 10
#: A conversation shares turns with the one at the next lower multiple of SHARED, below SPAN of them.
SHARED, SPAN = 5, 9

NODES = pa.schema(
    [
        ("border", pa.bool_()), ("chain", pa.int64()), ("depth", pa.int64()), ("length", pa.int64()), ("prefix", pa.binary()), ("size", pa.int64()),
        ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ]
)
NODE_COLUMNS = (
    "border boolean, chain long, depth long, length long, prefix binary, size long, conv_id long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def _size(key: bytes, depth: int) -> int:
    """Bytes of the last text of the key's first `depth` turns; the root has none."""
    return int.from_bytes(key[(depth - 1) * WIDTH : (depth - 1) * WIDTH + SIZE_BYTES], "big") if depth else 0


class Count:
    """What is known of a node, or of what hangs below one."""

    __slots__ = ("n", "least", "children", "leaves", "saved", "ends", "key", "open_rows")

    def __init__(self):
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.key, self.open_rows = None, None, []

    def take(self, other: Count):
        self.n += other.n
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.key = other.key
        # The longer list takes the shorter one.
        if len(self.open_rows) < len(other.open_rows):
            self.open_rows, other.open_rows = other.open_rows, self.open_rows
        self.open_rows += other.open_rows


def _block_rows(entries: list[tuple[bytes, int, int, str]], chain: int) -> Iterator[tuple]:
    """Rows of NODES for a block of sorted keys: (key, members, smallest member, hash of members).

    Nodes on the paths to the first and the last key are border rows, by chain and
    depth; they hold what hangs directly below them in this block. The others are
    whole. A whole node below a border node names it by chain and depth instead of
    its conversation.
    """
    first, last = entries[0][0], entries[-1][0]
    border: dict[tuple[int, int], Count] = {}
    # (node, bytes before it, bytes shared with the first and last key up to there, its sum, whose sum it goes to)
    order: list[tuple[Node, int, int, int, Count, Count | None]] = []
    stack = [(tree((e[0], e) for e in entries), 0, 0, 0, b"", None)]
    while stack:
        node, start, with_first, with_last, mark, above = stack.pop()
        run = mark + node.path
        if with_first == start:
            with_first += common(run, first, start)
        if with_last == start:
            with_last += common(run, last, start)
        own = Count()
        order.append((node, start, with_first, with_last, own, above))
        end = start + len(run)
        stack += [(child, end, with_first, with_last, bytes([m]), own) for m, child in node.items()]
        if not mark:  # the root stands at no byte; every other node begins after its parent's end
            order[-1] = (node, -1, with_first, with_last, own, above)
        node.path = run
    # Children come after their parents, so the way back sees them first.
    for node, start, with_first, with_last, sums, above in reversed(order):
        end = max(start, 0) + len(node.path)
        if node.entry is not None:
            key, n, least, ends = node.entry
            sums.n, sums.least, sums.ends, sums.key = sums.n + n, least if sums.least is None else min(sums.least, least), ends, key
        for at in range(end // WIDTH * WIDTH, start, -WIDTH):
            depth = at // WIDTH
            up = Count()
            up.n, up.least, up.key = sums.n, sums.least, sums.key
            if at <= max(with_first, with_last):
                side = 0 if at <= with_first else 1
                border[side, depth] = sums
                for row in sums.open_rows:
                    yield (False, chain + side, *row[:1], None, None, None, row[1], None, *row[2:])
            else:
                saved = sums.saved + (sums.n - 1) * _size(sums.key, depth)
                leaves = sums.leaves if sums.children else 1
                for row in sums.open_rows:
                    yield (False, None, *row[:1], None, None, None, row[1], sums.least, *row[2:])
                up.children, up.leaves, up.saved = 1, leaves, saved
                up.open_rows = [(depth, sums.least, sums.n, sums.children, leaves, saved, sums.ends)]
            sums = up
        if above is not None:
            above.take(sums)
    shared = common(first, last) // WIDTH
    for side, key in ((0, first), (1, last))[: 1 if first == last else 2]:
        length, seen = len(key) // WIDTH, hashlib.sha256()
        for depth in range(length + 1):
            seen.update(key[(depth - 1) * WIDTH : depth * WIDTH] if depth else b"")
            c = border[side, depth] if side == 0 or depth > shared else Count()
            yield True, chain + side, depth, length, seen.copy().digest()[:HASH_BYTES], _size(key, depth), c.least, None, c.n, c.children, c.leaves, c.saved, c.ends


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, str]]:
    """(key, members, smallest member, hash of the members' ids) of rows sorted by key and ids."""
    key, n, least, seen = None, 0, None, None
    for batch in batches:
        for k, count, low, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "least", "ids"))):
            if seen is not None and k == key:
                seen.update(b"," + ids.encode())
                n, least = n + count, min(least, low)
                continue
            if seen is not None:
                yield key, n, least, seen.hexdigest()
            key, n, least, seen = k, count, low, hashlib.sha256(ids.encode())
    if seen is not None:
        yield key, n, least, seen.hexdigest()


def _trees(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            chain, block, held = TaskContext.get().partitionId() << 32, [], 0
            for entry in _distinct(batches):
                if len(block) >= most or held >= BLOCK_BYTES:
                    yield from _block_rows(block, chain)
                    chain, block, held = chain + 2, [], 0
                block.append(entry)
                held += len(entry[0])
            if block:
                yield from _block_rows(block, chain)

        yield from emitted(rows(), NODES)

    return run


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id and ids (hex strings) of the rebuilt turns of each conversation.

    rows: conv_id, turn, role, text. A conversation c has the first h turns of the
    conversation c - c % 5, then its own after its first h; h = crc32(c) % 9. Turns
    stand by turn (nulls first), rows of one turn by size and hash of their text.
    Null roles and texts are empty. Rows with a null conv_id belong to no
    conversation and are left out; a remainder has the sign of c.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    size = F.lpad(F.hex(F.octet_length(text)), 2 * SIZE_BYTES, "0")
    turn_id = F.concat(size, F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * HASH_BYTES))
    turns = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", turn_id.alias("id"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id")))["id"].alias("own"))
    whole = whole.select("*", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SPAN).cast("int").alias("h"))
    heads = whole.filter("conv_id = base").select("base", F.slice("own", 1, SPAN - 1).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    own = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return whole.join(heads, "base", "left").select("conv_id", F.concat(head, own).alias("ids"))


def trie(conversations: DataFrame, block: int = BLOCK_KEYS) -> DataFrame:
    """A row for each distinct beginning of the conversations (conv_id, ids: hex strings of WIDTH bytes).

    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. conv_id and depth name a node. Conversations
    without turns are members of the root; without conversations there is no root.
    Repeated conv_ids are members each.

    A conversation is one key of 20 bytes a turn in one row. A key that many
    conversations share is counted in parts of 1,024 ids; only the hash over its
    ids, which has to see them in order, reads these parts one after the other.
    """
    key = F.unhex(F.array_join("ids", ""))
    members = conversations.select("conv_id", key.alias("key")).groupBy("key", F.shiftright("conv_id", ID_BITS).alias("part"))
    counted = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    keys = settle(counted).repartitionByRange("key").sortWithinPartitions("key", "part").select("key", "n", "least", "ids")
    nodes = settle(keys.mapInArrow(_trees(block), NODE_COLUMNS))

    rows = nodes.filter("border").drop("border", "parent_conv_id")
    met = rows.groupBy("prefix", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
        F.max("size").alias("size"),
        F.min("chain").alias("owner"),
        F.max(F.col("length") > F.col("depth")).alias("inner"),
    )
    along = Window.partitionBy("chain").orderBy("depth")
    below = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    mine = F.col("owner") == F.col("chain")
    # A border node's own share is counted along one chain only, so that ancestors add it up once.
    saved = F.when(mine, F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).otherwise(0)
    leaves = F.when(mine, F.col("n_leaves") + F.when((F.col("n_children") == 0) & ~F.col("inner"), 1).otherwise(0)).otherwise(0)
    chains = settle(
        rows.select("chain", "depth", "prefix").join(met, ["prefix", "depth"]).select(
            "chain", "depth", "prefix", "conv_id", "n_convs", "n_children", "ends_sha256",
            F.lag("conv_id").over(along).alias("parent_conv_id"),
            F.coalesce(F.lead(mine).over(along), F.lit(False)).cast("long").alias("_next"),
            F.sum(saved).over(below).alias("_saved"),
            F.sum(leaves).over(below).alias("_leaves"),
        )
    )
    borders = chains.groupBy("prefix", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("parent_conv_id").alias("parent_conv_id"),
        F.min("n_convs").alias("n_convs"),
        (F.min("n_children") + F.sum("_next")).alias("n_children"),
        F.sum("_leaves").alias("n_leaves"),
        F.sum("_saved").alias("saved_tokens"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    names = chains.select(F.col("chain"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_parent"))
    inner = nodes.filter("NOT border").join(names, ["chain", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return inner.select(*columns).unionByName(borders.select(*columns))


ORACLE = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns, conv_id - conv_id % {SHARED} AS base
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT *, CAST({CRC.format("CAST(conv_id AS VARCHAR)")} % {SPAN} AS INTEGER) AS h FROM own, crc),
rebuilt AS (
  SELECT heads.conv_id, list_concat(coalesce(own.turns, [])[1:h], heads.turns[h + 1:]) AS turns
  FROM heads LEFT JOIN own ON own.conv_id = heads.base),
member AS (
  SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns[1:depth] AS prefix, len(turns) AS n FROM rebuilt),
node AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM member GROUP BY prefix, depth),
linked AS (
  SELECT node.*, parent.conv_id AS parent_conv_id,
         (SELECT count(*) FROM node c WHERE c.depth = node.depth + 1 AND c.prefix[1:node.depth] = node.prefix) AS n_children,
         CASE WHEN node.depth = 0 THEN 0 ELSE (node.n_convs - 1) * strlen(node.prefix[node.depth].text) END AS saved
  FROM node LEFT JOIN node parent ON parent.depth = node.depth - 1 AND parent.prefix = node.prefix[1:node.depth - 1]),
above AS (SELECT n_children, saved, up AS depth, prefix[1:up] AS prefix FROM (SELECT n_children, saved, prefix, unnest(range(depth + 1)) AS up FROM linked)),
sums AS (SELECT prefix, depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY prefix, depth)
SELECT conv_id, linked.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM linked JOIN sums ON sums.depth = linked.depth AND sums.prefix = linked.prefix
"""
