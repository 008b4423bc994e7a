"""Conversation structure repair: the cheapest edits to a lawful order of roles, with an audit that is least among the cheapest.

Audits are strings that share their beginnings as linked nodes. A node knows its
label, a rolling hash of all labels up to it, and its ancestors 1, 2, 4, ... labels
back; two audits of equal cost are compared at their first differing label, found
by those ancestors and hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opswell.llm.streams import emitted, groups
from opswell.operators.segments import Ordered
from opswell.session import settle

#: Rows of a conversation whose edits are planned together; longer conversations are planned in parts, from each state a part can begin in.
CHUNK = 4096
#: What a repaired conversation has shown so far: nothing, system, user, assistant. Its roles are (s?(ua)+)?.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn is added, and that turn's role.
AFTER = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
MODULUS, FACTOR = (1 << 61) - 1, 0x1D2C6A5B3F7E9
#: Initials of the inserted turns that end a conversation lawfully.
ENDING = {NOTHING: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}


class Audits:
    """Sequences of labels as nodes that share their beginnings. Node 0 is the empty one.

    No label may be a beginning of another one that can stand in its place.
    """

    def __init__(self, factor: int = FACTOR):
        self.factor = factor
        self.labels, self.hashes, self.up = [""], [0], [[]]

    def add(self, node: int, label: str) -> int:
        new = len(self.labels)
        h = self.hashes[node]
        for letter in label:
            h = (h * self.factor + ord(letter)) % MODULUS
        self.labels.append(label)
        self.hashes.append((h * self.factor + 1) % MODULUS)
        up, k = [node], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        return new

    def less(self, a: int, b: int) -> bool:
        """Whether the first sequence is the smaller one; both have as many labels and differ."""
        x, y = a, b
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[x]) and self.hashes[self.up[x][k]] != self.hashes[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        first = x, y
        # Equal hashes are taken as equal beginnings only after a look at the labels, up to the node both come from.
        while x != y:
            if self.labels[x] != self.labels[y]:
                first = x, y
            x, y = self.up[x][0], self.up[y][0]
        return self.labels[first[0]] < self.labels[first[1]]

    def path(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.labels[node])
            node = self.up[node][0]
        return out[::-1]


def _steps(initial: str, forced: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, label) of what can be done with a row, the best label for each pair of states.

    A label is the inserts before the row and the row's own edit. An insert before
    a deletion is left out: after it, it costs as much and gives a smaller audit.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(a, b, cost, label):
        best[a, b] = min(best.get((a, b), (cost, label)), (cost, label))

    for a in range(4):
        offer(a, a, DELETE, "D")
        state = a
        for inserts in range(3):
            if not forced:
                cost, before = inserts * INSERT + truncated * TRUNCATED, "I" * inserts
                if initial == "s" and state == NOTHING:
                    offer(a, SYSTEM, cost, before + "K")
                if initial == {USER: "u", ASSISTANT: "a"}[AFTER[state]]:
                    offer(a, AFTER[state], cost, before + "K")
                offer(a, AFTER[state], cost + REROLE, before + "R")
            state = AFTER[state]
    return [(a, b, cost, label) for (a, b), (cost, label) in best.items()]


STEPS = {(i, f, t): _steps(i, f, t) for i in ("u", "a", "s", "") for f in (False, True) for t in (False, True)}


def _advance(audits: Audits, live: dict[int, tuple[int, int]], steps) -> dict[int, tuple[int, int]]:
    """The best audit for each state after steps (before, after, cost, label); live: state -> (cost, node)."""
    best: dict[int, tuple[int, int, str]] = {}
    for a, b, cost, label in steps:
        if a not in live:
            continue
        total, node = live[a][0] + cost, live[a][1]
        old = best.get(b)
        if old is not None and total == old[0]:
            better = label < old[2] if node == old[1] else audits.less(node, old[1])
        else:
            better = old is None or total < old[0]
        if better:
            best[b] = total, node, label
    return {b: (total, audits.add(node, label)) for b, (total, node, label) in best.items()}


def _paths(initials: list[str], faults: list[str], entries: list[int]) -> list[tuple[int, int, int, list[str]]]:
    """(state before, state after, cost, labels of the rows) over some rows, for each state they can begin in."""
    out = []
    for entry in entries:
        audits, live = Audits(), {entry: (0, 0)}
        for initial, fault in zip(initials, faults):
            live = _advance(audits, live, STEPS[initial if initial in "uas" else "", fault in ("blank", "duplicate"), fault == "truncated"])
        out += [(entry, b, cost, audits.path(node)) for b, (cost, node) in live.items()]
    return out


def _resolved(labels: list[str], initials: list[str], state: int) -> list[str]:
    """Labels with the roles they give: u and a for inserted turns, K, D, U and A for the row itself."""
    out = []
    for label, initial in zip(labels, initials):
        edit = ""
        for letter in label:
            if letter == "K" and initial == "s":
                state = SYSTEM
            elif letter != "D":
                state = AFTER[state]
            edit += letter if letter in "KD" else ROLE[state][0] if letter == "I" else ROLE[state][0].upper()
        out.append(edit)
    return out


PATHS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("labels", pa.string()), ("edits", pa.string())]))
CHUNKS = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("paths", PATHS)])
EDITS = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("edits", pa.list_(pa.string())), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
CHUNK_COLUMNS = "key string, chunk long, first string, last string, illegal long, paths array<struct<entry:int,exit:int,cost:long,labels:string,edits:string>>"
EDIT_COLUMNS = "key string, chunk long, edits array<string>, audit string, cost long, illegal long"


def _illegal(pairs) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairs)


def _plan_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its best paths from and to each state, and its pairs of roles out of order."""

    def rows():
        for (key, chunk), g in groups(batches, ["key", "chunk"]):
            initials, found = g["initial"], []
            for a, b, cost, labels in _paths(initials, g["fault"], [NOTHING] if chunk == 0 else list(range(4))):
                found.append({"entry": a, "exit": b, "cost": cost, "labels": " ".join(labels), "edits": " ".join(_resolved(labels, initials, a))})
            yield key, chunk, initials[0], initials[-1], _illegal(zip(initials, initials[1:])), found

    yield from emitted(rows(), CHUNKS, 50)


def _join_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best path over all chunks of each conversation; its last chunk's row has the whole audit.

    All labels of a chunk are one label here: they are as many on every path and end with a row's own edit.
    """

    def rows():
        for (key,), g in groups(batches, ["key"]):
            audits, live, came = Audits(), {NOTHING: (0, 0)}, {0: (None, NOTHING)}
            for paths in g["paths"]:
                live = _advance(audits, live, [(p["entry"], p["exit"], p["cost"], p["labels"]) for p in paths])
                for state, (_, node) in live.items():
                    came[node] = came[audits.up[node][0]][1], state
            best = None
            for state, (cost, node) in live.items():
                cost += INSERT * len(ENDING[state])
                if best is None or cost < best[0] or cost == best[0] and audits.less(node, best[1]):
                    best = cost, node
            cost, node = best
            nodes, ending = [], came[node][1]
            while node:
                nodes.append(node)
                node = audits.up[node][0]
            audit = "".join(audits.labels[n] for n in reversed(nodes)).replace(" ", "") + "I" * len(ENDING[ending])
            illegal = sum(g["illegal"]) + _illegal(zip(g["last"], g["first"][1:]))
            for i, n in enumerate(reversed(nodes)):
                edits = next(p["edits"] for p in g["paths"][i] if (p["entry"], p["exit"]) == came[n]).split(" ")
                if i < len(nodes) - 1:
                    yield key, g["chunk"][i], edits, None, None, None
                else:
                    edits[-1] += ENDING[ending]
                    yield key, g["chunk"][i], edits, audit, cost, illegal

    yield from emitted(rows(), EDITS, 50)


def damage(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text; nulls of role and text as one blank) with faults by crc32(conv_id:turn) % 20.

    0 drops the row, 1 empties its text, 2 takes . ! ? out of it, 3 gives it twice, 4 makes its role user.
    A null conv_id or turn is one blank in the hashed string.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("fault"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.filter("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


@dataclass
class Repair:
    """audits: a row for each conversation; turns: the turns of the repaired conversations."""

    audits: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, chunk: int = CHUNK) -> Repair:
    """The cheapest edits that give each conversation roles whose initials are (s?(ua)+)?.

    rows: conv_id, turn, role, text. A conversation's rows stand by turn (nulls
    first); rows of one turn by role, then by a hash of their text, equal rows next
    to each other. A null conv_id is a conversation; a null role or text is empty.
    A row whose role is empty or begins with another letter than s, u, a can't be kept as it is.

    audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    turns: conv_id, place (of the row among the conversation's, from 1), step (order
    of turns at a place), edit (K kept, R new role, I inserted), role, text.
    A conversation whose rows are all deleted has no turns. Without rows both are empty.

    Texts are written once and moved twice. Planning moves a few bytes for each row,
    and a conversation of any length is spread over parts of `chunk` rows; only the
    parts' paths meet in one task, as the audit is one string.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank = trimmed == ""
    given = settle(
        rows.select(
            "conv_id",
            F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("key"),
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).select(
            "*",
            F.sha2("text", 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
            blank.alias("blank"),
            (~blank & ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"),
        )
    )
    light = given.select("key", "turn", "role", "digest", "row", "blank", "open")
    numbered = Ordered(light, ["key"], ["turn", "role", "digest", "row"]).row_numbers("place")
    placed = settle(numbered.df.withColumn("chunk", F.floor((F.col("place") - 1) / chunk).cast("long")))
    first = placed.groupBy("key", "role", "digest").agg(F.min("place").alias("place")).select("key", F.floor((F.col("place") - 1) / chunk).cast("long").alias("chunk"), "place", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("")
    flagged = settle(placed.join(first, ["key", "chunk", "place"], "left").select("key", "chunk", "place", "turn", "row", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")))
    chunks = flagged.select("key", "chunk", "place", "initial", "fault").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "place").mapInArrow(_plan_chunks, CHUNK_COLUMNS)
    edits = settle(chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_join_chunks, EDIT_COLUMNS))

    tally = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = flagged.groupBy("key").agg(gaps, tally("blank"), tally("duplicate"), tally("truncated"))
    ids = given.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    audits = ids.join(counts, "key").join(edits.filter("audit IS NOT NULL").select("key", "illegal", "cost", "audit"), "key")

    by_row = edits.select("key", "chunk", F.posexplode("edits").alias("at", "edit")).select("key", "chunk", (F.col("chunk") * chunk + F.col("at") + 1).alias("place"), "edit")
    by_row = flagged.select("key", "chunk", "place", "row").join(by_row, ["key", "chunk", "place"]).filter("edit <> 'D'").select("row", "place", "edit")
    inserted = lambda letter: F.struct(F.lit("I").alias("edit"), F.when(letter == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))
    new_role = lambda letter: F.when(letter == "U", "user").when(letter == "A", "assistant")
    own = lambda letter: F.struct(F.when(letter == "K", "K").otherwise("R").alias("edit"), F.coalesce(new_role(letter), F.col("role")).alias("role"), F.col("text"))
    letters = F.filter(F.split("edit", ""), lambda e: (e != "") & (e != "D"))
    turns = F.transform(letters, lambda e: F.when(e.isin("u", "a"), inserted(e)).otherwise(own(e)))
    shown = given.select("conv_id", "row", "role", "text").join(by_row, "row").select("conv_id", "place", F.posexplode(turns).alias("step", "turn"))
    return Repair(audits.drop("key"), shown.select("conv_id", "place", "step", "turn.*"))


DIGESTS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _hash_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        whose, digest = None, None
        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is None or conv != whose:
                    if digest is not None:
                        yield whose, digest.hexdigest()
                    whose, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
        if digest is not None:
            yield whose, digest.hexdigest()

    yield from emitted(rows(), DIGESTS)


def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of `role:text`, one line for each turn. Rows pass one by one; none is held."""
    lines = turns.select("conv_id", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step").select("conv_id", "line").mapInArrow(_hash_turns, "conv_id long, repaired_sha256 string")


def digest(given: DataFrame, found: Repair) -> DataFrame:
    """A row for each conv_id of the given rows, with its audit and the hash of its repaired turns; zeros and empty strings where no row is left."""
    ids = given.select("conv_id").distinct().select(F.col("conv_id").alias("_id"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    hashes = turn_hashes(found.turns).withColumnRenamed("conv_id", "_turns_of")
    out = ids.join(found.audits, F.col("conv_id").eqNullSafe(F.col("_id")), "left").join(hashes, F.col("_turns_of").eqNullSafe(F.col("_id")), "left")
    return out.select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: Unsigned crc32 of the decimal string in `{}` for DuckDB, by the table `crc(t)` of CRC_TABLE.
CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(CAST(range(8) AS BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS v FROM range(256) r(i)))"""
CRC = """xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)))"""

_STATE = "struct_pack(c := {}, a := {}, o := {})"


def _oracle() -> str:
    def step(x: int, inserts: str, row: str) -> str:
        """From state x over inserted turns to the row's edit: its cost, label and line are columns of `fold`."""
        lines = "".join(f" || chr(10) || '{ROLE[USER] if i == 'u' else ROLE[ASSISTANT]}:'" for i in inserts)
        return _STATE.format(f"b[{x + 1}].c + {INSERT * len(inserts)} + {row}_cost", f"b[{x + 1}].a || '{'I' * len(inserts)}' || {row}_label", f"b[{x + 1}].o{lines} || {row}_line")

    delete = lambda x: _STATE.format(f"b[{x + 1}].c + {DELETE}", f"b[{x + 1}].a || 'D'", f"b[{x + 1}].o")
    keep = _STATE.format("b[1].c + s_cost", "b[1].a || 'K'", "b[1].o || s_line")
    lists = [
        [delete(0)],
        [delete(1), keep],
        [delete(2), step(0, "", "u"), step(1, "", "u"), step(3, "", "u"), step(2, "a", "u"), step(0, "ua", "u"), step(1, "ua", "u")],
        [delete(3), step(2, "", "a"), step(0, "u", "a"), step(1, "u", "a"), step(3, "u", "a")],
    ]
    best = ", ".join(f"list_min([{', '.join(some)}])" for some in lists)
    none = _STATE.format("CAST(1000000 AS BIGINT)", "''", "''")
    start = _STATE.format("CAST(0 AS BIGINT)", "''", "''")
    ends = ", ".join(
        _STATE.format(f"b[{x + 1}].c + {INSERT * len(e)}", f"b[{x + 1}].a || '{'I' * len(e)}'", f"b[{x + 1}].o" + "".join(f" || chr(10) || '{'user' if i == 'u' else 'assistant'}:'" for i in e)) for x, e in ENDING.items()
    )
    return f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(2) copies(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS i,
         CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
              WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed),
edits AS (
  SELECT conv_id, place,
         CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS base,
         base + CASE WHEN i = 's' THEN 0 ELSE 1000000 END AS s_cost, chr(10) || role || ':' || text AS s_line,
         base + CASE WHEN i = 'u' THEN 0 ELSE {REROLE} END AS u_cost, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS u_label,
         chr(10) || CASE WHEN i = 'u' THEN role ELSE 'user' END || ':' || text AS u_line,
         base + CASE WHEN i = 'a' THEN 0 ELSE {REROLE} END AS a_cost, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS a_label,
         chr(10) || CASE WHEN i = 'a' THEN role ELSE 'assistant' END || ':' || text AS a_line
  FROM faults),
fold AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS upto, [{start}, {none}, {none}, {none}] AS b FROM placed
  UNION ALL
  SELECT fold.conv_id, place, [{best}] FROM fold JOIN edits ON edits.conv_id IS NOT DISTINCT FROM fold.conv_id AND place = upto + 1),
ended AS (
  SELECT conv_id, list_min([{ends}]) AS e FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY upto DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE = _oracle()
