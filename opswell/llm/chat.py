"""Chat formatting: turns written by a small grammar, read back, and escaped where the reading differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A turn is written as HEAD, role, MID, text, TAIL.
HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
#: What stands for the control strings inside texts and roles, the escape sign itself first. Each is the sign and a letter, so no two can be mixed up.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
TURN = "array<struct<role:string,text:string>>"


def _replaced(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, pairs=ESCAPES) -> Column:
    return _replaced(c, pairs)


def unescape(c: Column, pairs=ESCAPES) -> Column:
    return _replaced(c, [(b, a) for a, b in reversed(pairs)])


def _written(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MID), t["text"], F.lit(TAIL))), "")


def _segments(formatted: Column) -> Column:
    """What stands before each TAIL."""
    parts = F.split(formatted, r"\Q" + TAIL + r"\E")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null in a turn that breaks the grammar.

    A segment up to TAIL is HEAD, a role up to the first MID, and the text. Control
    strings may stand nowhere else. Escapes are undone.
    """

    def turn(s):
        role_until = F.instr(s, MID)
        head = F.startswith(s, F.lit(HEAD)) & (role_until > len(HEAD))
        role = F.substring(s, F.lit(len(HEAD) + 1), role_until - 1 - len(HEAD))
        text = F.substring(s, role_until + len(MID), F.length(s))
        clean = ~F.contains(role, F.lit(HEAD.strip())) & ~F.contains(text, F.lit(HEAD.strip())) & ~F.contains(text, F.lit(TAIL.strip()))
        return F.when(head & clean, F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text")))

    return F.transform(_segments(formatted), turn).cast(TURN)


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (role and text by turn; rows of the same turn by role, then text). Nulls are empty strings."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_chats(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, escaped (whether escapes were needed) and mask of each conversation.

    rows: conv_id, turn, role, text. A conversation is first written as it is and
    read back; where a turn differs from the source, the conversation is written
    with escapes and read back again. Should that differ too, the job stops: the
    result always reads back as its source.

    mask: runs (length in code points of `formatted`, loss) over the whole of
    `formatted`; loss is true over the texts of turns whose role is `learn`.

    Null roles and texts are empty. Rows of a conversation with the same turn are
    ordered by role, then text; equal rows are turns each. A null conv_id is a
    conversation. A conversation is one text, so all its turns meet in one row.
    Without rows the result is empty.
    """
    plain = conversations(rows).withColumn("_plain", _written(F.col("turns")))
    escaped = F.transform("turns", lambda t: F.struct(escape(t["role"], ROLE_ESCAPES).alias("role"), escape(t["text"]).alias("text")))
    tried = plain.withColumn("escaped", ~F.coalesce(parse(F.col("_plain")).eqNullSafe(F.col("turns").cast(TURN)), F.lit(False)))
    chosen = tried.withColumn("_shown", F.when(F.col("escaped"), escaped).otherwise(F.col("turns")))
    written = chosen.withColumn("formatted", F.when(F.col("escaped"), _written(F.col("_shown"))).otherwise(F.col("_plain")))
    checked = F.when(
        F.col("escaped") & ~parse(F.col("formatted")).eqNullSafe(F.col("turns").cast(TURN)), F.raise_error(F.lit("a conversation does not read back"))
    ).otherwise(F.col("formatted"))
    run = lambda n, loss: F.struct(n.alias("length"), loss.alias("loss"))
    mask = F.flatten(
        F.zip_with(
            "_shown",
            "turns",
            lambda s, t: F.array(
                run(F.length(s["role"]) + len(HEAD) + len(MID), F.lit(False)), run(F.length(s["text"]), t["role"] == learn), run(F.lit(len(TAIL)), F.lit(False))
            ),
        )
    )
    return written.select("conv_id", F.size("turns").cast("long").alias("n_turns"), checked.alias("formatted"), "escaped", mask.alias("mask"))


def digest(chats: DataFrame) -> DataFrame:
    """Read back from formatted text and mask: hashes over turns and over the text under the mask."""
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    segments = _segments(F.col("formatted"))
    # Each segment has three runs of the mask: before its text, its text, and the tail.
    learned = F.transform(
        segments,
        lambda s, i: F.when(
            F.get(F.col("mask"), 3 * i + 1)["loss"],
            unescape(F.substring(s, F.get(F.col("mask"), 3 * i)["length"] + 1, F.get(F.col("mask"), 3 * i + 1)["length"])),
        ).otherwise(F.lit("")),
    )
    read = chats.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.array_join(turns, "").alias("_all"), F.array_join(learned, "").alias("_loss"), "formatted")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("_all", 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '###', '\h') AS safe_text,
         replace(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '###', '\h'), ':', '\c'), chr(10), '\n') AS safe_role,
         contains(text, '###') OR contains(text, '</turn>') OR regexp_matches(text, '\\[bth]')
           OR contains(role, '###') OR contains(role, '</turn>') OR contains(role, ': ') OR regexp_matches(role, '\\[bthcn]') AS conflict
  FROM rows),
marked AS (SELECT *, bool_or(conflict) OVER (PARTITION BY conv_id) AS safe FROM escaped)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length('### : </turn>') + 1 + CASE WHEN safe THEN length(safe_role) + length(safe_text) ELSE length(role) + length(text) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
