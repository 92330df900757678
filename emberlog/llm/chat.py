"""Chat formatting from reply trees, with DataFrame functions only.

Messages form trees (node, parent).  Leaves are paths of length one; doubling
self-joins then give every ancestor of every leaf in a number of rounds that grows
with the logarithm of the depth.  Paths of a tree are ranked by the sum of their
messages' scores, and each chosen path becomes one formatted conversation.

The template puts ``<|role|>`` before and ``</s>`` after each turn and wraps user
turns in ``[INST] [/INST]``.  Inside texts and roles every control character of the
template is escaped by a backslash sequence, so a text that holds control strings
comes back unchanged and never ends a turn.

Defined results: null text and null role are empty; a null turn sorts first and
ties are ordered by role and text; equal messages of one turn each count; a null
conversation is one of its own; a text of any length is one turn; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm._text import written

#: Template (fixed values).
OPEN, CLOSE, END, USER_OPEN, USER_CLOSE = "<|", "|>", "</s>", "[INST] ", " [/INST]"
#: Escapes, in the order in which they apply; a backslash itself becomes \b, so an escaped
#: text holds a backslash only before one of these letters, and the reverse order undoes them.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("[", "\\o"), ("]", "\\c"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def chained(conversations: DataFrame) -> DataFrame:
    """Messages (conv, node, parent, role, text, score) of plain turn lists: each turn answers the one before."""
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, distance) for every message on the way from a leaf to its root."""
    key = ["conv", "node"]
    links = messages.select("conv", "node", "parent").filter("parent is not null")
    answered = links.select("conv", F.col("parent").alias("node")).distinct()
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    leaves = messages.select(*key).join(answered, same(messages, answered) & (messages.node == answered.node), "left_anti")
    reached = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).alias("distance"))
    jump = written(links, "jump")
    step = 1
    while not jump.isEmpty():
        j = jump.select(F.col("conv").alias("jc"), F.col("node").alias("jn"), F.col("parent").alias("jp"))
        further = reached.join(j, reached.conv.eqNullSafe(j.jc) & (reached.node == j.jn)).select("conv", "leaf", F.col("jp").alias("node"), (F.col("distance") + step).alias("distance"))
        reached = written(reached.unionByName(further), "paths")
        twice = jump.join(j, jump.conv.eqNullSafe(j.jc) & (jump.parent == j.jn)).select("conv", "node", F.col("jp").alias("parent"))
        jump = written(twice, "jump")
        step *= 2
    return reached


def conversations_of(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per root-to-leaf path: conv, leaf, rank (by score), and its turns in order.

    With `branches`, only that many best paths of each conversation (a top-k report).
    """
    way = paths(messages)
    m = messages.select(F.col("conv").alias("mc"), F.col("node").alias("mn"), "role", "text", "score")
    turns = way.join(m, way.conv.eqNullSafe(m.mc) & (way.node == m.mn))
    gathered = turns.groupBy("conv", "leaf").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "role", "text"))).alias("turns"), F.sum("score").alias("path_score")
    )
    ranked = gathered.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("path_score").desc(), "leaf")))
    return ranked if branches is None else ranked.filter(F.col("rank") <= branches)


def formatted(paths_with_turns: DataFrame) -> DataFrame:
    """Adds `formatted`, one string, and `pieces`: the same with a mask, array<struct<text, loss>>."""

    def piece(t: Column) -> Column:
        role, text = t["role"], escape(t["text"])
        body = F.when(role == "user", F.concat(F.lit(USER_OPEN), text, F.lit(USER_CLOSE))).otherwise(text)
        head = F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE))
        learn = role == "assistant"
        return F.array(
            F.struct(F.when(learn, head).otherwise(F.concat(head, body)).alias("text"), F.lit(False).alias("loss")),
            F.struct(F.when(learn, body).otherwise(F.lit("")).alias("text"), learn.alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    pieces = F.flatten(F.transform("turns", piece))
    return paths_with_turns.withColumn("pieces", pieces).withColumn("formatted", F.concat_ws("", F.transform("pieces", lambda p: p["text"])))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds `read_turns`, array<struct<role, text>>, and `read_loss`, the text under the loss mask; both parsed from `formatted` alone."""
    blocks = F.filter(F.split("formatted", F.lit("</s>"), -1), lambda b: b != "")

    def turn(block: Column) -> Column:
        at = F.locate(CLOSE, block)
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        body = F.substring(block, at + len(CLOSE), F.length(block))
        inner = F.substring(body, F.lit(len(USER_OPEN) + 1), F.length(body) - len(USER_OPEN) - len(USER_CLOSE))
        return F.struct(role.alias("role"), unescape(F.when(role == "user", inner).otherwise(body)).alias("text"))

    learnt = F.lit(f"{OPEN}assistant{CLOSE}")
    masked = F.transform(F.filter(blocks, lambda b: F.startswith(b, learnt)), lambda b: unescape(F.substring(b, F.length(learnt) + 1, F.length(b))))
    return conversations.withColumns({"read_turns": F.transform(blocks, turn), "read_loss": F.concat_ws("", masked)})


def chat_digests(conversations: DataFrame) -> DataFrame:
    """The digest columns of every path, from what is read back."""
    rows = read_back(formatted(conversations_of(chained(conversations))))
    said = F.concat_ws("", F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.col("read_loss")
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH extra AS (SELECT * FROM (VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text)),
m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM extra)),
n AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\\<>\[\]]')) AS coded FROM m)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
 sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(2 + length(role) + len(regexp_extract_all(role, '[\\<>\[\]]')) + 2 + coded + CASE WHEN role = 'user' THEN 15 ELSE 0 END + 4) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
