"""Chat formatting of reply trees: the best branch of each tree becomes one conversation with a loss mask.

Messages point to the message they answer. Distances to all ancestors come from iterated self-joins that double their reach,
so a chain of n replies takes log2(n) of them. Every leaf ends one root-to-leaf path; paths are ranked by their mean score,
then their length, then the leaf's id. The messages of a chosen path are found by the same jumps and are formatted as one
conversation.

In the template ``[`` and ``<`` only occur in its own marks: texts have them, and the backslash, replaced by two-character
escapes, so what a text says can never be taken for a mark, and reading back restores it. The loss mask holds the ranges of
the assistant's texts, by code point of the formatted text.

A conversation is one row, so its size is bounded by what a row may hold; that is the operator's output, not a group it gathers
on the way to something smaller.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docledger.llm.shared import prepare, written

BEGIN, END = "<s>", "</s>"
# Marks before and after the text of a turn, by role; other roles are named in the mark.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", END)}
OTHER, NAMED, CLOSED = "[ROLE]", "[TEXT]", "[/TEXT]"
# The escapes of the control characters.
ESCAPES = {"\\": "\\\\", "[": "\\(", "<": "\\{"}

_BACK = {v: k for k, v in ESCAPES.items()}
_ESCAPED = re.compile(r"\\[\\({]")
_PLAIN = r"([^\[<]*)"
_TURN = re.compile(
    "|".join(re.escape(a) + _PLAIN + re.escape(b) for a, b in MARKS.values()) + "|" + re.escape(OTHER) + _PLAIN + re.escape(NAMED) + _PLAIN + re.escape(CLOSED)
)


def escape(text: str) -> str:
    """``text`` without control characters of the template."""
    for raw, out in ESCAPES.items():
        text = text.replace(raw, out)
    return text


def unescape(text: str) -> str:
    """The text that was escaped."""
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, ranges of the loss mask) of (role, text) turns. A null role or text is empty."""
    out, at, mask = [BEGIN], len(BEGIN), []
    for role, text in turns:
        before, after = MARKS.get(role or "", (OTHER + escape(role or "") + NAMED, CLOSED))
        body = escape(text or "")
        if role == "assistant":
            mask.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], len(BEGIN)
    if not formatted.startswith(BEGIN):
        raise ValueError("a conversation begins with its mark")
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn begins at {at}")
        at = found.end()
        *known, role, text = found.groups()
        if role is not None:
            turns.append((unescape(role), unescape(text)))
        else:
            turns.append(next((name, unescape(body)) for name, body in zip(MARKS, known, strict=True) if body is not None))
    return turns


def loss_text(formatted: str, mask: list[tuple[int, int]]) -> str:
    """All text under the loss mask, in order, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in mask)


def _jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables of (node, up), one for each power of two, and (node, depth, total)) of (node, parent, score).

    Each join doubles the distance. Nodes in a cycle have no root and come out without depth; a parent that is not there
    makes its child a root.
    """
    known = messages.select(F.col("node").alias("parent"))
    linked = messages.join(known, "parent", "left_semi").select("node", F.col("parent").alias("up"))
    state = messages.select("node", "score").join(linked, "node", "left").select("node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), "score")
    state = written(state, "chat-jumps")
    tables: list[DataFrame] = []
    done, active = state.where("up is null"), state.where("up is not null")
    before = -1
    while (left := active.count()) and left != before:
        before = left
        tables.append(active.select("node", "up"))
        # Only nodes that have not met their root look further up, so a round costs what is deeper than its reach.
        above = done.unionByName(active).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("score").alias("added"))
        further = active.join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("added")).alias("score"))
        further = written(further, "chat-jumps")
        done, active = done.unionByName(further.where("up is null")), further.where("up is not null")
    return tables, done.select("node", "depth", F.col("score").alias("total"))


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, rank, turns) of the ``top`` best root-to-leaf paths of each tree; ``turns`` holds (at, role, text) from the root on.

    ``messages`` has tree, node (unique, not null), parent (null at a root), score (null: 0), role and text. Messages in a
    cycle belong to no path. Other columns are not read.
    """
    messages = written(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "role", "text"), "chat-messages")
    tables, reached = _jumps(messages)
    leaves = messages.select("tree", "node").join(messages.select(F.col("parent").alias("node")), "node", "left_anti").join(reached, "node")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    on_path = chosen.select("tree", "rank", "node", F.col("depth").alias("at"))
    for k, table in enumerate(tables):
        up = on_path.join(table, "node").select("tree", "rank", F.col("up").alias("node"), (F.col("at") - (1 << k)).alias("at"))
        on_path = written(on_path.unionByName(up), "chat-paths")
    turns = on_path.join(messages.select("node", "role", "text"), "node")
    return turns.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))


def formatted(paths: DataFrame) -> DataFrame:
    """Replace ``turns`` by ``formatted`` and ``mask``: one conversation for each path, and its loss mask as [start, stop) ranges."""

    @arrow_udf("struct<formatted: string, mask: array<struct<start: long, stop: long>>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns or []]) for turns in batch.to_pylist()]
            masks = [[{"start": a, "stop": b} for a, b in mask] for _, mask in done]
            yield pa.StructArray.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array(masks, span)], ["formatted", "mask"])

    prepare(paths.sparkSession)
    return paths.withColumn("__c", of("turns")).drop("turns").withColumns({"formatted": F.col("__c.formatted"), "mask": F.col("__c.mask")}).drop("__c")


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn answers the one before.

    Turns of equal number follow each other by role and text, null ones first; a null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))

    def node(at: Column) -> Column:
        return F.concat_ws("#", name, at.cast("string"))

    at = F.col("__at")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("__at", F.row_number().over(order))
    return rows.select(F.col("conv_id").alias("tree"), node(at).alias("node"), F.when(at > 1, node(at - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that consists of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema)
    done = formatted(best_paths(chains(given.unionByName(extra))))

    @arrow_udf("struct<n_turns: long, turns_sha256: string, loss_chars: long, loss_sha256: string>")
    def back(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, masks in batches:
            rows = []
            for text, mask in zip(texts.to_pylist(), masks.to_pylist(), strict=True):
                turns, loss = read_turns(text), loss_text(text, [(m["start"], m["stop"]) for m in mask])
                joined = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), _digest(joined), len(loss), _digest(loss)))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"])

    found = done.withColumn("back", back("formatted", "mask"))
    return found.select(F.col("tree").alias("conv_id"), "back.*", F.length("formatted").cast("long").alias("formatted_chars"))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


OP9_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, 4 * length(text) - length(replace(text, '\', '')) - length(replace(text, '[', '')) - length(replace(text, '<', '')) AS body,
        CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
             ELSE 19 + length(role) + 3 * length(role) - length(replace(role, '\', '')) - length(replace(role, '[', '')) - length(replace(role, '<', '')) END AS marks
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(3 + sum(body + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
