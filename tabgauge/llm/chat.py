"""Conversations from reply trees.

Messages form trees by their parents. Iterative self-joins with doubled steps (parent, grandparent, fourth ancestor ...) give every node its
depth and the sum of scores up to the root in a number of rounds that is the logarithm of the depth. Nodes without replies end a branch; the branches of a
tree are ranked by their mean score, and the ``keep`` best are enumerated by the same steps downwards. Only ids and scores take part in these joins;
roles and texts join once, for chosen branches only. Each branch becomes one conversation.

The template marks each turn. Inside texts, a control string gets one backslash more after its first character than it had, so no text can
end a turn, and reading back takes it away again. The loss mask lists the code points of the assistant's texts.

Defined cases: a null text or role is empty; a null score is 0; a message whose parent is absent is a root; messages in or below a cycle are on no
branch that starts at a root and are left out; a null tree id is a tree of its own; equal scores rank by the smaller leaf id; node ids are distinct within
a tree, and of rows that repeat one the least (role, text) counts; other columns are not read; an empty table gives no rows. Texts of any length are kept whole; a branch is one
record, so its texts must fit a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabgauge.llm.common import cut, small, tasks_for

#: What opens and closes a turn of each role; other roles are named.
MARKERS = {"system": ("<<SYS>> ", " <</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")}
NAMED = ("[ROLE] ", " [SAYS] ", " [/ROLE]\n")
_CONTROL = ((r"\[", r"/?(?:INST|ROLE)\]|SAYS\]"), (r"<", r"/?s>|</?SYS>>"))
_ESCAPE = [(re.compile(rf"({a})(\\*)({b})"), r"\1\2\\\3") for a, b in _CONTROL]
_UNESCAPE = [(re.compile(rf"({a})\\(\\*)({b})"), r"\1\2\3") for a, b in _CONTROL]


def escape(text: str) -> str:
    for pattern, to in _ESCAPE:
        text = pattern.sub(to, text)
    return text


def unescape(text: str) -> str:
    for pattern, to in _UNESCAPE:
        text = pattern.sub(to, text)
    return text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts in it."""
    out, mask, at = [], [], 0
    for role, text in turns:
        if role in MARKERS:
            opening, closing = MARKERS[role]
        else:
            opening, closing = NAMED[0] + escape(role) + NAMED[1], NAMED[2]
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(opening), at + len(opening) + len(body)))
        out += [opening, body, closing]
        at += len(opening) + len(body) + len(closing)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (opening, closing) in MARKERS.items():
            if formatted.startswith(opening, at):
                at += len(opening)
                break
        else:
            if not formatted.startswith(NAMED[0], at):
                raise ValueError(f"no turn starts at {at}")
            middle = formatted.index(NAMED[1], at)
            role, at, closing = unescape(formatted[at + len(NAMED[0]) : middle]), middle + len(NAMED[1]), NAMED[2]
        end = formatted.index(closing, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(closing)
    return turns


def _same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
    return a["tree"].eqNullSafe(b[f"{right}_tree"]) & (a[left] == b[f"{right}_node"])


def branches(messages: DataFrame, tree: str, node: str, parent: str, score: str, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, place) of the ``keep`` best root-to-leaf paths of each tree; place counts from 1 at the root."""
    nodes = cut(messages.groupBy(F.col(tree).alias("tree"), F.col(node).alias("node")).agg(
        F.min(parent).alias("parent"), F.max(F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("score")))
    known = nodes.select(F.col("tree").alias("b_tree"), F.col("node").alias("b_node"))
    state = cut(nodes.join(known, nodes["tree"].eqNullSafe(known["b_tree"]) & (nodes["parent"] == known["b_node"]), "left").select(
        "tree", "node", F.col("b_node").alias("above"), F.lit(1).cast("long").alias("length"), F.col("score").alias("total")))
    steps = []
    for _ in range(max(1, nodes.count()).bit_length() + 1):
        active = state.where(F.col("above").isNotNull())  # nodes at the root already take no further part
        if active.isEmpty():
            break
        steps.append(active.select(F.col("tree").alias("s_tree"), F.col("node").alias("s_node"), F.col("above").alias("s_above")))
        upper = state.select(*[F.col(c).alias(f"b_{c}") for c in state.columns])
        moved = active.join(upper, _same(active, upper, "above", "b")).select(
            "tree", "node", F.col("b_above").alias("above"), (F.col("length") + F.col("b_length")).alias("length"), (F.col("total") + F.col("b_total")).alias("total"))
        state = cut(state.where(F.col("above").isNull()).union(moved))
    replied = nodes.where(F.col("parent").isNotNull()).select(F.col("tree").alias("r_tree"), F.col("parent").alias("r_node")).distinct()
    rooted = state.where(F.col("above").isNull())
    leaves = rooted.join(replied, rooted["tree"].eqNullSafe(replied["r_tree"]) & (rooted["node"] == replied["r_node"]), "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("length")).desc(), "node")
    path = cut(leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select(
        "tree", F.col("node").alias("leaf"), "rank", "node", F.col("length").alias("place")))
    for k in reversed(range(len(steps))):
        step = steps[k]
        up = path.join(step, path["tree"].eqNullSafe(step["s_tree"]) & (path["node"] == step["s_node"])).select(
            "tree", "leaf", "rank", F.col("s_above").alias("node"), (F.col("place") - 2**k).alias("place"))
        path = cut(path.union(up))
    return path


def conversations(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text",
                  score: str = "score", keep: int = 1) -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, n_turns, formatted, loss (array of (start, end), code points)."""
    path = cut(branches(messages, tree, node, parent, score, keep).select(F.col("tree").alias("p_tree"), F.col("node").alias("p_node"), "leaf", "rank", "place"))
    said = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.struct(
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"))
    same = said["tree"].eqNullSafe(path["p_tree"]) & (said["node"] == path["p_node"])
    # Texts meet the ids of the chosen branches and are dealt out once, by branch; there rows that repeat a node give way to the least one.
    own = said.join(small(path), same).select("tree", "leaf", "rank", "place", "said").repartition(tasks_for(messages), "tree", "leaf", "rank")
    turns = (
        own.groupBy("tree", "leaf", "rank", "place").agg(F.min("said").alias("said"))
        .groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "said.role", "said.text"))).alias("turns"))
    )
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, masks, n = [], [], []
            for row in batch.column("turns"):
                turns = [(t["role"], t["text"]) for t in row.as_py()]
                formatted, mask = render(turns)
                made.append(formatted)
                masks.append([{"start": a, "end": b} for a, b in mask])
                n.append(len(turns))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("tree", "leaf", "rank")), pa.array(n, pa.int64()), pa.array(made, pa.string()), pa.array(masks, spans)],
                names=["tree", "leaf", "rank", "n_turns", "formatted", "loss"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.select("tree", "leaf", "rank").schema)
    return turns.mapInArrow(run, f"{kinds}, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>")


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of conversations that are mere lists: each row replies to the one before it by (turn, role, text), nulls first."""
    order = Window.partitionBy(conv).orderBy(*(F.col(c).asc_nulls_first() for c in (turn, role, text)))
    n = F.row_number().over(order)
    return rows.select(
        F.col(conv).alias("tree"), n.cast("long").alias("node"), F.when(n > 1, n - 1).cast("long").alias("parent"),
        F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))


def _length(column: str) -> str:
    """SQL: code points of the escaped text."""
    return reduce(lambda x, c: f"regexp_replace({x}, '({c[0]})(\\\\*)({c[1]})', '\\1\\2\\\\\\3', 'g')", _CONTROL, f"coalesce({column}, '')")


_MARKS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKERS.items())
ORACLE = f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length({_length("text")}) + CASE role {_MARKS} ELSE {sum(map(len, NAMED))} + length({_length("role")}) END)::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id
"""
