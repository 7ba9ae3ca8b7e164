"""Chat formatting over reply trees.

A forest of messages is a table of nodes with a parent each. Root-to-leaf paths
come from iterative self-joins: in round k every node holds a pointer 2^k steps
up, and the known parts of paths double, so a tree of depth d takes log2(d)
rounds. Branches of a tree are ranked by score and each chosen path is formatted
as one conversation, with the character spans of assistant texts (loss mask).

Template, per turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and texts
``<|`` becomes ``<||``, so no control string can occur there; a line feed in a
role becomes ``<|n``. Both steps are undone exactly by `parse`.

Defined results: null text or role is the empty string; a null score is 0; a node
whose parent is null or unknown is a root; rows with equal (conv_id, turn) keep all
rows, ordered by role, then text; an empty table gives no rows; further columns are
ignored. Nodes on a cycle have no root, so they lie on no path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,stop:long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "<|n")


def unescape_role(role: str) -> str:
    return re.sub(r"<\|([n|])", lambda m: "\n" if m[1] == "n" else "<|", role)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans, in code points, of the assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|im_start|>{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "<|im_end|>\n"]
        at += len(head) + len(body) + 11
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The inverse of format_turns."""
    turns = []
    for part in formatted.split("<|im_start|>")[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest.removesuffix("<|im_end|>\n"))))
    return turns


def paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """nodes(node string or long, parent, score) -> (leaf, node, depth): the nodes of
    the per_tree best branches of each tree; a branch's score is the sum over its
    nodes, ties go to the smaller leaf. depth counts from 0 at the root."""
    known = nodes.select("node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = known.select(F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    known = known.join(ids, "parent", "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there")
    # every node's pointer `up` leads `dist` steps towards the root; the sum covers the nodes
    # passed; nodes that have reached their root leave the rounds
    cols = ("node", "up", "score", "dist", "top")
    state = written(known.select("node", F.col("parent").alias("up"), "score", F.lit(1).alias("dist"), F.col("node").alias("top")), "chat_ptr")
    done, jumps = state.where(F.col("up").isNull()), []
    while (active := state.where(F.col("up").isNotNull())).limit(1).count() and len(jumps) < 40:  # 2^40 steps: only a cycle runs on
        jumps.append(active)
        above = done.unionByName(active).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("dist").alias("dist2"), F.col("top").alias("top2"))
        state = written(active.join(above, "up").select(
            "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("top2").alias("top")), "chat_ptr")
        done = done.unionByName(state.where(F.col("up").isNull()).select(*cols))
    parents = known.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    leaves = done.join(parents, "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("top").orderBy(F.desc("score"), "node"))
    found = leaves.withColumn("rank", rank).where(F.col("rank") <= per_tree).select(F.col("node").alias("leaf"), "node", (F.col("dist") - 1).alias("depth"))
    # parts of paths double: in round k all nodes below 2^k steps from the leaf are known
    for k, jump in enumerate(jumps):
        step = jump.select("node", "up")
        more = found.join(step, "node").select("leaf", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        found = written(found.unionByName(more), "chat_paths")
    return found


def as_nodes(turns: DataFrame) -> DataFrame:
    """A table of turns as a reply forest: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("pos", F.row_number().over(order))
    name = lambda p: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lpad(p.cast("string"), 10, "0"))
    return numbered.select(name(F.col("pos")).alias("node"), F.when(F.col("pos") > 1, name(F.col("pos") - 1)).alias("parent"), F.lit(0.0).alias("score"), "conv_id", "role", "text")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, turns = batch.column("conv_id"), batch.column("turns").to_pylist()
        made = [format_turns([(t["role"], t["text"]) for t in x]) for x in turns]
        yield pa.RecordBatch.from_arrays([
            ids, pa.array([x for x, _ in made], pa.string()),
            pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            names=["conv_id", "formatted", "loss_spans"])


def format_chats(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """nodes(node, parent, score, conv_id, role, text) -> one row per chosen path:
    conv_id of its leaf, the formatted text and the loss spans."""
    nodes = written(nodes, "chat_nodes")
    texts = nodes.select("node", "role", "text")
    of_leaf = nodes.select(F.col("node").alias("leaf"), "conv_id")
    turns = paths(nodes, per_tree).join(texts, "node").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return turns.join(of_leaf, "leaf").select("conv_id", "turns").mapInArrow(_formatted, FORMATTED)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            turns = parse(x["formatted"])
            loss = "".join(unescape(x["formatted"][s["start"] : s["stop"]]) for s in x["loss_spans"])
            rows.append((x["conv_id"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(x["formatted"])))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: DataFrame) -> DataFrame:
    """Reads conversations back from their formatted text."""
    return formatted.mapInArrow(_digest, DIGEST)
