"""Chat formatting of reply trees: root-to-leaf paths by doubling self-joins, ranked, each formatted with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain, tidy

#: The template of a turn: ``### role: text</turn>`` and a newline.
OPEN, END = "### ", "</turn>\n"
#: What a text may not hold as it is: a backslash goes before each.
CONTROL = r"(\\|#(?=##)|<(?=/turn>))"
ROLE_CONTROL = r"(\\|:|#(?=##)|<(?=/turn>))"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def reply_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """The ``keep`` best root-to-leaf paths of each reply tree.

    ``nodes``: tree, node, parent (one type), score (double; null counts as 0); tree and node identify a row. A node
    whose parent is null or unknown is a root; nodes on a cycle, or under one, have no root and are left out. Paths
    rank by the sum of their scores, ties by the smaller leaf. Returns a row for each node of a chosen path: tree,
    leaf, rank (from 1), depth (from 0 at the root), node.

    Self-joins double the distance to an ancestor each round, so a chain of n replies takes log2(n) rounds.
    """
    plain_nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = plain_nodes.select("tree", F.col("node").alias("parent")).distinct()
    known = plain_nodes.join(ids.withColumn("there", F.lit(True)), ["tree", "parent"], "left")
    jump = materialize(known.filter("there").select("tree", "node", F.col("parent").alias("up"), F.lit(1).alias("hops")), "jump")
    # total: score of the nodes from this one up to the last ancestor seen, without that one
    reach = materialize(known.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).alias("depth"), F.col("score").alias("total")), "reach")
    own = plain_nodes.select("tree", "node", "score")
    jumps, before = [], -1
    while (n := jump.count()) and n != before:
        jumps.append(jump)
        before = n
        # up: null once the root is in the total
        far = reach.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        reach = materialize(reach.join(far, ["tree", "up"], "left").select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total")), "reach")
        jump = materialize(jump.join(jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2")), ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("hops") * 2).alias("hops")), "jump")
    leaves = reach.filter("up IS NULL").join(known.filter("there").select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    best = leaves.withColumn("rank", rank).filter(F.col("rank") <= keep).select("tree", F.col("node").alias("leaf"), "rank", "depth", "node")
    path = materialize(best, "path")
    for jump in jumps:
        # every ancestor at a distance below twice the last one is reached once
        up = path.join(jump.drop("hops"), ["tree", "node"]).select("tree", "leaf", "rank", (F.col("depth") - F.lit(1 << jumps.index(jump))).alias("depth"), F.col("up").alias("node"))
        path = materialize(path.unionByName(up), "path")
    return path


def escaped(text, control: str = CONTROL):
    return F.regexp_replace(F.coalesce(text, F.lit("")), control, r"\\$1")


def format_paths(turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``turns`` (conversation, position, role, text): conversation, formatted,
    loss_spans (first and end code point of each assistant text within ``formatted``, in order)."""
    order = Window.partitionBy("conversation").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_CONTROL), F.lit(": "))
    body = escaped(F.col("text"))
    parts = turns.select("conversation", "position", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("learned"))
    placed = parts.withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(order), F.lit(0)))
    start = F.col("at") + F.length("head")
    rows = placed.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("position", F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("learned"), F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("span")))).alias("rows"))
    return rows.select("conversation", F.array_join(F.col("rows.turn"), "").alias("formatted"), F.filter(F.col("rows.span"), lambda x: x.isNotNull()).alias("loss_spans"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    found, at = [], 0
    while at < len(formatted):
        turn = TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return found


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        turns, learned = [], []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns.append([{"role": r, "text": t} for r, t in parse(text)])
            learned.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans))
        yield pa.RecordBatch.from_arrays([batch.column("conversation"), pa.array(turns, pa.list_(turn)), pa.array(learned, pa.string())], ["conversation", "turns", "learned"])


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Back from ``format_paths``: conversation, turns (role, text), learned (the texts under the loss mask)."""
    kind = dict(formatted.dtypes)["conversation"]
    return formatted.select("conversation", "formatted", "loss_spans").mapInArrow(_read, f"conversation {kind}, turns array<struct<role: string, text: string>>, learned string")


def threads(conversations: DataFrame) -> DataFrame:
    """Reply-tree nodes of conversations whose turns follow each other: tree, node, parent, score, role, text.

    Rows go by turn (null first); rows of one turn, repeated ones too, follow each other by role and text. A null
    conv_id makes one conversation. Null roles and texts count as empty.
    """
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = plain(conversations, "conv_id", "turn", "role", "text").withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    return rows.select("tree", "conv_id", F.row_number().over(order).alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def chat_format(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """Format the best paths of reply trees: ``nodes`` (tree, node, parent, score, role, text) to conversation
    (tree and rank), formatted and loss_spans. Trees are formatted whole, of any depth."""
    paths = reply_paths(nodes, keep)
    turns = paths.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    return format_paths(turns.select(F.struct("tree", "rank").alias("conversation"), F.col("depth").alias("position"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
