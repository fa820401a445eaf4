"""Mixing sources to target weights: budgets flow down a tree of domains, languages and sources, shortages go to
siblings before they go to ancestors, and each leaf gives a token-prefix of its seeded epochs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Ranges of the seeded order in which a leaf's tokens are summed before its cut is looked for.
BUCKETS = 4096
#: Leaves up to which each task gets the cuts of all.
MOST_BROADCAST = 100_000


@dataclass
class Node:
    """A node of the tree: its weight among its siblings, its children by name, and a leaf's tokens."""

    weight: float = 1.0
    children: dict[str, Node] = field(default_factory=dict)
    supply: int = 0

    def capacity(self, epochs: int) -> int:
        return sum(c.capacity(epochs) for c in self.children.values()) if self.children else self.supply * epochs


def share_out(amount: int, weights: list[float], rooms: list[int]) -> list[int]:
    """Whole shares of ``amount`` in proportion to the weights, none above its room: what one can't take goes to the
    others in proportion; rounding goes to the first ones with room. Less than ``amount`` only if all are full."""
    given = [0] * len(rooms)
    open_ = [i for i, r in enumerate(rooms) if r > 0 and weights[i] > 0] or [i for i, r in enumerate(rooms) if r > 0]
    left = min(amount, sum(rooms[i] for i in open_))
    while left > 0 and open_:
        total = sum(weights[i] for i in open_) or len(open_)
        part = {i: int(left * (weights[i] if sum(weights[j] for j in open_) else 1) / total) for i in open_}
        full = [i for i in open_ if given[i] + part[i] >= rooms[i]]
        if full:
            for i in full:
                left -= rooms[i] - given[i]
                given[i] = rooms[i]
            open_ = [i for i in open_ if i not in full]
            continue
        for i in open_:
            given[i] += part[i]
            left -= part[i]
        for i in open_:
            more = min(left, rooms[i] - given[i])
            given[i] += more
            left -= more
            if not left:
                break
        open_ = [i for i in open_ if given[i] < rooms[i]]
    return given


def leaf_budgets(root: Node, amount: int, epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens that each leaf gives. A node's share is split among its children by their weights; what a child can't
    give within ``epochs`` goes to its siblings first, and only what all of them together can't give goes up."""
    out: dict[tuple[str, ...], int] = {}

    def down(node: Node, budget: int, path: tuple[str, ...]) -> None:
        if not node.children:
            out[path] = budget
            return
        names = sorted(node.children)
        rooms = [node.children[n].capacity(epochs) for n in names]
        for name, part in zip(names, share_out(budget, [node.children[n].weight for n in names], rooms), strict=True):
            down(node.children[name], part, (*path, name))

    down(root, min(amount, root.capacity(epochs)), ())
    return out


def _names(levels: dict[str, Column]) -> list[str]:
    return [f"_level{k}" for k in range(len(levels))]


def _marked(documents: DataFrame, levels: dict[str, Column], seed: str, *more: Column) -> DataFrame:
    """Of ``documents`` their leaf (_level0, ...), words and place in the seeded order, and ``more``."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    spot = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    names = [F.coalesce(c.cast("string"), F.lit("?")).alias(n) for n, c in zip(_names(levels), levels.values(), strict=True)]
    return documents.select(*more, *names, words.cast("long").alias("_tokens"), spot.alias("_spot"))


def level_shares(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``share_out`` for all parents at once: children (parent columns, name, weight, room, budget: the parent's) with
    ``share``, by windows over the children of a parent.

    Children fill up in the order of room by weight; one is full if its part of what the fuller ones leave reaches its
    room. The others share the rest in proportion, rounded down; what rounding leaves goes to the first by name with room.
    """
    own = Window.partitionBy(*parent)
    open_ = nodes.filter("room > 0").withColumn("any", F.max(F.col("weight") > 0).over(own))
    open_ = open_.filter("weight > 0 OR NOT any").withColumn("w", F.when(F.col("any"), F.col("weight")).otherwise(1.0))
    open_ = open_.withColumns({"left": F.least("budget", F.sum("room").over(own)), "all_w": F.sum("w").over(own)})
    fuller = own.orderBy(F.col("room") / F.col("w"), name).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(fuller), F.lit(0))
    open_ = open_.withColumns({"rest": F.col("left") - before("room"), "rest_w": F.col("all_w") - before("w")})
    # of equal ratios all are full or none; rounding of sums of weights must not open the last one
    open_ = open_.withColumn("full", (F.col("rest") * F.col("w") >= F.col("room") * F.col("rest_w") * (1 - 1e-12)))
    part = F.floor((F.col("left") - F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(own)) * F.col("w") / F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(own))
    open_ = open_.withColumn("part", F.when(F.col("full"), F.col("room")).otherwise(F.least(F.coalesce(part, F.lit(0)), F.col("room"))))
    open_ = open_.withColumns({"over": F.col("left") - F.sum("part").over(own), "spare": F.col("room") - F.col("part")})
    earlier = F.coalesce(F.sum("spare").over(own.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.col("part") + F.greatest(F.lit(0), F.least(F.col("spare"), F.col("over") - earlier))
    shares = open_.select(*parent, name, share.cast("long").alias("share"))
    return nodes.join(shares, [*parent, name], "left").fillna(0, ["share"])


def spread_budgets(supply: DataFrame, names: list[str], weights: dict[tuple[str, ...], float], amount: int, epochs: int) -> DataFrame:
    """``leaf_budgets`` in Spark: leaves (names, tokens) to (names, tokens, budget), a level of the tree at a time. No leaf
    comes to the driver, however many there are; ``weights`` are a table that people write."""
    spark = supply.sparkSession
    above = None
    for k, name in enumerate(names):
        parent = names[:k]
        nodes = supply.groupBy(*parent, name).agg((F.sum("tokens") * epochs).alias("room"))
        given = [(*path, float(w)) for path, w in weights.items() if len(path) == k + 1]
        own = spark.createDataFrame(given, ", ".join(f"{n} string" for n in [*parent, name]) + ", weight double")
        nodes = nodes.join(own, [*parent, name], "left").fillna(1.0, ["weight"])
        nodes = nodes.withColumn("budget", F.lit(amount).cast("long")) if above is None else nodes.join(above, parent)
        nodes = materialize(nodes, "nodes")  # read twice, and plans stay small
        last, above = above, materialize(level_shares(nodes, parent, name).select(*parent, name, F.col("share").alias("budget")), "shares")
        discard(nodes, *([] if last is None else [last]))
    return supply.join(above, names)


def leaf_cuts(documents: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], float], amount: float, epochs: int, seed: str) -> DataFrame:
    """One row for each leaf: _level0, ..., _epochs (whole ones that it gives), _last (of the next epoch, the last
    place in the seeded order that its budget reaches).

    The running sum is over BUCKETS ranges of the order, and over documents only in a leaf's last range, so no task
    sees a whole leaf.
    """
    names = _names(levels)
    rows = materialize(_marked(documents, levels, seed), "mix")
    prefix = F.substring("_spot", 1, 3)
    sums = materialize(rows.groupBy(*names, prefix.alias("bucket")).agg(F.sum("_tokens").alias("tokens")), "sums")
    supply = sums.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    budgets = materialize(spread_budgets(supply, names, weights, int(amount * total), epochs), "budgets")
    unit = F.greatest("tokens", F.lit(1))
    plan = budgets.select(*names, F.floor(F.col("budget") / unit).alias("_epochs"), F.pmod("budget", unit).alias("_rest"))
    order = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0))).join(plan, names)
    # each leaf's first range that its budget doesn't cover, or none
    cut = before.filter(F.col("before") + F.col("tokens") > F.col("_rest")).groupBy(*names).agg(F.min(F.struct("bucket", "before")).alias("cut")).select(*names, "cut.bucket", "cut.before")
    within = Window.partitionBy(*names).orderBy("_spot").rangeBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("bucket", prefix).join(cut, [*names, "bucket"]).join(plan, names)
    last = near.withColumn("upto", F.col("before") + F.sum("_tokens").over(within)).filter("upto <= _rest").groupBy(*names).agg(F.max("_spot").alias("reached"))
    cuts = materialize(plan.join(cut, names, "left").join(last, names, "left").select(*names, "_epochs", F.coalesce("reached", "bucket", F.lit("g")).alias("_last")), "cuts")
    discard(rows, sums, budgets)
    return cuts


def mix_to_weights(documents: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], float], amount: float, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """Choose copies of documents so that the tokens of sources come near target weights.

    ``documents``: doc_id, text and what ``levels`` (name to column, from the top) read; tokens are words split at ASCII
    white space. ``weights``: weight of a node among its siblings, by its path of names; 1 where none is given.
    ``amount``: the share of all tokens to choose. A leaf gives whole epochs, and of the next one the documents whose
    running sum in a seeded order of doc_id stays within its budget. Null names are one more name, "?"; null doc_ids
    share one place in the order, as rows of one doc_id do, and go together. Null and wordless texts have no tokens and
    go with their place. Returns ``documents`` with copies (long; 0: not chosen) and n_tokens in place of columns of
    those names; other columns may have any name. Up to MOST_BROADCAST leaves no document is moved, as each leaf's cut
    is one value that all tasks get; more leaves are joined by their names.
    """
    names = _names(levels)
    cuts = leaf_cuts(documents, levels, weights, amount, epochs, seed)
    if cuts.count() <= MOST_BROADCAST:
        cuts = F.broadcast(cuts)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    chosen = _marked(documents, levels, seed, row).join(cuts, names, "left")
    copies = F.col("_epochs") + (F.col("_spot") <= F.col("_last")).cast("long")
    new = {"copies": F.coalesce(copies, F.lit(0)), "n_tokens": F.col("_tokens")}
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in documents.columns if c not in new], *[c.alias(n) for n, c in new.items()])
