"""Merkle manifest of a table: a tree of SHA-256 per source over its leaves, a tree over the sources, and a proof of each row.

Leaves are ranked within their source. The digits of a rank, to the base of the fan, say where a leaf stands in the tree,
so that nodes are made by grouping one digit column away at a time: five groupings nest 243 leaves into one struct, with
no shuffle but the one that brings a block together. Blocks of one tier are the leaves of the next. Proofs come down the
same way: ``transform`` walks a block's nested structs and collects the hashes beside each path, ``explode`` gives one
row a leaf, and a block meets the proof of its own root by a union that is grouped by block. Nothing is joined to leaves,
no row holds more than a block, and the driver sees the root and the largest rank only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, plain, ranked

FAN = 3
DEPTH = 5
BLOCK = FAN**DEPTH
PATH = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(column: Column) -> Column:
    """A value as text that says its own length in bytes; ``-`` for null."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(*columns: Column) -> Column:
    return digest(F.concat(*[field(c) for c in columns]))


def _hashes(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda k: k["node"]["h"]), "")


def _nest(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, n, pos, h, item) to blocks (grp, n, block, node): digit columns grouped away from the last to the first.

    A group of n nodes ends where one is left; levels above that pass the hash on.
    """
    digits = [f"d{i}" for i in range(DEPTH)]
    places = [F.expr(f"pos div {FAN**i} % {FAN}").alias(d) for i, d in enumerate(digits)]
    rows = nodes.select("grp", "n", F.expr(f"pos div {BLOCK}").alias("block"), *places, F.struct("h", "item").alias("node")).repartition("grp", "block")
    for i, d in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(F.col(d).alias("d"), "node")))
        rows = rows.groupBy("grp", "n", "block", *digits[i + 1 :]).agg(kids.alias("kids"))
        own = F.when(F.col("n") > FAN**i, digest(_hashes(F.col("kids")))).otherwise(F.col("kids")[0]["node"]["h"])
        rows = rows.withColumn("node", F.struct(own.alias("h"), "kids")).drop("kids")
    return rows


def _tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Blocks of each tier, from the leaves up, until every group (of ``most`` nodes at most) is one block."""
    found = [materialize(_nest(nodes), "blocks")]
    while (most := -(-most // BLOCK)) > 1:
        below = found[-1].select("grp", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("block").alias("pos"), F.col("node.h").alias("h"), F.struct(F.col("block").alias("pos")).alias("item"))
        found.append(materialize(_nest(below), "blocks"))
    return found


def _leaves(node: Column, n: Column, level: int, above: Column) -> Column:
    """All leaves (item, path) under a nested node; a path holds the hashes left and right of it, the lowest level first."""
    if not level:
        return F.array(F.struct(node["item"].alias("item"), above.alias("path")))
    kids = node["kids"]

    def under(kid: Column, place: Column) -> Column:
        beside = F.struct(_hashes(F.slice(kids, F.lit(1), place)).alias("l"), _hashes(F.slice(kids, place + 2, F.lit(FAN))).alias("r"))
        own = F.when(n > FAN ** (level - 1), F.array(beside)).otherwise(F.array().cast(PATH))
        return _leaves(kid["node"], n, level - 1, F.concat(own, above))

    return F.flatten(F.transform(kids, under))


def _proofs(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tops`` (grp, top, path: above the group's root) carried down to the leaves: (grp, top, item, path)."""
    above, rows = tops.withColumn("block", F.lit(0).cast("long")), None
    for blocks in reversed(tiers):
        down = blocks.select("grp", "block", "n", "node", F.lit(None).cast("string").alias("top"), F.lit(None).cast(PATH).alias("path"))
        both = down.unionByName(above.select("grp", "block", "top", "path"), allowMissingColumns=True)
        met = both.groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "top", "path")])
        rows = met.select("grp", "top", F.explode(_leaves(F.col("node"), F.col("n"), DEPTH, F.col("path"))).alias("leaf")).select("grp", "top", "leaf.item", "leaf.path")
        if blocks is not tiers[0]:
            above = rows.select("grp", "top", F.col("item.pos").alias("block"), "path")
    return rows


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the hashes beside its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def merkle_manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claim: Column | None = None) -> DataFrame:
    """key, source, leaf, claimed_leaf, subroot, root, path, proof_sha256, folded_root, verified: a row for each row of ``docs``.

    Leaves of a source ascend by key, null first, equal keys by their hash; repeated rows are leaves of their own. Null
    sources are one source, before all others. ``claim`` is the hash to prove, as a column over ``docs`` (the leaf itself
    by default). An empty table gives an empty one. Other columns are not read.
    """
    own = leaf_hash(*[F.col(f"`{c}`") for c in fields])
    grp = F.when(F.col(f"`{source}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{source}`")))
    names = list(dict.fromkeys([key, source, *fields]))
    read = plain(docs, *names).select(F.col(f"`{key}`").alias("k"), grp.alias("grp"), own.alias("leaf"), (own if claim is None else claim).alias("claimed"))
    rows = materialize(read, "leaves")
    placed = ranked(rows, ["grp"], ["k", "leaf", "claimed"], "leaves-ranked")
    most = placed.agg(F.max("of")).first()[0]
    if most is None:
        nothing = {"subroot": "string", "root": "string", "path": PATH, "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
        return rows.select(F.col("k").alias(key), F.col("grp").alias(source), "leaf", F.col("claimed").alias("claimed_leaf"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    nodes = placed.select("grp", F.col("of").alias("n"), F.col("place").alias("pos"), F.col("leaf").alias("h"), F.struct("k", "leaf", "claimed").alias("item"))
    tiers = _tiers(nodes, most)
    discard(rows, placed)
    subroots = ranked(tiers[-1].select("grp", F.col("node.h").alias("h")), [], ["grp"], "subroots")
    upper = subroots.select(F.lit("").alias("grp"), F.col("of").alias("n"), F.col("place").alias("pos"), "h", F.struct(F.col("grp").alias("pos"), F.col("h").alias("h")).alias("item"))
    above = _tiers(upper, subroots.count())
    root = above[-1].select("node.h").first()[0]
    top = docs.sparkSession.range(1).select(F.lit("").alias("grp"), F.lit("").alias("top"), F.array().cast(PATH).alias("path"))
    sources = materialize(_proofs(above, top).select(F.col("item.pos").alias("grp"), F.col("item.h").alias("top"), "path"), "source-proofs")
    discard(subroots, *above)
    found = _proofs(tiers, sources)
    found = found.withColumn("folded_root", folded(F.col("path"), F.col("item.claimed")))
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return found.select(
        F.col("item.k").alias(key), F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias(source), F.col("item.leaf").alias("leaf"), F.col("item.claimed").alias("claimed_leaf"), F.col("top").alias("subroot"),
        F.lit(root).alias("root"), "path", digest(beside).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def without_line_ends(key: Column, text: Column, *before: Column) -> Column:
    """The leaf hash of rows whose key has an even CRC-32 as if the line ends of their text were lost; of others as they are."""
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return leaf_hash(*before, F.when(hit, F.translate(text, "\n", "")).otherwise(text))
