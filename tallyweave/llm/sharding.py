"""Sharding by balanced label propagation.

A vertex is a bundle of documents of one text: at most some 256 of a group that may hold a third of all rows, mostly one
document. Bundles of equal texts are linked to the first of their group; a group that no shard can hold is first dealt
into chunks of half a shard, each with a first of its own. A label is a shard. Each round joins links with
labels, counts the votes of a vertex's neighbours, and moves vertices to the shard with the most votes; of the weight
that wants into a shard, the part that its quota admits moves, chosen by a hash. Rounds alternate between half of the
vertices following all neighbours, and all vertices following smaller neighbours, which keeps two of them from trading
places for ever. Documents without links fill what is left of each shard, so that row counts differ by one at most. A
shard's rows are numbered through ranges of a sort, never in one task. The driver sees sums of weights by pair of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, plain, ranked

BUNDLE = 256
SPREAD = 1 << 20


def _below(ratios: list[float], shard: Column, *by: Column) -> Column:
    """Whether a hash of ``by`` lies under the ratio of the shard."""
    limits = F.array(*[F.lit(int(r * SPREAD)) for r in ratios])
    return F.pmod(F.xxhash64(*by), F.lit(SPREAD)) < F.element_at(limits, shard + 1)


def admitted(flows: dict[tuple[int, int], int], sizes: list[int], capacity: int) -> list[float]:
    """The part of the weight that wants into each shard which its quota admits: room, and what leaves it meanwhile.

    ``flows`` is the weight by (from, to). Parts only fall from round to round, until no shard is overfull.
    """
    shards, parts = len(sizes), [1.0] * len(sizes)
    into = [sum(w for (_, t), w in flows.items() if t == s) for s in range(shards)]
    for _ in range(200):
        out = [0.0] * shards
        for (s, t), w in flows.items():
            out[s] += w * parts[t]
        now = [min(p, max(0.0, capacity - size + o) / i) if i else p for p, size, o, i in zip(parts, sizes, out, into)]
        if max(a - b for a, b in zip(parts, now)) < 1e-4:
            break
        parts = now
    return [min(a, b) for a, b in zip(parts, now)]


def balanced_labels(vertices: DataFrame, links: DataFrame, shards: int, capacity: int, rounds: int = 8) -> DataFrame:
    """``vertices`` (id, weight) to (id, weight, label): labels from 0 to ``shards`` - 1 that leave few ``links`` (a, b,
    weight) between shards, with about ``capacity`` of weight in each at most.

    Ids are unique and not null. Links to unknown vertices and to oneself count nothing; repeated links add up. Labels
    start from a hash of the id. Two rounds without a move end the work.
    """
    state = materialize(vertices.select("id", "weight", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("label")), "labels")
    both = links.filter("a != b").select("a", "b", "weight")
    both = both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    still = 0
    for step in range(rounds):
        own = state.select(F.col("id").alias("a"), F.col("label").alias("own"), F.col("weight").alias("size"))
        other = state.select(F.col("id").alias("b"), "label")
        asked = both.filter("b < a") if step % 2 else both.filter(F.pmod(F.xxhash64("a", F.lit(step)), F.lit(2)) == 0)
        votes = asked.join(other, "b").groupBy("a", "label").agg(F.sum("weight").alias("votes")).join(own, "a")
        best = votes.groupBy("a", "own", "size").agg(F.max(F.struct("votes", F.negate("label").alias("label"))).alias("best"), F.sum(F.when(F.col("label") == F.col("own"), F.col("votes"))).alias("stay"))
        wants = materialize(best.filter(F.col("best.votes") > F.coalesce("stay", F.lit(0))).select(F.col("a").alias("id"), "own", "size", F.negate("best.label").alias("into")), "wants")
        sizes = [0] * shards
        for label, weight in state.groupBy("label").agg(F.sum("weight")).collect():  # a row a shard
            sizes[label] = weight
        flows = {(r["own"], r["into"]): r["w"] for r in wants.groupBy("own", "into").agg(F.sum("size").alias("w")).collect()}  # a row a pair of shards
        if flows:
            moves = wants.filter(_below(admitted(flows, sizes, capacity), F.col("into"), F.col("id"), F.lit(step))).select("id", "into")
            last, state = state, materialize(state.join(moves, "id", "left").select("id", "weight", F.coalesce("into", "label").alias("label")), "labels")
            discard(last)
        discard(wants)
        still = 0 if flows else still + 1
        if still == 2:
            break
    return state


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot, group_rows: each row's shard, and its place there, from 0 without gaps.

    Row counts of shards differ by one at most. Rows of equal texts share a shard as long as their group fits; a null
    text is in no group, has size 1 and the CRC-32 of no bytes. Null and repeated keys are rows like others, an empty
    table gives an empty one. Other columns are not read.
    """
    raw = F.col(f"`{text}`")
    size = F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + 1
    read = plain(docs, *dict.fromkeys([key, text])).select(F.col(f"`{key}`").alias("key"), size.alias("size"), F.coalesce(F.crc32(raw.cast("binary")), F.lit(0)).cast("long").alias("crc"), F.md5(raw.cast("binary")).alias("twin"))
    rows = materialize(read.withColumn("row", F.monotonically_increasing_id()), "rows")
    count = rows.count()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(max(1, count // BUNDLE))))
    bundles = materialize(salted.filter("twin IS NOT NULL").groupBy("twin", "salt").agg(F.min("row").alias("id"), F.count("*").alias("weight")), "bundles")
    groups = bundles.groupBy("twin").agg(F.sum("weight").alias("group_rows")).filter("group_rows > 1")
    capacity = max(1, count // shards)
    chunks = F.when(F.col("group_rows") <= capacity, 1).otherwise(F.ceil(F.col("group_rows") / max(1, capacity // 2)))
    linked = bundles.join(groups, "twin").withColumn("chunk", F.pmod(F.xxhash64("id"), chunks))
    linked = materialize(linked.join(linked.groupBy("twin", "chunk").agg(F.min("id").alias("first")), ["twin", "chunk"]).drop("chunk"), "linked")
    links = linked.filter("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"), "weight")
    state = balanced_labels(linked.select("id", "weight"), links, shards, capacity, rounds)
    labelled = linked.join(state.select("id", "label"), "id")
    whole = labelled.groupBy("twin").agg((F.min("label") == F.max("label")).alias("whole"))
    spot = labelled.join(whole, "twin").select("twin", "salt", "label", "whole", "group_rows")
    # whole groups come first in their shard; what goes beyond its share joins the rows without links
    placed = salted.join(spot, ["twin", "salt"], "left").select("key", "size", "crc", "row", F.coalesce("label", F.lit(shards)).alias("label"), F.coalesce(~F.col("whole"), F.lit(False)).alias("cut"), F.coalesce("group_rows", F.lit(1)).alias("group_rows"))
    order = ranked(placed.withColumn("dice", F.xxhash64("row")), ["label"], ["cut", "dice", "row"], "placed")
    have = [0] * (shards + 1)
    for label, n in order.groupBy("label").agg(F.max("of")).collect():  # a row a shard
        have[label] = n
    share = [count // shards + (s < count % shards) for s in range(shards)]
    kept = [min(a, b) for a, b in zip(have, share)]
    over, short, beyond, lack = [], [], have[shards], 0
    for s in range(shards):
        over.append(beyond)
        short.append(lack)
        beyond, lack = beyond + have[s] - kept[s], lack + share[s] - kept[s]
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("label") + 1)
    loose = F.when(F.col("label") == shards, F.col("place")).when(F.col("place") >= at([*kept, 0]), at([*over, 0]) + F.col("place") - at([*kept, 0]))
    ends = [lo + a - b for lo, a, b in zip(short, share, kept)]
    free = sum([F.when(F.col("loose") >= e, 1).otherwise(0) for e in ends[:-1]], F.lit(0))
    out = order.withColumn("loose", loose).withColumn("shard", F.when(F.col("loose").isNull(), F.col("label")).otherwise(free).cast("int"))
    base = F.element_at(F.array(*[F.lit(k - lo).cast("long") for k, lo in zip(kept, short)]), F.col("shard") + 1)
    slot = F.when(F.col("loose").isNull(), F.col("place")).otherwise(F.col("loose") + base)
    return out.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", slot.alias("slot"), "group_rows")
