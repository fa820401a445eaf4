"""N-gram Jaccard join by signature trees.

Every document is a set of word 4-grams. Documents with equal sets form one class. A class is listed under the
rarest part of its set (the prefix that any partner must share), and each list is searched with a signature tree:
leaves hold one class's token bitmap and size, inner nodes hold OR-combined bitmaps and size ranges. Pairs of nodes
are walked from the root down and dropped where even the largest possible overlap is too small. Those bitmaps are full
for long sets, so what survives is held against bitmaps that grow with the set. The rest is compared exactly, and links
give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, discard, distinct, materialize, mixed, plain, shingle_hashes, starts_of, tidy, whole_groups
from .components import connected_components

#: log2 of the number of counters that order shingles by frequency; the table has this fixed size for any input.
COUNT_BITS = 22
#: Parts in which the counters of tasks are summed.
PARTS = 256
#: Bits of a token bitmap.
BITMAP = 512
#: Classes in a leaf of a signature tree; children of an inner node.
LEAF, FANOUT = 32, 8
#: Classes of one list that a task holds; longer lists are dealt out as pairs of tiles.
TILE = 2048
#: doc_ids that are broadcast at most (some 30 MB).
MOST_BROADCAST = 1_000_000


def _set_of(text: bytes | None, words: WordHashes, width: int) -> np.ndarray:
    return distinct(shingle_hashes(words.of(text.lower().split()), width)) if text else np.empty(0, np.uint64)


def _bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP, np.uint8)
    bits[(mixed(s) % np.uint64(BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits)


def _sketch(s: np.ndarray) -> np.ndarray:
    """A bitmap of 8 to 16 bits a token, by the first bits of the tokens: that of half as many bits is its pairs' OR."""
    bits = max(3, (8 * len(s) - 1).bit_length())
    marks = np.zeros(1 << bits, np.uint8)
    marks[(s >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return np.packbits(marks)


def _may_share(n: int, x: np.ndarray, m: int, y: np.ndarray, num: int, den: int) -> bool:
    """Whether sets of ``n`` and ``m`` tokens with these sketches can overlap enough."""
    x, y = np.unpackbits(x), np.unpackbits(y)
    size = min(len(x), len(y))
    x, y = x.reshape(size, -1).max(1), y.reshape(size, -1).max(1)
    shared = min(n - int((x > y).sum()), m - int((y > x).sum()))
    return shared * (num + den) >= num * (n + m)


def _prints(width: int, bits: int):
    """Size, two fingerprints and the bitmap of each document's set, and at the end of a task how often each counter was met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, mask = WordHashes(), np.zeros(1 << bits, np.uint32), np.uint64((1 << bits) - 1)
        for batch in batches:
            n, f1, f2, maps, held = [], [], [], [], []
            for text in as_bytes(batch.column("text")):
                s = _set_of(text, words, width)
                n.append(len(s))
                f1.append(s.sum(dtype=np.uint64) if len(s) else 0)
                f2.append(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0)
                maps.append(_bitmap(s).tobytes() if len(s) else None)
                held.append(s & mask)
                if sum(map(len, held)) > 500_000:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(maps, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "n", "f1", "f2", "bitmap", "part", "counts"])
        if counts.any():
            parts = [x.tobytes() for x in counts.reshape(PARTS, -1)]
            none = pa.nulls(PARTS).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "n", "f1", "f2", "bitmap", "part", "counts"])

    return tidy(run)


@tidy
def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, x in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            v = np.frombuffer(x, np.uint32).astype(np.uint64)
            total[part] = total[part] + v if part in total else v
    if total:
        # a rank by eighths of powers of two is all that the order needs
        ranks = [np.minimum(255, np.log2(v + 1.0) * 8).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], ["part", "ranks"])


def _prefixes(ranks, width: int, num: int, den: int):
    """The shingles of which any partner of a document has at least one: its rarest, in one order for all. Listed by the
    first fingerprint of its set, so that copies are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rank = WordHashes(), np.frombuffer(ranks.value, np.uint8)
        mask = np.uint64(len(rank) - 1)
        for batch in batches:
            tokens, prints, held = [], [], 0
            for text in as_bytes(batch.column("text")):
                s = _set_of(text, words, width)
                if not len(s):
                    continue
                size = len(s) - -(-num * len(s) // den) + 1
                key = (rank[(s & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                tokens.append(s[np.argsort(key, kind="stable")[:size]])
                prints.append(np.full(size, s.sum(dtype=np.uint64)).view(np.int64))
                held += size
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(prints))], ["token", "f1"])
                    tokens, prints, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(prints))], ["token", "f1"])

    return tidy(run)


def _sets(width: int):
    """The set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [_set_of(text, words, width).tobytes() for text in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.binary())], ["doc", "tokens"])

    return tidy(run)


def _sketches(width: int):
    """Size and sketch of the set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [_set_of(text, words, width) for text in as_bytes(batch.column("text"))]
            columns = pa.array(map(len, sets), pa.int64()), pa.array([_sketch(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc", "n", "sketch"])

    return tidy(run)


def signature_tree_pairs(n: np.ndarray, maps: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose overlap may reach ``num``/``den`` of their union, by a walk of two signature trees.

    ``maps``: bitmaps as rows of 64-bit words. A node's bound: at most ``slack`` tokens of a member hide behind
    others on the same bit, so no two members of nodes X and Y share more than the smaller slack plus the bits
    that both OR-combined bitmaps have.
    """
    order = np.lexsort((maps[:, 0], maps[:, 1], n))
    slack = n - np.bitwise_count(maps).sum(1).astype(np.int64)
    levels = []
    rows = order
    step = [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
    node = [(np.bitwise_or.reduce(maps[r], 0), n[r].min(), n[r].max(), slack[r].max()) for r in step]
    ors, low, high, hide = (np.array([x[k] for x in node]) for k in range(4))
    levels.append((ors, low, high, hide))
    while len(low) > 1:
        cuts = np.arange(0, len(low), FANOUT)
        ors, low, high, hide = np.bitwise_or.reduceat(ors, cuts, 0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(hide, cuts)
        levels.append((ors, low, high, hide))

    def may(level, x, y):
        ors, low, high, hide = level
        sized = den * np.minimum(high[x], high[y]) >= num * np.maximum(low[x], low[y])
        most = np.minimum(hide[x], hide[y]) + np.bitwise_count(ors[x] & ors[y]).sum(1)
        return sized & (most * (num + den) >= num * (low[x] + low[y]))

    x = y = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, 0, -1):
        size = len(levels[depth - 1][1])
        i = np.minimum(x[:, None] * FANOUT + np.arange(FANOUT), size - 1)
        j = np.minimum(y[:, None] * FANOUT + np.arange(FANOUT), size - 1)
        x, y = np.repeat(i, FANOUT, 1).ravel(), np.tile(j, (1, FANOUT)).ravel()
        both = np.unique(np.stack((x, y))[:, x <= y], axis=1)
        x, y = both[:, may(levels[depth - 1], both[0], both[1])]
    out = []
    for a, b in zip(x, y, strict=True):
        p, q = order[a * LEAF : (a + 1) * LEAF], order[b * LEAF : (b + 1) * LEAF]
        i, j = np.repeat(p, len(q)), np.tile(q, len(p))
        if a == b:
            upper = np.triu_indices(len(p), 1)
            i, j = p[upper[0]], p[upper[1]]
        out.append(np.stack((i, j)))
    pairs = np.concatenate(out, 1) if out else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def _may_link(n, maps, i, j, num, den):
    """Leaves: a bit that only one side has is a token that the other side lacks."""
    keep = den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])
    i, j = i[keep], j[keep]
    only_i, only_j = (np.bitwise_count(maps[a] & ~maps[b]).sum(1).astype(np.int64) for a, b in ((i, j), (j, i)))
    keep = np.minimum(n[i] - only_i, n[j] - only_j) * (num + den) >= num * (n[i] + n[j])
    return i[keep], j[keep], only_i[keep], only_j[keep]


def _forest(docs, n, maps, i, j, only_i, only_j, num, den):
    """Of the likely links of lists, the most similar ones that join them together: fewer than their members."""
    filled = np.bitwise_count(maps).sum(1) / (64 * maps.shape[1] + 1.0)
    shared = np.minimum(n[i] - only_i / (1 - filled[j]), n[j] - only_j / (1 - filled[i]))
    similar = shared / np.maximum(1, n[i] + n[j] - shared)
    top = dict(zip(docs.tolist(), docs.tolist(), strict=True))

    def root(v):
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    keep = []
    for k in np.argsort(-similar):
        if similar[k] * den < num * 0.97:
            break
        a, b = root(docs[i[k]]), root(docs[j[k]])
        if a != b:
            top[a] = b
            keep.append(k)
    return i[keep], j[keep]


def _search(num: int, den: int, forest: bool):
    """Candidate pairs of each list; forest: only enough of the likely ones to join the list."""
    keys = ("hub", "lo", "hi", "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size_kept, hub = [], 0, None

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(kept, 1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for table in whole_groups(batches, keys):
            # a pair that several lists of one hub hold is given out once
            if kept and (table.column("hub")[0].as_py() != hub or size_kept > 1_000_000):
                yield flush()
                kept, size_kept = [], 0
            hub = table.column("hub")[-1].as_py()
            at = starts_of(table, keys)
            size = np.diff(at)
            doc, comp, n, tile, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "comp", "n", "tile", "lo", "hi"))
            maps = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(table.num_rows, -1)
            found = []

            def take(i, j, doc=doc, comp=comp, tile=tile, lo=lo, hi=hi, n=n, maps=maps, found=found, joined=False):
                for k in range(0, len(i), 500_000):
                    a, b = i[k : k + 500_000], j[k : k + 500_000]
                    new = (comp[a] != comp[b]) & (doc[a] != doc[b]) & ((lo[a] == hi[a]) | (tile[a] != tile[b]))
                    a, b, only_a, only_b = _may_link(n, maps, a[new], b[new], num, den)
                    if forest and joined:
                        a, b = _forest(doc, n, maps, a, b, only_a, only_b, num, den)
                    found.append(np.stack((np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]))))

            for m in range(2, LEAF + 1):
                if len(first := at[:-1][size == m]):
                    p, q = np.triu_indices(m, 1)
                    take((first[:, None] + p).ravel(), (first[:, None] + q).ravel(), joined=True)
            for k in np.flatnonzero(size > LEAF):
                rows = slice(at[k], at[k + 1])
                i, j = signature_tree_pairs(n[rows], maps[rows], num, den)
                take(i + at[k], j + at[k], joined=True)
            if found:
                kept.append(np.unique(np.concatenate(found, 1), axis=1))
                size_kept += kept[-1].shape[1]
        if kept:
            yield flush()

    return tidy(run)


def _lists(entries: DataFrame, described: DataFrame, tiles_of_pairs: bool) -> DataFrame:
    """The lists (token, doc, comp) that have several components, with what the search needs; long ones in tiles.

    Lists with the same smallest member go to one task, as the same pairs tend to meet in many of them; a member of very
    many long lists is spread over several.
    """
    several = entries.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("members"), F.min("doc").alias("hub")).filter("least < most")
    spread = several.groupBy("hub").agg(F.ceil(F.sum("members") / F.lit(4 * TILE)).alias("shares"))
    several = several.join(spread, "hub").withColumn("share", F.pmod("token", "shares"))
    entries = entries.join(several.select("token", "members", "hub", "share"), "token")
    k = F.ceil(F.col("members") / F.lit(TILE)).cast("int")
    dealt = entries.withColumn("tile", F.when(k > 1, F.pmod(F.xxhash64("doc"), k)).otherwise(0).cast("int"))
    if tiles_of_pairs:
        dealt = dealt.withColumn("other", F.explode(F.when(k > 1, F.sequence(F.lit(0), k - 1)).otherwise(F.array(F.lit(0))))).withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    else:
        dealt = dealt.withColumn("lo", F.col("tile")).withColumn("hi", F.col("tile"))
    full = dealt.join(described, "doc")
    return full.select("hub", "share", "lo", "hi", "token", "tile", "doc", "comp", "n", "bitmap").repartition("hub", "share", "lo", "hi").sortWithinPartitions("hub", "lo", "hi", "token")


def _compare(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tidy(run)


def _not_refuted(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(c).to_pylist() for c in ("n", "x", "m", "y"))
            keep = [_may_share(a, np.frombuffer(b, np.uint8), c, np.frombuffer(d, np.uint8), num, den) for a, b, c, d in zip(n, x, m, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tidy(run)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these doc_ids: the ids are broadcast if they are few enough, else both are shuffled."""
    few = ids.count() <= MOST_BROADCAST
    return docs.join(ids.hint("broadcast" if few else "shuffle_hash"), "doc_id", "left_semi")


def linked(lists: DataFrame, described: DataFrame, sets_of, num: int, den: int, one_in: int = 8, sketches_of=None) -> tuple[DataFrame, DataFrame]:
    """Two tables of links (a, b: long), materialized, that join all pairs of ``lists`` with similar sets, and no others.

    ``lists`` (token, doc), ``described`` (doc, n, bitmap), both materialized; ``sets_of(ids)`` gives (doc, tokens) for
    the column ``doc`` of ids, ``sketches_of(ids)`` (doc, n, sketch) where sets can be long. First a forest of likely links of one list in ``one_in`` is verified. Then all lists that
    still hold several components are searched, for pairs across components only. So what is verified is about as
    many pairs as members for groups of near copies, while every pair of a list is linked, or refuted, or already
    joined by links.
    """

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("doc")).unionAll(pairs.select(F.col("b").alias("doc"))).distinct()

    def not_refuted(pairs: DataFrame) -> DataFrame:
        own = materialize(sketches_of(ends(pairs)), "sketches")
        both = pairs.join(own.toDF("a", "n", "x"), "a").join(own.toDF("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
        left = materialize(both.mapInArrow(_not_refuted(num, den), "a long, b long"), "left")
        discard(own, pairs)
        return left

    def verified(pairs: DataFrame) -> DataFrame:
        sets = materialize(sets_of(ends(pairs)), "sets")
        x = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x"))
        y = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y"))
        found = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_compare(num, den), "a long, b long"), "links")
        discard(sets, pairs)
        return found

    sample = lists.filter(F.pmod("token", F.lit(one_in)) == 0).withColumn("comp", F.col("doc"))
    first = verified(materialize(_lists(sample, described, False).mapInArrow(_search(num, den, True), "a long, b long").distinct(), "likely"))
    early = connected_components(first)
    known = materialize(lists.join(early.select(F.col("node").alias("doc"), "component"), "doc", "left").select("token", "doc", F.coalesce("component", "doc").alias("comp")), "known")
    rest = materialize(_lists(known, described, True).mapInArrow(_search(num, den, False), "a long, b long").distinct(), "rest")
    discard(known)
    return first, verified(not_refuted(rest) if sketches_of else rest)


def ngram_jaccard_components(documents: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Classes of documents linked by word-n-gram Jaccard similarity of at least ``num``/``den``.

    Reads ``doc_id`` (long) and ``text``. Words are lower-cased in A-Z only and split at ASCII white space; a text of
    fewer than ``width`` words is one shingle. Returns one row per input row: ``doc_id``, ``n_shingles`` (0 for null or
    wordless text), ``component_id`` (the smallest doc_id that links reach, the own one without any).

    No cap: every pair that can reach the threshold is compared unless other links already join its two sides.
    Rows that share a doc_id count as one node. A null doc_id takes no part and gets a null component.
    """
    spark = documents.sparkSession
    docs = plain(documents, "doc_id", "text")
    prints = materialize(docs.mapInArrow(_prints(width, COUNT_BITS), "doc_id long, n long, f1 long, f2 long, bitmap binary, part int, counts binary"), "prints")
    sets = prints.filter("part IS NULL").select("doc_id", "n", "f1", "f2")
    # a table of fixed size (2**COUNT_BITS bytes), whatever the input's
    parts = prints.filter("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(_sum_counts, "part int, ranks binary").collect()
    ranks = spark.sparkContext.broadcast(b"".join(r.ranks for r in sorted(parts, key=lambda r: r.part)) or bytes(1))

    full = prints.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("bitmap").alias("bitmap")), "classes")
    copies = classes.filter("members > 1")
    described = classes.select(F.col("rep").alias("doc"), F.col("n").cast("int").alias("n"), "bitmap")
    entries = materialize(docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(_prefixes(ranks, width, num, den), "token long, f1 long"), "entries")
    # one shuffle finds the tokens of several sets and lists these
    whole = Window.partitionBy("token")
    listed = entries.withColumns({"least": F.min("f1").over(whole), "most": F.max("f1").over(whole)}).filter("least < most").select("token", "f1").distinct()
    lists = materialize(listed.join(classes.select("f1", "rep"), "f1").select("token", F.col("rep").alias("doc")), "lists")

    def sets_of(ids: DataFrame) -> DataFrame:
        return _only(docs, ids.select(F.col("doc").alias("doc_id"))).mapInArrow(_sets(width), "doc long, tokens binary")

    def sketches_of(ids: DataFrame) -> DataFrame:
        return _only(docs, ids.select(F.col("doc").alias("doc_id"))).mapInArrow(_sketches(width), "doc long, n long, sketch binary")

    links = linked(lists, described, sets_of, num, den, sketches_of=sketches_of)
    discard(entries, lists)

    member = sets.join(copies.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left").withColumn("rep", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    member = materialize(member.select("doc_id", "n", "rep"), "members")
    # a doc_id on several rows ties their classes together
    tied = member.filter("doc_id != rep").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = connected_components(links[0].unionByName(links[1]).unionByName(tied)).select(F.col("node").alias("rep"), "component")
    discard(prints, classes, *links)
    return member.join(final, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_one_of_each_component(documents: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The rows of ``documents``, all columns, whose doc_id is the smallest of its component, one row for each doc_id.

    Rows with a null doc_id or a wordless text stay as they are, but for repeats of a doc_id.
    """
    member = materialize(ngram_jaccard_components(documents, width, num, den).filter("doc_id IS NOT NULL"), "components")
    gone = member.filter("doc_id != component_id").select("doc_id").distinct()
    twice = member.groupBy("doc_id").count().filter("count > 1").select("doc_id").join(gone, "doc_id", "left_anti")
    gone, twice = materialize(gone, "gone"), materialize(twice, "twice")
    discard(member)

    def few(ids: DataFrame) -> DataFrame:
        return ids.hint("broadcast" if ids.count() <= MOST_BROADCAST else "shuffle_hash")

    once = documents.join(few(gone.unionByName(twice)), "doc_id", "left_anti")
    return once.unionByName(documents.join(few(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
