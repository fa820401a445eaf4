"""Substring dedup: passages that stand at several places of the corpus, alike or nearly, whatever lines they lie in.

The paragraphs of a text are its lines of UNIT words or more, and besides stretches of UNIT words that start where the
words themselves say so, so that a passage holds the same ones wherever it stands. MinHash bands find colliding paragraphs, exact Jaccard verifies them, and of each
component of links the first place stays. Of what goes, the removed paragraphs of a text are joined to stretches, which
grow word by word at both ends for as long as the words before and after the kept place are the same, and over single
exchanged words between such.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, discard, distinct, materialize, mixed, plain, shingle_hashes, tidy
from .components import connected_components
from .ngram_join import BITMAP, MOST_BROADCAST, linked

#: Words of a paragraph within lines, and word places in a row of which one at least starts one. So any UNIT + EVERY - 1
#: = 39 words hold a whole paragraph that they choose by themselves: also a passage of 51 words or more with a word in
#: fifty exchanged (a similarity of 0.8 or more) nearly always has one between its changes.
UNIT = EVERY = 20
#: Words of a stretch, once it has grown, below which it is no passage.
LEAST = 26
#: Words on either side of a stretch that it can grow by, and words in a row that must be the same for it to go on after
#: an exchanged one.
LOOK, BRIDGE = 64, 5
#: A class of paragraphs with more than this part of all repeated places is sought by a broadcast.
HOT = 1024
#: Words whose hash decides where a paragraph starts.
CHOOSER = 4
WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


def tune_bands(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """Bands and rows: the most rows for which bands reach ``recall`` at ``similarity`` within so many hashes."""
    for rows in range(hashes, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if bands * rows <= hashes:
            return bands, rows
    return hashes, 1


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` word hashes, put together from runs of powers of two; none if there are fewer words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out, done, part, size = None, 0, words, 1
    while True:
        if n & size:
            most = len(words) - done - size + 1
            out = part[:most] if out is None else out[:most] * np.uint64(0x9E3779B97F4A7C15) + part[done : done + most]
            done += size
        if done == n:
            return mixed(out)
        part = part[:-size] * (np.uint64((0xC2B2AE3D27D4EB4F + size * size * 0x2809D0EA8E2B79C0) % 2**64)) + part[size:]
        size *= 2


def _sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        values = op(values[:-step], values[step:])
        size += step
    return values


def paragraph_starts(words: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """First words of the paragraphs of UNIT words of a text, given as word hashes, or of several texts of ``counts`` words, one after
    another: the places whose next CHOOSER words hash lowest in some EVERY places in a row of their text (in all places,
    if it has fewer). Equal words choose equal places, so ties all count."""
    counts = np.array([len(words)]) if counts is None else counts
    places = np.maximum(0, counts - UNIT + 1)
    before = np.cumsum(places) - places
    at = np.arange(places.sum()) + np.repeat(np.cumsum(counts) - counts - before, places)
    if not len(at):
        return at
    values, text = run_hashes(words, CHOOSER)[at], np.repeat(np.arange(len(counts)), places)
    chosen = np.zeros(len(at), bool)
    if len(at) >= EVERY:
        inside = text[EVERY - 1 :] == text[: len(at) - EVERY + 1]
        lows = np.pad(np.where(inside, _sliding(np.minimum, values, EVERY), np.uint64(0)), EVERY - 1)
        chosen = _sliding(np.maximum, lows, EVERY) == values
    few = (places > 0) & (places < EVERY)
    if few.any():
        lowest = np.zeros(len(counts), np.uint64)
        lowest[places > 0] = np.minimum.reduceat(values, before[places > 0])
        chosen |= few[text] & (values == lowest[text])
    return at[chosen]


def _first_of_neighbours(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a paragraph is no mere shift of one with the same key that overlaps it."""
    order = np.argsort(keys, kind="stable")
    again = (keys[order][1:] == keys[order][:-1]) & (np.abs(np.diff(starts[order])) < UNIT)
    fresh = np.ones(len(keys), bool)
    fresh[order[1:][again]] = False
    return fresh


def _text_id(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def lines(counts: list[int]) -> list[tuple[int, int]]:
    """First word and number of words of each line of UNIT words or more, from the words of all lines of a text."""
    found, at = [], 0
    for n in counts:
        if n >= UNIT:
            found.append((at, n))
        at += n
    return found


def _set_sizes(shingles: np.ndarray) -> np.ndarray:
    """How many different ones each column has."""
    if not shingles.shape[1]:
        return np.empty(0, np.int64)
    ordered = np.sort(shingles, 0)
    return 1 + (ordered[1:] != ordered[:-1]).sum(0)


def _maps(shingles: np.ndarray, paragraph: np.ndarray, many: int) -> np.ndarray:
    """Bitmaps of the shingles of each of so many paragraphs."""
    bits = np.zeros((many, BITMAP), np.uint8)
    bits[paragraph, (shingles % np.uint64(BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


class Paragraphs:
    """The paragraphs of texts, given as word hashes of all, words of each, and lines of UNIT words or more (text, first
    word, words): which text they are of, where they start, how many words they have, two hashes of their words, and for
    each band a key from ``rows`` MinHash values of its set of ``width``-word shingles and whether the paragraph is
    listed under it."""

    def __init__(self, bands: int, rows: int, width: int):
        self.bands, self.rows, self.width = bands, rows, width
        self.factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def of(self, words: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
        first_of_text = np.cumsum(counts) - counts
        starts = paragraph_starts(words, counts)
        text = np.concatenate((np.searchsorted(first_of_text + counts, starts, side="right"), whole[:, 0]))
        sizes = np.concatenate((np.full(len(starts), UNIT), whole[:, 2]))
        firsts = np.concatenate((starts, first_of_text[whole[:, 0]] + whole[:, 1]))
        raw = words.tobytes()
        prints = b"".join([xxhash.xxh3_128_digest(raw[8 * a : 8 * (a + k)]) for a, k in zip(firsts.tolist(), sizes.tolist(), strict=True)])
        f1, f2 = np.frombuffer(prints, "<u8").astype(np.uint64).reshape(-1, 2).T
        s = shingle_hashes(words, self.width)
        near = s[np.arange(UNIT - self.width + 1)[:, None] + starts]
        low = [(near * f).min(0) for f in self.factors]
        if len(whole):
            many = whole[:, 2] - self.width + 1
            first = np.cumsum(many) - many
            own = s[np.arange(many.sum()) + np.repeat(firsts[len(starts) :] - first, many)]
            low = [np.concatenate((x, np.minimum.reduceat(own * f, first))) for x, f in zip(low, self.factors, strict=True)]
        keys, listed = [], []
        order = np.argsort(text, kind="stable")
        for b in range(self.bands):
            key = np.full(len(sizes), b + 1, np.uint64)
            for x in low[b * self.rows : (b + 1) * self.rows]:
                key = mixed(key + x)
            key = key >> np.uint64(2) << np.uint64(2) | np.uint64(min(b, 3))  # the band shows in the last bits
            keys.append(key[order])
            # texts don't overlap, so a shift is always one of the same text
            listed.append(((sizes > UNIT) | _first_of_neighbours(key, firsts))[order])
        short_f2 = (f2 >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return (*(x[order] for x in (text, firsts - first_of_text[text], sizes, f1, short_f2)), keys, listed)


#: Words of texts that are described in one go; a longer text goes alone.
AT_ONCE = 100_000


def _described(bands: int, rows: int, width: int):
    names = ["doc_id", "text_id", "start", "size", "f1", "f2", *(f"b{k}" for k in range(bands))]
    paragraphs = Paragraphs(bands, rows, width)

    def record(held: list[tuple]) -> pa.RecordBatch:
        docs, texts, words, whole = zip(*held, strict=True)
        counts = np.array([len(x) for x in words])
        whole = np.array([(k, a, n) for k, own in enumerate(whole) for a, n in own], np.int64).reshape(-1, 3)
        text, start, size, f1, f2, keys, listed = paragraphs.of(np.concatenate(words), counts, whole)
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(docs))))), pa.int32())

        def lists(values: np.ndarray, kind: pa.DataType, valid: np.ndarray | None = None) -> pa.Array:
            flat = values.view(np.int64) if values.dtype == np.uint64 else values.astype(kind.to_pandas_dtype())
            return pa.ListArray.from_arrays(ends, pa.array(flat, kind, mask=None if valid is None else ~valid))

        columns = [lists(x, pa.int32()) for x in (start, size)] + [lists(f1, pa.int64()), lists(f2, pa.int32())]
        columns += [lists(k, pa.int64(), v) for k, v in zip(keys, listed, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.int64()), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, many = WordHashes(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                for doc, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), strict=True):
                    split = [line.split() for line in text.lower().split(b"\n")]
                    counts = [len(x) for x in split]
                    total = sum(counts)
                    if total < UNIT:
                        continue
                    if held and many + total > AT_ONCE:
                        yield record(held)
                        held, many = [], 0
                    held.append((doc, _text_id(text), words.of([x for line in split for x in line]), lines(counts)))
                    many += total
        if held:
            yield record(held)

    return tidy(run)


def _summaries(width: int):
    """Size and bitmap of the shingle sets of the paragraphs asked for (start, size, f1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part, rows = batch.slice(at, 250), ([], [], [])
                for text, own_id, asked in zip(as_bytes(part.column("text")), part.column("text_id").to_pylist(), part.column("asked").to_pylist(), strict=True):
                    if _text_id(text) != own_id:  # another row of this doc_id
                        continue
                    s = shingle_hashes(words.of(text.lower().split()), width)
                    by_size: dict[int, list[dict]] = {}
                    for a in asked:
                        by_size.setdefault(a["size"], []).append(a)
                    for size, own in by_size.items():
                        sets = s[np.arange(size - width + 1)[:, None] + np.array([a["start"] for a in own])]
                        rows[0].extend(a["f1"] for a in own)
                        rows[1].extend(_set_sizes(sets).tolist())
                        rows[2].extend(m.tobytes() for m in _maps(sets, np.arange(len(own)), len(own)))
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc", "n", "bitmap"])

    return tidy(run)


def _sets(width: int):
    """The shingle sets of the paragraphs asked for (start, size, f1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part, rows = batch.slice(at, 250), []
                for text, own_id, asked in zip(as_bytes(part.column("text")), part.column("text_id").to_pylist(), part.column("asked").to_pylist(), strict=True):
                    if _text_id(text) != own_id:  # another row of this doc_id
                        continue
                    own = text.lower().split()
                    rows += [(a["f1"], distinct(shingle_hashes(words.of(own[a["start"] : a["start"] + a["size"]]), width)).tobytes()) for a in asked]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], ["doc", "tokens"])

    return tidy(run)


@tidy
def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes (32 bits) of the words before or after the places asked for, nearest word first."""
    words = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part, rows = batch.slice(at, 250), []
            for doc, text, own_id, asked in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), part.column("text_id").to_pylist(), part.column("asked").to_pylist(), strict=True):
                if _text_id(text) != own_id:
                    continue
                own = text.lower().split()
                for a in asked:
                    p = a["place"]
                    near = own[p : p + LOOK] if a["after"] else own[max(0, p - LOOK) : p][::-1]
                    rows.append((doc, own_id, p, a["after"], (words.of(near) >> np.uint64(32)).astype(np.uint32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["doc_id", "text_id", "place", "after", "words"])


@tidy
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words in a row are the same at both places, but for single ones with BRIDGE equal words after them."""
    for batch in batches:
        more = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            n = min(len(x), len(y)) // 4
            differ = np.append(np.flatnonzero(np.frombuffer(x, np.uint32, n) != np.frombuffer(y, np.uint32, n)), n)
            ends = np.flatnonzero(np.diff(differ) <= BRIDGE)
            more.append(int(differ[ends[0]] if len(ends) else differ[-1]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_id", "first", "after")), pa.array(more, pa.int32())], ["doc_id", "text_id", "first", "after", "more"])


def _asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the rows of ``asked`` (doc_id, text_id, a struct ``a``) that they have, as arrays."""
    asked = materialize(asked.groupBy("doc_id", "text_id").agg(F.collect_list("a").alias("asked")), "asked")
    n, most = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()
    few = n <= MOST_BROADCAST // 10 and most <= MOST_BROADCAST
    return docs.join(asked.hint("broadcast" if few else "shuffle_hash"), "doc_id").select("doc_id", "text_id", "text", "asked")


def _place(name: str | None = None) -> Column:
    return F.struct(*[F.col(f"{name}.{c}" if name else c).alias(c) for c in ("doc_id", "text_id", "start", "size")])


def repeated_passages(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100, recall: float = 0.95, hashes: int = 6) -> DataFrame:
    """Passages of ``documents`` (doc_id, text) that stand twice or more, alike or nearly.

    Words are lower-cased in A-Z and split at ASCII white space. Two paragraphs (see above) link when the Jaccard similarity of their word ``width``-grams is ``num``/``den`` or more; bands are
    tuned to meet such a pair with ``recall`` at least, and equal paragraphs always. Every run of 39 words
    that stands twice holds a paragraph that is found; of passages that are alike by 0.8 or more in this measure, those
    without one in common are few (tests measure a recall above 0.9 in running text). Returns a row for each stretch of paragraphs of a text that are
    no first place of their component (removed), or that are (not removed): doc_id, text_id (of the text, where a doc_id
    has several), first_word, n_words, component (a number of its first paragraph), kept_doc_id, kept_first_word (the
    place that stays, for removed ones the one they were compared with), removed. A paragraph that overlaps the place
    that stays is no repeat of it. A stretch can take in a few words of its own beside a passage, with which a paragraph is
    still alike. Null texts, rows with a null doc_id and texts of fewer than UNIT words take no part, and
    stretches of fewer than LEAST words are none;
    rows of one doc_id with the same text count as one. Members of a component are never paired, and no group has a cap.
    """
    bands, rows = tune_bands(num / den, recall, hashes)
    keys = [f"b{k}" for k in range(bands)]
    docs = plain(documents, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, text_id long, start array<int>, size array<int>, f1 array<long>, f2 array<int>, " + ", ".join(f"{k} array<long>" for k in keys)
    found = materialize(docs.mapInArrow(_described(bands, rows, width), schema), "paragraphs")
    entries = found.select(F.explode(F.arrays_zip("f1", *keys)).alias("u")).select("u.f1", F.explode(F.array(*[f"u.{k}" for k in keys])).alias("token")).filter("token IS NOT NULL")
    # lists of one paragraph and its copies have no pair to compare
    shared = materialize(entries.groupBy("token").agg(F.min("f1").alias("least"), F.max("f1").alias("most")).filter("least < most").select("token"), "shared")
    lists = materialize(entries.join(shared, "token").select("token", F.col("f1").alias("doc")).distinct(), "lists")
    discard(shared)
    # what stays on disk from here on goes without keys, and without paragraphs that are alike to no other
    listed = lists.select(F.col("doc").alias("f1")).distinct().withColumn("listed", F.lit(True))
    described = found
    found = materialize(described.drop(*keys), "places")
    discard(described)
    # equal paragraphs are one class, at its first place; a class of many places is combined before the shuffle
    units = found.select("doc_id", "text_id", F.explode(F.arrays_zip("start", "size", "f1", "f2")).alias("u")).select("doc_id", "text_id", "u.*")
    classes = units.groupBy("f1", "f2").agg(F.min(_place()).alias("first"), (F.min(_place()) < F.max(_place())).alias("again"), F.count("*").alias("places"))
    classes = materialize(classes.join(listed, "f1", "left").filter("again OR listed"), "classes")
    spots = materialize(classes.filter("listed").groupBy("f1").agg(F.min("first").alias("first")).withColumnRenamed("f1", "doc"), "spots")
    twice = not found.groupBy("doc_id", "text_id").count().filter("count > 1").isEmpty()

    def read(ids: DataFrame, what, schema: str) -> DataFrame:
        """What is made of the sets of paragraphs, in a second reading of their texts."""
        ask = ids.select("first.doc_id", "first.text_id", F.struct("first.start", "first.size", F.col("doc").alias("f1")).alias("a"))
        made = _asked(docs, ask).mapInArrow(what(width), schema)
        return made.dropDuplicates(["doc"]) if twice else made

    def sets_of(ids: DataFrame) -> DataFrame:
        return read(spots.join(ids, "doc", "left_semi"), _sets, "doc long, tokens binary")

    described = materialize(read(spots, _summaries, "doc long, n int, bitmap binary"), "described")

    # first the lists of the first band, in which every paragraph is, then all others for what is not joined yet
    links = linked(lists, described.select("doc", "n", "bitmap"), sets_of, num, den, one_in=4)
    discard(lists, described, spots)
    component = materialize(connected_components(links[0].unionByName(links[1])).select(F.col("node").alias("f1"), "component"), "component")
    discard(*links)
    member = materialize(classes.select("f1", "f2", "first", "again", "places").join(component, "f1", "left").filter("again OR component IS NOT NULL").withColumn("component", F.coalesce("component", "f1")), "member")
    discard(classes, component)
    kept = member.groupBy("component").agg(F.min("first").alias("kept"))
    chosen = materialize(member.join(kept, "component").select("f1", "f2", "component", "first", "kept", "places"), "chosen")
    # classes with more than one in HOT of all places: fewer than HOT, so they are broadcast; no other has many places
    hot = chosen.filter(F.col("places") * HOT > (chosen.agg(F.sum("places")).first()[0] or 0))
    often = units.join(F.broadcast(hot), ["f1", "f2"])
    seldom = units.join(F.broadcast(hot.select("f1", "f2")), ["f1", "f2"], "left_anti").join(chosen.join(hot, ["f1", "f2"], "left_anti"), ["f1", "f2"])
    at = often.unionByName(seldom).select(_place().alias("place"), "component", "first", "kept").distinct()
    same_text = (F.col("place.doc_id") == F.col("kept.doc_id")) & (F.col("place.text_id") == F.col("kept.text_id"))
    apart = (F.col("place.start") >= F.col("kept.start") + F.col("kept.size")) | (F.col("kept.start") >= F.col("place.start") + F.col("place.size"))
    removed = F.when(F.col("place") == F.col("kept"), False).when(~same_text | apart, True)
    like = F.when(F.col("place") == F.col("first"), F.col("kept")).otherwise(F.col("first"))
    at = at.select("place.*", "component", like.alias("like"), removed.alias("removed")).filter("removed IS NOT NULL")
    text = Window.partitionBy("doc_id", "text_id", "removed").orderBy("start", "size")
    at = at.withColumn("end", F.col("start") + F.col("size"))
    at = at.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")).withColumn("stretch", F.sum("new").over(text))
    spans = at.groupBy("doc_id", "text_id", "removed", "stretch").agg(F.min("start").alias("first"), F.max("end").alias("end"), F.min_by("component", "start").alias("component"), F.min_by("like", "start").alias("left"), F.max_by("like", "end").alias("right"))
    spans = materialize(spans.drop("stretch"), "spans")
    discard(found, member, chosen)
    # the words around both places of a stretch's ends
    gone = spans.filter("removed")
    sides = [gone.select("doc_id", "text_id", "first", F.lit(False).alias("after"), F.col("first").alias("place"), "left.doc_id", "left.text_id", "left.start"), gone.select("doc_id", "text_id", "first", F.lit(True).alias("after"), F.col("end").alias("place"), "right.doc_id", "right.text_id", F.col("right.start") + F.col("right.size"))]
    sides = materialize(sides[0].union(sides[1]).toDF("doc_id", "text_id", "first", "after", "place", "like_doc", "like_text", "like_place"), "sides")
    ask = sides.select("doc_id", "text_id", "place", "after").union(sides.select("like_doc", "like_text", "like_place", "after")).distinct()
    around = read_words = materialize(_asked(docs, ask.select("doc_id", "text_id", F.struct("place", "after").alias("a"))).mapInArrow(_around, "doc_id long, text_id long, place int, after boolean, words binary"), "around")
    if twice:  # rows of one doc_id and text
        around = around.dropDuplicates(["doc_id", "text_id", "place", "after"])
    there = around.toDF("like_doc", "like_text", "like_place", "after", "y")
    both = sides.join(around.withColumnRenamed("words", "x"), ["doc_id", "text_id", "place", "after"]).join(there, ["like_doc", "like_text", "like_place", "after"])
    more = both.mapInArrow(_alike, "doc_id long, text_id long, first int, after boolean, more int").groupBy("doc_id", "text_id", "first").agg(F.max(F.when(~F.col("after"), F.col("more"))).alias("before"), F.max(F.when(F.col("after"), F.col("more"))).alias("behind"))
    more = more.withColumn("removed", F.lit(True))
    before, behind = F.coalesce("before", F.lit(0)), F.coalesce("behind", F.lit(0))
    out = spans.join(more, ["doc_id", "text_id", "first", "removed"], "left").select("doc_id", "text_id", (F.col("first") - before).alias("first_word"), (F.col("end") - F.col("first") + before + behind).alias("n_words"), "component", F.col("left.doc_id").alias("kept_doc_id"), (F.col("left.start") - before).alias("kept_first_word"), "removed")
    out = materialize(out, "passages")
    discard(spans, sides, read_words)
    gone = out.filter(F.col("removed") & (F.col("n_words") >= LEAST))
    stays = out.filter("NOT removed").join(gone.select(F.col("kept_doc_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return gone.unionByName(stays)


def _without(text: bytes, gone: list[dict]) -> bytes:
    own = _text_id(text)
    spans = sorted((g["first_word"], g["first_word"] + g["n_words"]) for g in gone if g["text_id"] == own)
    if not spans:
        return text
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    parts, at = [], 0
    for first, end in spans:
        if starts[first] > at:
            parts.append(text[at : starts[first]])
        at = max(at, starts[end])
    return b"".join([*parts, text[at:]])


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_without(t, gone).decode() for t, gone in zip(as_bytes(batch.column("text")), batch.column("gone").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def remove_repeats(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with repeated passages cut from their texts, but for the first place of each; all columns as they
    came, n_chars (if there is one) counted anew in the texts that are cut. A cut document of which nothing but white
    space is left goes; others, null texts and null doc_ids stay. Repeated rows are cut alike."""
    gone = repeated_passages(documents, **options).filter("removed").groupBy("doc_id").agg(F.collect_set(F.struct("text_id", "first_word", "n_words")).alias("gone"))
    gone = materialize(gone.select(F.col("doc_id").alias("doc"), "gone"), "gone")
    few = gone.count() <= MOST_BROADCAST // 10
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    both = documents.select(row, F.col("doc_id").cast("long").alias("doc")).join(gone.hint("broadcast" if few else "shuffle_hash"), "doc", "left")
    hit = F.col("gone").isNotNull() & F.col("row.text").isNotNull()
    whole = both.filter(~hit).select("row.*")
    kind = documents.select(row).schema["row"].dataType.simpleString()
    cut = both.filter(hit).select("row", F.col("row.text").alias("text"), "gone").mapInArrow(_cut, f"row {kind}, text string").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    types = dict(documents.dtypes)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("text").cast(types["n_chars"])) if "n_chars" in types else None}
    return whole.unionByName(cut.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in documents.columns]))
