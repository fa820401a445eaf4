"""Phrase collocation mining with counting quotient filters.

Words get 64-bit ids (a hash that is proved to tell all words of the corpus apart; else another seed is taken). An
n-gram is the packed tuple of its words' ids. An invertible permutation spreads it; the leading bits of the permuted
tuple are the quotient, all others are kept as the remainder, so that a filter gives back every n-gram and counts it
exactly. Each task fills a filter for each language and length, cut into blocks of neighbouring quotients; blocks meet
in the shuffle and sorted filters are merged, block by block. Texts are read three times: for words, pairs, and runs of
three to five. A pass skips what cannot reach the least count, as a part of it has not: the parts that have are marked
in a bitmap of bounded size, in which a false mark costs room in a filter and never changes a result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, materialize, mixed, plain, tidy

CHUNK_BYTES = 8 << 20
HELD_ENTRIES = 1_500_000
BLOCK_WORDS = 1 << 18
MOST_QUOTIENT_BITS = 20
MOST_BITS = 1 << 27
SALTS = 64

KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

U = np.uint64


# --- the filter -----------------------------------------------------------------------------------------------------


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mixed``: a shift by 33 undoes itself, an odd factor has an inverse modulo 2^64."""
    for factor in (0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD):
        x = (x ^ (x >> U(33))) * U(pow(factor, -1, 1 << 64))
    return x ^ (x >> U(33))


def permuted(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The packed ids under a bijection; its first lane depends on all of them."""
    lanes = [mixed(ids[-1])]
    for x in reversed(ids[:-1]):
        lanes.insert(0, mixed(x + lanes[0]))
    return lanes


def restored(lanes: list[np.ndarray]) -> list[np.ndarray]:
    return [unmixed(y) - after for y, after in zip(lanes, lanes[1:])] + [unmixed(lanes[-1])]


def merged(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Entries in the order of their lanes, equal ones added up."""
    if not len(counts):
        return lanes, counts
    order = np.argsort(lanes[0], kind="stable")
    lanes_now = [y[order] for y in lanes]
    tied = lanes_now[0][1:] == lanes_now[0][:-1]
    same = tied.copy()
    for y in lanes_now[1:]:
        same &= y[1:] == y[:-1]
    if (tied != same).any():  # a first lane of several tuples: order by all
        order = np.lexsort(lanes[::-1])
        lanes_now = [y[order] for y in lanes]
        same = np.logical_and.reduce([y[1:] == y[:-1] for y in lanes_now])
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    return [y[first] for y in lanes_now], np.add.reduceat(counts[order], first)


def packed_filter(lanes: list[np.ndarray], counts: np.ndarray, q: int) -> bytes:
    """Sorted entries, one at least, whose first lanes share the leading ``q`` bits. The next bits, about as many as tell
    the entries apart, are the quotient, written as run lengths in unary; the rest is the remainder, in full. Counts
    take a byte; larger ones follow as eight."""
    m = len(counts)
    b = max(0, m.bit_length() - 1)
    quotient = ((lanes[0] << U(q)) >> U(64 - b)).astype(np.int64) if b else np.zeros(m, np.int64)
    runs = np.zeros(m + (1 << b), np.uint8)
    runs[np.arange(m) + quotient] = 1
    width = (64 - q - b + 7) // 8
    rest = np.ascontiguousarray(lanes[0].astype("<u8")).view(np.uint8).reshape(m, 8)[:, :width]
    large = counts[counts >= 255]
    return b"".join([struct.pack("<IIB", m, len(large), b), np.packbits(runs).tobytes(), rest.tobytes(), *[y.astype("<u8").tobytes() for y in lanes[1:]], np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes()])


def unpacked_filter(data: bytes, block: int, q: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The lanes and counts of a filter of ``n`` words in block ``block``."""
    m, many, b = struct.unpack_from("<IIB", data)
    at, width = 9, (64 - q - b + 7) // 8
    size = (m + (1 << b) + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=m + (1 << b)))
    quotient, at = (ones - np.arange(m)).astype(U), at + size
    rest = np.zeros((m, 8), np.uint8)
    rest[:, :width] = np.frombuffer(data, np.uint8, m * width, at).reshape(m, width)
    at += m * width
    low = 64 - q - b
    first = rest.view("<u8").ravel().astype(U) & U((1 << low) - 1)
    lanes = [first | (U(block) << U(64 - q)) | (quotient << U(low))]
    for _ in range(n - 1):
        lanes.append(np.frombuffer(data, "<u8", m, at).astype(U))
        at += 8 * m
    counts = np.frombuffer(data, np.uint8, m, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", many, at + m)
    return lanes, counts


class Filters:
    """A task's filters by (language, length); gives out rows when it holds many entries, and at the end."""

    def __init__(self, q: int):
        self.q, self.held, self.parts, self.limit = q, 0, {}, HELD_ENTRIES

    def add(self, lang: str, lanes: list[np.ndarray], counts: np.ndarray) -> None:
        if len(counts):
            self.parts.setdefault((lang, len(lanes)), []).append((lanes, counts))
            self.held += len(counts)

    def tighten(self) -> bool:
        """Merge what is held; whether much is left. Merging pays again at twice what is left."""
        for key, parts in self.parts.items():
            if len(parts) > 1:
                self.parts[key] = [merged([np.concatenate(y) for y in zip(*[p[0] for p in parts])], np.concatenate([p[1] for p in parts]))]
        self.held = sum(len(p[0][1]) for p in self.parts.values())
        self.limit = max(HELD_ENTRIES, 2 * self.held)
        return self.held > HELD_ENTRIES // 2

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.tighten()
        for (lang, n), [(lanes, counts)] in self.parts.items():
            block = (lanes[0] >> U(64 - self.q)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), len(block))
            blobs = [packed_filter([y[a:b] for y in lanes], counts[a:b], self.q) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.record_batch({"block": pa.array(block[cuts[:-1]]), "lang": pa.array([lang] * len(blobs)), "n": pa.array([n] * len(blobs), pa.int32()), "filter": pa.array(blobs, pa.binary())})
        self.parts, self.held = {}, 0


FILTER_ROWS = "block long, lang string, n int, filter binary"
GRAM_ROWS = "lang string, ids array<long>, f long"


def merge_filters(rows: DataFrame, q: int, least: int) -> DataFrame:
    """Filters of all tasks to the n-grams counted ``least`` times or more: (lang, ids, f).

    Filters of one block come in a row and are merged as they come, so that a task holds the different n-grams of one
    block, however many tasks have filled it.
    """

    def often(key: tuple[int, str, int], out: Filters) -> Iterator[pa.RecordBatch]:
        out.tighten()
        for [(lanes, counts)] in out.parts.values():
            enough = counts >= least
            if enough.any():
                ids = np.stack(restored([y[enough] for y in lanes]), axis=1).view(np.int64)
                offsets = np.arange(0, ids.size + 1, key[2], dtype=np.int32)
                yield pa.record_batch({"lang": pa.array([key[1]] * len(ids)), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.ravel())), "f": pa.array(counts[enough])})

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, Filters(q)
        for batch in batches:
            for *this, data in zip(*[batch.column(c).to_pylist() for c in ("block", "lang", "n", "filter")]):
                if this != key:
                    if key is not None:
                        yield from often(key, out)
                    key, out = this, Filters(q)
                out.add(key[1], *unpacked_filter(data, key[0], q, key[2]))
                if out.held > out.limit:
                    out.tighten()
        if key is not None:
            yield from often(key, out)

    return rows.repartition("block").sortWithinPartitions("block", "lang", "n").mapInArrow(run, GRAM_ROWS)


# --- words of texts -------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts of some 8 MB at a time, however long a batch or a text is."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            langs.append("und" if lang is None else lang)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield langs, texts
                langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


class Words:
    """The words of a chunk: ``code`` into ``distinct``, ``piece``, and ``lang``, a code into ``langs``."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
        kind = KIND[data]
        inside = np.concatenate(([False], kind == 0, [False]))
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        letters = np.ascontiguousarray(data[kind == 0])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.code, self.distinct = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()
        self.piece = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
        self.langs = sorted(set(langs))
        place = {lang: i for i, lang in enumerate(self.langs)}
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
        self.lang = np.array([place[lang] for lang in langs], np.int64)[np.searchsorted(ends_of_texts, starts, side="right")]

    def ids(self, seed: int) -> np.ndarray:
        return word_ids(self.distinct, seed)


def word_ids(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), U, len(words))


def lang_key(lang: str) -> np.uint64:
    return U(xxhash.xxh3_64_intdigest(lang.encode()))


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word: binary, id, f) of ``docs`` (lang, text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            words = Words(*chunk)
            keys, counts = np.unique(words.lang * len(words.distinct) + words.code, return_counts=True)
            if not len(keys):
                continue
            lang, code = np.divmod(keys, len(words.distinct))
            distinct = pa.array(words.distinct, pa.binary())
            yield pa.record_batch({"lang": pa.array(words.langs).take(pa.array(lang)), "word": distinct.take(pa.array(code)), "id": pa.array(words.ids(seed)[code].view(np.int64)), "f": pa.array(counts.astype(np.int64))})

    return docs.mapInArrow(run, "lang string, word binary, id long, f long").groupBy("lang", "word", "id").agg(F.sum("f").alias("f"))


# --- marks of parts that are frequent -------------------------------------------------------------------------------


class Marks:
    """A bitmap of keys of languages; of bounded size, so that a key may be marked by another one."""

    def __init__(self, data: bytes):
        self.data, self.mask = np.frombuffer(data, np.uint8), U(8 * len(data) - 1)

    @staticmethod
    def bit(lang: np.ndarray | np.uint64, key: np.ndarray, mask: np.uint64) -> np.ndarray:
        return (mixed(key + lang) & mask).astype(np.int64)

    def has(self, lang: np.ndarray, key: np.ndarray) -> np.ndarray:
        bit = self.bit(lang, key, self.mask)
        return (self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & np.uint8(1) > 0


def frequent_marks(grams: DataFrame, rows: int) -> bytes:
    """Marks of n-grams (lang, ids), 16 bits for each up to a bound of 2^27 bits in all: 16 MB at most."""
    size = min(MOST_BITS, max(1 << 15, 1 << (16 * max(1, rows) - 1).bit_length()))
    mask = U(size - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = np.array([lang_key(x) for x in batch.column(0).to_pylist()], U)
            ids = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64).view(U)
            bit = Marks.bit(lang, permuted(list(ids.T))[0], mask)
            yield pa.record_batch({"part": pa.array(bit >> 15), "place": pa.array(bit & 32767)})

    parts = grams.select("lang", "ids").mapInArrow(run, "part long, place long").groupBy("part").agg(F.bitmap_construct_agg("place").alias("bits"))
    data = bytearray(size // 8)
    for part, bits in parts.toLocalIterator():
        data[part * 4096 : part * 4096 + len(bits)] = bits
    return bytes(data)


# --- n-grams --------------------------------------------------------------------------------------------------------


def gram_filters(docs: DataFrame, lengths: range, seed: int, marks: bytes, q: int) -> DataFrame:
    """Filters of the n-grams of ``docs`` whose words (for pairs) or pairs (for longer ones) are all marked."""
    spread = docs.sparkSession.sparkContext.broadcast(marks)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, out = Marks(spread.value), Filters(q)
        for chunk in _chunks(batches):
            words = Words(*chunk)
            if len(words.code) < 2:
                continue
            ids, langs = words.ids(seed), np.array([lang_key(x) for x in words.langs], U)
            linked = words.piece[1:] == words.piece[:-1]
            if lengths[0] == 2:
                good = often.has(langs[words.lang], mixed(ids)[words.code])
                linked &= good[1:] & good[:-1]
            else:
                at = np.flatnonzero(linked)
                linked[at] = often.has(langs[words.lang[at]], permuted([ids[words.code[at]], ids[words.code[at + 1]]])[0])
            runs = linked
            for n in range(2, lengths[-1] + 1):
                if n > 2:
                    runs = runs[:-1] & linked[n - 2 :]
                if n not in lengths:
                    continue
                places = np.flatnonzero(runs)
                if len(words.langs) > 1:
                    places = places[np.argsort(words.lang[places], kind="stable")]
                for lang, at in zip(words.langs, np.split(places, np.searchsorted(words.lang[places], np.arange(1, len(words.langs))))):
                    if n == 2:  # pairs of codes sort as whole numbers
                        pairs, counts = np.unique(words.code[at] * len(ids) + words.code[at + 1], return_counts=True)
                        first, second = np.divmod(pairs, len(ids))
                        lanes, counts = permuted([ids[first], ids[second]]), counts.astype(np.int64)
                    else:
                        lanes, counts = permuted([ids[words.code[at + i]] for i in range(n)]), np.ones(len(at), np.int64)
                    out.add(lang, *merged(lanes, counts))
            if out.held > HELD_ENTRIES and out.tighten():  # the rows of a task stay few
                yield from out.rows()
        yield from out.rows()

    return docs.mapInArrow(run, FILTER_ROWS)


def phrase_scores(grams: DataFrame, totals: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates (two words or more) that no longer one stands for, at their lowest cut: lang, phrase, a, l, r, n, score."""
    candidates = grams.filter(F.size("ids") > 1)
    # of all longer candidates around one, the counts don't fall below those of the ones longer by a word
    shorter = F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1)))
    around = candidates.filter(F.size("ids") > 2).select("lang", shorter.alias("ids"), "f").groupBy("lang", "ids").agg(F.max("f").alias("longer"))
    kept = candidates.join(around, ["lang", "ids"], "left").filter("longer IS NULL OR longer < f").select("lang", "ids", F.col("f").alias("a"))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumns({"left_ids": F.slice("ids", F.lit(1), F.col("k")), "right_ids": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(grams.select("lang", F.col("ids").alias("left_ids"), F.col("f").alias("l")), ["lang", "left_ids"]).join(grams.select("lang", F.col("ids").alias("right_ids"), F.col("f").alias("r")), ["lang", "right_ids"])
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(34,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    best = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelled = best.select("lang", "ids", F.posexplode("ids").alias("place", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    spelled = spelled.groupBy("lang", "ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ").alias("phrase"))
    return best.join(spelled, ["lang", "ids"]).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = 100, widest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``widest`` words counted ``least`` times.

    ``docs`` has ``lang`` and ``text``; other columns are not read. A null text is empty, a null language is ``und``.
    Texts of any length count whole, repeated rows count each; ties go to the larger count, then to the phrase in byte
    order. A table without a phrase that often gives an empty result.
    """
    spark = docs.sparkSession
    texts = plain(docs, "lang", "text")
    seed, all_words = 0, None
    while all_words is None:
        all_words = materialize(counted_words(texts, seed), "words")
        if all_words.groupBy("id").agg((F.min("word") != F.max("word")).alias("two")).filter("two").limit(1).count():  # two words of one id
            discard(all_words)
            seed, all_words = seed + 1, None
    words = materialize(all_words.filter(F.col("f") >= least), "words-frequent")
    totals = materialize(all_words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    discard(all_words)
    ones = words.select("lang", F.array("id").alias("ids"), "f")
    count = totals.agg(F.sum("n")).first()[0] or 0
    q = min(MOST_QUOTIENT_BITS, max(4, (count // BLOCK_WORDS).bit_length()))
    pairs = _frequent(spark, gram_filters(texts, range(2, 3), seed, frequent_marks(ones, words.count()), q), q, least)
    tables = [ones, pairs]
    if widest > 2:
        tables.append(_frequent(spark, gram_filters(texts, range(3, widest + 1), seed, frequent_marks(pairs, pairs.count()), q), q, least))
    grams = tables[0]
    for more in tables[1:]:
        grams = grams.unionByName(more)
    scored = materialize(phrase_scores(grams, totals, words), "phrases")
    discard(words, totals, *tables[1:])
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_place") <= top)
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _frequent(spark: SparkSession, rows: DataFrame, q: int, least: int) -> DataFrame:
    return materialize(merge_filters(rows, q, least), "grams")
