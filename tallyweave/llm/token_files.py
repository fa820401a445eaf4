"""Files of token ids, packed by an adaptive context-mixing range coder.

A file holds a table of documents and blocks of BLOCK ids. Each block starts from an empty model and carries a
checksum, so any block can be read on its own. Three orders predict the next id: order 2 and order 1 name one id each
(what followed this context last, with a confidence), order 0 has the frequencies of the block so far. Their
probabilities are mixed by weights that are learned for each pair of confidences:

    P(id) = w2 [id = prediction 2] + w1 [id = prediction 1] + w0 P0(id)

and P drives a range coder. The models adapt after each segment of a block; within a segment LANES range coders run
side by side over neighbouring stretches, and all blocks of a group advance together, so every step is a few array
operations over thousands of coders.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, plain, tidy
from .tokens import encoder

MAGIC = b"TWIDS1\n\0"
#: Range coders of a block; ids of each in the segments of a block.
LANES, SEGMENTS = 32, (8, 24, 96, 128, 256)
BLOCK = LANES * sum(SEGMENTS)
#: Bytes of text in a file, at least (if there are so many) and at most, nearly.
FILE_BYTES = (4 << 20, 256 << 20)
#: Blocks that advance together.
TOGETHER = 64
#: Ids are below this; the top one stands for an id that order 0 has not met.
IDS, ESCAPE = 1 << 16, (1 << 16) - 1
#: log2 of the contexts that orders 2 and 1 tell apart, of order 0's total, and of the weights' total.
CONTEXT_BITS, ZERO_BITS, WEIGHT_BITS = (14, 13), 14, 16
CONFIDENCES = 8
BITS = ZERO_BITS + WEIGHT_BITS
NO_ID = 0
U = np.uint64


class Model:
    """What is known of each of ``n`` blocks. Frozen during a segment, then it adapts to the segment's ids."""

    def __init__(self, n: int):
        self.n = n
        self.guess = [np.zeros((n, 1 << b), np.uint16) for b in CONTEXT_BITS]
        self.sure = [np.zeros((n, 1 << b), np.int8) for b in CONTEXT_BITS]
        self.seen = np.zeros((n, IDS), np.uint16)
        self.seen[:, ESCAPE] = 1
        self.freq, self.cum = np.zeros((n, IDS), np.uint16), np.zeros((n, IDS), np.uint16)
        self.events = np.ones((n, CONFIDENCES * CONFIDENCES, 3), np.int64) * np.array([1, 1, 6])
        self.freeze()

    def freeze(self) -> None:
        """Order 0 scaled to 2**ZERO_BITS with a share for what it has not met, and the weights of the three orders."""
        met = np.flatnonzero(self.seen.ravel())  # by block and id; each block's last is ESCAPE
        count, block = self.seen.ravel()[met].astype(np.int64), met // IDS
        last = np.flatnonzero(met % IDS == ESCAPE)
        total = np.bincount(block, count, self.n).astype(np.int64)
        freq = count * ((1 << ZERO_BITS) - 256) // total[block]
        freq[last] = 0
        freq[last] = (1 << ZERO_BITS) - np.bincount(block, freq, self.n).astype(np.int64)
        self.freq.ravel()[met] = freq
        self.cum.ravel()[met] = np.cumsum(freq) - freq - (block << ZERO_BITS)
        self.slots = np.repeat((met % IDS).astype(np.uint16), freq).reshape(self.n, 1 << ZERO_BITS)
        whole = (1 << WEIGHT_BITS) - 3 * 64
        parts = self.events[:, :, :2] * whole // self.events.sum(2, keepdims=True) + 64
        self.w2, self.w1 = (np.ascontiguousarray(parts[:, :, k]) for k in (0, 1))

    @staticmethod
    def slot(order: int, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The context's place: before and last are the two ids that precede."""
        bits = CONTEXT_BITS[order]
        mix = last * U(0x9E3779B1) if order else (before * U(0x85EBCA6B) + last) * U(0x9E3779B1)
        return ((mix & U(0xFFFFFFFF)) >> U(32 - bits)).astype(np.int64)

    def weights(self, block, before, last):
        """Predictions of orders 2 and 1, and where their shares of the range end."""
        a, b = (block << CONTEXT_BITS[0]) + self.slot(0, before, last), (block << CONTEXT_BITS[1]) + self.slot(1, before, last)
        two, one = self.guess[0].take(a), self.guess[1].take(b)
        at = block * CONFIDENCES**2 + self.sure[0].take(a) * np.int64(CONFIDENCES) + self.sure[1].take(b)
        w2, w1 = self.w2.take(at), self.w1.take(at)
        same = two == one
        return two, one, np.where(same, w2 + w1, w2), w2 + w1

    def adapt(self, ids: np.ndarray, before: np.ndarray, last: np.ndarray) -> None:
        """``ids`` (block, position) of a segment, with the two that precede each."""
        block = np.repeat(np.arange(self.n), ids.shape[1])
        flat, p, q = ids.ravel(), before.ravel(), last.ravel()
        places = [self.slot(k, p, q) for k in (0, 1)]
        hits = [self.guess[k][block, places[k]] == flat for k in (0, 1)]
        at = self.sure[0][block, places[0]].astype(np.int64) * CONFIDENCES + self.sure[1][block, places[1]]
        event = np.where(hits[0], 0, np.where(hits[1], 1, 2))
        size = CONFIDENCES * CONFIDENCES * 3
        self.events += np.bincount(block * size + at * 3 + event, minlength=self.n * size).reshape(self.events.shape) * 4
        for k in (0, 1):
            flat_place = block * (1 << CONTEXT_BITS[k]) + places[k]
            step = np.bincount(flat_place, np.where(hits[k], 1.0, -1.0), self.n << CONTEXT_BITS[k]).reshape(self.n, -1)
            self.sure[k] = np.clip(self.sure[k] + step, 0, CONFIDENCES - 1).astype(np.int8)
            self.guess[k].ravel()[flat_place] = flat
        keys = np.sort(block * IDS + flat)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.seen.ravel()[keys[first]] += np.diff(np.append(first, len(keys))).astype(np.uint16)
        self.freeze()


def _settle(low: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Coders with a 32-bit word to shift out, again and again; shifts their low and size after each."""
    at = np.flatnonzero(((low ^ (low + size)) < U(1 << 32)) | (size < U(1 << 32)))
    while len(at):
        lo, sz = low[at], size[at]
        ready = (lo ^ (lo + sz)) < U(1 << 32)
        small = ~ready & (sz < U(1 << 32))
        sz = np.where(small, (U(0) - lo) & U(0xFFFFFFFF), sz)
        size[at] = sz
        go = ready | small
        at, lo, sz = at[go], lo[go], sz[go]
        if not len(at):
            return
        yield at
        low[at], size[at] = lo << U(32), sz << U(32)
        at = at[((low[at] ^ (low[at] + size[at])) < U(1 << 32)) | (size[at] < U(1 << 32))]


def _before(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two ids that precede each of a segment (block, lane, step); a lane's stretch starts without context."""
    none = np.full((*part.shape[:2], 1), NO_ID, part.dtype)
    last = np.concatenate((none, part[:, :, :-1]), 2)
    return np.concatenate((none, last[:, :, :-1]), 2).astype(np.uint64), last.astype(np.uint64)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """``ids`` (block, BLOCK) of uint16 below ESCAPE to the bytes of each block."""
    n = len(ids)
    model, low, size = Model(n), np.zeros(n * LANES, np.uint64), np.full(n * LANES, (1 << 64) - 1, np.uint64)
    out_lane, out_word = [], []

    def put(lanes, start, width):
        unit = size[lanes] >> U(BITS)
        low[lanes] += start * unit
        size[lanes] = unit * width
        for at in _settle(low, size):
            out_lane.append(at)
            out_word.append((low[at] >> U(32)).astype(np.uint32))

    every = np.arange(n * LANES)
    done = 0
    for steps in SEGMENTS:
        part = ids[:, done : done + LANES * steps].reshape(n, LANES, steps)
        before, last = _before(part)
        done += LANES * steps
        block = np.arange(n)[:, None, None]
        two, one, end2, end1 = model.weights(block, before, last)
        freq, cum = model.freq[block, part].astype(np.int64), model.cum[block, part].astype(np.int64)
        lost = freq == 0
        esc_f, esc_c = (np.broadcast_to(x[:, ESCAPE].astype(np.int64)[:, None, None], part.shape) for x in (model.freq, model.cum))
        freq, cum = np.where(lost, esc_f, freq), np.where(lost, esc_c, cum)
        w0 = (1 << WEIGHT_BITS) - end1
        start = (end1 << ZERO_BITS) + cum * w0
        width = freq * w0
        hit2, hit1 = part == two, (part == one) & (two != one)
        start = np.where(hit2, 0, np.where(hit1, end2 << ZERO_BITS, start)).astype(np.uint64)
        width = np.where(hit2, end2 << ZERO_BITS, np.where(hit1, (end1 - end2) << ZERO_BITS, width)).astype(np.uint64)
        lost &= ~hit2 & ~hit1
        for t in range(part.shape[2]):
            put(every, start[:, :, t].ravel(), width[:, :, t].ravel())
            if len(raw := np.flatnonzero(lost[:, :, t].ravel())):
                put(raw, part[:, :, t].ravel()[raw].astype(np.uint64) << U(BITS - 16), U(1 << (BITS - 16)))
        if done < BLOCK:
            model.adapt(part.reshape(n, -1), before.reshape(n, -1), last.reshape(n, -1))
    for shift in (32, 0):
        out_lane.append(every)
        out_word.append(((low >> U(shift)) & U(0xFFFFFFFF)).astype(np.uint32))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane, kind="stable")
    word, counts = word[order], np.bincount(lane, minlength=n * LANES)
    ends = np.cumsum(counts.reshape(n, LANES).sum(1))
    return [counts[k * LANES : (k + 1) * LANES].astype("<u2").tobytes() + word[a:b].astype("<u4").tobytes() for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True))]


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids (block, BLOCK) of what ``encode_blocks`` made."""
    n = len(blocks)
    counts = np.concatenate([np.frombuffer(b, "<u2", LANES) for b in blocks]).astype(np.int64)
    words = np.concatenate([np.frombuffer(b, "<u4", offset=2 * LANES) for b in blocks] + [np.zeros(2, np.uint32)]).astype(np.uint64)
    at = np.cumsum(counts) - counts
    code = (words[at] << U(32)) | words[at + 1]
    at += 2
    model, low, size = Model(n), np.zeros(n * LANES, np.uint64), np.full(n * LANES, (1 << 64) - 1, np.uint64)
    block = np.repeat(np.arange(n), LANES)

    def take(lanes, start, width, unit):
        low[lanes] += start * unit
        size[lanes] = unit * width
        for go in _settle(low, size):
            code[go] = (code[go] << U(32)) | words[at[go]]
            at[go] += 1

    every, out = np.arange(n * LANES), []
    for steps in SEGMENTS:
        part = np.zeros((n * LANES, steps), np.uint16)
        before = last = np.full(n * LANES, NO_ID, np.uint64)
        for t in range(steps):
            two, one, end2, end1 = model.weights(block, before, last)
            unit = size >> U(BITS)
            target = np.minimum((code - low) // unit, U((1 << BITS) - 1)).astype(np.int64)
            w0 = (1 << WEIGHT_BITS) - end1
            rest = target - (end1 << ZERO_BITS)
            slot = np.clip(rest // w0, 0, (1 << ZERO_BITS) - 1)
            token = model.slots.take((block << ZERO_BITS) + slot)
            hit2, hit1 = target < end2 << ZERO_BITS, rest < 0
            start = np.where(hit2, 0, np.where(hit1, end2 << ZERO_BITS, (end1 << ZERO_BITS) + model.cum.take(block * IDS + token) * w0))
            width = np.where(hit2, end2 << ZERO_BITS, np.where(hit1, (end1 - end2) << ZERO_BITS, model.freq.take(block * IDS + token) * w0))
            token = np.where(hit2, two, np.where(hit1, one, token))
            lost = np.flatnonzero(~hit1 & ~hit2 & (token == ESCAPE))
            take(every, start.astype(np.uint64), width.astype(np.uint64), unit)
            if len(lost):
                unit = size[lost] >> U(BITS)
                raw = np.minimum((code[lost] - low[lost]) // unit >> U(BITS - 16), U(IDS - 1))
                take(lost, raw << U(BITS - 16), U(1 << (BITS - 16)), unit)
                token[lost] = raw
            part[:, t] = token
            before, last = last, token.astype(np.uint64)
        whole = part.reshape(n, LANES, steps)
        out.append(whole.reshape(n, -1))
        if steps < SEGMENTS[-1]:
            model.adapt(whole.reshape(n, -1), *(x.reshape(n, -1) for x in _before(whole)))
    return np.concatenate(out, 1)


@dataclass
class TokenFile:
    """One file's documents: ids of doc_id (None: null), where each starts in ``ids``, and all ids."""

    docs: list[int | None]
    lengths: np.ndarray
    ids: np.ndarray


def file_bytes(docs: list[int | None], lengths: list[int], parts: Iterator[np.ndarray]) -> bytes:
    """A token file of documents whose ids come as ``parts`` (uint16), a few blocks at a time.

    Layout: MAGIC, the number of documents and of ids, the compressed tables of doc_ids, nulls and lengths with a
    checksum, then for each block its size, the number and the checksum of its ids, and its bytes.
    """
    out = io.BytesIO()
    table = zlib.compress(np.array([x or 0 for x in docs], "<i8").tobytes() + np.array([x is None for x in docs], np.uint8).tobytes() + np.array(lengths, "<u4").tobytes(), 6)
    out.write(MAGIC + struct.pack("<QQQI", len(docs), sum(lengths), len(table), zlib.crc32(table)) + table)
    held, size = [], 0

    def flush() -> None:
        ids = np.concatenate(held)
        for at in range(0, len(ids), TOGETHER * BLOCK):
            group = ids[at : at + TOGETHER * BLOCK]
            full = np.zeros(-(-len(group) // BLOCK) * BLOCK, np.uint16)
            full[: len(group)] = group
            for k, block in enumerate(encode_blocks(full.reshape(-1, BLOCK))):
                own = group[k * BLOCK : (k + 1) * BLOCK]
                out.write(struct.pack("<III", len(block), len(own), zlib.crc32(own.tobytes())) + block)

    for part in parts:
        while len(part):
            take = part[: TOGETHER * BLOCK - size]
            held.append(take)
            size, part = size + len(take), part[len(take) :]
            if size == TOGETHER * BLOCK:
                flush()
                held, size = [], 0
    if size:
        flush()
    return out.getvalue()


def read_file(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray] | np.ndarray]:
    """First the doc_ids and lengths, then the ids of a group of blocks at a time. Damage raises ValueError."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    n, total, size, check = struct.unpack_from("<QQQI", content, 8)
    at = 8 + struct.calcsize("<QQQI")
    table, at = content[at : at + size], at + size
    if zlib.crc32(table) != check:
        raise ValueError("damaged table of documents")
    raw = zlib.decompress(table)
    docs, nulls, lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n), np.frombuffer(raw, "<u4", n, 9 * n)
    yield [None if z else int(x) for x, z in zip(docs, nulls, strict=True)], lengths.astype(np.int64)
    while total > 0:
        blocks, heads = [], []
        while len(blocks) < TOGETHER and sum(h[0] for h in heads) < total:
            size, count, check = struct.unpack_from("<III", content, at)
            blocks.append(content[at + 12 : at + 12 + size])
            heads.append((count, check))
            at += 12 + size
        ids = decode_blocks(blocks)
        own = [x[:count] for x, (count, _) in zip(ids, heads, strict=True)]
        if any(zlib.crc32(x.tobytes()) != check for x, (_, check) in zip(own, heads, strict=True)):
            raise ValueError("damaged block of ids")
        total -= sum(map(len, own))
        yield np.concatenate(own)


def _store(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, docs, lengths, parts = encoder(path), [], [], []
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), pieces.all_ids(batch.column("text").to_pylist()), strict=True):
                if len(ids) and ids.max() >= ESCAPE:
                    raise ValueError("ids of 65535 or more do not fit this format")
                docs.append(doc)
                lengths.append(len(ids) + 1)
                parts.append(np.append(ids, np.uint32(end_id)).astype(np.uint16))
        if not docs:
            return
        number = TaskContext.get().partitionId()
        fs, place = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(place)
        # a task that runs again or twice makes the same file; it appears whole or not at all
        half = f"{place}/_part-{number:06d}-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(half) as out:
            out.write(file_bytes(docs, lengths, iter(parts)))
        fs.move(half, f"{place}/part-{number:06d}.ids")
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["file", "n_docs", "n_ids"])

    return tidy(run)


MANIFEST = "file int, n_docs long, n_ids long"
DOCUMENT = "file int, place long, doc_id long, local_start long, ids binary"


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, files: int | None = None) -> str:
    """Write the ids of ``documents`` (doc_id, text) as files in ascending doc_id order, and return their folder.

    ``tokenizer``: path of a ``tokenizers`` file that every executor has. A document is its ids and ``end_id``; a null
    text has ``end_id`` only. Null doc_ids come first, rows of one doc_id are in the order of a hash of their texts, so
    that many of them fill several files. Files are ranges of this order, one for each shuffle partition, but of
    FILE_BYTES of text at least and at most; an empty table has none. The folder is one that all executors share.
    """
    spark = documents.sparkSession
    folder = folder or new_path(spark, "token-files")
    docs = plain(documents, "doc_id", "text")
    if not files:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES[0])), -(-size // FILE_BYTES[1]))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    docs = docs.repartitionByRange(files, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    docs.mapInArrow(_store(f"{folder}/ids", tokenizer, end_id), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


@tidy
def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "place", "doc_id", "local_start", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            number = int(path.as_py().rsplit("part-", 1)[1].split(".")[0])
            parts = read_file(content.as_py())
            docs, lengths = next(parts)
            ends = np.cumsum(lengths)
            held, base, k = np.empty(0, np.uint16), 0, 0
            for ids in parts:
                held = np.concatenate((held, ids))
                stop = int(np.searchsorted(ends, base + len(held), "right"))
                if stop > k:
                    cuts = np.append(ends[k:stop] - lengths[k:stop], ends[stop - 1]) - base
                    rows = [held[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    for at in range(0, len(rows), 500):
                        own = slice(k + at, min(k + at + 500, stop))
                        columns = [[number] * (own.stop - own.start), range(own.start, own.stop), docs[own], ends[own] - lengths[own], rows[at : at + 500]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                    held, base, k = held[cuts[-1] :], int(ends[stop - 1]), stop


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder of token files: file, place in it, doc_id, start (ids of all before), n_tokens, ids.

    ids are little-endian unsigned 32-bit. A block or table that its checksum doesn't fit raises an error.
    """
    # files are few: the numbers of their ids give each file's first place
    sizes = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    bases = sizes.select("file", (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("base"))
    if sizes.isEmpty():
        rows = spark.createDataFrame([], DOCUMENT)
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").schema("path string, modificationTime timestamp, length long, content binary").load(f"{folder}/ids")
        rows = found.select("path", "content").mapInArrow(_load, DOCUMENT)
    return rows.join(F.broadcast(bases), "file").select("file", "place", "doc_id", (F.col("base") + F.col("local_start")).alias("start"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def token_files(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``documents`` as token files and read them back: doc_id, start, n_tokens, ids."""
    spark = documents.sparkSession
    return read_token_files(spark, write_token_files(documents, tokenizer, end_id))
