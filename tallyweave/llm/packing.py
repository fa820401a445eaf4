"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. What is left of a document after whole windows goes to the open
window that it fits best; when none fits, the fullest is topped up with the start of the document and emitted. The
windows that are open at the end are merged across partitions, in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain, tidy
from .tokens import encoder

WINDOW, OPEN_WINDOWS = 4096, 32
#: A gap below this is padded rather than filled with so short a piece.
LEAST_PIECE = 8
#: Partitions whose open windows one task merges.
MERGED = 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]


class Packer:
    """Open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, most: int, first_id: int):
        self.window, self.most, self.next_id = window, most, first_id
        self.windows: list[list] = []  # of [used, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], is_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next_id, offset, is_open))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.emit([(doc, start, ids[start : start + self.window], total)])
            start += self.window
        rest = total - start
        if not rest:
            return
        fits = [w for w in self.windows if w[0] + rest <= self.window]
        if fits:
            best = max(fits, key=lambda w: w[0])
        else:
            if len(self.windows) >= self.most:
                full = max(self.windows, key=lambda w: w[0])
                gap = self.window - full[0]
                if gap >= LEAST_PIECE:
                    full[1].append((doc, start, ids[start : start + gap], total))
                    start, rest = start + gap, rest - gap
                self.emit(full[1])
                self.windows.remove(full)
            self.windows.append(best := [0, []])
        best[0] += rest
        best[1].append((doc, start, ids[start:], total))
        if best[0] == self.window:
            self.emit(best[1])
            self.windows.remove(best)

    def close(self) -> None:
        for _, pieces in self.windows:
            self.emit(pieces, True)
        self.windows = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)


def _pack(path: str, end_id: int, window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        packer = Packer(window, most, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), pieces.all_ids(batch.column("text").to_pylist()), strict=True):
                packer.add(doc, np.append(ids, np.uint32(end_id)))
                if len(packer.rows) >= 2000:
                    yield packer.batch()
        packer.close()
        if packer.rows:
            yield packer.batch()

    return tidy(run)


def _merge(window: int, level: int):
    """Chain the open windows of a group, cut at each whole window; what is left at the end stays open."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(window, 1, (level << 56) | (int(key[0]) << 32))
        rows = rows.sort_values(["sequence_id", "offset"])
        used, held = 0, []
        for doc, start, ids, total in zip(rows.doc_id.astype("Int64"), rows.start, rows.ids, rows.doc_tokens, strict=True):
            ids, doc = np.frombuffer(ids, "<u4"), None if pd.isna(doc) else int(doc)
            while len(ids):
                part = ids[: window - used]
                held.append((doc, start, part, total))
                used, start, ids = used + len(part), start + len(part), ids[len(part) :]
                if used == window:
                    packer.emit(held)
                    used, held = 0, []
        if held:
            packer.emit(held, True)
        out = pd.DataFrame(packer.rows, columns=NAMES)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack_sequences(documents: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack all ``documents`` (doc_id, text) into sequences of at most ``window`` ids, for padding to ``window``.

    ``tokenizer``: path of a ``tokenizers`` file that every executor has. Each document is its ids and ``end_id``; a
    null text has ``end_id`` only. Returns a row for each piece: doc_id (as it came, null too), start (the document's
    ids before the piece), length, ids (little-endian unsigned 32-bit), doc_tokens (with ``end_id``), sequence_id
    (unique, not dense), offset (in the sequence, without gaps from 0). Every id lies in exactly one piece. A sequence
    is full but for gaps of under LEAST_PIECE ids, and one last sequence. Repeated rows are packed like others, an
    empty table has no piece.

    A task holds ``open_windows`` windows; open ones of MERGED partitions at a time are merged, and so on.
    """
    packed = materialize(plain(documents, "doc_id", "text").mapInArrow(_pack(tokenizer, end_id, window, open_windows), SCHEMA), "packed")
    done, rest = [packed.filter("NOT open")], packed.filter("open")
    groups = (rest.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        key = F.floor((F.shiftright("sequence_id", 32).bitwiseAND(0xFFFFFF)) / MERGED).alias("group")
        merged = materialize(rest.groupBy(key).applyInPandas(_merge(window, level), SCHEMA), "merged")
        groups = -(-groups // MERGED)
        if groups == 1:
            done.append(merged)
            break
        done.append(merged.filter("NOT open"))
        rest = merged.filter("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")
