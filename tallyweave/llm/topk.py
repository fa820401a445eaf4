"""Exact top-k search by tiled matrix products: each tile selects its best, and lists merge in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, plain, tidy

#: Rows of a tile of candidates and of a block of queries; lists that one merge takes.
TILE, BLOCK, FAN_IN = 4096, 1024, 32
SCALE = 1024


def _matrices(scale: int, rows: int, key: str):
    """Whole-number matrices of up to ``rows`` vectors of one length, for each value of ``key`` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        made, part = 0, TaskContext.get().partitionId()

        def matrix(size, group):
            nonlocal made
            ids, vectors = zip(*held.pop((size, group)), strict=True)
            v = np.array(vectors, np.float64).reshape(len(ids), size)
            with np.errstate(over="ignore"):
                whole = np.floor(v * scale)
            made += 1
            kind = "<i2" if not whole.size or np.abs(whole).max() < 1 << 15 else "<f8"
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([group], pa.int64()), pa.array([(part << 24) | made], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([kind]), pa.array([whole.astype(kind).tobytes()])], ["size", "grp", "tile", "ids", "kind", "matrix"])

        for batch in batches:
            for vec, group, x in zip(batch.column("vec_id").to_pylist(), batch.column(key).to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                own = held.setdefault((len(x), group), [])
                own.append((vec, x))
                if len(own) >= rows:
                    yield matrix(len(x), group)
        for size, group in list(held):
            yield matrix(size, group)

    return tidy(run)


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of ``x`` for each row of ``q``: highest product, then smallest id; never the query's own id.

    Rows that share an id count once, by their best product. Returns query ids, ids and scores.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if largest < 2**53:  # every sum is a whole number that a double holds
        score = (q @ x.T).astype(np.int64)
    else:
        whole = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) @ np.array([[int(v) for v in row] for row in x], object).reshape(x.shape).T
        score = np.array([[max(-(2**63) + 2, min(2**63 - 1, v)) for v in row] for row in whole], np.int64).reshape(len(q), len(x))
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    if len(first) < len(ids):
        score, ids = np.maximum.reduceat(score, first, axis=1), ids[first]
    none = np.iinfo(np.int64).min
    score[ids[None, :] == q_ids[:, None]] = none
    k = min(k, len(ids))
    if largest * (len(ids) + 1) < 2**61:  # one number for score and place, so that there are no ties
        keyed = np.where(score == none, none, score * len(ids) - np.arange(len(ids)))
        top = np.argpartition(~keyed, k - 1, axis=1)[:, :k]
    else:
        top = np.argsort(~score, axis=1, kind="stable")[:, :k]
    found = np.take_along_axis(score, top, 1)
    keep = found != none
    return np.repeat(q_ids, k).reshape(len(q_ids), k)[keep], ids[top][keep], found[keep]


def _products(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids = (np.frombuffer(row[c], "<i8") for c in ("q_ids", "ids"))
                q = np.frombuffer(row["q_matrix"], row["q_kind"]).astype(np.float64).reshape(len(q_ids), row["size"])
                x = np.frombuffer(row["matrix"], row["kind"]).astype(np.float64).reshape(len(ids), row["size"])
                queries, found, score = best_of_tile(q_ids, q, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(np.full(len(queries), row["tile_no"])), pa.array(found), pa.array(score)], ["query_id", "lst", "vec_id", "score"])

    return tidy(run)


def _merged(lists: DataFrame, k: int, *keys) -> DataFrame:
    best = lists.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries, k: int = 10, scale: int = SCALE) -> DataFrame:
    """The ``k`` highest whole-number inner products of each query with all other rows.

    ``vectors``: vec_id (long), embedding (array of float or double); ``queries``: a condition on its rows. Components
    become floor(scale * x). Rows with a null vec_id, a null vector, or a null or non-finite component take no part;
    only vectors of one length are compared. Rows that share a vec_id count once as a candidate, by their best score,
    and as one query. Returns query_id, rank (int, from 1), vec_id, score (long, kept within its range); ties go to the
    smaller vec_id. A query without another row has none.

    Queries form blocks and candidates tiles, and each pair of a block and a tile is one matrix product, dealt out over
    tasks; a tile gives k rows for a query, and lists merge FAN_IN at a time.
    """
    rows = plain(vectors, "vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite)
    asked = rows.filter(queries)
    n, m = rows.count(), asked.count()
    blocks, groups = max(1, -(-m // BLOCK)), max(1, -(-n // (TILE * 4)))
    tiles = rows.withColumn("grp", F.pmod(F.monotonically_increasing_id(), F.lit(1))).mapInArrow(_matrices(scale, TILE, "grp"), "size int, grp long, tile long, ids binary, kind string, matrix binary")
    tiles = materialize(tiles, "tiles").withColumn("g", F.pmod(F.xxhash64("tile"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = asked.repartition("b").mapInArrow(_matrices(scale, 2 * BLOCK, "b"), "size int, grp long, tile long, ids binary, kind string, matrix binary")
    asked = asked.select("size", F.col("grp").alias("b"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    pairs = tiles.join(asked.hint("shuffle_hash"), ["size", "b", "g"]).select("size", F.pmod(F.xxhash64("tile"), F.lit(1 << 20)).alias("tile_no"), "ids", "kind", "matrix", "q_ids", "q_kind", "q_matrix")
    lists = pairs.mapInArrow(_products(k), "query_id long, lst long, vec_id long, score long")
    width = max(1, -(-n // TILE))
    while width > FAN_IN:
        lists = _merged(lists.withColumn("lst", F.pmod("lst", F.lit(max(1, width // FAN_IN)))), k, "query_id", "lst").select("query_id", "lst", "vec_id", "score")
        width //= FAN_IN
    return _merged(lists, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
