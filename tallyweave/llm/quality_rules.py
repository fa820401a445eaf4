"""Quality rules: statistics of each text, an isolation forest over them, and a threshold set by labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, discard, materialize, plain, shingle_hashes, tidy

SYMBOLS = b"#*$%&|<>"
#: Kinds of bytes: inside a code point, white space, symbol, A-Z, a-z, digit, other ASCII, first of a longer code point.
INSIDE, SPACE, SYMBOL, UPPER, LOWER, DIGIT, MARK, WIDE = range(8)
KIND = np.full(256, MARK, np.uint8)
KIND[0x80:0xC0], KIND[0xC0:] = INSIDE, WIDE
KIND[list(b" \t\n\x0b\x0c\r")] = SPACE
KIND[list(SYMBOLS)] = SYMBOL
KIND[ord("A") : ord("Z") + 1], KIND[ord("a") : ord("z") + 1], KIND[ord("0") : ord("9") + 1] = UPPER, LOWER, DIGIT

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_words_distinct")
#: Trees, and rows that each is grown on: the forest is fitted on TREES * TREE_ROWS rows at most.
TREES, TREE_ROWS = 128, 256
#: Bins of the score in which labelled rows are counted.
BINS = 2000
#: Share of good texts that the threshold may cost at most, and how many points of bad ones a point of good ones is worth.
FALSE_REJECTS, PRICE = 0.02, 10.0


def repeated_words(words: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more."""
    if len(words) <= width:
        return 0
    windows = shingle_hashes(words, width)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(len(windows), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(often), 1)
    np.add.at(covered, np.flatnonzero(often) + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def rule_counts(text: bytes | None, hashes: WordHashes) -> tuple[int, ...]:
    """The values of COUNTS for one text; null counts as empty."""
    if not text:
        return (0,) * len(COUNTS)
    kinds = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=8)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = int(kinds.sum() - kinds[INSIDE] - kinds[SPACE])
    return (len(words), chars, int(kinds[SYMBOL]), len(lines) - len(set(lines)), repeated_words(hashes.of(words)), len(lines), int(kinds[UPPER]), int(kinds[LOWER]), int(kinds[DIGIT]), int(kinds[MARK]), len(set(words)))


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = np.array([rule_counts(x, hashes) for x in as_bytes(batch.column("text"))], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], ["doc_id", *COUNTS])


def rule_statistics(documents: DataFrame) -> DataFrame:
    """``doc_id`` and COUNTS (long) of every whole text of ``documents``; a null text has zeros."""
    return plain(documents, "doc_id", "text").mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees: shares and means that don't grow with the length of a text."""
    words, chars, lines = (np.maximum(1, counts[c]).astype(float) for c in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        chars / words,
        np.minimum(1, counts["n_symbols"] / words),
        counts["n_dup_lines"] / lines,
        counts["n_repeat_words"] / words,
        counts["n_upper"] / np.maximum(1, counts["n_upper"] + counts["n_lower"]),
        counts["n_digits"] / chars,
        np.minimum(1, counts["n_marks"] / words),
        np.minimum(1, 10 / words),
    ], axis=1)


def grow_tree(rows: np.ndarray, random: np.random.Generator, depth: int = 8) -> list[tuple[int, float, int, int, float]]:
    """One isolation tree as nodes (feature, split, left, right, path length at a leaf); a leaf has feature -1.

    Splits are drawn a little beyond the range of the rows, so that a text outside of it ends on a short path, but not
    below zero, where no share lies.
    """
    nodes: list = []

    def expected(n: int) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def add(x: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(rows.shape[1]),) * 2
        pad = 0.25 * spread
        if len(x) <= 1 or level >= depth:
            nodes[at] = (-1, 0.0, 0, 0, level + expected(len(x)))
            return at
        k = int(random.integers(rows.shape[1]))
        split = float(random.uniform(max(0.0, low[k] - pad[k]), high[k] + pad[k]))
        left = x[:, k] < split
        nodes[at] = (k, split, add(x[left], level + 1), add(x[~left], level + 1), 0.0)
        return at

    spread = np.maximum(rows.max(0) - rows.min(0), 0.02) if len(rows) else np.ones(rows.shape[1])
    add(rows, 0)
    return nodes


def anomaly_scores(x: np.ndarray, trees: list[list[tuple]]) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for rows that few splits set apart."""
    total = np.zeros(len(x))
    for nodes in trees:
        feature, split, left, right, path = (np.array(c) for c in zip(*nodes, strict=True))
        at = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(feature[at] >= 0)):
            here = at[open_]
            at[open_] = np.where(x[open_, feature[here]] < split[here], left[here], right[here])
        total += path[at]
    usual = 2 * (np.log(TREE_ROWS - 1) + 0.5772156649) - 2 * (TREE_ROWS - 1) / TREE_ROWS
    return 2 ** (-total / max(1, len(trees)) / usual)


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}


def _score(trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly_scores(features(_arrays(batch)), trees.value))], [*batch.schema.names, "anomaly"])

    return tidy(run)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def grow_forest(labelled: DataFrame, seed: int, most: int = TREES * TREE_ROWS) -> list[list[tuple]]:
    """Isolation trees grown on texts labelled good, or on all texts where no label says so.

    A documented bound: ``most`` rows of counts at most, chosen by a hash of doc_id, are fetched for the fit.
    """
    good = labelled.filter("quality = 1")
    n = good.count()
    if not n:
        good, n = labelled, labelled.count()
    share = min(1.0, 0.9 * most / max(1, n))
    order = F.xxhash64("doc_id", F.lit(seed))
    rows = good.filter(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(order, *COUNTS).limit(most).select(*COUNTS).toPandas()
    x = features({c: rows[c].to_numpy(float) for c in COUNTS})
    random = np.random.default_rng(seed)
    return [grow_tree(x[random.choice(len(x), min(TREE_ROWS, len(x)), replace=False)], random) for _ in range(TREES)] if len(x) else []


def calibrated_threshold(scored: DataFrame, false_rejects: float, price: float = PRICE) -> float:
    """The score above which texts go: of all that at most ``false_rejects`` of the texts labelled good exceed, the one
    with the largest share of rejected bad texts less ``price`` times the share of rejected good ones, and the higher one
    of equals. 1, which rejects nothing, where labels lack a side or no score is worth it."""
    bins = scored.filter("quality IS NOT NULL").groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "quality").count().toPandas()
    good, bad = (np.bincount(bins.loc[bins.quality == q, "bin"], bins.loc[bins.quality == q, "count"], BINS + 2) for q in (1, 0))
    if not good.sum() or not bad.sum():
        return 1.0
    above = lambda x: np.cumsum(x[::-1])[::-1] / x.sum()
    lost, caught = above(good), above(bad)
    gain = np.where(lost <= false_rejects, caught - price * lost, -1.0)
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return float(best / BINS) if gain[best] > 0 else 1.0


def _keep(trees, limit: float):
    """Rows of whole batches that the base rules and the forest keep; all columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = np.array([rule_counts(x, hashes) for x in as_bytes(batch.column("text"))], np.int64).reshape(-1, len(COUNTS))
            counts = dict(zip(COUNTS, rows.T, strict=True))
            keep = (counts["n_words"] >= 10) & (100 * counts["n_repeat_words"] <= 20 * counts["n_words"])
            if limit < 1:
                keep &= anomaly_scores(features(counts), trees.value) < limit
            yield batch.filter(pa.array(keep))

    return tidy(run)


def _fitted(counts: DataFrame, labels: DataFrame, false_rejects: float, seed: int):
    known = plain(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("fold")), F.lit(2))
    labelled = materialize(counts.filter(~base_failed()).join(known, "doc_id").withColumn("fold", fold), "labelled")
    sides = {(r["fold"], r["quality"]) for r in labelled.select("fold", "quality").distinct().collect()}  # four rows at most
    apart = len(sides) == 4
    trees = counts.sparkSession.sparkContext.broadcast(grow_forest(labelled.filter("fold = 0") if apart else labelled, seed))
    held_out = labelled.filter("fold = 1") if apart else labelled
    scored = held_out.select("doc_id", *COUNTS, "quality").mapInArrow(_score(trees), SCHEMA + ", quality int, anomaly double")
    limit = calibrated_threshold(scored, false_rejects)
    discard(labelled)
    return trees, limit


SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def keep_good_documents(documents: DataFrame, labels: DataFrame, false_rejects: float = FALSE_REJECTS, seed: int = 17) -> DataFrame:
    """The rows of ``documents``, all columns, that ``quality_rules`` keeps; no row is moved."""
    counts = materialize(rule_statistics(documents), "rules")
    trees, limit = _fitted(counts, labels, false_rejects, seed)
    discard(counts)
    return documents.mapInArrow(_keep(trees, limit), documents.schema)


def quality_rules(documents: DataFrame, labels: DataFrame, false_rejects: float = FALSE_REJECTS, seed: int = 17) -> DataFrame:
    """Judge every whole text of ``documents`` (doc_id, text) by fixed base rules and an isolation forest.

    ``labels`` (doc_id, quality 0/1) names known texts; several labels of one doc_id count as the lowest. The forest
    is grown on good ones of one half of the labelled texts, by hash; the threshold is chosen on the other half, by good
    and bad ones (``calibrated_threshold``). If a half lacks good or bad texts, both are done on all.
    Returns one row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), anomaly (double). Null, empty and wordless texts have zeros and fail the base rules;
    rows with a null or repeated doc_id are judged like any other. Without labels of both kinds, only the base rules
    reject. An empty table gives an empty result.
    """
    counts = materialize(rule_statistics(documents), "rules")
    trees, limit = _fitted(counts, labels, false_rejects, seed)
    judged = counts.mapInArrow(_score(trees), SCHEMA + ", anomaly double")
    return judged.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & (F.col("anomaly") < limit if limit < 1 else F.lit(True))).alias("kept"), "anomaly")
