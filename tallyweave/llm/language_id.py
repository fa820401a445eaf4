"""Language identification of mixed text: scripts narrow the candidates, word scores and a Viterbi pass label spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain, tidy

#: First code points of ranges and the script that each begins (fixed values; letters outside of them are "other").
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
#: log2 of the number of buckets of character n-grams, and the lengths of those.
BUCKET_BITS, GRAMS = 16, (1, 2, 3, 4)
#: Documents of each language that the model is fitted on at most.
MOST_PER_LANGUAGE = 3000
#: A script belongs to a language if it writes this share of its letters.
SCRIPT_SHARE = 0.01


class Letters:
    """Which code points are letters, their lower case and script, as tables."""

    def __init__(self):
        n = 0x32000
        chars = [chr(i) for i in range(n)]
        self.letter = np.array([c.isalpha() for c in chars] + [False])
        self.lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)] + [0], np.uint32)
        starts = np.array([a for a, _ in SCRIPT_RANGES])
        kinds = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
        self.script = np.append(kinds[np.searchsorted(starts, np.arange(n), "right") - 1], SCRIPTS.index("other"))

    def codes(self, text: str) -> np.ndarray:
        return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(self.letter) - 1)


_LETTERS: list[Letters] = []


def letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def word_grams(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Script of each word (-1: it has no letter), and for each gram length the buckets and the words that they are of.

    A word counts as its letters alone, in lower case, with a space before and after.
    """
    table = letters()
    codes = table.codes("\n" + "\n".join(words))
    owner = np.cumsum(codes == 10) - 1
    use = table.letter[codes] | (codes == 10)
    codes, owner = codes[use], owner[use]
    letter = codes != 10
    script = np.full(len(words), -1)
    first = np.flatnonzero(letter & np.concatenate(([False], ~letter[:-1])))
    script[owner[first]] = table.script[codes[first]]
    low = np.where(letter, table.lower[codes], 32).astype(np.uint64)
    low, letter, owner = np.append(low, np.uint64(32)), np.append(letter, False), np.append(owner, len(words))
    grams = []
    for k in GRAMS:
        if len(low) < k:
            continue
        total = np.full(len(low) - k + 1, k, np.uint64)
        inside = np.zeros(len(total), np.int64)
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + low[i : i + len(total)]
            inside += ~letter[i : i + len(total)]
        edge = ~letter[: len(total)]
        end = ~letter[k - 1 :]
        ok = (inside - edge - (end if k > 1 else 0) <= 0) & (letter[: len(total)] | letter[k - 1 :])
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        grams.append(((total >> np.uint64(64 - BUCKET_BITS))[ok].astype(np.int64), owner[: len(total)][ok]))
    return script, grams


@dataclass
class LanguageModel:
    """Languages, log-probabilities (bucket, language), and which languages each script can write."""

    languages: list[str]
    log_p: np.ndarray
    candidates: np.ndarray

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probability of each word's grams under each language, times its letters' weight; and its script."""
        script, grams = word_grams(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        n = np.zeros(len(words), np.float32)
        for buckets, owner in grams:
            if len(owner):
                at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                out[owner[at]] += np.add.reduceat(self.log_p[buckets], at, 0)
                n[owner[at]] += np.diff(np.append(at, len(owner)))
        out /= len(GRAMS)
        allowed = self.candidates[script] & (script >= 0)[:, None]
        narrowed = allowed.any(1)
        out[narrowed] = np.where(allowed[narrowed], out[narrowed], out[narrowed].min(1, keepdims=True) - 20)
        out[~narrowed] = 0
        return out - out.max(1, keepdims=True), script


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best state of each step of each sequence, where a change of state costs ``penalty``; ties go to the first state."""
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(scores)
    order = sorted((i for i, s in enumerate(scores) if len(s)), key=lambda i: -len(scores[i]))
    at = 0
    while at < len(order):
        steps = len(scores[order[at]])
        k = scores[order[at]].shape[1]
        lanes = order[at : at + max(1, 2_400_000 // (steps * max(4, k)))]
        at += len(lanes)
        lengths = np.array([len(scores[i]) for i in lanes])
        x = np.zeros((steps, len(lanes), k), np.float32)
        for j, i in enumerate(lanes):
            x[: lengths[j], j] = scores[i]
        active = np.searchsorted(-lengths, -np.arange(steps), "left")  # lanes longer than each step, as they are sorted
        came = np.zeros((steps, len(lanes), k), np.int16)
        best = x[0].copy()
        own = np.arange(k)
        for t in range(1, steps):
            n = active[t]
            now = best[:n]
            top = now.argmax(1)
            change = now[np.arange(n), top] - penalty
            stay = now >= change[:, None]
            came[t, :n] = np.where(stay, own, top[:, None])
            best[:n] = np.where(stay, now, change[:, None]) + x[t, :n]
        state = best.argmax(1)
        path = np.zeros((steps, len(lanes)), np.int16)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            path[t, :n] = state[:n]
            state[:n] = came[t, np.arange(n), state[:n]] if t else state[:n]
        for j, i in enumerate(lanes):
            out[i] = path[: lengths[j], j].copy()
    return out


def _gram_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        counts: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                have = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for buckets, _ in word_grams(text.split())[1]:
                    have += np.bincount(buckets, minlength=1 << bits)
                codes = table.codes(text)
                scripts.setdefault(lang, np.zeros(len(SCRIPTS), np.int64))
                scripts[lang] += np.bincount(table.script[codes[table.letter[codes]]], minlength=len(SCRIPTS))
        for lang, have in counts.items():
            at = np.flatnonzero(have)
            more = np.flatnonzero(scripts[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + len(more)), pa.string()), pa.array(np.concatenate((at, -1 - more)).astype(np.int32)), pa.array(np.concatenate((have[at], scripts[lang][more])))], ["lang", "bucket", "n"])

    return tidy(run)


def fit_languages(labelled: DataFrame, per_language: int = MOST_PER_LANGUAGE, seed: int = 5) -> LanguageModel:
    """Learn from ``labelled`` (doc_id, text, lang), rows without nulls.

    Every language is learned. Bound: ``per_language`` documents of each language, chosen by a hash of doc_id; so what
    is fetched has at most 2**BUCKET_BITS numbers a language.
    """
    totals = labelled.groupBy("lang").count()
    order = F.xxhash64("doc_id", F.lit(seed))
    near = labelled.join(F.broadcast(totals), "lang").filter(F.pmod(order, F.lit(1_000_000)) < F.lit(1_000_000.0 * per_language) / F.col("count"))
    counted = near.select("text", "lang").mapInArrow(_gram_counts(BUCKET_BITS), "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows.lang.unique().tolist())
    counts = np.zeros((1 << BUCKET_BITS, len(languages)), np.float64)
    script = np.zeros((len(SCRIPTS), len(languages)))
    for k, lang in enumerate(languages):
        own = rows[rows.lang == lang]
        grams, marks = own[own.bucket >= 0], own[own.bucket < 0]
        counts[grams.bucket, k] = grams.n
        script[-1 - marks.bucket, k] = marks.n
    log_p = np.log((counts + 0.5) / (counts.sum(0, keepdims=True) + 0.5 * len(counts))) if languages else counts
    return LanguageModel(languages, log_p.astype(np.float32), script >= SCRIPT_SHARE * np.maximum(1, script.sum(0, keepdims=True)))


SPANS = "array<struct<first_word: int, end_word: int, lang: string>>"


def _label(model, penalty: float, most_words: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        place: dict[str, int] = {}
        # many languages make wide rows, so fewer are held
        width = max(4, len(m.languages))
        step = max(1, 4000 // width)
        known, scripts = np.empty((0, len(m.languages)), np.float32), np.empty(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                if len(place) > most_words * 4 // width:
                    place, known, scripts = {}, known[:0], scripts[:0]
                texts = [(x or "").split() for x in part.column("text").to_pylist()]
                new = list(dict.fromkeys(w for t in texts for w in t if w not in place))
                if new and m.languages:
                    place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                    s, k = m.scores(new)
                    known, scripts = np.concatenate((known, s)), np.concatenate((scripts, k))
                rows = [np.fromiter(map(place.__getitem__, t), np.int64, len(t)) if m.languages else np.empty(0, np.int64) for t in texts]
                rows = [r[scripts[r] >= 0] if len(r) else r for r in rows]  # words with letters
                at = [np.flatnonzero(scripts[np.fromiter(map(place.__getitem__, t), np.int64, len(t))] >= 0) if len(r) else r for t, r in zip(texts, rows, strict=True)]
                paths = viterbi([known[r] for r in rows], penalty)
                lang, score, spans = [], [], []
                for words, index, path in zip(texts, at, paths, strict=True):
                    if not len(path):
                        lang.append("und"), score.append(0.0), spans.append([])
                        continue
                    weight = np.fromiter((len(words[i]) for i in index), np.int64, len(index))
                    share = np.bincount(path, weight, len(m.languages))
                    top = int(share.argmax())
                    lang.append(m.languages[top]), score.append(float(share[top] / share.sum()))
                    cut = np.flatnonzero(path[1:] != path[:-1]) + 1
                    firsts = [0, *cut.tolist()]
                    ends = [*index[cut].tolist(), len(words)]
                    spans.append([{"first_word": 0 if f == 0 else int(index[f]), "end_word": e, "lang": m.languages[path[f]]} for f, e in zip(firsts, ends, strict=True)])
                kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return tidy(run)


def label_languages(documents: DataFrame, model: LanguageModel, penalty: float = 12.0) -> DataFrame:
    """Label every whole text of ``documents`` (doc_id, text) with spans of languages.

    Words are split at white space. Words without a letter follow their neighbours. A change of language costs
    ``penalty`` nats. Returns one row per input row: doc_id, lang_pred (the language of most letters; ties go to the
    first name; ``und`` for a null text, one without letters, or a model without languages), score (its share of the
    letters; 0 for ``und``), spans (first_word, end_word, lang; in order, without gaps). Null and repeated doc_ids
    are kept as they are.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    return plain(documents, "doc_id", "text").mapInArrow(_label(held, penalty), f"doc_id long, lang_pred string, score double, spans {SPANS}")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def language_id(documents: DataFrame, penalty: float = 12.0) -> DataFrame:
    """Learn from the rows of ``documents`` (doc_id, text, lang) that are not held out, and label all of them.

    Held out are rows whose crc32 of doc_id as text leaves 2 by 4; a null doc_id is not. Rows without text or lang
    teach nothing. Neither lang nor doc_id is seen by a prediction. Adds held_out (boolean) to ``label_languages``.
    """
    docs = plain(documents, "doc_id", "text", "lang")
    model = fit_languages(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out()))
    return label_languages(docs, model, penalty).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
