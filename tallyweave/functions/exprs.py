"""Column expressions of the ledger. Each returns a Column; none needs Python at run time but ``nfkd_fold``."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from . import vocab


def computed(**columns: Column) -> Column:
    """Columns for a select that later filters and columns read instead of computing them again, as they would if the
    optimizer put the expressions in their places."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def rejoin_acronyms(name: Column) -> Column:
    """Trim, and close the gaps inside runs of one- and two-letter capital groups ("BL W" to "BLW")."""
    runs = F.regexp_extract_all(name, F.lit(r"(\b(?:[A-Z]{1,2}\s+){1,}[A-Z]\b)"), F.lit(1))
    return F.aggregate(runs, F.trim(name), lambda whole, run: F.replace(whole, run, F.regexp_replace(run, r"\s+", "")))


def name_key(name: Column) -> Column:
    """The key by which names are the same: lower case, without marks and trailing legal suffixes, and without a trailing
    "india" if a suffix followed it."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(rejoin_acronyms(name)), r"[.,&'\"]", ""), r"\s+", " "))
    return F.regexp_replace(plain, rf"(?:(?:^|\s)india)?(?:(?:^|\s)(?:{'|'.join(vocab.LEGAL_SUFFIXES)}))+$", "")


def quote_form(text: Column) -> Column:
    """The form in which quotes are looked for: lower case, without page markers, soft hyphens and white space, with
    ligatures spelled out and typographic quotes and dashes as ASCII."""
    out = F.regexp_replace(F.lower(text), r"(?i)\[\[\s*page\s+\d+\s*\]\]", "")
    for mark, plain in (("­", ""), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(mark), F.lit(plain))
    out = F.translate(out, "‘’“”–—", "''\"\"--")
    return F.regexp_replace(out, "(?U)[\\s﻿]+", "")


def quote_hash(quote: Column) -> Column:
    return F.sha2(quote_form(quote), 256)


@F.pandas_udf(StringType())
def nfkd_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, in lower case; Spark has no such function."""
    return text.map(lambda t: None if t is None else _fold(t))


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not 0x300 <= ord(c) <= 0x36F).lower()


#: Characters of texts whose words are held at once.
WORDS_OF_CHARS = 1 << 19


def _words_of(text: str | None) -> tuple[list[str], list[str], list[str], list[int | None]]:
    """Words of a text: folded, as they stand, what follows up to the next one, and the page of the last marker before."""
    tokens, words, gaps, pages = [], [], [], []
    page, last = None, None
    for found in PAGE_OR_WORD.finditer(text or ""):
        if found[1] is not None:
            page = int(found[1])
            continue
        if last is not None:
            gaps.append(text[last : found.start()])
        word, last = found[0], found.end()
        tokens.append(word.lower() if word.isascii() else _fold(word))
        words.append(word)
        pages.append(page)
    if last is not None:
        gaps.append("")
    if not all(tokens):
        tokens, words, gaps, pages = ([v for v, t in zip(column, tokens) if t] for column in (tokens, words, gaps, pages))
    return tokens, words, gaps, pages


def _lists(parts: list[list], kind: pa.DataType) -> pa.ListArray:
    starts = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array([v for part in parts for v in part], kind))


def _word_lists(texts: list[tuple[list, list, list, list]]) -> pa.ListArray:
    """Words of texts as flat columns, and where each text's begin."""
    columns = [_lists(parts, pa.int32() if name == "page" else pa.string()) for name, parts in zip(WORD.names, zip(*texts))]
    return pa.ListArray.from_arrays(columns[0].offsets, pa.StructArray.from_arrays([c.values for c in columns], names=WORD.names))


PAGE_OR_WORD = re.compile(r"\[\[\s*page\s+([0-9]+)\s*\]\]|[^\W_]+", re.IGNORECASE)


WORD = StructType([StructField("token", StringType()), StructField("word", StringType()), StructField("gap", StringType()), StructField("page", IntegerType())])


def _some_at_a_time(*columns: pa.Array) -> Iterator[list[list[str | None]]]:
    """Texts of a batch in parts of a bounded size, as their words take a hundred times their room."""
    sizes = np.cumsum(sum(pc.fill_null(pc.utf8_length(c), 0).to_numpy(zero_copy_only=False) for c in columns))
    first = 0
    while first < len(sizes):
        before = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + WORDS_OF_CHARS, "right")))
        yield [c.slice(first, end - first).to_pylist() for c in columns]
        first = end


@F.arrow_udf(ArrayType(WORD))
def text_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Words of a text: folded, as they stand, what follows up to the next one, and the page of the last marker before."""
    for batch in batches:
        for (texts,) in _some_at_a_time(batch):
            yield _word_lists([_words_of(t) for t in texts])


def _best_window(quote: list[str], text: list[str]) -> tuple[float, int, int, int] | None:
    """The window of a text that shares most words with a quote: the score with a minus, how far its length is off, length,
    start. None without a word in common, or if the text is too short.

    Lengths are the quote's times 0.7, 0.85, 1.15 and 1.3, and one off. Words are shared as multisets; the score is their
    F1. Of a word that the quote has k times, the i-th place p in the text counts for windows that hold p but not the
    (i - k)-th place: for starts after max(p - length, that place), up to p. So each place is a step up and a step down in
    the overlap, and a running sum over the steps gives the overlap of every window.
    """
    m, size, at, since = len(quote), len(text), [], []
    counts = Counter(quote)
    places = {token: [] for token in counts}
    for place, token in enumerate(text):
        if token in places:
            places[token].append(place)
    for token, k in counts.items():
        at += places[token]
        since += ([-1] * k + places[token])[: len(places[token])]
    at, since, found = np.array(at, int), np.array(since, int), []
    for n in {math.floor(m * 0.7), math.floor(m * 0.85), m - 1, m, m + 1, math.ceil(m * 1.15), math.ceil(m * 1.3)}:
        if len(at) and 0 < n <= size:
            low, high = np.maximum(at - n, since) + 1, np.minimum(at, size - n)
            held = low <= high
            shared = np.cumsum(np.bincount(low[held], minlength=size + 2) - np.bincount(high[held] + 1, minlength=size + 2))
            start = int(shared.argmax())
            found.append((-2.0 * int(shared[start]) / (m + n), abs(n - m), n, start))
    return min(found, default=None)


WINDOW = StructType([StructField("quote", ArrayType(StringType())), StructField("len", IntegerType()), StructField("start", IntegerType()), StructField("score", DoubleType()), StructField("first", IntegerType()), StructField("words", ArrayType(WORD))])


@F.arrow_udf(WINDOW)
def best_window(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of a quote and a text: the quote's words, the window of the text that shares most of them (length, start, score;
    null if there is none), and the text's words from ``first`` on, around that window: a length before and two after it,
    and six either side. No other words of a text leave the task; they are made once for rows in a row of one text."""
    of, known = None, None
    for batch in batches:
        for quotes, texts in _some_at_a_time(*batch):
            rows = []
            for quote, text in zip(quotes, texts):
                if known is None or text != of:
                    of, known = text, _words_of(text)
                said = _words_of(quote)[0]
                best = _best_window(said, known[0])
                if best is None:
                    rows.append((said, None, None, None, None, ([], [], [], [])))
                    continue
                minus, _, n, start = best
                first, end = max(min(start - n, start - 6), 0), max(start + 3 * n, start + n + 6)
                rows.append((said, n, start, -minus, first, tuple(column[first:end] for column in known)))
            quote, n, start, score, first, words = zip(*rows)
            columns = [_lists(quote, pa.string()), pa.array(n, pa.int32()), pa.array(start, pa.int32()), pa.array(score, pa.float64()), pa.array(first, pa.int32()), _word_lists(words)]
            yield pa.StructArray.from_arrays(columns, names=WINDOW.names)


def reference_form(text: Column) -> Column:
    """Words of a-z and 0-9 with single spaces, "&" as "and"."""
    return F.trim(F.regexp_replace(F.replace(nfkd_fold(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of the words of two strings."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def similarity(a: Column, b: Column) -> Column:
    """The highest of edit similarity, word Jaccard, and containment of a string of four letters or more."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (short >= 4) & (F.contains(a, b) | F.contains(b, a))
    best = F.greatest(1 - F.levenshtein(a, b) / long, jaccard(a, b), F.when(inside, 0.8 + 0.2 * short / long).otherwise(0.0))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(best)


def report_date(raw: Column) -> Column:
    """ISO, month-first, day-first (ordinals must be right) or dd-MM-yyyy; null if it is none of these or no date."""
    month = "(" + "|".join([*vocab.MONTHS, *[rf"{m[:3]}\.?" for m in vocab.MONTHS]]) + ")"
    day = r"(\d{1,2})(st|nd|rd|th)?"

    def named(pattern: str, m: int, d: int, y: int) -> Column:
        part = lambda k: F.regexp_extract(raw, pattern, k)
        number = F.array_position(F.array(*[F.lit(x[:3]) for x in vocab.MONTHS]), F.lower(F.substring(part(m), 1, 3)))
        n, suffix = part(d).try_cast("int"), F.lower(part(d + 1))
        right = F.when(F.pmod(n, F.lit(100)).between(11, 13), "th").otherwise(F.element_at(F.array(*map(F.lit, ["th", "st", "nd", "rd", "th", "th", "th", "th", "th", "th"])), (F.pmod(n, F.lit(10)) + 1).cast("int")))
        text = F.concat_ws("-", part(y), F.lpad(number.cast("string"), 2, "0"), F.lpad(part(d), 2, "0"))
        return F.when(raw.rlike(pattern) & ((suffix == "") | (suffix == right)), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))

    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")).cast("date"))
    reverse = F.when(raw.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_timestamp(raw, F.lit("dd-MM-yyyy")).cast("date"))
    return F.coalesce(iso, named(rf"(?i)^{month} {day},? (\d{{4}})$", 1, 2, 4), named(rf"(?i)^{day} {month},? (\d{{4}})$", 3, 1, 4), reverse)


def substance_score(relation: Column, quote: Column, exposure: Column, risk: Column, confidence: Column) -> Column:
    evidence = F.lower(F.concat_ws(" ", relation, quote))
    return (F.when(exposure.isNotNull(), 100).otherwise(0) + F.when(F.coalesce(risk, F.lit("")) != "", 60).otherwise(0)
            + F.when(confidence == "high", 10).otherwise(0) + F.when(evidence.rlike(vocab.SUBSTANCE), 30).otherwise(0))


def retry_delay_seconds(attempts: Column) -> Column:
    """Five minutes, doubled with each attempt after the first, a day at most."""
    doubled = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(20))
    return F.least(F.lit(300) * F.pow(F.lit(2), doubled), F.lit(86400)).cast("long")


def next_attempt(now: Column, attempts: Column, not_before: Column) -> Column:
    return F.greatest(F.timestamp_seconds(F.unix_timestamp(now) + retry_delay_seconds(attempts)), not_before)


def issuer_name(name: Column) -> Column:
    """Without a trailing one-symbol listing marker ("Ltd-$"), where a legal suffix stands before it."""
    whole = F.trim(name)
    cut = F.trim(F.regexp_replace(whole, r"\s*-\s*[^\p{L}\p{N}\s]\s*$", ""))
    return F.when((cut != whole) & cut.rlike(rf"(?i)\b(?:{'|'.join(vocab.LEGAL_SUFFIXES)})\.?\s*$"), cut).otherwise(whole)


def feed_date(value: Column) -> Column:
    """Eight digits are midnight in India; else ISO, in UTC where no offset is given."""
    digits = F.try_to_timestamp(F.concat(value, F.lit(" +05:30")), F.lit("yyyyMMdd XXX"))
    return F.when(value.rlike(r"^\d{8}$"), digits).otherwise(value.try_cast("timestamp"))


def attachment_url(value: Column) -> Column:
    folder = F.lit(f"{vocab.FEED_SITE}/xml-data/corpfiling/")
    return (F.when(value.rlike("(?i)^https?://"), value).when(value.startswith("/"), F.concat(F.lit(vocab.FEED_SITE), value))
            .when(value.rlike("(?i)^(?:xml-data/corpfiling/)?Attach(?:Live|His)/"), F.concat(folder, F.regexp_replace(value, "(?i)^xml-data/corpfiling/", "")))
            .when(value.isNotNull(), F.concat(folder, F.lit("AttachLive/"), value)))


def alternate_attachment_url(url: Column) -> Column:
    live, old = "/xml-data/corpfiling/AttachLive/", "/xml-data/corpfiling/AttachHis/"
    known = F.coalesce(F.try_parse_url(url, F.lit("HOST")).rlike(r"(?i)(?:^|\.)bseindia\.com$"), F.lit(False))
    return F.when(known & url.contains(live), F.replace(url, F.lit(live), F.lit(old))).when(known & url.contains(old), F.replace(url, F.lit(old), F.lit(live)))


def percent_text(value: Column) -> Column:
    """Whole numbers as such, else one decimal."""
    return F.regexp_replace(F.format_string("%.1f", value.cast("double")), r"\.0$", "")


def perspective(entity_type: Column, counterparty_type: Column, counterparty: Column, company: Column) -> Column:
    """A relationship as seen from one of its ends."""

    def choose(kind: Column, templates: dict[str, str], name: Column) -> Column:
        out = F.lit(None)
        for k, t in templates.items():
            out = F.when(kind == k, F.format_string(t, name) if "%s" in t else F.lit(t)).otherwise(out)
        return F.coalesce(out, F.concat(F.lit("Relationship with "), name))

    return F.when(entity_type == "target", choose(counterparty_type, vocab.SEEN_BY_TARGET, counterparty)).otherwise(choose(entity_type, vocab.SEEN_BY_OTHERS, company))


def rating_text(rating: Column, agency: Column) -> Column:
    """A rating with its agency before it: in place of a marker in brackets, or added where the rating doesn't start with
    it. A stable outlook follows a slash. An empty rating is not stated."""
    marker = F.concat(F.lit("["), agency, F.lit("]"))
    starts = lambda what: F.lower(F.substring(rating, F.lit(1), F.length(what))) == F.lower(what)
    named = F.when(starts(marker), F.concat(agency, F.lit(" "), F.substring(rating, F.length(marker) + 1, F.length(rating)))).when(~starts(agency), F.concat(agency, F.lit(" "), rating))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(named, rating), r"(?iU)\s*;\s*stable", "/Stable"), r"(?iU)\s*\(stable\)", "/Stable")
    return F.when(F.coalesce(rating, F.lit("")) == "", vocab.NO_RATING).otherwise(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def rated_on(raw: Column) -> Column:
    """A report date as day, short month and year; as it stands if it is no date; or that there is none."""
    return F.when(F.coalesce(raw, F.lit("")) == "", vocab.NO_REPORT_DATE).otherwise(F.coalesce(F.date_format(report_date(raw), "dd MMM yyyy"), raw))


def provenance(rating: Column, agency: Column, raw_date: Column) -> Column:
    """The line that says where a report comes from: rating, agency if there is no rating, date."""
    alone = F.when((F.coalesce(rating, F.lit("")) == "") & agency.isNotNull(), F.concat(F.lit(" · "), agency)).otherwise("")
    return F.concat(rating_text(rating, agency), alone, F.lit(" · rated "), rated_on(raw_date))


def relationship_identity(source: Column, target: Column, relation_type: Column, exposure: Column) -> Column:
    return F.concat_ws("\u001f", name_key(source), name_key(target), relation_type, F.when(exposure.isNull(), "none").otherwise(F.format_string("%.2f", exposure.cast("double"))))


def retryable_chain(errors: Column, depth: int = 5) -> Column:
    """The same of an error with its causes, outermost first (an array of structs code, status, message): of the first
    five, the first code there is decides as a code; a status or message of any one does."""
    near = F.slice(errors, 1, depth)
    code = F.try_element_at(F.filter(F.transform(near, lambda e: e["code"]), lambda c: c.isNotNull()), F.lit(1))
    rest = F.exists(near, lambda e: retryable_error(F.lit(None).cast("string"), e["status"], e["message"]))
    return F.coalesce(code.isin(vocab.RETRYABLE_CODES), F.lit(False)) | F.coalesce(rest, F.lit(False))


def retryable_error(code: Column, status: Column, message: Column) -> Column:
    found = F.coalesce(code.isin(vocab.RETRYABLE_CODES), F.lit(False)) | F.coalesce(status.between(500, 599), F.lit(False)) | F.coalesce(message.rlike("(?i)socket hang up"), F.lit(False))
    return found


def near_token_ceiling(used: Column, most: Column) -> Column:
    return used >= F.ceil(most * 0.9)


def token_cost(read: Column, written: Column, per_million_read: float, per_million_written: float) -> Column:
    """The price of a call, from its tokens and prices a million."""
    return (read * per_million_read + written * per_million_written) / 1_000_000
