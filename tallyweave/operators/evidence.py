"""Evidence: pages of texts, quotes that must stand in them, and why some don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from ..storage import written

MARKER = r"(?i)\[\[\s*page\s+(\d+)\s*\]\]"
#: Texts up to this length go whole; of longer ones, so many first pages and those with a key word.
WHOLE_CHARS, FIRST_PAGES = 50_000, 10
#: Overlap below which a quote counts as absent.
FLOOR = 0.2


def split_pages(docs: DataFrame) -> DataFrame:
    """doc_id, position, page, text: pieces between page markers; text before the first marker has no page."""
    pieces = F.split("text", MARKER)
    numbers = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("text", F.lit(MARKER), F.lit(1)))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(numbers.alias("page"), pieces.alias("text"))).alias("position", "piece"))
    return rows.select("doc_id", "position", F.col("piece")["page"].cast("int").alias("page"), F.col("piece")["text"].alias("text")).filter("text != ''")


def select_model_pages(pages: DataFrame, whole: int = WHOLE_CHARS, first: int = FIRST_PAGES, keywords: str = vocab.PAGE_KEYWORDS) -> DataFrame:
    """Pages (doc_id, position, page, text) to show to a model: all of a short text, else the first and the telling ones."""
    sizes = pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.count("page").alias("paged"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    rows = pages.withColumn("page_index", index).join(sizes, "doc_id")
    return rows.filter((F.col("chars") <= whole) | (F.col("paged") == 0) | (F.col("page_index") < first) | F.col("text").rlike(keywords)).drop("chars", "paged")


def verify_quotes(edges: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (doc_id, quote, ...) whose quote stands in the document, and the others. Documents are normalised once."""
    known = docs.select("doc_id", exprs.quote_form(F.col("text")).alias("_text"))
    rows = edges.join(known, "doc_id", "left").withColumn("_found", F.coalesce(F.contains(F.col("_text"), exprs.quote_form(F.col("quote"))), F.lit(False))).drop("_text")
    return rows.filter("_found").drop("_found"), rows.filter("NOT _found").drop("_found")


def readable_documents(docs: DataFrame, min_chars: int = 200) -> DataFrame:
    chars = F.coalesce(F.length(exprs.quote_form(F.col("text"))), F.lit(0))
    return docs.select("doc_id", chars.alias("chars")).withColumn("readable", F.col("chars") >= min_chars)


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """doc_id, sha256, canonical_id, status: later documents of one content point at the first. Copies meet by a
    pre-aggregated minimum, so a text with many copies is no hot window."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("doc_id").alias("canonical_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = hashed.join(first, "sha256", "left").withColumn("canonical_id", F.coalesce("canonical_id", "doc_id"))
    return rows.withColumn("status", F.when(F.col("doc_id") != F.col("canonical_id"), "superseded_document").otherwise("discovered"))


def documents_by_host(pages: DataFrame) -> DataFrame:
    """page_id, source: which source the host of a URL belongs to, the first that fits."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return pages.select("page_id", F.coalesce(*[F.when(host.contains(part), name) for part, name in vocab.HOST_SOURCES], F.lit("manual")).alias("source"))


def classify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, doc_type, decision_path, headings and signals of documents (doc_id, title, url, text)."""
    value = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", value.alias("value"), F.coalesce("text", F.lit("")).alias("text")).withColumn("form", exprs.reference_form(F.replace("value", F.lit("&"), F.lit(" "))))
    headings = F.filter(F.array(*map(F.lit, vocab.RATIONALE_HEADINGS)), lambda h: F.contains(F.col("form"), h))
    pages = F.greatest(F.regexp_count("text", F.lit(MARKER)), F.lit(1))
    signals = {"transcript": vocab.TRANSCRIPT, "label": vocab.RATIONALE_LABEL, "intimation": vocab.RATING_INTIMATION, "annual": vocab.ANNUAL_REPORT, "related_party": vocab.RELATED_PARTY, "order_news": vocab.ORDER, "drhp": vocab.DRHP}
    rows = rows.select("doc_id", headings.alias("headings"), F.length("text").alias("characters"), pages.alias("pages"), *[F.col("value").rlike(p).alias(s) for s, p in signals.items()])
    rules = [
        (F.col("transcript"), "other", "earnings_transcript"), (F.size("headings") > 0, "rating_rationale", "rationale_substance_precedes_intimation"), (F.col("label"), "rating_rationale", "rationale_label"),
        (F.col("intimation"), "rating_intimation", "intimation_without_rationale_substance"), (F.col("annual"), "annual_report", "annual_report"), (F.col("related_party"), "rpt_schedule", "related_party_schedule"),
        (F.col("order_news"), "order_win", "order_announcement"), (F.col("drhp"), "drhp", "drhp"),
    ]
    kind = F.coalesce(*[F.when(c, t) for c, t, _ in rules], F.lit("other"))
    path = F.coalesce(*[F.when(c, p) for c, _, p in rules], F.lit("conservative_other"))
    return rows.withColumns({"multi_page": (F.col("pages") > 2) | (F.col("characters") >= 12_000), "doc_type": kind, "decision_path": path})


def relationship_phrases(claims: DataFrame) -> DataFrame:
    """Claims with raw_phrase: the wordings of their quotes that have no type of their own, each once (the last spelling,
    at its first place), or null."""
    found = F.concat(*[F.regexp_extract_all("quote", F.lit(f"({p})"), F.lit(1)) for p in vocab.PHRASES])
    keys = F.array_distinct(F.transform("_found", lambda x: F.lower(x)))
    last = F.transform(keys, lambda k: F.element_at(F.filter("_found", lambda x: F.lower(x) == k), -1))
    return claims.withColumn("_found", found).withColumn("raw_phrase", F.when(F.size("_found") > 0, F.array_join(last, "; "))).drop("_found")


def sentence_context(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims (claim_id, doc_id, page, quote) with the sentence around the start of the quote and one either side, else
    260 characters around it, else null. ``pages``: doc_id, position, page, text; a claim without a page that is there sees
    the whole text. No text is carried along with the claims of its pages."""
    own = pages.filter("page IS NOT NULL AND text IS NOT NULL").select("doc_id", "page", F.col("text").alias("_text"))
    # texts are merged, never broadcast: their files may be a tenth of their size
    on_page = claims.join(own.hint("merge"), ["doc_id", "page"])
    # written, so that its size is known: of few claims only their documents are put together
    others = written(claims.join(own.select("doc_id", "page"), ["doc_id", "page"], "left_anti"), "claims")
    wanted = pages.join(others.select("doc_id").distinct(), "doc_id", "left_semi")
    whole = wanted.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "").alias("_text"))
    rows = on_page.unionByName(others.join(whole.hint("merge"), "doc_id", "left"))
    scope = F.trim("_text")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = rows.withColumns({"_scope": scope, "_probe": F.lower(F.substring(flat(F.col("quote")), 1, 72))})
    sentences = F.filter(F.transform(F.regexp_extract_all(F.regexp_replace("_scope", r"\s+", " "), F.lit(r"([^.!?]+[.!?]+|[^.!?]+$)"), F.lit(1)), lambda s: F.trim(s)), lambda s: s != "")
    rows = rows.withColumn("_sentences", sentences)
    hit = F.array_position(F.transform("_sentences", lambda s: F.contains(F.lower(s), F.col("_probe"))), True)
    at = F.instr(F.lower("_scope"), F.col("_probe"))
    rows = rows.withColumns({"_hit": hit.cast("int"), "_at": at})
    near = F.array_join(F.slice("_sentences", F.greatest(F.col("_hit") - 1, F.lit(1)), F.when(F.col("_hit") == 1, 2).otherwise(3)), " ")
    begin = F.greatest(F.col("_at") - 260, F.lit(1))
    window = flat(F.substring("_scope", begin, F.col("_at") + F.length("quote") + 260 - begin))
    return rows.withColumn("context", F.when(F.col("_hit") > 0, near).when(F.col("_at") > 0, window)).drop("_text", "_scope", "_probe", "_sentences", "_hit", "_at")


def best_windows(rejected: DataFrame, docs: DataFrame) -> DataFrame:
    """quote_id, doc_id, m, len, start, score: for each rejected quote (quote_id, doc_id, quote) the window of its
    document that shares most words with it. Documents without a word in common, or too short, have no row."""
    rows = _windows(rejected, docs).filter("best.score IS NOT NULL")
    return rows.select("quote_id", "doc_id", F.size("best.quote").alias("m"), "best.len", "best.start", "best.score")


def _windows(rejected: DataFrame, docs: DataFrame) -> DataFrame:
    """Rejected quotes (quote_id, doc_id), each with ``best`` of its document (see ``exprs.best_window``). A text that is
    asked for is shuffled once, as it stands; its words and the places that they share with quotes stay in a task."""
    wanted = docs.select("doc_id", "text").join(rejected.select("doc_id").distinct(), "doc_id", "left_semi")
    # texts are merged, never broadcast: their files may be a tenth of their size
    rows = rejected.select("quote_id", "doc_id", "quote").join(wanted.hint("merge"), "doc_id", "left")
    return rows.select("quote_id", "doc_id", exprs.computed(best=exprs.best_window("quote", "text")))


def diagnose_rejected_quotes(rejected: DataFrame, docs: DataFrame, floor: float = FLOOR) -> DataFrame:
    """quote_id, doc_id, score (3 decimals), bucket, start_page, end_page of rejected quotes.

    Buckets, first that fits: not_found (below the floor), truncated (the quote itself stands at an edge of the window
    and six words around it), cross_page, table_derived (around the window many short and numeric words or headers, and
    no sentence), paraphrase. Quotes without a word or a document are not found.
    """
    start, size, first = F.col("best.start"), F.col("best.len"), F.col("best.first")

    def part(a: Column, b: Column) -> Column:
        begin = F.greatest(a, F.lit(0))
        return F.slice("best.words", begin - first + 1, b - begin)

    pieces = exprs.computed(window=part(start, start + size), context=part(start - 6, start + size + 6)["token"], around=part(start - size, start + 3 * size))
    rows = _windows(rejected, docs).select("quote_id", "doc_id", F.col("best.quote").alias("q"), F.col("best.score").alias("score"), pieces)
    k = F.size("q")
    at_edge = (F.slice("context", F.lit(1), k) == F.col("q")) | (F.slice("context", F.greatest(F.size("context") - k + 1, F.lit(1)), k) == F.col("q"))
    truncated = (F.size("context") > k) & at_edge
    start_page, end_page = F.element_at("window", 1)["page"], F.element_at("window", -1)["page"]
    share = lambda test: F.size(F.filter("around", test)) / F.size("around")
    short, numeric = share(lambda x: F.length(x["token"]) <= 4), share(lambda x: x["token"].rlike("[0-9]"))
    said = lambda c: F.concat(F.array_join(F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: F.concat(x["word"], x["gap"])), ""), F.element_at(c, -1)["word"])
    text = F.concat_ws(" ", said(F.col("window")), said(F.col("around")))
    table = ~text.rlike(r"[a-z0-9][.!?](?:\s|$)") & (((short >= 0.55) & (numeric >= 0.08)) | ((short >= 0.4) & (numeric >= 0.04) & (F.regexp_count(text, F.lit(vocab.TABLE_HEADER)) >= 2)))
    cross = F.coalesce(start_page != end_page, F.lit(False))
    absent = F.coalesce(F.col("score") < floor, F.lit(True))
    bucket = F.when(absent, "not_found").when(truncated, "truncated").when(cross, "cross_page").when(table, "table_derived").otherwise("paraphrase")
    page = lambda p, name: F.when(~absent, p).alias(name)
    return rows.select("quote_id", "doc_id", F.coalesce(F.round("score", 3), F.lit(0.0)).alias("score"), bucket.alias("bucket"), page(start_page, "start_page"), page(end_page, "end_page"))


def merge_diagnostics(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both, stored ones first; of rows alike in doc_id, quote, page, ends and bucket the earliest stays."""
    key = ["doc_id", "quote", "page", "source", "target", "bucket"]
    both = stored.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    return both.groupBy(*key).agg(F.min("batch").alias("batch"), F.min_by("score", "batch").alias("score"))
