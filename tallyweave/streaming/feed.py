"""The announcement feed: payloads to typed rows, their status, the state of the feed. All row rules run alike on batches
and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from ..storage import in_ranges

#: Lateness after which rows go to a repair job, and how far back a first run looks.
LATENESS = "24 hours"
INTERVAL_SECONDS, BLOCK_SECONDS, CIRCUIT = 1800, 86400, 3


def _field(name: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col("_fields")[k]), F.lit("")) for k in vocab.FEED_KEYS[name]])


def read_announcements(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (payload: JSON text) to typed announcements, and the payloads that lack what every announcement needs."""
    rows = payloads.withColumn("_fields", F.from_json("payload", "map<string, string>"))
    typed = rows.select(*payloads.columns, exprs.computed(**{name: _field(name) for name in vocab.FEED_KEYS}))
    named = [c for c in typed.columns if c != "attachment"]
    typed = typed.select(*named, exprs.computed(announced=exprs.feed_date(F.col("date")), attachment_url=exprs.attachment_url(F.col("attachment"))))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("external_id", "scrip_code", "company_name", "headline", "announced")]))
    judged = typed.withColumn("missing", missing)
    return judged.filter(F.size("missing") == 0).drop("missing", "date"), judged.filter(F.size("missing") > 0).select("payload", "missing")


def is_relevant() -> Column:
    return F.concat_ws(" ", "headline", "category", "sub_category").rlike(vocab.RATING_LANGUAGE)


def relevant_announcements(rows: DataFrame) -> DataFrame:
    return rows.filter(is_relevant())


def ignored_announcements(rows: DataFrame, companies: DataFrame, source: str, since: str | None = None) -> DataFrame:
    """Ignored announcements of a source, of a date on if one is given, by company and newest first."""
    found = rows.filter((F.col("source") == source) & (F.col("status") == "ignored"))
    if since is not None:
        found = found.filter(F.col("announced") >= F.lit(since).cast("timestamp"))
    return found.join(companies.select("company_id", "name"), "company_id", "left").orderBy("name", F.desc("announced"))


def announcement_stream(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Announcements with company_id, status and failure_reason. ``companies``: company_id, name, scrip_code; a mapping
    that people keep, so it is small, and Spark broadcasts it only if it is.

    A name that isn't the mapped company's fails; without rating language or an attachment it is ignored; else linked.
    """
    key = lambda c: exprs.name_key(exprs.issuer_name(F.col(c)))
    mapped = companies.select("company_id", F.col("name").alias("mapped_name"), "scrip_code", key("name").alias("_mapped_key"))
    known = rows.select("*", exprs.computed(_key=key("company_name"))).join(mapped, "scrip_code", "left")
    same = F.col("_mapped_key") == F.col("_key")
    status = F.when(F.col("company_id").isNull(), "skipped").when(~same, "failed").when(~is_relevant() | F.col("attachment_url").isNull(), "ignored").otherwise("linked")
    return known.withColumns({"status": status, "failure_reason": F.when(~same, "company name mismatch")}).drop("_key", "_mapped_key")


def latest_announcements(log: DataFrame) -> DataFrame:
    """The state of each announcement (source, external_id) from an append-only log (batch_id, status, ...): the latest
    payload; a link once made stays, unless the row became irrelevant."""
    return linked_status(folded_log(log))


def folded_log(log: DataFrame) -> DataFrame:
    """One row of each announcement: the last of the log, and whether any was linked (``was_linked``, which rows of an
    earlier fold bring along). Folding in parts gives what folding at once gives."""
    key, own = ["source", "external_id"], F.col("status") == "linked"
    if "was_linked" in log.columns:
        own = own | F.coalesce("was_linked", F.lit(False))
    last = log.groupBy(*key).agg(F.max(F.struct("batch_id", "row_no", *[c for c in log.columns if c not in (*key, "batch_id", "row_no", "was_linked")])).alias("r"), F.bool_or(own).alias("was_linked"))
    return last.select(*key, "r.*", "was_linked")


def linked_status(folded: DataFrame) -> DataFrame:
    return folded.withColumn("status", F.when(F.col("was_linked") & (F.col("status") != "ignored"), "linked").otherwise(F.col("status"))).drop("was_linked")


def discover_documents(linked: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One document for each linked announcement: provisional sha256, company, url; those stored already are left out."""
    rows = linked.filter("status = 'linked'").select(F.sha2(F.concat(F.lit("bse-announcement:"), "external_id"), 256).alias("sha256"), "external_id", "company_id", F.col("attachment_url").alias("url"), "announced")
    if rows.isStreaming:
        rows = rows.withWatermark("announced", LATENESS).dropDuplicatesWithinWatermark(["sha256"])
    else:
        rows = rows.groupBy("sha256").agg(F.min(F.struct("announced", "external_id", "company_id", "url")).alias("r")).select("sha256", "r.external_id", "r.company_id", "r.url", "r.announced")
    return rows.join(stored.select("sha256"), "sha256", "left_anti") if stored is not None else rows


def late_rows(rows: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Rows older than their source's watermark less the lateness: for the repair job."""
    return rows.join(watermarks.select("source", "watermark"), "source").filter(F.col("announced") < F.col("watermark") - F.expr(f"INTERVAL {LATENESS}")).drop("watermark")


def feed_watermark(batches: DataFrame) -> DataFrame:
    """source, watermark, since: the state after the metrics (source, batch_id, max_date, failed, backfill, at) of all polls.

    Polls that fail or fill back leave the watermark as it is. Of the others the greatest date counts; an empty one keeps
    what there is, and only without any date so far its own time is taken. ``since`` is where the next poll starts: the
    watermark, or a day before the last poll if there is none. The order of polls matters for the first good one only,
    so this is one aggregation with partial sums.
    """
    counts = ~F.col("failed") & ~F.col("backfill")
    first = F.min(F.when(counts, F.struct("batch_id", F.coalesce("max_date", "at").alias("start"))))
    state = batches.groupBy("source").agg(F.greatest(F.max(F.when(counts, F.col("max_date"))), first["start"]).alias("watermark"), F.max("at").alias("_at"))
    return state.select("source", "watermark", F.coalesce("watermark", F.col("_at") - F.expr(f"INTERVAL {LATENESS}")).alias("since"))


def feed_health(polls: DataFrame) -> DataFrame:
    """Poll log (source, at, outcome: success, failure or block; mapped) with what the next poll of that time would do:
    failures in a row, disabled_until and skip (disabled_until, poll_interval, circuit_open, no_mapped_companies or null).

    A source's log is cut into ranges of time. Of each range its first poll, whether it has a reset, the failures after
    the last one and the last block are carried on to the next ranges; the rest is counted within a range, by many tasks.
    """
    rows = in_ranges(polls, ["source"], [F.col("at")], "polls").withColumn("_until", F.when(F.col("outcome") == "block", F.unix_timestamp("at") + BLOCK_SECONDS))
    part = Window.partitionBy("source", "range_no").orderBy("range_at")
    so_far = part.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum((F.col("outcome") != "failure").cast("int")).over(so_far))
    tail = rows.groupBy("source", "range_no", "island").agg(F.count_if(F.col("outcome") == "failure").alias("n"), F.min("at").alias("first_at"), F.max("_until").alias("until"))
    parts = tail.groupBy("source", "range_no").agg(F.max("island").alias("resets"), F.max_by("n", "island").alias("open"), F.min("first_at").alias("first_at"), F.max("until").alias("until"))
    order = Window.partitionBy("source").orderBy("range_no")
    parts = parts.withColumn("era", F.sum((F.col("resets") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("standing", F.sum("open").over(Window.partitionBy("source", "era").orderBy("range_no").rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.select("source", "range_no", F.coalesce(F.lag("standing").over(order), F.lit(0)).alias("_before"), F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_until_before"), F.lead("first_at").over(order).alias("_next_range"))
    failures = F.sum((F.col("outcome") == "failure").cast("int")).over(Window.partitionBy("source", "range_no", "island").orderBy("range_at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"failures": failures, "_until": F.max("_until").over(so_far), "_next": F.lead("at").over(part)}).join(parts, ["source", "range_no"])
    rows = rows.withColumns({"failures": F.col("failures") + F.when(F.col("island") == 0, F.col("_before")).otherwise(0), "disabled_until": F.timestamp_seconds(F.greatest("_until", "_until_before")), "next_at": F.coalesce("_next", "_next_range")})
    skip = F.when(F.col("next_at") < F.col("disabled_until"), "disabled_until").when(F.unix_timestamp("next_at") - F.unix_timestamp("at") < INTERVAL_SECONDS, "poll_interval").when(F.col("failures") >= CIRCUIT, "circuit_open").when(~F.col("mapped"), "no_mapped_companies")
    return rows.withColumn("skip", skip).drop("island", "range_no", "range_at", "_until", "_next", "_before", "_until_before", "_next_range")


def feed_run_summary(labelled: DataFrame, companies: DataFrame) -> DataFrame:
    """Counts of each company's announcements by status; companies without a mapping are skipped."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = labelled.groupBy("company_id").agg(F.count("*").alias("seen"), F.count_if(F.col("status").isin("linked")).alias("relevant"), n("linked").alias("linked"), n("ignored").alias("ignored"), n("failed").alias("failed"))
    return companies.join(counts, "company_id", "left").fillna(0, ["seen", "relevant", "linked", "ignored", "failed"]).withColumn("skipped", F.col("scrip_code").isNull())
