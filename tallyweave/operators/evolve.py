"""How the ledger changes: reconciliation of new claims, review, supersession, retries, status logs. Nothing is updated in
place: each job returns the rows to append and those that it rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from .closure import follow

RELATION = ["doc_id", "source_entity_id", "target_entity_id", "relation_type"]


def append_claims(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``new`` whose relation and quote hash are not stored yet, each once (the smallest ordinal)."""
    key = [*RELATION, "quote_hash"]
    first = new.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))).filter("n = 1").drop("n")
    return first.join(existing.select(*key), key, "left_anti")


def reconcile_claims(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (ordinal, relation, quote_hash) with action: repeat (of this batch), exact (stored), variant (stored with
    another quote), variant_pending (met earlier in this batch with another quote) or insert."""
    stored = existing.groupBy(*RELATION).agg(F.count("*").alias("stored"))
    exact = existing.select(*RELATION, "quote_hash", F.lit(True).alias("same")).distinct()
    by_quote, by_relation = Window.partitionBy(*RELATION, "quote_hash").orderBy("ordinal"), Window.partitionBy(*RELATION).orderBy("ordinal")
    rows = candidates.withColumns({"quote_place": F.row_number().over(by_quote), "place": F.row_number().over(by_relation)})
    rows = rows.join(stored, RELATION, "left").join(exact, [*RELATION, "quote_hash"], "left")
    action = F.when(F.col("quote_place") > 1, "repeat").when(F.col("same"), "exact").when(F.col("stored") > 0, "variant").when(F.col("place") > 1, "variant_pending").otherwise("insert")
    return rows.withColumn("action", action).drop("quote_place", "place", "same")


def reconciliation_counts(actions: DataFrame, *keys: str) -> DataFrame:
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return actions.groupBy(*keys).agg(n("exact", "variant").alias("relationship_existing"), n("repeat", "exact").alias("exact_quote_skipped"), n("variant", "variant_pending").alias("quote_variants"), n("insert").alias("new_claims"))


def reprocess_log(runs: DataFrame, documents: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log entries of runs (doc_id, run_trigger, version) of documents that may be reprocessed, and the other runs."""
    ready = documents.filter("status = 'ready_for_review' AND company_id IS NOT NULL AND published_date IS NOT NULL").select("doc_id", F.lit(True).alias("ok"))
    rows = runs.join(ready, "doc_id", "left")
    entries = rows.filter("ok").drop("ok").join(reconciliation_counts(actions, "doc_id"), "doc_id", "left").fillna(0)
    return entries, rows.filter("ok IS NULL").drop("ok")


def supersede_claims(requests: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (claim_id, new_claim_id, new_quote): replacement rows, restated prior rows, and rejects with a reason."""
    prior = requests.join(claims, "claim_id", "left")
    first = F.row_number().over(Window.partitionBy("claim_id").orderBy("new_claim_id"))
    reason = F.when(F.col("doc_id").isNull(), "missing").when(F.col("lifecycle_state") == "superseded", "already superseded").when(F.col("n") > 1, "asked twice")
    judged = prior.withColumn("n", first).withColumn("reason", reason)
    good = judged.filter("reason IS NULL")
    new = good.select(F.col("new_claim_id").alias("claim_id"), F.col("new_quote").alias("quote"), "doc_id", F.lit("current").alias("lifecycle_state"), F.lit(None).cast("long").alias("superseded_by"))
    old = good.select("claim_id", "quote", "doc_id", F.lit("superseded").alias("lifecycle_state"), F.col("new_claim_id").alias("superseded_by"))
    return new, old, judged.filter("reason IS NOT NULL").select("claim_id", "new_claim_id", "reason")


def supersession_chains(claims: DataFrame) -> DataFrame:
    """claim_id, first_version, current_version, version (from 1), versions, in_cycle of claims (claim_id, superseded_by).

    Links are followed by doubling, so a chain of any length takes a few rounds. Where several claims name one successor,
    its history goes on with the smallest of them. Claims in or before a cycle, which no good ledger has, have nulls.
    """
    forward = claims.filter("superseded_by IS NOT NULL").groupBy(F.col("claim_id").alias("id")).agg(F.min("superseded_by").alias("into"))
    back = forward.groupBy(F.col("into").alias("id")).agg(F.min("id").alias("into"))
    to_end, _ = follow(forward)
    to_start, _ = follow(back)
    rows = claims.select("claim_id").distinct().join(forward.select(F.col("id").alias("claim_id"), F.lit(True).alias("old")), "claim_id", "left").join(back.select(F.col("id").alias("claim_id"), F.lit(True).alias("next")), "claim_id", "left")
    rows = rows.join(to_end.select(F.col("id").alias("claim_id"), F.col("at").alias("current"), F.col("steps").alias("ahead")), "claim_id", "left").join(to_start.select(F.col("id").alias("claim_id"), F.col("at").alias("first"), F.col("steps").alias("behind")), "claim_id", "left")
    lost = (F.col("old") & F.col("current").isNull()) | (F.col("next") & F.col("first").isNull())
    lost = F.coalesce(lost, F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0))
    own = lambda c: F.when(~lost, c)
    return rows.select("claim_id", own(F.coalesce("first", "claim_id")).alias("first_version"), own(F.coalesce("current", "claim_id")).alias("current_version"), own(zero("behind") + 1).alias("version"), own(zero("behind") + zero("ahead") + 1).alias("versions"), lost.alias("in_cycle"))


def apply_review_decisions(requests: DataFrame, claims: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, doc_id, claim_id, decision, reason, method, phrase) to new claim states and rejects; a request
    counts as a whole. Bulk needs two claims or more and the typed phrase, individual exactly one."""
    ready = documents.filter("status = 'ready_for_review'").select("doc_id", F.lit(True).alias("ready"))
    rows = requests.join(claims.select("claim_id", F.col("doc_id").alias("own_doc"), "verification_tier"), "claim_id", "left").join(ready, "doc_id", "left")
    whole = Window.partitionBy("request_id")
    n = F.count("*").over(whole)
    rows = rows.withColumn("n", n)
    yes = lambda c: F.coalesce(c, F.lit(False))
    reasoned = (F.col("decision") == "approve") | ((F.col("decision") == "reject") & (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    counted = ((F.col("method") == "individual") & (F.col("n") == 1)) | ((F.col("method") == "bulk") & (F.col("n") >= 2) & (F.col("phrase") == F.concat_ws(" ", "decision", F.col("n").cast("string"), F.lit("claims"))))
    fault = F.when(~yes(F.col("ready")), "document not ready").when(~yes(F.col("own_doc") == F.col("doc_id")), "claim not of document").when(~yes(F.col("verification_tier") == "machine_validated"), "claim already decided").when(~yes(reasoned), "no reason").when(~yes(counted), "wrong method")
    judged = rows.withColumn("fault", fault).withColumn("bad", F.max(F.col("fault").isNotNull()).over(whole))
    states = judged.filter("NOT bad").select("claim_id", "doc_id", F.when(F.col("decision") == "approve", "human_verified").otherwise("excluded").alias("verification_tier"), F.lit("decided").alias("review_state"), F.when(F.col("decision") == "reject", F.col("reason")).alias("exclusion_reason"), F.col("method").alias("decision_method"))
    return states, judged.filter("bad").groupBy("request_id").agg(F.min("fault").alias("fault"))


def park_second_look(requests: DataFrame, claims: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (claim_id, note) to claims that need a second look: pending ones, with a note."""
    rows = requests.join(claims.select("claim_id", "doc_id", "verification_tier"), "claim_id", "left").join(documents.select("doc_id", "status"), "doc_id", "left")
    good = F.coalesce((F.col("status") == "ready_for_review") & (F.col("verification_tier") == "machine_validated") & (F.trim(F.coalesce("note", F.lit(""))) != ""), F.lit(False))
    return rows.filter(good).select("claim_id", F.lit("needs_second_look").alias("review_state"), F.col("note").alias("review_note")), rows.filter(~good).select("claim_id", "note")


def publishable_documents(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """Documents that wait for review without a pending claim; none at all is fine."""
    pending = claims.filter("verification_tier = 'machine_validated'").select("doc_id")
    return documents.filter("status = 'ready_for_review'").join(pending, "doc_id", "left_anti")


def transition_matrix(rule: str = "db") -> list[tuple[str, str]]:
    """Allowed moves. The database lets any status end, and ends restart; the application closes ended ones."""
    chain = list(zip(vocab.STATUS_CHAIN, vocab.STATUS_CHAIN[1:], strict=False))
    if rule == "db":
        return chain + [(a, b) for a in vocab.DOCUMENT_STATUS for b in vocab.STATUS_ENDS if a != b] + [("failed", "discovered"), ("excluded", "discovered")]
    return chain + [(a, b) for a in vocab.STATUS_CHAIN[:-1] for b in vocab.STATUS_ENDS]


def validate_transitions(status_log: DataFrame, rule: str = "db") -> DataFrame:
    """Moves in a log (doc_id, seq, status) that no rule allows."""
    allowed = status_log.sparkSession.createDataFrame(transition_matrix(rule), "before string, status string")
    moves = status_log.withColumn("before", F.lag("status").over(Window.partitionBy("doc_id").orderBy("seq"))).filter("before IS NOT NULL AND before != status")
    return moves.join(F.broadcast(allowed), ["before", "status"], "left_anti")


def retry_plan(failures: DataFrame) -> DataFrame:
    """Failures (doc_id, at, attempts, http_status) to what comes next: 404 fails for good, a block waits a day, others
    wait five minutes, doubled with each attempt."""
    blocked = F.coalesce(F.col("http_status").isin(403, 429), F.lit(False))
    not_before = F.when(blocked, F.timestamp_seconds(F.unix_timestamp("at") + 86400))
    gone = F.coalesce(F.col("http_status") == 404, F.lit(False))
    return failures.select("doc_id", F.when(gone, "failed").otherwise("discovered").alias("status"), exprs.retry_delay_seconds(F.col("attempts")).alias("delay_seconds"), F.when(~gone, exprs.next_attempt(F.col("at"), F.col("attempts"), not_before)).alias("next_attempt"))


def reclassify_candidates(documents: DataFrame, doc_type: str) -> DataFrame:
    """Log rows that set excluded documents back, with the type that is forced on them."""
    return documents.filter("status = 'excluded'").select("doc_id", F.lit("discovered").alias("status"), F.lit(doc_type).alias("forced_type"))


def resume_state(incoming: DataFrame, documents: DataFrame, claims: DataFrame) -> DataFrame:
    """Incoming (sha256) to new, resume or duplicate. Stored early states resume; a validated one only without claims."""
    has = claims.select("doc_id").distinct().withColumn("claimed", F.lit(True))
    known = documents.select("sha256", "doc_id", "status").join(has, "doc_id", "left")
    rows = incoming.join(known, "sha256", "left")
    early = F.col("status").isin("discovered", "fetched", "classified", "failed") | ((F.col("status") == "validated") & F.col("claimed").isNull())
    return rows.select("sha256", "doc_id", F.when(F.col("doc_id").isNull(), "new").when(early, "resume").otherwise("duplicate").alias("action"))
