"""Facts of the ledger: latest documents, retained claims, the joined fact rows, review queues and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..storage import ranked

RISK_RANK = {"high": 0, "medium": 1, "low": 2}


def retained_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("verification_tier").isin(vocab.RETAINED_TIERS))


def claims_for_company(claims: DataFrame, documents: DataFrame, company_id: int) -> DataFrame:
    """A company's claims, newest document first."""
    own = claims.filter(F.col("company_id") == company_id).join(documents.select("doc_id", "published_date"), "doc_id")
    return own.orderBy(F.desc_nulls_first("published_date"), F.desc("claim_id"))


def company_by_slug(companies: DataFrame, slug: str) -> DataFrame:
    return companies.filter(F.col("slug") == slug).limit(1)


def open_documents(documents: DataFrame, companies: DataFrame) -> DataFrame:
    """Documents that are neither published nor excluded, with their companies' names where known, newest first."""
    waiting = documents.filter(~F.col("status").isin("published", "excluded"))
    return waiting.join(companies.select("company_id", "name"), "company_id", "left").orderBy(F.desc_nulls_first("published_date"), "doc_id")


def near_ceiling_documents(documents: DataFrame, status: str, doc_type: str) -> DataFrame:
    """Documents whose metadata (variant) say that the extraction came near its token ceiling."""
    near = F.try_variant_get("metadata", "$.extraction.near_token_ceiling", "boolean")
    return documents.filter((F.col("status") == status) & (F.col("doc_type") == doc_type) & F.coalesce(near, F.lit(False)))


def latest_published_document(documents: DataFrame) -> DataFrame:
    """Each company's newest published document; without a date last, ties to the later doc_id."""
    order = Window.partitionBy("company_id").orderBy(F.desc_nulls_last("published_date"), F.desc("doc_id"))
    return documents.filter("status = 'published'").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def due_documents(documents: DataFrame, status: str, now: int, k: int) -> DataFrame:
    """The k documents of a status that wait longest: due ones by their next attempt, those without one last."""
    due = documents.filter((F.col("status") == status) & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now)))
    return due.orderBy(F.asc_nulls_last("next_attempt"), "doc_id").limit(k)


def first_alias(aliases: DataFrame) -> DataFrame:
    """One name of an entity in a document: the smallest, so that several do not multiply claims."""
    return aliases.groupBy("entity_id", "doc_id").agg(F.min("raw_name").alias("raw_name"))


def graph_facts(claims: DataFrame, documents: DataFrame, companies: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims of ``documents`` with company, document, and both ends; an end's label is its alias in that very document,
    else its canonical name."""
    names, alias = entities.select("entity_id", "canonical_name", "entity_type", F.col("company_id").alias("own_company")), first_alias(aliases)
    docs = documents.select("doc_id", "published_date", "agency", "title", "status")
    rows = claims.join(docs, "doc_id").join(companies.select("company_id", F.col("name").alias("company"), "slug"), "company_id")
    for end in ("source", "target"):
        entity = names.select(*[F.col(c).alias(f"{end}_{c}") for c in names.columns])
        own = alias.select(F.col("entity_id").alias(f"{end}_entity_id"), "doc_id", F.col("raw_name").alias(f"{end}_alias"))
        rows = rows.join(entity, f"{end}_entity_id").join(own, [f"{end}_entity_id", "doc_id"], "left").withColumn(f"{end}_label", F.coalesce(f"{end}_alias", f"{end}_canonical_name"))
    return rows


def company_graph_facts(claims, documents, companies, entities, aliases) -> DataFrame:
    """Fact rows of each company's latest published document, retained claims only."""
    return graph_facts(retained_claims(claims), latest_published_document(documents), companies, entities, aliases)


def corpus_facts(claims, documents, companies, entities, aliases) -> DataFrame:
    """Fact rows of all published documents, retained claims only."""
    return graph_facts(retained_claims(claims), documents.filter("status = 'published'"), companies, entities, aliases)


def review_facts(claims, documents, companies, entities, aliases) -> DataFrame:
    """Fact rows of documents that wait for review, claims of all tiers."""
    return graph_facts(claims, documents.filter("status = 'ready_for_review'"), companies, entities, aliases)


def claims_resolved(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claims with the terminal entity of either end."""
    for end in ("source", "target"):
        ids = resolved.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("resolved_id").alias(f"{end}_resolved"))
        claims = claims.join(ids, f"{end}_entity_id", "left").withColumn(f"{end}_resolved", F.coalesce(f"{end}_resolved", f"{end}_entity_id"))
    return claims


def entity_across_corpus(claims_with_ends: DataFrame, resolved: DataFrame, entity_id: int) -> DataFrame:
    """Retained claims, of documents in any status, one of whose ends resolves as the entity does."""
    goal = resolved.filter(F.col("entity_id") == entity_id).select(F.col("resolved_id").alias("goal"))
    ends = retained_claims(claims_with_ends).withColumn("end", F.explode(F.array_distinct(F.array("source_resolved", "target_resolved"))))
    return ends.join(goal, F.col("end") == F.col("goal"), "left_semi").drop("end").dropDuplicates(["claim_id"])


def verified_companies(claims: DataFrame, documents: DataFrame, companies: DataFrame) -> DataFrame:
    """Counts of retained claims of each company's latest published document; without such claims a company is left out."""
    risk = [F.count_if(F.col("risk_flag") == r).alias(r) for r in vocab.RISK_FLAGS]
    tier = [F.count_if(F.col("verification_tier") == t).alias(t) for t in vocab.RETAINED_TIERS]
    latest = latest_published_document(documents).select("doc_id", "agency", "published_date")
    counts = retained_claims(claims).groupBy("company_id", "doc_id").agg(F.count("*").alias("claim_count"), *risk, *tier)
    return counts.join(latest, "doc_id").join(companies, "company_id").select("company_id", "slug", "name", "agency", "published_date", "claim_count", *vocab.RISK_FLAGS, *vocab.RETAINED_TIERS)


def review_queue(claims: DataFrame, documents: DataFrame, companies: DataFrame) -> DataFrame:
    """Documents that wait for review with their claims, pending and excluded ones; also those without claims."""
    counts = claims.groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(F.col("verification_tier") == "machine_validated").alias("pending"), F.count_if(F.col("verification_tier") == "excluded").alias("excluded"))
    waiting = documents.filter("status = 'ready_for_review'").select("doc_id", "company_id", "title", "published_date")
    return waiting.join(companies.select("company_id", "name"), "company_id", "left").join(counts, "doc_id", "left").fillna(0, ["claims", "pending", "excluded"])


def excluded_claim_count(claims: DataFrame, documents: DataFrame) -> DataFrame:
    counts = claims.filter("verification_tier = 'excluded'").groupBy("doc_id").agg(F.count("*").alias("excluded"))
    return documents.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["excluded"])


def published_documents_per_company(documents: DataFrame, companies: DataFrame) -> DataFrame:
    counts = documents.groupBy("company_id").agg(F.count_distinct(F.when(F.col("status") == "published", F.col("doc_id"))).alias("published"))
    return companies.join(counts, "company_id", "left").fillna(0, ["published"])


def entity_usage(claims_with_ends: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims that each named entity is an end of, and the distinct titles of their documents; unused entities too. The
    titles of one entity are one value here; ``entity_titles`` has them as rows."""
    ends = claims_with_ends.select(F.col("source_resolved").alias("entity_id"), "doc_id").unionAll(claims_with_ends.select(F.col("target_resolved").alias("entity_id"), "doc_id"))
    titles = F.sort_array(F.collect_set("title"))
    used = ends.join(documents.select("doc_id", "title"), "doc_id").groupBy("entity_id").agg(F.count("*").alias("claims"), titles.alias("titles"))
    named = entities.filter("entity_type != 'unnamed'").select("entity_id", "canonical_name")
    return named.join(used, "entity_id", "left").withColumns({"claims": F.coalesce("claims", F.lit(0)), "titles": F.coalesce("titles", F.array().cast("array<string>"))})


def entity_titles(claims_with_ends: DataFrame, documents: DataFrame) -> DataFrame:
    """entity_id, title, claims, place: the titles of an entity's documents in order, each once, however many they are."""
    ends = claims_with_ends.select(F.explode(F.array("source_resolved", "target_resolved")).alias("entity_id"), "doc_id").groupBy("entity_id", "doc_id").agg(F.count("*").alias("claims"))
    titles = ends.join(documents.select("doc_id", "title"), "doc_id").groupBy("entity_id", "title").agg(F.sum("claims").alias("claims"))
    return ranked(titles, ["entity_id"], [F.col("title")], "titles").withColumn("place", F.col("place") + 1)


def multi_document_entities(claims_with_ends: DataFrame, min_docs: int = 2, approximate: bool = False) -> DataFrame:
    """Entities at an end of claims of several documents; ``approximate`` counts with a sketch."""
    ends = claims_with_ends.select(F.explode(F.array("source_resolved", "target_resolved")).alias("entity_id"), "doc_id")
    count = F.approx_count_distinct("doc_id") if approximate else F.count_distinct("doc_id")
    return ends.groupBy("entity_id").agg(count.alias("documents")).filter(F.col("documents") >= min_docs)


def mismatch_bucket_counts(diagnostics: DataFrame) -> DataFrame:
    """Rejected quotes of each document by bucket, all five, zero where none."""
    return diagnostics.groupBy("doc_id").pivot("bucket", vocab.MISMATCH_BUCKETS).count().fillna(0)


def retry_backlog(documents: DataFrame, now: int) -> DataFrame:
    """Waiting documents and the earliest next attempt, by status."""
    return documents.groupBy("status").agg(F.count("*").alias("pending"), F.min(F.coalesce("next_attempt", F.lit(now))).alias("earliest"))


def discovered_backlog(documents: DataFrame, now: int) -> DataFrame:
    """Discovered documents of each source: how many wait, how many are due, how many have failed before, and the earliest
    next attempt; a document without a time is due now."""
    at = F.coalesce("next_attempt", F.lit(now))
    waiting = documents.filter("status = 'discovered'").groupBy("source")
    return waiting.agg(F.count("*").alias("pending"), F.count_if(at <= now).alias("due"), F.count_if(F.col("attempts") > 0).alias("retried"), F.min(at).alias("earliest"))


def review_order(claims: DataFrame, nulls: str = "last") -> Column | list[Column]:
    """Sort keys: high, medium, low and no risk, then exposure; claims without exposure are last, or first."""
    rank = F.coalesce(*[F.when(F.col("risk_flag") == r, k) for r, k in RISK_RANK.items()], F.lit(3))
    exposure = F.desc_nulls_last("exposure_bp") if nulls == "last" else F.desc_nulls_first("exposure_bp")
    return [rank, exposure, F.col("claim_id")]


def claims_by_quote(claims: DataFrame) -> DataFrame:
    """Claims of a document by identical quote: the claims in review order, and the quotes in order of their first."""
    ranked = claims.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(*review_order(claims))))
    grouped = ranked.groupBy("doc_id", "quote").agg(F.min("place").alias("first_place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "claim_id"))), lambda x: x["claim_id"].cast("string")), ",").alias("claim_ids"))
    return grouped


def failure_bursts(events: DataFrame, key: str, seconds: int = 60, limit: int = 5) -> DataFrame:
    """Events of each key with how many lie in the trailing window (its old end excluded), and whether that trips."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy(key).orderBy("micros").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("micros", micros).withColumn("recent", F.count("*").over(window)).withColumn("tripped", F.col("recent") >= limit).drop("micros")


def recent_rows(rows: DataFrame, companies: DataFrame, k: int = 20) -> DataFrame:
    """The newest k announcements, with their companies where known."""
    return rows.orderBy(F.desc("announced"), F.desc("external_id")).limit(k).join(companies.select("company_id", "name"), "company_id", "left")


def latest_per_version(runs: DataFrame) -> DataFrame:
    """The latest completed run of each prompt version, of schema version 1 only."""
    order = Window.partitionBy("prompt_version").orderBy(F.desc("completed_at"), F.desc("run_id"))
    return runs.filter("schema_version = 1").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counted = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionAll(more)
    return out
