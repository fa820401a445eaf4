"""Audits: constraints as jobs that return the rows which break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def _isin(column: str, values: list[str]) -> Column:
    return F.col(column).isNull() | F.col(column).isin(values)


def claim_rules() -> dict[str, Column]:
    """Each rule holds for a good claim; null counts as good where the rule says nothing of null."""
    tier, state = F.col("verification_tier"), F.col("review_state")
    return {
        "relation_type": _isin("relation_type", vocab.RELATION_TYPES),
        "exposure_range": F.col("exposure_bp").isNull() | F.col("exposure_bp").between(0, 10000),
        "risk_flag": _isin("risk_flag", vocab.RISK_FLAGS),
        "page_positive": F.col("page").isNull() | (F.col("page") > 0),
        "lifecycle_state": _isin("lifecycle_state", vocab.LIFECYCLE_STATES),
        "supersession_link": (F.col("lifecycle_state") == "superseded") == F.col("superseded_by").isNotNull(),
        "not_self_superseding": F.col("superseded_by").isNull() | (F.col("superseded_by") != F.col("claim_id")),
        "verification_tier": _isin("verification_tier", vocab.VERIFICATION_TIERS),
        "exclusion_reason": (tier != "excluded") | F.col("exclusion_reason").isNotNull(),
        "review_state": _isin("review_state", vocab.REVIEW_STATES),
        "state_matches_tier": ((tier == "machine_validated") & state.isin("pending", "needs_second_look")) | (tier.isin("human_verified", "excluded") & (state == "decided")),
        "second_look_note": (state != "needs_second_look") | (F.trim(F.coalesce("review_note", F.lit(""))) != ""),
        "decision_method": _isin("decision_method", vocab.DECISION_METHODS),
    }


def check_violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule of each row that breaks a rule, in one pass over the table."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphan_violations(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti")


#: What a claim says, which never changes once it is written; and what its review has decided.
SUBSTANCE_COLUMNS = [
    "doc_id", "company_id", "source_entity_id", "target_entity_id", "relation_type", "relation_label", "raw_phrase", "exposure_bp", "risk_flag",
    "quote", "quote_hash", "page", "observed_date", "extraction_confidence", "model_version", "prompt_version", "created_at",
]
DECISION_COLUMNS = ["reviewed_at", "reviewed_by", "verification_tier", "exclusion_reason", "review_state", "review_note", "decision_method"]


def immutability_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """claim_id and rule, a row for each rule that a claim breaks between two snapshots: deleted, changed in substance,
    relinked, reactivated, decided anew, put back to pending, with its note changed, or decided without a reviewer.

    Columns that neither snapshot has are left out of the comparison; one that only one of them has is null in the other.
    """
    every = ["superseded_by", "lifecycle_state", *SUBSTANCE_COLUMNS, *DECISION_COLUMNS]
    side = lambda df, p: df.select("claim_id", *[(F.col(c) if c in df.columns else F.lit(None)).alias(f"{p}_{c}") for c in every], F.lit(True).alias(f"{p}_here"))
    both = side(before, "old").join(side(after, "new"), "claim_id", "full").filter("old_here")
    old, new = (lambda c: F.col(f"old_{c}")), (lambda c: F.col(f"new_{c}"))
    moved = lambda *columns: reduce(lambda a, b: a | b, [~old(c).eqNullSafe(new(c)) for c in columns])
    decided = (old("verification_tier") == "machine_validated") & (new("verification_tier") != "machine_validated")
    rules = {
        "substance_changed": moved(*SUBSTANCE_COLUMNS),
        "link_changed": old("superseded_by").isNotNull() & moved("superseded_by"),
        "reactivated": (old("lifecycle_state") == "superseded") & moved("lifecycle_state"),
        "final_tier_changed": (old("verification_tier") != "machine_validated") & moved("verification_tier"),
        "review_changed": old("reviewed_at").isNotNull() & moved(*DECISION_COLUMNS),
        "second_look_undone": (old("review_state") == "needs_second_look") & ~F.coalesce(new("review_state").isin("needs_second_look", "decided"), F.lit(False)),
        "note_changed": old("review_note").isNotNull() & moved("review_note"),
        "decided_without_reviewer": decided & (new("reviewed_at").isNull() | new("reviewed_by").isNull() | new("decision_method").isNull()),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))
    return both.select("claim_id", F.explode(F.when(F.col("new_here").isNull(), F.array(F.lit("deleted"))).otherwise(broken)).alias("rule"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other has fewer times, with the side."""
    both = a.select("*", F.lit(1).alias("_n")).union(b.select("*", F.lit(-1).alias("_n")))
    apart = both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("_n").alias("_n")).filter("_n != 0")
    side = F.when(F.col("_n") > 0, "left").otherwise("right")
    return apart.select(*[F.col(f"`{c}`") for c in a.columns], F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("side"))


def import_parity(nodes: DataFrame, edges: DataFrame, entities_of: DataFrame, claims: DataFrame) -> DataFrame:
    """graph_id, nodes, edges, entities, claims, same_quotes: a graph and what the ledger holds of it."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("graph_id")).agg(F.count("*").alias(name))
    apart = multiset_difference(edges.select("graph_id", "quote"), claims.select(F.col("doc_id").alias("graph_id"), "quote")).select("graph_id").distinct().withColumn("apart", F.lit(True))
    out = count(nodes, "graph_id", "nodes").join(count(edges, "graph_id", "edges"), "graph_id", "full").join(entities_of.groupBy("graph_id").agg(F.count_distinct("entity_id").alias("entities")), "graph_id", "full").join(count(claims, "doc_id", "claims"), "graph_id", "full").join(apart, "graph_id", "left")
    return out.fillna(0, ["nodes", "edges", "entities", "claims"]).withColumn("same_quotes", F.col("apart").isNull()).drop("apart")


def graph_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    return multiset_difference(a, b)


def resolution_parity(claims_with_ends: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claims whose resolved ends are not what a resolver of another kind gives."""
    out = claims_with_ends
    for end in ("source", "target"):
        out = out.join(resolved.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("resolved_id").alias(f"{end}_again")), f"{end}_entity_id", "left")
    return out.filter("source_resolved != coalesce(source_again, source_entity_id) OR target_resolved != coalesce(target_again, target_entity_id)").select("claim_id")


def graph_file_integrity(repaired: dict[str, DataFrame]) -> DataFrame:
    """Findings of graph files: ends that no repair helps are blocking, the rest are warnings."""
    rows = [("drops", "blocking"), ("duplicates", "blocking"), ("repairs", "warning"), ("unlinked", "warning")]
    parts = [repaired[k].groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", F.lit(k).alias("finding"), F.lit(level).alias("level"), "n") for k, level in rows]
    return reduce(DataFrame.unionByName, parts)
