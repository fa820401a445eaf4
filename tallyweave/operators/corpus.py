"""The corpus: relationships seen from both ends, and how specific an entity is across all reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..storage import ranked
from .graph import node_types_from_claims, with_ends


def specificity(n_docs: Column, df: Column) -> Column:
    """Smoothed inverse document frequency: 1 for an entity of every report, more for rarer ones, 0 for none."""
    return F.when((n_docs <= 0) | (df <= 0), 0.0).otherwise(F.log((n_docs + 1) / (df + 1)) + 1)


def corpus_relationships(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Two rows of each fact: as its source and as its target sees it."""
    rows = node_types_from_claims(facts)
    sides = []
    for own, other in (("source", "target"), ("target", "source")):
        sides.append(F.struct(F.lit(own).alias("side"), F.col(f"{own}_entity_id").alias("raw_id"), F.col(f"{own}_label").alias("entity_label"), F.col(f"{own}_type").alias("entity_type"), F.col(f"{other}_entity_id").alias("raw_counterparty"), F.col(f"{other}_label").alias("counterparty_label"), F.col(f"{other}_type").alias("counterparty_type")))
    each = rows.select("claim_id", "doc_id", "company", "published_date", "agency", "relation_type", "exposure_bp", "risk_flag", "quote", "verification_tier", F.inline(F.array(*sides)))
    ids = resolved.select("entity_id", "resolved_id")
    each = each.join(ids.select(F.col("entity_id").alias("raw_id"), F.col("resolved_id").alias("entity_id")), "raw_id").join(ids.select(F.col("entity_id").alias("raw_counterparty"), F.col("resolved_id").alias("counterparty_id")), "raw_counterparty")
    return each.withColumn("perspective", exprs.perspective(F.col("entity_type"), F.col("counterparty_type"), F.col("counterparty_label"), F.col("company")))


def corpus_entities(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Each entity's reports and its specificity; entities without a claim have zero of both."""
    n = relationships.agg(F.count_distinct("doc_id").alias("n_docs"))
    df = relationships.groupBy("entity_id").agg(F.count_distinct("doc_id").alias("report_count"))
    rows = entities.select("entity_id", F.col("canonical_name").alias("label")).join(df, "entity_id", "left").fillna(0, ["report_count"])
    return rows.join(F.broadcast(n)).select("entity_id", "label", "report_count", specificity(F.col("n_docs"), F.col("report_count")).alias("specificity"))


def relationship_specificity(relationships: DataFrame, scored: DataFrame) -> DataFrame:
    own = scored.select("entity_id", F.col("specificity").alias("entity_specificity"))
    other = scored.select(F.col("entity_id").alias("counterparty_id"), F.col("specificity").alias("counterparty_specificity"))
    return relationships.join(own, "entity_id", "left").join(other, "counterparty_id", "left")


def entity_profile(labels: DataFrame, lookup: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships of the entities that labels name."""
    ids = labels.select("label", exprs.name_key(F.col("label")).alias("key")).join(lookup, "key")
    return ids.join(relationships, "entity_id")


def graph_entity_relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each node, with the other end as counterparty; an edge to itself is one row."""
    rows = with_ends(nodes, edges)
    cols = ["graph_id", "edge_no", "relation", "exposure_bp", "risk_flag", "quote"]
    out = rows.select(*cols, F.col("source").alias("node_id"), F.col("target").alias("counterparty_id"), F.col("target_label").alias("counterparty_label"))
    back = rows.filter("source != target").select(*cols, F.col("target").alias("node_id"), F.col("source").alias("counterparty_id"), F.col("source_label").alias("counterparty_label"))
    return out.unionByName(back)


def other_report_relationships(relationships: DataFrame, company: Column, date: Column, agency: Column) -> DataFrame:
    """Relationships of other reports than the active one; null counts as a value."""
    same = F.col("company").eqNullSafe(company) & F.col("published_date").eqNullSafe(date) & F.col("agency").eqNullSafe(agency)
    return relationships.filter(~same)


def session_relationships(committed: DataFrame, session: DataFrame) -> DataFrame:
    """Relationships of both, the committed ones first; of equal ones (company, date, ends, quote) the first stays."""
    both = committed.withColumn("source_rank", F.lit(0)).unionByName(session.withColumn("source_rank", F.lit(1)))
    order = Window.partitionBy("company", "published_date", "entity_id", "counterparty_id", "quote").orderBy("source_rank", "claim_id", "side")
    return both.withColumn("copy", F.row_number().over(order)).filter("copy = 1").drop("copy", "source_rank")


def node_specificity(nodes: DataFrame, lookup: DataFrame, scored: DataFrame) -> DataFrame:
    """Specificity of graph nodes by the entity that their label names, 0 where there is none."""
    ids = nodes.withColumn("key", exprs.name_key(F.col("label"))).join(lookup, "key", "left").join(scored.select("entity_id", "specificity"), "entity_id", "left")
    return ids.select("graph_id", "node_id", F.coalesce("specificity", F.lit(0.0)).alias("specificity"))


def rank_by_specificity(relationships: DataFrame) -> DataFrame:
    """Place of each relationship among its entity's: rare counterparties first, then newer reports, names, relations. An
    entity with very many relationships is ranked in ranges, by several tasks."""
    order = [F.desc("counterparty_specificity"), F.desc("published_date"), *map(F.col, ("counterparty_label", "relation_type", "claim_id", "side"))]
    return ranked(relationships, ["entity_id"], order, "by-specificity").withColumn("place", F.col("place") + 1)


def report_sketches(relationships: DataFrame, precision: int = 14) -> DataFrame:
    """Each entity's reports of a batch of relationships as a mergeable sketch; ``precision`` 14 errs by about 1 %."""
    return relationships.groupBy("entity_id").agg(F.hll_sketch_agg("doc_id", F.lit(precision)).alias("sketch"))


def merge_sketches(*batches: DataFrame) -> DataFrame:
    """Sketches of several batches as one; a batch that comes twice changes nothing."""
    every = batches[0]
    for more in batches[1:]:
        every = every.unionByName(more)
    return every.groupBy("entity_id").agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_entities(sketches: DataFrame, entities: DataFrame, n_docs: int) -> DataFrame:
    """``corpus_entities`` from kept sketches: an estimate of each entity's reports, and its specificity."""
    rows = entities.select("entity_id", F.col("canonical_name").alias("label")).join(sketches.select("entity_id", F.hll_sketch_estimate("sketch").alias("report_count")), "entity_id", "left").fillna(0, ["report_count"])
    return rows.withColumn("specificity", specificity(F.lit(n_docs), F.col("report_count")))
