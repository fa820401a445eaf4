"""Relationship graphs: nodes (graph_id, node_id, label, type, named, node_no) and edges (graph_id, edge_no, source, target,
relation, exposure_bp, risk_flag, quote, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab

COUNTED = vocab.RELATION_TYPES
MAPPABLE = [t for t in vocab.RELATION_TYPES if t != "unnamed_dependency"]
#: Subsidiary and group-company edges that a graph keeps.
STRUCTURE_CAP = 5


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with label, type and named of both ends; null where an end is unknown."""
    for end in ("source", "target"):
        own = nodes.select("graph_id", F.col("node_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("label", "type", "named")])
        edges = edges.join(own, ["graph_id", end], "left")
    return edges


def typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with relation_type (null: none fits) and malformed (between two distinct targets)."""
    rows = with_ends(nodes, edges)
    unnamed = ~F.coalesce("source_named", F.lit(True)) | ~F.coalesce("target_named", F.lit(True)) | (F.col("source_type") == "industry") | (F.col("target_type") == "industry")
    from_target, to_target = F.col("source_type") == "target", F.col("target_type") == "target"
    other = F.when(from_target, F.col("target_type")).otherwise(F.col("source_type"))
    known = lambda c: F.when(c.isin(MAPPABLE), c)
    relation = F.when(unnamed, "unnamed_dependency").when(from_target != to_target, known(other)).otherwise(F.coalesce(known(F.col("target_type")), known(F.col("source_type"))))
    return rows.withColumns({"relation_type": relation, "malformed": (F.col("source") != F.col("target")) & from_target & to_target})


def relation_type_of_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their relation type, and those that have none."""
    rows = typed_edges(nodes, edges)
    return rows.filter("relation_type IS NOT NULL"), rows.filter("relation_type IS NULL")


def drop_malformed_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = typed_edges(nodes, edges)
    bad = F.coalesce("malformed", F.lit(False))
    return rows.filter(~bad), rows.filter(bad)


def relation_type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each graph by relation type, all seven, zero where none; malformed and unmappable edges don't count."""
    rows = typed_edges(nodes, edges).filter("NOT malformed AND relation_type IS NOT NULL")
    counts = rows.groupBy("graph_id").pivot("relation_type", COUNTED).count()
    return nodes.select("graph_id").distinct().join(counts, "graph_id", "left").fillna(0, COUNTED)


def cap_group_structure(nodes: DataFrame, edges: DataFrame, cap: int = STRUCTURE_CAP, reported: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with at most ``cap`` structure edges a graph, the most substantial ones, and a report: graph_id, total_seen,
    response_edges, capped. ``reported`` (graph_id, total): what the model says that it saw."""
    rows = typed_edges(nodes, edges)
    structure = F.coalesce(F.col("relation_type").isin(vocab.STRUCTURE_TYPES) & ~F.col("malformed"), F.lit(False))
    score = exprs.substance_score(F.col("relation"), F.col("quote"), F.col("exposure_bp"), F.col("risk_flag"), F.col("confidence"))
    place = F.row_number().over(Window.partitionBy("graph_id", "structure").orderBy(F.desc("score"), "edge_no"))
    ranked = rows.withColumns({"structure": structure, "score": score}).withColumn("place", place)
    kept = ranked.filter(~F.col("structure") | (F.col("place") <= cap)).drop("structure", "score", "place")
    counts = ranked.groupBy("graph_id").agg(F.count_if("structure").alias("response_edges"))
    if reported is not None:
        counts = counts.join(reported, "graph_id", "left")
    total = F.greatest(F.coalesce("total", F.lit(0)), "response_edges") if reported is not None else F.col("response_edges")
    return kept, counts.select("graph_id", total.alias("total_seen"), "response_edges", (F.col("response_edges") - F.least("response_edges", F.lit(cap))).alias("capped"))


def needs_second_pass(counts: DataFrame, cap: int = STRUCTURE_CAP) -> DataFrame:
    """Graphs of which more structure was seen than kept, and no dependency at all. ``counts``: relation types and,
    where known, total_seen."""
    structure = F.col("subsidiary") + F.col("group_company")
    others = F.col("customer") + F.col("supplier") + F.col("lender") + F.col("parent") + F.col("unnamed_dependency")
    seen = F.coalesce("total_seen", structure) if "total_seen" in counts.columns else structure
    return counts.withColumn("needs_second_pass", (seen > cap) & (structure > 0) & (others == 0))


def coverage_report(returned: DataFrame, kept: DataFrame, report: DataFrame) -> DataFrame:
    """Relation-type counts before and after, with what was seen and capped."""
    name = lambda df, p: df.select("graph_id", *[F.col(c).alias(f"{p}_{c}") for c in COUNTED])
    return name(returned, "returned").join(name(kept, "claimed"), "graph_id", "left").join(report, "graph_id", "left")


def repair_graph(nodes: DataFrame, edges: DataFrame, threshold: float = 0.78) -> dict[str, DataFrame]:
    """Repair graphs: nodes, edges, repairs (end, reference, node, score), drops, unlinked, duplicates.

    Of repeated node ids the first (node_no) stays. An end that is no node becomes the most similar node of its graph,
    by id or label, if that is similar enough (ties to the smaller id); else the edge goes. Nodes without edges go, but
    for targets. Only bad ends are compared with nodes.
    """
    order = Window.partitionBy("graph_id", "node_id").orderBy("node_no")
    numbered = nodes.withColumn("copy", F.row_number().over(order))
    own, duplicates = numbered.filter("copy = 1").drop("copy"), numbered.filter("copy > 1").drop("copy")
    refs = edges.select("graph_id", F.explode(F.array("source", "target")).alias("reference")).distinct()
    bad = refs.join(own.select("graph_id", F.col("node_id").alias("reference")), ["graph_id", "reference"], "left_anti")
    forms = own.select("graph_id", "node_id", exprs.reference_form(F.col("node_id")).alias("id_form"), exprs.reference_form(F.col("label")).alias("label_form"))
    near = bad.withColumn("form", exprs.reference_form(F.col("reference"))).join(forms, "graph_id")
    scored = near.withColumn("score", F.greatest(exprs.similarity(F.col("form"), F.col("id_form")), exprs.similarity(F.col("form"), F.col("label_form"))))
    best = scored.groupBy("graph_id", "reference").agg(F.min(F.struct((-F.col("score")).alias("minus"), "node_id")).alias("b"))
    repairs = best.select("graph_id", "reference", F.col("b.node_id").alias("node_id"), (-F.col("b.minus")).alias("score")).filter(F.col("score") >= threshold)
    fixed = edges
    for end in ("source", "target"):
        good = own.select("graph_id", F.col("node_id").alias(end), F.lit(True).alias(f"{end}_known"))
        mend = repairs.select("graph_id", F.col("reference").alias(end), F.col("node_id").alias(f"{end}_mend"))
        fixed = fixed.join(good, ["graph_id", end], "left").join(mend, ["graph_id", end], "left").withColumn(f"{end}_new", F.when(F.col(f"{end}_known"), F.col(end)).otherwise(F.col(f"{end}_mend")))
    whole = F.col("source_new").isNotNull() & F.col("target_new").isNotNull()
    kept = fixed.filter(whole).withColumns({"source": F.col("source_new"), "target": F.col("target_new")}).select(*edges.columns)
    linked = kept.select("graph_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    lone = own.filter("type != 'target'").join(linked, ["graph_id", "node_id"], "left_anti")
    return {"nodes": own.join(lone.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti"), "edges": kept, "repairs": repairs, "drops": fixed.filter(~whole).select(*edges.columns), "unlinked": lone, "duplicates": duplicates}


def merge_extraction_passes(nodes: DataFrame, edges: DataFrame, nodes2: DataFrame, edges2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a second pass to a first. A node is the same if type, named and label (in its reference form) are; a new node
    whose id is taken gets ``-sweep-n``. Edges are the same if ends and quote form are; the first pass goes first."""
    ident = lambda df: df.withColumns({"form": exprs.reference_form(F.col("label")), "is_named": F.coalesce("named", F.lit(True))})
    key = ["graph_id", "type", "is_named", "form"]
    first = ident(nodes).groupBy(*key).agg(F.min("node_id").alias("same_id"))
    second = ident(nodes2).join(first, key, "left").join(nodes.select("graph_id", "node_id", F.lit(True).alias("taken")).distinct(), ["graph_id", "node_id"], "left")
    n = F.row_number().over(Window.partitionBy("graph_id", "clash").orderBy("node_id"))
    clash = F.col("same_id").isNull() & F.coalesce("taken", F.lit(False))
    mapped = second.withColumn("clash", clash).withColumn("n", n).withColumn("new_id", F.when(F.col("clash"), F.concat(F.col("node_id"), F.lit("-sweep-"), F.col("n").cast("string"))).otherwise(F.coalesce("same_id", "node_id")))
    ids = mapped.select("graph_id", "node_id", "new_id")
    added = mapped.filter("same_id IS NULL").withColumn("node_id", F.col("new_id")).select(*nodes.columns)
    moved = edges2
    for end in ("source", "target"):
        moved = moved.join(ids.select("graph_id", F.col("node_id").alias(end), F.col("new_id").alias(f"{end}_new")), ["graph_id", end], "left").withColumn(end, F.coalesce(f"{end}_new", end)).drop(f"{end}_new")
    both = edges.withColumn("pass", F.lit(1)).unionByName(moved.select(*edges.columns).withColumn("pass", F.lit(2))).withColumn("form", exprs.quote_form(F.col("quote")))
    first_of = F.row_number().over(Window.partitionBy("graph_id", "source", "target", "form").orderBy("pass", "edge_no"))
    return nodes.unionByName(added), both.withColumn("copy", first_of).filter("copy = 1").drop("copy", "form", "pass")


def exclusion_disclosure(nodes: DataFrame, rejected: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Labels of nodes that lost evidence, with the reason: a quote that isn't there outranks an end that isn't."""
    rows = rejected.select("graph_id", "source", "target", F.lit("quote_not_verified").alias("reason"), F.lit(0).alias("rank")).unionAll(unresolved.select("graph_id", "source", "target", F.lit("unresolved_endpoint"), F.lit(1)))
    ends = with_ends(nodes, rows)
    labels = [F.when(F.col(f"{e}_type") != "target", F.col(f"{e}_label")) for e in ("source", "target")]
    every = F.array_compact(F.array("source_label", "target_label"))
    chosen = F.array_compact(F.array(*labels))
    each = ends.select("graph_id", "reason", "rank", F.explode(F.when(F.size(chosen) > 0, chosen).otherwise(every)).alias("label"))
    return each.groupBy("graph_id", "label").agg(F.min_by("reason", "rank").alias("reason"))


def node_types_from_claims(facts: DataFrame) -> DataFrame:
    """Type of either end of claims, as a graph shows it."""
    for end in ("source", "target"):
        kind = F.when(F.coalesce(F.col(f"{end}_own_company") == F.col("company_id"), F.lit(False)), "target")
        if end == "target":
            kind = kind.when(F.col("relation_type").isin(MAPPABLE), F.col("relation_type"))
            label = F.col("relation_label") if "relation_label" in facts.columns else F.col("relation_type")
            words = [(rf"(?i)\b{w}s?\b", w) for w in vocab.DEPENDENCY_TYPES]
            unnamed = F.coalesce(*[F.when(label.rlike(p), w) for p, w in words], F.lit("unnamed_dependency"))
        else:
            unnamed = F.lit("unnamed_dependency")
        facts = facts.withColumn(f"{end}_type", kind.when(F.col(f"{end}_entity_type") == "unnamed", unnamed).otherwise("industry"))
    return facts


def claims_to_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and headers of the graphs that fact rows make; of several claims the first names a node."""
    rows = node_types_from_claims(facts)
    ends = [rows.select(F.col("doc_id").alias("graph_id"), F.col(f"{e}_entity_id").cast("string").alias("node_id"), F.col(f"{e}_label").alias("label"), F.col(f"{e}_type").alias("type"), (F.col(f"{e}_entity_type") != "unnamed").alias("named"), F.col("claim_id"), F.lit(k).alias("end")) for k, e in enumerate(("source", "target"))]
    both = ends[0].unionByName(ends[1])
    nodes = both.groupBy("graph_id", "node_id").agg(F.min(F.struct("claim_id", "end", "label", "type", "named")).alias("f")).select("graph_id", "node_id", "f.label", "f.type", "f.named")
    edges = rows.select(F.col("doc_id").alias("graph_id"), F.col("claim_id").alias("edge_no"), F.col("source_entity_id").cast("string").alias("source"), F.col("target_entity_id").cast("string").alias("target"), F.concat(F.lit("rel "), "relation_type").alias("relation"), "exposure_bp", "risk_flag", "quote")
    header = rows.groupBy(F.col("doc_id").alias("graph_id")).agg(F.first("company").alias("target_company"), F.first(F.when(F.col("agency").isin(vocab.AGENCIES), F.col("agency"))).alias("agency"), F.first("published_date").alias("report_date"), F.count("*").alias("edges"))
    return nodes, edges, header
