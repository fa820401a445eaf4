"""Graph files: read, validate, key by content, and import into the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab

NODE = "struct<id: string, label: string, type: string, named: boolean>"
EDGE = "struct<source: string, target: string, relation: string, exposure_pct: double, risk_flag: string, source_quote: string, source_page: int, confidence: string>"
GRAPH = f"target_company string, rating string, report_date string, agency string, verified boolean, nodes array<{NODE}>, edges array<{EDGE}>, key_risks array<string>, relationship_summary struct<group_structure_total_seen: int>, _corrupt_record string"


def read_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each JSON file of a folder and the folders in it: graph_id and the graph. The id is the name of the file
    without .json, or what follows ``graph_id=`` in the name of its folder."""
    reader = spark.read.schema(GRAPH).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    named = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "/graph_id=([^/]+)/[^/]*$", 1), F.lit(""))
    return reader.json(folder).select(F.coalesce(named, F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")).alias("graph_id"), "*")


def write_graph_lines(graphs: DataFrame, folder: str) -> None:
    """Graphs as JSON lines, many to a file: a folder and a file for each of a million graphs would take the driver longer
    to move and to list than the graphs take to write."""
    graphs.write.json(folder)


def read_graph_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The graphs of such files, one a line, as ``read_graphs`` gives them."""
    return spark.read.schema(f"graph_id string, {GRAPH}").option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(folder)


def validate_graphs(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good graphs, and graph_id with the reasons of the others."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    ids = F.transform("nodes", lambda n: n["id"])
    off = lambda c, values: c.isNotNull() & ~c.isin(values)
    reasons = {
        "unreadable": F.col("_corrupt_record").isNotNull(), "no_company": blank(F.col("target_company")), "no_nodes": F.col("nodes").isNull() | F.col("edges").isNull() | (F.size("nodes") == 0),
        "bad_report_date": F.col("report_date").isNotNull() & exprs.report_date(F.col("report_date")).isNull(), "bad_agency": off(F.col("agency"), vocab.AGENCIES),
        "repeated_node_id": F.size(F.array_distinct(ids)) != F.size(ids), "blank_node": F.exists("nodes", lambda n: blank(n["id"]) | blank(n["label"])), "bad_node_type": F.exists("nodes", lambda n: n["type"].isNull() | ~n["type"].isin(vocab.NODE_TYPES)),
        "unknown_endpoint": F.exists("edges", lambda e: ~F.array_contains(ids, F.coalesce(e["source"], F.lit(""))) | ~F.array_contains(ids, F.coalesce(e["target"], F.lit("")))),
        "exposure_range": F.exists("edges", lambda e: e["exposure_pct"].isNotNull() & ~e["exposure_pct"].between(0, 100)), "blank_edge": F.exists("edges", lambda e: blank(e["relation"]) | blank(e["source_quote"])),
        "bad_risk_flag": F.exists("edges", lambda e: off(e["risk_flag"], vocab.RISK_FLAGS)), "bad_page": F.exists("edges", lambda e: e["source_page"].isNotNull() & (e["source_page"] <= 0)), "bad_confidence": F.exists("edges", lambda e: off(e["confidence"], vocab.CONFIDENCES)),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in reasons.items()]))
    rows = graphs.withColumn("reasons", found)
    return rows.filter(F.size("reasons") == 0).drop("reasons", "_corrupt_record"), rows.filter(F.size("reasons") > 0).select("graph_id", F.explode("reasons").alias("reason"))


def graph_content_key(graphs: DataFrame) -> DataFrame:
    """Graphs with sha256 of their content, whatever the order of keys in the file."""
    names = sorted(c for c in graphs.columns if c != "graph_id" and not c.startswith("_"))
    ordered = lambda kind, fields: lambda x: F.struct(*[x[f].alias(f) for f in sorted(fields)])
    nodes = F.transform("nodes", ordered("nodes", ["id", "label", "type", "named"]))
    edges = F.transform("edges", ordered("edges", ["source", "target", "relation", "exposure_pct", "risk_flag", "source_quote", "source_page", "confidence"]))
    columns = [nodes.alias("nodes") if c == "nodes" else edges.alias("edges") if c == "edges" else F.col(c) for c in names]
    return graphs.withColumn("sha256", F.sha2(F.to_json(F.struct(*columns)), 256))


def graph_tables(graphs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flat nodes, edges and key risks of nested graphs, with exposure in basis points."""
    nodes = graphs.select("graph_id", F.posexplode("nodes").alias("node_no", "n")).select("graph_id", F.col("n.id").alias("node_id"), "n.label", "n.type", F.coalesce("n.named", F.lit(True)).alias("named"), "node_no")
    edges = graphs.select("graph_id", F.posexplode("edges").alias("edge_no", "e")).select("graph_id", "edge_no", "e.source", "e.target", "e.relation", F.round(F.col("e.exposure_pct") * 100).cast("long").alias("exposure_bp"), "e.risk_flag", F.col("e.source_quote").alias("quote"), F.col("e.source_page").alias("page"), "e.confidence")
    risks = graphs.select("graph_id", F.posexplode("key_risks").alias("pos", "text"))
    return nodes, edges, risks


def import_graphs_to_ledger(graphs: DataFrame, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rows to append for graphs whose content (sha256) is not stored: companies, documents, entities, aliases, claims.

    Claims of curated graphs are verified and decided. Companies are one for each slug; entities one for each name key,
    but unnamed ones one for each node.
    """
    from ..operators.graph import typed_edges

    keyed = graph_content_key(graphs)
    if stored is not None:
        keyed = keyed.join(stored.select("sha256"), "sha256", "left_anti")
    keyed = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("sha256").orderBy("graph_id"))).filter("copy = 1").drop("copy")
    nodes, edges, _ = graph_tables(keyed)
    companies = keyed.groupBy("graph_id").agg(F.first("target_company").alias("name")).select(F.col("graph_id").alias("slug"), "name")
    documents = keyed.select(F.col("graph_id").alias("doc_id"), "sha256", F.col("graph_id").alias("slug"), "agency", "rating", exprs.report_date(F.col("report_date")).alias("published_date"), F.lit("published").alias("status"))
    key = F.when(F.col("named"), exprs.name_key(F.col("label"))).otherwise(F.concat_ws(":", F.lit("unnamed"), "graph_id", "node_id"))
    named = nodes.withColumn("entity_key", key)
    entities = named.groupBy("entity_key").agg(F.min(F.struct("graph_id", "node_no", "label", "named")).alias("f")).select("entity_key", F.col("f.label").alias("canonical_name"), F.when(F.col("f.named"), "company").otherwise("unnamed").alias("entity_type"))
    aliases = named.filter("named").groupBy("entity_key", "graph_id").agg(F.min("label").alias("raw_name")).withColumnRenamed("graph_id", "doc_id")
    ends = typed_edges(nodes, edges).filter("relation_type IS NOT NULL AND NOT malformed")
    for end in ("source", "target"):
        ends = ends.join(named.select("graph_id", F.col("node_id").alias(end), F.col("entity_key").alias(f"{end}_entity")), ["graph_id", end])
    claims = ends.select(F.col("graph_id").alias("doc_id"), "edge_no", "source_entity", "target_entity", "relation_type", "relation", "exposure_bp", "risk_flag", "quote", exprs.quote_hash(F.col("quote")).alias("quote_hash"), "page", F.lit("human_verified").alias("verification_tier"), F.lit("decided").alias("review_state"))
    return {"companies": companies, "documents": documents, "entities": entities, "aliases": aliases, "claims": claims}
