"""Concentration: exposure to customers, single points of failure, watch items, and the verdicts on a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs
from .graph import with_ends

#: Exposure, in basis points, from which one counterparty is a single point of failure.
SINGLE_POINT_BP = 2500


def target_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that touch the graph's first target, with the other end as counterparty (id, label, type)."""
    first = nodes.filter("type = 'target'").groupBy("graph_id").agg(F.min_by("node_id", "node_no").alias("target_id"))
    rows = with_ends(nodes, edges).join(first, "graph_id")
    out = F.col("source") == F.col("target_id")
    rows = rows.filter(out | (F.col("target") == F.col("target_id")))
    return rows.withColumns({f"counterparty_{k}": F.when(out, F.col(f"target{s}")).otherwise(F.col(f"source{s}")) for k, s in (("id", ""), ("label", "_label"), ("type", "_type"))})


def customer_concentration(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, exposure_bp (a sum over edges), customers (distinct), any_high: quantified edges to customers."""
    rows = target_edges(nodes, edges).filter("counterparty_type = 'customer' AND exposure_bp IS NOT NULL")
    return rows.groupBy("graph_id").agg(F.sum("exposure_bp").alias("exposure_bp"), F.count_distinct("counterparty_id").alias("customers"), F.bool_or(F.coalesce(F.col("risk_flag") == "high", F.lit(False))).alias("any_high"))


def single_points_of_failure(nodes: DataFrame, edges: DataFrame, specificity: DataFrame | None = None, min_bp: int = SINGLE_POINT_BP) -> DataFrame:
    """Counterparties of high risk or large exposure, the strongest edge of each, in order of place."""
    high = F.coalesce(F.col("risk_flag") == "high", F.lit(False))
    rows = target_edges(nodes, edges).filter((F.coalesce("exposure_bp", F.lit(0)) >= min_bp) | high)
    rows = rows.withColumn("score", F.when(high, 1_000_000).otherwise(F.coalesce("exposure_bp", F.lit(0))))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("graph_id", "counterparty_id").orderBy(F.desc("score"), "edge_no"))).filter("n = 1").drop("n")
    if specificity is None:
        best = best.withColumn("specificity", F.lit(0.0))
    else:
        best = best.join(specificity.select("graph_id", F.col("node_id").alias("counterparty_id"), "specificity"), ["graph_id", "counterparty_id"], "left").fillna(0.0, ["specificity"])
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("specificity"), F.desc("score"), "counterparty_label", "counterparty_id"))
    return best.select("graph_id", "counterparty_id", "counterparty_label", "edge_no", "source", "target", "relation", "quote", "exposure_bp", "risk_flag", "score", "specificity", place.alias("place"))


def watch_items(nodes: DataFrame, edges: DataFrame, key_risks: DataFrame | None = None) -> DataFrame:
    """graph_id, place, text, node_id, edge_no: key risks in order, then each unnamed node with its first edge."""
    rows = with_ends(nodes, edges)
    ghost = {e: (F.col(f"{e}_type") == "unnamed_dependency") | ~F.coalesce(f"{e}_named", F.lit(True)) for e in ("source", "target")}
    rows = rows.filter(F.coalesce(ghost["source"], F.lit(False)) | F.coalesce(ghost["target"], F.lit(False)))
    rows = rows.withColumns({"ghost": F.when(ghost["source"], F.col("source")).otherwise(F.col("target")), "ghost_label": F.when(ghost["source"], F.col("source_label")).otherwise(F.col("target_label"))})
    order = ["ghost_label", "relation", "quote", "edge_no"]
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("graph_id", "ghost").orderBy(*order))).filter("n = 1")
    ghosts = first.select("graph_id", F.lit(1).alias("kind"), F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)).alias("pos"), F.col("ghost_label").alias("text"), F.col("ghost").alias("node_id"), "edge_no", "risk_flag")
    if key_risks is not None:
        risks = key_risks.select("graph_id", F.lit(0).alias("kind"), "pos", "text", F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("int").alias("edge_no"), F.lit(None).cast("string").alias("risk_flag"))
        ghosts = risks.unionByName(ghosts)
    return ghosts.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy("kind", "pos"))).drop("kind", "pos")


def _summary(items, maximum: int = 2):
    """The first two and how many more."""
    return F.when(F.size(items) <= maximum, F.array_join(items, " · ")).otherwise(F.concat(F.array_join(F.slice(items, 1, maximum), " · "), F.lit(" · +"), (F.size(items) - maximum).cast("string"), F.lit(" more")))


def dependency_read(nodes: DataFrame, edges: DataFrame, key_risks: DataFrame | None = None, excluded: DataFrame | None = None, specificity: DataFrame | None = None) -> DataFrame:
    """One row for each graph: four lines with their tones, a headline and an overall tone."""
    percent = lambda c: exprs.percent_text(c / 100.0)
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))), lambda x: x["v"])
    many = lambda n, one, more: F.when(n == 1, one).otherwise(more)
    high = F.coalesce(F.col("risk_flag") == "high", F.lit(False))
    cust = customer_concentration(nodes, edges)
    named = F.concat("counterparty_label", F.when(F.col("exposure_bp").isNotNull(), F.concat(F.lit(" ("), percent(F.col("exposure_bp")), F.lit("%)"))).otherwise(F.lit(" (high risk)")))
    single = single_points_of_failure(nodes, edges, specificity).groupBy("graph_id").agg(ordered(named).alias("single"), F.bool_or(high).alias("single_high"))
    watch = watch_items(nodes, edges, key_risks).groupBy("graph_id").agg(ordered(F.col("text")).alias("watch"), F.bool_or(high).alias("watch_high"))
    kept = edges.groupBy("graph_id").agg(F.count("*").alias("retained"))
    rows = nodes.select("graph_id").distinct().join(kept, "graph_id", "left").fillna(0, ["retained"]).join(cust, "graph_id", "left").join(single, "graph_id", "left").join(watch, "graph_id", "left")
    rows = rows.join(excluded, "graph_id", "left") if excluded is not None else rows.withColumn("excluded", F.lit(None).cast("long"))
    amount = percent(F.col("exposure_bp"))
    has_cust, has_single, has_watch = (F.col(c).isNotNull() for c in ("customers", "single", "watch"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        "graph_id",
        F.when(has_cust, F.concat(F.lit("≥"), amount, F.lit("% explicitly quantified across "), F.col("customers").cast("string"), many(F.col("customers"), " customer", " customers"))).otherwise("No explicit customer percentage retained").alias("concentration"),
        F.when(has_cust, F.when(yes("any_high"), "high").otherwise("medium")).otherwise("low").alias("concentration_tone"),
        F.when(has_single, F.concat(F.size("single").cast("string"), many(F.size("single"), " counterparty", " counterparties"), F.lit(" · "), _summary(F.col("single")))).otherwise("No retained counterparties meet the 25% / high-risk threshold").alias("single_points"),
        F.when(has_single, F.when(yes("single_high"), "high").otherwise("medium")).otherwise("low").alias("single_points_tone"),
        F.when(has_watch, _summary(F.col("watch"))).otherwise("No unnamed or key-risk dependencies retained").alias("watch_items"),
        F.when(has_watch, F.when(yes("watch_high"), "high").otherwise("medium")).otherwise("low").alias("watch_items_tone"),
        F.concat(F.col("retained").cast("string"), many(F.col("retained"), " retained relationship", " retained relationships"), F.coalesce(F.concat(F.lit(" · "), F.col("excluded").cast("string"), F.lit(" excluded")), F.lit(""))).alias("evidence"),
        F.when(has_cust, F.concat(F.lit("≥"), amount, F.lit("% named customer exposure")))
        .when(has_single, F.concat(F.size("single").cast("string"), many(F.size("single"), " potential single point of failure", " potential single points of failure")))
        .when(has_watch, F.concat(F.size("watch").cast("string"), many(F.size("watch"), " reported dependency watch item", " reported dependency watch items")))
        .otherwise(F.concat(F.col("retained").cast("string"), F.lit(" evidence-backed relationships retained"))).alias("headline"),
        F.when(yes("single_high") | yes("any_high"), "high").when(has_cust | has_watch, "medium").otherwise("low").alias("tone"),
    )


def risk_verdict(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, tone, label. Here the counterparty is the other end of an edge from the target, else its source, even
    if the edge doesn't touch the target."""
    first = nodes.filter("type = 'target'").groupBy("graph_id").agg(F.min_by("node_id", "node_no").alias("target_id"))
    rows = with_ends(nodes, edges).join(first, "graph_id", "left")
    customer = F.when(F.col("source").eqNullSafe(F.col("target_id")), F.col("target_type")).otherwise(F.col("source_type")) == "customer"
    high = F.coalesce(F.col("risk_flag") == "high", F.lit(False))
    both = high & F.coalesce(customer, F.lit(False))
    sums = rows.groupBy("graph_id").agg(F.count_if(both).alias("n"), F.count_if(both & F.col("exposure_bp").isNotNull()).alias("q"), F.sum(F.when(both, F.col("exposure_bp"))).alias("bp"), F.count_if(high).alias("h"), F.count_if(F.col("risk_flag") == "medium").alias("m"))
    sums = nodes.select("graph_id").distinct().join(sums, "graph_id", "left").fillna(0, ["n", "q", "h", "m"])
    plural = lambda c: F.when(c == 1, " customer").otherwise(" customers")
    label = (F.when(F.col("q") > 0, F.concat(F.regexp_replace(F.format_string("%.2f", F.col("bp") / 100.0), r"\.?0+$", ""), F.lit("% of revenue concentrated in "), F.col("q").cast("string"), plural(F.col("q"))))
             .when(F.col("n") > 0, F.concat(F.lit("Material revenue dependency across "), F.col("n").cast("string"), F.lit(" named"), plural(F.col("n"))))
             .when(F.col("h") > 0, F.concat(F.col("h").cast("string"), F.lit(" high-risk counterparty relationships detected")))
             .when(F.col("m") > 0, "Moderate dependency signals found in the report").otherwise("No explicit high-risk counterparty concentration detected"))
    return sums.select("graph_id", F.when(F.col("h") > 0, "high").when(F.col("m") > 0, "medium").otherwise("low").alias("tone"), label.alias("label"))
