"""Evaluation of extracted relationships against curated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def relationship_metrics(golden: DataFrame, returned: DataFrame, by_type: bool = False) -> DataFrame:
    """True and false positives and false negatives of each document, by sets of identities, with precision and recall
    (null without a denominator)."""
    key = ["doc_id", "relation_type", "identity"]
    both = golden.select(*key).distinct().withColumn("g", F.lit(1)).join(returned.select(*key).distinct().withColumn("r", F.lit(1)), key, "full")
    hit, more, less = (F.count_if(c) for c in (F.col("g").isNotNull() & F.col("r").isNotNull(), F.col("g").isNull(), F.col("r").isNull()))
    rows = both.groupBy("doc_id", *["relation_type"] * by_type).agg(hit.alias("tp"), more.alias("fp"), less.alias("fn"))
    return rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def micro_aggregate(metrics: DataFrame, *keys: str) -> DataFrame:
    """Sums over documents, then precision and recall of the sums."""
    rows = metrics.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def run_summary(docs: DataFrame) -> DataFrame:
    """One row for each run of document results (run_id, error, tp, fp, fn, candidates, accepted, latency_ms, cost): errors
    are counted apart, the cost is null if any document's is."""
    good = F.col("error").isNull()
    when = lambda c: F.when(good, F.col(c))
    rows = docs.groupBy("run_id").agg(F.count_if(good).alias("documents"), F.count_if(~good).alias("failed"), *[F.sum(when(c)).alias(c) for c in ("tp", "fp", "fn")], (F.sum(when("candidates")) - F.sum(when("accepted"))).alias("validation_loss"), F.max(when("latency_ms")).alias("latency_max"), F.sum(when("latency_ms")).alias("latency_sum"), F.when(F.coalesce(F.bool_or(good & F.col("cost").isNull()), F.lit(False)), None).otherwise(F.sum(when("cost"))).alias("cost"))
    return rows.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, identity, change: relationships gained and lost between two runs."""
    key = ["doc_id", "identity"]
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("gained")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("lost")))


def recall_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Relation types whose recall fell."""
    a = before.select("relation_type", F.col("recall").alias("recall_before"))
    return a.join(after.select("relation_type", F.col("recall").alias("recall_after")), "relation_type").filter("recall_after < recall_before")


#: So many edges of group structure seen, and more, are heavy.
MOST_STRUCTURE = 5


def batch_summary(documents: DataFrame, claims: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, claims, excluded and markers of documents (doc_id, doc_type, near_ceiling, structure_seen) that want a look:
    a rationale of fewer than three claims is thin; an answer may be near its ceiling; structure is heavy if more than five
    such edges were seen, some were returned, and no customer, supplier or lender."""
    own = claims.groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(F.col("verification_tier") == "excluded").alias("excluded"))
    rows = documents.select("doc_id", "doc_type", "near_ceiling", "structure_seen").join(own, "doc_id", "left").fillna(0, ["claims", "excluded"]).join(counts.withColumnRenamed("graph_id", "doc_id"), "doc_id", "left")
    structure = F.col("subsidiary") + F.col("group_company")
    heavy = (structure > 0) & (F.col("structure_seen") > MOST_STRUCTURE) & (F.col("customer") + F.col("supplier") + F.col("lender") == 0)
    markers = F.array_compact(F.array(F.when((F.col("doc_type") == "rating_rationale") & (F.col("claims") < 3), "thin"), F.when(F.col("near_ceiling"), "near_ceiling"), F.when(F.coalesce(heavy, F.lit(False)), "structure_heavy")))
    return rows.select("doc_id", "claims", "excluded", F.array_join(markers, ",").alias("markers"))
