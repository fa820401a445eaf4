"""The ledger as a projection of the given tables, by DataFrame operations, and the same as SQL for the oracles.

Suppliers are companies, a supplier's year is a document, its best customers of the year are claims. Money is in whole
cents and percentages are floored basis points, so any engine gets the same numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written

#: Entities of companies have ids above those of customers.
COMPANY_ENTITY = 10_000_000

#: Bits of a day (years 1 to 9999 fit, 0 is null), the day number 0 among them, and the number of a null supplier.
DAY_BITS, DAY_ZERO, NO_SUPPLIER = 22, 1 << 20, -1 << 41


def supplier_day(supplier: Column, day: Column) -> Column:
    """A supplier and a day as one number, so that a row of sales has one column less to be shuffled."""
    number = F.coalesce(supplier.cast("long"), F.lit(NO_SUPPLIER))
    fits = (number > NO_SUPPLIER) & (number < -NO_SUPPLIER) | supplier.isNull()
    whole = F.shiftleft(number, DAY_BITS) + F.coalesce(F.unix_date(day) + F.lit(DAY_ZERO), F.lit(0))
    return F.when(fits, whole).otherwise(F.raise_error(F.lit("suppliers of 2**41 or more do not fit")).cast("long"))


def supplier_of(both: Column) -> Column:
    number = F.shiftright(both, DAY_BITS)
    return F.when(number != NO_SUPPLIER, number)


def day_of(both: Column) -> Column:
    number = both.bitwiseAND(F.lit((1 << DAY_BITS) - 1))
    return F.when(number != 0, F.date_from_unix_date((number - DAY_ZERO).cast("int")))


@dataclass
class Ledger:
    """Tables of the ledger, each built when it is asked for."""

    spark: SparkSession
    folder: str
    #: Whether the sales behind documents and claims are joined once and written, for queries that read them many times.
    once: bool = True

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), F.lower(F.regexp_replace("s_name", "#", "-")).alias("slug"))

    @cached_property
    def ranked(self) -> DataFrame:
        """The six best customers of each supplier and year; a year lies in one partition from its sums on."""
        cents, both = F.round(F.col("l_extendedprice") * 100).cast("long"), supplier_day(F.col("l_suppkey"), F.col("l_shipdate").cast("date"))
        lines = self.table("lineitem").select("l_orderkey", both.alias("both"), cents.alias("cents"))
        sold = lines.join(self.table("orders").select("o_orderkey", F.col("o_custkey").alias("cust")), F.col("l_orderkey") == F.col("o_orderkey")).select("both", "cust", "cents")
        # both shuffles carry the supplier and the day as one number, and neither the year, which the day gives
        company, ship = supplier_of(F.col("both")), day_of(F.col("both"))
        dealt = sold.repartition(company, F.year(ship)).select(company.alias("company_id"), F.year(ship).alias("yr"), "cust", "cents", ship.alias("ship"))
        by_year = dealt.groupBy("company_id", "yr", "cust").agg(F.sum("cents").alias("cents"), F.max("ship").alias("last_ship"))
        year = Window.partitionBy("company_id", "yr")
        rows = by_year.withColumn("rn", F.row_number().over(year.orderBy(F.desc("cents"), "cust"))).withColumn("total", F.sum("cents").over(year)).withColumn("last_of_year", F.max("last_ship").over(year)).filter("rn <= 6")
        return written(rows, "sales") if self.once else rows

    @cached_property
    def documents(self) -> DataFrame:
        first = self.ranked.filter("rn = 1")
        kind = F.pmod(F.col("company_id") + F.col("yr"), F.lit(7))
        agency = F.pmod("company_id", F.lit(5))
        doc_id = F.col("company_id") * 10000 + F.col("yr")
        return first.select(
            doc_id.alias("doc_id"), "company_id", "yr", F.col("last_of_year").alias("published_date"),
            F.when(kind == 0, "ready_for_review").when(kind == 1, "failed").otherwise("published").alias("status"),
            F.when(agency == 0, "CRISIL").when(agency == 1, "ICRA").when(agency == 2, "CARE").when(agency == 3, "India Ratings").otherwise("Other").alias("agency"),
            F.concat(F.lit("Report "), doc_id.cast("string")).alias("title"),
            F.when(F.pmod(doc_id, F.lit(3)) == 0, doc_id * 7).alias("next_attempt"), F.pmod(doc_id, F.lit(9)).alias("attempts"),
        )

    @cached_property
    def claims(self) -> DataFrame:
        cust = F.pmod("cust", F.lit(7))
        relation = F.when(cust == 0, "customer").when(cust == 1, "supplier").when(cust == 2, "lender").when(cust == 3, "subsidiary").when(cust == 4, "parent").when(cust == 5, "group_company").otherwise("unnamed_dependency")
        tier = F.pmod(F.col("cust") + F.col("yr"), F.lit(5))
        doc_id = F.col("company_id") * 10000 + F.col("yr")
        return self.ranked.select(
            (doc_id * 10 + F.col("rn")).alias("claim_id"), doc_id.alias("doc_id"), "company_id", (F.col("company_id") + COMPANY_ENTITY).alias("source_entity_id"), F.col("cust").alias("target_entity_id"), "rn",
            relation.alias("relation_type"), F.when(F.col("rn") <= 4, F.floor(F.col("cents") * 10000 / F.col("total")).cast("long")).alias("exposure_bp"),
            F.when(F.col("rn") == 1, "high").when(F.col("rn") == 2, "medium").when(F.col("rn") == 3, "low").alias("risk_flag"),
            F.when(tier == 0, "excluded").when(tier <= 2, "machine_validated").otherwise("human_verified").alias("verification_tier"),
            F.concat(F.lit("quote "), F.pmod(F.col("cust"), F.lit(11)).cast("string")).alias("quote"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        customers = self.table("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"), F.lit(None).cast("long").alias("company_id"), F.when(F.pmod("c_custkey", F.lit(13)) == 0, "unnamed").otherwise("company").alias("entity_type"))
        return customers.unionByName(self.companies.select((F.col("company_id") + COMPANY_ENTITY).alias("entity_id"), F.col("name").alias("canonical_name"), "company_id", F.lit("company").alias("entity_type")))

    @cached_property
    def merges(self) -> DataFrame:
        """from_id, into_id, reverted: chains, reverted ones, cycles and branches."""
        c = F.col("c_custkey")
        ten, hundred = F.pmod(c, F.lit(10)), F.pmod(c, F.lit(100))
        rules = [(ten == 3, -1, 0), (ten == 2, -2, 0), (ten == 7, -7, 1), (hundred == 55, 1, 0), (hundred == 56, -1, 0), (hundred == 84, -4, 0), (hundred == 84, -3, 0)]
        each = F.array(*[F.when(when, F.struct(c.alias("from_id"), (c + step).alias("into_id"), F.lit(reverted).alias("reverted"))) for when, step, reverted in rules])
        return self.table("customer").select(F.inline(F.filter(each, lambda x: x.isNotNull())))

    @cached_property
    def aliases(self) -> DataFrame:
        """entity_id, raw_name, doc_id: names that documents use; some have two."""
        one = self.claims.filter("(target_entity_id + doc_id) % 4 = 0").select(F.col("target_entity_id").alias("entity_id"), "doc_id")
        names = F.when(F.col("entity_id") % 8 == 0, F.array(F.lit("Alpha "), F.lit("Beta "))).otherwise(F.array(F.lit("Alpha ")))
        return one.distinct().withColumn("prefix", F.explode(names)).select("entity_id", F.concat("prefix", F.col("entity_id").cast("string"), F.lit(" Ltd")).alias("raw_name"), "doc_id")

    @cached_property
    def graph_nodes(self) -> DataFrame:
        """graph_id, node_id, label, type, named: each document's company and its claims' customers."""
        c = F.col("target_entity_id")
        kind = F.when(F.pmod(c, F.lit(19)) == 0, "target").when(F.pmod(c, F.lit(17)) == 0, "industry").otherwise(F.col("relation_type"))
        others = self.claims.join(self.entities.select(F.col("entity_id").alias("target_entity_id"), "canonical_name"), "target_entity_id").select(F.col("doc_id").alias("graph_id"), F.concat(F.lit("N"), c.cast("string")).alias("node_id"), F.col("canonical_name").alias("label"), kind.alias("type"), (F.pmod(c, F.lit(13)) != 0).alias("named"), F.col("rn").alias("node_no"))
        own = self.documents.join(self.companies, "company_id").select(F.col("doc_id").alias("graph_id"), F.lit("T").alias("node_id"), F.col("name").alias("label"), F.lit("target").alias("type"), F.lit(True).alias("named"), F.lit(0).alias("node_no"))
        return own.unionByName(others)

    @cached_property
    def graph_edges(self) -> DataFrame:
        """graph_id, edge_no, source, target, relation, exposure_bp, risk_flag, quote, confidence: one of each claim."""
        other, swap = F.concat(F.lit("N"), F.col("target_entity_id").cast("string")), F.pmod("target_entity_id", F.lit(2)) == 0
        return self.claims.select(F.col("doc_id").alias("graph_id"), F.col("rn").alias("edge_no"), F.when(swap, other).otherwise("T").alias("source"), F.when(swap, "T").otherwise(other).alias("target"), F.concat(F.lit("rel "), "relation_type").alias("relation"), "exposure_bp", "risk_flag", "quote", F.when(F.pmod("target_entity_id", F.lit(3)) == 0, "high").otherwise("medium").alias("confidence"))

    @cached_property
    def texts(self) -> DataFrame:
        """doc_id, text of the documents table."""
        return self.table("documents").select("doc_id", "text")

    @cached_property
    def quotes(self) -> DataFrame:
        """doc_id, text, quote: a piece of each text; every third one is damaged."""
        piece = F.expr("substring(text, cast(1 + doc_id % 40 as int), 80)")
        return self.texts.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("zz "), piece)).otherwise(piece).alias("quote"))


#: The same tables for DuckDB: a chain of WITH, to go before a SELECT or more of WITH.
LEDGER_SQL = """
rev AS (
  SELECT l_suppkey AS company_id, year(l_shipdate) AS yr, o_custkey AS cust,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, max(l_shipdate) AS last_ship
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id, yr ORDER BY cents DESC, cust) AS rn FROM rev),
companies AS (SELECT s_suppkey AS company_id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug FROM supplier),
led_documents AS (
  SELECT company_id * 10000 + yr AS doc_id, company_id, yr, CAST(max(last_ship) AS DATE) AS published_date,
         CASE (company_id + yr) % 7 WHEN 0 THEN 'ready_for_review' WHEN 1 THEN 'failed' ELSE 'published' END AS status,
         CASE company_id % 5 WHEN 0 THEN 'CRISIL' WHEN 1 THEN 'ICRA' WHEN 2 THEN 'CARE' WHEN 3 THEN 'India Ratings' ELSE 'Other' END AS agency,
         'Report ' || CAST(company_id * 10000 + yr AS VARCHAR) AS title,
         CASE WHEN (company_id * 10000 + yr) % 3 = 0 THEN (company_id * 10000 + yr) * 7 END AS next_attempt,
         (company_id * 10000 + yr) % 9 AS attempts
  FROM ranked GROUP BY company_id, yr),
claims AS (
  SELECT * EXCLUDE (cents, cust, yr) FROM (
  SELECT (company_id * 10000 + yr) * 10 + rn AS claim_id, company_id * 10000 + yr AS doc_id, company_id, cust, yr, cents,
         10000000 + company_id AS source_entity_id, cust AS target_entity_id, rn,
         CASE cust % 7 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' WHEN 2 THEN 'lender' WHEN 3 THEN 'subsidiary'
              WHEN 4 THEN 'parent' WHEN 5 THEN 'group_company' ELSE 'unnamed_dependency' END AS relation_type,
         CASE WHEN rn <= 4 THEN CAST(floor(cents * 10000 / sum(cents) OVER (PARTITION BY company_id, yr)) AS BIGINT) END AS exposure_bp,
         CASE WHEN rn = 1 THEN 'high' WHEN rn = 2 THEN 'medium' WHEN rn = 3 THEN 'low' END AS risk_flag,
         CASE (cust + yr) % 5 WHEN 0 THEN 'excluded' WHEN 1 THEN 'machine_validated' WHEN 2 THEN 'machine_validated' ELSE 'human_verified' END AS verification_tier,
         'quote ' || CAST(cust % 11 AS VARCHAR) AS quote
  FROM ranked) WHERE rn <= 6),
entities AS (
  SELECT c_custkey AS entity_id, c_name AS canonical_name, CAST(NULL AS BIGINT) AS company_id, CASE WHEN c_custkey % 13 = 0 THEN 'unnamed' ELSE 'company' END AS entity_type FROM customer
  UNION ALL SELECT 10000000 + company_id, name, company_id, 'company' FROM companies),
merges AS (
  SELECT c_custkey AS from_id, c_custkey - 1 AS into_id, 0 AS reverted FROM customer WHERE c_custkey % 10 = 3
  UNION ALL SELECT c_custkey, c_custkey - 2, 0 FROM customer WHERE c_custkey % 10 = 2
  UNION ALL SELECT c_custkey, c_custkey - 7, 1 FROM customer WHERE c_custkey % 10 = 7
  UNION ALL SELECT c_custkey, c_custkey + 1, 0 FROM customer WHERE c_custkey % 100 = 55
  UNION ALL SELECT c_custkey, c_custkey - 1, 0 FROM customer WHERE c_custkey % 100 = 56
  UNION ALL SELECT c_custkey, c_custkey - 4, 0 FROM customer WHERE c_custkey % 100 = 84
  UNION ALL SELECT c_custkey, c_custkey - 3, 0 FROM customer WHERE c_custkey % 100 = 84),
aliases AS (
  SELECT entity_id, prefix || CAST(entity_id AS VARCHAR) || ' Ltd' AS raw_name, doc_id
  FROM (SELECT DISTINCT target_entity_id AS entity_id, doc_id FROM claims WHERE (target_entity_id + doc_id) % 4 = 0)
  JOIN (SELECT 'Alpha ' AS prefix, 8 AS every UNION ALL SELECT 'Beta ', 0) ON every = 8 OR entity_id % 8 = 0)"""

GRAPH_SQL = """
graph_nodes AS (
  SELECT doc_id AS graph_id, 'T' AS node_id, name AS label, 'target' AS type, true AS named, 0 AS node_no FROM led_documents JOIN companies USING (company_id)
  UNION ALL
  SELECT doc_id, 'N' || CAST(target_entity_id AS VARCHAR), canonical_name,
         CASE WHEN target_entity_id % 19 = 0 THEN 'target' WHEN target_entity_id % 17 = 0 THEN 'industry' ELSE relation_type END, target_entity_id % 13 <> 0, rn
  FROM claims JOIN entities ON entity_id = target_entity_id),
graph_edges AS (
  SELECT doc_id AS graph_id, rn AS edge_no,
         CASE WHEN target_entity_id % 2 = 0 THEN 'N' || CAST(target_entity_id AS VARCHAR) ELSE 'T' END AS source,
         CASE WHEN target_entity_id % 2 = 0 THEN 'T' ELSE 'N' || CAST(target_entity_id AS VARCHAR) END AS target,
         'rel ' || relation_type AS relation, exposure_bp, risk_flag, quote, CASE WHEN target_entity_id % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence
  FROM claims),
ends AS (
  SELECT e.*, s.type AS source_type, s.named AS source_named, s.label AS source_label, t.type AS target_type, t.named AS target_named, t.label AS target_label
  FROM graph_edges e JOIN graph_nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source JOIN graph_nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target),
typed AS (
  SELECT *, CASE WHEN NOT source_named OR NOT target_named OR source_type = 'industry' OR target_type = 'industry' THEN 'unnamed_dependency'
    WHEN (source_type = 'target') <> (target_type = 'target') THEN
      CASE WHEN (CASE WHEN source_type = 'target' THEN target_type ELSE source_type END) IN ('customer','supplier','lender','subsidiary','parent','group_company') THEN CASE WHEN source_type = 'target' THEN target_type ELSE source_type END END
    WHEN target_type IN ('customer','supplier','lender','subsidiary','parent','group_company') THEN target_type
    WHEN source_type IN ('customer','supplier','lender','subsidiary','parent','group_company') THEN source_type END AS relation_type,
    source <> target AND source_type = 'target' AND target_type = 'target' AS malformed
  FROM ends)"""

#: Terminal entity of each merge source: the longest simple path over active merges, then the smallest id.
RESOLVED_SQL = """
active AS (SELECT from_id, into_id FROM merges WHERE reverted = 0),
walk AS (
  SELECT from_id AS origin, into_id AS node, [from_id, into_id] AS path, from_id = into_id AS cyc FROM active
  UNION ALL
  SELECT w.origin, m.into_id, list_append(w.path, m.into_id), list_contains(w.path, m.into_id)
  FROM walk w JOIN active m ON m.from_id = w.node WHERE NOT w.cyc),
terminal AS (
  SELECT origin, node FROM (
    SELECT origin, node, row_number() OVER (PARTITION BY origin ORDER BY len(path) DESC, node) AS n FROM walk w
    WHERE cyc OR NOT EXISTS (SELECT 1 FROM active m WHERE m.from_id = w.node)) WHERE n = 1),
resolved AS (SELECT e.entity_id, coalesce(t.node, e.entity_id) AS resolved_id FROM entities e LEFT JOIN terminal t ON t.origin = e.entity_id)"""


def with_ledger(sql: str, *more: str) -> str:
    """An oracle over the ledger's tables."""
    return "WITH RECURSIVE " + ",".join([LEDGER_SQL, *more]) + "\n" + sql
