"""Registered queries over the ledger projection, each beside the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concentration, corpus, entities, facts, graph
from ..storage import written
from .project import GRAPH_SQL, RESOLVED_SQL, Ledger, with_ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, once: bool = True):
    """Register a function of a Ledger, with its oracle; not ``once`` if it asks for one company only, whose sales are few."""

    def add(f):
        QUERIES[name] = lambda spark, folder: f(Ledger(spark, folder, once))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


RETAINED = "verification_tier IN ('human_verified', 'machine_validated')"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY published_date DESC NULLS LAST, doc_id DESC) AS n FROM led_documents WHERE status = 'published') WHERE n = 1)"
ALIAS = "alias AS (SELECT entity_id, doc_id, min(raw_name) AS raw_name FROM aliases GROUP BY 1, 2)"
FACTS = """facts AS (
  SELECT c.*, d.published_date, d.agency, d.title, d.status, co.name AS company, co.slug,
         coalesce(sa.raw_name, s.canonical_name) AS source_label, coalesce(ta.raw_name, t.canonical_name) AS target_label,
         s.entity_type AS source_entity_type, t.entity_type AS target_entity_type, s.company_id AS source_own, t.company_id AS target_own
  FROM claims c JOIN led_documents d USING (doc_id) JOIN companies co ON co.company_id = c.company_id
  JOIN entities s ON s.entity_id = c.source_entity_id JOIN entities t ON t.entity_id = c.target_entity_id
  LEFT JOIN alias sa ON sa.entity_id = c.source_entity_id AND sa.doc_id = c.doc_id
  LEFT JOIN alias ta ON ta.entity_id = c.target_entity_id AND ta.doc_id = c.doc_id)"""
ENDS = """ends_resolved AS (
  SELECT c.*, coalesce(s.resolved_id, c.source_entity_id) AS source_resolved, coalesce(t.resolved_id, c.target_entity_id) AS target_resolved
  FROM claims c LEFT JOIN resolved s ON s.entity_id = c.source_entity_id LEFT JOIN resolved t ON t.entity_id = c.target_entity_id)"""
FACT_COLUMNS = ["claim_id", "doc_id", "slug", "company", "source_label", "target_label", "relation_type", "exposure_bp", "risk_flag", "verification_tier"]
FACT_LIST = ", ".join(FACT_COLUMNS)


def _facts(led: Ledger, job) -> DataFrame:
    return job(led.claims, led.documents, led.companies, led.entities, led.aliases)


def _resolved(led: Ledger) -> DataFrame:
    return entities.resolve_entities(led.entities, led.merges)


def _ends(led: Ledger) -> DataFrame:
    return facts.claims_resolved(led.claims, _resolved(led))


# Projections, filters and limits


@query("F1_retained_claims", with_ledger(f"SELECT claim_id, verification_tier FROM claims WHERE {RETAINED}"))
def _(led):
    return facts.retained_claims(led.claims).select("claim_id", "verification_tier")


@query("F2_claims_for_company", with_ledger("SELECT claim_id, doc_id, published_date FROM claims JOIN led_documents USING (doc_id) WHERE claims.company_id = 7"), once=False)
def _(led):
    return facts.claims_for_company(led.claims, led.documents, 7).select("claim_id", "doc_id", "published_date")


@query("F3_company_by_slug", with_ledger("SELECT company_id, name, slug FROM companies WHERE slug = 'supplier-000000003' LIMIT 1"))
def _(led):
    return facts.company_by_slug(led.companies, "supplier-000000003")


@query("F4_open_documents", with_ledger("SELECT doc_id, name, status, published_date FROM led_documents LEFT JOIN companies USING (company_id) WHERE status NOT IN ('published', 'excluded')"))
def _(led):
    return facts.open_documents(led.documents, led.companies).select("doc_id", "name", "status", "published_date")


@query("F5_near_ceiling_documents", with_ledger("SELECT doc_id, status FROM led_documents WHERE status = 'ready_for_review' AND doc_id % 5 = 0"))
def _(led):
    meta = F.parse_json(F.concat(F.lit('{"extraction": {"near_token_ceiling": '), F.when(F.pmod("doc_id", F.lit(5)) == 0, "true").otherwise("false"), F.lit("}}")))
    docs = led.documents.withColumns({"metadata": meta, "doc_type": F.lit("rating_rationale")})
    return facts.near_ceiling_documents(docs, "ready_for_review", "rating_rationale").select("doc_id", "status")


@query("L1_latest_published_document", with_ledger("SELECT company_id, doc_id, published_date FROM latest", LATEST))
def _(led):
    return facts.latest_published_document(led.documents).select("company_id", "doc_id", "published_date")


@query("L2_due_documents", with_ledger("SELECT doc_id, next_attempt FROM led_documents WHERE status = 'failed' AND (next_attempt IS NULL OR next_attempt <= 400000) ORDER BY next_attempt ASC NULLS LAST, doc_id LIMIT 25"))
def _(led):
    return facts.due_documents(led.documents, "failed", 400_000, 25).select("doc_id", "next_attempt")


ORDER_SQL = "row_number() OVER (PARTITION BY doc_id ORDER BY CASE risk_flag WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, exposure_bp DESC NULLS LAST, claim_id)"


@query("L3_review_order", with_ledger(f"SELECT claim_id, {ORDER_SQL} AS place FROM claims"))
def _(led):
    from pyspark.sql import Window

    return led.claims.select("claim_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*facts.review_order(led.claims))).cast("long").alias("place"))


BURSTS = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {n} PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error'"


@query("L9_failure_bursts", f"SELECT event_id, recent, recent >= 2 AS tripped FROM ({BURSTS.format(n=86_400 * 1_000_000 - 1)})")
def _(led):
    errors = led.table("events").filter("event_type = 'error'")
    return facts.failure_bursts(errors, "user_id", seconds=86_400, limit=2).select("event_id", "recent", "tripped")


@query("L8_latest_eval_run", "SELECT prompt_version, run_id FROM (SELECT user_id % 20 AS prompt_version, event_id AS run_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id % 3 <> 0) WHERE n = 1")
def _(led):
    runs = led.table("events").select(F.pmod("user_id", F.lit(20)).alias("prompt_version"), F.col("event_id").alias("run_id"), F.col("ts").alias("completed_at"), F.when(F.pmod("user_id", F.lit(3)) != 0, 1).otherwise(0).alias("schema_version"))
    return facts.latest_per_version(runs).select("prompt_version", "run_id")


# Joins


@query("J1_company_graph_facts", with_ledger(f"SELECT {FACT_LIST} FROM facts WHERE {RETAINED} AND doc_id IN (SELECT doc_id FROM latest)", LATEST, ALIAS, FACTS))
def _(led):
    return _facts(led, facts.company_graph_facts).select(*FACT_COLUMNS)


@query("J2_corpus_facts", with_ledger(f"SELECT {FACT_LIST} FROM facts WHERE {RETAINED} AND status = 'published'", ALIAS, FACTS))
def _(led):
    return _facts(led, facts.corpus_facts).select(*FACT_COLUMNS)


@query("J3_review_facts", with_ledger(f"SELECT {FACT_LIST} FROM facts WHERE status = 'ready_for_review'", ALIAS, FACTS))
def _(led):
    return _facts(led, facts.review_facts).select(*FACT_COLUMNS)


@query("J4_entity_across_corpus", with_ledger(f"SELECT claim_id, source_resolved, target_resolved FROM ends_resolved WHERE {RETAINED} AND (SELECT resolved_id FROM resolved WHERE entity_id = 13) IN (source_resolved, target_resolved)", RESOLVED_SQL, ENDS))
def _(led):
    return facts.entity_across_corpus(_ends(led), _resolved(led), 13).select("claim_id", "source_resolved", "target_resolved")


@query("J5_claims_resolved", with_ledger("SELECT claim_id, source_resolved, target_resolved FROM ends_resolved", RESOLVED_SQL, ENDS))
def _(led):
    return _ends(led).select("claim_id", "source_resolved", "target_resolved")


# Aggregates

VERIFIED = f"""SELECT c.company_id, slug, name, agency, published_date, count(*) AS claim_count,
  count(*) FILTER (risk_flag = 'high') AS high, count(*) FILTER (risk_flag = 'medium') AS medium, count(*) FILTER (risk_flag = 'low') AS low,
  count(*) FILTER (verification_tier = 'human_verified') AS human_verified, count(*) FILTER (verification_tier = 'machine_validated') AS machine_validated
FROM claims c JOIN latest USING (doc_id) JOIN companies co ON co.company_id = c.company_id WHERE {RETAINED} GROUP BY 1, 2, 3, 4, 5"""


@query("A1_verified_companies", with_ledger(VERIFIED, LATEST))
def verified(led):
    return facts.verified_companies(led.claims, led.documents, led.companies)


@query("A2_review_queue", with_ledger("""SELECT d.doc_id, name, title, published_date, count(c.claim_id) AS claims, count(*) FILTER (verification_tier = 'machine_validated') AS pending, count(*) FILTER (verification_tier = 'excluded') AS excluded
FROM led_documents d LEFT JOIN companies co USING (company_id) LEFT JOIN claims c USING (doc_id) WHERE d.status = 'ready_for_review' GROUP BY 1, 2, 3, 4"""))  # fmt: skip
def _(led):
    return facts.review_queue(led.claims, led.documents, led.companies).drop("company_id")


@query("A3_excluded_claim_count", with_ledger("SELECT doc_id, count(claim_id) FILTER (verification_tier = 'excluded') AS excluded FROM led_documents LEFT JOIN claims USING (doc_id) GROUP BY 1"))
def _(led):
    return facts.excluded_claim_count(led.claims, led.documents)


@query("A4_published_documents_per_company", with_ledger("SELECT company_id, name, slug, count(DISTINCT doc_id) FILTER (status = 'published') AS published FROM companies LEFT JOIN led_documents USING (company_id) GROUP BY 1, 2, 3"))
def _(led):
    return facts.published_documents_per_company(led.documents, led.companies)


@query("A5_entity_usage", with_ledger("""SELECT e.entity_id, canonical_name, count(title) AS claims, coalesce(array_to_string(list_sort(list_distinct(list(title) FILTER (title IS NOT NULL))), '|'), '') AS titles
FROM entities e LEFT JOIN (SELECT source_resolved AS entity_id, title FROM ends_resolved JOIN led_documents USING (doc_id) UNION ALL SELECT target_resolved, title FROM ends_resolved JOIN led_documents USING (doc_id)) USING (entity_id)
WHERE entity_type <> 'unnamed' GROUP BY 1, 2""", RESOLVED_SQL, ENDS))  # fmt: skip
def _(led):
    return facts.entity_usage(_ends(led), led.entities, led.documents).withColumn("titles", F.array_join("titles", "|"))


@query("A6_multi_document_entities", with_ledger("SELECT entity_id, count(DISTINCT doc_id) AS documents FROM (SELECT source_resolved AS entity_id, doc_id FROM ends_resolved UNION ALL SELECT target_resolved, doc_id FROM ends_resolved) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2", RESOLVED_SQL, ENDS))
def _(led):
    return facts.multi_document_entities(_ends(led))


@query("A5_entity_titles", with_ledger("""SELECT entity_id, title, count(*) AS claims, row_number() OVER (PARTITION BY entity_id ORDER BY title) AS place
FROM (SELECT doc_id, unnest(list_distinct([source_resolved, target_resolved])) AS entity_id FROM ends_resolved) JOIN led_documents USING (doc_id) GROUP BY 1, 2""", RESOLVED_SQL, ENDS))  # fmt: skip
def _(led):
    return facts.entity_titles(_ends(led), led.documents)


COUNTED = ", ".join(f"count(*) FILTER (relation_type = '{t}' AND NOT malformed) AS {t}" for t in graph.COUNTED)


@query("A7_relation_type_counts", with_ledger(f"SELECT graph_id, {COUNTED} FROM (SELECT DISTINCT graph_id FROM graph_nodes) LEFT JOIN typed USING (graph_id) GROUP BY 1", GRAPH_SQL))
def _(led):
    return graph.relation_type_counts(led.graph_nodes, led.graph_edges)


@query("A9_retry_backlog", with_ledger("SELECT status, count(*) AS pending, min(coalesce(next_attempt, 5)) AS earliest FROM led_documents GROUP BY 1"))
def _(led):
    return facts.retry_backlog(led.documents, 5).withColumn("earliest", F.col("earliest").cast("long"))


@query("A10_claims_by_quote", with_ledger(f"SELECT doc_id, quote, min(place) AS first_place, string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY place) AS claim_ids FROM (SELECT *, {ORDER_SQL} AS place FROM claims) GROUP BY 1, 2"))
def _(led):
    return facts.claims_by_quote(led.claims).withColumn("first_place", F.col("first_place").cast("long"))


@query("A9_discovered_backlog", with_ledger("SELECT agency AS source, count(*) AS pending, count(*) FILTER (coalesce(next_attempt, 60000000) <= 60000000) AS due, count(*) FILTER (attempts > 0) AS retried, CAST(min(coalesce(next_attempt, 60000000)) AS BIGINT) AS earliest FROM led_documents WHERE status = 'failed' GROUP BY 1"))
def _(led):
    docs = led.documents.withColumns({"source": F.col("agency"), "status": F.when(F.col("status") == "failed", "discovered").otherwise(F.col("status"))})
    return facts.discovered_backlog(docs, 60_000_000).withColumn("earliest", F.col("earliest").cast("long"))


@query("A12_batch_ingest_summary", with_ledger(f"""SELECT d.doc_id, coalesce(n, 0) AS claims, coalesce(x, 0) AS excluded,
  concat_ws(',', CASE WHEN d.doc_id % 2 = 0 AND coalesce(n, 0) < 3 THEN 'thin' END, CASE WHEN d.doc_id % 5 = 0 THEN 'near_ceiling' END, CASE WHEN d.doc_id % 9 > 5 AND subsidiary + group_company > 0 AND customer + supplier + lender = 0 THEN 'structure_heavy' END) AS markers
FROM led_documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (verification_tier = 'excluded') AS x FROM claims WHERE doc_id % 5 > 1 OR rn < 3 GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT graph_id AS doc_id, {COUNTED} FROM (SELECT DISTINCT graph_id FROM graph_nodes) LEFT JOIN typed USING (graph_id) GROUP BY 1) USING (doc_id)""", GRAPH_SQL))  # fmt: skip
def _(led):
    from ..operators import evaluate

    docs = led.documents.withColumns({"doc_type": F.when(F.pmod("doc_id", F.lit(2)) == 0, "rating_rationale").otherwise("annual_report"), "near_ceiling": F.pmod("doc_id", F.lit(5)) == 0, "structure_seen": F.pmod("doc_id", F.lit(9))})
    claims = led.claims.filter((F.pmod("doc_id", F.lit(5)) > 1) | (F.col("rn") < 3))
    return evaluate.batch_summary(docs, claims, graph.relation_type_counts(led.graph_nodes, led.graph_edges))


@query("A14_graph_evidence_counts", with_ledger(f"SELECT doc_id, count(*) FILTER ({RETAINED}) AS retained, count(*) FILTER (verification_tier = 'excluded') AS excluded FROM claims GROUP BY 1"))
def _(led):
    return led.claims.groupBy("doc_id").agg(F.count_if(F.col("verification_tier").isin("human_verified", "machine_validated")).alias("retained"), F.count_if(F.col("verification_tier") == "excluded").alias("excluded"))


@query("S9_table_counts", with_ledger("SELECT 'companies' AS table_name, count(*) AS n FROM companies UNION ALL SELECT 'documents', count(*) FROM led_documents UNION ALL SELECT 'claims', count(*) FROM claims UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'merges', count(*) FROM merges UNION ALL SELECT 'aliases', count(*) FROM aliases"))
def _(led):
    return facts.table_counts({"companies": led.companies, "documents": led.documents, "claims": led.claims, "entities": led.entities, "merges": led.merges, "aliases": led.aliases})


@query("S6_scan_ledger_tables", "SELECT c_custkey AS entity_id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(led):
    from ..sources.snapshots import scan_tables

    tables = scan_tables(led.spark, led.folder, ["customer", "supplier"])
    return tables["customer"].select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name")).unionAll(tables["supplier"].select("s_suppkey", "s_name"))


# Entities


@query("E1_resolve_entities", with_ledger("SELECT entity_id, resolved_id FROM resolved", RESOLVED_SQL))
def _(led):
    return _resolved(led).select("entity_id", "resolved_id")


@query("E2_entity_family", with_ledger("SELECT entity_id FROM family", "active AS (SELECT from_id, into_id FROM merges WHERE reverted = 0)", "family AS (SELECT CAST(80 AS BIGINT) AS entity_id UNION SELECT m.from_id FROM family f JOIN active m ON m.into_id = f.entity_id)"))
def _(led):
    return entities.entity_family(led.entities, led.merges, 80)


PARTS = "p_name || ' ' || p_type || CASE p_partkey % 6 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Pvt. Ltd.' WHEN 2 THEN ' India Private Limited' WHEN 3 THEN '' WHEN 4 THEN ' & Co' ELSE ' Inc' END"


def _part_names(led: Ledger) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, [" Ltd", " Pvt. Ltd.", " India Private Limited", "", " & Co", " Inc"])), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    return led.table("part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type", suffix).alias("name"), F.pmod("p_partkey", F.lit(17)).alias("claims"))


KEY = "regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({0}), '[.,&''\"]', '', 'g'), '\\s+', ' ', 'g')), '((^|\\s)(limited|ltd|private|pvt|plc|inc|incorporated|corporation|corp|company|co|llp|llc|gmbh|sa|nv|bv|ag|pte))+$', '#'), '((^|\\s)india)?#$', '')"


@query("E3_entity_keys", f"SELECT p_partkey AS id, name, {KEY.format('name')} AS normalized_name FROM (SELECT p_partkey, {PARTS} AS name FROM part)")
def _(led):
    return entities.entity_keys(_part_names(led), "name").select("id", "name", "normalized_name")


@query("E4_link_nodes_to_entities", f"""WITH nodes AS (SELECT p_partkey % 50 AS doc_id, 'n' || CAST(p_partkey AS VARCHAR) AS node_id, {PARTS} AS label, p_partkey % 13 <> 0 AS named FROM part),
keyed AS (SELECT *, {KEY.format('label')} AS key FROM nodes), alias AS (SELECT key, 'a:' || key AS entity_key FROM (SELECT DISTINCT key FROM keyed) WHERE length(key) % 3 = 0),
ent AS (SELECT 'e:' || key AS entity_key, key FROM (SELECT DISTINCT key FROM keyed) WHERE length(key) % 2 = 0)
SELECT doc_id, node_id, CASE WHEN NOT named THEN 'unnamed:' || CAST(doc_id AS VARCHAR) || ':' || node_id ELSE coalesce(a.entity_key, e.entity_key, 'new:' || k.key) END AS entity_key
FROM keyed k LEFT JOIN alias a ON a.key = k.key LEFT JOIN ent e ON e.key = k.key""")  # fmt: skip
def _(led):
    from ..functions import exprs

    parts = _part_names(led)
    nodes = parts.select(F.pmod("id", F.lit(50)).alias("doc_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.col("name").alias("label"), (F.pmod("id", F.lit(13)) != 0).alias("named"))
    keys = parts.select(exprs.name_key(F.col("name")).alias("key")).distinct()
    aliases = keys.filter("length(key) % 3 = 0").select("key", F.concat(F.lit("a:"), "key").alias("entity_key"))
    known = keys.filter("length(key) % 2 = 0").select(F.concat(F.lit("e:"), "key").alias("entity_key"), F.col("key").alias("normalized_name"))
    return entities.link_nodes_to_entities(nodes, aliases, known)[0].select("doc_id", "node_id", "entity_key")


@query("E5_classify_entity", "SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN 'unnamed' WHEN c_custkey % 5 = 0 THEN 'government' WHEN c_custkey % 5 = 1 THEN 'institution' ELSE 'company' END AS entity_type, CASE WHEN c_custkey % 5 <> 2 THEN 'IN' END AS country FROM customer")
def _(led):
    kind = F.pmod("c_custkey", F.lit(5))
    nodes = led.table("customer").select(F.col("c_custkey").alias("id"), F.when(kind == 0, "Indian Navy").when(kind == 1, F.concat("c_name", F.lit(" Bank"))).when(kind == 2, "Samsung Works").otherwise(F.col("c_name")).alias("label"), F.when(kind == 1, "lender").otherwise("customer").alias("type"), (F.pmod("c_custkey", F.lit(13)) != 0).alias("named"))
    return entities.classify_entity(nodes).select("id", "entity_type", "country")


CANDIDATES = f"""WITH named AS (SELECT p_partkey AS id, {PARTS} AS name, p_partkey % 17 AS claims FROM part),
keyed AS (SELECT id, claims, {KEY.format('name')} AS key FROM named), names AS (SELECT key, min(id) AS first, string_split(key, ' ') AS w FROM keyed WHERE key <> '' GROUP BY key),
pairs AS (SELECT a.key AS a, b.key AS b, a.first AS x, b.first AS y,
  len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(list_concat(a.w, b.w))) AS j,
  length(CASE WHEN length(a.key) < length(b.key) THEN a.key ELSE b.key END) >= 4 AND (contains(a.key, b.key) OR contains(b.key, a.key)) AS inside,
  len(a.w) >= 2 AND len(b.w) >= 2 AND (len(list_intersect(fa, fb)) > 0 OR list_contains(fa, b.key) OR list_contains(fb, a.key)) AS trim
  FROM (SELECT *, list_filter([CASE WHEN len(w) > 2 THEN array_to_string(w[2:], ' ') END, CASE WHEN len(w) > 2 THEN array_to_string(w[:len(w) - 1], ' ') END], lambda x: x IS NOT NULL) AS fa FROM names) a
  JOIN (SELECT *, list_filter([CASE WHEN len(w) > 2 THEN array_to_string(w[2:], ' ') END, CASE WHEN len(w) > 2 THEN array_to_string(w[:len(w) - 1], ' ') END], lambda x: x IS NOT NULL) AS fb FROM names) b ON a.key < b.key),
found AS (SELECT x, y, greatest(CASE WHEN inside THEN 0.95 ELSE 0 END, CASE WHEN j >= 0.8 THEN least(0.92, 0.7 + j / 4) ELSE 0 END, CASE WHEN trim THEN 0.88 ELSE 0 END) AS c FROM pairs WHERE inside OR j >= 0.8 OR trim
  UNION ALL SELECT first, id, CASE WHEN length(k.key) >= 4 THEN 0.95 ELSE 0.92 END FROM keyed k JOIN names n ON n.key = k.key WHERE id <> first)
SELECT least(x, y) AS left_id, greatest(x, y) AS right_id, round(CAST(c AS DOUBLE), 6) AS confidence FROM found"""


@query("E6_duplicate_candidates", CANDIDATES)
def _(led):
    from ..functions import exprs

    usage = _part_names(led).withColumn("key", exprs.name_key(F.col("name")))
    return entities.duplicate_candidates(usage).select("left_id", "right_id", F.round("confidence", 6).alias("confidence"))


@query("J8_similar_entity_pairs", f"WITH c AS ({CANDIDATES}), named AS (SELECT p_partkey AS id, {PARTS} AS name, p_partkey % 17 AS claims FROM part), keyed AS (SELECT id, claims, {KEY.format('name')} AS key FROM named) SELECT left_id, right_id, l.key AS left_key, r.key AS right_key, l.claims AS left_claims, r.claims AS right_claims FROM c JOIN keyed l ON l.id = left_id JOIN keyed r ON r.id = right_id WHERE confidence >= 0.9")
def _(led):
    from ..functions import exprs

    pairs = entities.duplicate_candidates(_part_names(led).withColumn("key", exprs.name_key(F.col("name"))))
    return pairs.filter(F.round("confidence", 6) >= 0.9).select("left_id", "right_id", "left_key", "right_key", *[F.col(c).cast("long").alias(c) for c in ("left_claims", "right_claims")])


@query("E8_apply_merges", with_ledger("""SELECT c_custkey AS from_id, c_custkey + 5 AS into_id, CASE WHEN c_custkey + 5 NOT IN (SELECT entity_id FROM entities) THEN 'unknown entity'
  WHEN c_custkey % 13 = 0 OR (c_custkey + 5) % 13 = 0 THEN 'unnamed entity' WHEN c_custkey IN (SELECT from_id FROM merges WHERE reverted = 0) THEN 'already merged' ELSE 'merged' END AS outcome FROM customer WHERE c_custkey % 4 = 1"""))  # fmt: skip
def _(led):
    requests = led.table("customer").filter("c_custkey % 4 = 1").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") + 5).alias("into_id"))
    new, _, rejects = entities.apply_merges(requests, led.entities, led.merges, led.aliases)
    return new.select("from_id", "into_id", F.lit("merged").alias("outcome")).unionByName(rejects.withColumnRenamed("reason", "outcome"))


@query("E9_seed_alias_groups", f"""WITH named AS (SELECT p_partkey AS id, {PARTS} AS name, p_partkey % 17 AS claims FROM part), keyed AS (SELECT *, {KEY.format('name')} AS key FROM named),
near AS (SELECT DISTINCT canonical, id, name, claims FROM keyed JOIN (SELECT 'Red Widget' AS canonical, 'red widget' AS a UNION ALL SELECT 'Small Ring Ltd', 'small ring') ON starts_with(key, a)),
best AS (SELECT canonical, first(id ORDER BY (name = canonical) DESC, claims DESC, id) AS into_id FROM near GROUP BY 1)
SELECT canonical, id AS from_id, into_id FROM near JOIN best USING (canonical) WHERE id <> into_id""")  # fmt: skip
def _(led):
    from ..functions import exprs

    groups = led.spark.createDataFrame([("red widget inc", "Red Widget"), ("Small ring", "Small Ring Ltd")], "raw string, canonical string")
    return entities.seed_alias_groups(groups, _part_names(led).withColumn("key", exprs.name_key(F.col("name"))))


@query("E10_seed_rejections", f"""WITH named AS (SELECT p_partkey AS id, {PARTS} AS name FROM part), ids AS (SELECT {KEY.format('name')} AS key, min(id) AS id FROM named GROUP BY 1)
SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM part p JOIN ids x ON x.key = lower(p.p_name || ' ' || p.p_type) JOIN ids y ON y.key = lower(p.p_name || ' small') WHERE x.id <> y.id""")  # fmt: skip
def _(led):
    from ..functions import exprs

    names = led.table("part").select(F.concat_ws(" ", "p_name", "p_type").alias("left_name"), F.concat("p_name", F.lit(" SMALL")).alias("right_name"))
    keyed = _part_names(led).withColumn("key", exprs.name_key(F.col("name")))
    return entities.seed_rejections(names, keyed, led.spark.createDataFrame([], "a long, b long"))


@query("E11_match_or_create_companies", f"""WITH n AS (SELECT key, min_by(name, id) AS name, min(id) AS ordinal FROM (SELECT p_partkey AS id, {PARTS} AS name, {KEY.format(PARTS)} AS key FROM part) GROUP BY key)
SELECT key, name, CAST(NULL AS BIGINT) AS company_id, s || CASE WHEN k > 1 THEN '-' || CAST(k AS VARCHAR) ELSE '' END AS slug FROM (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY ordinal) AS k FROM (SELECT *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM n))""")  # fmt: skip
def _(led):
    return entities.match_or_create_companies(_part_names(led).select("name", F.col("id").alias("ordinal")), led.companies)


@query("E12_name_lookup", with_ledger(f"""SELECT key, resolved_id AS entity_id FROM (SELECT key, resolved_id, row_number() OVER (PARTITION BY key ORDER BY rank, resolved_id) AS n FROM (
  SELECT {KEY.format('canonical_name')} AS key, entity_id, 1 AS rank FROM entities UNION ALL SELECT {KEY.format('raw_name')}, entity_id, 0 FROM aliases) JOIN resolved USING (entity_id)) WHERE n = 1""", RESOLVED_SQL))  # fmt: skip
def _(led):
    return entities.name_lookup(led.entities, led.aliases, _resolved(led))


@query("J6_anti_rejected_pairs", CANDIDATES + " WHERE (least(x, y) + greatest(x, y)) % 2 <> 0")
def _(led):
    from ..functions import exprs

    usage = _part_names(led).withColumn("key", exprs.name_key(F.col("name")))
    every = entities.duplicate_candidates(usage)
    rejected = every.filter("(left_id + right_id) % 2 = 0").select(F.col("right_id").alias("a"), F.col("left_id").alias("b"))
    # the SQL takes rejected rows from the star and links nothing anew
    return entities.duplicate_candidates(usage, rejections=rejected, relink=False).select("left_id", "right_id", F.round("confidence", 6).alias("confidence"))


@query("J7_anti_active_merge_sources", with_ledger("SELECT entity_id FROM entities WHERE entity_id NOT IN (SELECT from_id FROM merges WHERE reverted = 0)"))
def _(led):
    return led.entities.select("entity_id").join(led.merges.filter("reverted = 0").select(F.col("from_id").alias("entity_id")), "entity_id", "left_anti")


@query("J10_queue_left_joins", with_ledger("SELECT d.doc_id, co.name, c.claim_id FROM led_documents d LEFT JOIN companies co USING (company_id) LEFT JOIN claims c ON c.doc_id = d.doc_id AND c.rn > 4"))
def _(led):
    late = led.claims.filter("rn > 4").select("doc_id", "claim_id")
    return led.documents.select("doc_id", "company_id").join(led.companies.select("company_id", "name"), "company_id", "left").join(late, "doc_id", "left").select("doc_id", "name", "claim_id")


@query("U1_union_of_endpoints", with_ledger("SELECT source_entity_id AS entity_id, doc_id FROM claims UNION ALL SELECT target_entity_id, doc_id FROM claims"))
def _(led):
    return led.claims.select(F.col("source_entity_id").alias("entity_id"), "doc_id").unionAll(led.claims.select("target_entity_id", "doc_id"))


@query("U2_distinct_edges", with_ledger("SELECT DISTINCT company_id, target_entity_id, relation_type, quote FROM claims"))
def _(led):
    return led.claims.select("company_id", "target_entity_id", "relation_type", "quote").dropDuplicates()


# Graphs, corpus, concentration


@query("G1_relation_type_of_edges", with_ledger("SELECT graph_id, edge_no, relation_type FROM typed WHERE relation_type IS NOT NULL", GRAPH_SQL))
def _(led):
    return graph.relation_type_of_edges(led.graph_nodes, led.graph_edges)[0].select("graph_id", "edge_no", "relation_type")


@query("F8_drop_malformed_edges", with_ledger("SELECT graph_id, edge_no, source, target FROM typed WHERE malformed", GRAPH_SQL))
def _(led):
    return graph.drop_malformed_edges(led.graph_nodes, led.graph_edges)[1].select("graph_id", "edge_no", "source", "target")


TYPES = """kinds AS (SELECT *, CASE WHEN source_own = company_id THEN 'target' WHEN source_entity_type = 'unnamed' THEN 'unnamed_dependency' ELSE 'industry' END AS source_type,
  CASE WHEN target_own = company_id THEN 'target' WHEN relation_type <> 'unnamed_dependency' THEN relation_type WHEN target_entity_type = 'unnamed' THEN 'unnamed_dependency' ELSE 'industry' END AS target_type
  FROM facts WHERE verification_tier IN ('human_verified', 'machine_validated') AND status = 'published')"""


@query("G2_node_types_from_claims", with_ledger("SELECT claim_id, source_type, target_type FROM kinds", ALIAS, FACTS, TYPES))
def _(led):
    return graph.node_types_from_claims(_facts(led, facts.corpus_facts)).select("claim_id", "source_type", "target_type")


@query("G3_claims_to_graph", with_ledger("""SELECT graph_id, node_id, label, type FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node_id ORDER BY claim_id, e) AS n FROM (
  SELECT doc_id AS graph_id, CAST(source_entity_id AS VARCHAR) AS node_id, source_label AS label, source_type AS type, claim_id, 0 AS e FROM kinds
  UNION ALL SELECT doc_id, CAST(target_entity_id AS VARCHAR), target_label, target_type, claim_id, 1 FROM kinds)) WHERE n = 1""", ALIAS, FACTS, TYPES))  # fmt: skip
def _(led):
    return graph.claims_to_graph(_facts(led, facts.corpus_facts))[0].select("graph_id", "node_id", "label", "type")


SCORE = "(CASE WHEN exposure_bp IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN risk_flag IS NOT NULL THEN 60 ELSE 0 END + CASE WHEN confidence = 'high' THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(relation || ' ' || quote), 'revenue|turnover|operat|manufactur|supply|customer|support|guarantee|obligation|debt|loan|funding|cash flow|financial') THEN 30 ELSE 0 END)"
CAPPED = f"""capped AS (SELECT *, row_number() OVER (PARTITION BY graph_id, structure ORDER BY {SCORE} DESC, edge_no) AS place FROM (
  SELECT *, coalesce(relation_type IN ('subsidiary', 'group_company') AND NOT malformed, false) AS structure FROM typed))"""


@query("L5_cap_group_structure", with_ledger("SELECT graph_id, edge_no FROM capped WHERE NOT structure OR place <= 1", GRAPH_SQL, CAPPED))
def _(led):
    return graph.cap_group_structure(led.graph_nodes, led.graph_edges, cap=1)[0].select("graph_id", "edge_no")


@query("G6_needs_second_pass", with_ledger("SELECT graph_id, subsidiary + group_company > 0 AND customer + supplier + lender + parent + unnamed_dependency = 0 AS needs_second_pass FROM (SELECT graph_id, " + COUNTED + " FROM (SELECT DISTINCT graph_id FROM graph_nodes) LEFT JOIN typed USING (graph_id) GROUP BY 1)", GRAPH_SQL))
def _(led):
    return graph.needs_second_pass(graph.relation_type_counts(led.graph_nodes, led.graph_edges), cap=0).select("graph_id", "needs_second_pass")


@query("G7_coverage_report", with_ledger("SELECT graph_id, count(*) FILTER (structure) AS total_seen, count(*) FILTER (structure) AS response_edges, greatest(count(*) FILTER (structure) - 1, 0) AS capped, count(*) FILTER (relation_type = 'subsidiary' AND NOT malformed) AS returned_subsidiary, count(*) FILTER (relation_type = 'subsidiary' AND NOT malformed AND place <= 1) AS claimed_subsidiary FROM capped GROUP BY 1", GRAPH_SQL, CAPPED))
def _(led):
    kept, report = graph.cap_group_structure(led.graph_nodes, led.graph_edges, cap=1)
    kept = kept.select(*led.graph_edges.columns)
    counts = graph.relation_type_counts
    return graph.coverage_report(counts(led.graph_nodes, led.graph_edges), counts(led.graph_nodes, kept), report).filter("response_edges IS NOT NULL").select("graph_id", "total_seen", "response_edges", "capped", "returned_subsidiary", "claimed_subsidiary")


@query("G8_exclusion_disclosure", with_ledger("""SELECT graph_id, label, min(reason) AS reason FROM (SELECT graph_id, reason, unnest(CASE WHEN len(chosen) > 0 THEN chosen ELSE [source_label, target_label] END) AS label FROM (
  SELECT graph_id, CASE WHEN edge_no <= 2 THEN 'quote_not_verified' ELSE 'unresolved_endpoint' END AS reason, source_label, target_label,
    list_filter([CASE WHEN source_type <> 'target' THEN source_label END, CASE WHEN target_type <> 'target' THEN target_label END], lambda x: x IS NOT NULL) AS chosen FROM ends WHERE edge_no <= 4)) GROUP BY 1, 2""", GRAPH_SQL))  # fmt: skip
def _(led):
    edges = led.graph_edges
    return graph.exclusion_disclosure(led.graph_nodes, edges.filter("edge_no <= 2"), edges.filter("edge_no IN (3, 4)"))


RELATIONSHIPS = """rel AS (
  SELECT k.claim_id, k.doc_id, company, published_date, relation_type, side, e.resolved_id AS entity_id, c.resolved_id AS counterparty_id, entity_label, counterparty_label, entity_type, counterparty_type FROM (
    SELECT claim_id, doc_id, company, published_date, relation_type, 'source' AS side, source_entity_id AS raw, target_entity_id AS raw2, source_label AS entity_label, target_label AS counterparty_label, source_type AS entity_type, target_type AS counterparty_type FROM kinds
    UNION ALL SELECT claim_id, doc_id, company, published_date, relation_type, 'target', target_entity_id, source_entity_id, target_label, source_label, target_type, source_type FROM kinds) k
  JOIN resolved e ON e.entity_id = raw JOIN resolved c ON c.entity_id = raw2),
scored AS (
  SELECT e.entity_id, e.canonical_name AS label, count(DISTINCT doc_id) AS report_count,
    CASE WHEN count(DISTINCT doc_id) = 0 THEN 0 ELSE ln(((SELECT count(DISTINCT doc_id) FROM rel) + 1) / (count(DISTINCT doc_id) + 1)) + 1 END AS specificity
  FROM entities e LEFT JOIN rel USING (entity_id) GROUP BY 1, 2)"""
CORPUS = (RESOLVED_SQL, ALIAS, FACTS, TYPES, RELATIONSHIPS)


def _relationships(led: Ledger) -> DataFrame:
    return corpus.corpus_relationships(_facts(led, facts.corpus_facts), _resolved(led))


@query("C1_corpus_relationships", with_ledger("SELECT claim_id, side, entity_id, counterparty_id, entity_label, counterparty_label, entity_type, counterparty_type FROM rel", *CORPUS))
def _(led):
    return _relationships(led).select("claim_id", "side", "entity_id", "counterparty_id", "entity_label", "counterparty_label", "entity_type", "counterparty_type")


@query("C2_corpus_entities", with_ledger("SELECT entity_id, label, report_count, round(specificity, 6) AS specificity FROM scored", *CORPUS))
def _(led):
    return corpus.corpus_entities(_relationships(led), led.entities).withColumn("specificity", F.round("specificity", 6))


@query("C3_relationship_specificity", with_ledger("SELECT claim_id, side, round(a.specificity, 6) AS entity_specificity, round(b.specificity, 6) AS counterparty_specificity FROM rel LEFT JOIN scored a ON a.entity_id = rel.entity_id LEFT JOIN scored b ON b.entity_id = rel.counterparty_id", *CORPUS))
def _(led):
    rel = _relationships(led)
    rows = corpus.relationship_specificity(rel, corpus.corpus_entities(rel, led.entities))
    return rows.select("claim_id", "side", *[F.round(c, 6).alias(c) for c in ("entity_specificity", "counterparty_specificity")])


LOOKUP = f"""lookup AS (SELECT key, resolved_id AS entity_id FROM (SELECT key, resolved_id, row_number() OVER (PARTITION BY key ORDER BY rank, resolved_id) AS n FROM (
  SELECT {KEY.format('canonical_name')} AS key, entity_id, 1 AS rank FROM entities UNION ALL SELECT {KEY.format('raw_name')}, entity_id, 0 FROM aliases) JOIN resolved USING (entity_id)) WHERE n = 1)"""


@query("C4_entity_profile", with_ledger(f"SELECT p.label, rel.claim_id, rel.side, counterparty_label FROM (SELECT c_name || ' Ltd' AS label, {KEY.format('c_name')} AS key FROM customer WHERE c_custkey < 40) p JOIN lookup USING (key) JOIN rel USING (entity_id)", *CORPUS, LOOKUP))
def _(led):
    labels = led.table("customer").filter("c_custkey < 40").select(F.concat("c_name", F.lit(" Ltd")).alias("label"))
    lookup = entities.name_lookup(led.entities, led.aliases, _resolved(led))
    return corpus.entity_profile(labels, lookup, _relationships(led)).select("label", "claim_id", "side", "counterparty_label")


@query("C5_graph_entity_relationships", with_ledger("SELECT graph_id, edge_no, source AS node_id, target AS counterparty_id, target_label AS counterparty_label FROM ends UNION ALL SELECT graph_id, edge_no, target, source, source_label FROM ends WHERE source <> target", GRAPH_SQL))
def _(led):
    return corpus.graph_entity_relationships(led.graph_nodes, led.graph_edges).select("graph_id", "edge_no", "node_id", "counterparty_id", "counterparty_label")


@query("C6_other_report_relationships", with_ledger("SELECT claim_id, side FROM rel WHERE company <> 'Supplier#000000001'", *CORPUS))
def _(led):
    rows = _relationships(led)
    return corpus.other_report_relationships(rows, F.when(F.col("company") == "Supplier#000000001", F.col("company")).otherwise("-"), F.col("published_date"), F.col("agency")).select("claim_id", "side")


@query("C7_session_relationships", with_ledger("SELECT company, published_date, entity_id, counterparty_id, quote, min(claim_id) AS claim_id FROM rel JOIN (SELECT claim_id, quote FROM claims) USING (claim_id) GROUP BY 1, 2, 3, 4, 5", *CORPUS))
def _(led):
    rel = _relationships(led)
    return corpus.session_relationships(rel, rel.filter("claim_id % 3 = 0")).select("company", "published_date", "entity_id", "counterparty_id", "quote", "claim_id")


@query("C8_node_specificity", with_ledger(f"SELECT graph_id, node_id, round(coalesce(specificity, 0), 6) AS specificity FROM (SELECT *, {KEY.format('label')} AS key FROM graph_nodes) LEFT JOIN lookup USING (key) LEFT JOIN scored USING (entity_id)", *CORPUS, LOOKUP, GRAPH_SQL))
def _(led):
    lookup = entities.name_lookup(led.entities, led.aliases, _resolved(led))
    rows = corpus.node_specificity(led.graph_nodes, lookup, corpus.corpus_entities(_relationships(led), led.entities))
    return rows.withColumn("specificity", F.round("specificity", 6))


@query("L7_rank_by_specificity", with_ledger("SELECT claim_id, side, place FROM (SELECT claim_id, side, row_number() OVER (PARTITION BY rel.entity_id ORDER BY b.report_count, published_date DESC, counterparty_label, relation_type, claim_id, side) AS place FROM rel JOIN scored b ON b.entity_id = counterparty_id)", *CORPUS))
def _(led):
    # read twice, by few of its columns
    rel = written(_relationships(led).select("entity_id", "counterparty_id", "doc_id", "published_date", "counterparty_label", "relation_type", "claim_id", "side"), "relationships")
    rows = corpus.rank_by_specificity(corpus.relationship_specificity(rel, corpus.corpus_entities(rel, led.entities)))
    return rows.select("claim_id", "side", F.col("place").cast("long").alias("place"))


TOUCH = """touch AS (SELECT *, CASE WHEN source = 'T' THEN target ELSE source END AS other, CASE WHEN source = 'T' THEN target_type ELSE source_type END AS other_type, CASE WHEN source = 'T' THEN target_label ELSE source_label END AS other_label FROM ends WHERE source = 'T' OR target = 'T'),
single AS (SELECT *, CASE WHEN risk_flag = 'high' THEN 1000000 ELSE coalesce(exposure_bp, 0) END AS score FROM touch WHERE risk_flag = 'high' OR exposure_bp >= 2500),
points AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY score DESC, other_label, other) AS place FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, other ORDER BY score DESC, edge_no) AS n FROM single) WHERE n = 1),
ghosts AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY ghost_label, relation, quote, edge_no) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY graph_id, ghost ORDER BY ghost_label, relation, quote, edge_no) AS n FROM (
    SELECT *, CASE WHEN source_type = 'unnamed_dependency' OR NOT source_named THEN source ELSE target END AS ghost, CASE WHEN source_type = 'unnamed_dependency' OR NOT source_named THEN source_label ELSE target_label END AS ghost_label
    FROM ends WHERE source_type = 'unnamed_dependency' OR NOT source_named OR target_type = 'unnamed_dependency' OR NOT target_named)) WHERE n = 1),
cust AS (SELECT graph_id, CAST(sum(exposure_bp) AS BIGINT) AS exposure_bp, count(DISTINCT other) AS customers, bool_or(coalesce(risk_flag = 'high', false)) AS any_high FROM touch WHERE other_type = 'customer' AND exposure_bp IS NOT NULL GROUP BY 1)"""


@query("D1_customer_concentration", with_ledger("SELECT * FROM cust", GRAPH_SQL, TOUCH))
def _(led):
    return concentration.customer_concentration(led.graph_nodes, led.graph_edges)


@query("D2_single_points_of_failure", with_ledger("SELECT graph_id, other AS counterparty_id, edge_no, CAST(score AS BIGINT) AS score, place FROM points", GRAPH_SQL, TOUCH))
def _(led):
    rows = concentration.single_points_of_failure(led.graph_nodes, led.graph_edges)
    return rows.select("graph_id", "counterparty_id", "edge_no", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@query("L6_strongest_edge_per_counterparty", with_ledger("SELECT graph_id, other AS counterparty_id, edge_no, exposure_bp FROM points", GRAPH_SQL, TOUCH))
def _(led):
    return concentration.single_points_of_failure(led.graph_nodes, led.graph_edges).select("graph_id", "counterparty_id", "edge_no", "exposure_bp")


@query("D3_watch_items", with_ledger("SELECT graph_id, 'risk ' || CAST(graph_id % 3 AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS node_id, 1 AS place FROM (SELECT DISTINCT graph_id FROM graph_nodes) UNION ALL SELECT graph_id, ghost_label, ghost, place + 1 FROM ghosts", GRAPH_SQL, TOUCH))
def _(led):
    risks = led.graph_nodes.select("graph_id").distinct().select("graph_id", F.lit(0).alias("pos"), F.concat(F.lit("risk "), F.pmod("graph_id", F.lit(3)).cast("string")).alias("text"))
    return concentration.watch_items(led.graph_nodes, led.graph_edges, risks).select("graph_id", "text", "node_id", F.col("place").cast("long").alias("place"))


PERCENT = "(CAST(({0} + 5) // 10 // 10 AS VARCHAR) || CASE WHEN ({0} + 5) // 10 % 10 = 0 THEN '' ELSE '.' || CAST(({0} + 5) // 10 % 10 AS VARCHAR) END)"
READ = f"""SELECT n.graph_id, CASE WHEN c.graph_id IS NOT NULL THEN '≥' || {PERCENT.format('c.exposure_bp')} || '% explicitly quantified across ' || CAST(customers AS VARCHAR) || CASE WHEN customers = 1 THEN ' customer' ELSE ' customers' END ELSE 'No explicit customer percentage retained' END AS concentration,
  CASE WHEN s.graph_id IS NOT NULL THEN CAST(sn AS VARCHAR) || CASE WHEN sn = 1 THEN ' counterparty' ELSE ' counterparties' END || ' · ' || array_to_string(names[1:2], ' · ') || CASE WHEN sn > 2 THEN ' · +' || CAST(sn - 2 AS VARCHAR) || ' more' ELSE '' END ELSE 'No retained counterparties meet the 25% / high-risk threshold' END AS single_points,
  CASE WHEN w.graph_id IS NOT NULL THEN array_to_string(items[1:2], ' · ') || CASE WHEN wn > 2 THEN ' · +' || CAST(wn - 2 AS VARCHAR) || ' more' ELSE '' END ELSE 'No unnamed or key-risk dependencies retained' END AS watch_items,
  CAST(coalesce(k, 0) AS VARCHAR) || CASE WHEN k = 1 THEN ' retained relationship' ELSE ' retained relationships' END || ' · ' || CAST(x AS VARCHAR) || ' excluded' AS evidence,
  CASE WHEN c.graph_id IS NOT NULL THEN '≥' || {PERCENT.format('c.exposure_bp')} || '% named customer exposure' WHEN s.graph_id IS NOT NULL THEN CAST(sn AS VARCHAR) || CASE WHEN sn = 1 THEN ' potential single point of failure' ELSE ' potential single points of failure' END
    WHEN w.graph_id IS NOT NULL THEN CAST(wn AS VARCHAR) || CASE WHEN wn = 1 THEN ' reported dependency watch item' ELSE ' reported dependency watch items' END ELSE CAST(coalesce(k, 0) AS VARCHAR) || ' evidence-backed relationships retained' END AS headline,
  CASE WHEN coalesce(sh, false) OR coalesce(any_high, false) THEN 'high' WHEN c.graph_id IS NOT NULL OR w.graph_id IS NOT NULL THEN 'medium' ELSE 'low' END AS tone
FROM (SELECT DISTINCT graph_id FROM graph_nodes) n LEFT JOIN cust c USING (graph_id)
LEFT JOIN (SELECT graph_id, count(*) AS sn, bool_or(coalesce(risk_flag = 'high', false)) AS sh, list(other_label || CASE WHEN exposure_bp IS NOT NULL THEN ' (' || {PERCENT.format('exposure_bp')} || '%)' ELSE ' (high risk)' END ORDER BY place) AS names FROM points GROUP BY 1) s USING (graph_id)
LEFT JOIN (SELECT graph_id, count(*) AS wn, list(ghost_label ORDER BY place) AS items FROM ghosts GROUP BY 1) w USING (graph_id)
LEFT JOIN (SELECT graph_id, count(*) AS k FROM graph_edges GROUP BY 1) e USING (graph_id)
LEFT JOIN (SELECT doc_id AS graph_id, count(claim_id) FILTER (verification_tier = 'excluded') AS x FROM led_documents LEFT JOIN claims USING (doc_id) GROUP BY 1) q USING (graph_id)"""


@query("D4_dependency_read", with_ledger(READ, GRAPH_SQL, TOUCH))
def _(led):
    excluded = facts.excluded_claim_count(led.claims, led.documents).withColumnRenamed("doc_id", "graph_id")
    rows = concentration.dependency_read(led.graph_nodes, led.graph_edges, excluded=excluded)
    return rows.select("graph_id", "concentration", "single_points", "watch_items", "evidence", "headline", "tone")


@query("D5_risk_verdict", with_ledger("""SELECT n.graph_id, CASE WHEN coalesce(h, 0) > 0 THEN 'high' WHEN coalesce(m, 0) > 0 THEN 'medium' ELSE 'low' END AS tone,
  CASE WHEN q > 0 THEN regexp_replace(format('{:.2f}', bp / 100.0), '\\.?0+$', '') || '% of revenue concentrated in ' || CAST(q AS VARCHAR) || CASE WHEN q = 1 THEN ' customer' ELSE ' customers' END
  WHEN k > 0 THEN 'Material revenue dependency across ' || CAST(k AS VARCHAR) || ' named' || CASE WHEN k = 1 THEN ' customer' ELSE ' customers' END
  WHEN h > 0 THEN CAST(h AS VARCHAR) || ' high-risk counterparty relationships detected' WHEN m > 0 THEN 'Moderate dependency signals found in the report' ELSE 'No explicit high-risk counterparty concentration detected' END AS label
FROM (SELECT DISTINCT graph_id FROM graph_nodes) n LEFT JOIN (SELECT graph_id, count(*) FILTER (risk_flag = 'high' AND c) AS k, count(*) FILTER (risk_flag = 'high' AND c AND exposure_bp IS NOT NULL) AS q, sum(exposure_bp) FILTER (risk_flag = 'high' AND c) AS bp,
  count(*) FILTER (risk_flag = 'high') AS h, count(*) FILTER (risk_flag = 'medium') AS m FROM (SELECT *, coalesce(CASE WHEN source = 'T' THEN target_type ELSE source_type END = 'customer', false) AS c FROM ends) GROUP BY 1) USING (graph_id)""", GRAPH_SQL))  # fmt: skip
def _(led):
    return concentration.risk_verdict(led.graph_nodes, led.graph_edges)
