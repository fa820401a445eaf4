"""Registered queries of the column expressions and of what other queries read only in part, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from ..operators import entities
from .evidence_queries import FORM, ORACLES, QUERIES, query  # noqa: F401
from .ledger_queries import CANDIDATES, _part_names
from .project import with_ledger


def _choose(number: Column, *values: Column) -> Column:
    """The value at the number's remainder."""
    return F.element_at(F.array(*values), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


@query("X1_rejoin_acronyms", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'ABC ' || c_name WHEN 1 THEN c_name || ' BLW' ELSE c_name END AS name FROM customer")
def _(led):
    name = _choose(F.col("c_custkey"), F.concat(F.lit(" A B C "), "c_name"), F.concat("c_name", F.lit(" BL  W ")), F.col("c_name"))
    return led.table("customer").select(F.col("c_custkey").alias("id"), exprs.rejoin_acronyms(name).alias("name"))


@query("X2_name_key", "SELECT c_custkey AS id, lower(c_name) || CASE WHEN c_custkey % 4 = 1 THEN ' india' ELSE '' END AS key FROM customer")
def _(led):
    name = _choose(F.col("c_custkey"), F.concat("c_name", F.lit(" India Pvt. Ltd.")), F.concat("c_name", F.lit(" India")), F.concat(F.lit(" "), "c_name", F.lit("  PRIVATE  LIMITED ")), F.concat("c_name", F.lit(" & Co., Inc.")))
    return led.table("customer").select(F.col("c_custkey").alias("id"), exprs.name_key(name).alias("key"))


@query("X3_quote_form", f"SELECT doc_id, md5({FORM.format('text')}) AS form FROM documents")
def _(led):
    """Texts behind a page marker and a soft hyphen, with curly quotes that become straight and are cut away again."""
    marked = F.concat(F.lit("[[ Page 3 ]]\u00ad"), "text", F.lit("\u00a0\ufeff"))
    return led.texts.select("doc_id", F.md5(exprs.quote_form(marked)).alias("form"))


@query("X5_reference_form", "SELECT doc_id, md5(trim(regexp_replace(replace(strip_accents(lower(text)), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))) AS form FROM documents")
def _(led):
    return led.texts.select("doc_id", F.md5(exprs.reference_form(F.col("text"))).alias("form"))


@query("X6_similarity", """WITH p AS (SELECT c_custkey AS id, lower(c_name) AS a, lower(CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || ' works' WHEN 2 THEN 'of ' || substring(c_name, 1, 14) || ' x' ELSE reverse(c_name) END) AS b FROM customer),
w AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y, greatest(length(a), length(b)) AS longer, least(length(a), length(b)) AS shorter FROM p)
SELECT id, round(CASE WHEN a = b THEN 1.0 ELSE greatest(1 - levenshtein(a, b) / longer, len(list_intersect(x, y)) / len(list_distinct(x || y)), CASE WHEN shorter >= 4 AND (contains(a, b) OR contains(b, a)) THEN 0.8 + 0.2 * shorter / longer ELSE 0 END) END, 6) AS similarity FROM w""")
def _(led):
    other = _choose(F.col("c_custkey"), F.col("c_name"), F.concat("c_name", F.lit(" works")), F.concat(F.lit("of "), F.substring("c_name", 1, 14), F.lit(" x")), F.reverse("c_name"))
    rows = led.table("customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("a"), F.lower(other).alias("b"))
    return rows.select("id", F.round(exprs.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("X7_substance_score", with_ledger(f"SELECT claim_id, CASE WHEN rn % 2 = 0 THEN 100 ELSE 0 END + CASE WHEN rn % 3 = 0 THEN 60 ELSE 0 END + CASE WHEN rn = 1 THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(relation_type || ' ' || quote), '{vocab.SUBSTANCE}') THEN 30 ELSE 0 END AS score FROM claims"))
def _(led):
    rn = F.col("rn")
    score = exprs.substance_score(F.col("relation_type"), F.col("quote"), F.when(rn % 2 == 0, rn), F.when(rn % 3 == 0, "high").when(rn % 3 == 1, ""), F.when(rn == 1, "high").otherwise("medium"))
    return led.claims.select("claim_id", score.alias("score"))


@query("X9_issuer_name", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN s_name || ' Ltd' WHEN 1 THEN s_name || ' Works-$' ELSE s_name || ' Co.' END AS name FROM supplier")
def _(led):
    name = _choose(F.col("s_suppkey"), F.concat("s_name", F.lit(" Ltd-$")), F.concat("s_name", F.lit(" Works-$")), F.concat(F.lit(" "), "s_name", F.lit(" Co. - # ")))
    return led.table("supplier").select(F.col("s_suppkey").alias("id"), exprs.issuer_name(name).alias("name"))


@query("X10_feed_date", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) - INTERVAL 330 MINUTE WHEN 1 THEN date_trunc('second', ts) - INTERVAL 120 MINUTE END AS at FROM events")
def _(led):
    value = _choose(F.col("event_id"), F.date_format("ts", "yyyyMMdd"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), F.lit("soon"))
    return led.table("events").select(F.col("event_id").alias("id"), exprs.feed_date(value).cast("timestamp_ntz").alias("at"))


@query("X11_attachment_url", f"""WITH u AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'HTTPS://other.example/' || event_id WHEN 1 THEN '{vocab.FEED_SITE}/x/' || event_id WHEN 2 THEN '{vocab.FEED_SITE}/xml-data/corpfiling/AttachHis/' || event_id WHEN 3 THEN '{vocab.FEED_SITE}/xml-data/corpfiling/AttachLive/' || event_id END AS url FROM events)
SELECT id, url, CASE id % 5 WHEN 2 THEN replace(url, 'AttachHis', 'AttachLive') WHEN 3 THEN replace(url, 'AttachLive', 'AttachHis') END AS alternate FROM u""")
def _(led):
    name = F.col("event_id").cast("string")
    value = _choose(F.col("event_id"), F.concat(F.lit("HTTPS://other.example/"), name), F.concat(F.lit("/x/"), name), F.concat(F.lit("xml-data/corpfiling/AttachHis/"), name), name, F.lit(None).cast("string"))
    rows = led.table("events").select(F.col("event_id").alias("id"), exprs.attachment_url(value).alias("url"))
    return rows.withColumn("alternate", exprs.alternate_attachment_url(F.col("url")))


@query("X12_display_text", with_ledger("SELECT claim_id, CASE WHEN exposure_bp % 100 = 0 THEN CAST(exposure_bp // 100 AS VARCHAR) ELSE CAST(exposure_bp // 100 AS VARCHAR) || '.5' END AS percent, CASE rn % 3 WHEN 0 THEN 'Financed by Y' WHEN 1 THEN 'Customer of X' ELSE 'Relationship with Y' END AS seen FROM (SELECT claim_id, rn, (claim_id % 101) * 100 + (claim_id % 2) * 50 AS exposure_bp FROM claims)"))
def _(led):
    rn, n = F.col("rn"), F.col("claim_id")
    percent = exprs.percent_text((n % 101 * 100 + n % 2 * 50) / 100)
    seen = exprs.perspective(F.when(rn % 3 == 1, "customer").otherwise("target"), F.when(rn % 3 == 0, "lender").otherwise("stranger"), F.lit("Y"), F.lit("X"))
    return led.claims.select("claim_id", percent.alias("percent"), seen.alias("seen"))


#: All wordings of either side, and a type that has none, by the number of a claim.
OURS, THEIRS = list(vocab.SEEN_BY_TARGET.items()), list(vocab.SEEN_BY_OTHERS.items())
SEEN = [t.replace("%s", "Y") for _, t in OURS] + [t.replace("%s", "X") for _, t in THEIRS] + ["Relationship with Y", "Relationship with X"]


@query("X12_perspectives", with_ledger(f"SELECT claim_id, [{', '.join(chr(39) + t + chr(39) for t in SEEN)}][CAST(claim_id % {len(SEEN)} AS INT) + 1] AS seen FROM claims"))
def _(led):
    kinds = [("target", k) for k, _ in OURS] + [(k, "target") for k, _ in THEIRS] + [("target", "stranger"), ("stranger", "target")]
    own, other = (_choose(F.col("claim_id"), *[F.lit(k[i]) for k in kinds]) for i in (0, 1))
    return led.claims.select("claim_id", exprs.perspective(own, other, F.lit("Y"), F.lit("X")).alias("seen"))


RATINGS = ["[ICRA]A+ (Stable)", "[icra] AA-; Stable", "ICRA  BBB (stable) / A2", "CRISIL A ; stable", "", None, "BB+"]
RATED = f"""SELECT claim_id, r, CASE WHEN k < 4 THEN 'ICRA' END AS agency, CASE claim_id % 3 WHEN 0 THEN strftime(published_date, '%Y-%m-%d') WHEN 1 THEN 'last year' END AS raw, published_date, claim_id % 3 AS d
FROM (SELECT claim_id, claim_id % 5 AS k, published_date, [{', '.join('NULL' if r is None else chr(39) + r + chr(39) for r in RATINGS)}][CAST(claim_id % 7 AS INT) + 1] AS r FROM claims JOIN led_documents USING (doc_id))"""


@query("X12_provenance", with_ledger(rf"""SELECT claim_id, CASE WHEN coalesce(r, '') = '' THEN 'Rating not stated' || CASE WHEN agency IS NOT NULL THEN ' · ICRA' ELSE '' END ELSE
  trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN starts_with(lower(r), '[icra]') AND agency IS NOT NULL THEN 'ICRA ' || substr(r, 7) WHEN agency IS NOT NULL AND NOT starts_with(lower(r), 'icra') THEN 'ICRA ' || r ELSE r END, '\s*;\s*stable', '/Stable', 'gi'), '\s*\(stable\)', '/Stable', 'gi'), '\s+', ' ', 'g')) END
  || ' · rated ' || CASE d WHEN 0 THEN strftime(published_date, '%d %b %Y') WHEN 1 THEN 'last year' ELSE 'report date not stated' END AS line FROM ({RATED})"""))  # fmt: skip
def _(led):
    n = F.col("claim_id")
    rating = _choose(n, *[F.lit(r).cast("string") for r in RATINGS])
    raw = _choose(n, F.date_format("published_date", "yyyy-MM-dd"), F.lit("last year"), F.lit(None).cast("string"))
    rows = led.claims.join(led.documents.select("doc_id", "published_date"), "doc_id")
    return rows.select("claim_id", exprs.provenance(rating, F.when(F.pmod(n, F.lit(5)) < 4, "ICRA"), raw).alias("line"))


@query("X13_relationship_identity", with_ledger("SELECT claim_id, 'company ' || CAST(company_id AS VARCHAR) || chr(31) || 'party ' || CAST(target_entity_id AS VARCHAR) || chr(31) || relation_type || chr(31) || CASE WHEN rn % 2 = 0 THEN CAST(rn AS VARCHAR) || '.50' ELSE 'none' END AS identity FROM claims"))
def _(led):
    ends = [F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b)) for a, c, b in (("Company ", "company_id", " Ltd."), ("PARTY  ", "target_entity_id", " India Limited"))]
    return led.claims.select("claim_id", exprs.relationship_identity(*ends, F.col("relation_type"), F.when(F.col("rn") % 2 == 0, F.col("rn") + 0.5)).alias("identity"))


@query("X14_retryable_error", "SELECT event_id AS id, event_id % 6 IN (0, 2, 4) AS retryable FROM events")
def _(led):
    n = F.col("event_id")
    code = _choose(n, F.lit("ECONNRESET"), F.lit("EACCES"), *[F.lit(None).cast("string")] * 4)
    status = _choose(n, F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(503), F.lit(404), F.lit(None).cast("int"), F.lit(429))
    message = _choose(n, *[F.lit("no")] * 4, F.lit("read: Socket Hang Up"), F.lit(None).cast("string"))
    return led.table("events").select(n.alias("id"), exprs.retryable_error(code, status, message).alias("retryable"))


@query("X14_nested_causes", "SELECT event_id AS id, event_id % 5 IN (0, 2) OR (event_id % 5 = 4 AND event_id % 7 < 5) AS retryable FROM events")
def _(led):
    """An error whose cause tells: a code, a code that hides a good one, a status, nothing, a message at a depth."""
    n, error = F.col("event_id"), "struct<code: string, status: int, message: string>"
    made = lambda code=None, status=None, message=None: F.struct(F.lit(code).alias("code"), F.lit(status).alias("status"), F.lit(message).alias("message")).cast(error)
    plain = made(message="fetch failed")
    deep = F.concat(F.array_repeat(plain, F.pmod(n, F.lit(7)).cast("int")), F.array(made(message="Socket hang up")))
    chain = _choose(n, F.array(plain, made(code="ECONNRESET")), F.array(made(code="EOTHER"), made(code="ECONNRESET")), F.array(plain, plain, made(status=503)), F.array(plain, made(status=404)), deep)
    return led.table("events").select(n.alias("id"), exprs.retryable_chain(chain).alias("retryable"))


@query("X15_token_telemetry", "SELECT event_id AS id, event_id % 12001 >= 10800 AS near_ceiling, round((event_id % 12001) * 0.000015 + (event_id % 977) * 0.000003, 6) AS cost FROM events")
def _(led):
    n = F.col("event_id")
    rows = led.table("events").select(n.alias("id"), (n % 12001).alias("used"), (n % 977).alias("read"))
    return rows.select("id", exprs.near_token_ceiling(F.col("used"), F.lit(12000)).alias("near_ceiling"), F.round(exprs.token_cost(F.col("read"), F.col("used"), 3.0, 15.0), 6).alias("cost"))


SUGGESTED = CANDIDATES[: CANDIDATES.rindex("SELECT least(x, y)")] + """SELECT l AS left_id, r AS right_id, CASE WHEN a.claims > b.claims OR (a.claims = b.claims AND (a.key < b.key OR (a.key = b.key AND l < r))) THEN l ELSE r END AS suggested
FROM (SELECT least(x, y) AS l, greatest(x, y) AS r FROM found) JOIN keyed a ON a.id = l JOIN keyed b ON b.id = r"""


@query("E7_suggest_canonical", SUGGESTED)
def _(led):
    """Which of two candidates stays: the one with more claims, else the smaller id."""
    usage = _part_names(led).withColumn("key", exprs.name_key(F.col("name")))
    return entities.duplicate_candidates(usage).select("left_id", "right_id", "suggested")
