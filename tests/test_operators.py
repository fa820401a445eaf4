"""Operators on small vectors: cycles, orders of batches, buckets, caps, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import audit, entities, evaluate, evidence, evolve, facts, graph
from tallyweave.sources import graphs as graph_files
from tallyweave.sources import snapshots
from tallyweave.streaming import feed, store


def test_resolution_of_chains_cycles_and_branches(spark):
    ents = spark.createDataFrame([(i,) for i in range(1, 13)], "entity_id long")
    merges = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (4, 5, 1), (6, 7, 0), (7, 6, 0), (8, 6, 0), (9, 10, 0), (9, 11, 0), (10, 12, 0)], "from_id long, into_id long, reverted int")
    got = {r.entity_id: r.resolved_id for r in entities.resolve_entities(ents, merges).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 6, 9: 12, 10: 12, 11: 11, 12: 12}
    back = merges.withColumn("reverted", F.lit(1))
    assert all(r.entity_id == r.resolved_id for r in entities.resolve_entities(ents, back).collect())
    assert {r.entity_id for r in entities.entity_family(ents, merges, 3).collect()} == {1, 2, 3}


CLAIM = "ordinal long, doc_id long, source_entity_id long, target_entity_id long, relation_type string, quote_hash string"


def test_reconciliation_order_and_idempotence(spark):
    stored = spark.createDataFrame([(0, 1, 1, 2, "customer", "a"), (0, 1, 1, 3, "lender", "x")], CLAIM)
    new = spark.createDataFrame([(1, 1, 1, 2, "customer", "a"), (2, 1, 1, 2, "customer", "a"), (3, 1, 1, 2, "customer", "b"), (4, 1, 1, 9, "supplier", "c"), (5, 1, 1, 9, "supplier", "d"), (6, 1, 1, 9, "supplier", "c")], CLAIM)
    actions = evolve.reconcile_claims(new, stored)
    assert [r.action for r in actions.orderBy("ordinal").collect()] == ["exact", "repeat", "variant", "insert", "variant_pending", "repeat"]
    counts = evolve.reconciliation_counts(actions).first()
    assert (counts.relationship_existing, counts.exact_quote_skipped, counts.quote_variants, counts.new_claims) == (2, 3, 2, 1)
    more = stored.unionByName(actions.filter("action = 'insert'").select(stored.columns))
    assert evolve.reconcile_claims(new, more).filter("action = 'insert'").count() == 0
    assert evolve.append_claims(new, more).count() == 2 and evolve.append_claims(new, more.unionByName(new)).count() == 0


def test_quote_mismatch_buckets(spark):
    text = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " + "[[PAGE 1]] The company sells engines to many customers across the region every year. [[PAGE 2]] They also buy steel from one large supplier in the north of the country."
    docs = spark.createDataFrame([(1, text), (2, "Sr No Facility Limit 1 100 AB 2 200 CD 3 300 EF 4 400 GH Bank 5 500")], "doc_id long, text string")
    quotes = [(1, 1, "qqq www rrr"), (2, 1, "sells motors to many customers across the region each year"), (3, 1, "across the region every year They also buy steel from a big supplier"), (4, 2, "Facility Limit 1 100 XY 2 200 CD 9")]
    got = {r.quote_id: r for r in evidence.diagnose_rejected_quotes(spark.createDataFrame(quotes, "quote_id long, doc_id long, quote string"), docs).collect()}
    assert [got[k].bucket for k in (1, 2, 3, 4)] == ["not_found", "paraphrase", "cross_page", "table_derived"]
    assert got[1].score == 0 and (got[3].start_page, got[3].end_page) == (1, 2)


def test_best_window_equals_exhaustive_search(spark):
    import math
    import random
    from collections import Counter

    r = random.Random(0)
    text, quotes = [r.choice("abcdefgh") for _ in range(60)], [[r.choice("abcdefghx") for _ in range(n)] for n in (1, 3, 7, 10, 80)]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    rows = spark.createDataFrame([(k, 1, " ".join(q)) for k, q in enumerate(quotes)], "quote_id long, doc_id long, quote string")
    got = {x.quote_id: (round(x.score, 9), x.len, x.start) for x in evidence.best_windows(rows, docs).collect()}
    for k, q in enumerate(quotes):
        m, best = len(q), None
        for n in {n for n in (math.floor(m * 0.7), math.floor(m * 0.85), m - 1, m, m + 1, math.ceil(m * 1.15), math.ceil(m * 1.3)) if 0 < n <= 60}:
            for s in range(60 - n + 1):
                shared = sum((Counter(q) & Counter(text[s : s + n])).values())
                key = (-2 * shared / (m + n), abs(n - m), n, s)
                best = min(best, key) if best else key
        assert got.get(k, (0.0, best[2], best[3])) == (round(-best[0], 9), best[2], best[3])


def test_classification_precedence(spark):
    rows = [(1, "Key Rating Drivers. CRISIL has reaffirmed its rating"), (2, "has reaffirmed the credit rating"), (3, "Earnings call transcript; key rating drivers"), (4, "Rating rationale"), (5, "nothing"), (6, "the rpt schedule")]
    docs = spark.createDataFrame([(i, None, None, t) for i, t in rows], "doc_id long, title string, url string, text string")
    assert [r.doc_type for r in evidence.classify_documents(docs).orderBy("doc_id").collect()] == ["rating_rationale", "rating_intimation", "other", "rating_rationale", "other", "rpt_schedule"]


def test_sentence_context(spark):
    pages = spark.createDataFrame([(1, 0, 1, "One is here. Two is there! Three is far. Four."), (1, 1, 2, "Five. Six?")], "doc_id long, position int, page int, text string")
    claims = spark.createDataFrame([(1, 1, 1, "two is THERE"), (2, 1, 1, "One is"), (3, 1, 2, "absent"), (4, 1, None, "six")], "claim_id long, doc_id long, page int, quote string")
    got = [r.context for r in evidence.sentence_context(claims, pages).orderBy("claim_id").collect()]
    assert got[:3] == ["One is here. Two is there! Three is far.", "One is here. Two is there!", None] and "Six?" in got[3]


def test_graph_files(spark, tmp_path):
    good = {"target_company": "Acme Ltd", "rating": "A", "report_date": "March 09, 2026", "agency": "CARE", "verified": True, "nodes": [{"id": "t", "label": "Acme Ltd", "type": "target"}, {"id": "c", "label": "Big Bank", "type": "lender"}, {"id": "u", "label": "Top five customers", "type": "customer", "named": False}],
            "edges": [{"source": "c", "target": "t", "relation": "lends", "exposure_pct": 30.5, "risk_flag": "high", "source_quote": "q 1", "source_page": 1, "confidence": "high"}, {"source": "t", "target": "u", "relation": "sells", "exposure_pct": None, "risk_flag": None, "source_quote": "q 2", "source_page": 2, "confidence": "medium"}], "key_risks": ["one"]}
    bad = json.loads(json.dumps(good))
    bad["edges"][0] |= {"source": "nobody", "exposure_pct": 130}
    for name, g in (("acme", good), ("again", dict(reversed(good.items()))), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(g, indent=1))
    (tmp_path / "broken.json").write_text("{ not json")
    ok, rejects = graph_files.validate_graphs(graph_files.read_graphs(spark, str(tmp_path)))
    assert {r.graph_id for r in ok.collect()} == {"acme", "again"}
    assert {(r.graph_id, r.reason) for r in rejects.collect()} >= {("bad", "unknown_endpoint"), ("bad", "exposure_range"), ("broken", "unreadable")}
    keys = graph_files.graph_content_key(ok)
    assert keys.select("sha256").distinct().count() == 1
    ledger = graph_files.import_graphs_to_ledger(ok)
    assert {k: v.count() for k, v in ledger.items()} == {"companies": 1, "documents": 1, "entities": 3, "aliases": 2, "claims": 2}
    assert {r.relation_type for r in ledger["claims"].collect()} == {"lender", "unnamed_dependency"}
    assert graph_files.import_graphs_to_ledger(ok, keys)["claims"].count() == 0


def test_group_structure_cap(spark):
    nodes = spark.createDataFrame([("g", "t", "T", "target", True, 0)] + [("g", f"s{i}", f"S{i}", "subsidiary", True, i + 1) for i in range(7)], "graph_id string, node_id string, label string, type string, named boolean, node_no int")
    edges = spark.createDataFrame([("g", i, "t", f"s{i}", "owns", 100 if i == 6 else None, None, "quote", "medium") for i in range(7)], "graph_id string, edge_no int, source string, target string, relation string, exposure_bp long, risk_flag string, quote string, confidence string")
    kept, report = graph.cap_group_structure(nodes, edges, reported=spark.createDataFrame([("g", 29)], "graph_id string, total long"))
    assert sorted(r.edge_no for r in kept.collect()) == [0, 1, 2, 3, 6]
    assert tuple(report.first()) == ("g", 29, 7, 2)
    assert graph.needs_second_pass(graph.relation_type_counts(nodes, edges)).first().needs_second_pass
    twisted = edges.withColumn("target", F.when(F.col("edge_no") == 0, "S-0").when(F.col("edge_no") == 1, "zzzzzz").otherwise(F.col("target")))
    fixed = graph.repair_graph(nodes.unionByName(nodes.filter("node_no = 3").withColumn("node_no", F.lit(9))), twisted, threshold=0.6)
    assert {k: v.count() for k, v in fixed.items()} == {"nodes": 7, "edges": 6, "repairs": 1, "drops": 1, "unlinked": 1, "duplicates": 1}


def test_failure_bursts(spark):
    times = ["00:00:00", "00:00:10", "00:00:20", "00:00:30", "00:01:00", "00:01:00.001"]
    rows = spark.createDataFrame([("k", f"2024-01-01 {t}") for t in times], "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.tripped for r in facts.failure_bursts(rows, "key").orderBy("ts").collect()] == [False, False, False, False, False, True]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, "customer", "a"), (1, "customer", "b")], "doc_id long, relation_type string, identity string")
    found = spark.createDataFrame([(1, "customer", "a"), (1, "customer", "c")], gold.schema)
    row = evaluate.relationship_metrics(gold, found).first()
    assert (row.tp, row.fp, row.fn, row.precision, row.recall) == (1, 1, 1, 0.5, 0.5)


def test_snapshot_round_trip(spark, tmp_path):
    tables = {"a": spark.createDataFrame([(1, "x"), (2, None)], "i long, s string"), "b": spark.createDataFrame([], "d date")}
    snapshots.ledger_snapshot(tables, str(tmp_path / "s"))
    back = snapshots.ledger_restore(spark, str(tmp_path / "s"), {"a": tables["a"].limit(0)})
    assert list(back) == ["a", "b"] and audit.multiset_difference(tables["a"], back["a"]).count() == 0 and back["b"].schema == tables["b"].schema
    with pytest.raises(ValueError):
        snapshots.ledger_restore(spark, str(tmp_path / "s"), {"a": tables["a"]})
    part = next(p for p in (tmp_path / "s" / "a").glob("*.json") if "x" in p.read_text())
    part.write_text(part.read_text().replace("x", "y"))
    (tmp_path / "s" / "a" / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="not as written: a"):
        snapshots.ledger_restore(spark, str(tmp_path / "s"))


PAYLOADS = [
    {"NEWSID": "n1", "SCRIP_CD": 500, "SLONGNAME": "Acme Ltd-$", "NEWSSUB": "Credit Rating", "DT_TM": "2024-01-02T10:00:00Z", "ATTACHMENTNAME": "a.pdf"},
    {"NEWS_ID": "n2", "SCRIP_CODE": "500", "COMPANYNAME": "Other Ltd", "HEADLINE": "CRISIL", "NEWS_DT": "20240102", "ATTACHMENT": "/x.pdf"},
    {"ANNOUNCEMENT_ID": 3, "SCRIPCODE": "500", "SCRIP_NAME": "ACME LIMITED", "SUBJECT": "Board meeting", "NEWS_DATE": "2024-01-03"},
    {"NEWSID": "n1", "SCRIP_CD": 500, "SLONGNAME": "Acme Ltd", "NEWSSUB": "ICRA", "DT_TM": "2024-01-02T10:00:00Z", "ATTACHMENTNAME": "a.pdf"},
    {"SCRIP_CD": 500},
]


def test_feed_as_batch_and_as_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, p in enumerate(PAYLOADS):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(p))
    companies = spark.createDataFrame([(1, "Acme Limited", "500")], "company_id long, name string, scrip_code string")
    read = lambda lines: feed.announcement_stream(feed.read_announcements(lines.select(F.col("value").alias("payload")))[0], companies).withColumn("source", F.lit("bse"))
    batch = read(spark.read.text(str(tmp_path / "in")))
    assert {(r.external_id, r.status) for r in batch.collect()} == {("n1", "linked"), ("n2", "failed"), ("3", "ignored")}
    assert feed.read_announcements(spark.read.text(str(tmp_path / "in")).select(F.col("value").alias("payload")))[1].count() == 1

    stream = read(spark.readStream.schema("value string").text(str(tmp_path / "in")))
    log = str(tmp_path / "log")
    stream.writeStream.foreachBatch(lambda df, i: store.append_batch(df, i, log)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{log}/delta").drop("batch")
    assert audit.multiset_difference(batch.select("external_id", "status", "headline"), rows.select("external_id", "status", "headline")).count() == 0
    latest = feed.latest_announcements(rows.select("source", "external_id", "batch_id", "row_no", "status", "headline"))
    assert {(r.external_id, r.status) for r in latest.collect()} == {("n1", "linked"), ("n2", "failed"), ("3", "ignored")}

    docs = feed.discover_documents(stream)
    docs.writeStream.format("memory").queryName("found_docs").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert {r.sha256 for r in spark.table("found_docs").collect()} == {r.sha256 for r in feed.discover_documents(batch).collect()}


def test_only_rejected_pairs_of_copies_go(spark):
    copies = {"alpha": (1, 2, 3, 4), "bravo": (11, 12, 13, 14), "delta": (21, 22, 23, 24), "gamma": (31, 32), "omega steel works": (41, 42), "omega steel works north": (45, 46)}
    usage = spark.createDataFrame([(i, key, 1) for key, ids in copies.items() for i in ids], "id long, key string, claims long")
    rejected = spark.createDataFrame([(2, 1), (11, 12), (11, 13), (21, 22), (21, 23), (24, 21), (31, 32), (45, 41)], "a long, b long")
    got = {(r.left_id, r.right_id) for r in entities.duplicate_candidates(usage, rejections=rejected).collect()}
    assert got == {(1, 3), (1, 4), (2, 3), (11, 14), (12, 14), (13, 14), (22, 23), (22, 24), (23, 24), (41, 42), (45, 46), (41, 46)}


def test_link_and_unnamed_nodes(spark):
    nodes = spark.createDataFrame([(1, "a", "Acme Ltd", True), (1, "b", "Beta", None), (1, "c", "Gamma", True), (2, "a", "ACME", True), (2, "u", "Top customers", False)], "doc_id long, node_id string, label string, named boolean")
    aliases = spark.createDataFrame([("beta", "e1"), ("gamma", "e2"), ("gamma", "e3")], "key string, entity_key string")
    known = spark.createDataFrame([("e4", "gamma")], "entity_key string, normalized_name string")
    links, new, fresh = entities.link_nodes_to_entities(nodes, aliases, known)
    assert {(r.doc_id, r.node_id): r.entity_key for r in links.collect()} == {(1, "a"): "new:acme", (1, "b"): "e1", (1, "c"): "e4", (2, "a"): "new:acme", (2, "u"): "unnamed:2:u"}
    assert {r.entity_key for r in new.collect()} == {"new:acme", "unnamed:2:u"} and {r.entity_key for r in fresh.collect()} == {"new:acme", "e4"}
