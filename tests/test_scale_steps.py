"""Steps that many queries share: what they read, and how often."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import exprs
from tallyweave.operators import audit, entities, evidence
from tallyweave.plans import evidence_queries, ledger_queries, project
from tallyweave.plans.project import Ledger
from tallyweave.sources import graphs as graph_files

SF = "/root/testdata/sf0.001"


def scans(df, table: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(table)


def test_sales_of_claims_and_documents_are_joined_once(spark):
    led = Ledger(spark, SF)
    rows = led.claims.join(led.documents, "doc_id")
    assert not any("lineitem" in f or "orders" in f for f in rows.inputFiles())
    assert led.ranked.count() == led.ranked.filter("rn <= 6").count() == led.claims.count() > 0


def test_sums_and_places_of_a_year_share_one_shuffle(spark):
    plan = Ledger(spark, SF, once=False).claims._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "orderkey" not in line]
    assert len(keyed) == 1


def test_no_shuffle_of_sales_carries_the_year(spark):
    plan = Ledger(spark, SF, once=False).claims._jdf.queryExecution().optimizedPlan().toString()
    head, below = plan.split("RepartitionByExpression", 1)
    assert "AS yr" in head and "AS yr" not in below


def test_shuffles_of_sales_carry_supplier_and_day_as_one_number(spark):
    plan = Ledger(spark, SF, once=False).claims._jdf.queryExecution().optimizedPlan().toString()
    shuffled = plan.split("RepartitionByExpression", 1)[1].splitlines()[1]
    assert shuffled.split("Project [")[1].split("]")[0].count(",") == 2  # both, cust, cents
    rows = [(7, "1999-12-31"), (0, "0001-01-01"), (-3, "9999-12-31"), ((1 << 41) - 1, "1970-01-01"), (5, None), (None, "1969-12-31"), (None, None)]
    df = spark.createDataFrame(rows, "supplier long, day string").withColumn("day", F.col("day").cast("date"))
    back = df.select(project.supplier_day(F.col("supplier"), F.col("day")).alias("both")).select(project.supplier_of(F.col("both")), project.day_of(F.col("both")).cast("string"))
    assert [tuple(r) for r in back.collect()] == rows
    with pytest.raises(Exception, match="do not fit"):
        spark.range(1).select(project.supplier_day(F.lit(1 << 41), F.current_date())).collect()


def test_pages_of_a_text_are_cut_where_it_lies_and_not_broadcast(spark):
    assert "Exchange" not in evidence_queries.QUERIES["T1_split_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pages = spark.createDataFrame([(1, 0, None, "Zero. "), (1, 1, 1, "One. Two. Three. Four. "), (2, 0, 7, "Seven. Two.")], "doc_id long, position int, page int, text string")
    claims = spark.createDataFrame([(1, 1, 1, "Two."), (2, 1, 9, "One."), (3, 1, None, "Zero."), (4, 2, 7, "absent"), (5, 3, 1, "Two.")], "claim_id long, doc_id long, page int, quote string")
    got = evidence.sentence_context(claims, pages)
    assert {r.claim_id: r.context for r in got.collect()} == {1: "One. Two. Three.", 2: "Zero. One. Two.", 3: "Zero. One.", 4: None, 5: None}
    assert not any("BroadcastExchange" in line and "text" in line for line in got._jdf.queryExecution().executedPlan().toString().splitlines())


def test_ranks_hold_only_what_orders_them(spark):
    df = ledger_queries.QUERIES["L7_rank_by_specificity"](spark, SF)
    names = {c for f in df.inputFiles() for c in spark.read.parquet(f).columns}
    assert "counterparty_specificity" in names and not names & {"quote", "company", "agency", "entity_label"}


def test_multiset_difference_reads_each_side_once(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "id long, name string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (2, None), (4, "y")], "id long, name string")
    got = audit.multiset_difference(a, b)
    assert Counter(map(tuple, got.collect())) == Counter([(1, "x", "left"), (3, "y", "left"), (2, None, "right"), (2, None, "right"), (4, "y", "right")])
    assert scans(got, "LogicalRDD") + scans(got, "LocalRelation") == 2


def test_words_of_many_texts_are_held_some_at_a_time(spark):
    import pyarrow as pa

    texts = ["Wörd two[[PAGE 2]] x\u0301 " * 3000, None, "", "a b", "\u0301"] * 100
    parts = list(exprs.text_words.func(iter([pa.array(texts)])))
    assert sum(map(len, parts)) == len(texts)
    assert max(len(p.flatten()) for p in parts) <= exprs.WORDS_OF_CHARS
    rows = [r for p in parts[-2:] for r in p.to_pylist()][-5:]
    assert len(rows[0]) == 9000 and rows[1:] == [[], [], [{"token": "a", "word": "a", "gap": " ", "page": None}, {"token": "b", "word": "b", "gap": "", "page": None}], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    got = df.selectExpr("id", "text").select("id", exprs.text_words("text")["token"].alias("w")).collect()
    assert [len(r.w) for r in sorted(got)] == [9000, 0, 0, 2, 0] * 100


@pytest.mark.parametrize("name", ["T4_long_quotes", "T4_diagnose_rejected_quotes", "A8_mismatch_bucket_counts"])
def test_rejected_quotes_shuffle_texts_once_and_no_words(spark, name):
    df = evidence_queries.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffles = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert 2 <= len(shuffles) <= 5 and all(re.match(r"doc_id#\d+L?(, bucket#\d+)?, \d+\)", s) for s in shuffles)
    assert "Window" not in plan and all(f.endswith("/documents.parquet") for f in df.inputFiles())


def test_windows_of_many_quotes_are_held_some_at_a_time(spark):
    import pyarrow as pa

    texts = ["[[page 1]] one two three four. " * 10_000 + "Fünf six[[page 2]]", None, "", "\u0301", "a b"] * 20
    quotes = ["six fuenf FÜNF", "x", "x", "x", None] * 20
    parts = list(exprs.best_window.func(iter([(pa.array(quotes), pa.array(texts))])))
    rows = [r for p in parts for r in p.to_pylist()]
    assert len(parts) >= 10 and len(rows) == 100 and rows == rows[:5] * 20
    assert (rows[0]["len"], rows[0]["start"], rows[0]["first"], rows[0]["quote"]) == (2, 40_000, 39_994, ["six", "fuenf", "funf"])
    assert [(w["token"], w["word"], w["gap"], w["page"]) for w in rows[0]["words"][-3:]] == [("four", "four", ". ", 1), ("funf", "Fünf", " ", 1), ("six", "six", "", 1)]
    assert [(r["score"], r["words"]) for r in rows[1:5]] == [(None, [])] * 4


def test_every_rejected_quote_has_one_diagnosis(spark):
    docs = spark.createDataFrame([(1, "We sell engines to many customers in the region"), (2, None), (3, "")], "doc_id long, text string")
    quotes = [(1, 1, "sell engines to many customers"), (1, 1, "sell engines to many customers"), (2, 1, None), (3, 1, "..."), (4, 2, "sell"), (5, 3, "sell"), (6, 9, "sell"), (7, None, "sell"), (8, 1, "many sold pumps")]
    rows = spark.createDataFrame(quotes, "quote_id long, doc_id long, quote string")
    got = sorted((r.quote_id, r.bucket, r.score) for r in evidence.diagnose_rejected_quotes(rows, docs).collect())
    assert got == [(1, "paraphrase", 1.0)] * 2 + [(k, "not_found", 0.0) for k in range(2, 8)] + [(8, "paraphrase", 0.4)]
    assert evidence.best_windows(rows, docs).count() == 3


def test_many_graphs_share_a_file(spark, tmp_path):
    graphs = evidence_queries._nested(Ledger(spark, SF)).drop("_corrupt_record")
    graph_files.write_graph_lines(graphs.coalesce(2), str(tmp_path / "lines"))
    files = list((tmp_path / "lines").rglob("*.json"))
    (tmp_path / "lines" / "broken.json").write_text('{"graph_id": "x", "nodes": [\n')
    back = graph_files.read_graph_lines(spark, str(tmp_path / "lines"))
    got = {r.graph_id: r for r in back.collect()}
    want = graphs.collect()
    assert len(files) <= 2 < len(want) == len(got) - 1
    assert [r.graph_id for r in got.values() if r._corrupt_record is not None] == [g for g in got if g not in {str(w.graph_id) for w in want}]
    assert all(got[str(w.graph_id)][c] == w[c] for w in want for c in ("target_company", "report_date", "nodes", "key_risks")) and all(len(got[str(w.graph_id)].edges) == len(w.edges) for w in want)
    read = evidence_queries.QUERIES["S1_read_graphs"](spark, SF)
    assert len(read.inputFiles()) < read.count()


def test_entities_are_not_sent_to_curated_names(spark):
    groups = spark.createDataFrame([("red widget inc", "Red Widget")], "raw string, canonical string")
    rows = spark.range(1000).selectExpr("id", "concat('Red Widget ', id) AS name", "1L AS claims", "concat('red widget ', id) AS key")
    plan = entities.seed_alias_groups(groups, rows)._jdf.queryExecution().optimizedPlan().toString()
    hints = [line for line in plan.splitlines() if "Join Inner" in line]
    assert hints and all("strategy=broadcast" in line and "rightHint" in line for line in hints)
