"""The stored feed as a stream: late rows aside, replays, compaction, and the state of polls."""

import datetime

from pyspark.sql import functions as F

from tallyweave.operators import audit, evolve
from tallyweave.streaming import feed, store

DAY = datetime.datetime(2024, 5, 1)
SCHEMA = "source string, external_id string, announced timestamp, status string"


def rows(spark, *items):
    """Items (id, hours after the first of May, status)."""
    return spark.createDataFrame([("bse", i, DAY + datetime.timedelta(hours=h), s) for i, h, s in items], SCHEMA)


BATCHES = [
    [("a", 100, "linked"), ("b", 90, "failed"), ("c", 101, "ignored")],
    [("a", 102, "failed"), ("old", 70, "linked"), ("edge", 77, "linked")],  # a day before 101 is 77
    [],
    [("b", 150, "linked"), ("c", 126, "failed"), ("x", 10, "failed")],  # late is what lies before 102 less a day
    [("a", 160, "ignored")],
]


def state(spark, folder):
    return {(r.external_id, r.status) for r in store.stored_announcements(spark, folder).collect()}


def test_on_time_and_late_rows_add_up_however_batches_come(spark, tmp_path):
    once, again = str(tmp_path / "once"), str(tmp_path / "again")
    for k, items in enumerate(BATCHES):
        store.append_batch(rows(spark, *items), k, once)
    for k in (0, 1, 0, 1):
        store.append_batch(rows(spark, *BATCHES[k]), k, again)
    assert store.compact(spark, again) == 1
    for k in (1, 0, 2, 3, 3, 2):
        store.append_batch(rows(spark, *BATCHES[k]), k, again)
    assert store.compact(spark, again) == 3 and store.compact(spark, again) == 3
    for k in (3, 4, 4):
        store.append_batch(rows(spark, *BATCHES[k]), k, again)
    want = {("a", "ignored"), ("b", "linked"), ("c", "failed"), ("edge", "linked")}
    assert state(spark, once) == state(spark, again) == want
    for folder in (once, again):
        assert {r.external_id for r in store.stored_late_rows(spark, folder).collect()} == {"old", "x"}
    assert not list((tmp_path / "again" / "delta").glob("batch=[0-3]")) and len(list((tmp_path / "again" / "base").glob("upto=*"))) == 1
    polls = store.polls(spark, again)
    assert {(r.batch_id, r.rows, r.late) for r in polls.collect()} == {(0, 3, 0), (1, 3, 1), (2, 0, 0), (3, 3, 1), (4, 1, 0)}
    assert feed.feed_watermark(polls).first().watermark == DAY + datetime.timedelta(hours=160)


def test_a_stream_keeps_every_row_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, items in enumerate(BATCHES):
        rows(spark, *items).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    folder = str(tmp_path / "store")
    stream.writeStream.foreachBatch(lambda df, i: store.append_batch(df, i, folder)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    both = spark.read.parquet(f"{folder}/delta").select("external_id", "announced").unionAll(store.stored_late_rows(spark, folder).select("external_id", "announced"))
    given = rows(spark, *[x for items in BATCHES for x in items]).select("external_id", "announced")
    assert audit.multiset_difference(both, given).count() == 0


def test_watermark_of_empty_failed_and_backfilling_polls(spark):
    at = lambda h: DAY + datetime.timedelta(hours=h)
    polls = [
        ("dated", 0, at(1), False, False, at(5)), ("dated", 1, None, False, False, at(9)), ("dated", 2, at(50), True, False, at(10)), ("dated", 3, at(60), False, True, at(11)),
        ("empty", 0, None, True, False, at(3)), ("empty", 1, None, False, False, at(7)), ("empty", 2, at(4), False, False, at(8)),
        ("never", 0, at(2), True, False, at(30)),
    ]
    got = {r.source: (r.watermark, r.since) for r in feed.feed_watermark(spark.createDataFrame(polls, "source string, batch_id long, max_date timestamp, failed boolean, backfill boolean, at timestamp")).collect()}
    assert got == {"dated": (at(1), at(1)), "empty": (at(7), at(7)), "never": (None, at(6))}


def test_health_of_one_source_over_many_ranges(spark):
    outcome = lambda i: "block" if i % 97 == 0 else "success" if i % 13 == 5 and i < 400 else "failure"
    log = [("s" if i % 4 else "t", DAY + datetime.timedelta(minutes=40 * i), outcome(i), i % 3 > 0) for i in range(900)]
    polls = spark.createDataFrame(log, "source string, at timestamp, outcome string, mapped boolean").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r.source, r["at"]): (r.failures, r.disabled_until, r.skip) for r in feed.feed_health(polls).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for source in "st":
        own, failures, until = [x for x in log if x[0] == source], 0, None
        for x, after in zip(own, [*own[1:], None]):
            failures = failures + 1 if x[2] == "failure" else 0
            until = x[1] + datetime.timedelta(days=1) if x[2] == "block" else until
            skip = None if x[3] else "no_mapped_companies"
            skip = "circuit_open" if failures >= 3 else skip
            if after and (after[1] - x[1]).total_seconds() < 1800:
                skip = "poll_interval"
            if after and until and after[1] < until:
                skip = "disabled_until"
            assert got[(source, x[1])] == (failures, until, skip), x


def test_chains_of_versions(spark):
    links = [(1, 2), (2, 3), (3, None), (4, None), (5, 6), (6, 7), (7, 5), (8, 9), (9, None), (10, 9)]
    got = {r[0]: tuple(r[1:]) for r in evolve.supersession_chains(spark.createDataFrame(links, "claim_id long, superseded_by long")).collect()}
    assert got[1] == (1, 3, 1, 3, False) and got[2] == (1, 3, 2, 3, False) and got[3] == (1, 3, 3, 3, False) and got[4] == (4, 4, 1, 1, False)
    assert got[5] == (None, None, None, None, True) and got[9] == (8, 9, 2, 2, False) and got[10] == (10, 9, 1, 2, False)


def test_reports_by_sketches(spark):
    from tallyweave.operators import corpus

    rel = spark.range(60_000).select((F.col("id") % 3).alias("entity_id"), (F.col("id") % 7_000).alias("doc_id"))
    batches = [corpus.report_sketches(rel.filter(F.col("doc_id") % 4 == k)) for k in range(4)]
    ents = spark.range(4).select(F.col("id").alias("entity_id"), F.col("id").cast("string").alias("canonical_name"))
    kept = corpus.merge_sketches(*batches, batches[1])
    counts = {r.entity_id: r.report_count for r in corpus.sketched_entities(kept, ents, 7_000).collect()}
    exact = {r[0]: r[1] for r in rel.groupBy("entity_id").agg(F.count_distinct("doc_id")).collect()}
    assert counts[3] == 0 and all(abs(counts[k] - n) <= 0.04 * n for k, n in exact.items())
