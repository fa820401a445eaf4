"""The verdict of the isolation forest at size, budgets in Spark, columns of clashing names, and WARC files of all kinds."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import mixing, pipeline, quality_rules, warc


def test_most_bad_texts_go_and_good_ones_stay(spark):
    folder = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality_rules(table, labels).join(labels, "doc_id").filter("NOT base_failed").select("quality", "kept").toPandas()
    kept = judged.groupby("quality").kept.mean()
    assert kept[1] >= 0.98 and kept[0] <= 0.1, kept


def test_threshold_weighs_both_sides(spark):
    def choose(good, bad, **options):
        rows = [(1, float(s)) for s in good] + [(0, float(s)) for s in bad]
        return quality_rules.calibrated_threshold(spark.createDataFrame(rows, "quality int, anomaly double"), **options)

    good = np.linspace(0.3, 0.5, 100)
    assert 0.5 < choose(good, [0.7] * 10, false_rejects=0.02) <= 0.7
    assert choose(good, [0.2] * 10, false_rejects=0.02) == 1.0  # nothing is gained
    assert choose(good, [], false_rejects=0.02) == 1.0
    many = [*good, *[0.61] * 2]  # two of 102 lie among the bad ones
    assert choose(many, [0.6] * 50, false_rejects=0.02) <= 0.6 and choose(many, [0.6] * 50, false_rejects=0.01) == 1.0
    assert choose(many, [0.6] * 9 + [0.2] * 91, false_rejects=0.02) == 1.0  # the price is too high


def budgets_of(spark, leaves, names, weights, amount, epochs):
    supply = spark.createDataFrame([(*k, v) for k, v in leaves.items()], ", ".join(f"{n} string" for n in names) + ", tokens long")
    return {tuple(r[n] for n in names): r.budget for r in mixing.spread_budgets(supply, names, weights, amount, epochs).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_by_level_equal_those_of_the_tree(spark, seed):
    r = random.Random(seed)
    leaves = {(f"d{i}", f"l{j}", f"s{k}"): r.choice([0, 1, r.randrange(50), r.randrange(5000)]) for i in range(3) for j in range(4) for k in range(6)}
    weights = {("d0",): 4.0, ("d1",): 0.0, ("d0", "l1"): 3.0, ("d2", "l0", "s1"): 0.5, ("d2", "l0", "s2"): 0.0, ("no", "one"): 2.0}
    root = mixing.Node()
    for path, n in leaves.items():
        node = root
        for k in range(3):
            node = node.children.setdefault(path[k], mixing.Node(weights.get(path[: k + 1], 1.0)))
        node.supply = n
    total = sum(leaves.values())
    for amount, epochs in ((total // 3, 1), (total // 2 + 1, 2), (3 * total, 2), (7, 1)):
        assert budgets_of(spark, leaves, ["a", "b", "c"], weights, amount, epochs) == mixing.leaf_budgets(root, amount, epochs)


def test_more_leaves_than_tasks_get_at_once(spark, monkeypatch):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("five words in a text").alias("text"), F.concat(F.lit("host"), F.col("id") % 200).alias("source"))
    levels = {"source": F.col("source")}
    want = {r.doc_id: r.copies for r in mixing.mix_to_weights(docs, levels, {}, 0.5, 1).collect()}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 10)
    assert {r.doc_id: r.copies for r in mixing.mix_to_weights(docs, levels, {}, 0.5, 1).collect()} == want
    assert 0 < sum(want.values()) <= 300


def test_columns_of_any_name_pass_the_mixture(spark):
    extra = ["_tokens", "_level0", "_spot", "_epochs", "_last", "copies", "n_tokens", "row", "bucket", "a.b"]
    rows = [(i, f"some words of text {i}", "en" if i % 3 else None, f"s{i % 4}", *[f"{c}{i}" for c in extra]) for i in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *extra])
    kept = pipeline.mixture(spark, docs, "").collect()
    assert kept and pipeline.mixture(spark, docs, "").columns == docs.columns and {tuple(r) for r in kept} <= set(rows)


def members(folder, records, broken=None):
    """A volume of one gzip member a record, with a byte of one of them changed."""
    (folder / "volume=0").mkdir(parents=True)
    parts = [gzip.compress(r) for r in records]
    if broken is not None:
        parts[broken] = parts[broken][:20] + bytes([parts[broken][20] ^ 255]) + parts[broken][21:]
    (folder / "volume=0" / "part-0.warc.gz").write_bytes(b"".join(parts))
    return str(folder)


def records(n, spelling=b"Content-Length"):
    r = random.Random(0)
    for i in range(n):
        body = r.randbytes(150).hex().encode()
        yield b"WARC/1.0\r\nWARC-Record-ID: <urn:page:%d>\r\n%s: %d\r\n\r\n%s\r\n\r\n" % (i, spelling, len(body), body)


@pytest.mark.parametrize("spelling", [b"Content-Length", b"content-length", b"CONTENT-LENGTH"])
def test_every_member_and_spelling_is_read(spark, tmp_path, spelling):
    every = list(records(300, spelling))
    ours, theirs = members(tmp_path / "ours", every), members(tmp_path / "theirs", every)
    got = sorted(warc.fixity_audit(spark, ours, theirs).collect(), key=lambda x: x.seq)
    assert [x.hash for x in got] == [hashlib.sha256(x).hexdigest() for x in every] and not any(x.damaged for x in got)
    assert [x.record_id for x in got] == [f"<urn:page:{i}>" for i in range(300)]


def test_damage_to_our_own_replica_is_reported(spark, tmp_path):
    every = list(records(50))
    ours, theirs = members(tmp_path / "ours", every, broken=30), members(tmp_path / "theirs", every)
    got = warc.fixity_audit(spark, ours, theirs).collect()
    assert {x.record_id for x in got if not x.damaged} == {f"<urn:page:{i}>" for i in range(30)}
    assert any(x.damaged for x in got)
    other = warc.fixity_audit(spark, theirs, ours).collect()
    assert {x.record_id for x in other if x.damaged and x.record_id} == {f"<urn:page:{i}>" for i in range(30, 50)}


def test_many_members_unzip_in_one_pass():
    parts = [bytes([i % 251]) * (i % 40) for i in range(20_000)]
    data = b"".join(gzip.compress(p, 1) for p in parts)
    assert warc._unzipped(data) == (b"".join(parts), b"") and warc._unzipped(b"") == (b"", b"")
    whole = sum(len(gzip.compress(p, 1)) for p in parts[:500])
    head, rest = warc._unzipped(data[: whole + 5])
    assert head == b"".join(parts[:500]) and rest == data[whole : whole + 5]
