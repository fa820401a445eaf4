"""Each registered query itself, on the smallest tables: against its SQL, or against its contract by brute force."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tallyweave.llm import queries
from tallyweave.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()), key=repr)


def encoded(path, texts):
    """Ids of the tokenizers library with the end id, packed as 32-bit integers."""
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    return {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}


def test_packed_pieces_hold_each_id_once(spark, texts):
    want = encoded(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"), texts)
    rows = queries.op6_packing(spark, SF).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(map(len, want.values()))
    assert len(windows) * 4096 <= 1.1 * total + 2 * 4096


def test_token_files_read_back_in_order(spark, texts):
    want = encoded(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"), texts)
    got, at = {r.doc_id: r for r in queries.op7_token_files(spark, SF).collect()}, 0
    assert set(got) == set(want)
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want[i]), zlib.crc32(want[i].tobytes()))
        at += len(want[i])


def test_languages_of_texts_that_are_held_out(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_language_id(spark, folder).collect()
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out and langs[r.doc_id]]
    assert sum(out) / len(out) > 0.97


def test_rules_mixture_and_passages_give_whole_tables(spark, texts):
    rules = queries.op3_quality_rules(spark, SF).collect()
    assert {r.doc_id for r in rules} == set(texts) and all(r.n_words == len(texts[r.doc_id].encode().split()) and not (r.base_failed and r.kept) for r in rules)
    mix = queries.op4_mixing(spark, SF).collect()
    assert {r.doc_id for r in mix} == set(texts)
    total, chosen = sum(r.n_tokens for r in mix), sum(r.n_tokens * r.copies for r in mix)
    assert 0.5 * 0.8 * total <= chosen <= 0.8 * total
    for r in queries.op5_substring_dedup(spark, SF).collect():
        assert 0 <= r.first_word and r.first_word + r.n_words <= len(texts[r.doc_id].encode().split())


def test_pipeline_stages_only_take_away(spark, texts):
    from tallyweave.llm import pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        before, after = ({r.doc_id: r.text for r in df.collect()} for df in (docs, out))
        assert 0 < len(after) <= len(before) and set(after) <= set(before) and all(len(after[i] or "") <= len(before[i] or "") for i in after)
        docs = out
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
