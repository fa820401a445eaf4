"""The corpus operators against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import gzip
import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import chat, language_id, mixing, ngram_join, packing, quality_rules, substring_dedup, token_files, topk, warc
from tallyweave.llm.components import connected_components
from tallyweave.llm.tokens import PieceEncoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, n long, bitmap string"
try:
    import public_tokenizers
except ModuleNotFoundError:
    public_tokenizers = None
needs_tokenizers = pytest.mark.skipif(public_tokenizers is None, reason="public_tokenizers is absent")
WORDS, BYTES = [public_tokenizers.path(f"{name}.json") if public_tokenizers else name for name in ("word_bpe_49k", "byte_bpe_50k")]


def prose(random_, n, size=400):
    return " ".join(f"w{random_.randrange(size)}" for _ in range(n))


def odd_rows():
    r = random.Random(4)
    base = prose(r, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "three little words"),
        (8, "Three little WORDS"), (9, "é ü 日本 ###"), (10, prose(r, 30000, 10**6)), (None, base), (11, "x"), (11, "x"), (12, base.upper()),
        (13, "<|endoftext|> \\### Assistant: </turn> ok"), (14, "\n".join(["same line here"] * 30)), (-15, base + " and more at the end"),
    ]
    return [(i, t, "en" if t else None, None, None, "clash", 1, "clash") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, width, fold=True):
    words = (text or "").encode()
    words = (words.lower() if fold else words).split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    where = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                where[x].append(k)
    shared = Counter(p for ks in where.values() for p in itertools.combinations(ks, 2))
    top = {i: i for i, _ in sets if i is not None}

    def root(v):
        while top[v] != v:
            v = top[v]
        return v

    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((root(sets[a][0]), root(sets[b][0])))
            top[y] = x
    return sorted((i, len(s), None if i is None else root(i)) for i, s in sets if i is not None)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (3000, 3001)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1400)) and got[3001] == 3000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_ngram_join_is_exact(spark, docs, odd, width, num):
    for table in (docs, odd):
        got = ngram_join.ngram_jaccard_components(table, width, num, 100).filter("doc_id IS NOT NULL").collect()
        assert sorted(map(tuple, got)) == brute_components([(r.doc_id, r.text) for r in table.collect()], width, num, 100)


def test_ngram_join_of_many_near_copies(spark):
    """Lists of hundreds of near copies, some of which link only through others."""
    r = random.Random(1)
    base = prose(r, 150).split()
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(i % 9):
            words[r.randrange(150)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_components(rows, 4, 85, 100)


def test_ngram_join_moves_no_long_sets_of_unlike_documents(spark, monkeypatch):
    # each text shares half of its words with six others, so that a bitmap of 512 bits says nothing
    blocks = [" ".join(f"b{k}w{i}" for i in range(1500)) for k in range(8)]
    rows = [(4 * i + j, f"{blocks[i]} {blocks[4 + j]}") for i in range(4) for j in range(4)]
    wrote, plain_one = {}, ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: wrote.setdefault(name, []).append(plain_one(df, name)) or wrote[name][-1])
    monkeypatch.setattr(ngram_join, "discard", lambda *tables: None)
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r.doc_id == r.component_id for r in got.collect())
    assert wrote["rest"][0].count() > 0 and wrote["sets"][-1].count() == 0


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 900, 3000):
        for m in (n, n + 1, int(n * 1.17)):
            for shared in {0, n // 2, int(0.85 * n), -(-92 * n // 100), n}:
                pool = ngram_join.mixed(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
                x, y = pool[:n], np.concatenate((pool[:shared], pool[n : n + m - shared]))
                linked = shared * 185 >= 85 * (n + m)
                may = ngram_join._may_share(n, ngram_join._sketch(x), m, ngram_join._sketch(y), 85, 100)
                assert may or not linked
                assert not may or shared > n // 2 or n < 40


def test_ngram_join_of_no_rows(none, odd):
    assert ngram_join.ngram_jaccard_components(none).count() == 0
    null = ngram_join.ngram_jaccard_components(odd).filter("doc_id IS NULL").collect()
    assert [(x.n_shingles, x.component_id) for x in null] == [(117, None)]


def test_signature_tree_loses_no_pair():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**62, r.integers(5, 60)).astype(np.uint64)) for _ in range(150)]
    for k in range(0, 150, 3):
        sets[k] = np.unique(np.append(sets[k - 1][: int(len(sets[k - 1]) * 0.95)], r.integers(0, 2**62, 1).astype(np.uint64)))
    n = np.array([len(s) for s in sets])
    maps = np.stack([ngram_join._bitmap(s).view(np.uint64) for s in sets])
    found = set(map(tuple, np.sort(np.stack(ngram_join.signature_tree_pairs(n, maps, 85, 100)), 0).T.tolist()))
    for a, b in itertools.combinations(range(150), 2):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if 100 * shared >= 85 * (n[a] + n[b] - shared):
            assert (a, b) in found
    assert len(found) < 150 * 149 / 2
    i, j = (np.array(x) for x in zip(*found, strict=True))
    assert len(ngram_join._may_link(n, maps, i, j, 85, 100)[0]) < 1000


def test_language_id(spark, odd, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in got if x.held_out]
    assert all((zlib.crc32(str(x.doc_id).encode()) % 4 == 2) == x.held_out and 0 <= x.score <= 1 for x in got)
    assert sum(x.lang_pred == x.lang for x in held) / len(held) > 0.98
    rows = {x.doc_id: x for x in language_id.language_id(odd).collect()}
    assert [rows[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and rows[4].score == 0 and rows[1].lang_pred == "en"
    assert language_id.language_id(none).count() == 0


def test_language_spans(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 4000")
    model = language_id.fit_languages(table.filter("lang IS NOT NULL"))
    pick = {x.lang: " ".join(x.text.split()[:30]) for x in table.filter("doc_id < 60 AND length(text) > 800").collect()}
    mixed = spark.createDataFrame([(1, pick["en"] + " " + pick["de"] + " 123 " + pick["fr"])], "doc_id long, text string")
    spans = language_id.label_languages(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "de", "fr"] and spans[0].first_word == 0 and spans[-1].end_word == 91
    assert abs(spans[1].first_word - 30) < 4 and all(a.end_word == b.first_word for a, b in itertools.pairwise(spans))


def test_more_than_256_languages(spark):
    rows = [(i, " ".join(chr(0x4E00 + 8 * i + j) * 3 for j in range(8)), f"l{i:03}") for i in range(260)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(table)
    assert len(model.languages) == 260
    got = {x.doc_id: x.lang_pred for x in language_id.label_languages(table, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    for n in (1, 2, 5):
        s = r.normal(size=(n, 3)).astype(np.float32) * 3
        cost = lambda p, s=s: sum(s[t, x] for t, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(3), repeat=n), key=cost)
        assert tuple(language_id.viterbi([s, s[:1]], 2.0)[0]) == best


def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    dup = sum(bool(x.encode().split()) and x in lines[:k] for k, x in enumerate(lines))
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for table in (docs, odd):
        text = [(r.doc_id, r.text) for r in table.collect()]
        got = quality_rules.quality_rules(table, labels).collect()
        want = sorted((str(i), *brute_counts(t)) for i, t in text)
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_verdict(spark, none):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality_rules(table, labels).join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in judged if r.quality == q and not r.base_failed] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.5
    kept = {r.doc_id for r in quality_rules.quality_rules(table, labels).filter("kept").collect()}
    assert {r.doc_id for r in quality_rules.keep_good_documents(table, labels).collect()} == kept
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(table, labels.limit(0)).collect())


def test_share_out():
    assert mixing.share_out(100, [1, 1, 2], [1000, 1000, 1000]) == [25, 25, 50]
    assert mixing.share_out(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert mixing.share_out(100, [1, 1], [30, 30]) == [30, 30]
    assert mixing.share_out(5, [1, 1, 1], [9, 0, 9]) in ([3, 0, 2], [2, 0, 3])
    assert mixing.share_out(7, [], []) == []


def test_shortage_goes_to_siblings_first():
    leaf = lambda w, s: mixing.Node(w, {}, s)
    root = mixing.Node(1, {"a": mixing.Node(1, {"x": leaf(1, 10), "y": leaf(1, 500)}), "b": leaf(1, 500)})
    assert mixing.leaf_budgets(root, 200, 1) == {("a", "x"): 10, ("a", "y"): 90, ("b",): 100}
    root.children["a"].children["y"].supply = 20
    assert mixing.leaf_budgets(root, 200, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b",): 170}
    assert mixing.leaf_budgets(root, 200, 2)[("a", "x")] == 20


def test_mixing_takes_prefixes(docs, odd, none):
    levels = {"language": F.col("lang"), "origin": F.col("source")}
    for table, amount, epochs in ((docs, 0.7, 2), (docs, 1.7, 3), (odd, 0.5, 1)):
        rows = mixing.mix_to_weights(table, levels, {("en",): 3.0}, amount, epochs).collect()
        words = [len((r.text or "").encode().split()) for r in rows]
        assert [r.n_tokens for r in rows] == words
        root, leaves = mixing.Node(), defaultdict(list)
        for r, n in zip(rows, words, strict=True):
            path = (r.lang or "?", r.source or "?")
            top = root.children.setdefault(path[0], mixing.Node({"en": 3.0}.get(path[0], 1.0)))
            top.children.setdefault(path[1], mixing.Node()).supply += n
            leaves[path].append((hashlib.md5(f"mix:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), n, r.copies))
        budgets = mixing.leaf_budgets(root, int(amount * sum(words)), epochs)
        for path, own in leaves.items():
            whole, rest = divmod(budgets[path], max(1, sum(n for _, n, _ in own)))
            for spot, _, copies in own:
                assert copies == whole + (sum(m for s, m, _ in own if s <= spot) <= rest)
    assert mixing.mix_to_weights(none, levels, {}, 0.5).count() == 0


def test_substring_dedup_finds_planted_passages(spark):
    r = random.Random(2)
    fresh = lambda n: prose(r, n, 10**7)
    passage = fresh(60)
    near = passage.split()
    near[30] = "edited"
    rows = [(i, fresh(20 + i) + "\n" + (passage if i < 40 else " ".join(near) if i < 45 else fresh(60)) + "\n" + fresh(50)) for i in range(60)]
    rows += [(100, None), (101, ""), (None, passage), (102, passage)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeated_passages(table).collect()
    assert {x.doc_id for x in got} == {*range(45), 102} and 0 in {x.doc_id for x in got if not x.removed} and 0 not in {x.doc_id for x in got if x.removed}
    # a paragraph with up to two words beside the passage is alike too
    assert all(60 <= x.n_words <= 64 and 0 <= 20 + x.doc_id - x.first_word <= 2 for x in got if x.removed and x.doc_id < 45)
    cut = {x.doc_id: x.text for x in substring_dedup.remove_repeats(table).collect()}
    assert 102 not in cut and passage in cut[0] and cut[50] == rows[50][1] and cut[100] is None and cut[101] == ""
    assert all(-4 <= len(cut[i].split()) - 70 - i <= 0 for i in range(1, 45))


def test_passages_inside_lines_and_across_newlines(spark):
    r = random.Random(8)
    fresh = lambda n: prose(r, n, 10**7)
    rows, want = [], []
    for k, n in ((10, 51), (20, 52), (30, 60), (40, 100)):
        passage = fresh(n)
        words = passage.split()
        across = " ".join(words[:20]) + "\n" + " ".join(words[20:]).upper()
        rows += [(k + 1, fresh(150) + " " + passage + " " + fresh(150)), (k + 2, fresh(30) + ". " + across + " " + fresh(40)), (k + 3, passage), (k + 4, fresh(90) + " " + " ".join(words[:20]) + " " + fresh(90))]
        rows += [(k + 5, fresh(300)), (k + 6, rows[-4][1]), (k + 7, fresh(100)), (k + 7, fresh(30) + " " + passage)]
        want += [(k + 2, 30, n, k + 1, 150), (k + 3, 0, n, k + 1, 150), (k + 7, 30, n, k + 1, 150), (k + 6, 0, 300 + n, k + 1, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.first_word, x.n_words, x.kept_doc_id, x.kept_first_word) for x in substring_dedup.repeated_passages(table).collect() if x.removed)
    assert len(got) == len(want)
    for x, y in zip(got, sorted(want), strict=True):
        assert x[0] == y[0] and y[3] <= x[3] < x[0] and 0 <= y[1] - x[1] <= 2 and 0 <= x[1] + x[2] - y[1] - y[2] <= 2
    left = sorted((x.doc_id, len(x.text.split())) for x in substring_dedup.remove_repeats(table).collect())
    spans = {x[0]: x[2] for x in got}
    full = sorted((i, len(t.split()) - (spans.get(i, 0) if (i % 10, len(t.split())) != (7, 100) else 0)) for i, t in rows)
    assert left == [x for x in full if x[1]]


def test_passages_against_brute_force(spark, docs, odd, none):
    """Of every 51 words in a row that stand before as well, some go, and what goes stands elsewhere or nearly does."""
    r, least = random.Random(9), substring_dedup.UNIT + substring_dedup.EVERY - 1
    noisy = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(300)))) for i in range(30)] + [(40, "x y z " * 60)]
    for table in (docs, odd, spark.createDataFrame(noisy, "doc_id long, text string")):
        texts = {(x.doc_id, x.text): (x.text or "").encode().lower().split() for x in table.collect() if x.doc_id is not None}
        where, short = defaultdict(set), defaultdict(int)
        for (i, t), words in texts.items():
            for k in range(len(words) - least + 1):
                where[tuple(words[k : k + least])].add((i, substring_dedup._text_id(t.encode()), k))
            for k in range(len(words) - 4):
                short[tuple(words[k : k + 5])] += 1
        found = substring_dedup.repeated_passages(table).collect()
        gone = {(x.doc_id, x.text_id, k) for x in found if x.removed for k in range(x.first_word, x.first_word + x.n_words)}
        for places in where.values():
            first = min(places)
            for i, t, k in places:
                if (i, t) != first[:2]:
                    assert any((i, t, k + j) in gone for j in range(least))
        by_id = {(i, substring_dedup._text_id((t or "").encode())): w for (i, t), w in texts.items()}
        again = total = 0
        for x in found:
            if x.removed:
                own = by_id[x.doc_id, x.text_id][x.first_word : x.first_word + x.n_words]
                total += len(own)  # of an exchanged word, five runs of five words stand nowhere else, but only one word
                again += len({k + j for k in range(len(own) - 4) if short[tuple(own[k : k + 5])] > 1 for j in range(5)})
        assert again >= 0.97 * total
    assert substring_dedup.repeated_passages(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0


def test_paragraphs_alike_are_found(spark):
    """Recall on paragraphs with one word changed at an end, of which each alone reaches the threshold."""
    r, rows = random.Random(12), []
    for i in range(300):
        unit = prose(r, 26, 10**7).split()
        rows += [(2 * i, " ".join(unit)), (2 * i + 1, " ".join([*unit[:-1], "changed"]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id for x in substring_dedup.repeated_passages(table).collect() if x.removed}
    assert found <= {2 * i + 1 for i in range(300)} and len(found) >= 270


def test_clashing_columns_and_kinds_survive_a_cut(spark):
    text = " ".join(f"v{k}" for k in range(80))
    own = " ".join(f"own{k}" for k in range(20)) + " "
    table = spark.createDataFrame([(1, text, 7, "g"), (2, own + text, 7, "h"), (None, text, 7, None)], "doc_id int, text string, n_chars int, gone string")
    out = substring_dedup.remove_repeats(table)
    assert out.schema == table.schema
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, text, 7, "g"), (2, own, len(own), "h"), (None, text, 7, None)], key=str)


def test_bands_are_tuned():
    for similarity, hashes in ((0.8, 12), (0.5, 40), (0.9, 20)):
        bands, rows = substring_dedup.tune_bands(similarity, 0.99, hashes)
        assert bands * rows <= hashes and 1 - (1 - similarity**rows) ** bands >= 0.99


@needs_tokenizers
def test_piece_encoder_equals_whole_texts():
    r = random.Random(0)
    parts = ["a", "bB", " ", "  ", "\n", "\n\n", "'s", "'", "é", "é", "1", "23", "!", "##", " \n", "\n ", "<|endoftext|>", "日本", "%%%", "a-", "$", "&b", "ß", "ÅÉ", "\t", " ", "‍"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)] + [None, "x" * 5000]
    for path in (WORDS, BYTES):
        e = PieceEncoder(path, most=500)
        for text, ids in zip(texts, e.all_ids(texts), strict=True):
            assert ids.tolist() == (e.tokenizer.encode(text, add_special_tokens=False).ids if text else [])


@needs_tokenizers
@pytest.mark.parametrize("window", [64, 4096])
def test_packing(spark, docs, odd, window):
    e = PieceEncoder(WORDS)
    for table in (docs, odd):
        pieces = packing.pack_sequences(table, WORDS, window=window, open_windows=4).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            assert len(p.ids) == 4 * p.length > 0
            by_doc[p.doc_id].append(p)
            by_sequence[p.sequence_id].append(p)
        for own in by_sequence.values():
            own.sort(key=lambda p: p.offset)
            assert [p.offset for p in own] == list(itertools.accumulate((p.length for p in own[:-1]), initial=0))
        used = sorted(sum(p.length for p in own) for own in by_sequence.values())
        assert used[-1] <= window and all(u > window - packing.LEAST_PIECE for u in used[1:])
        want = Counter()
        for r in table.collect():
            want[r.doc_id, tuple([*next(e.all_ids([r.text])).tolist(), 2])] += 1
        for (doc, ids), times in want.items():
            own = sorted((p for p in by_doc[doc] if p.doc_tokens == len(ids)), key=lambda p: p.start)
            assert b"".join(p.ids for p in own) == b"".join(np.array(ids, "<u4").tobytes() for _ in range(1)) * times if times == 1 else sum(p.length for p in own) == times * len(ids)


@needs_tokenizers
def test_packing_of_no_rows(none):
    assert packing.pack_sequences(none, WORDS).count() == 0


def test_coder_round_trip():
    r = np.random.default_rng(1)
    kinds = [r.integers(0, 50257, (2, token_files.BLOCK)), np.zeros((1, token_files.BLOCK)), np.full((1, token_files.BLOCK), token_files.ESCAPE - 1), r.zipf(1.3, (2, token_files.BLOCK)) % 60000, np.tile(np.arange(token_files.BLOCK) % 97, (1, 1))]
    for ids in kinds:
        ids = ids.astype(np.uint16)
        assert (token_files.decode_blocks(token_files.encode_blocks(ids)) == ids).all()
    assert len(token_files.encode_blocks(np.zeros((1, token_files.BLOCK), np.uint16))[0]) < 1000


@needs_tokenizers
def test_token_files(spark, docs, odd, none):
    e = PieceEncoder(BYTES)
    for table in (docs, odd):
        got = sorted(map(tuple, token_files.token_files(table, BYTES).select("file", "place", "doc_id", "start", "n_tokens", "ids").collect()))
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""), r.doc_id, r.text) for r in table.collect())
        at = 0
        for (_, doc, text), (_, _, doc_id, start, n, ids) in zip(rows, got, strict=True):
            want = [*next(e.all_ids([text])).tolist(), 2]
            assert (doc_id, start, n, np.frombuffer(ids, "<u4").tolist()) == (doc, at, len(want), want)
            at += n
    assert token_files.token_files(none, BYTES).count() == 0


def test_token_file_damage_is_seen():
    ids = np.random.default_rng(2).integers(0, 50000, 40000).astype(np.uint16)
    good = token_files.file_bytes([1, None], [39990, 10], iter([ids]))
    parts = list(token_files.read_file(good))
    assert parts[0][0] == [1, None] and (np.concatenate(parts[1:]) == ids).all()
    bad = bytearray(good)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(ValueError):
        list(token_files.read_file(bytes(bad)))


def test_warc_audit(spark, tmp_path):
    pages = [(i, f"http://x/{i}", f"<p>{'é' * (i % 50)}</p>\r\n\r\nWARC/1.0 {i}") for i in range(300)] + [(None, None, None), (7, "http://x/7", "again\n"), (5000, "a\r\nb", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = warc.warc_records(table).cache()
    ours, theirs, same = (str(tmp_path / x) for x in ("ours", "theirs", "same"))
    warc.write_replica(records, ours)
    warc.write_replica(records, same)
    warc.write_replica(records.withColumn("record", F.when(F.col("page_id").isin(3, 250, 5000), F.regexp_replace("record", "WARC-Date: 2", "WARC-Date: 3")).otherwise(F.col("record"))).filter("page_id != 299 OR page_id IS NULL"), theirs)
    audit = warc.fixity_audit(spark, ours, theirs).collect()
    want = {(r.volume, r.seq): r.record.encode() for r in records.collect()}
    assert len(audit) == len(pages) and all(hashlib.sha256(want[a.volume, a.seq]).hexdigest() == a.hash and len(want[a.volume, a.seq]) == a.length for a in audit)
    assert sorted(a.record_id for a in audit if a.damaged) == [f"<urn:page:{i}>" for i in (250, 299, 3, 5000)]
    assert not any(a.damaged for a in warc.fixity_audit(spark, ours, same).collect())


def test_warc_audit_sees_more_bytes_and_places_a_bad_bit(spark, tmp_path):
    pages = [(i, f"http://x/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(2200)]
    records = warc.warc_records(spark.createDataFrame(pages, "page_id long, url string, html string"))
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    warc.write_replica(records, ours)
    warc.write_replica(records, theirs)
    for checksum in (tmp_path / "theirs").glob("volume=*/.*.crc"):
        checksum.unlink()  # else the local file system refuses to read changed files
    (extra,) = (tmp_path / "theirs" / f"volume={warc.PARTS}").glob("part-*")
    extra.write_bytes(extra.read_bytes() + gzip.compress(b"more"))
    (tmp_path / "theirs" / "volume=9").mkdir()
    (tmp_path / "theirs" / "volume=9" / "part-0.txt.gz").write_bytes(gzip.compress(b"WARC/1.0\r\n\r\n"))
    found = {(x.volume, x.record_id, x.length) for x in warc.fixity_audit(spark, ours, theirs).collect() if x.damaged}
    assert found == {(warc.PARTS, None, 4), (9, None, 12)}
    (broken,) = (tmp_path / "theirs" / "volume=0").glob("part-*")
    data = bytearray(broken.read_bytes())
    data[-4] ^= 1  # the length at the file's end: nothing else is touched
    broken.write_bytes(bytes(data))
    found = [x for x in warc.fixity_audit(spark, ours, theirs).collect() if x.damaged and x.volume == 0]
    assert len(found) == 1 and found[0].record_id is None
    broken.write_bytes(bytes(data[: len(data) // 2]))
    found = sorted(x.seq for x in warc.fixity_audit(spark, ours, theirs).collect() if x.damaged and x.volume == 0 and x.record_id)
    assert found[-1] == 2047 and 900 < found[0] < 1150 and found == list(range(found[0], 2048))


def test_volumes_end_by_bytes_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "VOLUME_BYTES", 4000)
    pages = [(i % 50 if i % 3 else None, f"http://x/{i}", "h" * (i % 700)) for i in range(400)]
    records = warc.warc_records(spark.createDataFrame(pages, "page_id long, url string, html string"))
    sizes = defaultdict(int)
    for r in records.collect():
        sizes[r.volume] += len(r.record)
    assert len(sizes) > 20 and max(sizes.values()) < 4000 + 1000
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    warc.write_replica(records, ours)
    warc.write_replica(records.filter("url != 'http://x/7'"), theirs)
    audit = warc.fixity_audit(spark, ours, theirs).collect()
    assert len(audit) == 400 and len({(x.volume, x.seq) for x in audit}) == 400
    hit = {x.volume for x in audit if x.damaged}
    assert len(hit) == 1  # records after the missing one in its volume have moved


def test_chat_paths_of_trees(spark):
    rows = [("t", 1, None, 1.0, "user", "q"), ("t", 2, 1, 5.0, "assistant", "a"), ("t", 3, 1, 2.0, "assistant", "b"), ("t", 4, 3, 9.0, "user", "c"), ("t", 5, 4, None, "assistant", "d"),
            ("c", 1, 2, 1.0, "user", "x"), ("c", 2, 1, 1.0, "user", "y"), ("o", 8, 99, 1.0, "user", None)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    got = defaultdict(list)
    for r in chat.reply_paths(nodes, keep=2).orderBy("tree", "rank", "depth").collect():
        got[r.tree, r.rank].append(r.node)
    assert got == {("t", 1): [1, 3, 4, 5], ("t", 2): [1, 2], ("o", 1): [8]}
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(150)], nodes.schema)
    assert [r.node for r in chat.reply_paths(deep).orderBy("depth").collect()] == list(range(150))


def test_chat_format_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "", None, "####\\", "</turn>\n### x: ", "\\", "a" * 20000 + "\\" * 500, "<</turn>#"]
    rows = [(c, t, ["user", "assistant", "we:ird\\", None][(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(12) for t in range(9)] + [(None, 1, "user", "z"), (3, 2, "user", "tie"), (3, 2, "user", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.chat_format(chat.threads(table))
    back = {r.conversation.tree: r for r in chat.read_formatted(formatted).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        r = back["" if conv is None else str(conv)]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.learned == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert chat.chat_format(chat.threads(table.limit(0))).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(5)
    rows = [(int(i), r.normal(size=8).round(2).tolist()) for i in range(700)]
    rows += [(1000, [0.0] * 8), (1001, None), (1002, [None] + [1.0] * 7), (1003, [float("nan")] * 8), (1100, [float("inf")] * 8), (None, [1.0] * 8), (1200, [1.0, 2.0]), (1201, [1.0, 1.0]), (5, rows[5][1]), (1300, [1e9] * 8), (1400, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in topk.exact_top_k(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = [int(np.floor(1024 * x)) for x in v]
    for q in [i for i in whole if i % 100 == 0]:
        want = sorted(((i, sum(a * b for a, b in zip(whole[q], v, strict=True))) for i, v in whole.items() if i != q and len(v) == len(whole[q])), key=lambda p: (-p[1], p[0]))[:10]
        assert got.pop(q, []) == want
    assert not got
    assert topk.exact_top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@needs_tokenizers
def test_pipeline(spark, odd):
    from tallyweave.llm import pipeline as corpus_pipeline

    folder = os.path.dirname(f"{SF}/")
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.count() > 50
    kept = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, folder)
        assert out.columns == kept.columns
        kept = spark.createDataFrame(out.collect(), kept.schema)
        assert stage(spark, kept.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, kept, folder).count() > 0
