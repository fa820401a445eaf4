"""Sharding, collocations and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import collocations, manifest, queries, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, twin string, salt int, label int, h string, item string"


def odd_rows():
    rows = [(1, "a b. a b", "en", "s", 8, 1), (2, None, "en", None, None, 2), (3, "", None, "", 0, 3), (3, "", None, "", 0, 3), (None, "a b\na b\r\nc", "en", "é", 9, None), (-5, "A B! c", "und", "é", 6, 5)]
    rows += [(10 + i, "same text\nhere " * 3, "de", "hot", 45, i) for i in range(300)] + [(7, "x " * 20_000 + "\n", "fr", "hot", 40_001, 0)]
    return [(*r, "clash", 1, 2, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# sharding


def laws_hold(rows, docs, shards):
    """One row a document, counts at most one apart, slots without gaps; returns shards of each text."""
    assert Counter((r[0], r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    return slots


def test_shards_of_odd_rows(spark, odd, none):
    docs = [(r[0], r[1]) for r in odd_rows()]
    laws_hold(sharding.shard_documents(odd).collect(), docs, 16)
    laws_hold(sharding.shard_documents(odd, shards=1).collect(), docs, 1)
    assert sharding.shard_documents(none).count() == 0


def test_groups_that_fit_stay_whole_and_others_take_few_shards(spark):
    r = random.Random(1)
    sizes = [2] * 120 + [3] * 60 + [9] * 10 + [40] * 3 + [700]
    texts = [f"group {k}" for k, n in enumerate(sizes) for _ in range(n)] + [f"alone {i}" for i in range(900)]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), shards=8).collect()
    laws_hold(rows, docs, 8)
    at = defaultdict(Counter)
    for x in rows:
        at[texts[x.doc_id]][x.shard] += 1
    groups = {t: c for t, c in at.items() if t.startswith("group")}
    whole = sum(len(c) == 1 for t, c in groups.items() if sum(c.values()) < 50)
    assert whole >= 0.97 * sum(sum(c.values()) < 50 for c in groups.values())
    assert all(x.group_rows == sum(at[texts[x.doc_id]].values()) for x in rows)


def test_propagation_cuts_fewer_links_within_quotas(spark):
    """Rings of twelve, with a few links between them: a general graph, no groups of copies."""
    r = random.Random(3)
    n, ring = 480, 12
    links = [(i, i - i % ring + (i + d) % ring, 3) for i in range(n) for d in (1, 2)] + [(r.randrange(n), r.randrange(n), 1) for _ in range(60)]
    ids = [7 * i + 1 for i in range(n)]
    vertices = spark.createDataFrame([(i, 1) for i in ids], "id long, weight long")
    edges = spark.createDataFrame([(ids[a], ids[b], w) for a, b, w in links] + [(ids[0], -1, 5), (ids[1], ids[1], 5)], "a long, b long, weight long")
    cut = lambda label: sum(w for a, b, w in links if label[ids[a]] != label[ids[b]])
    begun = {x.id: x.label for x in sharding.balanced_labels(vertices, edges, 4, 132, rounds=0).collect()}
    ended = {x.id: x.label for x in sharding.balanced_labels(vertices, edges, 4, 132, rounds=10).collect()}
    assert set(ended) == set(ids) and cut(ended) < 0.45 * cut(begun)
    assert max(Counter(ended.values()).values()) <= 1.15 * 132


def test_quotas_admit_what_fits():
    assert sharding.admitted({(0, 1): 10}, [50, 45], 50) == [1.0, 0.5]
    assert sharding.admitted({(0, 1): 10, (1, 0): 10}, [50, 50], 50) == [1.0, 1.0]
    assert sharding.admitted({(0, 1): 40, (1, 0): 10}, [50, 50], 50)[1] == pytest.approx(0.25, abs=1e-2)
    assert sharding.admitted({}, [1, 2], 5) == [1.0, 1.0]


# collocations


def brute_collocations(docs, least, top, widest=5):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, widest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in counts.items():
        often = {p: f for p, f in c.items() if f >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * f >= 100 * a and inside(q) for q, f in often.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((score, a, " ".join(p), left, right))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, totals[lang], s) for i, (s, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least,top,held", [(3, 40, 1_500_000), (2, 2000, 50)])
def test_collocations_equal_brute_force(spark, odd, none, monkeypatch, least, top, held):
    monkeypatch.setattr(collocations, "HELD_ENTRIES", held)
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "dé", "ü", "x", "the", "of"]
    docs = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(r.randrange(60)))) for _ in range(120)] + [("en", None), ("en", "")]
    table = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    assert collected(collocations.collocations(table, least, top=top)) == brute_collocations(docs, least, top)


def test_collocations_of_odd_rows(spark, odd, none):
    docs = [(r[2], r[1]) for r in odd_rows()]
    got = collocations.collocations(odd)
    assert collected(got) == brute_collocations(docs, 100, 2000)
    assert collocations.collocations(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_filters_give_back_what_they_hold(n):
    r = np.random.default_rng(n)
    ids = [r.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(n)]
    ids = [np.concatenate((x, x[:500], np.array([0, 2**64 - 1], np.uint64))) for x in ids]
    counts = np.concatenate((r.integers(1, 400, 3500), [1, 10**12]))
    want = Counter()
    for *key, c in zip(*[x.tolist() for x in ids], counts.tolist()):
        want[tuple(key)] += c
    lanes, summed = collocations.merged(collocations.permuted(ids), counts)
    got, q = Counter(), 5
    block = (lanes[0] >> np.uint64(64 - q)).astype(int)
    for b in np.unique(block):
        part = block == b
        back, c = collocations.unpacked_filter(collocations.packed_filter([y[part] for y in lanes], summed[part], q), int(b), q, n)
        for *key, k in zip(*[x.tolist() for x in collocations.restored(back)], c.tolist()):
            got[tuple(key)] += k
    assert got == want


def test_equal_first_lanes_are_told_apart():
    lanes = [np.array([5, 5, 5, 1], np.uint64), np.array([2, 1, 2, 9], np.uint64)]
    (a, b), counts = collocations.merged(lanes, np.array([1, 10, 100, 1000]))
    assert (a.tolist(), b.tolist(), counts.tolist()) == ([1, 5, 5], [9, 1, 2], [1000, 10, 101])


# manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(hashes):
    """The root, and for each leaf the runs before and after it, level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, path in enumerate(paths):
            low = at[i] // 3 * 3
            run = hashes[low : low + 3]
            path.append((run[: at[i] - low], run[at[i] - low + 1 :]))
            at[i] //= 3
        hashes = [sha("".join(hashes[k : k + 3])) for k in range(0, len(hashes), 3)]
    return hashes[0], paths


def brute_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) to doc_id, leaf, subroot, root, proof, folded root, verified."""
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        own = sorted(by[s], key=lambda x: x[:3])
        trees.append((own, *tree_of([x[2] for x in own])))
    root, above = tree_of([t[1] for t in trees])
    out = []
    for (own, subroot, paths), up in zip(trees, above):
        for (_, _, leaf, row), path in zip(own, paths):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf_of((*row[:4], text))
            for a, b in path + up:
                h = sha("".join(a) + h + "".join(b))
            out.append((str(row[0]), leaf, subroot, root, sha("".join("".join(a) + "".join(b) for a, b in path + up)), h, h == root))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_of(docs):
    claim = manifest.without_line_ends(F.col("doc_id"), F.col("text"), *[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")])
    return Counter((str(r.doc_id), *r[1:]) for r in manifest.merkle_manifest(docs, claim=claim).select(*COLUMNS).collect())


def test_manifest_of_odd_rows(spark, odd, none):
    assert manifest_of(odd) == brute_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()])
    assert manifest.merkle_manifest(none).count() == 0 and manifest.merkle_manifest(none).columns == manifest.merkle_manifest(odd.limit(1)).columns


def test_manifest_of_several_tiers_and_of_one_row(spark):
    rows = [(i, "s" if i % 9 else None, "en", i, f"line\n{i}") for i in range(2300)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_of(table) == brute_manifest(rows)
    assert manifest_of(table.filter("doc_id = 4")) == brute_manifest(rows[4:5])


def test_manifest_of_many_sources(spark):
    rows = [(i, f"host{i % 300}", None, None, None if i % 7 == 0 else "a\nb") for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_of(table) == brute_manifest(rows)


# the queries themselves


def test_queries_return_their_contracts(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    shards = queries.op11_sharding(spark, SF)
    assert dict(shards.dtypes) | {"group_rows": ""} == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "group_rows": ""}
    laws_hold(shards.collect(), [(d[0], d[4]) for d in docs], 16)
    phrases = queries.op12_collocations(spark, SF)
    assert {t for c, t in phrases.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert collected(phrases) == brute_collocations([(d[2], d[4]) for d in docs], 100, 2000)
    proofs = queries.op13_merkle_manifest(spark, SF)
    assert proofs.columns == COLUMNS and Counter((str(r.doc_id), *r[1:]) for r in proofs.collect()) == brute_manifest(docs)
