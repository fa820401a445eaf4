"""Where merges lead, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import closure, entities


def brute(links):
    """id to (end, steps, cyc) of the longest walk, the smaller end if there are several."""
    after = {}
    for a, b in set(links):
        after.setdefault(a, []).append(b)
    out = {}
    for origin in after:
        best, stack = None, [[origin]]
        while stack:
            path = stack.pop()
            nexts = after.get(path[-1], [])
            if len(path) > 1 and (path[-1] in path[:-1] or not nexts):
                key = (-(len(path) - 1), path[-1], path[-1] in path[:-1])
                best = key if best is None else min(best, key)
                continue
            stack += [[*path, b] for b in nexts]
        out[origin] = (best[1], -best[0], best[2])
    return out


def found(spark, links):
    df = spark.createDataFrame(links, "id long, into long")
    return {r["id"]: (r["at"], r["steps"], r["cyc"]) for r in closure.ends_of(df).collect()}


@pytest.mark.parametrize("seed,branches", [(1, 0), (2, 3), (3, 8)])
def test_random_graphs(spark, seed, branches):
    rng = random.Random(seed)
    links = [(i, rng.randrange(40)) for i in range(0, 40) if rng.random() < 0.8] + [(rng.randrange(40), rng.randrange(40)) for _ in range(branches)]
    links += links[:3]  # repeated rows
    assert found(spark, links) == brute(links)


def test_forks_without_cycles_and_a_tangle(spark):
    links = [(1, 2), (1, 3), (2, 4), (3, 5), (5, 4), (4, 6), (4, 7), (6, 8), (7, 8), (9, 1)]  # forks 1 and 4
    links += [(20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (19, 20), (30, 22), (30, 1)]  # a cycle through fork 22
    links += [(50, 50), (51, 50), (60, 61), (61, 62), (62, 61), (63, 60)]
    assert found(spark, links) == brute(links)


def test_long_chain(spark):
    n = 10_000
    chain = spark.range(n).select("id", (F.col("id") + 1).alias("into"))
    ended, endless = closure.follow(chain)
    assert endless is None
    assert ended.filter((F.col("at") != n) | (F.col("steps") != n - F.col("id"))).count() == 0 and ended.count() == n
    ring = chain.filter(F.col("id") < n - 1).unionAll(spark.range(1).select(F.lit(n - 1).cast("long").alias("id"), F.lit(n // 2).cast("long").alias("into")))
    at = {r["id"]: (r["at"], r["steps"]) for r in closure.ends_of(ring).filter(F.col("id").isin(0, n // 2, n - 1)).collect()}
    assert at == {0: (n // 2, n), n // 2: (n // 2, n // 2), n - 1: (n - 1, n // 2)}


def test_many_merges_into_one(spark):
    n = 1_200_000
    merges = spark.range(1, n).select(F.col("id").alias("from_id"), F.lit(0).cast("long").alias("into_id"), F.lit(0).alias("reverted"))
    ents = spark.range(n).select(F.col("id").alias("entity_id"))
    assert entities.resolve_entities(ents, merges).filter("resolved_id != 0").count() == 0
    assert entities.entity_family(ents, merges, 0).count() == n


def test_family(spark):
    links = [(i, i - 1) for i in range(1, 121)] + [(60, 200), (200, 201), (300, 301), (301, 300), (400, 119), (400, 300)]
    df = spark.createDataFrame([(a, b, 0) for a, b in links], "from_id long, into_id long, reverted int")
    ents = spark.range(500).select(F.col("id").alias("entity_id"))
    assert {r[0] for r in entities.entity_family(ents, df, 0).collect()} == {*range(121), 400}
    assert {r[0] for r in entities.entity_family(ents, df, 201).collect()} == {200, 201, *range(60, 121), 400}
    assert {r[0] for r in entities.entity_family(ents, df, 300).collect()} == {300, 301, 400}


def test_no_merges(spark):
    none = spark.createDataFrame([], "from_id long, into_id long, reverted int")
    ents = spark.range(3).select(F.col("id").alias("entity_id"))
    assert [(r[0], r[1], r[2], r[3]) for r in entities.resolve_entities(ents, none).orderBy("entity_id").collect()] == [(i, i, 1, False) for i in range(3)]
    assert [r[0] for r in entities.entity_family(ents, none, 2).collect()] == [2]


def test_rule_of_the_last_merge_differs_at_branches_only(spark):
    merges = spark.createDataFrame([(1, 2, 0, 1), (2, 3, 0, 2), (1, 5, 0, 3), (7, 8, 0, 4), (8, 7, 0, 5), (9, 8, 0, 6)], "from_id long, into_id long, reverted int, ordinal long")
    ents = spark.range(1, 10).select(F.col("id").alias("entity_id"))
    last = {r[0]: r[1] for r in entities.resolve_by_last_merge(ents, merges).collect()}
    longest = {r[0]: r[1] for r in entities.resolve_entities(ents, merges).collect()}
    assert last == {1: 5, 2: 3, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    assert {k for k in last if last[k] != longest[k]} == {1}
