"""Near copies of passages inside running text: how many of them, and of their words, are found."""

import random

import pytest

from tallyweave.llm import substring_dedup

PAIRS = 100


def jaccard(a, b, width=5):
    x, y = ({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_passages_in_running_text(spark):
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    cases, rows = {}, []
    for kind, (size, edits) in enumerate([(60, 0), (51, 1), (60, 1), (80, 1), (100, 2), (150, 3)]):
        for k in range(PAIRS):
            passage = fresh(size)
            near = list(passage)
            for place in r.sample(range(size), edits):
                near[place] = f"edit{r.randrange(10**7)}"
            if jaccard(passage, near) < 0.8:
                continue
            first = 2 * (kind * PAIRS + k)
            for doc, words in ((first, passage), (first + 1, near)):
                before = r.randrange(5, 90)
                rows.append((doc, " ".join(fresh(before) + words + fresh(r.randrange(5, 90)))))
            cases[first + 1] = (kind, before, size)
    clean = [(10**6 + i, " ".join(fresh(300))) for i in range(200)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows + clean, "doc_id long, text string")).filter("removed").collect()
    found = {}
    for x in got:
        found.setdefault(x.doc_id, set()).update(range(x.first_word, x.first_word + x.n_words))
    assert set(found) <= set(cases)
    for kind, (docs_least, words_least) in enumerate([(1.0, 0.999), (0.85, 0.8), (0.9, 0.9), (0.95, 0.95), (0.95, 0.95), (0.95, 0.95)]):
        own = {d: (b, n) for d, (k, b, n) in cases.items() if k == kind}
        words = sum(len(found.get(d, set()) & set(range(b, b + n))) for d, (b, n) in own.items()) / sum(n for _, n in own.values())
        beside = sum(len(found.get(d, set()) - set(range(b, b + n))) for d, (b, n) in own.items())
        docs = sum(d in found for d in own) / len(own)
        print(kind, len(own), round(docs, 3), round(words, 3), beside)
        assert docs >= docs_least and words >= words_least and beside <= 0.02 * sum(n for _, n in own.values()), (kind, docs, words, beside)
    every = sum(d in found for d in cases) / len(cases)
    assert every >= 0.95


@pytest.mark.parametrize("differ,n,want", [([], 30, 30), ([4], 30, 30), ([4, 10], 30, 30), ([4, 9], 30, 4), ([26], 30, 26), ([0, 6, 7], 30, 6), ([24], 30, 30), ([25], 30, 25)])
def test_growth_over_single_exchanged_words(differ, n, want):
    import numpy as np
    import pyarrow as pa

    x = np.arange(n, dtype=np.uint32)
    y = x.copy()
    y[differ] += 1000
    batch = pa.record_batch({"doc_id": [1], "text_id": [1], "first": pa.array([0], pa.int32()), "after": [True], "x": [x.tobytes()], "y": [y.tobytes()]})
    (out,) = substring_dedup._alike(iter([batch]))
    assert out["more"].to_pylist() == [want]
