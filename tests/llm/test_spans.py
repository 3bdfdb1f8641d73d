import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import spans
from weftline.llm.components import components


def brute(a, b, span):
    """Whether two texts share ``span`` code points verbatim."""
    return any(a[i : i + span] in b for i in range(len(a) - span + 1))


def random_docs(seed, n=60, span=40):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdeü ") for _ in range(k))
    pool = [word(rng.choice([span - 1, span, span + 1, 3 * span])) for _ in range(8)]
    docs = [word(rng.randint(0, 90)) + rng.choice(pool) + word(rng.randint(0, 90)) for _ in range(n)]
    return docs + ["x" * (2 * span), "x" * (3 * span), "ab" * span, pool[3], pool[3], pool[3], "", "short"]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    span = 40
    docs = random_docs(seed, span=span)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(900, None), (None, "x" * 99), (0, docs[0])], "doc_id long, text string")
    df = df.selectExpr("*", "1 AS key", "2 AS rep", "3 AS a").repartition(5)
    found = spans.SharedSpans(df, span=span, shingle=25)
    got = sorted(tuple(r) for r in found.pairs().collect())
    want = sorted((i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if brute(docs[i], docs[j], span))
    assert got == want
    report = {r["key"]: r for r in found.report().collect()}
    for i, t in enumerate(docs):
        if len(t) < span:
            assert i not in report
            continue
        covered = set()
        for j, other in enumerate(docs):
            if j != i:
                for s in range(len(t) - span + 1):
                    if t[s : s + span] in other:
                        covered |= set(range(s, s + span))
        assert report[i]["shared_chars"] == len(covered)
    heads = {}
    for i, j in want:
        heads.setdefault(report[i]["class_id"], set()).add(report[j]["class_id"])
    assert all(h == {k} for k, h in heads.items())
    assert sum(r["keep"] for r in report.values()) == len({r["class_id"] for r in report.values()})


def test_window_functions():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 200).astype(np.uint64)
    for width in (1, 7, 64, 200):
        assert spans.sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(201 - width)]
    codes = rng.integers(97, 100, 500).astype(np.uint32)
    hashes = spans.window_hashes(codes, 5)
    same = {}
    for i in range(496):
        same.setdefault(codes[i : i + 5].tobytes(), set()).add(int(hashes[i]))
    assert all(len(v) == 1 for v in same.values()) and len(set(hashes.tolist())) == len(same)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.SharedSpans(df).pairs().count() == 0 and spans.SharedSpans(df).report().count() == 0
    with pytest.raises(ValueError):
        spans.SharedSpans(df, span=10, shingle=11)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200)] + [(300, 300 + i) for i in range(1, 20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 5)], "a long, b long").withColumn("u", F.lit(1))
    assert {tuple(r) for r in components(df, "a", "b").collect()} == {(x, find(x)) for x in list(parent)}
    assert components(df.limit(0), "a", "b").count() == 0


def test_one_passage_in_many_texts_is_made_in_parts(spark, monkeypatch):
    """Half of the texts share a passage: parts give the same pairs as one group."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(450))
    rows = [(i, "".join(rng.choice("klmnop ") for _ in range(420)) + (passage if i % 2 else "")) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for part in (10_000, 17):
        monkeypatch.setattr(spans, "PART", part)
        got.append({tuple(r) for r in spans.SharedSpans(df).pairs().collect()})
    assert got[0] == got[1] == {(a, b) for a in range(1, 240, 2) for b in range(a + 2, 240, 2)}
