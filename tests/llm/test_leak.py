import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftline.functions.charforms import fold
from weftline.llm import leak

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, least=10):
    """Longest common run of words of each pair with at least ``least``."""
    out = {}
    for d, t in docs:
        a = WORD.findall(fold(t).lower()) if t else []
        for i, u in items:
            b = WORD.findall(fold(u).lower()) if u else []
            best, row = 0, [0] * (len(b) + 1)
            for x in a:
                new = [0] * (len(b) + 1)
                for k, y in enumerate(b, 1):
                    if x == y:
                        new[k] = row[k - 1] + 1
                        best = max(best, new[k])
                row = new
            if best >= least:
                out[d, i] = best
    return out


def data(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["ÄRZTE", "ﬁn", "x²"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "w1 " * 40)]
    docs = []
    for d in range(60):
        text = [rng.choice(words + ["other", "more"]) for _ in range(rng.randint(0, 40))]
        if d % 2:
            source = items[rng.randrange(12)][1].split()
            k = rng.randrange(max(1, len(source) - 8))
            text += source[k : k + rng.choice([8, 9, 10, 11, 30])]
        docs.append((d, (" ,  " if d % 3 else "\n").join(text)))
    return [*docs, (70, "w1 " * 30), (71, None), (72, ""), (73, items[0][1].upper()), (74, "ｗ1 " * 12)], items


@pytest.mark.parametrize("seed, block", [(1, 1 << 20), (2, 300)])
def test_equals_brute_force(spark, seed, block):
    docs, items = data(seed)
    d = spark.createDataFrame([*docs, docs[1], (None, "x")], "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS item_id").repartition(3)
    i = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    found = leak.leaks(d, i, block_bytes=block)
    assert {(r.doc_id, r.item_id): r.n_words for r in found.collect()} == brute(docs, items)
    kept = {r.doc_id for r in leak.without_leaks(d, found).collect()}
    assert kept == {None, *(k for k, _ in docs)} - {k for k, _ in brute(docs, items)}


def test_suffix_array_is_sorted():
    values = np.random.default_rng(2).integers(1, 4, 300)
    order = leak.suffix_array(values, 300)
    suffixes = [values[i:].tolist() for i in order]
    assert suffixes == sorted(suffixes)


def test_empty(spark):
    docs, items = data(1)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leak.leaks(d.limit(0), i).count() == 0 and leak.leaks(d, i.limit(0)).count() == 0
    assert leak.words_of(pa.array(["A_b", None])) == [["a", "b"], []]
