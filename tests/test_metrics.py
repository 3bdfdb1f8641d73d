import math
import random

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import metrics as m


def table(spark, rows):
    df = spark.createDataFrame(rows, "h string, r string")
    return df.withColumn("b", m.bleu_stats("h", "r")).withColumn("c", m.chrf_stats("h", "r")).withColumn("t", m.ter_stats("h", "r"))


def scores(spark, rows):
    return [tuple(r) for r in table(spark, rows).select(m.bleu(F.col("b")), m.chrf(F.col("c")), m.ter(F.col("t"))).collect()]


def test_equal_empty_and_null_texts(spark):
    same, empty, both, null = scores(spark, [("The left lung is clear.", "The left lung is clear."), ("", "a b"), ("", ""), (None, "a")])
    assert same[0] > 99.99 and same[1] == 100 and same[2] == 0
    assert empty == (0.0, 0.0, 100.0) and both == (0.0, 0.0, 0.0) and null == (None, None, None)


def test_bleu_by_hand(spark):
    # 5 tokens each, 4 of 5, 2 of 4, 1 of 3 and 0 of 2 n-grams, the last smoothed to 1 / (2 * 2)
    (got,) = scores(spark, [("a b c x e", "a b c d e")])
    assert math.isclose(got[0], 100 * (4 / 5 * 2 / 4 * 1 / 3 * 1 / 4) ** 0.25)
    (short,) = scores(spark, [("a b c d", "a b c d e f g h")])
    assert math.isclose(short[0], 100 * math.exp(1 - 8 / 4))
    assert m.tokens_13a("Ein 1.5 cm-Knoten, (links)") == ["Ein", "1.5", "cm-Knoten", ",", "(", "links", ")"]


def test_chrf_by_hand(spark):
    # orders: characters 1 and 2, word 1; precision and recall are means over the orders both texts have
    (got,) = scores(spark, [("ab", "ac")])
    p = (1 / 2 + 0 + 0) / 3
    assert math.isclose(got[1], 100 * 5 * p * p / (4 * p + p))


def test_ter_counts_shifts(spark):
    moved, replaced, case = scores(spark, [("d a b c", "a b c d"), ("a x c d", "a b c d"), ("A B", "a b")])
    assert moved[2] == 25 and replaced[2] == 25 and case[2] == 0


def test_ter_never_exceeds_the_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        h, r = (" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in "hr")
        x, y = h.split(), r.split()
        rows = m._distances(m.np.array([ord(c) for c in x]), m.np.array([ord(c) for c in y]))
        assert m.ter_counts(h, r)[0] <= rows[-1, -1]
        plain = [list(range(len(y) + 1))]
        for i, c in enumerate(x, 1):
            row = [i]
            for j, e in enumerate(y, 1):
                row.append(min(plain[-1][j - 1] + (c != e), plain[-1][j] + 1, row[-1] + 1))
            plain.append(row)
        assert rows.tolist() == plain


def test_sums_give_corpus_scores(spark):
    df = table(spark, [("a b c d", "a b c d"), ("a b x d", "a b c d")])
    sums = df.agg(m.sum_stats("b", 10).alias("b"), m.sum_stats("t", 2).alias("t"))
    row = sums.select(m.bleu(F.col("b")).alias("b"), m.ter(F.col("t")).alias("t")).first()
    assert math.isclose(row["b"], 100 * (7 / 8 * 4 / 6 * 2 / 4 * 1 / 2) ** 0.25) and row["t"] == 12.5


def test_distances_of_many_texts_at_once():
    rng = np.random.default_rng(5)
    ref, hyps = rng.integers(0, 6, 17), rng.integers(0, 6, (40, 13))
    assert m._last_distances(hyps.T.copy(), ref).tolist() == [m._distances(h, ref)[-1, -1] for h in hyps]
