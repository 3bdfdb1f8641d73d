import random

import numpy as np
import pytest

from weftline.llm import packing as p


def optimum(sizes, capacity):
    """The least number of containers, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= capacity and loads[k] not in loads[:k]:
                loads[k] += sizes[i]
                place(i + 1, loads)
                loads[k] -= sizes[i]
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best


def test_bound_and_packing_enclose_the_optimum():
    rng = random.Random(6)
    for _ in range(300):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 8))])
        best = optimum(sizes.tolist(), 20)
        bins = p.best_fit_decreasing(sizes, 20)
        assert np.bincount(bins, sizes).max() <= 20
        assert p.lower_bound(sizes, 20) <= best <= bins.max() + 1


def test_bound_sees_large_items():
    assert p.lower_bound(np.array([11, 11, 11]), 20) == 3
    assert p.lower_bound(np.array([7] * 6), 20) == 3
    assert p.lower_bound(np.zeros(0, int), 20) == 0


@pytest.mark.parametrize("per", [7, 1000])
def test_every_item_once_and_the_same_in_any_layout(spark, per):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 3, 17, 40, 55, 99, 100, 250])) for i in range(400)] + [(None, 5), (7, None)]
    df = spark.createDataFrame(rows, "key long, n int").selectExpr("*", "1 AS chunk", "2 AS size")

    def run(frame):
        return sorted(tuple(r) for r in p.pack(p.split_items(frame, "key", "n", 100), 100, per).collect())

    got = run(df.repartition(5))
    assert got == run(df.repartition(2))
    wanted = sorted((k, c, min(100, n - 100 * c)) for k, n in rows if k is not None and n for c in range(-(-n // 100)))
    assert sorted(r[:3] for r in got) == wanted
    loads = {}
    for r in got:
        loads[r[3]] = loads.get(r[3], 0) + r[2]
    assert max(loads.values()) <= 100
    report = p.fill_report(p.pack(p.split_items(df, "key", "n", 100), 100, per), 100).first()
    assert report["items"] == len(wanted) and report["containers"] == len(loads) and report["capacity_bound"] <= len(loads)


def test_empty(spark):
    df = spark.createDataFrame([], "key long, chunk int, size long")
    assert p.pack(df).count() == 0
