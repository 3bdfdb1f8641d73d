import hashlib

import pytest

from weftline.llm.sampling import SALT, stable_sample


def test_same_in_any_layout_and_stable_as_data_grow(spark):
    df = spark.range(5000).selectExpr("concat('k-', id) AS id", "id AS place", "'x' AS key")
    first = {r["id"] for r in stable_sample(df.filter("place < 3000"), rate=0.2).collect()}
    grown = {r["id"] for r in stable_sample(df.union(df).repartition(7), rate=0.2).collect()}
    assert first <= grown and 850 < len(grown) < 1150
    assert {r["id"] for r in stable_sample(df, rate=0.1).collect()} <= grown
    for key in sorted(grown)[:20]:
        digest = hashlib.md5(f"{SALT}|{key}".encode()).hexdigest()
        assert int(digest[:13], 16) / 2**52 < 0.2


def test_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("a",)], "id string")
    assert sorted(r["id"] for r in stable_sample(df, rate=1.0).collect()) == ["", "a"]
    assert stable_sample(df, rate=0.0).count() == 0
    with pytest.raises(ValueError):
        stable_sample(df, rate=1.5)
