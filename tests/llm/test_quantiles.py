import numpy as np
import pytest

from weftline.llm import quantiles as q


def relative_errors(sketch, values, shares):
    ordered = np.sort(values)
    out = []
    for share, got in zip(shares, sketch.quantiles(shares)):
        low, high = np.searchsorted(ordered, got, "left") + 1, np.searchsorted(ordered, got, "right")
        wanted = np.ceil(share * len(ordered))
        rank = min(max(wanted, low), high)
        tail = (len(ordered) - wanted + 1) if sketch.high else wanted
        out.append(abs(rank - wanted) / tail)
    return out


@pytest.mark.parametrize("high", [True, False])
@pytest.mark.parametrize("kind", ["normal", "sorted", "ties"])
def test_rank_error_is_relative_to_the_tail(high, kind):
    rng = np.random.default_rng(3)
    values = rng.lognormal(size=200_000)
    values = np.sort(values) if kind == "sorted" else np.round(values) if kind == "ties" else values
    sketch = q.RelativeSketch(high=high)
    for part in np.array_split(values, 37):
        sketch.update(part)
    shares = [0.5, 0.9, 0.99, 0.999, 0.9999] if high else [0.5, 0.1, 0.01, 0.001, 0.0001]
    assert max(relative_errors(sketch, values, shares)) < 1.6 / q.K * 2
    assert len(sketch.to_bytes()) < 60_000
    assert sketch.quantiles([0.0, 1.0]) == [values.min(), values.max()]


def test_merging_days_keeps_the_bound_and_bytes_round_trip():
    rng = np.random.default_rng(4)
    days = [rng.gamma(2, 10, size=rng.integers(1, 9000)) for _ in range(60)]
    whole = q.RelativeSketch()
    for day in days:
        part = q.RelativeSketch()
        part.update(day)
        whole.merge(q.RelativeSketch.from_bytes(part.to_bytes()))
    values = np.concatenate(days)
    assert whole.n == len(values)
    assert max(relative_errors(whole, values, [0.5, 0.9, 0.99, 0.999])) < 1.6 / q.K * 2


def test_table(spark):
    rows = [("a", float(i)) for i in range(100)] + [("A ", 5.0), (None, 7.0), ("", None)]
    df = spark.createDataFrame(rows, "g string, x double").selectExpr("*", "1 AS n", "2 AS sketch").repartition(3)
    sketches = q.merge_sketches(q.build_sketches(df, ["g"], "x"), ["g"])
    got = {r["g"]: r for r in q.read_quantiles(sketches, ["g"], [0.5, 0.99]).collect()}
    assert set(got) == {"a", "A ", None}
    assert (got["a"]["n"], got["a"]["p50"], got["a"]["p99"], got["a"]["least"], got["a"]["most"]) == (100, 49.0, 98.0, 0.0, 99.0)
    assert q.read_quantiles(q.merge_sketches(q.build_sketches(df.limit(0), ["g"], "x"), ["g"]), ["g"], [0.5]).count() == 0


def test_metric_rows(spark):
    df = spark.sql("SELECT * FROM VALUES ('e', ' EMEA', TIMESTAMP '2024-01-01 01:00:00', map('bleu', 1.0D, 'ter', CAST(NULL AS DOUBLE))), ('e', ' EMEA', TIMESTAMP '2024-01-01 01:00:00', map('bleu', 1.0D)), ('f', CAST(NULL AS STRING), CAST(NULL AS TIMESTAMP), CAST(NULL AS MAP<STRING, DOUBLE>)) AS t(eval_id, domain, scored_at, metrics)")
    assert [tuple(r) for r in q.metric_rows(df).collect()] == [("emea", "2024-01-01", "bleu", 1.0)]


def test_summaries_turn_into_sketches_and_merge_in_any_form():
    rng = np.random.default_rng(8)
    values = rng.gamma(2, 10, 6000)
    parts = [values[:50], values[50:150], values[150:3000], values[3000:3001], values[3001:]]
    whole = q.Summary()
    for part in parts:
        own = q.Summary()
        own.add(part)
        whole.merge(q.Summary.from_bytes(own.to_bytes()))
    assert whole.n == 6000 and whole.ends() == [values.min(), values.max()]
    ordered = np.sort(values)
    for share in (0.001, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999):
        (got,) = whole.quantiles([share])
        rank, wanted = np.searchsorted(ordered, got, side="right"), int(np.ceil(share * 6000))
        assert abs(rank - wanted) <= 3.2 / q.K * min(wanted, 6001 - wanted) + 1
    few = q.Summary()
    few.add(np.array([3.0, np.nan, 1.0, 2.0]))
    assert few.quantiles([0.0, 0.5, 1.0]) == [1.0, 2.0, 3.0] and len(few.to_bytes()) < 40 and q.Summary().quantiles([0.5]) == [None]


def test_errors_are_found(spark):
    rows = spark.range(1000).selectExpr("'g' AS g", "cast(id as double) AS x")
    found = spark.createDataFrame([("g", 499.0, 700.0)], "g string, p50 double, p99 double")
    assert {r["share"]: r["within"] for r in q.rank_errors(rows, found, ["g"], "x", [0.5, 0.99]).collect()} == {"p50": 1, "p99": 0}
