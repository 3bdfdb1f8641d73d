"""Paired statistics on additive counters: bootstrap intervals, exact McNemar test."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpoint


# 2 ** 32 times the distribution function of a Poisson variable of mean one, at 0, 1, 2, ...
POISSON = tuple(math.ceil(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(13))


def resampled(rows: DataFrame, key: str, resamples: int, seed: int) -> DataFrame:
    """Each row once per resample that draws it: its columns, ``resample`` and ``weight``.

    The bootstrap of large tables: how often a row is drawn is a Poisson number of mean one, read off the MD5 of seed,
    resample and key (four resamples to a hash). No row needs to know of another, so nothing is ranked or joined, and
    sums by resample are pre-aggregated by the tasks that read the rows. The same wherever MD5 is.
    """
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 4) - 1))))
    blocks = blocks.withColumn("_digest", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_block").cast("string"), F.col(key).cast("string"))))

    blocks = blocks.withColumns({f"_u{j}": F.conv(F.substring("_digest", 1 + 8 * j, 8), 16, 10).cast("bigint") for j in range(4)})

    def weight(j: int) -> Column:
        return reduce(add, ((F.col(f"_u{j}") >= x).cast("int") for x in POISSON))

    draws = F.array(*(F.struct((F.col("_block") * 4 + j).alias("resample"), weight(j).alias("weight")) for j in range(4)))
    return blocks.select(*rows.columns, F.inline(draws)).filter((F.col("weight") > 0) & (F.col("resample") < resamples))


def positioned(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``position`` from 0 in the order of ``key``.

    A global rank over the rows of one comparison; for very many rows the ranges are ranked apart and offset.
    """
    parts = df.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    sizes = local.groupBy("_p").agg(F.max("_r").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("position", F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def _interval(values: DataFrame, column: str) -> list[Column]:
    return [F.percentile(column, F.lit(0.025)).alias("ci_low"), F.percentile(column, F.lit(0.975)).alias("ci_high")]


def paired_bootstrap(pairs: DataFrame, key: str, base: str, cand: str, size: int, score: Callable[[Column], Column], resamples: int = 2000, seed: int = 13, higher_is_better: bool = True) -> DataFrame:
    """One row: observed_difference, ci_low, ci_high, p_value of a corpus metric, candidate minus baseline.

    ``base`` and ``cand`` hold counters whose sums ``score`` turns into the metric. Both systems share the draws.
    Under 100 resamples or an empty table is an error.
    """
    if resamples < 100:
        raise ValueError("at least 100 resamples")
    rows = checkpoint(pairs.select(key, base, cand))
    if rows.isEmpty():
        raise ValueError("no pairs")
    sign = 1.0 if higher_is_better else -1.0
    weighted = lambda c: F.array(*(F.sum(F.col("weight") * F.col(c)[i]) for i in range(size)))
    sums = resampled(rows, key, resamples, seed).groupBy("resample").agg(weighted(base).alias("b"), weighted(cand).alias("c"))
    deltas = sums.select((sign * (score(F.col("c")) - score(F.col("b")))).alias("d"))
    plain = lambda c: F.array(*(F.sum(F.col(c)[i]) for i in range(size)))
    seen = rows.agg(plain(base).alias("b"), plain(cand).alias("c")).select((sign * (score(F.col("c")) - score(F.col("b")))).alias("observed_difference"))
    tails = F.least(F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int")))
    out = deltas.agg(*_interval(deltas, "d"), F.least(F.lit(1.0), 2 * tails).alias("p_value"))
    return seen.crossJoin(out).select("observed_difference", "ci_low", "ci_high", "p_value", F.lit(resamples).alias("resamples"), F.lit(seed).alias("seed"))


def bootstrap_proportion(rows: DataFrame, key: str, flag: str, resamples: int = 2000, seed: int = 13) -> DataFrame:
    """One row: observed, ci_low, ci_high of the share of rows with the flag. An empty table is an error."""
    flagged = checkpoint(rows.select(key, F.coalesce(F.col(flag).cast("int"), F.lit(0)).alias("_f")))
    if flagged.isEmpty():
        raise ValueError("no rows")
    means = resampled(flagged, key, resamples, seed).groupBy("resample").agg((F.sum(F.col("weight") * F.col("_f")) / F.sum("weight")).alias("d"))
    seen = flagged.agg(F.avg("_f").alias("observed"))
    return seen.crossJoin(means.agg(*_interval(means, "d")))  # two single rows


def binomial_tail(b: Column, c: Column) -> Column:
    """min(1, 2 P(X <= min(b, c))) of a fair binomial with b + c trials, in log space; 1 without trials."""
    n = b + c
    start = F.struct((-n * F.log(F.lit(2.0))).alias("l"), F.lit(0.0).alias("s"))

    def grown(state: Column, i: Column) -> Column:
        log = F.when(i == 0, state["l"]).otherwise(state["l"] + F.log((n - i + 1) / F.greatest(i, F.lit(1))))
        return F.struct(log.alias("l"), (state["s"] + F.exp(log)).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(b, c).cast("bigint")), start, grown, lambda s: s["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(pairs: DataFrame, base: str, cand: str) -> DataFrame:
    """One row: baseline_only, candidate_only, p_value of paired flags; a null flag counts as false."""
    x, y = (F.coalesce(F.col(c), F.lit(False)) for c in (base, cand))
    counted = pairs.agg(F.count_if(x & ~y).alias("baseline_only"), F.count_if(~x & y).alias("candidate_only"))
    return counted.withColumn("p_value", binomial_tail(F.col("baseline_only"), F.col("candidate_only")))


def paired(base: DataFrame, cand: DataFrame, key: str = "id", flags: bool = False) -> DataFrame:
    """Rows of two runs joined on their key.

    An error if a key is twice in a run or in one only, if a text is missing, if references differ, or, where ``flags``
    are asked for, if a row lacks ``has_critical_error``.
    """
    sides = []
    for name, df in (("base", base), ("cand", cand)):
        if flags and "has_critical_error" not in df.columns:
            raise ValueError("a run without has_critical_error")
        twice = df.groupBy(key).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{key} {twice[0][key]} is twice in a run")
        flag = F.col("has_critical_error") if "has_critical_error" in df.columns else F.lit(None).cast("boolean")
        sides.append(df.select(F.col(key), F.col("ref_text").alias(f"ref_{name}"), F.col("hyp_text").alias(f"hyp_{name}"), flag.alias(f"critical_{name}")))
    both = sides[0].join(sides[1], key, "full_outer")
    rule = "ref_base IS NULL OR ref_cand IS NULL OR hyp_base IS NULL OR hyp_cand IS NULL OR ref_base <> ref_cand"
    broken = both.filter(rule + (" OR critical_base IS NULL OR critical_cand IS NULL" if flags else "")).limit(1).collect()
    if broken:
        raise ValueError(f"the runs do not match at {broken[0][key]}")
    return both
