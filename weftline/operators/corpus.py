"""Corpus operators: filters, first-of-duplicates, samples, alignment of two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.stats import positioned
from weftline.schema import strip

LEAST_LENGTH = 3
MOST_RATIO = 3.0


def degenerate(src: Column | str, tgt: Column | str, least: int = LEAST_LENGTH) -> Column:
    """Whether a side is shorter than ``least`` when stripped, or both are the same but for case."""
    a, b = strip(src), strip(tgt)
    return (F.length(a) < least) | (F.length(b) < least) | (F.lower(a) == F.lower(b))


def length_outlier(src: Column | str, tgt: Column | str, most: float = MOST_RATIO) -> Column:
    """Whether one side is more than ``most`` times as long as the other, or empty."""
    a, b = F.length(src), F.length(tgt)
    return (F.least(a, b) == 0) | (F.greatest(a, b) > most * F.least(a, b))


def clean_pairs(df: DataFrame, src: str, tgt: str) -> DataFrame:
    """Rows whose pair is neither degenerate nor a length outlier; a null side is dropped."""
    keep = ~degenerate(src, tgt) & ~length_outlier(src, tgt)
    return df.filter(F.col(src).isNotNull() & F.col(tgt).isNotNull() & F.coalesce(keep, F.lit(False)))


def first_of_pairs(df: DataFrame, src: str, tgt: str, order: str) -> DataFrame:
    """The first row by ``order`` of each distinct pair of texts.

    The least order per 256-bit hash is pre-aggregated before the shuffle, so a pair that fills a third of the rows
    does not gather in one task. Ties in ``order`` keep all their rows.
    """
    digest = F.sha2(F.concat_ws("\t", F.coalesce(F.col(src), F.lit("\x00")), F.coalesce(F.col(tgt), F.lit("\x00"))), 256)
    marked = df.withColumn("_h", digest)
    first = marked.groupBy("_h").agg(F.min(order).alias("_first"))
    kept = marked.alias("x").join(first.alias("y"), (F.col("x._h") == F.col("y._h")) & (F.col(f"x.{order}") == F.col("y._first")), "left_semi")
    return kept.drop("_h")


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 13) -> DataFrame:
    """The k rows of least MD5 of seed and key: a top-k, the same in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(k)


def stratified_sample(df: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """k rows spread evenly over the order of text length (then key): places floor(i n / k)."""
    sized = df.withColumn("_order", F.struct(F.length(text), F.col(key)))
    ranked = positioned(sized, "_order").drop("_order")
    n = df.count()
    if k >= n:
        return ranked.drop("position")
    places = df.sparkSession.range(k).select(F.floor(F.col("id") * F.lit(n / k)).alias("position"))
    return ranked.join(F.broadcast(places), "position", "left_semi").drop("position")


def numbered(df: DataFrame, order: str, prefix: str) -> DataFrame:
    """``df`` with ids prefix-000001 in the given order."""
    return positioned(df, order).withColumn("id", F.format_string(f"{prefix}-%06d", F.col("position") + 1)).drop("position")


def align_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides joined on the key, or an error if a key is on one side only."""
    both = left.join(right, key, "full_outer")
    names = [c for c in both.columns if c != key]
    broken = both.filter(" OR ".join(f"`{c}` IS NULL" for c in names)).limit(1)
    if not broken.isEmpty():
        raise ValueError(f"{key} {broken.first()[key]} is on one side only")
    return both


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: key, side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def single_direction(df: DataFrame) -> tuple[str, str]:
    """The one pair of languages of all rows, or an error."""
    pairs = df.select("src_lang", "tgt_lang").distinct().limit(2).collect()
    if len(pairs) != 1:
        raise ValueError("all rows must share one direction")
    return pairs[0].src_lang, pairs[0].tgt_lang


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the finished ones: how an interrupted run resumes."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", place).filter("_n = 1").drop("_n")
