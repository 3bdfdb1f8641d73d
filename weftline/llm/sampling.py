"""Problem 5: a sample that is the same in every run and layout and keeps its members as data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.1
SALT = "weftline-sample-1"


def unit_hash(key: Column | str, salt: str = SALT) -> Column:
    """A number from [0, 1) that depends on the key's characters and the salt only (first 52 bits of MD5)."""
    digest = F.md5(F.concat(F.lit(salt), F.lit("|"), F.col(key) if isinstance(key, str) else key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def stable_sample(df: DataFrame, key: str = "id", rate: float = RATE, salt: str = SALT) -> DataFrame:
    """The distinct keys whose hash lies below ``rate``, with that hash. Null keys are never in.

    No row looks at another, so added rows never push one out, and a sample at a lower rate lies within one at a
    higher rate. The filter runs before the distinct, so only the sample is shuffled.
    """
    if not 0 <= rate <= 1:
        raise ValueError("the rate lies between 0 and 1")
    place = unit_hash(F.col(key).cast("string"), salt)
    return df.select(F.col(key).cast("string").alias(key), place.alias("place")).filter(F.col("place") < F.lit(float(rate))).distinct()
