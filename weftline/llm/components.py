"""Connected components of a link table, by alternating star contraction on narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpoint


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Columns node, label: the least node of each node's component. Links with a null end are left out.

    Large-star and small-star rounds alternate until nothing changes; each ends in a reliable checkpoint. The least
    neighbour comes from a pre-aggregated minimum and a join, so no neighbourhood is gathered in one task; what a
    hub still concentrates is a join's hot key, which adaptive skew handling splits. Self links give single nodes.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
    edges = checkpoint(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(least, "u")
        small = kept.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("label"))
