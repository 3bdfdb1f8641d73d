"""Queries of the quantity operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import quantities as q
from weftline.session import table


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "segments").select("id", "source", "src_text", "ref_text"), table(spark, d, "evaluations").select("eval_id", "id", "model", "hyp_text")


def p3_found(spark: SparkSession, d: str, left_out: DataFrame | None = None) -> DataFrame:
    """The quantities of all segments and evaluations in common units; ``left_out`` holds eval_ids not to read."""
    return q.quantities(*_texts(spark, d), left_out)


def p3_unit_scales(spark: SparkSession, d: str) -> DataFrame:
    """Each unit of each source that links reach: its scale, that of its spelling, and whether links confirm it."""
    scales = q.unit_scales(q.learned_graph(q.read_all(*_texts(spark, d))))
    rows = [(node.source, u.token, u.dimension, exponent, u.exponent, sure) for node, (exponent, sure) in scales.items() for u in (q.units()[node.unit],)]
    out = spark.createDataFrame(rows, "source string, token string, dimension string, exponent int, spelled int, confirmed boolean")
    return out.withColumn("base_units", F.pow(F.lit(10.0), F.col("exponent")))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_unit_scales": p3_unit_scales}
