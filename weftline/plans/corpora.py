"""Corpora that the queries read: real tables, and reports derived from lineitem by one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.schema import domain, language
from weftline.session import spread, table

#: Reports with known faults. By ``fault``: 0 and 5 negation, 1 side, 2 number, 3 other unit, 4 term, else none.
REPORTS_SQL = """
WITH b AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, CAST(l_quantity AS INT) AS q,
         l_linenumber % 2 = 0 AS is_left, l_returnflag = 'N' AS neg, (l_orderkey * 7 + l_linenumber) % 10 AS fault
  FROM lineitem),
t AS (
  SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'Pleuraerguss' ELSE 'Atelektase' END AS term_de,
            CASE WHEN l_suppkey % 2 = 0 THEN 'pleural effusion' ELSE 'atelectasis' END AS term_en
  FROM b)
SELECT CONCAT('rep-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id,
       CONCAT('sys-', l_linestatus) AS model, CONCAT('dom-', l_returnflag) AS domain, 'de' AS src_lang, 'en' AS tgt_lang,
       CONCAT(CASE WHEN neg THEN 'Kein Pneumothorax' ELSE 'Pneumothorax' END, ' sichtbar. Ein ', CAST(q AS STRING),
              ' mm Knoten im ', CASE WHEN is_left THEN 'linken' ELSE 'rechten' END, ' Oberlappen. ', term_de, ' vorhanden.') AS src_text,
       CONCAT(CASE WHEN neg THEN 'No pneumothorax' ELSE 'Pneumothorax' END, ' visible. A ', CAST(q AS STRING),
              ' mm nodule in the ', CASE WHEN is_left THEN 'left' ELSE 'right' END, ' upper lobe. ', term_en, ' present.') AS ref_text,
       CONCAT(CASE WHEN (neg AND fault <> 0) OR (NOT neg AND fault = 5) THEN 'No pneumothorax' ELSE 'Pneumothorax' END, ' visible. A ',
              CASE WHEN fault = 2 THEN CONCAT(CAST(q + 1 AS STRING), ' mm')
                   WHEN fault = 3 THEN CONCAT(CAST(CAST(FLOOR(q / 10) AS INT) AS STRING), '.', CAST(q % 10 AS STRING), ' cm')
                   ELSE CONCAT(CAST(q AS STRING), ' mm') END,
              ' nodule in the ', CASE WHEN is_left = (fault <> 1) THEN 'left' ELSE 'right' END, ' upper lobe. ',
              CASE WHEN fault = 4 THEN 'finding' ELSE term_en END, ' present.') AS hyp_text,
       CASE WHEN neg AND fault = 0 THEN 'negation_dropped' WHEN NOT neg AND fault = 5 THEN 'negation_introduced' END AS truth_negation,
       fault = 1 AS truth_side, fault = 2 AS truth_number, fault = 4 AS truth_term
FROM t"""

REPORT_BANK = [("T1", "pleural effusion", "Pleuraerguss"), ("T2", "atelectasis", "Atelektase")]


def reports(spark: SparkSession, d: str) -> DataFrame:
    """The derived reports with their truth columns."""
    columns = ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"]
    return spark.sql(REPORTS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spread(table(spark, d, "lineitem").select(*columns)))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Distinct segments by id (texts are equal in all deliveries), languages as codes, domains in lower case."""
    rows = table(spark, d, "segments").select("id", "source", domain("domain").alias("domain"), language("src_lang").alias("src_lang"), language("tgt_lang").alias("tgt_lang"), "src_text", "ref_text")
    return rows.filter("id IS NOT NULL").dropDuplicates(["id"])


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct evaluations, languages as codes, domains in lower case."""
    rows = table(spark, d, "evaluations").filter("eval_id IS NOT NULL").dropDuplicates(["eval_id"])
    return rows.withColumn("src_lang", language("src_lang")).withColumn("tgt_lang", language("tgt_lang")).withColumn("domain", domain("domain"))


def referenced(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations with text and the non-empty reference of their segment, narrow."""
    refs = segments(spark, d).filter("ref_text <> ''").select("id", "src_text", "ref_text")
    rows = evaluations(spark, d).filter("hyp_text IS NOT NULL")
    return rows.select("eval_id", "id", "model", "domain", "source", "src_lang", "tgt_lang", "hyp_text", "findings", "metrics", "has_critical_error").join(refs, "id")
