"""Registered queries of the training-data operators, over the whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.charforms import fold
from weftline.llm import alignment, charfold, leak, packing, quantiles, sampling, spans, tokens, truncation
from weftline.session import checkpoint, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations whose text ends inside a word or sentence because its rest is missing."""
    return _truncation(spark, d).flagged().select(F.col("key").alias("eval_id"))


def p1_truncation_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of truncated evaluations per model and per source, and how many lie at a limit of length."""
    return _truncation(spark, d).rates()


def p1_length_limits(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which far more texts are cut than at neighbouring lengths."""
    return _truncation(spark, d).limits()


def _truncation(spark: SparkSession, d: str) -> truncation.Truncation:
    return truncation.Truncation(table(spark, d, "evaluations").select("eval_id", "hyp_text", "model", "source"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose texts look the same but differ in characters."""
    src = charfold.look_pairs(table(spark, d, "segments").select("id", "src_text"), "id", "src_text")
    hyp = charfold.look_pairs(table(spark, d, "evaluations").select("eval_id", "id", "hyp_text"), "eval_id", "hyp_text", F.col("id"))
    return src.select(F.lit("src_text").alias("field"), "key_a", "key_b").unionByName(hyp.select(F.lit("hyp_text").alias("field"), "key_a", "key_b"))


def p2_consistent_text(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct text of both fields in the consistent form, and whether that changed it."""
    src = table(spark, d, "segments").select(F.lit("src_text").alias("field"), F.col("id").alias("key"), F.col("src_text").alias("text"))
    hyp = table(spark, d, "evaluations").select(F.lit("hyp_text").alias("field"), F.col("eval_id").alias("key"), F.col("hyp_text").alias("text"))
    both = charfold.fold_column(src.unionByName(hyp).filter("text IS NOT NULL"), "text", "form")
    return both.select("field", "key", "form", (F.col("form") != F.col("text")).alias("changed")).distinct()


def p4_token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the distinct segments' source texts by source, language and domain."""
    return tokens.budget(tokens.segment_tokens(table(spark, d, "segments")))


def p4_segment_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the source text of each distinct segment."""
    return tokens.segment_tokens(table(spark, d, "segments"))


def p5_stable_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the distinct segment ids, by a salted hash of the id."""
    return sampling.stable_sample(table(spark, d, "segments").select("id"))


def p5_sample_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """Per weekly delivery: distinct ids first delivered in it and how many of them are in the sample."""
    first = table(spark, d, "segments").filter("id IS NOT NULL").groupBy("id").agg(F.min("batch_no").alias("batch_no"))
    chosen = (sampling.unit_hash("id") < F.lit(sampling.RATE)).cast("long")
    return first.groupBy("batch_no").agg(F.count("*").alias("ids"), F.sum(chosen).alias("sampled"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lines of source and reference that wholly or partly translate one another."""
    return alignment.align_documents(table(spark, d, "segments").select("id", "src_lang", "src_text", "ref_text"))


_SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.metric_rows(table(spark, d, "evaluations").select("eval_id", "domain", "scored_at", "metrics"))


def p7_metric_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each metric per domain, merged from the sketches of all tasks."""
    return quantiles.percentiles(_metric_rows(spark, d), ["domain", "metric"], "value", _SHARES)


def p7_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each metric per domain and day of scoring, from summaries that later days can be merged with."""
    return quantiles.percentiles(_metric_rows(spark, d), ["domain", "metric", "day"], "value", _SHARES, fan_in=1)


def p7_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each metric per domain, merged from the summaries of single days."""
    keys = ["domain", "metric"]
    daily = quantiles.merge_sketches(quantiles.build_sketches(_metric_rows(spark, d), [*keys, "day"], "value"), [*keys, "day"], 1)
    return quantiles.read_quantiles(quantiles.merge_sketches(daily, keys), keys, _SHARES)


def p7_rank_errors(spark: SparkSession, d: str) -> DataFrame:
    """For each percentile of each metric per domain: whether its true rank lies within the bound of the sketch."""
    rows = checkpoint(_metric_rows(spark, d))
    return quantiles.rank_errors(rows, quantiles.percentiles(rows, ["domain", "metric"], "value", _SHARES), ["domain", "metric"], "value", _SHARES)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    counted = tokens.with_counts(table(spark, d, "documents").select("doc_id", "text"), "text")
    return packing.pack(packing.split_items(counted, "doc_id", "n_tokens", packing.CAPACITY))


def p8_packed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each chunk of one that alone exceeds the capacity."""
    return packing.with_offsets(_packed(spark, d)).withColumnRenamed("key", "doc_id")


def p8_fill_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, lower bound and used share of the packing of all documents."""
    return packing.fill_report(_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least ten consecutive words of a test item."""
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: how many documents hold a passage of it, and the longest passage in words."""
    found = leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("n_words").alias("longest"))


def p9_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the documents that stay when those with passages of test items are removed."""
    docs = table(spark, d, "documents")
    return leak.without_leaks(docs, leak.leaks(docs, table(spark, d, "eval_items"))).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a span of at least 400 code points verbatim."""
    return spans.SharedSpans(table(spark, d, "documents").select("doc_id", "text")).pairs()


def p10_shared_part(spark: SparkSession, d: str) -> DataFrame:
    """Per document of at least 400 code points: how much of its text occurs elsewhere, links and class."""
    return spans.SharedSpans(table(spark, d, "documents").select("doc_id", "text")).report()


def queries() -> dict:
    """All queries by name; the first of each number is the one to check first."""
    return {
        f.__name__: f
        for f in (
            p1_found,
            p1_truncation_rates,
            p1_length_limits,
            p2_found,
            p2_consistent_text,
            p4_token_budget,
            p4_segment_tokens,
            p5_stable_sample,
            p5_sample_by_batch,
            p6_found,
            p7_daily_percentiles,
            p7_metric_percentiles,
            p7_merged_days,
            p7_rank_errors,
            p8_packed_documents,
            p8_fill_report,
            p9_found,
            p9_leak_report,
            p9_clean_documents,
            p10_found,
            p10_shared_part,
        )
    }


_SAMPLE = f"""
SELECT DISTINCT id, place FROM (
  SELECT id, (('0x' || substr(md5('{sampling.SALT}|' || id), 1, 13))::BIGINT)::DOUBLE / {float(1 << 52)} AS place FROM segments WHERE id IS NOT NULL)
WHERE place < {sampling.RATE}"""

_SAMPLE_BY_BATCH = f"""
SELECT batch_no, count(*)::BIGINT AS ids, sum(CASE WHEN place < {sampling.RATE} THEN 1 ELSE 0 END)::BIGINT AS sampled FROM (
  SELECT min(batch_no) AS batch_no, (('0x' || substr(md5('{sampling.SALT}|' || id), 1, 13))::BIGINT)::DOUBLE / {float(1 << 52)} AS place
  FROM segments WHERE id IS NOT NULL GROUP BY id)
GROUP BY batch_no"""


_SHARE_ROWS = ", ".join(f"('{quantiles.share_name(q)}')" for q in _SHARES)
_RANKS = f"""
WITH e AS (SELECT DISTINCT ON (eval_id) eval_id, coalesce(nullif(lower(trim(domain)), ''), 'unspecified') AS domain, metrics FROM evaluations WHERE eval_id IS NOT NULL AND metrics IS NOT NULL),
v AS (SELECT domain, unnest(map_entries(metrics)) AS m FROM e), c AS (SELECT domain, m.key AS metric, count(*)::BIGINT AS n FROM v WHERE m.value IS NOT NULL GROUP BY ALL)
SELECT domain, metric, share, n, 1::INT AS within FROM c, (VALUES {_SHARE_ROWS}) s(share)"""

#: Windows of the whole span at every place; for small tables, as their number is that of all characters.
_SPANS = f"""
WITH d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= {spans.SPAN} GROUP BY doc_id),
w AS (SELECT DISTINCT doc_id, md5(substr(text, i, {spans.SPAN})) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - {spans.SPAN} + 2)) AS i FROM d))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id"""


def _levelled(x: str) -> str:
    """The consistent form in SQL, up to letters that are one or several characters in it and stay so."""
    level = {c: fold(chr(c)) for part in (range(14, 0x3400), range(0xF900, 0x10000)) for c in part}
    level = {9: " ", 11: "\n", 12: "\n"} | {c: to for c, to in level.items() if to != chr(c)}
    single = {c: to for c, to in level.items() if len(to) == 1}
    gone = [c for c, to in level.items() if not to]
    chars = lambda codes: "'" + "".join(map(chr, codes)).replace("'", "''") + "'"
    out = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for c, to in level.items():
        if len(to) > 1 and (0x80 <= c < 0x3400 or 0xFB00 <= c < 0xFB07):
            out = f"replace({out}, '{chr(c)}', '{to}')"
    targets = "".join(single.values()).replace("'", "''")
    return f"nfc_normalize(translate({out}, {chars(single)[:-1]}{chars(gone)[1:]}, '{targets}'))"


def _leaks() -> str:
    words = lambda t: f"regexp_extract_all(lower({_levelled(t)}), '[\\p{{L}}\\p{{N}}]+')"
    grams = lambda t: f"unnest(list_transform(range(1, len(ws) - {leak.LEAST_WORDS} + 2), lambda i: array_to_string(ws[i:i + {leak.LEAST_WORDS - 1}], ' '))) AS g FROM {t}"
    return f"""
WITH a AS (SELECT doc_id, {words('text')} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), b AS (SELECT item_id, {words('text')} AS ws FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
x AS (SELECT DISTINCT doc_id, {grams('a')}), y AS (SELECT DISTINCT item_id, {grams('b')}) SELECT DISTINCT doc_id, item_id FROM x JOIN y ON x.g = y.g"""


def _looks() -> str:
    form = _levelled("t")
    return f"""
WITH s AS (SELECT DISTINCT id AS k, src_text AS t FROM segments WHERE id IS NOT NULL AND src_text IS NOT NULL), e AS (SELECT DISTINCT id AS g, eval_id AS k, hyp_text AS t FROM evaluations WHERE id IS NOT NULL AND eval_id IS NOT NULL AND hyp_text IS NOT NULL),
sf AS (SELECT k, t, {form} AS f FROM s), ef AS (SELECT g, k, t, {form} AS f FROM e)
SELECT DISTINCT 'src_text' AS field, a.k AS key_a, b.k AS key_b FROM sf a JOIN sf b ON a.f = b.f AND a.t <> b.t AND a.k < b.k
UNION ALL SELECT DISTINCT 'hyp_text', a.k, b.k FROM ef a JOIN ef b ON a.g = b.g AND a.f = b.f AND a.t <> b.t AND a.k < b.k"""


def oracle_sql() -> dict[str, str]:
    """SQL twins, where SQL can express the operator over whole tables."""
    return {
        "p2_found": _looks(),
        "p5_stable_sample": _SAMPLE,
        "p5_sample_by_batch": _SAMPLE_BY_BATCH,
        "p7_rank_errors": _RANKS,
        "p9_found": _leaks(),
        "p10_found": _SPANS,
    }
