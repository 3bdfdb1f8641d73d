"""Registered queries of the corpus and scoring operators, over the whole tables of a data folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import detect, metrics, text
from weftline.operators import aggregate, corpus, stats, translate
from weftline.plans import corpora
from weftline.schema import collapse, domain, language, strip
from weftline.session import checkpoint, table
from weftline.sources import readers

def _scored(spark: SparkSession, d: str) -> DataFrame:
    return detect.with_findings(corpora.reports(spark, d), bank=corpora.REPORT_BANK)


def critical_error_rate_by_system(spark: SparkSession, d: str) -> DataFrame:
    """Share of reports with a critical finding per system."""
    rate = F.avg(detect.has_critical("findings").cast("int"))
    return _scored(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.round(rate, 6).alias("critical_error_rate"))


def _codes(found: DataFrame) -> DataFrame:
    # explode would let the optimizer filter by the findings' number first, and work them out twice
    each = found.select("model", F.explode_outer("f").alias("f")).filter("f IS NOT NULL")
    return each.groupBy("model", F.col("f.code").alias("code"), F.col("f.severity").alias("severity")).agg(F.count("*").alias("n"))


def _of_reports(spark: SparkSession, d: str, detector: str) -> DataFrame:
    return _codes(detect.with_findings(corpora.reports(spark, d), bank=corpora.REPORT_BANK, into="f", detectors=(detector,)))


def negation_findings(spark: SparkSession, d: str) -> DataFrame:
    """Negation findings by system and code."""
    return _of_reports(spark, d, "negation")


def laterality_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of sides by system and code; a flip counts twice."""
    return _of_reports(spark, d, "laterality")


def number_mismatch_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of numbers by system; another unit of the same quantity is none."""
    return _of_reports(spark, d, "numbers")


def terminology_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of terms by system."""
    return _of_reports(spark, d, "terminology")


def _summary_map(spark: SparkSession, d: str, name: str, value: str) -> DataFrame:
    out = aggregate.run_summary(_scored(spark, d)).select(F.explode(name).alias("code", "v"))
    return out.select("code", (F.round("v", 6) if value == "rate" else F.col("v").cast("bigint")).alias(value))


def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    """All findings of the run by code."""
    return _summary_map(spark, d, "finding_counts", "n")


def error_segment_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of the run's rows with each code."""
    return _summary_map(spark, d, "error_segment_rates", "rate")


def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    """All findings of the run by severity."""
    return _summary_map(spark, d, "severity_counts", "n")


def detector_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which detectors run for each pair of languages of the segments."""
    pairs = corpora.segments(spark, d).select("src_lang", "tgt_lang").distinct().withColumn("c", detect.coverage(F.col("src_lang"), F.col("tgt_lang")))
    return pairs.select("src_lang", "tgt_lang", *(F.col(f"c.{n}").cast("int").alias(n) for n in ("negation", "laterality", "number_or_measurement", "terminology")))


def leaderboard_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the leaderboard of the derived reports."""
    out = aggregate.leaderboard(_scored(spark, d))
    return out.select("model", "direction", "domain", "n_segments", *(F.round(c, 6).alias(c) for c in ("critical_error_rate", *aggregate.RATES)))


def leaderboard_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Leaderboard of all evaluations from their own findings and COMET values."""
    rows = corpora.evaluations(spark, d).withColumn("ref_text", F.lit(None).cast("string"))
    out = aggregate.leaderboard(rows, F.try_element_at("metrics", F.lit("comet")))
    return out.select("model", "direction", "domain", "n_segments", F.round("comet", 3).alias("comet"), *(F.round(c, 6).alias(c) for c in ("critical_error_rate", *aggregate.RATES)))


def leaderboard_surface(spark: SparkSession, d: str) -> DataFrame:
    """Leaderboard with corpus BLEU, chrF++ and TER of all evaluations that have a reference."""
    rows = aggregate.with_stats(corpora.referenced(spark, d))
    return aggregate.leaderboard(rows, F.try_element_at("metrics", F.lit("comet")))


def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Run summary of each system over all its evaluations from their own findings; references by segment."""
    refs = corpora.segments(spark, d).select("id", F.nullif("ref_text", F.lit("")).alias("ref_text"))
    out = aggregate.run_summary(corpora.evaluations(spark, d).select("id", "model", "findings", "metrics").join(refs, "id"), ["model"])
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda s, n: s + n)
    pick = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    return out.select(
        "model",
        "n_segments",
        F.col("has_references").cast("int").alias("has_references"),
        "critical_error_segments",
        F.round("critical_error_rate", 6).alias("critical_error_rate"),
        total("finding_counts").alias("findings"),
        pick("finding_counts", "number_or_measurement_mismatch").alias("number_findings"),
        pick("severity_counts", "critical").alias("critical_findings"),
        F.round(pick("error_segment_rates", "negation_dropped").cast("double"), 6).alias("negation_dropped_rate"),
        F.round("comet", 6).alias("comet"),
    )


def _surface(spark: SparkSession, d: str, name: str, *shown: int) -> DataFrame:
    size, counts, form = metrics.COUNTERS[name]
    rows = corpora.referenced(spark, d).select("model", counts("hyp_text", "ref_text").alias("s"))
    sums = rows.groupBy("model").agg(F.count("*").alias("n"), metrics.sum_stats("s", size).alias("s"))
    return sums.select("model", "n", *(F.col("s")[i].alias(f"s{i}") for i in shown), F.round(form(F.col("s")), 4).alias(name))


def corpus_bleu_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Corpus BLEU of all evaluations with a reference, by system."""
    return _surface(spark, d, "bleu", 0, 1, 2, 5)


def corpus_chrf_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Corpus chrF++ of all evaluations with a reference, by system."""
    return _surface(spark, d, "chrf", 0, 17, 23)


def corpus_bleu_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Corpus BLEU of the derived reports by system and domain."""
    rows = corpora.reports(spark, d).withColumn("s", metrics.bleu_stats("hyp_text", "ref_text"))
    sums = rows.groupBy("model", "domain").agg(metrics.sum_stats("s", metrics.BLEU_SIZE).alias("s"))
    return sums.select("model", "domain", F.col("s")[0].alias("sys_len"), F.col("s")[2].alias("correct_1"), F.col("s")[5].alias("correct_4"), F.round(metrics.bleu(F.col("s")), 4).alias("bleu"))


def sentence_bleu(spark: SparkSession, d: str) -> DataFrame:
    """Mean and least sentence BLEU of the derived reports by system."""
    rows = corpora.reports(spark, d).withColumn("b", metrics.bleu(metrics.bleu_stats("hyp_text", "ref_text")))
    return rows.groupBy("model").agg(F.round(F.avg("b"), 4).alias("mean_bleu"), F.round(F.min("b"), 4).alias("least_bleu"))


def corpus_chrf_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Corpus chrF++ of the derived reports by system and domain."""
    rows = corpora.reports(spark, d).withColumn("s", metrics.chrf_stats("hyp_text", "ref_text"))
    sums = rows.groupBy("model", "domain").agg(metrics.sum_stats("s", metrics.CHRF_SIZE).alias("s"))
    return sums.select("model", "domain", F.col("s")[0].alias("hyp_1"), F.col("s")[17].alias("match_6"), F.col("s")[23].alias("match_words_2"), F.round(metrics.chrf(F.col("s")), 4).alias("chrf"))


def corpus_ter_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Corpus TER of the derived reports by system and domain."""
    rows = corpora.reports(spark, d).withColumn("s", metrics.ter_stats("hyp_text", "ref_text"))
    sums = rows.groupBy("model", "domain").agg(metrics.sum_stats("s", 2).alias("s"))
    return sums.select("model", "domain", F.col("s")[0].alias("edits"), F.col("s")[1].alias("ref_words"), F.round(metrics.ter(F.col("s")), 4).alias("ter"))


def evaluation_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the four detectors over all evaluations with the term bank, by system and code."""
    bank = readers.term_bank(table(spark, d, "term_bank"))
    rows = corpora.evaluations(spark, d).select("id", "model", "src_lang", "tgt_lang", "hyp_text").filter("hyp_text IS NOT NULL")
    return _codes(detect.with_findings(rows.join(corpora.segments(spark, d).select("id", "src_text"), "id"), bank=bank, into="f"))


def _of_evaluations(spark: SparkSession, d: str, detector: str) -> DataFrame:
    rows = corpora.evaluations(spark, d).select("id", "model", "src_lang", "tgt_lang", "hyp_text").filter("hyp_text IS NOT NULL")
    bank = readers.term_bank(table(spark, d, "term_bank")) if detector == "terminology" else None
    return _codes(detect.with_findings(rows.join(corpora.segments(spark, d).select("id", "src_text"), "id"), bank=bank, into="f", detectors=(detector,)))


def evaluation_negation(spark: SparkSession, d: str) -> DataFrame:
    """Negation findings of all evaluations with a text, by system and code."""
    return _of_evaluations(spark, d, "negation")


def evaluation_laterality(spark: SparkSession, d: str) -> DataFrame:
    """Findings of sides of all evaluations with a text, by system and code."""
    return _of_evaluations(spark, d, "laterality")


def evaluation_terminology(spark: SparkSession, d: str) -> DataFrame:
    """Findings of terms of all evaluations with a text and the term bank, by system."""
    return _of_evaluations(spark, d, "terminology")


def length_ratio_filter(spark: SparkSession, d: str) -> DataFrame:
    """Segments that pass the filters of degenerate pairs and length outliers, by source."""
    kept = corpus.clean_pairs(corpora.segments(spark, d), "src_text", "ref_text")
    return kept.groupBy("source").agg(F.count("*").alias("kept"))


def length_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Mean length of evaluations by that of their source text, per system: far below one hints at cut texts."""
    rows = corpora.referenced(spark, d).filter("src_text <> ''")
    return rows.groupBy("model").agg(F.round(F.avg(F.length("hyp_text") / F.length("src_text")), 6).alias("ratio"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The least id of each distinct pair of texts."""
    return corpus.first_of_pairs(corpora.segments(spark, d).filter("ref_text IS NOT NULL"), "src_text", "ref_text", "id").select("id")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """400 segments by the hash of seed and id."""
    return corpus.hash_sample(corpora.segments(spark, d).select("id"), "id", 400)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 segments spread evenly over the lengths of source texts."""
    rows = corpora.segments(spark, d).filter("src_text IS NOT NULL").select("id", "src_text")
    return corpus.stratified_sample(rows, "src_text", "id", 100).select("id", F.length("src_text").alias("n_chars"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Number of sentences and of their characters per document."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.length(F.array_join("s", "")).alias("n_chars"))


def chunk_reassemble(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into chunks and put together again."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    parts = text.chunk_documents(docs, "doc_id", "text", 64)
    return text.reassemble(docs, parts, "doc_id").select("doc_id", F.md5("text").alias("digest"))


def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents by their number per document."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    return docs.select(F.size(text.chunks("text", 64)).alias("n_chunks")).groupBy("n_chunks").agg(F.count("*").alias("documents"))


def align_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Segments that only one of two systems has translated, by side."""
    rows = table(spark, d, "evaluations")
    sides = corpus.unmatched(rows.filter("model = 'aster-600m'").select("id"), rows.filter("model = 'kelp-api'").select("id"), "id")
    return sides.groupBy("side").agg(F.count("*").alias("n"))


def _two(spark: SparkSession, d: str) -> DataFrame:
    rows = corpora.evaluations(spark, d).select("id", "model", "has_critical_error", F.try_element_at("metrics", F.lit("chrf")).alias("chrf"))
    sides = [rows.filter(F.col("model") == m).groupBy("id").agg(F.bool_or("has_critical_error").alias(f"crit_{n}"), F.max("chrf").alias(f"chrf_{n}")) for n, m in (("a", "aster-600m"), ("b", "kelp-api"))]
    return sides[0].join(sides[1], "id")


def mcnemar_systems(spark: SparkSession, d: str) -> DataFrame:
    """Exact McNemar test of the critical flags of two systems over their common segments."""
    out = stats.mcnemar(_two(spark, d), "crit_a", "crit_b")
    return out.withColumn("p_value", F.round("p_value", 9))


def bootstrap_critical_rate(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of the critical rate of one system."""
    out = stats.bootstrap_proportion(_two(spark, d), "id", "crit_a")
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


def paired_bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of the mean of the recorded sentence chrF of two systems."""
    rows = _two(spark, d).filter("chrf_a IS NOT NULL AND chrf_b IS NOT NULL")
    rows = rows.select("id", F.array("chrf_a", F.lit(1.0)).alias("a"), F.array("chrf_b", F.lit(1.0)).alias("b"))
    out = stats.paired_bootstrap(rows, "id", "a", "b", 2, lambda s: s[0] / s[1])
    return out.select(*(F.round(c, 6).alias(c) for c in ("observed_difference", "ci_low", "ci_high", "p_value")))


def _paired_bootstrap(spark: SparkSession, d: str, name: str) -> DataFrame:
    size, counts, form = metrics.COUNTERS[name]
    rows = corpora.referenced(spark, d).filter("model IN ('aster-600m', 'kelp-api')").select("id", "model", counts("hyp_text", "ref_text").alias("s"))
    sides = rows.groupBy("id").agg(*(F.min(F.when(F.col("model") == m, F.col("s"))).alias(n) for n, m in (("a", "aster-600m"), ("b", "kelp-api"))))
    return stats.paired_bootstrap(sides.filter("a IS NOT NULL AND b IS NOT NULL"), "id", "a", "b", size, form)


def paired_bootstrap_bleu(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of corpus BLEU of two systems."""
    return _paired_bootstrap(spark, d, "bleu")


def paired_bootstrap_chrf(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of corpus chrF++ of two systems."""
    return _paired_bootstrap(spark, d, "chrf")


def roundtrip_step_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ten cycles of the control translator over all segments with source, reference and known languages.

    A round trip per pair of languages; ``direction`` is that of the step, so that a row is one step of one trip.
    """
    rows = checkpoint(corpora.segments(spark, d).filter("src_text <> '' AND ref_text <> '' AND src_lang <> tgt_lang"))
    pairs = sorted(tuple(r) for r in rows.select("src_lang", "tgt_lang").distinct().collect())  # few languages are known
    if not pairs:
        raise ValueError("no segments")
    trips = [translate.round_trip(rows.filter((F.col("src_lang") == a) & (F.col("tgt_lang") == b)), translate.create("identity"), cycles=10) for a, b in pairs]
    brief = [t.select(F.lit(i).alias("trip"), "model", "step", "cycle", "direction", "hyp_text", "metrics", "findings", "has_critical_error", "hop_has_critical_error") for i, t in enumerate(trips)]
    curve = aggregate.step_curve(reduce(DataFrame.unionByName, brief), ["trip", "model"])
    return curve.withColumnsRenamed({"n": "n_segments", "crit_rate": "critical_error_rate", "mean_chars": "mean_output_chars"}).drop("trip")


def evaluation_steps(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations by week of scoring in the form of a step table: means, critical rate, mean length."""
    rows = corpora.evaluations(spark, d).filter("scored_at IS NOT NULL AND hyp_text IS NOT NULL").withColumn("step", F.weekofyear("scored_at"))
    rows = rows.withColumn("cycle", F.lit(1)).withColumn("direction", F.lit("all"))
    out = aggregate.step_summary(rows)
    return out.select("step", "n_segments", *(F.round(c, 6).alias(c) for c in ("critical_error_rate", "bleu", "chrf", "ter", "mean_output_chars")))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations by system and month of scoring in the form of a step table."""
    metric = F.try_element_at("metrics", F.lit("bleu"))
    rows = corpora.evaluations(spark, d).filter("scored_at IS NOT NULL AND hyp_text IS NOT NULL").groupBy("model", F.month("scored_at").alias("step"))
    return rows.agg(F.round(F.avg(metric), 6).alias("bleu"), F.avg(F.length("hyp_text")).alias("mean_output_chars")).withColumn("cycle", F.expr("(step + 1) DIV 2"))


def curve_delta(spark: SparkSession, d: str) -> DataFrame:
    """Change and front-loaded share of each system's curve over the months of scoring."""
    out = aggregate.curve_summary(_steps(spark, d), last_cycle=6)
    return out.select("model", "c1", "c2", "c_last", F.round("delta", 5).alias("delta"), F.round("front_loaded", 4).alias("front_loaded"))


def curve_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A system per row, a step per column."""
    out = aggregate.wide_curve(_steps(spark, d), "bleu", list(range(1, 13)))
    return out.select("model", *(F.col(str(i)).alias(f"step_{i}") for i in range(1, 13)))


def system_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Systems by the metric of their first step, and whether their outputs shrink."""
    steps = _steps(spark, d)
    first = aggregate.ranked(steps).withColumn("place", F.row_number().over(Window.orderBy(F.desc("bleu"), "model")))
    return first.join(aggregate.shrinking(steps).select("model", F.col("shrinks").cast("int").alias("shrinks")), "model")


def lag_hop_input(spark: SparkSession, d: str) -> DataFrame:
    """Length of what each evaluation would take in if a segment's systems worked in a row."""
    rows = corpora.evaluations(spark, d).filter("hyp_text IS NOT NULL").join(corpora.segments(spark, d).filter("src_text IS NOT NULL").select("id", "src_text"), "id")
    taken = text.previous_output(["id"], "eval_id", "hyp_text", "src_text")
    return rows.select("eval_id", taken.alias("t")).select("eval_id", F.length("t").alias("input_chars"))


def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Rows of segments by resolved languages and domain."""
    rows = table(spark, d, "segments").select(language("src_lang").alias("src_lang"), language("tgt_lang").alias("tgt_lang"), domain("domain").alias("domain"))
    return rows.groupBy("src_lang", "tgt_lang", "domain").agg(F.count("*").alias("n"))


def parrot_filter(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the German and Turkish report records."""
    rows = table(spark, d, "parrot_raw")
    both = readers.report_segments(rows, "de", "en").unionByName(readers.report_segments(rows, "tr", "en"))
    return both.select("id", "domain", "src_lang", F.col("metadata.area").alias("area"), F.length("src_text").alias("src_chars"), F.length("ref_text").alias("ref_chars"))


def area_fold(spark: SparkSession, d: str) -> DataFrame:
    """Report records by folded area."""
    return table(spark, d, "parrot_raw").groupBy(text.area("area").alias("area")).agg(F.count("*").alias("n"))


def sgml_segment_parse(spark: SparkSession, d: str) -> DataFrame:
    """Test items written as SGML by suite and parsed again."""
    items = table(spark, d, "eval_items")
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    seg = F.concat(F.lit('<seg id="'), F.col("item_id").cast("string"), F.lit('">\n  '), escaped, F.lit("\n</seg>"))
    files = items.groupBy("suite").agg(F.array_join(F.array_sort(F.collect_list(seg)), "\n").alias("sgml"))  # a file per suite, of fixed size
    out = readers.sgml_segments(files, "sgml", ["suite"])
    return out.select("suite", F.col("seg_id").cast("bigint").alias("item_id"), "text")


def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations wrapped in a thought and freed of it again."""
    rows = corpora.evaluations(spark, d).filter("hyp_text IS NOT NULL")
    wrapped = F.concat(F.lit("<think>plan\nof "), "model", F.lit("</think>\n\n"), "hyp_text")
    return rows.select("eval_id", F.length(text.strip_thinking(wrapped)).alias("n_chars"))


def same_model(spark: SparkSession, d: str) -> DataFrame:
    """Whether served names with name space and snapshot are the requested systems."""
    names = table(spark, d, "evaluations").select("model").distinct()
    served = F.concat(F.lit("Org/"), F.upper("model"), F.lit("-v0731"))
    other = F.concat(F.lit("org/"), F.col("model"), F.lit("-mini"))
    return names.select("model", text.model_leaf("model").alias("leaf"), text.same_model("model", served).cast("int").alias("snapshot"), text.same_model("model", other).cast("int").alias("other"))


def batch_parse(spark: SparkSession, d: str) -> DataFrame:
    """Numbered replies made of each segment's evaluations (about a dozen) and parsed again."""
    rows = corpora.evaluations(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("eval_id", F.coalesce("hyp_text", F.lit("")).alias("h")))), lambda x: x["h"]).alias("texts"))
    reply = F.array_join(F.transform("texts", lambda t, i: F.concat(F.lit("[["), (i + 1).cast("string"), F.lit("]]\n"), t)), "\n\n")
    parsed = text.parse_batch(reply, F.size("texts"))
    return rows.select("id", F.size("texts").alias("n"), F.length(F.array_join(parsed, "|")).alias("parsed_chars"))


def text_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Length of the prompt of each segment with a known direction."""
    rows = corpora.segments(spark, d).filter("src_text IS NOT NULL AND src_lang IS NOT NULL AND tgt_lang IS NOT NULL")
    return rows.select("id", F.length(text.single_prompt("src_text", "src_lang", "tgt_lang")).alias("prompt_chars"))


def resume_rest(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of system and domain that still lack a run, given those of the first half of the systems."""
    rows = corpora.evaluations(spark, d).select("model", "domain").distinct()
    return corpus.not_done(rows, rows.filter("model < 'g'"), ["model", "domain"])


def white_space(spark: SparkSession, d: str) -> DataFrame:
    """Length of documents stripped and with white space collapsed."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.length(strip("text")).alias("stripped"), F.length(collapse("text")).alias("collapsed"))


QUERIES = (
    critical_error_rate_by_system, negation_findings, laterality_findings, number_mismatch_findings, terminology_findings, finding_counts, error_segment_rates, severity_counts,
    detector_coverage, leaderboard_rates, leaderboard_evaluations, leaderboard_surface, run_summaries, corpus_bleu_evaluations, corpus_chrf_evaluations, corpus_bleu_by_group, sentence_bleu, corpus_chrf_by_group, corpus_ter_by_group,
    evaluation_findings, evaluation_negation, evaluation_laterality, evaluation_terminology, length_ratio_filter, length_ratio, dedup_first, hash_sample, stratified_sample, sentence_split, chunk_reassemble, chunk_sizes, align_unmatched,
    mcnemar_systems, bootstrap_critical_rate, paired_bootstrap_mean, paired_bootstrap_chrf, paired_bootstrap_bleu, roundtrip_step_summary, evaluation_steps, curve_delta, curve_pivot, system_ranking,
    lag_hop_input, alias_resolve, parrot_filter, area_fold, sgml_segment_parse, strip_thinking, same_model, batch_parse, text_prompts, resume_rest, white_space,
)


def queries() -> dict:
    """All queries by name."""
    return {f.__name__: f for f in QUERIES}
