import json
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weftline.functions import metrics, text
from weftline.operators import aggregate, corpus, stats, translate
from weftline.sources import writers
from weftline.streaming import scorer

FINDING = "array<struct<code:string,severity:string>>"


def rows(spark):
    data = [
        ("a", "m", "de", "en", "d", "r", "h", [("negation_dropped", "critical"), ("negation_dropped", "critical")], {"comet": 0.5}),
        ("b", "m", "de", "en", "d", "r", "h", [("negation_introduced", "critical"), ("laterality_added_or_flipped", "critical")], {"comet": None}),
        ("c", "m", "de", "en", "d", "r", "h", [("terminology_not_preserved", "major")], None),
        ("d", "m", "de", "en", "d", "r", "h", None, {}),
        ("e", None, None, "en", None, None, "h", [], {}),
    ]
    return spark.createDataFrame(data, f"id string, model string, src_lang string, tgt_lang string, domain string, ref_text string, hyp_text string, findings {FINDING}, metrics map<string,double>")


def test_leaderboard(spark):
    table = aggregate.leaderboard(aggregate.with_stats(rows(spark)), F.try_element_at("metrics", F.lit("comet")))
    assert table.columns == aggregate.LEADERBOARD_COLUMNS
    got = {r["model"]: r for r in table.collect()}
    m = got["m"]
    assert (m["direction"], m["n_segments"], m["critical_error_rate"], m["negation_flip_rate"], m["laterality_error_rate"], m["number_error_rate"], m["terminology_error_rate"], m["comet"]) == ("de→en", 4, 0.5, 0.5, 0.25, 0.0, 0.25, 0.5)
    assert m["bleu"] == 0 and m["ter"] == 100
    u = got["unknown"]
    assert (u["direction"], u["domain"], u["bleu"], u["comet"]) == ("?→en", "unspecified", None, None)


def test_run_summary(spark):
    s = aggregate.run_summary(rows(spark)).first()
    assert (s["n_segments"], s["critical_error_segments"], s["critical_error_rate"]) == (5, 2, 0.4)
    assert s["finding_counts"] == {"negation_dropped": 2, "negation_introduced": 1, "laterality_added_or_flipped": 1, "terminology_not_preserved": 1}
    assert s["error_segment_rates"]["negation_dropped"] == 0.2 and s["severity_counts"] == {"critical": 4, "major": 1}
    empty = aggregate.run_summary(rows(spark).limit(0)).first()
    assert (empty["n_segments"], empty["critical_error_rate"], empty["finding_counts"]) == (0, 0.0, {})


def test_curves(spark):
    data = [("x", 2 * c - 1, c, float(b), 100.0 - c) for c, b in ((1, 50), (2, 40), (3, 30))] + [("identity", 1, 1, 90.0, 1.0)]
    steps = spark.createDataFrame(data, "model string, step int, cycle int, bleu double, mean_output_chars double")
    got = {r["model"]: r for r in aggregate.curve_summary(steps, last_cycle=3).collect()}
    assert (got["x"]["delta"], got["x"]["front_loaded"]) == (-20.0, 0.5) and got["identity"]["delta"] is None
    assert [r["model"] for r in aggregate.ranked(steps).collect()] == ["x"]


def test_mcnemar_is_exact(spark):
    cases = [(0, 0), (0, 1), (3, 9), (10, 10), (40, 71), (900, 1100)]
    df = spark.createDataFrame(cases, "b long, c long").select("b", "c", stats.binomial_tail(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        n = r["b"] + r["c"]
        exact = min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(min(r["b"], r["c"]) + 1)), 2**n))) if n else 1.0
        assert abs(r["p"] - exact) < 1e-9


def test_bootstrap(spark):
    rng = random.Random(2)
    data = [(f"{i:03d}", [rng.randint(0, 4), 5], [rng.randint(1, 5), 5], rng.random() < 0.3) for i in range(80)]
    df = spark.createDataFrame(data, "id string, a array<long>, b array<long>, f boolean").repartition(3)
    run = lambda: tuple(stats.paired_bootstrap(df, "id", "a", "b", 2, lambda s: s[0] / s[1], 100).first())
    first = run()
    want = sum(x[2][0] - x[1][0] for x in data) / 400
    assert math.isclose(first[0], want) and first[1] <= want <= first[2] and first == run()
    with pytest.raises(ValueError, match="100"):
        stats.paired_bootstrap(df, "id", "a", "b", 2, lambda s: s[0], 99)
    with pytest.raises(ValueError, match="no pairs"):
        stats.paired_bootstrap(df.limit(0), "id", "a", "b", 2, lambda s: s[0], 100)
    p = stats.bootstrap_proportion(df, "id", "f", 100).first()
    assert math.isclose(p["observed"], sum(x[3] for x in data) / 80) and p["ci_low"] <= p["observed"] <= p["ci_high"]


def test_positions_filters_and_samples(spark):
    df = spark.range(1000).selectExpr("concat('k', lpad(id, 4, '0')) AS id", "repeat('x', cast(id % 37 as int)) AS t", "1 AS position").drop("position").repartition(5)
    got = [r["position"] for r in stats.positioned(df, "id").orderBy("id").collect()]
    assert got == list(range(1000))
    assert corpus.stratified_sample(df, "t", "id", 20).count() == 20 and corpus.stratified_sample(df.limit(3), "t", "id", 20).count() == 3
    assert {r.id for r in corpus.hash_sample(df, "id", 5).collect()} == {r.id for r in corpus.hash_sample(df.repartition(2), "id", 5).collect()}
    pairs = spark.createDataFrame([(1, "abc", "def"), (2, "abc", "def"), (3, "ab", "def"), (4, "same", " SAME"), (5, "abc", "d" * 10), (6, None, "x"), (7, "", "abc")], "i int, s string, t string")
    assert [r.i for r in corpus.clean_pairs(pairs, "s", "t").orderBy("i").collect()] == [1, 2]
    assert [r.i for r in corpus.first_of_pairs(pairs, "s", "t", "i").orderBy("i").collect()] == [1, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError, match="one side only"):
        corpus.align_sides(pairs.select("i", "s"), pairs.filter("i > 1").select("i", "t"), "i")


class Worse(translate.Translator):
    """Loses the negation on its first use; what it gives stays the same from then on."""

    name = "worse"

    def translate(self, df, source, into, src_lang, tgt_lang):
        return df.withColumn(into, F.regexp_replace(source, "^(Kein|No) ", ""))


def test_round_trip(spark):
    df = spark.createDataFrame([("s1", "d", "Kein Erguss links.", "No effusion on the left.", "de", "en")], "id string, domain string, src_text string, ref_text string, src_lang string, tgt_lang string")
    out = {r["step"]: r for r in translate.round_trip(df, Worse(), cycles=2).collect()}
    assert [out[i]["direction"] for i in range(1, 5)] == ["de->en", "en->de"] * 2 and [out[i]["cycle"] for i in range(1, 5)] == [1, 1, 2, 2]
    assert out[2]["input_text"] == out[1]["hyp_text"] and out[1]["input_text"] == "Kein Erguss links."
    assert "negation_dropped" in [f["code"] for f in out[2]["findings"]] and "negation_dropped" not in [f["code"] for f in out[2]["hop_findings"]]
    assert out[2]["has_critical_error"] and set(out[2]["metrics"]) == {"bleu", "chrf", "ter"}
    steps = aggregate.step_summary(translate.round_trip(df, Worse(), cycles=1)).orderBy("step").collect()
    assert steps[1]["finding_counts"]["negation_dropped"] == 1 and steps[0]["mean_output_chars"] == 13
    for bad in (lambda: translate.round_trip(df, Worse(), cycles=0), lambda: translate.round_trip(df.limit(0), Worse())):
        with pytest.raises(ValueError):
            bad()


def test_batched_translator_and_chunks(spark):
    df = spark.createDataFrame([(f"s{i}", "d", "Eins. Zwei. Drei.", None, "de", "en") for i in range(5)], "id string, domain string, src_text string, ref_text string, src_lang string, tgt_lang string")
    upper = translate.Batched("upper", lambda: lambda texts, a, b: [t.upper() for t in texts], 2)
    out = translate.predict(df, upper, "de", "en", chunk_max_tokens=3).collect()
    assert {r["hyp_text"] for r in out} == {"EINS. ZWEI. DREI."} and out[0]["generation"]["chunk_max_tokens"] == "3"
    scored = translate.score(translate.predict(df, translate.create("identity"), "de", "en")).first()
    assert scored["metrics"] == {} and scored["model"] == "identity"
    short = translate.Batched("short", lambda: lambda texts, a, b: texts[1:])
    with pytest.raises(Exception, match="returned"):
        translate.predict(df, short, "de", "en").collect()
    with pytest.raises(ValueError, match="unknown translator"):
        translate.create("none")


def test_stream_equals_batch(spark, tmp_path):
    lines = [{"id": str(i), "model": "m", "src_text": "Kein Erguss", "hyp_text": "No effusion" if i % 2 else "Effusion", "src_lang": "de", "tgt_lang": "en", "scored_at": f"2024-01-0{1 + i // 4}T00:00:00Z"} for i in range(8)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    schema = "id string, model string, src_text string, hyp_text string, src_lang string, tgt_lang string, scored_at timestamp"
    stream = scorer.windowed_rates(scorer.score_stream(scorer.read_predictions(spark, str(tmp_path / "in"), schema)))
    query = stream.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {(str(r.window.start)[:10], r.n_segments, r.critical_error_rate) for r in spark.table("rates").collect()}
    assert got == {("2024-01-01", 4, 0.5), ("2024-01-02", 4, 0.5)}


def test_compare_needs_equal_runs(spark):
    df = rows(spark).filter("id < 'd'").withColumn("has_critical_error", F.lit(True))
    assert stats.paired(df, df).count() == 3
    with pytest.raises(ValueError, match="do not match"):
        stats.paired(df, df.filter("id > 'a'"))
    assert metrics.SIGNATURES["bleu"].startswith("weftline")


def test_summary_curve_and_report_files(spark, tmp_path):
    df = spark.createDataFrame([("s1", "d", "Kein Erguss.", "No effusion.", "de", "en")], "id string, domain string, src_text string, ref_text string, src_lang string, tgt_lang string")
    trip = translate.round_trip(df, Worse(), cycles=1)
    curve = {r["step"]: r for r in aggregate.step_curve(trip).collect()}
    assert (curve[1]["crit_rate"], curve[1]["hop_crit_rate"], curve[2]["hop_crit_rate"], curve[2]["neg"], curve[2]["n"]) == (1.0, 1.0, 0.0, 1, 1)
    text = writers.write_curve(aggregate.step_curve(trip), str(tmp_path), figures=True)
    assert "| worse | 1.00 | 1.00 |" in text and (tmp_path / "ROUNDTRIP_RESULTS.md").exists() and (tmp_path / "figure_clinical.csv").exists()
    assert spark.read.option("header", True).csv(str(tmp_path / "roundtrip_steps.csv")).columns == aggregate.CURVE_COLUMNS
    scored = translate.score(translate.predict(df, translate.create("identity"), "de", "en"))
    out = writers.write_summary(aggregate.run_summary(scored), str(tmp_path / "s.json"))
    assert out["model"] == "identity" and out["n_segments"] == 1 and out["has_references"] and out["surface"]["signatures"]["bleu"] == metrics.SIGNATURES["bleu"]
    assert math.isclose(out["surface"]["ter"], metrics.corpus_metric(scored, "ter")) and out["clinical"]["critical_error_segments"] == 1
    paths = writers.write_report(aggregate.leaderboard(aggregate.with_stats(scored)), str(tmp_path / "report"))
    assert json.loads(open(paths["master_json"]).read())["table"][0]["model"] == "identity"
    for bad in (lambda: metrics.corpus_metric(scored, "x"), lambda: metrics.corpus_metric(scored.limit(0), "bleu"), lambda: metrics.corpus_metric(scored.withColumn("ref_text", F.lit(None).cast("string")), "ter")):
        with pytest.raises(ValueError):
            bad()


def test_adapters_and_learned_metrics(spark):
    with pytest.raises(RuntimeError, match="weights"):
        translate.create("nllb")
    translate.register("shout", lambda: lambda texts, a, b: [t.upper() for t in texts])
    df = spark.createDataFrame([("a", "b", "c"), ("d", "e", "f")], "src_text string, hyp_text string, ref_text string")
    assert [r["hyp_text"] for r in translate.create("shout").translate(df.drop("hyp_text"), "src_text", "hyp_text", "de", "en").orderBy("src_text").collect()] == ["A", "D"]
    sizes = lambda: lambda records: [float(len(r)) for r in records]
    assert [r["comet"] for r in translate.Neural("x", sizes).score(df).collect()] == [3.0, 3.0]
    assert [r["comet"] for r in translate.Neural("x", sizes, reference_free=True).score(df.drop("ref_text")).collect()] == [2.0, 2.0]
    with pytest.raises(ValueError, match="references"):
        translate.Neural("x", sizes).score(df.withColumn("ref_text", F.lit(None).cast("string")))
    with pytest.raises(RuntimeError, match="weights"):
        translate.Neural("x").score(df)
    assert translate.retry_delay("7", 3, 0.5) == 7 and translate.retry_delay("900", 0, 0.5) == 60 and translate.retry_delay("soon", 2, 0.5) == 4 and translate.retry_delay(None, 9, 0.0) == 30


def test_prompts_and_references_of_characters(spark):
    df = spark.createDataFrame([("Fisch &amp; Chips &#8364;5 &uuml;ber &lt;b&gt;", "tr")], "t string, l string")
    row = df.select(text.unescape("t").alias("u"), text.target_prompt("t", "l").alias("p"), text.api_prompt("t", F.lit("de"), "l").alias("a")).first()
    assert row["u"] == "Fisch & Chips €5 über <b>" and "into Turkish." in row["p"] and "from German to Turkish." in row["a"] and row["p"].endswith("&gt;")


def test_resamples_follow_the_poisson_distribution(spark):
    df = spark.range(200).selectExpr("cast(id as string) AS id")
    drawn = stats.resampled(df, "id", 400, 13).groupBy("resample").agg(F.sum("weight").alias("w"), F.max("weight").alias("m"))
    got = drawn.agg(F.count("*").alias("n"), F.avg("w").alias("mean"), F.var_samp("w").alias("spread"), F.max("m").alias("m")).first()
    assert got["n"] == 400 and abs(got["mean"] - 200) < 3 and 140 < got["spread"] < 270 and 4 <= got["m"] <= 12
