"""Registered queries over small tables written for the test."""

import math

import pytest

from weftline.functions import metrics as m
from weftline.plans import queries

SEGMENT = "id string, source string, domain string, src_lang string, tgt_lang string, src_text string, ref_text string"
EVALUATION = "eval_id string, id string, model string, domain string, source string, src_lang string, tgt_lang string, hyp_text string, findings array<struct<code:string,severity:string>>, metrics map<string,double>, has_critical_error boolean"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    report = "Kein Erguss links.\nHerz normal gross.", "No effusion on the left.\nHeart of normal size."
    segments = [(f"d{i}", source, "radiology", "de", "en", *report) for i, source in enumerate(("emea", "parrot", "legacy"))]
    segments += [("e0", "himl", "other", "en", "de", "No effusion.", "Kein Erguss."), ("t0", "parrot", "radiology", "tr", "en", "Efüzyon yok.", "No effusion."), ("x", "parrot", None, "de", "en", "Ohne Referenz.", None)]
    texts = {"aster-600m": "On the left no effusion.\nHeart of normal size.", "kelp-api": "No effusion on the right.\nHeart of size."}
    evaluations = [(f"{model}-d{i}", f"d{i}", model, "radiology", "parrot", "de", "en", text, [], {"chrf": 50.0 + i}, i == 0) for model, text in texts.items() for i in range(3)]
    spark.createDataFrame(segments, SEGMENT).write.parquet(f"{d}/segments.parquet")
    spark.createDataFrame(evaluations, EVALUATION).write.parquet(f"{d}/evaluations.parquet")
    return d


def test_leaderboard_surface_has_ter(spark, folder):
    got = {r["model"]: r for r in queries.leaderboard_surface(spark, folder).collect()}
    edits, words = m.ter_counts("On the left no effusion.\nHeart of normal size.", "No effusion on the left.\nHeart of normal size.")
    assert math.isclose(got["aster-600m"]["ter"], 100 * edits / words) and got["kelp-api"]["ter"] > 0


def test_round_trip_takes_all_segments_for_ten_cycles(spark, folder):
    rows = queries.roundtrip_step_summary(spark, folder).collect()
    got = {(r["step"], r["direction"]): r["n_segments"] for r in rows}
    assert len(rows) == len(got) == 60 and {r["cycle"] for r in rows} == set(range(1, 11))
    assert [got[1, x] for x in ("de->en", "en->de", "tr->en")] == [3, 1, 1] and [got[20, x] for x in ("en->de", "de->en", "en->tr")] == [3, 1, 1]
    assert all(r["bleu"] > 99.99 and r["ter"] == 0 for r in rows if r["step"] % 2 == 0)


def test_paired_bootstrap_bleu_takes_all_resamples(spark, folder):
    row = queries.paired_bootstrap_bleu(spark, folder).first()
    assert row["resamples"] == 2000 and row["ci_low"] <= row["observed_difference"] <= row["ci_high"]
