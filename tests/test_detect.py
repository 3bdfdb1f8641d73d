import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftline.functions import detect

BANK = [("c1", "pleural effusion", "Pleuraerguss"), ("c2", "lymph node", "Lymphknoten"), ("c3", "", "leer")]
CASES = [
    ("There is no stone of 8 mm in the left ureter.", "Im rechten Harnleiter liegt ein Stein von 9 mm.", "en", "de", ["negation_dropped", "laterality_missing_or_flipped", "laterality_added_or_flipped", "number_or_measurement_mismatch"]),
    ("The cyst has 2.4 cm.", "Die Zyste hat 24 mm.", "en", "de", []),
    ("Without pleural effusion.", "Ohne Flüssigkeit im Spalt.", "en", "de", ["terminology_not_preserved"]),
    ("Three lymph nodes in the neck.", "Drei Lymphknotens am Hals.", "en", "de", []),
    ("The lymphatic lymph nodules drain.", "Die Bahnen leiten ab.", "en", "de", []),
    ("Sol böbrekte taş yok.", "No stone in the left kidney.", "tr", "en", []),
    ("7 mm ve 2 cm", "7 mm and 3 cm", "tr", "en", ["number_or_measurement_mismatch"]),
    ("Beidseits Zysten.", "Cysts on the right and left side.", "de", "en", []),
    ("Fraktur.", "Without fracture.", "de", "en", ["negation_introduced"]),
    (None, None, "de", "en", []),
    ("", "31", "de", "en", ["number_or_measurement_mismatch"]),
]


@pytest.mark.parametrize("staged", [True, False])
def test_codes(spark, staged):
    rows = [(i, *c[:4]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, src_text string, hyp_text string, src_lang string, tgt_lang string").withColumn("findings_", F.lit(1))
    if staged:
        df = detect.with_findings(df, bank=BANK, into="f")
    else:
        df = df.withColumn("f", detect.findings("src_text", "hyp_text", F.col("src_lang"), F.col("tgt_lang"), BANK))
    got = {r["i"]: [f["code"] for f in r["f"]] for r in df.collect()}
    assert got == {i: c[4] for i, c in enumerate(CASES)}
    assert detect.with_findings(df.limit(0), into="g").count() == 0


def test_finding_carries_its_evidence(spark):
    df = spark.createDataFrame([CASES[0][:4]], "src_text string, hyp_text string, src_lang string, tgt_lang string")
    found = {f["code"]: f for f in detect.with_findings(df).first()["findings"]}
    number = found["number_or_measurement_mismatch"]
    assert (number["source_evidence"], number["target_evidence"], number["severity"], number["confidence"]) == ("8 mm", "9 mm", "critical", "heuristic")
    assert number["details"] == '{"missing_normalised":[["length_mm","8"]],"added_normalised":[["length_mm","9"]]}'
    assert found["laterality_missing_or_flipped"]["message"] == "Expected laterality ['left'] is absent from translation."
    assert found["negation_dropped"]["target_evidence"] is None


def scanned_numbers(text):
    """Measurements, then bare numbers, found by walking over the text character by character."""

    def word(c):
        return c.isalnum() or c == "_"

    def value(at):
        """End of a number with at most one mark that begins at ``at``, long and short form; none if there is none."""
        i = at + (text[at : at + 1] in ("+", "-"))
        j = i
        while text[j : j + 1].isdecimal():
            j += 1
        if j == i:
            return []
        k = j + 1
        while text[j : j + 1] in (".", ",") and text[k : k + 1].isdecimal():
            k += 1
        ends = [k] if j + 1 < k else []
        return [*ends, *range(j, i, -1)]

    taken, measures, at = [], [], 0
    while at < len(text):
        before, hit = text[at - 1 : at] if at else "", None
        if not (before and (word(before) or before == ".")):
            for end in value(at):
                for blank in blanks(text, end):
                    for unit in UNITS:
                        stop = blank + len(unit)
                        if hit is None and text[blank:stop].lower() == unit.lower() and not (stop < len(text) and word(text[stop])):
                            hit = stop
        if hit:
            taken.append((at, hit))
            measures.append(text[at:hit])
        at = hit or at + 1
    bare, at = [], 0
    while at < len(text):
        inside = [b for a, b in taken if a <= at < b]
        if inside:
            at = inside[0]
            continue
        before = text[at - 1 : at] if at else ""
        # what was measured before counts as part of a word
        part = before and (word(before) or before in ".," or any(b == at for _, b in taken))
        ends = [] if part else [e for e in value(at) if not (e < len(text) and (word(text[e]) or text[e] in ".,")) and not any(a < e for a, b in taken if a > at) and not any(a == e for a, _ in taken)]
        if ends:
            bare.append(text[at : ends[0]])
        at = ends[0] if ends else at + 1
    return measures + bare


def blanks(text, end):
    """Places after none or more blanks, the farthest first."""
    stop = end
    while text[stop : stop + 1].isspace():
        stop += 1
    return range(stop, end - 1, -1)


UNITS = "% mm cm m µm um mg g kg µg ug ml l cc cm3 cm³ mmhg mmol/l mg/dl hu bpm /min".split()


def test_numbers_equal_a_span_search(spark):
    rng = random.Random(7)
    parts = ["5", "12,5", "1.5", " ", " ", "mm", "cm³", "cm", "%", "-", "+", "mg/dl", "/min", "x", ".", ",", "a", "µg", "m²", " ", "HU", "_", "60", "3.", "l", "ml"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 9))) for _ in range(3000)] + ["5 mg/dl", "1,234,567 mg", "5-10 mm", "60/min", "5 m²", "x5 mm", "Level 12."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", detect.numbers("t").alias("n")).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != scanned_numbers(t)] == []


def test_keys_and_bags(spark):
    cases = {"1.50 cm": "length_mm|15", "0,5 g": "mass_mg|500", "7": "unitless|7", "10 %": "percent|10", "2 cm³": "volume_ml|2", "3 µm": "length_mm|0.003", "-0": "unitless|0"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", detect.number_key(F.col("t")).alias("k")).collect()} == cases
    rng = random.Random(1)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 6))], [rng.choice("abc") for _ in range(rng.randint(0, 6))]) for _ in range(300)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", detect.bag_except(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(Counter(r["d"]) == Counter(r["a"]) - Counter(r["b"]) for r in got)
    assert Decimal("1.5") * 10 == 15
