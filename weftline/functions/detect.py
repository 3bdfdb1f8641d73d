"""Fact-loss detectors as column expressions: negation, laterality, numbers with units, terminology.

Each builder takes source and hypothesis columns with their language codes and gives an array of finding structs;
``findings`` joins the four, ``with_findings`` adds them to a table and reads each text once. Null texts count as
empty. Nothing leaves the JVM, so Catalyst sees through all of it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schema import DETECTOR_LANGUAGES, FINDING

#: What counts as part of a word; Java's own classes leave superscripts out.
_W = r"[\p{L}\p{N}_]"

# Cues of negation.
NEGATION = {
    "en": r"no|not|without|neither|nor|denies|denied|absence\s+of|negative\s+for",
    "de": r"kein(?:e[mnr]?|en|er|es)?|ohne|nicht|weder|negativ\s+für|ausschluss",
}
# Words for sides.
SIDES = {
    "en": {"left": r"left(?:-sided)?", "right": r"right(?:-sided)?", "bilateral": r"bilateral(?:ly)?|both\s+sides?"},
    "de": {
        "left": r"links(?:seitig(?:e[nrms]?)?)?|linke[nrms]?",
        "right": r"rechts(?:seitig(?:e[nrms]?)?)?|rechte[nrms]?",
        "bilateral": r"beidseits|beidseitig(?:e[nrms]?)?",
    },
}
# Units in the order in which they are tried, and (dimension, factor) of those that convert.
UNITS = "mm|cm|m|µm|um|mg|g|kg|µg|ug|ml|mL|l|L|cc|cm3|cm³|mmhg|mmol/l|mg/dl|HU|bpm|/min"
FACTORS = {
    "µm": ("length_mm", "0.001"),
    "um": ("length_mm", "0.001"),
    "mm": ("length_mm", "1"),
    "cm": ("length_mm", "10"),
    "m": ("length_mm", "1000"),
    "µg": ("mass_mg", "0.001"),
    "ug": ("mass_mg", "0.001"),
    "mg": ("mass_mg", "1"),
    "g": ("mass_mg", "1000"),
    "kg": ("mass_mg", "1000000"),
    "ml": ("volume_ml", "1"),
    "l": ("volume_ml", "1000"),
    "cc": ("volume_ml", "1"),
    "cm3": ("volume_ml", "1"),
    "%": ("percent", "1"),
    "mmhg": ("pressure_mmhg", "1"),
    "mmol/l": ("mmol_l", "1"),
    "mg/dl": ("mg_dl", "1"),
    "hu": ("hu", "1"),
    "bpm": ("bpm", "1"),
    "/min": ("per_min", "1"),
}
# Fixed value: endings that a term's last word may take.
TERM_ENDING = r"(?:e?[nsr]|es|en|s)?"

_VALUE = r"[+-]?\d+(?:[.,]\d+)?"
_MEASURE = rf"(?iuU)(?<![\p{{L}}\p{{N}}_.]){_VALUE}\s*(?:(%)|{UNITS})(?!{_W})"
_BARE = rf"(?U)(?<![\p{{L}}\p{{N}}_.,]){_VALUE}(?![\p{{L}}\p{{N}}_.,])"


def _worded(pattern: str) -> str:
    return rf"(?iuU)(?<!{_W})(?:{pattern})(?!{_W})"


def _text(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _per_language(lang: Column, patterns: dict[str, str], use) -> Column:
    out = None
    for code, pattern in patterns.items():
        out = F.when(lang == code, use(pattern)) if out is None else out.when(lang == code, use(pattern))
    return out


def cues(text: Column | str, lang: Column) -> Column:
    """The negation cues of a text in order; null for a language without a list."""
    return _per_language(lang, NEGATION, lambda p: F.regexp_extract_all(_text(text), F.lit(_worded(p)), F.lit(0)))


def sides(text: Column | str, lang: Column) -> Column:
    """The sides that a text names, sorted; both for a bilateral word; null for a language without a list."""

    def of(patterns: dict[str, str]) -> Column:
        has = {side: F.regexp_like(_text(text), F.lit(_worded(p))) for side, p in patterns.items()}
        both = has["bilateral"]
        return F.array_compact(F.array(F.when(has["left"] | both, "left"), F.when(has["right"] | both, "right")))

    out = None
    for code, patterns in SIDES.items():
        out = F.when(lang == code, of(patterns)) if out is None else out.when(lang == code, of(patterns))
    return out


def numbers(text: Column | str) -> Column:
    """All measurements, then all bare numbers outside them, as they stand in the text."""
    t = _text(text)
    rest = F.regexp_replace(t, _MEASURE, "_$1")
    return F.concat(F.regexp_extract_all(t, F.lit(_MEASURE), F.lit(0)), F.regexp_extract_all(rest, F.lit(_BARE), F.lit(0)))


def number_key(raw: Column) -> Column:
    """Dimension and canonical value of a number as 'dimension|value', equal for equal quantities.

    Values beyond 24 digits before or 6 after the mark keep their digits as they are.
    """
    value = F.replace(F.regexp_extract(raw, rf"^({_VALUE})", 1), F.lit(","), F.lit("."))
    unit = F.replace(F.lower(F.regexp_extract(raw, rf"^{_VALUE}\s*(.*)$", 1)), F.lit("³"), F.lit("3"))
    table = F.create_map(*[x for u, (d, f) in FACTORS.items() for x in (F.lit(u), F.struct(F.lit(d).alias("d"), F.lit(f).cast("decimal(10,3)").alias("f")))])
    known = F.try_element_at(table, unit)
    dimension = F.when(unit == "", "unitless").otherwise(F.coalesce(known["d"], F.concat(F.lit("unit:"), unit)))
    factor = F.coalesce(known["f"], F.lit("1").cast("decimal(10,3)"))
    exact = (value.try_cast("decimal(24,6)") * factor).cast("string")
    tidy = F.regexp_replace(F.regexp_replace(exact, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    tidy = F.when(tidy == "-0", "0").otherwise(tidy)
    return F.concat(dimension, F.lit("|"), F.coalesce(tidy, value))


def number_keys(text: Column | str) -> Column:
    """Keys of all numbers of a text, sorted, with repeats."""
    return F.array_sort(F.transform(numbers(text), number_key))


def bag_except(a: Column, b: Column) -> Column:
    """Multiset difference of two arrays: each element as often as it is more frequent in ``a``."""

    def tagged(array: Column) -> Column:
        return F.transform(array, lambda x, i: F.struct(x.alias("k"), F.size(F.filter(F.slice(array, F.lit(1), i + 1), lambda y: y == x)).alias("n")))

    return F.transform(F.array_except(tagged(a), tagged(b)), lambda t: t["k"])


def _finding(code: Column | str, severity: str, detector: str, message: Column | str, source: Column, target: Column, details: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    parts = (lit(code), F.lit(severity), F.lit(detector), lit(message), F.nullif(source, F.lit("")), F.nullif(target, F.lit("")), F.lit("heuristic"), details)
    return F.struct(*(p.cast("string").alias(f.name) for p, f in zip(parts, FINDING.fields, strict=True)))


def _none() -> Column:
    return F.array().cast(f"array<{FINDING.simpleString()}>")


def negation(src: Column | str, hyp: Column | str, src_lang: Column, tgt_lang: Column) -> Column:
    """A finding if only one of the two texts holds a cue; the number of cues does not matter."""
    return _negation(cues(src, src_lang), cues(hyp, tgt_lang))


def _negation(s: Column, t: Column) -> Column:
    way = F.when(F.size(s) > 0, "dropped").otherwise("introduced")
    message = F.concat(F.lit("Negation appears "), way, F.lit(" between source and translation."))
    details = F.to_json(F.struct(F.size(s).alias("source_cue_count"), F.size(t).alias("target_cue_count")))
    found = _finding(F.concat(F.lit("negation_"), way), "critical", "segment_negation_cues", message, F.array_join(s, ", "), F.array_join(t, ", "), details)
    return F.when((F.size(s) > 0) != (F.size(t) > 0), F.array(found)).otherwise(_none())


def laterality(src: Column | str, hyp: Column | str, src_lang: Column, tgt_lang: Column) -> Column:
    """One finding for sides that are missing and one for sides that were added; a flip gives both."""
    return _laterality(sides(src, src_lang), sides(hyp, tgt_lang))


def _laterality(s: Column, t: Column) -> Column:
    missing, added = F.array_except(s, t), F.array_except(t, s)
    details = F.to_json(F.struct(s.alias("expected"), t.alias("observed")))

    def listed(a: Column) -> Column:
        return F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']"))

    first = _finding("laterality_missing_or_flipped", "critical", "laterality_lexicon", F.concat(F.lit("Expected laterality "), listed(missing), F.lit(" is absent from translation.")), F.array_join(s, ", "), F.array_join(t, ", "), details)
    second = _finding("laterality_added_or_flipped", "critical", "laterality_lexicon", F.concat(F.lit("Unexpected laterality "), listed(added), F.lit(" appears in translation.")), F.array_join(s, ", "), F.array_join(t, ", "), details)
    return F.coalesce(F.array_compact(F.array(F.when(F.size(missing) > 0, first), F.when(F.size(added) > 0, second))), _none())


def number_mismatch(src: Column | str, hyp: Column | str) -> Column:
    """A finding if the bags of quantities differ."""
    return _number_mismatch(numbers(src), numbers(hyp), number_keys(src), number_keys(hyp))


def _number_mismatch(raw_s: Column, raw_t: Column, s: Column, t: Column) -> Column:
    split = lambda a: F.transform(a, lambda k: F.split(k, r"\|"))
    details = F.to_json(F.struct(split(bag_except(s, t)).alias("missing_normalised"), split(bag_except(t, s)).alias("added_normalised")))
    message = "Numbers or normalised measurements do not match between source and translation."
    found = _finding("number_or_measurement_mismatch", "critical", "number_unit_parser", message, F.array_join(raw_s, "; "), F.array_join(raw_t, "; "), details)
    return F.when(s != t, F.array(found)).otherwise(_none())


def term_pattern(term: str) -> str | None:
    """Pattern of a term whose last word may be inflected; None for an empty term."""
    words = term.split()
    if not words:
        return None
    quoted = [rf"\Q{w}\E" for w in words]
    return rf"(?iuU)(?<!{_W})" + r"\s+".join(quoted) + TERM_ENDING + rf"(?!{_W})"


def terminology(src: Column | str, hyp: Column | str, src_lang: Column, tgt_lang: Column, bank: list[tuple[str, str, str]], lower: Column | None = None) -> Column:
    """A major finding for each bank entry (concept, en, de) found in the source and not in the hypothesis.

    The bank is one literal array, so the plan is as small for thousands of terms as for one. A plain search for the
    term's first word goes before each pattern, so few patterns are tried on a text.
    """
    entries = []
    for concept, en, de in bank:
        forms = {"en": en, "de": de}
        if not en or not de or not all(term_pattern(x) for x in forms.values()):
            continue
        for a, b in (("en", "de"), ("de", "en")):
            entries.append({"c": concept, "a": a, "b": b, "s": forms[a], "t": forms[b], "w": forms[a].split()[0].lower(), "p": term_pattern(forms[a]), "q": term_pattern(forms[b])})
    if not entries:
        return _none()
    terms = F.from_json(F.lit(json.dumps(entries)), "array<struct<c:string,a:string,b:string,s:string,t:string,w:string,p:string,q:string>>")
    lower = F.lower(_text(src)) if lower is None else lower

    def lost(t: Column) -> Column:
        return (src_lang == t["a"]) & (tgt_lang == t["b"]) & F.contains(lower, t["w"]) & F.regexp_like(_text(src), t["p"]) & ~F.regexp_like(_text(hyp), t["q"])

    def finding(t: Column) -> Column:
        details = F.to_json(F.struct(t["c"].alias("concept_id"), t["t"].alias("expected_target_term")))
        # Fixed value: the wording of the finding.
        message = F.concat(F.lit("Term-bank concept "), t["c"], F.lit(" was not found as its expected target term."))
        return _finding("terminology_not_preserved", "major", "term_bank_exact_match", message, t["s"], t["t"], details)

    return F.transform(F.filter(terms, lost), finding)


def findings(src: Column | str, hyp: Column | str, src_lang: Column, tgt_lang: Column, bank: list[tuple[str, str, str]] | None = None) -> Column:
    """All findings in the order negation, laterality, numbers, terminology."""
    return F.concat(negation(src, hyp, src_lang, tgt_lang), laterality(src, hyp, src_lang, tgt_lang), number_mismatch(src, hyp), terminology(src, hyp, src_lang, tgt_lang, bank or []))


DETECTORS = ("negation", "laterality", "numbers", "terminology")


def with_findings(
    df: DataFrame,
    src: str = "src_text",
    hyp: str = "hyp_text",
    src_lang: Column | str = "src_lang",
    tgt_lang: Column | str = "tgt_lang",
    bank: list[tuple[str, str, str]] | None = None,
    into: str = "findings",
    detectors: tuple[str, ...] = DETECTORS,
) -> DataFrame:
    """``df`` with the findings of the named detectors as ``into``.

    What is read from a text is a column of its own first: an expression that several others use would else be
    worked out for each of them.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (src_lang, tgt_lang))
    staged, names = df, []
    for side, text, lang in (("s", src, a), ("t", hyp, b)):
        read = {"negation": ("cues", cues(text, lang)), "laterality": ("sides", sides(text, lang)), "numbers": ("raw", numbers(text))}
        for detector, (name, column) in read.items():
            if detector in detectors:
                staged = staged.withColumn(f"_{name}_{side}", column)
                names.append(f"_{name}_{side}")
    if "numbers" in detectors:
        # equal notations are equal quantities, so only other rows need their keys
        differ = F.array_sort("_raw_s") != F.array_sort("_raw_t")
        staged = staged.withColumns({f"_keys_{side}": F.when(differ, F.array_sort(F.transform(f"_raw_{side}", number_key))) for side in "st"})
        names += ["_keys_s", "_keys_t"]
    if "terminology" in detectors:
        staged, names = staged.withColumn("_lower", F.lower(_text(src))), [*names, "_lower"]
    pair = lambda n: (F.col(f"_{n}_s"), F.col(f"_{n}_t"))
    made = {
        "negation": lambda: _negation(*pair("cues")),
        "laterality": lambda: _laterality(*pair("sides")),
        "numbers": lambda: _number_mismatch(*pair("raw"), *pair("keys")),
        "terminology": lambda: terminology(src, hyp, a, b, bank or [], F.col("_lower")),
    }
    found = F.concat(*(made[d]() for d in DETECTORS if d in detectors))
    return staged.withColumn(into, found).drop(*names)


def has_critical(found: Column | str) -> Column:
    """Whether any finding is critical."""
    return F.coalesce(F.exists(found, lambda f: f["severity"] == "critical"), F.lit(False))


def coverage(src_lang: Column, tgt_lang: Column) -> Column:
    """Which detectors can run for a pair of languages."""
    both = src_lang.isin(*DETECTOR_LANGUAGES) & tgt_lang.isin(*DETECTOR_LANGUAGES)
    return F.struct(both.alias("negation"), both.alias("laterality"), F.lit(True).alias("number_or_measurement"), both.alias("terminology"))
