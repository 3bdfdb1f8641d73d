"""Record schemas, language codes, aliases of input columns, and validation as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of languages and their codes.
LANGUAGE_ALIASES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "tr": ["tr", "tur", "turkish", "türkçe", "turkce"],
}
LANGUAGE_NAMES = {"en": "English", "de": "German", "tr": "Turkish"}
#: Languages with word lists for negation and laterality.
DETECTOR_LANGUAGES = ("en", "de")

# Input names of each column, the first that is neither null nor empty holds.
COLUMN_ALIASES = {
    "id": ["id", "segment_id", "uid"],
    "src_text": ["src_text", "source_text", "source", "src"],
    "src_lang": ["src_lang", "source_lang", "language", "lang"],
    "tgt_lang": ["tgt_lang", "target_lang"],
    "ref_text": ["ref_text", "reference_text", "reference", "target_text", "target", "ref"],
    "doc_id": ["doc_id", "document_id"],
    "domain": ["domain"],
}
HYPOTHESIS_ALIASES = ["hyp_text", "hypothesis", "translation", "mt", "prediction"]
#: Further names that are not metadata.
RESERVED = ["model", "metrics", "findings", "has_critical_error", "generation", "metadata", "position"]

FINDING = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("code", "severity", "detector", "message", "source_evidence", "target_evidence", "confidence", "details")
    ]
)

SEGMENT_COLUMNS = ["id", "domain", "src_lang", "tgt_lang", "src_text", "ref_text", "doc_id"]


def strip(column: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def collapse(column: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))


def language(column: Column | str) -> Column:
    """Code of a language in any known spelling; null for an unknown one."""
    pairs = [F.lit(x) for code, names in LANGUAGE_ALIASES.items() for name in names for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(column)))


def language_name(column: Column | str) -> Column:
    """English name of a language in any known spelling."""
    pairs = [F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), language(column))


def domain(column: Column | str) -> Column:
    """Domain in lower case; 'unspecified' for null or empty."""
    return F.coalesce(F.nullif(F.lower(strip(column)), F.lit("")), F.lit("unspecified"))


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first of the present columns that is neither null nor empty."""
    present = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def to_segments(df: DataFrame, src_lang: str | None = None, tgt_lang: str | None = None, reverse: bool = False, position: Column | None = None) -> DataFrame:
    """Canonical segment columns and ``metadata`` (all other columns as a map of strings) from any aliased input.

    A missing id becomes segment-NNNNNN by ``position`` (1-based; the order of reading where none is given). Rows are
    not validated here, see ``violations``. Null and empty values count as missing; an empty table stays empty.
    """
    own = position if position is not None else F.monotonically_increasing_id() + 1
    source = F.coalesce(language(F.coalesce(first_filled(df, COLUMN_ALIASES["src_lang"]), F.lit(src_lang))), first_filled(df, COLUMN_ALIASES["src_lang"]))
    target = F.coalesce(language(F.coalesce(first_filled(df, COLUMN_ALIASES["tgt_lang"]), F.lit(tgt_lang))), first_filled(df, COLUMN_ALIASES["tgt_lang"]))
    known = {n for names in COLUMN_ALIASES.values() for n in names} | set(HYPOTHESIS_ALIASES) | set(RESERVED)
    rest = [n for n in df.columns if n not in known]
    extra = F.map_filter(F.create_map(*[x for n in rest for x in (F.lit(n), F.col(f"`{n}`").cast("string"))]), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    out = df.select(
        F.coalesce(first_filled(df, COLUMN_ALIASES["id"]), F.format_string("segment-%06d", own)).alias("id"),
        F.coalesce(first_filled(df, ["domain"]), F.lit("unspecified")).alias("domain"),
        source.alias("src_lang"),
        target.alias("tgt_lang"),
        first_filled(df, COLUMN_ALIASES["src_text"]).alias("src_text"),
        first_filled(df, COLUMN_ALIASES["ref_text"]).alias("ref_text"),
        first_filled(df, COLUMN_ALIASES["doc_id"]).alias("doc_id"),
        extra.alias("metadata"),
    )
    return reversed_segments(out) if reverse else out


def reversed_segments(segments: DataFrame) -> DataFrame:
    """Languages and texts swapped; a row without reference keeps a null source text, which ``violations`` reports."""
    swap = {"src_lang": "tgt_lang", "tgt_lang": "src_lang", "src_text": "ref_text", "ref_text": "src_text"}
    return segments.select(*(F.col(swap.get(c, c)).alias(c) for c in segments.columns))


def violations(segments: DataFrame) -> DataFrame:
    """One row per broken rule: id, rule. Duplicate ids are found by a pre-aggregated count."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("src_text").isNull() | (F.col("src_text") == ""), "missing source text"),
            F.when(F.col("src_lang").isNull(), "missing source language"),
            F.when(F.col("tgt_lang").isNull(), "missing target language"),
            F.when(~F.col("src_lang").isin(*LANGUAGE_ALIASES), "unsupported source language"),
            F.when(~F.col("tgt_lang").isin(*LANGUAGE_ALIASES), "unsupported target language"),
            F.when(F.col("src_lang") == F.col("tgt_lang"), "equal languages"),
        )
    )
    single = segments.select("id", F.explode(rules).alias("rule"))
    twice = segments.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate id").alias("rule"))
    return single.unionByName(twice)


def validate(segments: DataFrame) -> DataFrame:
    """``segments``, or an error that names the first broken rules or an empty table."""
    broken = violations(segments).limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['id']}: {r['rule']}" for r in broken))
    if segments.isEmpty():
        raise ValueError("no segments")
    return segments
