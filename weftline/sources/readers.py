"""Readers: JSON lines, CSV/TSV, Parquet, TMX, SGML in tar archives, report records, term banks, run folders."""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import area, unescape
from weftline.operators import corpus
from weftline.schema import collapse, strip, to_segments, validate

# Subsets of the two test-set archives, as file name part and domain.
SGML_SUBSETS = {
    2015: {"cochrane.all": "himl2015-cochrane", "nhs24.all": "himl2015-nhs24", "himl.testing": "himl2015-himl"},
    2017: {"cochrane_output": "himl2017-cochrane", "nhs_output": "himl2017-nhs"},
}
# Names of report languages.
REPORT_LANGUAGES = {"de": ["german", "deutsch", "de"], "tr": ["turkish", "türkçe", "turkce", "tr"]}

_TMX = "tuv array<struct<`_xml:lang`:string,seg:string>>"


def read_rows(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of files by their suffix: .jsonl/.ndjson/.json, .csv, .tsv, .parquet; several files by name of columns.

    A broken JSON line or one that is no object fails the read; blank lines are skipped.
    """
    names = [paths] if isinstance(paths, str) else list(paths)
    suffixes = {os.path.splitext(n.rstrip("/"))[1].lower() for n in names}
    if len(suffixes) > 1:
        out = read_rows(spark, names[0], schema)
        for n in names[1:]:
            out = out.unionByName(read_rows(spark, n, schema), allowMissingColumns=True)
        return out
    suffix = suffixes.pop()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix in (".jsonl", ".ndjson", ".json"):
        return reader.option("mode", "FAILFAST").json(names)
    if suffix in (".csv", ".tsv"):
        sep = "," if suffix == ".csv" else "\t"
        return reader.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(names)
    if suffix == ".parquet":
        return reader.option("mergeSchema", len(names) > 1).parquet(*names)
    raise ValueError(f"unsupported suffix {suffix!r}")


def read_segments(spark: SparkSession, paths: str | list[str], src_lang: str | None = None, tgt_lang: str | None = None, reverse: bool = False) -> DataFrame:
    """Validated segments of a file with aliased columns."""
    return validate(to_segments(read_rows(spark, paths), src_lang, tgt_lang, reverse))


def tmx_pairs(spark: SparkSession, path: str, src_lang: str = "de", tgt_lang: str = "en") -> DataFrame:
    """Columns pos, src, tgt of the units that have both languages.

    The last filled variant of a language holds; text ends at the first markup inside; white space is collapsed.
    """
    units = spark.read.format("xml").option("rowTag", "tu").schema(_TMX).load(path).withColumn("pos", F.monotonically_increasing_id())

    def side(lang: str):
        texts = F.transform(F.filter("tuv", lambda t: t["_xml:lang"] == lang), lambda t: collapse(F.regexp_replace(t["seg"], r"(?s)<[A-Za-z/].*$", "")))
        return F.try_element_at(F.filter(texts, lambda x: x.isNotNull() & (x != "")), F.lit(-1))

    return units.select("pos", side(src_lang).alias("src"), side(tgt_lang).alias("tgt")).filter("src IS NOT NULL AND tgt IS NOT NULL")


def tmx_segments(spark: SparkSession, path: str, src_lang: str = "de", tgt_lang: str = "en", sample: int = 0, seed: int = 13, domain: str = "emea") -> DataFrame:
    """Cleaned, distinct, sampled and numbered segments of a translation memory."""
    pairs = corpus.first_of_pairs(corpus.clean_pairs(tmx_pairs(spark, path, src_lang, tgt_lang), "src", "tgt"), "src", "tgt", "pos")
    kept = corpus.hash_sample(pairs, "pos", sample, seed) if sample else pairs
    rows = corpus.numbered(kept, "pos", domain)
    return rows.select("id", F.lit(domain).alias("domain"), F.lit(src_lang).alias("src_lang"), F.lit(tgt_lang).alias("tgt_lang"), F.col("src").alias("src_text"), F.col("tgt").alias("ref_text"), F.col("id").alias("doc_id"))


def sgml_segments(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, seg_id, text of all <seg id="N"> in SGML texts; the last of equal ids holds."""
    pattern = F.lit(r'(?s)<seg\s+id="(\d+)">(.*?)</seg>')
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("i"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("t"))
    rows = texts.select(*keys, F.posexplode(found).alias("_pos", "_f"))
    rows = rows.select(*keys, "_pos", F.col("_f.i").alias("seg_id"), unescape(collapse("_f.t")).alias("text"))
    last = Window.partitionBy(*keys, "seg_id").orderBy(F.desc("_pos"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_pos")


def tar_texts(spark: SparkSession, path: str, endings: list[str]) -> DataFrame:
    """ending, text of the first member of a tar archive whose name ends so; a missing one is an error.

    Spark has no reader for tar archives, so each archive is unpacked in memory by one task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    members = archive.getmembers()
                    for ending in endings:
                        member = next((m for m in members if m.name.endswith(ending)), None)
                        if member is None:
                            raise FileNotFoundError(f"no member ends with {ending}")
                        rows.append((ending, archive.extractfile(member).read().decode("utf-8")))
                yield pd.DataFrame(rows, columns=["ending", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "ending string, text string")


def sgml_tar_segments(spark: SparkSession, path: str, year: int, src_lang: str = "en", tgt_lang: str = "de", subsets: list[str] | None = None) -> DataFrame:
    """Aligned segments of a test-set archive; a segment on one side only is an error."""
    known = SGML_SUBSETS[year]
    chosen = subsets or list(known)
    names = {f"{s}.{lang}.sgm": (s, lang) for s in chosen for lang in (src_lang, tgt_lang)}
    texts = tar_texts(spark, path, list(names))
    parsed = sgml_segments(texts, "text", ["ending"])
    pick = lambda k: F.element_at(F.create_map(*[x for n, v in names.items() for x in (F.lit(n), F.lit(v[k]))]), F.col("ending"))
    parsed = parsed.select(pick(0).alias("subset"), pick(1).alias("lang"), "seg_id", "text").withColumn("key", F.concat_ws("|", "subset", "seg_id"))
    sides = [parsed.filter(F.col("lang") == lang).select("key", F.col("text").alias(name)) for lang, name in ((src_lang, "src_text"), (tgt_lang, "ref_text"))]
    both = corpus.align_sides(*sides, "key")
    subset, number = F.split("key", r"\|")[0], F.split("key", r"\|")[1]
    domain = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), subset)
    return both.select(F.concat_ws("-", domain, number).alias("id"), domain.alias("domain"), F.lit(src_lang).alias("src_lang"), F.lit(tgt_lang).alias("tgt_lang"), "src_text", "ref_text", F.concat_ws("-", domain, number).alias("doc_id")).orderBy("domain", F.regexp_extract("id", r"(\d+)$", 1).cast("bigint"))


def report_records(records: DataFrame, lang: str, names: list[str] | None = None) -> DataFrame:
    """Records of a language (by name, in any case and with blanks) whose report and translation are not blank."""
    wanted = names or REPORT_LANGUAGES[lang]
    return records.filter(F.lower(strip("language")).isin(*wanted) & (strip("report") != "") & (strip("translation") != ""))


def report_segments(records: DataFrame, src_lang: str = "de", tgt_lang: str = "en") -> DataFrame:
    """Segments of report records of a language paired with English, in either direction."""
    if "en" not in (src_lang, tgt_lang) or src_lang == tgt_lang:
        raise ValueError("a report language is paired with English")
    lang = tgt_lang if src_lang == "en" else src_lang
    rows = report_records(records, lang)
    report, translation = strip("report"), strip("translation")
    modality = F.coalesce(F.nullif(strip("modality"), F.lit("")), F.lit("unspecified"))
    ident = F.concat(F.lit("parrot-"), F.col("no").cast("string"))
    meta = {"modality": modality, "area": area("area"), "area_raw": F.col("area"), "icd": F.col("icd"), "subspecialty": F.col("subspecialty"), "contributor_code": F.col("contributor_code"), "country": F.col("country")}
    return rows.select(
        ident.alias("id"),
        F.concat(F.lit("parrot-"), F.lower(modality)).alias("domain"),
        F.lit(src_lang).alias("src_lang"),
        F.lit(tgt_lang).alias("tgt_lang"),
        (translation if src_lang == "en" else report).alias("src_text"),
        (report if src_lang == "en" else translation).alias("ref_text"),
        ident.alias("doc_id"),
        F.create_map(*[x for n, c in meta.items() for x in (F.lit(n), F.coalesce(c, F.lit("")))]).alias("metadata"),
    )


#: Entries of a term bank at most, as each text is searched for each.
MOST_TERMS = 20_000


def term_bank(bank: DataFrame) -> list[tuple[str, str, str]]:
    """The filled distinct entries of a term bank, sorted: concept, en, de. A bank holds some thousands at most."""
    missing = {"concept_id", "en", "de"} - set(bank.columns)
    if missing:
        raise ValueError(f"a term bank needs {', '.join(sorted(missing))}")
    rows = bank.filter("en <> '' AND de <> ''").select("concept_id", "en", "de").distinct().orderBy("concept_id", "en", "de")
    found = [tuple(r) for r in rows.limit(MOST_TERMS + 1).collect()]
    if len(found) > MOST_TERMS:
        raise ValueError(f"a term bank of more than {MOST_TERMS} entries")
    return found


def run_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Round-trip rows of a folder; the model is the file name between rt_ and .jsonl. Combined files are left out."""
    rows = spark.read.json(os.path.join(folder, "rt_*.jsonl"))
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    return rows.filter(~F.contains(name, F.lit("combined"))).withColumn("model", F.regexp_extract(name, r"^rt_(.*)\.jsonl$", 1))


def curve_table(spark: SparkSession, path: str) -> DataFrame:
    """A step table as CSV in which a dash or nothing is a missing value."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.nullif(F.nullif(F.col(f"`{c}`"), F.lit("—")), F.lit("")).alias(c) for c in rows.columns))
