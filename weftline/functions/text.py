"""Text functions as column expressions: sentences, chunks, prompts, replies, names of models and areas."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.schema import collapse, language_name, strip

#: Characters per token that the chunk budget assumes.
CHARS_PER_TOKEN = 3.0

# Prompts whose wording the translation models are given.
SINGLE_PROMPT = "Translate the following medical text from %s to %s. Return only the translation, with no explanation.\n\n%s"
API_PROMPT = "Translate the following medical text from %s to %s. Return only the translation, with no explanation, no preamble, and no quotation marks.\n\n%s"
TARGET_PROMPT = "Translate the following text into %s. Note that you should only output the translated result without any additional explanation:\n\n%s"
BATCH_PROMPT = (
    "Translate each of the following %d medical texts from %s to %s.\n\n"
    "Rules:\n"
    "- Output exactly %d translations.\n"
    "- Prefix each translation with its number in the form '[[k]]' on its own line, using the same numbering as the input.\n"
    "- Do not merge, split, reorder, or omit any item.\n"
    "- Output only the translations. No commentary, no preamble, no repetition of the source.\n\n"
)

# Fixed value: a mark ends a sentence unless a capital or a digit stands before it.
_SENTENCE_END = r"(?U)(?<=[^\sA-ZÇĞİÖŞÜ0-9])([.!?])\s+"
_MARK = "\x01"


def sentences(text: Column | str) -> Column:
    """Sentences with their marks, stripped, empties left out; null for null. U+0001 must not occur in the text."""
    parts = F.split(F.regexp_replace(text, _SENTENCE_END, "$1" + _MARK), _MARK)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def chunks(text: Column | str, max_tokens: int) -> Column:
    """Sentences packed greedily into chunks of at most ``max_tokens`` (by characters); a longer one stays whole."""
    budget = max(1, int(max_tokens * CHARS_PER_TOKEN))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        grown = F.concat(state["open"], F.lit(" "), sentence)
        fresh = F.struct(state["done"].alias("done"), sentence.alias("open"))
        fits = F.struct(state["done"].alias("done"), grown.alias("open"))
        full = F.struct(F.array_append(state["done"], state["open"]).alias("done"), sentence.alias("open"))
        return F.when(state["open"] == "", fresh).when(F.length(grown) <= budget, fits).otherwise(full)

    return F.aggregate(sentences(text), empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def chunk_documents(df: DataFrame, key: str, text: str, max_tokens: int) -> DataFrame:
    """One row per chunk: key, position (from 0), n_chunks, chunk. Texts without sentences have no chunk."""
    parts = df.select(F.col(key), chunks(text, max_tokens).alias("_c"))
    return parts.select(key, F.size("_c").alias("n_chunks"), F.posexplode("_c").alias("position", "chunk"))


def reassemble(documents: DataFrame, chunked: DataFrame, key: str, chunk: str = "chunk") -> DataFrame:
    """key and text: the chunks of each document in order, stripped, empties left out, joined by a blank.

    A document without chunks gets an empty text. A document whose chunks are not all there raises an error.
    """
    parts = chunked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", F.col(chunk).alias("c")))).alias("_p"), F.max("n_chunks").alias("_n"))
    joined = documents.select(key).join(parts, key, "left")
    texts = F.filter(F.transform("_p", lambda p: strip(p["c"])), lambda x: x != "")
    whole = F.when(F.col("_p").isNull(), F.lit("")).when(F.size("_p") == F.col("_n"), F.array_join(texts, " "))
    return joined.select(key, F.coalesce(whole, F.raise_error(F.lit("chunks are missing")).cast("string")).alias("text"))


def strip_thinking(text: Column | str) -> Column:
    """Without closed <think> blocks, stripped; an open block stays."""
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def unescape(text: Column | str) -> Column:
    """All named and numeric character references as characters, once; null for null.

    Only texts with an ampersand go to Python, where the standard table of names is; the others stay in the JVM.
    """
    column = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else html.unescape(x))

    marked = F.when(F.contains(column, F.lit("&")), column)
    return F.when(marked.isNotNull(), decoded(marked)).otherwise(column)


def single_prompt(text: Column | str, src_lang: Column | str, tgt_lang: Column | str) -> Column:
    """The prompt for one text."""
    return F.format_string(SINGLE_PROMPT, language_name(src_lang), language_name(tgt_lang), F.col(text) if isinstance(text, str) else text)


def api_prompt(text: Column | str, src_lang: Column | str, tgt_lang: Column | str) -> Column:
    """The prompt for one text of a served model, where a numbered reply failed."""
    return F.format_string(API_PROMPT, language_name(src_lang), language_name(tgt_lang), F.col(text) if isinstance(text, str) else text)


def target_prompt(text: Column | str, tgt_lang: Column | str) -> Column:
    """The prompt of models that are told the target language only."""
    return F.format_string(TARGET_PROMPT, language_name(tgt_lang), F.col(text) if isinstance(text, str) else text)


def batch_prompt(texts: Column | str, src_lang: Column | str, tgt_lang: Column | str) -> Column:
    """The numbered prompt for an array of texts."""
    array = F.col(texts) if isinstance(texts, str) else texts
    body = F.array_join(F.transform(array, lambda t, i: F.concat(F.lit("[["), (i + 1).cast("string"), F.lit("]]\n"), t)), "\n\n")
    return F.concat(F.format_string(BATCH_PROMPT, F.size(array), language_name(src_lang), language_name(tgt_lang), F.size(array)), body)


def parse_batch(content: Column | str, expected: Column | int) -> Column:
    """The items of a numbered reply, or null if their number or numbering is wrong or one is empty."""
    marker = r"\[\[\s*(\d+)\s*\]\]"
    wanted = F.lit(expected) if isinstance(expected, int) else expected
    numbers = F.transform(F.regexp_extract_all(content, F.lit(marker), F.lit(1)), lambda x: x.try_cast("int"))
    items = F.transform(F.slice(F.split(content, marker), 2, 1 << 20), strip)
    good = (F.size(numbers) == wanted) & (numbers == F.when(wanted > 0, F.sequence(F.lit(1), wanted)).otherwise(F.array().cast("array<int>"))) & ~F.exists(items, lambda x: x == "")
    return F.when(good, items)


def model_leaf(name: Column | str) -> Column:
    """Name of a model in lower case without name space and trailing digits of a snapshot."""
    return F.regexp_replace(F.substring_index(F.lower(strip(name)), "/", -1), r"-v?\d+$", "")


def same_model(requested: Column | str, served: Column | str) -> Column:
    """Whether the served model is the requested one."""
    return model_leaf(requested) == model_leaf(served)


def area(value: Column | str) -> Column:
    """Free-text area as a key: one blank, lower case, parts apart by ', '; 'unspecified' for null or empty."""
    parts = F.filter(F.transform(F.split(F.lower(collapse(value)), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit("unspecified"))


def previous_output(keys: list[str], step: str, output: str, origin: str) -> Column:
    """What each step took in: the previous step's output, the origin at the first."""
    return F.coalesce(F.lag(output).over(Window.partitionBy(*keys).orderBy(step)), F.col(origin))
