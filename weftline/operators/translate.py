"""Translators as column plug-ins, the scoring run, and the round trip."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import detect, metrics, text
from weftline.operators import corpus
from weftline.session import checkpoint

SCORED = ["bleu", "chrf", "ter"]


class Translator(ABC):
    """Adds a column of translations; a subclass keeps rows and their number."""

    name = "translator"
    options: dict[str, str] = {}
    direction_specific = False

    @abstractmethod
    def translate(self, df: DataFrame, source: str, into: str, src_lang: str, tgt_lang: str) -> DataFrame:
        """``df`` with the translation of ``source`` as ``into``."""


class Identity(Translator):
    """Control: returns its input."""

    name = "identity"

    def translate(self, df: DataFrame, source: str, into: str, src_lang: str, tgt_lang: str) -> DataFrame:
        if src_lang == tgt_lang:
            raise ValueError("source and target language are the same")
        return df.withColumn(into, F.col(source))


class Lookup(Translator):
    """Whole texts from a table (source, target); a text without entry stays as it is."""

    name = "lookup"

    def __init__(self, pairs: dict[tuple[str, str], dict[str, str]]):
        self.pairs = pairs

    def translate(self, df: DataFrame, source: str, into: str, src_lang: str, tgt_lang: str) -> DataFrame:
        known = self.pairs.get((src_lang, tgt_lang), {})
        if not known:
            return df.withColumn(into, F.col(source))
        table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return df.withColumn(into, F.coalesce(F.try_element_at(table, F.col(source)), F.col(source)))


class Batched(Translator):
    """Any list-to-list model in Arrow batches; ``make`` builds it once per worker.

    ``make()`` gives a function of (texts, src_lang, tgt_lang). A reply of another length is an error. The function
    is marked as non-deterministic so that no plan runs a paid translation twice; its output should be written or
    checkpointed before it is used more than once.
    """

    def __init__(self, name: str, make: Callable[[], Callable[[list[str], str, str], list[str]]], batch_size: int = 8, **options: str):
        self.name, self.make, self.batch_size, self.options = name, make, batch_size, {"batch_size": str(batch_size), **options}

    def translate(self, df: DataFrame, source: str, into: str, src_lang: str, tgt_lang: str) -> DataFrame:
        make, size, name = self.make, self.batch_size, self.name

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = make()
            for batch in batches:
                texts, out = ["" if t is None else t for t in batch], []
                for at in range(0, len(texts), size):
                    part = texts[at : at + size]
                    got = model(part, src_lang, tgt_lang)
                    if len(got) != len(part):
                        raise RuntimeError(f"{name} returned {len(got)} texts for {len(part)}")
                    out += got
                yield pd.Series(out, dtype=object)

        return df.withColumn(into, F.pandas_udf(run, "string").asNondeterministic()(source))


# Longest wait in seconds and base of the growing wait between calls.
BACKOFF_CAP, BACKOFF_BASE = 60.0, 2.0


def retry_delay(header: str | None, attempt: int, jitter: float) -> float:
    """Seconds to wait before a call is made again: what the service asks for, else a growing wait, up to the cap.

    ``jitter`` from [0, 1) spreads callers that failed at the same time. A header that is no number counts as none.
    """
    try:
        return min(float(header), BACKOFF_CAP) if header else min(BACKOFF_BASE**attempt, BACKOFF_CAP) * (0.5 + jitter)
    except ValueError:
        return min(BACKOFF_BASE**attempt, BACKOFF_CAP) * (0.5 + jitter)


class Absent:
    """An adapter whose model is not shipped: making it names what it needs, ``register`` puts a maker in its place."""

    def __init__(self, name: str, needs: str):
        self.name, self.needs = name, needs

    def __call__(self, **_: object) -> Translator:
        raise RuntimeError(f"{self.name} needs {self.needs}; register a maker for it")


# Names of adapters and what they need; models that need weights or a network register here.
ADAPTERS = {
    "opus": "weights of one direction",
    "nllb": "weights",
    "madlad": "weights",
    "tower": "weights",
    "prompted-llm": "weights",
    "hymt2": "weights",
    "translategemma": "weights",
    "deepl": "a network service",
    "openai-compat": "a network service",
}
REGISTRY: dict[str, Callable[..., Translator]] = {"identity": Identity, "lookup": Lookup, **{n: Absent(n, needs) for n, needs in ADAPTERS.items()}}


def register(name: str, make: Callable[[], Callable[[list[str], str, str], list[str]]], batch_size: int = 8) -> None:
    """Registers a list-to-list model under a name; ``make`` builds it once per worker."""
    REGISTRY[name] = lambda **options: Batched(name, make, batch_size, **options)


class Neural:
    """A learned metric in Arrow batches, with or without references; its values go under ``comet`` in the metrics.

    ``make()`` gives a function of a list of records (src, mt and, unless reference-free, ref) to a list of numbers.
    """

    def __init__(self, checkpoint_name: str, make: Callable[[], Callable[[list[dict]], list[float]]] | None = None, reference_free: bool = False, batch_size: int = 8):
        self.checkpoint_name, self.make, self.reference_free, self.batch_size = checkpoint_name, make, reference_free, batch_size

    def score(self, df: DataFrame, src: str = "src_text", hyp: str = "hyp_text", ref: str = "ref_text", into: str = "comet") -> DataFrame:
        """``df`` with the value of each row as ``into``; a missing reference is an error unless reference-free."""
        if self.make is None:
            raise RuntimeError(f"{self.checkpoint_name} needs its weights; give a maker for it")
        if not self.reference_free and (ref not in df.columns or not df.filter(F.col(ref).isNull()).isEmpty()):
            raise ValueError("a metric with references needs one in every row")
        make, size, names = self.make, self.batch_size, ["src", "mt"] if self.reference_free else ["src", "mt", "ref"]

        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = make()
            for columns in batches:
                records = [dict(zip(names, r, strict=True)) for r in zip(*columns, strict=True)]
                out: list[float] = []
                for at in range(0, len(records), size):
                    got = model(records[at : at + size])
                    if len(got) != len(records[at : at + size]):
                        raise RuntimeError(f"the metric gave {len(got)} values for {len(records[at : at + size])} records")
                    out += [float(x) for x in got]
                yield pd.Series(out, dtype="float64")

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return df.withColumn(into, F.pandas_udf(run, "double").asNondeterministic()(*([src, hyp] if self.reference_free else [src, hyp, ref])))


def create(name: str, **options) -> Translator:
    """A registered translator, or an error that names the known ones."""
    if name not in REGISTRY:
        raise ValueError(f"unknown translator {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


def predict(segments: DataFrame, translator: Translator, src_lang: str, tgt_lang: str, chunk_max_tokens: int | None = None) -> DataFrame:
    """Segments with hyp_text, model and generation; by chunks of whole sentences where a limit is given."""
    if chunk_max_tokens:
        parts = text.chunk_documents(segments, "id", "src_text", chunk_max_tokens)
        done = checkpoint(translator.translate(parts, "chunk", "_out", src_lang, tgt_lang))
        whole = text.reassemble(segments, done, "id", "_out").withColumnRenamed("text", "hyp_text")
        out = segments.join(whole, "id")
    else:
        out = translator.translate(segments, "src_text", "hyp_text", src_lang, tgt_lang)
    options = dict(translator.options) | ({"chunked": "true", "chunk_max_tokens": str(chunk_max_tokens)} if chunk_max_tokens else {})
    given = F.create_map(*[F.lit(x) for pair in options.items() for x in pair]) if options else F.create_map()
    return out.withColumn("model", F.lit(translator.name)).withColumn("generation", given.cast("map<string,string>"))


def score(predictions: DataFrame, bank: list[tuple[str, str, str]] | None = None, surface: bool = True) -> DataFrame:
    """Predictions with findings, has_critical_error and sentence metrics.

    Surface metrics need a reference in every row of the run; else the metrics map is empty in all.
    """
    out = detect.with_findings(predictions, bank=bank).withColumn("has_critical_error", detect.has_critical("findings"))
    if not surface:
        return out.withColumn("metrics", F.create_map().cast("map<string,double>"))
    complete = predictions.filter("ref_text IS NULL").limit(1).isEmpty()
    if not complete:
        return out.withColumn("metrics", F.create_map().cast("map<string,double>"))
    stats = {"bleu": metrics.bleu_stats, "chrf": metrics.chrf_stats, "ter": metrics.ter_stats}
    forms = {"bleu": metrics.bleu, "chrf": metrics.chrf, "ter": metrics.ter}
    for n, of in stats.items():
        out = out.withColumn(f"{n}_stats", of("hyp_text", "ref_text"))
    return out.withColumn("metrics", F.create_map(*[x for n in SCORED for x in (F.lit(n), forms[n](F.col(f"{n}_stats")))]))


def round_trip(segments: DataFrame, forward: Translator, backward: Translator | None = None, cycles: int = 1, bank: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Rows per segment and step of ``cycles`` translations there and back.

    Odd steps go to the target language and are scored against the reference, even ones back and against the
    origin; findings compare with the origin, hop findings with the step's input. Each step is checkpointed, as its
    translations must not run again. Less than one cycle and no segments are errors.
    """
    if cycles < 1:
        raise ValueError("at least one cycle")
    if segments.isEmpty():
        raise ValueError("no segments")
    source, target = corpus.single_direction(segments)
    with_refs = segments.filter("ref_text IS NULL").limit(1).isEmpty()
    current = segments.select("id", "domain", "src_text", "ref_text", F.col("src_text").alias("input_text"))
    steps = []
    for step in range(1, 2 * cycles + 1):
        there = step % 2 == 1
        a, b = (source, target) if there else (target, source)
        model = forward if there else backward or forward
        done = checkpoint(model.translate(current, "input_text", "hyp_text", a, b))
        given = {"cycle": (step + 1) // 2, "step": step, "direction": f"{a}->{b}", "model": model.name, "_a": a, "_b": b}
        steps.append(done.withColumns({n: F.lit(v) for n, v in given.items()}))
        current = done.select("id", "domain", "src_text", "ref_text", F.col("hyp_text").alias("input_text"))
    # all steps are scored by one plan: the filter, always true, keeps the optimizer from scoring below the union, step by step
    found = reduce(DataFrame.unionByName, steps).withColumn("_fence", F.monotonically_increasing_id()).filter("_fence >= 0")
    there = F.col("step") % 2 == 1
    found = found.withColumn("_anchor", F.when(there, F.col("ref_text")).otherwise(F.col("src_text")))
    found = detect.with_findings(found, "src_text", "hyp_text", F.lit(source), F.col("_b"), bank)
    found = detect.with_findings(found, "input_text", "hyp_text", F.col("_a"), F.col("_b"), bank, "hop_findings")
    counts = {"bleu": metrics.bleu_stats, "chrf": metrics.chrf_stats, "ter": metrics.ter_stats}
    forms = {"bleu": metrics.bleu, "chrf": metrics.chrf, "ter": metrics.ter}
    for n in SCORED:
        found = found.withColumn(f"_{n}", counts[n]("hyp_text", "_anchor"))
    scores = F.create_map(*[x for n in SCORED for x in (F.lit(n), forms[n](F.col(f"_{n}")))])
    given = scores if with_refs else F.when(there, F.create_map().cast("map<string,double>")).otherwise(scores)
    rows = found.select("id", "domain", "cycle", "step", "direction", "src_text", "ref_text", "input_text", "hyp_text", given.alias("metrics"), "findings", "hop_findings", "model")
    return rows.withColumn("has_critical_error", detect.has_critical("findings")).withColumn("hop_has_critical_error", detect.has_critical("hop_findings"))
