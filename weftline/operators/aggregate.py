"""Aggregates over scored rows: run summary, leaderboard, steps of a round trip, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import metrics as m
from weftline.functions.detect import has_critical
from weftline.session import checkpoint

# Code prefixes behind each rate.
RATES = {
    "negation_flip_rate": "negation_",
    "laterality_error_rate": "laterality_",
    "number_error_rate": "number_or_measurement_mismatch",
    "terminology_error_rate": "terminology_not_preserved",
}
LEADERBOARD_COLUMNS = ["model", "direction", "domain", "n_segments", "bleu", "chrf", "ter", "comet", "critical_error_rate", *RATES]


def prefix_rate(prefix: str, findings: str = "findings") -> Column:
    """Aggregate: share of rows with a finding whose code begins with ``prefix``; a null array holds none."""
    return F.avg(F.coalesce(F.exists(findings, lambda f: f["code"].startswith(prefix)), F.lit(False)).cast("int"))


def with_stats(scored: DataFrame, hyp: str = "hyp_text", ref: str = "ref_text", ter: bool = True) -> DataFrame:
    """``scored`` with the counters of BLEU, chrF++ and TER; null where a text is null."""
    out = scored.withColumn("bleu_stats", m.bleu_stats(hyp, ref)).withColumn("chrf_stats", m.chrf_stats(hyp, ref))
    return out.withColumn("ter_stats", m.ter_stats(hyp, ref)) if ter else out


def leaderboard(rows: DataFrame, comet: Column | None = None) -> DataFrame:
    """One row per model, direction and domain of rows with counters (``with_stats``) and findings.

    Surface scores are corpus scores, null unless every row of the group has a reference. Missing keys become
    'unknown', '?' and 'unspecified'. One shuffle; all sums are pre-aggregated.
    """
    keys = [
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.concat(F.coalesce("src_lang", F.lit("?")), F.lit("→"), F.coalesce("tgt_lang", F.lit("?"))).alias("direction"),
        F.coalesce("domain", F.lit("unspecified")).alias("domain"),
    ]
    whole = F.bool_and(F.col("ref_text").isNotNull())
    sums = {"bleu": (m.BLEU_SIZE, m.bleu), "chrf": (m.CHRF_SIZE, m.chrf), "ter": (2, m.ter)}
    present = {k: v for k, v in sums.items() if f"{k}_stats" in rows.columns}
    aggregates = [F.count("*").alias("n_segments"), whole.alias("_all")]
    aggregates += [m.sum_stats(f"{k}_stats", size).alias(f"_{k}") for k, (size, _) in present.items()]
    aggregates.append((F.avg(comet) if comet is not None else F.lit(None).cast("double")).alias("comet"))
    aggregates.append(F.avg(has_critical("findings").cast("int")).alias("critical_error_rate"))
    aggregates += [prefix_rate(p).alias(n) for n, p in RATES.items()]
    out = rows.groupBy(*keys).agg(*aggregates)
    for k in sums:
        score = F.when(F.col("_all"), present[k][1](F.col(f"_{k}"))) if k in present else F.lit(None).cast("double")
        out = out.withColumn(k, score)
    return out.select(*LEADERBOARD_COLUMNS)


def run_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per run, or for all rows where ``by`` is not given.

    Columns: ``by``, model (null for several), n_segments, has_references (in every row), critical_error_segments,
    critical_error_rate, maps by code and severity, surface (corpus scores of the counters of ``with_stats`` that are
    there; empty unless every row has a reference), signatures of those, and comet (mean of the rows' values).
    ``error_segment_rates`` counts rows with a code once, ``finding_counts`` all findings. An empty table gives one row
    of zeros without ``by``.
    """
    by = by or []
    brief = F.transform(F.coalesce("findings", F.array().cast(rows.schema["findings"].dataType)), lambda f: F.struct(f["code"].alias("code"), f["severity"].alias("severity")))
    present = {k: (size, form) for k, (size, _, form) in m.COUNTERS.items() if f"{k}_stats" in rows.columns}
    field = lambda n: F.col(n) if n in rows.columns and n not in by else F.lit(None).cast("string")
    comet = F.try_element_at("metrics", F.lit("comet")) if "metrics" in rows.columns else F.lit(None).cast("double")
    own = [F.col("model") if "model" in by else field("model").alias("model")]
    own += [*(F.col(b) for b in by if b != "model"), has_critical("findings").alias("critical"), brief.alias("findings"), field("ref_text").isNotNull().alias("referenced"), comet.alias("comet")]
    counted = checkpoint(rows.select(*own, *(f"{k}_stats" for k in present)))  # narrow, and read twice
    sums = [m.sum_stats(f"{k}_stats", size).alias(f"_{k}") for k, (size, _) in present.items()]
    model = [] if "model" in by else [F.when(F.min("model") == F.max("model"), F.min("model")).alias("model")]
    critical = F.coalesce(F.sum(F.col("critical").cast("long")), F.lit(0))
    whole = counted.groupBy(*by).agg(*model, F.count("*").alias("n_segments"), F.coalesce(F.bool_and("referenced"), F.lit(False)).alias("has_references"), critical.alias("critical_error_segments"), F.avg("comet").alias("comet"), *sums)
    tagged = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("k")))
    codes, severities = F.transform("findings", lambda f: f["code"]), F.transform("findings", lambda f: f["severity"])
    every = F.concat(tagged("rows", F.array_distinct(codes)), tagged("codes", codes), tagged("severities", severities))
    counts = counted.select(*by, F.explode(every).alias("e")).groupBy(*by, "e.kind", "e.k").agg(F.count("*").alias("n"))
    bounded = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("kind", "k", "n"))).alias("_c"))  # one entry per code
    pick = lambda kind: F.map_from_entries(F.transform(F.filter("_c", lambda x: x["kind"] == kind), lambda x: F.struct(x["k"], x["n"])))
    both = whole.join(bounded, by, "left") if by else whole.crossJoin(bounded)
    both = both.withColumn("_c", F.coalesce("_c", F.array().cast(bounded.schema["_c"].dataType)))
    rate = F.when(F.col("n_segments") > 0, F.col("critical_error_segments") / F.col("n_segments")).otherwise(0.0)
    scores = F.create_map(*[x for k, (_, form) in present.items() for x in (F.lit(k), form(F.col(f"_{k}")))]) if present else F.create_map().cast("map<string,double>")
    signed = F.create_map(*[F.lit(x) for k in present for x in (k, m.SIGNATURES[k])]) if present else F.create_map().cast("map<string,string>")
    return both.select(
        *([] if "model" in by else ["model"]),
        *by,
        "n_segments",
        "has_references",
        "critical_error_segments",
        rate.alias("critical_error_rate"),
        F.transform_values(pick("rows"), lambda _, n: n / F.col("n_segments")).alias("error_segment_rates"),
        pick("codes").alias("finding_counts"),
        pick("severities").alias("severity_counts"),
        F.when(F.col("has_references"), scores).otherwise(F.create_map().cast("map<string,double>")).alias("surface"),
        F.when(F.col("has_references"), signed).otherwise(F.create_map().cast("map<string,string>")).alias("signatures"),
        "comet",
    )


# Columns of a step curve, and the codes that its counts add up.
CURVE_COLUMNS = ["model", "step", "cycle", "direction", "n", "crit_rate", "hop_crit_rate", "bleu", "chrf", "ter", "mean_chars", "neg", "num", "lat", "term"]
CURVE_CODES = {
    "neg": ("negation_dropped", "negation_introduced"),
    "num": ("number_or_measurement_mismatch",),
    "lat": ("laterality_missing_or_flipped", "laterality_added_or_flipped"),
    "term": ("terminology_not_preserved",),
}


def step_curve(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per system (or ``by``) and step of round-trip rows: rates against the origin and of the hop alone, means
    of the sentence scores, mean length, and findings by kind. One shuffle of pre-aggregated sums."""
    keys = [*(by or ["model"]), "step"]
    metric = lambda n: F.avg(F.try_element_at("metrics", F.lit(n))).alias(n)
    flag = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    counts = lambda codes: F.coalesce(F.sum(F.size(F.filter("findings", lambda f: f["code"].isin(*codes))).cast("long")), F.lit(0))
    return rows.groupBy(*keys).agg(
        F.min("cycle").alias("cycle"),
        F.min("direction").alias("direction"),
        F.count("*").alias("n"),
        flag("has_critical_error").alias("crit_rate"),
        flag("hop_has_critical_error").alias("hop_crit_rate"),
        *(metric(n) for n in ("bleu", "chrf", "ter")),
        F.avg(F.length("hyp_text")).alias("mean_chars"),
        *(counts(codes).alias(n) for n, codes in CURVE_CODES.items()),
    )


# Decimals of each column of a step curve as written, and the sign for a missing value.
_CURVE_FORMS = {"crit_rate": 4, "hop_crit_rate": 4, "bleu": 2, "chrf": 2, "ter": 2, "mean_chars": 0}
MISSING = "—"


def curve_as_text(curve: DataFrame) -> DataFrame:
    """The columns of a step curve as they are written: fixed decimals, a dash for a missing value."""
    form = lambda c: F.format_string(f"%.{_CURVE_FORMS[c]}f", c) if c in _CURVE_FORMS else F.col(c).cast("string")
    return curve.select(*(F.when(F.col(c).isNull(), MISSING).otherwise(form(c)).alias(c) for c in CURVE_COLUMNS))


def figure_data(curve: DataFrame, control: str = "identity") -> dict[str, DataFrame]:
    """What each figure of a round trip shows, by its name: narrow tables, without the control.

    curves (metric by odd step), dumbbell (first and last odd step), clinical (rates by step), bleu_vs_clinical (first
    step), output_length (mean characters by step in percent of the first).
    """
    own = curve.filter(F.col("model") != control)
    odd = own.filter("step % 2 = 1")
    ends = odd.groupBy("model").agg(F.min_by("bleu", "step").alias("first_bleu"), F.max_by("bleu", "step").alias("last_bleu"))
    first = own.groupBy("model").agg(F.min_by("mean_chars", "step").alias("_first"))
    return {
        "curves": odd.select("model", "step", "cycle", "bleu", "chrf", "ter"),
        "dumbbell": ends.withColumn("delta", F.col("last_bleu") - F.col("first_bleu")),
        "clinical": own.select("model", "step", "crit_rate", "hop_crit_rate", "neg", "num", "lat", "term"),
        "bleu_vs_clinical": own.filter("step = 1").select("model", "bleu", "crit_rate"),
        "output_length": own.join(first, "model").select("model", "step", (100 * F.col("mean_chars") / F.col("_first")).alias("percent")),
    }


def step_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per step of a round trip: means of sentence scores, critical rate, finding counts, mean length."""
    by = by or []
    keys = [*by, "step"]
    metric = lambda n: F.avg(F.try_element_at("metrics", F.lit(n))).alias(n)
    out = rows.groupBy(*keys).agg(
        F.min("cycle").alias("cycle"),
        F.min("direction").alias("direction"),
        F.count("*").alias("n_segments"),
        F.avg(F.coalesce("has_critical_error", F.lit(False)).cast("int")).alias("critical_error_rate"),
        *(metric(n) for n in ("bleu", "chrf", "ter")),
        F.avg(F.length("hyp_text")).alias("mean_output_chars"),
    )
    counts = rows.select(*keys, F.explode("findings").alias("f")).groupBy(*keys, F.col("f.code").alias("code")).count()
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "count")))).alias("finding_counts"))
    empty = F.create_map().cast("map<string,bigint>")
    return out.join(maps, keys, "left").withColumn("finding_counts", F.coalesce("finding_counts", empty))


def curve_summary(steps: DataFrame, metric: str = "bleu", last_cycle: int = 10, by: str = "model") -> DataFrame:
    """Per system: the metric at cycles 1, 2 and the last (odd steps), the change and the share lost by cycle 2."""
    odd = steps.filter("step % 2 = 1")
    at = lambda c: F.max(F.when(F.col("cycle") == c, F.col(metric)))
    out = odd.groupBy(by).agg(at(1).alias("c1"), at(2).alias("c2"), at(last_cycle).alias("c_last"))
    fall = F.col("c1") - F.col("c_last")
    return out.select(by, "c1", "c2", "c_last", (-fall).alias("delta"), F.when(fall != 0, (F.col("c1") - F.col("c2")) / fall).alias("front_loaded"))


def wide_curve(steps: DataFrame, metric: str, n_steps: list[int], by: str = "model") -> DataFrame:
    """A system per row, a step per column."""
    return steps.groupBy(by).pivot("step", n_steps).agg(F.first(metric, ignorenulls=True))


def shrinking(steps: DataFrame, by: str = "model", share: float = 0.95) -> DataFrame:
    """Per system: mean output length of the first and last step and whether it shrank below ``share``."""
    out = steps.groupBy(by).agg(F.min_by("mean_output_chars", "step").alias("first_chars"), F.max_by("mean_output_chars", "step").alias("last_chars"))
    return out.withColumn("shrinks", F.col("last_chars") < share * F.col("first_chars"))


def ranked(steps: DataFrame, by: str = "model", control: str = "identity") -> DataFrame:
    """Systems without the control by their first step's BLEU, best first."""
    first = steps.filter((F.col("step") == 1) & (F.col(by) != control))
    return first.select(by, "bleu").orderBy(F.desc_nulls_last("bleu"), by)
