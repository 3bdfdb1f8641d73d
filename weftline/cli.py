"""Command line: translate, evaluate, run, report, leaderboard, compare, round trip, convert."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import metrics
from weftline.operators import aggregate, corpus, stats, translate
from weftline.schema import HYPOTHESIS_ALIASES, to_segments
from weftline.session import checkpoint, session, ship
from weftline.sources import readers, writers


def _bank(spark, path: str | None):
    return readers.term_bank(readers.read_rows(spark, path)) if path else None


def _predictions(rows: DataFrame) -> DataFrame:
    """Segments with the first present hypothesis column; an empty hypothesis is a valid one."""
    names = [n for n in HYPOTHESIS_ALIASES if n in rows.columns]
    if not names:
        raise ValueError("no column with hypotheses")
    kept = to_segments(rows).drop("metadata")
    hyps = rows.select(_id(rows).alias("id"), F.coalesce(*(F.col(n) for n in names)).alias("hyp_text"), (F.col("model") if "model" in rows.columns else F.lit("unknown")).alias("model"))
    return kept.join(hyps, "id")


def _id(rows: DataFrame):
    from weftline.schema import COLUMN_ALIASES, first_filled

    return first_filled(rows, COLUMN_ALIASES["id"])


def _write(scored: DataFrame, args) -> None:
    scored = checkpoint(scored)
    counters = [f"{n}_stats" for n in metrics.COUNTERS if f"{n}_stats" in scored.columns]
    writers.write_rows(scored.drop(*counters), args.output, getattr(args, "parquet", None))
    print(json.dumps(writers.write_summary(aggregate.run_summary(scored), getattr(args, "summary", None) or f"{args.output.rstrip('/')}.summary.json"), sort_keys=True))


def _run(spark, args) -> None:
    segments = readers.read_segments(spark, args.input, args.src_lang, args.tgt_lang, args.reverse)
    predicted = translate.predict(segments.drop("metadata"), translate.create(args.model), *corpus.single_direction(segments), args.chunk_max_tokens)
    if args.verb == "translate":
        writers.write_rows(predicted, args.output)
    else:
        _write(translate.score(checkpoint(predicted), _bank(spark, args.term_bank)), args)


def _evaluate(spark, args) -> None:
    predicted = _predictions(readers.read_rows(spark, args.input))
    if args.model:
        predicted = predicted.withColumn("model", F.lit(args.model))
    _write(translate.score(checkpoint(predicted), _bank(spark, args.term_bank)), args)


def _table(spark, paths) -> DataFrame:
    rows = readers.read_rows(spark, paths)
    comet = F.try_element_at("metrics", F.lit("comet")) if dict(rows.dtypes).get("metrics", "").startswith("map") else None
    return checkpoint(aggregate.leaderboard(aggregate.with_stats(rows), comet))


def _leaderboard(spark, args) -> None:
    writers.write_leaderboard(_table(spark, args.inputs), args.output)


def _report(spark, args) -> None:
    print(json.dumps(writers.write_report(_table(spark, args.inputs), args.output), sort_keys=True))


def _run_rows(spark, path: str) -> DataFrame:
    rows = readers.read_rows(spark, path)
    flag = rows.select(_id(rows).alias("id"), "has_critical_error") if "has_critical_error" in rows.columns else None
    kept = _predictions(rows)
    return kept if flag is None else kept.join(flag, "id")


def _compare(spark, args) -> None:
    pairs = stats.paired(_run_rows(spark, args.baseline), _run_rows(spark, args.candidate), flags=args.error_incidence)
    size, counts, form = metrics.COUNTERS[args.metric]
    counted = checkpoint(pairs.withColumn("b", counts("hyp_base", "ref_base")).withColumn("c", counts("hyp_cand", "ref_cand")))
    better = args.metric != "ter"
    out = stats.paired_bootstrap(counted, "id", "b", "c", size, form, args.resamples, args.seed, better).first().asDict()
    out |= {"metric": args.metric, "higher_is_better": better, "n_segments": counted.count()}
    if args.error_incidence:
        out["mcnemar_critical_error"] = stats.mcnemar(counted, "critical_base", "critical_cand").first().asDict()
    text = json.dumps(out, sort_keys=True)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as to:
            to.write(text + "\n")
    print(text)


def _roundtrip(spark, args) -> None:
    segments = readers.read_segments(spark, args.input, args.src_lang, args.tgt_lang).drop("metadata")
    if args.sample:
        segments = corpus.stratified_sample(segments, "src_text", "id", args.sample)
    rows = checkpoint(translate.round_trip(segments, translate.create(args.model), None, args.cycles, _bank(spark, args.term_bank)))
    writers.write_rows(rows, args.output)
    writers.write_rows(aggregate.step_summary(rows), f"{args.output.rstrip('/')}.steps")
    if args.report:
        os.makedirs(args.report, exist_ok=True)
        writers.write_curve(checkpoint(aggregate.step_curve(rows)), args.report, figures=True)


def _convert(spark, args) -> None:
    if args.kind == "tmx":
        out = readers.tmx_segments(spark, args.input, args.src_lang, args.tgt_lang, args.sample, args.seed)
    elif args.kind == "sgml":
        out = readers.sgml_tar_segments(spark, args.input, args.year, args.src_lang, args.tgt_lang)
    else:
        out = readers.report_segments(readers.read_rows(spark, args.input), args.src_lang, args.tgt_lang)
    writers.write_rows(out, args.output)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="weftline")
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, handler, *names: str) -> argparse.ArgumentParser:
        sub = verbs.add_parser(name)
        for n in names:
            sub.add_argument(f"--{n}", required=n in ("input", "output", "inputs", "baseline", "candidate"), nargs="+" if n == "inputs" else None)
        sub.set_defaults(handler=handler)
        return sub

    for name in ("translate", "run"):
        sub = verb(name, _run, "input", "output", "src-lang", "tgt-lang", "term-bank", "parquet", "summary")
        sub.add_argument("--model", default="identity")
        sub.add_argument("--reverse", action="store_true")
        sub.add_argument("--chunk-max-tokens", type=int)
    verb("evaluate", _evaluate, "input", "output", "model", "term-bank", "parquet", "summary")
    verb("leaderboard", _leaderboard, "inputs", "output")
    verb("report", _report, "inputs", "output")
    sub = verb("compare", _compare, "baseline", "candidate")
    sub.add_argument("--metric", choices=("bleu", "chrf", "ter"), default="bleu")
    sub.add_argument("--resamples", type=int, default=2000)
    sub.add_argument("--seed", type=int, default=13)
    sub.add_argument("--error-incidence", action="store_true")
    sub.add_argument("--output")
    sub = verb("roundtrip", _roundtrip, "input", "output", "src-lang", "tgt-lang", "term-bank")
    sub.add_argument("--model", default="identity")
    sub.add_argument("--cycles", type=int, default=10)
    sub.add_argument("--sample", type=int, default=0)
    sub.add_argument("--report")
    sub = verb("convert", _convert, "input", "output")
    sub.add_argument("kind", choices=("tmx", "sgml", "reports"))
    sub.add_argument("--src-lang", default="de")
    sub.add_argument("--tgt-lang", default="en")
    sub.add_argument("--year", type=int, default=2017)
    sub.add_argument("--sample", type=int, default=400)
    sub.add_argument("--seed", type=int, default=13)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = session()
    ship(spark)
    try:
        args.handler(spark, args)
    except (ValueError, FileNotFoundError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
