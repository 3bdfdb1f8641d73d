"""Writers: JSON lines, Parquet, summaries, leaderboards and step reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.aggregate import LEADERBOARD_COLUMNS, curve_as_text, figure_data


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line with sorted keys and explicit nulls."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_rows(df: DataFrame, path: str, parquet: str | None = None) -> None:
    """JSON lines always, Parquet too where a path is given; the rows are then made once, and read back as Parquet."""
    if parquet:
        df.write.mode("overwrite").parquet(parquet)
        df = df.sparkSession.read.schema(df.schema).parquet(parquet)
    write_jsonl(df, path)


def _save(value: dict, path: str) -> dict:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(value, out, indent=2, sort_keys=True, ensure_ascii=False)
        out.write("\n")
    return value


def write_summary(summary: DataFrame, path: str) -> dict:
    """The one row of a run summary as indented JSON with sorted keys; surface and neural parts only where there are."""
    row = json.loads(summary.select(F.to_json(F.struct("*")).alias("j")).first().j)
    clinical = ["critical_error_segments", "critical_error_rate", "error_segment_rates", "finding_counts", "severity_counts"]
    out = {"clinical": {n: row[n] for n in clinical}, **{n: row.get(n) for n in ("model", "n_segments", "has_references")}}
    if row.get("surface"):
        out["surface"] = {**row["surface"], "signatures": row["signatures"]}
    if row.get("comet") is not None:
        out["neural"] = {"comet": row["comet"]}
    return _save(out, path)


def write_report(table: DataFrame, folder: str) -> dict[str, str]:
    """A leaderboard as CSV and as a JSON table in ``folder``; the paths by name."""
    paths = {"master_table": os.path.join(folder, "master_metrics.csv"), "master_json": os.path.join(folder, "master_metrics.json")}
    write_leaderboard(table, paths["master_table"])
    rows = table.select(*LEADERBOARD_COLUMNS).orderBy("model", "direction", "domain").collect()  # one per system and domain
    _save({"table": [r.asDict() for r in rows]}, paths["master_json"])
    return paths


def write_curve(curve: DataFrame, folder: str, figures: bool = False) -> str:
    """A step curve as CSV and Markdown in ``folder``, and the data of each figure as CSV where asked for."""
    curve_as_text(curve).orderBy("model", F.col("step").cast("int")).coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(folder, "roundtrip_steps.csv"))
    text = "".join(f"## {name} by step\n\n{step_report(curve, name)}\n" for name in ("crit_rate", "hop_crit_rate", "bleu", "chrf", "ter"))
    with open(os.path.join(folder, "ROUNDTRIP_RESULTS.md"), "w", encoding="utf-8") as out:
        out.write(text)
    for name, data in (figure_data(curve) if figures else {}).items():
        data.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(folder, f"figure_{name}.csv"))
    return text


def write_leaderboard(table: DataFrame, path: str) -> None:
    """The fixed columns as one CSV file with a header; an empty table is an error."""
    if table.isEmpty():
        raise ValueError("an empty leaderboard")
    table.select(*LEADERBOARD_COLUMNS).orderBy("model", "direction", "domain").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def step_report(steps: DataFrame, metric: str, by: str = "model") -> str:
    """A Markdown table of a metric, a system per line and a step per column; a dash for a missing value."""
    numbers = [r.step for r in steps.select("step").distinct().orderBy("step").collect()]
    rows = steps.groupBy(by).pivot("step", numbers).agg(F.first(metric, ignorenulls=True)).orderBy(by).collect()
    lines = ["| " + " | ".join([by, *map(str, numbers)]) + " |", "|" + "---|" * (len(numbers) + 1)]
    lines += ["| " + " | ".join([r[by], *("—" if r[str(n)] is None else f"{r[str(n)]:.2f}" for n in numbers)]) + " |" for r in rows]
    return "\n".join(lines) + "\n"
