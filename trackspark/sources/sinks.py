"""Sinks: tables, versioned runs, fallback beats, JSON records, Markdown reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fixed, iso_from_epoch_ms


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, also if there are no rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_run(df: DataFrame, root: str, run_id: str, name: str) -> None:
    """A table of a run, below run_id=.../; runs don't overwrite each other, a repeated run does itself."""
    df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines with nulls spelled out; NaN becomes null, as JSON has none."""
    clean = df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_rows(spark: SparkSession, rows: Sequence[Mapping], path: str) -> None:
    """A few rows as CSV, with the names in the first for a header; without rows the file is empty."""
    if not rows:
        spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    names = list(rows[0])
    text = spark.createDataFrame([[None if r.get(c) is None else str(r[c]) for c in names] for r in rows], ", ".join(f"`{c}` string" for c in names))
    write_csv(text.coalesce(1), path)


def write_summary(df: DataFrame, csv: str, json: str) -> None:
    """A summary twice: as CSV with a header, and as JSON records."""
    write_csv(df, csv)
    write_records(df, json)


def write_metadata(spark: SparkSession, metadata: Mapping, path: str) -> None:
    """What a run was made of, as one JSON object in a file of one line."""
    line = json.dumps(metadata, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: Columns of a rebuilt beats table, in order.
FALLBACK = (
    "開始時刻", "記録開始時刻", "現在時刻", "epoch_ns", "monotonic_ns", "経過時間", "計測回数", "BP waveform Raw", "BP waveform [mmHg]", "MAP Raw", "MAP [mmHg]",
    "CO Raw", "CO [L/min]", "Beat Sys [mmHg]", "Beat Mean [mmHg]", "Beat Dia [mmHg]", "Beat HR [bpm]",
)


def fallback_beats(events: DataFrame) -> DataFrame:
    """The beats table rebuilt from live events with a time (timestamp_ms, elapsed_s, count, sbp, dbp, map,
    hr), as text; what events lack is blank. The start is the earliest event's time."""
    rows = events.where("timestamp_ms is not null")
    begun = iso_from_epoch_ms(F.min("timestamp_ms")).alias("__begun")
    rows = rows.join(F.broadcast(rows.agg(begun)), F.lit(True))  # one row
    decimal = {"経過時間": "elapsed_s", "MAP [mmHg]": "map", "Beat Mean [mmHg]": "map", "Beat Sys [mmHg]": "sbp", "Beat Dia [mmHg]": "dbp", "Beat HR [bpm]": "hr"}
    known = {
        "開始時刻": F.col("__begun"), "記録開始時刻": F.col("__begun"), "現在時刻": iso_from_epoch_ms(F.col("timestamp_ms")),
        "epoch_ns": F.round(F.col("timestamp_ms") * 1_000_000).cast("long").cast("string"),
        **{c: fixed(F.col(e).cast("double"), 9) for c, e in decimal.items() if e in events.columns},
        **({"計測回数": F.col("count").cast("long").cast("string")} if "count" in events.columns else {}),
    }
    return rows.select([F.coalesce(known.get(c, F.lit("")), F.lit("")).alias(c) for c in FALLBACK])


def coefficient_payload(table: DataFrame) -> DataFrame:
    """One JSON object per method of a coefficient table (method, target, term, value)."""
    each = table.groupBy("method", "target").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "value")))).alias("terms"))
    return each.groupBy("method").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", F.to_json("terms").alias("terms")))))).alias("payload"))


def markdown(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3, most: int = 1000) -> str:
    """A Markdown table of a small frame; at most so many rows, as a report is read by people."""
    names = list(columns or df.columns)
    rows = df.select(names).limit(most).collect()

    def cell(v) -> str:
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def report(title: str, parts: Mapping[str, DataFrame]) -> str:
    """A Markdown report of small frames under headings."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(df)}" for name, df in parts.items())]) + "\n"


def tracking_report(summary: DataFrame, representative: str, metadata: Mapping, methods: Sequence[str] | None = None) -> str:
    """The report of a tracking analysis: its settings, and per target the methods' means over sessions at
    the primary width, the best mean error first."""
    width = float(metadata["primary_window_seconds"])
    rows = summary.where(F.col("window_seconds") == width)
    rows = rows.where(F.col("method").isin(list(methods))) if methods else rows
    columns = ["method", "n_sessions", "mean_mae", "mean_rmse", "mean_centered_mae", "mean_corr", "mean_delta_corr", "mean_detrended_corr"]
    head = "\n".join(f"* {k}: {v}" for k, v in [*metadata.items(), ("representative session", representative)])
    return "\n\n".join(["# Tracking analysis", head, *(f"## {t}\n\n{markdown(rows.where(F.col('target') == t).orderBy('mean_mae', 'method'), columns)}" for t in ("SBP", "DBP", "MAP", "PP"))]) + "\n"


def session_report(evaluation: DataFrame, n_rows: int, n_kept: int) -> str:
    """The report of one session: rows before and after the gates, and each series' measures by target."""
    columns = ["method", "series", "n", "mae", "rmse", "corr", "signed_bias", "centered_mae", "tracking_gain", "direction_agreement"]
    parts = (f"## {t}\n\n{markdown(evaluation.where(F.col('target') == t).orderBy('method', 'series'), columns)}" for t in ("SBP", "DBP", "MAP", "PP"))
    return "\n\n".join(["# Session", f"{n_kept} of {n_rows} beats pass the gates.", *parts]) + "\n"


def diagnostic_report(terms: DataFrame, culprits: DataFrame) -> str:
    """The report on pulse pressure: the terms that work against it most, and how often each is the worst."""
    worst = terms.where("inverse_strength > 0").orderBy(F.desc("inverse_strength"), "term").limit(20)
    return report("Pulse pressure terms", {"Strongest inverse terms": worst, "By term": culprits.orderBy(F.desc("n_sessions"), "term")})


def coefficient_report(coefficients: DataFrame, summary: DataFrame) -> str:
    """The report of a coefficient search: the models, and their errors in sample and held out."""
    return report("Coefficients", {"Models": coefficients.orderBy("method", "target", "term"), "Errors over all sessions": summary.where("session_id = 'ALL'").orderBy("method", "fit", "target")})
