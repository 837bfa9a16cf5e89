"""From yearly files to the processed layer: observe, gate, clean, write."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, SparkSession

from caseflow.config import Settings
from caseflow.operators.cleaning import Context, clean, quality_report
from caseflow.operators.drift import Observation, detect, gate, load_baseline, next_baseline, observation, observe, save_baseline
from caseflow.schema import DATE_COLUMNS
from caseflow.sources.readers import read_text_csv, detect_encoding, year_of
from caseflow.sources.sinks import append_json, write_processed


def ingest(spark: SparkSession, files: dict[int, str] | list[str], out: str, baseline: str, run_date: datetime.date, accept_drift: bool = False, settings: Settings | None = None, history: str | None = None) -> dict:
    """Loads yearly files.  Nothing is written where drift of severity ERROR is found and not accepted."""
    settings = settings or Settings()
    files = files if isinstance(files, dict) else {year_of(f): f for f in files}
    known = load_baseline(baseline)
    seen: list[Observation] = []
    findings: list[dict] = []
    parts: list[DataFrame] = []
    reports = {}
    for year, path in sorted(files.items()):
        raw = read_text_csv(spark, path, ";", detect_encoding(spark, path))
        now = observe(raw, year, settings)
        cleaned = clean(raw, Context(year, run_date, settings), keep_observations=True)
        report = quality_report(now.record_count, cleaned)
        unreadable = {c: report["observed"][f"invalid_dates:{c}"] for c in DATE_COLUMNS}
        findings += detect(now, observation(known.get(year)), settings, unreadable)
        seen.append(now)
        reports[year] = report
        parts.append(cleaned.drop(*(c for c in cleaned.columns if c.startswith("__obs_"))))
    gate(findings, accept_drift)
    write_processed(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), out)
    save_baseline(baseline, next_baseline(known, seen, findings, accept_drift))
    result = {"run_date": run_date.isoformat(), "years": sorted(files), "reports": reports, "findings": findings, "accepted": accept_drift}
    if history:
        append_json(history, result)
    return result
