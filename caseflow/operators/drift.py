"""Drift of a load's schema against the year's baseline."""

from __future__ import annotations

import datetime
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.config import Settings
from caseflow.functions.codes import NUMBER, ratio
from caseflow.functions.dates import blank_to_null, parse_date
from caseflow.schema import ALLOWED_COLUMNS, CODE_LABELS

AGREEMENT = 0.99


@dataclass
class Observation:
    year: int
    raw_columns: list[str]
    dtypes: dict[str, str]
    missing_rate: dict[str, float]
    categories: dict[str, list[str]]
    record_count: int
    truncated: list[str] = field(default_factory=list)


def missing_rate(c: Column) -> Column:
    """Per cent of rows without a value, blank ones included; 0 where there are no rows."""
    return F.coalesce(ratio(F.count("*") - F.count(blank_to_null(c.cast("string"))), F.count("*")), F.lit(0.0))


def missing_rates(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``coluna, taxa`` of each group, all columns in one aggregate."""
    one = df.groupBy(*by).agg(*(missing_rate(F.col(c)).alias(f"__rate_{c}") for c in columns))
    pairs = ", ".join(f"'{c}', `__rate_{c}`" for c in columns)
    return one.selectExpr(*(f"`{c}`" for c in by), f"stack({len(columns)}, {pairs}) as (coluna, taxa)")


def observe(raw: DataFrame, year: int, settings: Settings | None = None) -> Observation:
    """Kinds, missing rates and categories of all read columns, in one aggregate over the whole file.

    A column's distinct values are gathered up to one above the cap (by a bounded top-k of the grouped
    values), so nothing of unbounded size reaches the driver.
    """
    settings = settings or Settings()
    columns = [c for c in ALLOWED_COLUMNS if c in raw.columns]
    sums = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        x = blank_to_null(F.col(c))
        sums += [F.count(x).alias(f"p{i}"), missing_rate(F.col(c)).alias(f"m{i}"), F.count_if(x.rlike(NUMBER)).alias(f"w{i}"), F.count_if(parse_date(F.col(c)).isNotNull()).alias(f"d{i}")]
    r = raw.agg(*sums).first()
    kinds, rates = {}, {}
    for i, c in enumerate(columns):
        present = r[f"p{i}"]
        rates[c] = round(r[f"m{i}"], 4)
        kinds[c] = "vazio" if not present else "inteiro" if r[f"w{i}"] >= AGREEMENT * present else "data" if r[f"d{i}"] >= AGREEMENT * present else "texto"
    coded = [c for c in CODE_LABELS if c in columns]
    categories, truncated = {}, []
    if coded:
        pairs = ", ".join(f"'{c}', `{c}`" for c in coded)
        long = raw.selectExpr(f"stack({len(coded)}, {pairs}) as (c, v)").select("c", blank_to_null(F.col("v")).alias("v")).where("v is not null").distinct()
        per = long.groupBy("c").agg(F.sort_array(F.slice(F.array_sort(F.collect_set("v")), 1, settings.drift_category_cap + 1)).alias("v"))
        for row in per.collect():  # a row per coded column, values up to the cap
            categories[row["c"]] = row["v"][: settings.drift_category_cap]
            if len(row["v"]) > settings.drift_category_cap:
                truncated.append(row["c"])
    return Observation(year, list(raw.columns), kinds, rates, categories, r["n"], sorted(truncated))


def finding(kind: str, severity: str, column: str | None, detail: str, year: int) -> dict:
    return {"kind": kind, "severity": severity, "column": column, "detail": detail, "year": year}


def detect(now: Observation, before: Observation | None, settings: Settings | None = None, unreadable: dict[str, int] | None = None) -> list[dict]:
    """Findings of eight kinds; those of severity ERROR stop a load unless they are accepted."""
    s = settings or Settings()
    out = []
    add = lambda *a: out.append(finding(*a, now.year))
    floors = set()
    if now.record_count >= s.drift_min_records:
        for c, most in s.drift_max_missing_pct.items():
            if now.missing_rate.get(c, 0) > most:
                floors.add(c)
                add("missing_rate_changes", "ERROR", c, f"{now.missing_rate[c]}% missing, {most}% allowed")
        for c, n in (unreadable or {}).items():
            if 100 * n / now.record_count > s.drift_unreadable_pct:
                add("unreadable_dates", "ERROR", c, f"{n} of {now.record_count} can't be read")
    for c in now.truncated:
        add("truncated_categories", "WARNING", c, f"more than {s.drift_category_cap} values")
    for c, values in now.categories.items():
        official = {str(k) for k in CODE_LABELS.get(c, {})}
        known = official | set(before.categories.get(c, []) if before else [])
        if new := sorted(set(values) - known):
            add("new_categories", "WARNING", c, ", ".join(new))
    if before is None:
        return out
    for c in sorted(set(now.raw_columns) - set(before.raw_columns)):
        add("new_columns", "WARNING", c, "not in the baseline")
    for c in sorted(set(before.raw_columns) - set(now.raw_columns)):
        add("missing_columns", "ERROR" if c in ALLOWED_COLUMNS else "WARNING", c, "in the baseline only")
    for c, kind in now.dtypes.items():
        old = before.dtypes.get(c)
        if old and old != kind and "vazio" not in (old, kind):
            add("dtype_changes", "ERROR", c, f"{old} became {kind}")
    for c, rate in now.missing_rate.items():
        old = before.missing_rate.get(c)
        if old is not None and c not in floors and abs(rate - old) >= s.drift_missing_rate_pp:
            add("missing_rate_changes", "WARNING", c, f"{old}% became {rate}%")
    if before.record_count:
        change = 100 * (now.record_count - before.record_count) / before.record_count
        if change <= -s.drift_drop_pct:
            add("record_count_changes", "ERROR", None, f"{change:.1f}%")
        elif change >= s.drift_growth_pct:
            add("record_count_changes", "WARNING", None, f"{change:.1f}%")
    return out


class SchemaDriftError(RuntimeError):
    """A load with findings of severity ERROR that were not accepted."""


def load_baseline(path: str) -> dict:
    """The baseline by year; an unreadable file counts as a first load."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return {int(k): v for k, v in found.items()}
    except (OSError, ValueError, AttributeError):
        return {}


#: What an entry of the baseline holds beside the observation: when it was taken, what waits since when, what was accepted when.
RECORD = ("captured_at", "pending_findings", "pending_since", "accepted_findings", "accepted_at")


def observation(entry: dict | None) -> Observation | None:
    """What a load is compared with: the observation of an entry, without its record."""
    return Observation(**{k: v for k, v in entry.items() if k not in (*RECORD, "pending")}) if entry else None


def entry_after(o: Observation, old: dict | None, found: list[dict], accepted: bool, now: str) -> dict:
    """A year's entry after a load.

    Findings that nobody accepted freeze the entry that is there, which tells what waits and since when, so the
    next load meets the same findings; on a first load they wait beside the new observation.
    """
    waits = {"pending_findings": found} if found and not accepted else {}
    if waits and old is not None:
        return old | waits | {"pending_since": old.get("pending_since", now)}
    return o.__dict__ | {"captured_at": now} | (waits and waits | {"pending_since": now}) | ({"accepted_findings": found, "accepted_at": now} if found and accepted else {})


def next_baseline(baseline: dict, observations: list[Observation], findings: list[dict], accepted: bool, now: str | None = None) -> dict:
    """The baseline after a load; years that were not loaded keep their entries."""
    now = now or datetime.datetime.now(datetime.UTC).isoformat()
    return baseline | {o.year: entry_after(o, baseline.get(o.year), [f for f in findings if f["year"] == o.year], accepted, now) for o in observations}


def save_baseline(path: str, baseline: dict) -> None:
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump({str(k): v for k, v in sorted(baseline.items())}, f, ensure_ascii=False, indent=1)
    os.replace(part, path)


def gate(findings: list[dict], accepted: bool) -> None:
    """Runs before anything is written."""
    errors = [f for f in findings if f["severity"] == "ERROR"]
    if errors and not accepted:
        raise SchemaDriftError("; ".join(f"{f['kind']} {f['column'] or ''}: {f['detail']}" for f in errors))
