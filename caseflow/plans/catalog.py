"""The closed catalogue of tools, with parameter ranges, error envelopes and an audit trail."""

from __future__ import annotations

import contextlib
import datetime
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.publish import scrub
from caseflow.operators import metrics as M
from caseflow.operators.filters import Analysis, AnalyticFilters, InvalidFilterError
from caseflow.operators.reliability import reliability, small_cell
from caseflow.sources.sinks import append_json


@dataclass(frozen=True)
class Tool:
    name: str
    category: str
    run: Callable[..., dict]
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)


def metric(f: Callable[..., M.Metric]) -> Callable[..., dict]:
    def run(a: Analysis, window_days: int | None = None) -> dict:
        return reliability(small_cell(f(a, window_days).to_dict(), a.settings.min_cell_size), a.settings.stable_events)

    return run


WINDOW = {"window_days": (7, 365)}
TOOLS = {
    t.name: t
    for t in (
        Tool("get_case_growth_rate", "indicator", metric(M.case_growth_rate), WINDOW),
        Tool("get_mortality_rate", "indicator", metric(M.mortality_rate), WINDOW),
        Tool("get_icu_metrics", "indicator", metric(M.icu_metrics), WINDOW),
        Tool("get_icu_bed_occupancy", "indicator", metric(M.icu_bed_occupancy_rate), WINDOW),
        Tool("get_vaccination_metrics", "indicator", metric(M.vaccination_metrics), WINDOW),
        Tool("get_incidence_rate", "indicator", metric(M.incidence_rate), WINDOW),
        Tool("get_seasonal_baseline", "indicator", metric(M.seasonal_baseline), WINDOW),
        Tool("get_notification_completeness", "diagnostic", lambda a: M.notification_delay_profile(a)),
        Tool("get_duplicate_sensitivity", "diagnostic", lambda a, window_days=None: M.duplicate_sensitivity(a, window_days), WINDOW),
        Tool("get_daily_cases", "series", lambda a, window_days=30: M.daily_cases(a, window_days), {"window_days": (7, 180)}),
        Tool("get_monthly_cases", "series", lambda a, window_months=12: M.monthly_cases(a, window_months), {"window_months": (3, 36)}),
    )
}


class Audit:
    """Events of one run, in order, as lines of JSON and for the audit table."""

    def __init__(self, path: str | None = None, run_id: str | None = None):
        self.path, self.run_id, self.events = path, run_id or uuid.uuid4().hex, []

    def record(self, status: str, tool: str | None = None, node: str | None = None, parameters: dict | None = None, duration_ms: float = 0.0, summary: str = "", error: str | None = None) -> None:
        event = {
            "run_id": self.run_id, "seq": len(self.events) + 1, "timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "node": node, "tool": tool, "parameters": str(scrub(parameters or {})),
            "status": status, "duration_ms": round(duration_ms, 2), "result_summary": scrub(summary), "source": None, "error": scrub(error),
        }
        self.events.append(event)
        if self.path:
            append_json(self.path, event)

    @contextlib.contextmanager
    def step(self, node: str, **parameters):
        """Times a step and records how it ended; ``told["summary"]`` goes into its event, ``told["degraded"]`` marks it."""
        began, told = time.perf_counter(), {}
        took = lambda: (time.perf_counter() - began) * 1000
        try:
            yield told
        except Exception as e:
            self.record("error", node=node, parameters=parameters, duration_ms=took(), error=f"{type(e).__name__}: {e}")
            raise
        self.record("degraded" if told.get("degraded") else "ok", node=node, parameters=parameters, duration_ms=took(), summary=told.get("summary", ""))

    def summary(self) -> dict:
        by: dict[str, int] = {}
        for e in self.events:
            by[e["status"]] = by.get(e["status"], 0) + 1
        return {"run_id": self.run_id, "events": len(self.events), "by_status": by, "duration_ms": round(sum(e["duration_ms"] for e in self.events), 2)}


def planned(mandatory: list[str], proposed: list[str]) -> list[str]:
    """The mandatory tools, then the proposed ones that are known and not yet there, in order."""
    return list(dict.fromkeys([*mandatory, *(p for p in proposed if p in TOOLS)]))


def within_budget(proposals: list[tuple[str, dict]], most: int) -> list[tuple[str, dict, bool]]:
    """Which of the proposed calls are made: the first ``most`` of known tools; the others are told as refused."""
    out, left = [], most
    for name, parameters in proposals:
        accepted = name in TOOLS and left > 0
        left -= accepted
        out.append((name, parameters, accepted))
    return out


def audit_by(events: DataFrame, *keys: str) -> DataFrame:
    """Events of the audit table by tool, status or node: how many, and how long they took."""
    took = F.col("duration_ms")
    return events.groupBy(*keys).agg(F.count("*").alias("eventos"), F.avg(took).alias("duracao_media_ms"), F.max(took).alias("duracao_maxima_ms"))


def call_tool(name: str, a: Analysis, parameters: dict | None = None, audit: Audit | None = None) -> dict:
    """Runs a tool by name.  Unknown names, parameters out of range and failures come back as envelopes."""
    parameters, audit, began = dict(parameters or {}), audit or Audit(), time.perf_counter()
    done = lambda out, status, error=None: (audit.record(status, name, parameters=parameters, duration_ms=(time.perf_counter() - began) * 1000, error=error), out)[1]
    tool = TOOLS.get(name)
    if tool is None:
        return done({"ok": False, "error": "unknown_tool", "detail": name}, "error", "unknown_tool")
    try:
        wanted = {k: parameters.pop(k) for k in ("uf", "classification") if k in parameters}
        scoped = a.filtered(AnalyticFilters(**wanted, domain=a.filters.domain)) if wanted else a
        for key, value in parameters.items():
            if key not in tool.ranges or isinstance(value, bool) or not isinstance(value, int) or not tool.ranges[key][0] <= value <= tool.ranges[key][1]:
                raise InvalidFilterError(f"{key}={value!r} is not allowed for {name}")
    except (InvalidFilterError, TypeError) as e:
        return done({"ok": False, "error": "invalid_parameters", "detail": str(e)}, "error", str(e))
    a.view.sparkSession.sparkContext.setJobGroup(audit.run_id, name)
    try:
        result = tool.run(scoped, **parameters)
    except Exception as e:  # a failed tool must not end a report
        return done({"ok": False, "error": "execution_failed", "detail": type(e).__name__}, "error", type(e).__name__)
    return done({"ok": True, "tool": name, "result": result}, "degraded" if "value" in result and result["value"] is None else "ok")
