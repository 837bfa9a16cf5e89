"""A report from the catalogue's tools: Markdown and a plain page, with bars instead of pictures."""

from __future__ import annotations

import datetime
import html
import json
import os

from caseflow.operators.filters import Analysis
from caseflow.operators.reliability import compare_runs, evaluate_alerts
from caseflow.plans.catalog import TOOLS, Audit, call_tool
from caseflow.plans.definitions import DEFINITIONS
from caseflow.plans.narrative import bar_shares, comparison, headline, local_number, paragraphs, points, quality_section
from caseflow.sources.sinks import append_json


def cell(text) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def build(a: Analysis, audit: Audit | None = None, previous: dict | None = None, quality: dict | None = None) -> dict:
    """Runs every tool once and gathers indicators, diagnostics, series, alerts and the change since the run before.

    ``quality`` is the load's report of cleaning, if its section is wanted.
    """
    audit = audit or Audit()
    results = {name: call_tool(name, a, {}, audit) for name in TOOLS}
    indicators = {r["result"]["metric"]: r["result"] for n, r in results.items() if r["ok"] and TOOLS[n].category == "indicator"}
    diagnostics = results["get_notification_completeness"].get("result")
    alerts = evaluate_alerts(indicators, diagnostics, a.settings)
    entry = {"run_id": audit.run_id, "gerado_em": datetime.datetime.now(datetime.UTC).isoformat(), **a.filters.to_dict(), "data_corte_analitica": a.cutoff.isoformat(), "indicadores": {k: m["value"] for k, m in indicators.items()}, "nivel_de_alerta": alerts["nivel"], "alertas_disparados": [x["regra"] for x in alerts["disparados"]]}
    return {"run_id": audit.run_id, "cutoff": a.cutoff.isoformat(), "indicators": indicators, "results": results, "alerts": alerts, "entry": entry, "quality": quality, "change": compare_runs(entry, previous), "audit": audit.summary()}


def markdown(report: dict) -> str:
    out = [f"# Vigilancia: corte {report['cutoff']}", "", headline(report["indicators"], report["alerts"]["nivel"]), "", f"Nivel de alerta: **{report['alerts']['nivel']}**", ""]
    out += [f"- {kind}: {cell(text)}" for kind, text in points(report["indicators"])]
    out += ["", "| Indicador | Valor | Numerador | Denominador | Comparacao | Observacao |", "|---|---|---|---|---|---|"]
    for key, m in report["indicators"].items():
        name = DEFINITIONS[key].name if key in DEFINITIONS else key
        note = m.get("unavailable_reason") or m.get("reliability_warning") or ""
        out.append(f"| {cell(name)} | {local_number(m['value'])} | {local_number(m['numerator'])} | {local_number(m['denominator'])} | {cell(comparison(key, m, report['change']))} | {cell(note)} |")
    for title, lines in paragraphs(report["indicators"]):
        out += ["", f"## {title}", "", *map(cell, lines)]
    out += ["", quality_section(report["quality"]).rstrip()] if report.get("quality") else []
    out += ["", "## Series", ""]
    for name in ("get_daily_cases", "get_monthly_cases"):
        r = report["results"][name]
        if r["ok"]:
            out.append(f"- {name}: " + ", ".join(f"{k} {local_number(v)}" for k, v in r["result"]["resumo"].items()))
    out += ["", "## Mudanca desde a execucao anterior", ""]
    out += [f"- {k}: {local_number(v['anterior'])} -> {local_number(v['atual'])}" for k, v in report["change"]["variacao"].items()] or ["- primeira execucao"]
    return "\n".join(out) + "\n"


def page(report: dict) -> str:
    points = report["results"]["get_daily_cases"].get("result", {}).get("pontos", [])
    most = max((p["casos"] for p in points), default=0) or 1
    bars = "".join(f'<rect x="{6 * i}" y="{100 - 100 * p["casos"] / most:.1f}" width="5" height="{100 * p["casos"] / most:.1f}"><title>{p["data"]}: {p["casos"]}</title></rect>' for i, p in enumerate(points))
    shares = bar_shares(report["indicators"])
    width = lambda k: f'<meter max="100" value="{shares[k].get("records_used", 0)}"></meter>'
    rows = "".join(f"<tr><td>{html.escape(k)}</td><td>{local_number(m['value'])}</td><td>{html.escape(comparison(k, m, report['change']))}</td><td>{width(k)}</td></tr>" for k, m in report["indicators"].items())
    return f'<!doctype html><meta charset="utf-8"><title>{report["cutoff"]}</title><h1>{html.escape(headline(report["indicators"], report["alerts"]["nivel"]))}</h1><table>{rows}</table><svg viewBox="0 0 {6 * len(points)} 100" height="160">{bars}</svg>'


def write(report: dict, folder: str) -> dict[str, str]:
    os.makedirs(folder, exist_ok=True)
    files = {"md": markdown(report), "html": page(report), "json": json.dumps(report, ensure_ascii=False, default=str, indent=1)}
    out = {}
    for kind, text in files.items():
        out[kind] = os.path.join(folder, f"{report['run_id']}.{kind}")
        with open(out[kind], "w", encoding="utf-8") as f:
            f.write(text)
    append_json(os.path.join(folder, "history.jsonl"), report["entry"])
    return out
