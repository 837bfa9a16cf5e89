"""What a report says about its numbers: scales, headline, points, comparisons, paragraphs, quality of the load."""

from __future__ import annotations

#: Changes of cases within this many per cent are called stable.
STABLE_PCT = 8
#: Excesses from this many per cent on are called out of the season's pattern.
SEASON_PCT = 20
MOST_POINTS, MOST_CONTEXT = 5, 1
#: Indicators that worsen as they rise.
WORSE_UP = ("case_growth_rate", "mortality_rate", "icu_admission_rate", "icu_bed_occupancy_rate", "incidence_rate", "seasonal_excess")
COUNTED = ("numerator", "denominator", "records_used")
#: Columns whose ignored codes are told in the quality section.
IGNORED_TOLD = ("UTI", "EVOLUCAO", "VACINA_COV", "VACINA", "HOSPITAL")


def local_number(x, digits: int = 2) -> str:
    """1234.5 as ``1.234,50``."""
    if x is None:
        return "n/d"
    text = f"{x:,.{digits}f}" if isinstance(x, float) else f"{x:,}"
    return text.replace(",", "\0").replace(".", ",").replace("\0", ".")


def bar_shares(indicators: dict[str, dict]) -> dict[str, dict[str, float]]:
    """For each indicator, the length of its bars in per cent of the greatest absolute value of the column."""
    most = {c: max((abs(m[c]) for m in indicators.values() if m.get(c) is not None), default=0) for c in COUNTED}
    return {k: {c: round(100 * abs(m[c]) / most[c], 2) for c in COUNTED if m.get(c) is not None and most[c]} for k, m in indicators.items()}


def headline(indicators: dict[str, dict], level: str = "normal") -> str:
    """One sentence from growth, fatality and the level of alert."""
    growth, deaths = (indicators.get(k, {}).get("value") for k in ("case_growth_rate", "mortality_rate"))
    if growth is None:
        cases = "Sem base para medir a variacao de casos"
    elif abs(growth) <= STABLE_PCT:
        cases = "Casos estaveis frente a janela anterior"
    else:
        cases = f"Casos {'avancam' if growth > 0 else 'recuam'} {local_number(abs(growth))}% frente a janela anterior"
    fatal = "letalidade nao calculavel" if deaths is None else f"letalidade de {local_number(deaths)}% entre casos encerrados"
    return f"{cases}; {fatal}" + (f"; nivel {level.upper()}" if level != "normal" else "") + "."


#: Names of indicators in points, in the order in which they are told, and what must be said with them.
POINTS = {
    "case_growth_rate": ("Variacao de casos", "entre duas janelas consecutivas"),
    "mortality_rate": ("Letalidade", "entre casos encerrados"),
    "icu_admission_rate": ("Admissao em UTI", "nao e ocupacao de leitos"),
    "icu_bed_occupancy_rate": ("Ocupacao de UTI", "um piso: outros pacientes nao sao contados"),
    "vaccination_coverage_among_cases": ("Vacinacao declarada", "entre os casos, nao na populacao"),
}


def points(indicators: dict[str, dict], articles: list[dict] | None = None) -> list[tuple[str, str]]:
    """At most five points from data and one from context; indicators without a value are not told."""
    told = [(k, indicators[k]) for k in POINTS if indicators.get(k, {}).get("value") is not None]
    data = [("DADO", f"{POINTS[k][0]}: {local_number(m['value'])}% ({local_number(m.get('numerator'))} de {local_number(m.get('denominator'))}; {POINTS[k][1]}).") for k, m in told]
    context = [("CONTEXTO", f"{len(articles)} noticias recentes; a primeira: {articles[0].get('title', '')[:90]}.")] if articles else []
    return data[:MOST_POINTS] + context[:MOST_CONTEXT]


def trend(change: float, worse_up: bool) -> tuple[str, str]:
    """An arrow, and whether the way it points is ``bad``, ``good`` or ``neutral``."""
    if abs(change) < 1e-9:
        return "→", "neutral"
    return "▲" if change > 0 else "▼", "bad" if (change > 0) == worse_up else "good"


def comparison(key: str, m: dict, change: dict | None = None) -> str:
    """What a card compares its number with: the run before, else the indicator's own base, else its counts, else the period."""
    moved = ((change or {}).get("variacao") or {}).get(key, {}).get("variacao")
    if (change or {}).get("execucao_anterior") and moved is not None and abs(moved) > 1e-9:
        return f"{trend(moved, key in WORSE_UP)[0]} {local_number(abs(moved))} p.p. desde a execucao anterior"
    parts = m.get("components") or {}
    own = {"case_growth_rate": ("anterior", "{} vs {} casos na janela anterior"), "seasonal_excess": ("mediana", "{} casos vs mediana de {}")}
    if key in own and None not in (parts.get("atual"), parts.get(own[key][0])):
        text = own[key][1].format(local_number(parts["atual"]), local_number(parts[own[key][0]]))
        return f"{trend(m.get('value') or 0, True)[0]} {text}" if key == "case_growth_rate" else text
    if None not in (m.get("numerator"), m.get("denominator")):
        return f"{local_number(m['numerator'])} em {local_number(m['denominator'])}"
    period = m.get("period") or {}
    return f"{period.get('inicio', '')} a {period.get('fim', '')}"


def paragraphs(indicators: dict[str, dict], articles: list[dict] | None = None) -> list[tuple[str, list[str]]]:
    """Sections of template text: every number is one of the report's, and what has no value says why."""
    def said(key: str, text) -> list[str]:
        m = indicators.get(key)
        if m is None:
            return []
        return [text(m) if m.get("value") is not None else f"{key}: sem valor ({m.get('unavailable_reason')})."]

    def growth(m):
        c = m["components"]
        return f"Houve {'aumento' if m['value'] > 0 else 'reducao' if m['value'] < 0 else 'estabilidade'} de {local_number(abs(m['value']))}%: {local_number(c.get('atual'))} casos contra {local_number(c.get('anterior'))}."

    def season(m):
        way = "na mediana" if m["value"] == 0 else f"{local_number(abs(m['value']))}% {'acima' if m['value'] > 0 else 'abaixo'} da mediana"
        return f"A janela esta {way} sazonal, {'fora do padrao da estacao' if abs(m['value']) >= SEASON_PCT else 'como se espera da estacao'}."

    rate = lambda name: lambda m: f"{name}: {local_number(m['value'])}% ({local_number(m.get('numerator'))} de {local_number(m.get('denominator'))})."
    news = [f"{len(articles)} noticias recentes acompanham o periodo; nao provam causa."] if articles else ["Sem noticias recentes."]
    return [
        ("Panorama", said("case_growth_rate", growth) + said("incidence_rate", lambda m: f"Incidencia de {local_number(m['value'])} por 100 mil habitantes.") + said("seasonal_excess", season)),
        ("Severidade", said("mortality_rate", rate("Letalidade")) + said("icu_admission_rate", rate("Admissao em UTI")) + said("icu_bed_occupancy_rate", rate("Ocupacao de UTI (piso)"))),
        ("Vacinacao declarada", said("vaccination_coverage_among_cases", rate("Cobertura entre os casos"))),
        ("Contexto", news),
    ]


def quality_section(report: dict, ignored: dict[str, int] | None = None) -> str:
    """Markdown of what cleaning counted in a load: rows, changes by code, flags, and ignored codes above zero."""
    rows = report["rows_kept"]
    out = ["## Qualidade da carga", "", f"- lidas {local_number(report['rows_read'])}, descartadas {local_number(report['rows_dropped'])}, ajustadas {local_number(report['rows_adjusted'])}, identicas {local_number(report['identical_rows'])} (contadas, nao removidas)"]
    tables = {
        "Contagem": {k: n for k, n in sorted(report["observed"].items()) if n},
        "Flag": report["flags"],
        "Codigo 9": {k: ignored[k] for k in IGNORED_TOLD if (ignored or {}).get(k)},
    }
    for title, counts in tables.items():
        if counts:
            out += ["", f"| {title} | Registros | % |", "|---|---|---|", *(f"| {k} | {local_number(n)} | {local_number(100.0 * n / rows if rows else None)} |" for k, n in counts.items())]
    return "\n".join(out) + "\n"
