"""Indicators with their numerator, denominator, period and, where there is none, the reason.

Each indicator has a DataFrame of counts made in one scan (``*_counts``) and an envelope around
it.  A value that can't be computed is null with a reason, never zero.
"""

from __future__ import annotations

import datetime
import statistics
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.dates import month_distance
from caseflow.operators import stays as S
from caseflow.operators.filters import Analysis
from caseflow.operators.series import daily_counts, monthly_counts
from caseflow.schema import BED_TYPES_OF_CENSUS

DAY = datetime.timedelta(days=1)


@dataclass
class Metric:
    metric: str
    value: float | None
    numerator: int | None
    denominator: int | None
    period: dict
    filters: dict
    components: dict = field(default_factory=dict)
    unavailable_reason: str | None = None
    records_used: int | None = None

    def to_dict(self) -> dict:
        return self.__dict__ | {"components": dict(self.components)}


def pct(n: float, d: float, factor: float = 100.0, digits: int = 2) -> float | None:
    return round(n / d * factor, digits) if d else None


def period_of(first: datetime.date, last: datetime.date) -> dict:
    return {"inicio": first.isoformat(), "fim": last.isoformat()}


def inside(c: str, first: datetime.date, last: datetime.date) -> Column:
    return F.col(c).between(F.lit(first), F.lit(last))


# Growth between two windows of the same maturity


def growth_counts(rows: DataFrame, cutoff: datetime.date, window: int, lag: int) -> DataFrame:
    """Cases of a window and of the one before; matured: entered within ``lag`` days of the window's own end."""
    first = cutoff - (window - 1) * DAY
    before_last, before_first = first - DAY, first - window * DAY
    now, before = inside("data_sintomas", first, cutoff), inside("data_sintomas", before_first, before_last)
    entered = lambda until: F.coalesce(F.col("data_digitacao") <= F.lit(until), F.lit(False))
    rows = rows.where(inside("data_sintomas", before_first, cutoff))
    return rows.agg(
        F.count_if(now).alias("atual_bruto"),
        F.count_if(before).alias("anterior_bruto"),
        F.count_if(now & entered(cutoff + lag * DAY)).alias("atual"),
        F.count_if(before & entered(before_last + lag * DAY)).alias("anterior"),
    )


def case_growth_rate(a: Analysis, window: int | None = None) -> Metric:
    window = a.settings.growth_window_days if window is None else window
    r = growth_counts(a.rows(), a.cutoff, window, a.settings.reporting_lag_days).first()
    out = Metric(
        "case_growth_rate", None, r["atual"] - r["anterior"], r["anterior"], period_of(a.cutoff - (2 * window - 1) * DAY, a.cutoff), a.filters.to_dict(),
        r.asDict() | {"variacao_bruta_pct": pct(r["atual_bruto"] - r["anterior_bruto"], r["anterior_bruto"])}, records_used=r["atual"] + r["anterior"],
    )
    if r["anterior"]:
        out.value = pct(r["atual"] - r["anterior"], r["anterior"])
    else:
        out.unavailable_reason = "no case in the previous window: the change has no base"
    return out


# Fatality among closed cases


def fatality_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("casos"),
        F.count_if("caso_encerrado").alias("encerrados"),
        F.count_if("eh_obito_srag").alias("obitos"),
        F.count_if(F.col("EVOLUCAO") == 3).alias("obitos_outras_causas"),
        F.count_if(F.col("EVOLUCAO") == 9).alias("evolucao_ignorada"),
        F.count_if(F.col("EVOLUCAO").isNull()).alias("evolucao_ausente"),
    )


def maturity_percentile(rows: DataFrame, p: float) -> DataFrame:
    closed = rows.where("caso_encerrado and data_encerramento is not null and data_encerramento >= data_sintomas")
    return closed.agg(F.percentile(F.datediff("data_encerramento", "data_sintomas"), F.lit(p)).alias("dias"))


def outcome_maturity(a: Analysis) -> int:
    most = a.settings.outcome_maturity_cap_days
    days = maturity_percentile(a.rows(), a.settings.outcome_maturity_percentile).first()["dias"]
    return most if days is None else max(1, min(round(days), most))


def mortality_rate(a: Analysis, window: int | None = None) -> Metric:
    first, last = a.window(window)
    r = fatality_counts(a.between(first, last)).first()
    shift = outcome_maturity(a) * DAY
    m = fatality_counts(a.between(first - shift, last - shift)).first()
    components = r.asDict() | {
        "percentual_em_aberto": pct(r["evolucao_ausente"], r["casos"]),
        "percentual_encerrado": pct(r["encerrados"], r["casos"]),
        "coorte_madura": {
            "dias_de_deslocamento": shift.days, "casos": m["casos"], "encerrados": m["encerrados"], "obitos": m["obitos"],
            "percentual_encerrado": pct(m["encerrados"], m["casos"]), "letalidade": pct(m["obitos"], m["encerrados"]),
        },
    }
    out = Metric("mortality_rate", pct(r["obitos"], r["encerrados"]), r["obitos"], r["encerrados"], period_of(first, last), a.filters.to_dict(), components, records_used=r["casos"])
    if out.value is None:
        out.unavailable_reason = "no closed case in the period: there is no denominator"
    return out


# Admission to intensive care


def admission_counts(rows: DataFrame) -> DataFrame:
    """Only those who declared no hospital stay leave the denominator; an unknown stay is no negative."""
    admitted = F.col("foi_hospitalizado") | ~F.col("hospitalizacao_informada")
    return rows.agg(
        F.count_if(admitted).alias("internados"),
        F.count_if(admitted & F.col("uti_informado")).alias("uti_informado"),
        F.count_if(admitted & F.col("teve_admissao_uti")).alias("admitidos_uti"),
        F.count_if(admitted & (F.col("UTI") == 9)).alias("uti_ignorado"),
        F.count_if(admitted & F.col("UTI").isNull()).alias("uti_ausente"),
        F.count_if(F.col("uti_informado") & F.col("HOSPITAL").isNull()).alias("uti_hospital_ausente"),
        F.count_if(F.col("uti_informado") & (F.col("HOSPITAL") == 9)).alias("uti_hospital_ignorado"),
        F.count_if(F.col("teve_admissao_uti") & (F.col("HOSPITAL") == 2)).alias("uti_hospital_negado"),
    )


def largest(points: list) -> dict | None:
    """The point of most patients; the earliest of equals."""
    best = max(points, key=lambda p: (p["pacientes"], -p["dia"].toordinal()), default=None)
    return None if best is None else {"data": best["dia"].isoformat(), "pacientes": best["pacientes"], "percentual_imputado": pct(best["imputados"], best["pacientes"])}


def icu_metrics(a: Analysis, window: int | None = None) -> Metric:
    first, last = a.window(window)
    r = admission_counts(a.between(first, last)).first()
    cap = S.stay_cap(a)
    points = S.census(a.rows(), cap["dias"], first, last).orderBy("dia").collect()  # a row per day of the window
    mature = last - cap["dias"] * DAY
    c = S.completeness(a.rows(), cap["dias"], first, last).first()
    components = r.asDict() | {
        "teto_de_permanencia": cap,
        "censo_diario": [{"data": p["dia"].isoformat(), "pacientes_em_uti": p["pacientes"], "imputados": p["imputados"], "percentual_imputado": pct(p["imputados"], p["pacientes"])} for p in points],
        "censo_diario_pico": largest([p for p in points if p["dia"] <= mature]),
        "censo_diario_pico_apurado_ate": mature.isoformat(),
        "censo_diario_maximo_bruto": largest(points),
        "completude": c.asDict() | {"percentual_com_saida_registrada": pct(c["saida_registrada"], c["estadias"]), "percentual_em_aberto": pct(c["em_aberto"], c["estadias"])},
    }
    out = Metric("icu_admission_rate", pct(r["admitidos_uti"], r["uti_informado"]), r["admitidos_uti"], r["uti_informado"], period_of(first, last), a.filters.to_dict(), components, records_used=r["internados"])
    if out.value is None:
        out.unavailable_reason = "no hospital case of the period tells whether it was in intensive care"
    return out


# Occupancy against an external capacity


def capacity_by_competence(capacity: DataFrame, uf: str | None, types: tuple[str, ...] = BED_TYPES_OF_CENSUS) -> DataFrame:
    rows = capacity.where(F.col("tipo_leito").isin(*types))
    rows = rows.where(F.col("uf") == uf) if uf else rows
    return rows.groupBy("competencia").agg(
        F.sum("leitos_existentes").alias("existentes"),
        F.sum("leitos_sus").alias("sus"),
        F.count_distinct("uf").alias("ufs"),
        F.min("fonte").alias("fonte"),
        F.min("url").alias("url"),
        F.max("data_extracao").alias("data_extracao"),
    )


def nearest_competence(by_competence: DataFrame, cutoff: datetime.date, needed: int) -> DataFrame:
    """The covered month nearest to the cutoff; the earlier of equals."""
    far = month_distance(F.col("competencia"), F.lit(cutoff))
    return by_competence.where(F.col("ufs") >= needed).withColumn("defasagem", far).orderBy("defasagem", "competencia").limit(1)


def icu_capacity(a: Analysis) -> tuple[dict | None, str | None]:
    """The capacity, or the first of: no reference, too few states, too far in time, no beds."""
    needed = 1 if a.filters.uf else a.settings.required_coverage
    grouped = capacity_by_competence(a.references["capacity"], a.filters.uf)
    best = grouped.agg(F.max("ufs")).first()[0]
    if best is None:
        return None, "no capacity reference for this scope"
    if best < needed:
        return None, f"capacity reference covers {best} of {needed} states"
    row = nearest_competence(grouped, a.cutoff, needed).first()
    if row["defasagem"] > a.settings.icu_capacity_max_lag_months:
        return None, f"nearest capacity {row['competencia']} is {row['defasagem']} months away"
    if not row["existentes"] or row["existentes"] <= 0:
        return None, f"capacity of {row['competencia']} has no beds"
    return row.asDict(), None


def icu_bed_occupancy_rate(a: Analysis, window: int | None = None) -> Metric:
    window = a.settings.growth_window_days if window is None else window
    cap = S.stay_cap(a)["dias"]
    last = a.cutoff - cap * DAY
    first = last - (window - 1) * DAY
    out = Metric("icu_bed_occupancy_rate", None, None, None, period_of(first, last), a.filters.to_dict())
    capacity, out.unavailable_reason = icu_capacity(a)
    if capacity is None:
        return out
    # Ends are imputed as for the whole window up to the cutoff; the published days are its mature part.
    points = [p for p in S.census(a.rows(), cap, first, a.cutoff).orderBy("dia").collect() if p["dia"] <= last]
    beds, top = capacity["existentes"], largest(points)
    daily = [pct(p["pacientes"], beds) for p in points]
    out.denominator, out.numerator = beds, top and top["pacientes"]
    out.components = {"capacidade": capacity, "pico": top, "ocupacao_media": round(statistics.fmean(daily), 2) if daily else None, "ocupacao_minima": min(daily, default=None), "dias": len(daily)}
    if top is None:
        out.unavailable_reason = "no day of the mature window can be counted"
    else:
        out.value = pct(top["pacientes"], beds)
    return out


# Vaccination


def vaccination_counts(rows: DataFrame, *by: str) -> DataFrame:
    out = [F.count("*").alias("casos")]
    for name, code, known, yes in (("covid", "VACINA_COV", "vacina_covid_informada", "vacinado_covid"), ("influenza", "VACINA", "vacina_influenza_informada", "vacinado_influenza")):
        out += [F.count_if(known).alias(f"{name}_informada"), F.count_if(yes).alias(f"{name}_sim"), F.count_if(F.col(code) == 9).alias(f"{name}_ignorada"), F.count_if(F.col(code).isNull()).alias(f"{name}_ausente")]
    return rows.groupBy(*by).agg(*out)


def vaccination_metrics(a: Analysis, window: int | None = None) -> Metric:
    first, last = a.window(window)
    r = vaccination_counts(a.between(first, last)).first()
    components = r.asDict()
    for name in ("covid", "influenza"):
        components[f"{name}_cobertura_pct"] = pct(r[f"{name}_sim"], r[f"{name}_informada"])
        components[f"{name}_completude_pct"] = pct(r[f"{name}_informada"], r["casos"])
    components["cobertura_populacional"] = population_coverage(a, last.year) if "vaccination" in a.references else None
    out = Metric("vaccination_coverage_among_cases", components["covid_cobertura_pct"], r["covid_sim"], r["covid_informada"], period_of(first, last), a.filters.to_dict(), components, records_used=r["casos"])
    if out.value is None:
        out.unavailable_reason = "no case of the period tells whether it was vaccinated"
    return out


def nearest_year(reference: DataFrame, year: int) -> DataFrame:
    """The year of a reference nearest to the wanted one; the earlier of equals."""
    return reference.select("ano").distinct().orderBy(F.abs(F.col("ano") - year), "ano").limit(1)


def reference_population(population: DataFrame, uf: str | None, year: int) -> tuple[int | None, int | None]:
    chosen = nearest_year(population, year).first()
    if chosen is None:
        return None, None
    rows = population.where(F.col("ano") == chosen["ano"])
    rows = rows.where(F.col("uf") == uf) if uf else rows
    return rows.agg(F.sum("populacao")).first()[0], chosen["ano"]


def campaign_sums(vaccination: DataFrame) -> DataFrame:
    """Per campaign: doses, target, whether each row has a target, sources, states, whether the period is complete."""
    return vaccination.groupBy("campanha").agg(
        F.sum("doses_aplicadas").alias("doses"),
        F.sum("populacao_alvo").alias("alvo"),
        F.count_if(F.col("populacao_alvo").isNull()).alias("sem_alvo"),
        F.array_join(F.array_sort(F.collect_set("fonte")), "; ").alias("fontes"),
        F.count_distinct("uf").alias("ufs"),
        F.bool_and(F.coalesce("periodo_completo", F.lit(False))).alias("completo"),
    )


def population_coverage(a: Analysis, year: int) -> dict:
    """Doses over target, or over residents where a target is missing, per campaign."""
    reference = a.references["vaccination"]
    chosen = nearest_year(reference, year).first()
    if chosen is None:
        return {"value": None, "unavailable_reason": "no reference of applied doses"}
    rows = reference.where(F.col("ano") == chosen["ano"])
    rows = rows.where(F.col("uf") == a.filters.uf) if a.filters.uf else rows
    found = campaign_sums(rows).orderBy("campanha").collect()  # a row per campaign of a closed list
    if not found:
        return {"value": None, "ano": chosen["ano"], "unavailable_reason": "the reference does not cover this scope"}
    population = reference_population(a.references["population"], a.filters.uf, chosen["ano"])[0] if "population" in a.references else None
    out = {}
    for r in found:
        whole = r["alvo"] is not None and r["sem_alvo"] == 0
        denominator = r["alvo"] if whole else population
        reason = "the reference does not declare a complete period" if not r["completo"] else None if denominator else "neither a target nor a population"
        out[r["campanha"]] = {
            "value": None if reason else pct(r["doses"], denominator), "numerator": r["doses"], "denominator": None if reason else denominator, "denominador": "alvo" if whole else "populacao",
            "fontes": r["fontes"], "ufs": r["ufs"], "unavailable_reason": reason,
        }
    return {"ano": chosen["ano"], "campanhas": out}


# Incidence


def incidence_counts(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.agg(F.count_if(predicate).alias("casos"), F.count_if(F.col("uf_residencia").isNull()).alias("sem_residencia"))


def incidence_rate(a: Analysis, window: int | None = None) -> Metric:
    """By state of residence, as the population is one of residents."""
    first, last = a.window(window)
    r = incidence_counts(a.view.where(inside("data_sintomas", first, last)), a.filters.predicate("SG_UF")).first()
    population, year = reference_population(a.references["population"], a.filters.uf, last.year) if "population" in a.references else (None, None)
    out = Metric("incidence_rate", None, r["casos"], population, period_of(first, last), a.filters.to_dict(), {"sem_uf_de_residencia": r["sem_residencia"], "ano_da_populacao": year}, records_used=r["casos"])
    if population:
        out.value = pct(r["casos"], population, 100_000.0)
    else:
        out.unavailable_reason = "no population reference"
    return out


# Seasonal excess


def shift_year(d: datetime.date, years: int) -> datetime.date:
    try:
        return d.replace(year=d.year + years)
    except ValueError:
        return d.replace(year=d.year + years, day=28)


def baseline_counts(rows: DataFrame, first: datetime.date, last: datetime.date, years: list[int]) -> DataFrame:
    """One row: cases of the window, and of the same window of each year, in one scan."""
    spans = {y: (shift_year(first, y - last.year), shift_year(last, y - last.year)) for y in years}
    some = inside("data_sintomas", first, last)
    for a, b in spans.values():
        some = some | inside("data_sintomas", a, b)
    return rows.where(some).agg(F.count_if(inside("data_sintomas", first, last)).alias("atual"), *(F.count_if(inside("data_sintomas", a, b)).alias(f"ano_{y}") for y, (a, b) in spans.items()))


def seasonal_baseline(a: Analysis, window: int | None = None) -> Metric:
    """Against the median of the same calendar window of the years that have cases in it."""
    first, last = a.window(window)
    configured = sorted(set(a.settings.baseline_years) - set(a.settings.pandemic_years))
    r = baseline_counts(a.rows(), first, last, configured).first()
    counts = {y: r[f"ano_{y}"] for y in configured if r[f"ano_{y}"] and y < last.year}
    median = statistics.median(counts.values()) if counts else None
    components = {
        "atual": r["atual"], "casos_por_ano": counts, "mediana": median, "media": round(statistics.fmean(counts.values()), 1) if counts else None, "anos_ausentes": sorted(set(configured) - set(counts)),
        "anos_excluidos": sorted(set(a.settings.baseline_years) & set(a.settings.pandemic_years)), "razao": round(r["atual"] / median, 3) if median else None,
    }
    out = Metric("seasonal_excess", None, None, None, period_of(first, last), a.filters.to_dict(), components, records_used=r["atual"])
    if len(counts) < a.settings.baseline_min_years:
        out.unavailable_reason = f"{len(counts)} baseline years have cases; {a.settings.baseline_min_years} are needed"
    elif not median:
        out.unavailable_reason = "the median of the baseline is zero"
    else:
        out.value, out.numerator, out.denominator = pct(r["atual"] - median, median), r["atual"] - median, median
    return out


# Diagnostics


def delay_percentiles(rows: DataFrame) -> DataFrame:
    delay = F.datediff("data_digitacao", "data_sintomas")
    known = rows.where("data_digitacao is not null")
    p = F.percentile(delay, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    return known.agg(p.alias("p"), F.count("*").alias("registros")).select(F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p75"), F.get("p", F.lit(2)).alias("p90"), "registros")


def notification_delay_profile(a: Analysis) -> dict:
    r = delay_percentiles(a.between(a.cutoff - 365 * DAY, a.cutoff)).first()
    lag = a.settings.reporting_lag_days
    short = r["p75"] is not None and lag < r["p75"]
    return r.asDict() | {"corte_configurado_dias": lag, "corte_suficiente": not short, "alerta": f"the lag of {lag} days is below the observed 75th percentile {r['p75']}" if short else None}


def data_currency(a: Analysis, source: dict | None = None) -> dict:
    """Dates and lags; ``source`` is what the manifest of ingestion says of the raw files (``readers.source_update``)."""
    latest = a.view.where(F.col("data_sintomas") <= F.lit(a.today)).agg(F.max("data_sintomas")).first()[0]
    return {
        "hoje": a.today.isoformat(), "sintomas_mais_recentes": latest and latest.isoformat(), "digitacao_mais_recente": a.reference.isoformat(), "corte": a.cutoff.isoformat(),
        "defasagem_ate_a_digitacao": (a.today - a.reference).days, "defasagem_ate_o_corte": (a.today - a.cutoff).days,
        "fonte": source or {"disponivel": False},
    }


def sensitivity_counts(rows: DataFrame) -> DataFrame:
    """Two rows, all and distinct: each group of equal rows is counted once with its size."""
    measures = ("caso_encerrado", "eh_obito_srag", "uti_informado", "teve_admissao_uti", "vacina_covid_informada", "vacinado_covid")
    grouped = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    one = lambda weight, name: [F.lit(name).alias("base"), F.sum(weight).alias("casos"), *(F.sum(F.when(F.col(m), weight).otherwise(0)).alias(m) for m in measures)]
    sums = grouped.agg(F.struct(*one(F.col("__n"), "todas")).alias("a"), F.struct(*one(F.lit(1), "distintas")).alias("b"))
    return sums.select(F.explode(F.array("a", "b")).alias("x")).select("x.*")


def duplicate_sensitivity(a: Analysis, window: int | None = None) -> dict:
    first, last = a.window(window)
    rows = {r["base"]: r for r in sensitivity_counts(a.between(first, last).drop("ajustes_aplicados")).collect()}
    every, once = rows["todas"], rows["distintas"]
    pairs = {"mortality_rate": ("eh_obito_srag", "caso_encerrado"), "icu_admission_rate": ("teve_admissao_uti", "uti_informado"), "vaccination_coverage_among_cases": ("vacinado_covid", "vacina_covid_informada")}
    out = {}
    for name, (n, d) in pairs.items():
        x, y = pct(every[n] or 0, every[d] or 0), pct(once[n] or 0, once[d] or 0)
        out[name] = {"publicado": x, "deduplicado": y, "diferenca_pp": None if x is None or y is None else round(y - x, 2)}
    gaps = [abs(v["diferenca_pp"]) for v in out.values() if v["diferenca_pp"] is not None]
    return {"casos": every["casos"], "casos_distintos": once["casos"], "indicadores": out, "material": bool(gaps) and max(gaps) >= a.settings.materiality_pp}


def daily_cases(a: Analysis, window: int = 30) -> dict:
    first, last = a.window(window)
    points = daily_counts(a.rows(), "data_sintomas", first, last).orderBy("dia").collect()
    return {"pontos": [{"data": p["dia"].isoformat(), "casos": p["casos"]} for p in points], "resumo": series_summary([p["casos"] for p in points])}


def monthly_cases(a: Analysis, months: int = 12) -> dict:
    points = monthly_counts(a.rows(), "data_sintomas", a.cutoff, months).orderBy("mes").collect()
    return {"pontos": [{"mes": p["mes"].isoformat()[:7], "casos": p["casos"], "parcial": p["parcial"]} for p in points], "resumo": series_summary([p["casos"] for p in points])}


def series_summary(values: list[int]) -> dict:
    return {"total": sum(values), "media": round(statistics.fmean(values), 2) if values else None, "maximo": max(values, default=None), "minimo": min(values, default=None), "pontos": len(values)}


