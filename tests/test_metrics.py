"""Indicators on a small base whose values can be counted by hand."""

import datetime as dt
from dataclasses import replace

import pytest

from caseflow.config import Settings
from caseflow.operators import metrics as M
from caseflow.operators import stays as S
from caseflow.operators.cleaning import analytic_view, semantics
from caseflow.operators.filters import Analysis, AnalyticFilters, EmptyBaseError, InvalidFilterError
from caseflow.plans.catalog import Audit, call_tool
from caseflow.schema import CAPACITY, POPULATION, UF_CODES, VACCINATION

TODAY, REFERENCE, CUTOFF = dt.date(2026, 9, 1), dt.date(2026, 8, 23), dt.date(2026, 8, 2)
DAY = dt.timedelta(days=1)
START = CUTOFF - 29 * DAY
SCHEMA = (
    "DT_SIN_PRI date, DT_DIGITA date, DT_ENTUTI date, DT_SAIDUTI date, DT_EVOLUCA date, DT_ENCERRA date, HOSPITAL short, UTI short, SUPORT_VEN short, NOSOCOMIAL short, CLASSI_FIN short, CRITERIO short, "
    "EVOLUCAO short, VACINA short, VACINA_COV short, SG_UF_NOT string, SG_UF string, flag_data_invalida boolean, flag_uti_inconsistente boolean, semana_epi string, semana_epi_ano short, semana_epi_num byte, mes_sintomas string, ajustes_aplicados string"
)


def case(day, uf="SP", entered=None, **more):
    base = {"DT_SIN_PRI": day, "DT_DIGITA": entered or min(day + 10 * DAY, REFERENCE), "SG_UF_NOT": uf, "SG_UF": uf, "CLASSI_FIN": 5, "CRITERIO": 1, "NOSOCOMIAL": 2, "flag_data_invalida": False, "flag_uti_inconsistente": False, "ajustes_aplicados": ""}
    return base | more


def base_rows():
    out = [case(START - 30 * DAY + (i % 30) * DAY, EVOLUCAO=1, HOSPITAL=2) for i in range(100)]
    outcomes = [2] * 15 + [3] * 5 + [1] * 40 + [9] * 10 + [None] * 80
    care = [(1, 1)] * 40 + [(1, 2)] * 60 + [(1, 9)] * 10 + [(2, None)] * 40
    covid = [1] * 30 + [2] * 90 + [9] * 15 + [None] * 15
    for i in range(150):
        day = START + (i % 30) * DAY
        hospital, icu = care[i]
        row = case(day, EVOLUCAO=outcomes[i], HOSPITAL=hospital, UTI=icu, VACINA_COV=covid[i], VACINA=1 if i < 20 else 2)
        if icu == 1:
            row |= {"DT_ENTUTI": day, "DT_SAIDUTI": day + 3 * DAY}
        out.append(row)
    out[100] |= {"DT_SAIDUTI": out[100]["DT_ENTUTI"] - DAY, "flag_uti_inconsistente": True}
    out.append(out[-1] | {"flag_data_invalida": True})
    out.append(case(CUTOFF - DAY, "RJ", REFERENCE, EVOLUCAO=1, HOSPITAL=1, UTI=2))
    for year, n in ((2023, 180), (2024, 120)):
        out += [case(M.shift_year(START + (i % 30) * DAY, year - 2026), EVOLUCAO=1) for i in range(n)]
    return out


def frame(spark, rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def view(spark):
    return analytic_view(semantics(frame(spark, base_rows()))).cache()


@pytest.fixture(scope="module")
def references(spark):
    people = {"SP": 10_000_000, "RJ": 5_000_000}
    beds = {"UTI_ADULTO": 100, "UTI_PEDIATRICA": 20, "UTI_NEONATAL": 30}
    return {
        "population": spark.createDataFrame([(u, 2026, people.get(u, 1_000_000)) for u in UF_CODES], POPULATION),
        "capacity": spark.createDataFrame([(u, "2026-08", t, n, n // 2, "CNES", "", "") for u in UF_CODES for t, n in beds.items()], CAPACITY),
        "vaccination": spark.createDataFrame([("SP", 2026, "influenza", 500, 1000, "x", "", None, True), ("SP", 2026, "covid19", 10, None, "x", "", None, True), ("RJ", 2026, "covid19", 10, None, "y", "", None, False)], VACCINATION),
    }


@pytest.fixture
def sp(view, references):
    return Analysis(view, TODAY, Settings(), AnalyticFilters("sp"), references)


def test_anchor(sp):
    assert (sp.reference, sp.cutoff, sp.window()) == (REFERENCE, CUTOFF, (START, CUTOFF))


def test_growth(sp):
    m = M.case_growth_rate(sp)
    assert (m.value, m.components["atual"], m.components["anterior"]) == (50.0, 150, 100)


def test_growth_needs_a_base_and_equal_maturity(spark, sp):
    late = [case(START - 5 * DAY, entered=REFERENCE)] * 3 + [case(CUTOFF, entered=REFERENCE)] * 2 + [case(CUTOFF) | {"DT_DIGITA": None}]
    a = Analysis(analytic_view(semantics(frame(spark, late))), TODAY)
    m = M.case_growth_rate(a)
    assert m.value is None and m.unavailable_reason
    assert (m.components["anterior_bruto"], m.components["anterior"], m.components["atual_bruto"], m.components["atual"]) == (3, 0, 3, 2)


def test_fatality(sp):
    m = M.mortality_rate(sp)
    assert (m.value, m.numerator, m.denominator) == (25.0, 15, 60)
    assert (m.components["evolucao_ignorada"], m.components["evolucao_ausente"]) == (10, 80)


def test_icu(sp):
    m = M.icu_metrics(sp)
    assert (m.value, m.numerator, m.denominator, m.records_used) == (40.0, 40, 100, 110)
    assert m.components["uti_ignorado"] == 10
    assert m.components["teto_de_permanencia"]["dias"] == 3
    assert m.components["completude"]["estadias"] == 39


def test_unknown_hospital_stay_is_no_negative(spark):
    rows = [case(CUTOFF, HOSPITAL=h, UTI=u, entered=REFERENCE) for h, u in ((None, 1), (9, 2), (2, 1), (1, 2))]
    r = M.admission_counts(analytic_view(semantics(frame(spark, rows)))).first()
    assert (r["uti_informado"], r["admitidos_uti"], r["uti_hospital_negado"]) == (3, 1, 1)


def test_imputed_stays_end_at_the_cap_and_recorded_ones_do_not(spark):
    rows = [
        case(START, UTI=1, DT_ENTUTI=START, DT_SAIDUTI=START + 20 * DAY),
        case(START, UTI=1, DT_ENTUTI=START, DT_EVOLUCA=START + 20 * DAY),
        case(START, UTI=1, DT_ENTUTI=START),
        case(START, UTI=1, DT_ENTUTI=START, DT_EVOLUCA=START + 2 * DAY),
    ]
    view = analytic_view(semantics(frame(spark, rows)))
    ends = sorted((r["saida"] - START).days for r in S.stays(view, 5, CUTOFF).collect())
    assert ends == [2, 5, 5, 20]
    points = {r["dia"]: (r["pacientes"], r["imputados"]) for r in S.census(view, 5, START, CUTOFF).collect()}
    assert len(points) == 30 and points[START] == (4, 3) and points[START + 5 * DAY] == (3, 2) and points[START + 21 * DAY] == (0, 0)


def test_occupancy(sp):
    m = M.icu_bed_occupancy_rate(sp)
    assert m.denominator == 120 and m.value is not None
    assert M.icu_bed_occupancy_rate(sp.filtered(AnalyticFilters())).denominator == 3240


@pytest.mark.parametrize(
    ("change", "words"),
    [
        (lambda c: c.limit(0), "no capacity"),
        (lambda c: c.where("uf != 'AC'"), "26 of 27"),
        (lambda c: c.withColumn("competencia", __import__("pyspark").sql.functions.lit("2025-08")), "12 months"),
        (lambda c: c.withColumn("leitos_existentes", __import__("pyspark").sql.functions.lit(0).cast("bigint")), "no beds"),
    ],
)
def test_occupancy_says_why_it_is_missing(sp, change, words):
    a = sp.filtered(AnalyticFilters())
    a.references = a.references | {"capacity": change(a.references["capacity"])}
    m = M.icu_bed_occupancy_rate(a)
    assert m.value is None and words in m.unavailable_reason


def test_vaccination(sp):
    m = M.vaccination_metrics(sp)
    assert (m.value, m.numerator, m.denominator, m.components["covid_completude_pct"]) == (25.0, 30, 120, 80.0)
    found = m.components["cobertura_populacional"]["campanhas"]
    assert found["influenza"]["value"] == 50.0 and found["covid19"]["denominador"] == "populacao"
    other = M.population_coverage(sp.filtered(AnalyticFilters("RJ")), 2026)["campanhas"]["covid19"]
    assert other["value"] is None and "complete" in other["unavailable_reason"]
    assert "does not cover" in M.population_coverage(sp.filtered(AnalyticFilters("AC")), 2026)["unavailable_reason"]


def test_incidence(sp):
    m = M.incidence_rate(sp)
    assert (m.value, m.numerator, m.denominator) == (1.5, 150, 10_000_000)
    sp.references = {}
    assert M.incidence_rate(sp).unavailable_reason


def test_seasonal_excess(sp):
    m = M.seasonal_baseline(sp)
    assert m.value == 0.0 and m.components["casos_por_ano"] == {2023: 180, 2024: 120}
    assert M.seasonal_baseline(sp.filtered(AnalyticFilters())).value == 0.67
    sp.settings = replace(Settings(), baseline_years=(2020, 2023))
    assert M.seasonal_baseline(sp).unavailable_reason


def test_series(sp):
    d = M.daily_cases(sp)
    assert len(d["pontos"]) == 30 and d["resumo"]["total"] == 150
    m = M.monthly_cases(sp, 3)
    assert [p["parcial"] for p in m["pontos"]] == [False, False, True]


def test_diagnostics(sp):
    r = M.notification_delay_profile(sp)
    assert r["p50"] == 10.0 and r["corte_suficiente"]
    assert M.data_currency(sp)["defasagem_ate_o_corte"] == (TODAY - CUTOFF).days
    twice = M.duplicate_sensitivity(sp)
    assert twice["casos"] == 150 and twice["casos_distintos"] <= 150


def test_filters_are_closed():
    for bad in ({"uf": "XX"}, {"uf": "SP' OR 1=1"}, {"classification": 9}, {"classification": True}):
        with pytest.raises(InvalidFilterError):
            AnalyticFilters(**bad)


def test_empty_base(view):
    with pytest.raises(EmptyBaseError):
        _ = Analysis(view.limit(0), TODAY).reference


def test_catalog(sp, tmp_path):
    audit = Audit(str(tmp_path / "a.jsonl"))
    assert call_tool("get_mortality_rate", sp, {"window_days": 30}, audit)["result"]["value"] == 25.0
    assert call_tool("get_mortality_rate", sp, {"window_days": 3}, audit)["error"] == "invalid_parameters"
    assert call_tool("get_mortality_rate", sp, {"uf": "XX"}, audit)["error"] == "invalid_parameters"
    assert call_tool("drop_table", sp, {}, audit)["error"] == "unknown_tool"
    assert audit.summary()["by_status"] == {"ok": 1, "error": 3}
    assert len((tmp_path / "a.jsonl").read_text().splitlines()) == 4
