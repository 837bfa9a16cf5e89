"""Rules on raw cells, and the way from a file to the view."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseflow.functions.codes import whole
from caseflow.functions.dates import epi_week, parse_date, rfc822, shift_years
from caseflow.operators.cleaning import Context, analytic_view, clean, code_completeness, quality_report
from caseflow.operators.drift import Observation, SchemaDriftError, detect, gate, load_baseline, next_baseline, observation, observe, save_baseline
from caseflow.schema import ALLOWED_COLUMNS, DeniedColumnError, check_columns
from caseflow.sources import readers
from caseflow.sources.sinks import upsert_table, write_processed

DEFAULTS = {
    "DT_SIN_PRI": "2026-05-08", "DT_EVOLUCA": "2026-05-12", "DT_DIGITA": "2026-05-20", "SEM_PRI": "19", "CS_SEXO": "F", "TP_IDADE": "3", "NU_IDADE_N": "45", "HOSPITAL": "1", "UTI": "2", "SUPORT_VEN": "3",
    "NOSOCOMIAL": "2", "CLASSI_FIN": "5", "CRITERIO": "1", "EVOLUCAO": "1", "VACINA": "2", "VACINA_COV": "1", "SG_UF_NOT": "SP", "SG_UF": "SP", "DT_INTERNA": "2026-05-09",
}
CONTEXT = Context(2026, dt.date(2026, 9, 1))


def raw(spark, *rows):
    return spark.createDataFrame([tuple((DEFAULTS | r).get(c) for c in ALLOWED_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in ALLOWED_COLUMNS))


def one(spark, **cells):
    return clean(raw(spark, cells), CONTEXT).first()


@pytest.mark.parametrize(
    ("cell", "day"),
    [
        ("2026-05-08", dt.date(2026, 5, 8)), ("2026-05-08T00:00:00.000Z", dt.date(2026, 5, 8)), ("30/04/2026", dt.date(2026, 4, 30)), ("1/4/2026", dt.date(2026, 4, 1)), ("20241229", dt.date(2024, 12, 29)),
        ("2024-12", dt.date(2024, 12, 1)), ("2024", dt.date(2024, 1, 1)), ("2024-1-5", dt.date(2024, 1, 5)), ("2026-05-08T23:30:00-03:00", dt.date(2026, 5, 9)), ("abc", None), ("2024-12-29 lixo", None), ("31/02/2026", None), ("  ", None), ("5202-01-01", dt.date(5202, 1, 1)),
    ],
)
def test_dates(spark, cell, day):
    assert spark.createDataFrame([(cell,)], "x string").select(parse_date(F.col("x"))).first()[0] == day


@pytest.mark.parametrize(("cell", "code"), [("1", 1), ("1.0", 1), ("1.5", 1), ("1e2", 100), (" 3 ", 3), ("65537", None), ("X", None), ("", None), ("NaN", None), ("1d", None), ("-9", -9)])
def test_codes(spark, cell, code):
    assert spark.createDataFrame([(cell,)], "x string").select(whole(F.col("x"))).first()[0] == code


def expected_week(d):
    start = d - dt.timedelta(days=(d.weekday() + 1) % 7)
    year = (start + dt.timedelta(days=3)).year
    fourth = dt.date(year, 1, 4)
    first = fourth - dt.timedelta(days=(fourth.weekday() + 1) % 7)
    return year, (start - first).days // 7 + 1


def test_every_day_of_many_years_has_its_week(spark):
    year, number, label = epi_week(F.col("d"))
    days = spark.sql("select explode(sequence(date'2008-12-20', date'2031-01-10', interval 1 day)) as d")
    for r in days.select("d", year.alias("y"), number.alias("n"), label.alias("l")).collect():
        assert (r["y"], r["n"]) == expected_week(r["d"]) and r["l"] == f"{r['y']}-{r['n']:02d}"


def test_years_shift_to_the_same_day(spark):
    r = spark.sql("select date'2024-02-29' as d").select(shift_years(F.col("d"), -1), shift_years(F.col("d"), -4)).first()
    assert tuple(r) == (dt.date(2023, 2, 28), dt.date(2020, 2, 29))


def test_feed_dates(spark):
    got = spark.createDataFrame([("Tue, 05 Aug 2025 10:00:00 GMT",), ("5 Aug 2025 10:00:00 -0300",), ("x",)], "x string").select(rfc822(F.col("x")).cast("string")).collect()
    assert [r[0] for r in got] == ["2025-08-05 10:00:00", "2025-08-05 13:00:00", None]


def test_nothing_is_dropped_and_every_change_is_noted(spark):
    r = one(spark, DT_EVOLUCA="abc", UTI="X", SG_UF="XX", TP_IDADE="2", NU_IDADE_N="63")
    assert r["ajustes_aplicados"] == "data_ilegivel:DT_EVOLUCA,codigo_ilegivel:UTI,uf_anulada:SG_UF,idade_unidade_implausivel"
    assert r["DT_EVOLUCA"] is None and r["UTI"] is None and r["SG_UF"] is None and r["faixa_etaria"] is None
    assert one(spark)["ajustes_aplicados"] == ""
    assert len(clean(raw(spark, {}), CONTEXT).columns) == 53


@pytest.mark.parametrize(("unit", "n", "band"), [("3", "45", "40-49"), ("3", "80", "80+"), ("2", "0", "0-4"), ("1", "30", "0-4"), ("1", "31", None), ("3", "121", None), ("2", "-1", None), ("9", "5", None)])
def test_ages(spark, unit, n, band):
    assert one(spark, TP_IDADE=unit, NU_IDADE_N=n)["faixa_etaria"] == band


@pytest.mark.parametrize(
    ("cells", "flag"),
    [
        ({"DT_SIN_PRI": ""}, "flag_data_invalida"), ({"DT_SIN_PRI": "2018-12-31"}, "flag_data_invalida"), ({"DT_SIN_PRI": "2026-05-21"}, "flag_data_invalida"),
        ({"DT_INTERNA": "2026-05-01"}, "flag_internacao_inconsistente"), ({"DT_INTERNA": ""}, "flag_internacao_inconsistente"),
        ({"UTI": "1"}, "flag_uti_inconsistente"), ({"DT_SAIDUTI": "2026-05-10"}, "flag_uti_inconsistente"), ({"DT_ENTUTI": "2026-05-10", "DT_SAIDUTI": "2026-05-09"}, "flag_uti_inconsistente"),
        ({"DT_EVOLUCA": "2026-05-01"}, "flag_evolucao_inconsistente"), ({"DT_EVOLUCA": ""}, "flag_evolucao_inconsistente"),
        ({"DT_ENCERRA": "5202-01-01"}, "flag_data_implausivel"), ({"DT_ENCERRA": "1695-01-17"}, "flag_data_implausivel"),
    ],
)
def test_flags(spark, cells, flag):
    assert not one(spark)[flag] and one(spark, **cells)[flag]


def test_hospital_infection_may_follow_admission(spark):
    assert not one(spark, DT_INTERNA="2026-05-01", NOSOCOMIAL="1")["flag_internacao_inconsistente"]


def test_ignored_and_absent_are_not_no(spark):
    r = one(spark, EVOLUCAO="9", CLASSI_FIN="", SUPORT_VEN="2", HOSPITAL="7")
    assert (r["status_caso"], r["grupo_etiologico"], r["foi_ventilado"], r["hospitalizacao_informada"]) == ("desfecho_ignorado", "nao_encerrado", True, False)
    found = code_completeness(clean(raw(spark, {"HOSPITAL": "7"}, {"HOSPITAL": "9"}, {"HOSPITAL": ""}, {}), CONTEXT), ("HOSPITAL",)).first()
    assert (found["total"], found["valid"], found["ignored"], found["absent"], found["outside"]) == (4, 1, 1, 1, 1)


def write_csv(path, rows, encoding="utf-8", extra=()):
    columns = [*ALLOWED_COLUMNS, *extra]
    lines = [";".join(columns)] + [";".join('"' + (DEFAULTS | r).get(c, "") + '"' for c in columns) for r in rows]
    path.write_bytes("\n".join(lines).encode(encoding))
    return str(path)


def test_from_file_to_view(spark, tmp_path):
    path = write_csv(tmp_path / "INFLUD26.csv", [{}, {}, {"EVOLUCAO": "7"}], extra=("SURTO_SG",))
    assert readers.year_of(path) == 2026 and readers.detect_encoding(spark, path) == "UTF-8"
    cases = readers.read_cases(spark, path)
    assert "SURTO_SG" not in cases.columns
    observed = clean(cases, CONTEXT, keep_observations=True)
    report = quality_report(cases.count(), observed)
    assert (report["rows_read"], report["rows_dropped"], report["identical_rows"]) == (3, 0, 1)
    write_processed(clean(cases, CONTEXT), str(tmp_path / "out"))
    assert analytic_view(readers.read_processed(spark, str(tmp_path / "out"))).count() == 3


def test_encodings(spark, tmp_path):
    assert readers.detect_encoding(spark, write_csv(tmp_path / "a.csv", [{"CS_SEXO": "é"}], "latin-1")) == "ISO-8859-1"
    assert readers.detect_encoding(spark, write_csv(tmp_path / "b.csv", [{"CS_SEXO": "é"}])) == "UTF-8"
    cut = tmp_path / "c.csv"
    cut.write_bytes("abc é".encode()[:-1])
    assert readers.detect_encoding(spark, str(cut)) == "ISO-8859-1"
    assert readers.read_cases(spark, str(tmp_path / "a.csv")).first()["CS_SEXO"] == "é"


def test_denied_columns_stop_a_load():
    with pytest.raises(DeniedColumnError):
        check_columns(["UTI", "DT_NASC"])


def seen(**change):
    base = {"year": 2026, "raw_columns": ["DT_SIN_PRI", "UTI", "CS_SEXO"], "dtypes": {"DT_SIN_PRI": "data", "UTI": "inteiro", "CS_SEXO": "texto"}, "missing_rate": {"DT_DIGITA": 0.0, "UTI": 10.0}, "categories": {"UTI": ["1", "2", "9"]}, "record_count": 100_000}
    return Observation(**(base | change))


@pytest.mark.parametrize(
    ("change", "kind", "severity"),
    [
        ({"raw_columns": ["DT_SIN_PRI", "UTI", "CS_SEXO", "NOVA"]}, "new_columns", "WARNING"), ({"raw_columns": ["DT_SIN_PRI", "CS_SEXO"]}, "missing_columns", "ERROR"),
        ({"dtypes": {"UTI": "texto"}}, "dtype_changes", "ERROR"), ({"categories": {"UTI": ["1", "7"]}}, "new_categories", "WARNING"),
        ({"missing_rate": {"UTI": 15.0}}, "missing_rate_changes", "WARNING"), ({"missing_rate": {"DT_DIGITA": 61.0}}, "missing_rate_changes", "ERROR"),
        ({"record_count": 80_000}, "record_count_changes", "ERROR"), ({"record_count": 150_000}, "record_count_changes", "WARNING"), ({"truncated": ["UTI"]}, "truncated_categories", "WARNING"),
    ],
)
def test_drift(change, kind, severity):
    assert [(f["kind"], f["severity"]) for f in detect(seen(**change), seen())] == [(kind, severity)]
    assert detect(seen(), seen()) == [] and detect(seen(dtypes={"UTI": "vazio"}), seen()) == []


def test_unreadable_dates_and_gate():
    found = detect(seen(), seen(), unreadable={"DT_SIN_PRI": 501})
    assert [(f["kind"], f["severity"]) for f in found] == [("unreadable_dates", "ERROR")]
    with pytest.raises(SchemaDriftError):
        gate(found, accepted=False)
    gate(found, accepted=True)


def test_baseline_stays_until_findings_are_accepted(tmp_path):
    old, new = seen(), seen(record_count=10)
    found = detect(new, old)
    baseline = next_baseline({}, [old], [], False)
    assert next_baseline(baseline, [new], found, False)[2026]["record_count"] == 100_000
    assert next_baseline(baseline, [new], found, True)[2026]["record_count"] == 10
    frozen = next_baseline(baseline, [new], found, False, "t1")[2026]
    assert frozen["pending_findings"] == found and frozen["pending_since"] == "t1" and "accepted_at" not in frozen
    again = next_baseline({2026: frozen}, [new], found, False, "t2")[2026]
    assert again["pending_since"] == "t1" and detect(new, observation(again)) == found
    done = next_baseline({2026: frozen, 2025: baseline[2026]}, [new], found, True, "t3")
    assert done[2026]["accepted_findings"] == found and done[2026]["accepted_at"] == done[2026]["captured_at"] == "t3" and "pending_findings" not in done[2026]
    assert done[2025] == baseline[2026] and observation(None) is None
    first = next_baseline({}, [new], found, False, "t1")[2026]
    assert first["record_count"] == 10 and first["pending_findings"] == found and first["pending_since"] == first["captured_at"] == "t1"
    path = str(tmp_path / "b.json")
    save_baseline(path, baseline)
    assert load_baseline(path)[2026]["record_count"] == 100_000
    (tmp_path / "bad.json").write_text("{")
    assert load_baseline(str(tmp_path / "bad.json")) == {}


def test_observation(spark):
    o = observe(raw(spark, {}, {"UTI": "7", "DT_SIN_PRI": "", "CS_SEXO": " "}), 2026)
    assert o.record_count == 2 and o.dtypes["DT_SIN_PRI"] == "data" and o.dtypes["UTI"] == "inteiro" and o.missing_rate["CS_SEXO"] == 50.0 and o.categories["UTI"] == ["2", "7"]


def test_references(spark, tmp_path):
    assert readers.read_population(spark, str(tmp_path / "none.csv")).count() == 0
    bad = tmp_path / "p.csv"
    bad.write_text("uf,ano,populacao\nSP,2026,10\n")
    with pytest.raises(readers.ReferenceError):
        readers.read_population(spark, str(bad))
    v = tmp_path / "v.csv"
    v.write_text("uf,ano,campanha,doses_aplicadas,populacao_alvo,fonte,url\n# note\nSP,2026,influenza,5,,x,u\n")
    assert readers.read_vaccination(spark, str(v)).first()["periodo_completo"] is False
    beds = spark.createDataFrame([("202608", '"sp"', "3", "1", "0", "0", "2.0", "1", "", "", "x", "")], "COMP string, UF string, UTI_ADULTO_EXIST string, UTI_ADULTO_SUS string, UTI_PEDIATRICO_EXIST string, UTI_PEDIATRICO_SUS string, UTI_NEONATAL_EXIST string, UTI_NEONATAL_SUS string, UTI_QUEIMADO_EXIST string, UTI_QUEIMADO_SUS string, UTI_CORONARIANA_EXIST string, UTI_CORONARIANA_SUS string")
    got = {(r["tipo_leito"], r["leitos_existentes"], r["leitos_sus"]) for r in readers.aggregate_beds(beds, "u", "d").collect()}
    assert got == {("UTI_ADULTO", 3, 1), ("UTI_NEONATAL", 2, 1)}


def test_doses(spark):
    rows = [("SP", "Vacina Influenza", "2026-02-01", "final"), ("SP", "Haemophilus influenzae B", "2026-02-01", "final"), ("SP", "COVID e influenza", "2026-02-01", "final"), ("XX", "gripe", "2026-02-01", "final"), ("SP", "gripe", "2026-02-01", "entered-in-error")]
    doses, reasons = readers.aggregate_doses(spark.createDataFrame(rows, "sg_uf_paciente string, ds_nome string, dt_vacina string, st_documento string"))
    assert {(r["campanha"], r["doses_aplicadas"]) for r in doses.collect()} == {("influenza", 1), ("covid19", 1)}
    assert {r["motivo"]: r["linhas"] for r in reasons.collect()} == {"contadas": 2, "fora_do_escopo": 1, "uf_invalida": 1, "documento_nao_final": 1}


def test_upsert_table(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_table(spark, path, spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int"), "k", "t")
    upsert_table(spark, path, spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int"), "k", "t")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
