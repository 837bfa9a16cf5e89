"""Cleaning as an ordered list of named transforms.  No row is dropped; every changed value leaves a code.

Each rule maps a DataFrame to a DataFrame with built-in functions only, so that all rules run as one
projection in one pass.  ``__adj`` gathers the codes of what was changed, and ``__obs`` what the
quality report counts; ``clean`` turns the first into ``ajustes_aplicados`` and may keep the second.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.config import Settings
from caseflow.functions.codes import age_band, age_outside_range, age_outside_unit, age_years, is_code, label, normal_text, whole
from caseflow.functions.dates import blank_to_null, epi_week, parse_date
from caseflow.schema import ALLOWED_COLUMNS, CASE_STATUS, CODE_COLUMNS, CODE_LABELS, DATE_COLUMNS, ETIOLOGIC_GROUPS, FLAGS, GEOGRAPHIC_COLUMNS, MISSING_CODES, UF_CODES, check_columns


@dataclass(frozen=True)
class Context:
    year: int
    run_date: datetime.date
    settings: Settings = Settings()


def noted(df: DataFrame, adjustments: dict[str, Column], observed: dict[str, Column]) -> DataFrame:
    """Adds codes of changes and observations, both computed before the change."""
    return df.withColumns(
        {f"__adj_{i}": F.when(c, F.lit(k)) for i, (k, c) in enumerate(adjustments.items(), len([x for x in df.columns if x.startswith("__adj_")]))}
        | {f"__obs_{k}": F.coalesce(c, F.lit(False)) for k, c in observed.items()}
    )


def select_allowed(df: DataFrame) -> DataFrame:
    """Allowed columns only; absent ones as nulls."""
    check_columns([c for c in df.columns if c in ALLOWED_COLUMNS])
    return df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ALLOWED_COLUMNS))


def parse_dates(df: DataFrame, context: Context) -> DataFrame:
    parsed = {c: parse_date(F.col(c)) for c in DATE_COLUMNS}
    bad = {c: blank_to_null(F.col(c)).isNotNull() & parsed[c].isNull() for c in DATE_COLUMNS}
    df = noted(df, {f"data_ilegivel:{c}": bad[c] for c in DATE_COLUMNS}, {f"invalid_dates:{c}": bad[c] for c in DATE_COLUMNS})
    return df.withColumns(parsed)


def read_codes(df: DataFrame, context: Context) -> DataFrame:
    values = {c: whole(F.col(c)) for c in CODE_COLUMNS}
    bad = {c: blank_to_null(F.col(c)).isNotNull() & values[c].isNull() for c in CODE_COLUMNS}
    df = noted(df, {f"codigo_ilegivel:{c}": bad[c] for c in CODE_COLUMNS}, {f"unreadable_codes:{c}": bad[c] for c in CODE_COLUMNS})
    return df.withColumns(values)


def normal_sex(df: DataFrame, context: Context) -> DataFrame:
    return df.withColumn("CS_SEXO", normal_text(F.col("CS_SEXO")))


def read_numbers(df: DataFrame, context: Context) -> DataFrame:
    return df.withColumn("NU_IDADE_N", whole(F.col("NU_IDADE_N"), "int"))


def check_states(df: DataFrame, context: Context) -> DataFrame:
    values = {c: normal_text(F.col(c)) for c in GEOGRAPHIC_COLUMNS}
    unknown = {c: values[c].isNotNull() & ~values[c].isin(*UF_CODES) for c in GEOGRAPHIC_COLUMNS}
    df = noted(df, {f"uf_anulada:{c}": unknown[c] for c in GEOGRAPHIC_COLUMNS}, {f"unknown_uf:{c}": unknown[c] for c in GEOGRAPHIC_COLUMNS})
    return df.withColumns({c: F.when(values[c].isin(*UF_CODES), values[c]) for c in GEOGRAPHIC_COLUMNS})


def derive_age(df: DataFrame, context: Context) -> DataFrame:
    amount, unit = F.col("NU_IDADE_N"), F.col("TP_IDADE")
    conflict, years = age_outside_unit(amount, unit), age_years(amount, unit)
    strange = ~conflict & age_outside_range(years)
    df = noted(df, {"idade_unidade_implausivel": conflict, "idade_anulada": strange}, {"age_unit": conflict, "age_range": strange})
    return df.withColumn("faixa_etaria", age_band(F.when(~conflict & ~strange, years))).drop("NU_IDADE_N", "TP_IDADE")


def mark_year(df: DataFrame, context: Context) -> DataFrame:
    return df.withColumn("ano_referencia", F.lit(context.year).cast("int"))


def derive_epi_week(df: DataFrame, context: Context) -> DataFrame:
    day = F.col("DT_SIN_PRI")
    year, number, name = epi_week(day)
    published = whole(F.col("SEM_PRI"), "int")
    comparable = published.between(1, 53) & number.isNotNull()
    df = noted(df, {}, {"epiweek_compared": comparable, "epiweek_mismatch": comparable & (published != number)})
    return df.withColumns(
        {
            "semana_epi_ano": year,
            "semana_epi_num": number,
            "semana_epi": name,
            "ano_sintomas": F.year(day).cast("short"),
            "mes_sintomas": F.date_format(day, "yyyy-MM"),
        }
    )


def coherence(df: DataFrame, context: Context) -> DataFrame:
    """Five flags, none of them null; only the first takes a row out of the analytic view."""
    floor, ceiling = F.lit(context.settings.min_valid_date).cast("date"), F.lit(context.run_date)
    symptoms, entry, admitted, icu_in, icu_out, outcome = (F.col(c) for c in ("DT_SIN_PRI", "DT_DIGITA", "DT_INTERNA", "DT_ENTUTI", "DT_SAIDUTI", "DT_EVOLUCA"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    strange = F.lit(False)
    for c in DATE_COLUMNS:
        strange = strange | yes((F.col(c) < floor) | (F.col(c) > ceiling)) | yes(F.col(c) > F.date_add(entry, context.settings.max_days_after_entry))
    flags = {
        "flag_data_invalida": symptoms.isNull() | yes(symptoms < floor) | yes(symptoms > entry),
        "flag_internacao_inconsistente": (yes(admitted < symptoms) & ~is_code(F.col("NOSOCOMIAL"), 1)) | (is_code(F.col("HOSPITAL"), 1) & admitted.isNull()),
        "flag_uti_inconsistente": yes(icu_in < symptoms) | yes(icu_out < icu_in) | (is_code(F.col("UTI"), 1) & icu_in.isNull()) | (icu_out.isNotNull() & icu_in.isNull()),
        "flag_evolucao_inconsistente": yes(outcome < symptoms) | (is_code(F.col("EVOLUCAO"), 1, 2, 3) & outcome.isNull()),
        "flag_data_implausivel": strange,
    }
    return df.withColumns(flags)


def semantics(df: DataFrame, context: Context | None = None) -> DataFrame:
    """What codes mean: 18 booleans that are never null, and two labels."""
    c = F.col
    return df.withColumns(
        {
            "eh_obito_srag": is_code(c("EVOLUCAO"), 2),
            "caso_encerrado": is_code(c("EVOLUCAO"), 1, 2, 3),
            "foi_hospitalizado": is_code(c("HOSPITAL"), 1),
            "hospitalizacao_informada": is_code(c("HOSPITAL"), 1, 2),
            "teve_admissao_uti": is_code(c("UTI"), 1),
            "uti_informado": is_code(c("UTI"), 1, 2),
            "estadia_uti_utilizavel": is_code(c("UTI"), 1) & c("DT_ENTUTI").isNotNull() & ~c("flag_uti_inconsistente"),
            "foi_ventilado": is_code(c("SUPORT_VEN"), 1, 2),
            "ventilacao_invasiva": is_code(c("SUPORT_VEN"), 1),
            "ventilacao_nao_invasiva": is_code(c("SUPORT_VEN"), 2),
            "ventilacao_informada": is_code(c("SUPORT_VEN"), 1, 2, 3),
            "caso_nosocomial": is_code(c("NOSOCOMIAL"), 1),
            "etiologia_laboratorial": is_code(c("CRITERIO"), 1),
            "etiologia_criterio_informado": is_code(c("CRITERIO"), 1, 2, 3, 4),
            "grupo_etiologico": label(c("CLASSI_FIN"), ETIOLOGIC_GROUPS, "nao_encerrado"),
            "status_caso": label(c("EVOLUCAO"), CASE_STATUS, "em_aberto"),
            "vacinado_covid": is_code(c("VACINA_COV"), 1),
            "vacina_covid_informada": is_code(c("VACINA_COV"), 1, 2),
            "vacinado_influenza": is_code(c("VACINA"), 1),
            "vacina_influenza_informada": is_code(c("VACINA"), 1, 2),
        }
    )


#: Names and transforms, in the order in which they depend on each other.
RULES: tuple[tuple[str, Callable[[DataFrame, Context], DataFrame]], ...] = (
    ("parse_datas", parse_dates),
    ("normaliza_codigos_categoricos", read_codes),
    ("normaliza_sexo", normal_sex),
    ("normaliza_numericos", read_numbers),
    ("valida_uf", check_states),
    ("deriva_idade", derive_age),
    ("marca_ano_de_origem", mark_year),
    ("deriva_semana_epidemiologica", derive_epi_week),
    ("avalia_coerencia", coherence),
    ("deriva_semantica", semantics),
)


def gather_codes(df: DataFrame) -> DataFrame:
    """``ajustes_aplicados``: the codes that ``noted`` left, in their order; empty where nothing was changed."""
    codes = [c for c in df.columns if c.startswith("__adj_")]
    return df.withColumn("ajustes_aplicados", F.concat_ws(",", *(F.col(f"`{c}`") for c in codes))).drop(*codes)


def clean(raw: DataFrame, context: Context, keep_observations: bool = False) -> DataFrame:
    df = select_allowed(raw)
    for _, rule in RULES:
        df = rule(df, context)
    df = gather_codes(df)
    return df if keep_observations else df.drop(*(c for c in df.columns if c.startswith("__obs_")))


def analytic_view(cases: DataFrame) -> DataFrame:
    """Typed names for analysis; rows without a usable time axis are left out here and nowhere else."""
    named = {
        "data_sintomas": "DT_SIN_PRI",
        "data_digitacao": "DT_DIGITA",
        "data_evolucao": "DT_EVOLUCA",
        "data_encerramento": "DT_ENCERRA",
        "data_entrada_uti": "DT_ENTUTI",
        "data_saida_uti": "DT_SAIDUTI",
    }
    return cases.where("not flag_data_invalida").withColumns(
        {new: F.col(old).cast("date") for new, old in named.items()}
        | {
            "uf_residencia": F.col("SG_UF"),
            "semana_epidemiologica": F.col("semana_epi"),
            "semana_epidemiologica_ano": F.col("semana_epi_ano"),
            "semana_epidemiologica_numero": F.col("semana_epi_num"),
            "mes_sintomas_rotulo": F.col("mes_sintomas"),
            "mes_sintomas": F.trunc("DT_SIN_PRI", "month"),
        }
    )


def code_completeness(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Per code column: total = valid + ignored + absent + out of domain, in one pass."""
    columns = columns or tuple(c for c in CODE_LABELS if c in df.columns)
    sums = []
    for c in columns:
        missing = MISSING_CODES[c]
        valid = [k for k in CODE_LABELS[c] if k not in missing]
        v, i, a = is_code(F.col(c), *valid), is_code(F.col(c), *missing) if missing else F.lit(False), F.col(c).isNull()
        sums += [F.count_if(v).alias(f"{c}__valid"), F.count_if(i).alias(f"{c}__ignored"), F.count_if(a).alias(f"{c}__absent"), F.count_if(~v & ~i & ~a).alias(f"{c}__outside")]
    one = df.agg(F.count("*").alias("total"), *sums)
    parts = ", ".join(f"'{c}', {c}__valid, {c}__ignored, {c}__absent, {c}__outside" for c in columns)
    return one.selectExpr("total", f"stack({len(columns)}, {parts}) as (coluna, valid, ignored, absent, outside)")


def quality_report(raw_rows: int, cleaned: DataFrame) -> dict:
    """Counters of one load from one aggregate over the cleaned plan with its observations."""
    observed = [c for c in cleaned.columns if c.startswith("__obs_")]
    sums = [F.count_if(F.col(f"`{c}`")).alias(f"o{i}") for i, c in enumerate(observed)] + [F.count_if(F.col(f)).alias(f) for f in FLAGS]
    sums += [F.count("*").alias("rows"), F.count_if(F.col("ajustes_aplicados") != "").alias("adjusted")]
    row = cleaned.agg(*sums).first()
    return {
        "rows_read": raw_rows,
        "rows_kept": row["rows"],
        "rows_dropped": raw_rows - row["rows"],
        "rows_adjusted": row["adjusted"],
        "flags": {f: row[f] for f in FLAGS},
        "observed": {c.removeprefix("__obs_"): row[f"o{i}"] for i, c in enumerate(observed)},
        "identical_rows": identical_rows(cleaned.drop(*observed, "ajustes_aplicados")),
    }


def identical_rows(df: DataFrame) -> int:
    """Rows beyond the first of each group of equal ones; nulls are equal."""
    n = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).count()
    return n.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
