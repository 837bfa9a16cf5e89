"""Columns, closed domains and schemas of case files and reference tables."""

from __future__ import annotations


# Names and codes of the published data dictionary.
DATE_COLUMNS = ("DT_SIN_PRI", "DT_INTERNA", "DT_ENTUTI", "DT_SAIDUTI", "DT_EVOLUCA", "DT_ENCERRA", "DT_DIGITA")
EPIWEEK_COLUMNS = ("SEM_PRI",)
CATEGORICAL_COLUMNS = ("CS_SEXO", "TP_IDADE", "HOSPITAL", "UTI", "SUPORT_VEN", "NOSOCOMIAL", "CLASSI_FIN", "CRITERIO", "EVOLUCAO", "VACINA", "VACINA_COV")
GEOGRAPHIC_COLUMNS = ("SG_UF_NOT", "SG_UF")
NUMERIC_COLUMNS = ("NU_IDADE_N",)
ALLOWED_COLUMNS = DATE_COLUMNS + EPIWEEK_COLUMNS + CATEGORICAL_COLUMNS + GEOGRAPHIC_COLUMNS + NUMERIC_COLUMNS
CODE_COLUMNS = tuple(c for c in CATEGORICAL_COLUMNS if c != "CS_SEXO")
PERSISTED_CODES = tuple(c for c in CODE_COLUMNS if c != "TP_IDADE")
#: Columns that must never be read: identifiers and quasi-identifiers of persons and places.
DENIED_COLUMNS = frozenset(
    {
        "NU_NOTIFIC",
        "DT_NASC",
        "COD_IDADE",
        "ID_MUNICIP",
        "CO_MUN_NOT",
        "ID_MN_RESI",
        "CO_MUN_RES",
        "ID_REGIONA",
        "ID_RG_RESI",
        "NM_UN_INTE",
        "ID_MN_INTE",
        "CO_MU_INTE",
        "PAC_COCBO",
        "PAC_DSCBO",
        "TEM_CPF",
        "ESTRANG",
        "MORB_DESC",
        "OUTRO_DES",
        "OUT_MORBI",
        "CLASSI_OUT",
        "OBES_IMC",
        "CS_ETINIA",
        "CS_RACA",
        "CS_GESTANT",
        "DOSE_1_COV",
        "DOSE_2_COV",
        "DOSE_REF",
        "DOSE_2REF",
        "DOSE_ADIC",
        "DOS_RE_BI",
        "LOTE_1_COV",
        "LOTE_2_COV",
        "LOTE_REF",
        "LOTE_REF2",
        "LOTE_ADIC",
        "LOT_RE_BI",
        "FAB_ADIC",
        "FAB_RE_BI",
        "FAB_COV_1",
        "FAB_COV_2",
        "FAB_COVRF",
        "FAB_COVRF2",
        "DT_UT_DOSE",
        "DT_DOSEUNI",
        "DT_1_DOSE",
        "DT_2_DOSE",
        "PAIS_VGM",
        "CO_PS_VGM",
        "LO_PS_VGM",
    }
)
# Labels of codes.
YES_NO = {1: "Sim", 2: "Nao", 9: "Ignorado"}
CODE_LABELS = {
    "HOSPITAL": YES_NO,
    "UTI": YES_NO,
    "VACINA": YES_NO,
    "VACINA_COV": YES_NO,
    "NOSOCOMIAL": YES_NO,
    "EVOLUCAO": {1: "Cura", 2: "Obito", 3: "Obito por outras causas", 9: "Ignorado"},
    "CLASSI_FIN": {
        1: "SRAG por influenza",
        2: "SRAG por outro virus respiratorio",
        3: "SRAG por outro agente etiologico",
        4: "SRAG nao especificado",
        5: "SRAG por covid-19",
    },
    "TP_IDADE": {1: "Dia", 2: "Mes", 3: "Ano"},
    "SUPORT_VEN": {1: "Sim, invasivo", 2: "Sim, nao invasivo", 3: "Nao", 9: "Ignorado"},
    "CRITERIO": {1: "Laboratorial", 2: "Clinico epidemiologico", 3: "Clinico", 4: "Clinico imagem"},
}
#: Codes that mean "ignored"; these two columns have none.
MISSING_CODES = {c: (() if c in ("CLASSI_FIN", "CRITERIO") else (9,)) for c in CODE_LABELS}
AGE_BANDS = ((0, 4, "0-4"), (5, 11, "5-11"), (12, 17, "12-17"), (18, 29, "18-29"), (30, 39, "30-39"), (40, 49, "40-49"), (50, 59, "50-59"), (60, 69, "60-69"), (70, 79, "70-79"), (80, 200, "80+"))
AGE_UNIT_DOMAIN = {1: (0, 30), 2: (0, 11)}
AGE_RANGE = (0, 120)
# The states, outcomes, causes, kinds of beds and words of campaigns.
UF_CODES = (
    "AC",
    "AL",
    "AP",
    "AM",
    "BA",
    "CE",
    "DF",
    "ES",
    "GO",
    "MA",
    "MT",
    "MS",
    "MG",
    "PA",
    "PB",
    "PR",
    "PE",
    "PI",
    "RJ",
    "RN",
    "RS",
    "RO",
    "RR",
    "SC",
    "SP",
    "SE",
    "TO",
)
CASE_STATUS = {1: "cura", 2: "obito_srag", 3: "obito_outras", 9: "desfecho_ignorado"}
ETIOLOGIC_GROUPS = {1: "influenza", 2: "outro_virus_respiratorio", 3: "outro_agente", 4: "nao_especificado", 5: "covid_19"}
BED_TYPES = {
    "UTI_ADULTO": ("UTI_ADULTO_EXIST", "UTI_ADULTO_SUS"),
    "UTI_PEDIATRICA": ("UTI_PEDIATRICO_EXIST", "UTI_PEDIATRICO_SUS"),
    "UTI_NEONATAL": ("UTI_NEONATAL_EXIST", "UTI_NEONATAL_SUS"),
    "UTI_QUEIMADOS": ("UTI_QUEIMADO_EXIST", "UTI_QUEIMADO_SUS"),
    "UTI_CORONARIANA": ("UTI_CORONARIANA_EXIST", "UTI_CORONARIANA_SUS"),
}
BED_TYPES_OF_CENSUS = ("UTI_ADULTO", "UTI_PEDIATRICA")
CAMPAIGNS = {"covid19": ("COVID", "CORONAVIRUS", "SARS-COV"), "influenza": ("INFLUENZA", "GRIPE")}
NOT_INFLUENZA = "HAEMOPHILUS"

FLAGS = ("flag_data_invalida", "flag_internacao_inconsistente", "flag_uti_inconsistente", "flag_evolucao_inconsistente", "flag_data_implausivel")

POPULATION = "uf string, ano int, populacao bigint"
VACCINATION = (
    "uf string, ano int, campanha string, doses_aplicadas bigint, populacao_alvo bigint, fonte string, url string, data_extracao string, periodo_completo boolean"
)
CAPACITY = (
    "uf string, competencia string, tipo_leito string, leitos_existentes bigint, leitos_sus bigint, fonte string, url string, data_extracao string"
)
HISTORY = (
    "run_id string, gerado_em string, uf string, classification int, data_corte_analitica string, indicadores map<string,double>, nivel_de_alerta string, alertas_disparados array<string>"
)
AUDIT = (
    "run_id string, seq int, timestamp string, node string, tool string, parameters string, status string, duration_ms double, result_summary string, source string, error string"
)


class DeniedColumnError(ValueError):
    """A column that must not be read is there."""


def check_columns(columns: list[str]) -> None:
    found = sorted({c.upper() for c in columns} & DENIED_COLUMNS)
    if found:
        raise DeniedColumnError(f"columns that must not be read: {', '.join(found)}")


def require_columns(columns: list[str], wanted: tuple[str, ...]) -> None:
    missing = sorted(set(wanted) - set(columns))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
