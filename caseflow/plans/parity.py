"""Queries that run the operators over the driver's tables, each with the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import codes as C
from caseflow.functions import dates as D
from caseflow.functions import text as X
from caseflow.functions import vectors as V
from caseflow.operators import cleaning as Q
from caseflow.operators import drift as DR
from caseflow.operators import guards as G
from caseflow.operators import metrics as M
from caseflow.operators import news as N
from caseflow.operators import reliability as R
from caseflow.operators import series as S
from caseflow.operators import stays as T
from caseflow.operators.filters import reference_date_frame
from caseflow.plans import standin as P
from caseflow.plans.catalog import audit_by
from caseflow.plans.standin import CAPACITY_SQL, CASES_SQL, DOSES_SQL, POPULATION_SQL, SETTINGS, TODAY, WINDOW, analysis, cases, table
from caseflow.schema import BED_TYPES, UF_CODES
from caseflow.sources.readers import aggregate_beds

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def cut(spark, sf):
    a = analysis(spark, sf)
    return a, *a.window(WINDOW)


# M0: the anchor of all windows


@query(CASES_SQL + "SELECT reference FROM w")
def reference_date(spark: SparkSession, sf: str) -> DataFrame:
    return reference_date_frame(analysis(spark, sf).view, TODAY)


@query(CASES_SQL + "SELECT cutoff, first AS start FROM w")
def analysis_cutoff(spark, sf):
    a = analysis(spark, sf)
    lag = SETTINGS.reporting_lag_days
    return reference_date_frame(a.view, TODAY).select(F.date_sub("reference", lag).alias("cutoff"), F.date_sub("reference", lag + WINDOW - 1).alias("start"))


# Series

DAILY_SQL = """, s AS (SELECT CAST(dia AS DATE) AS dia, (SELECT count(*) FROM v WHERE data_sintomas = CAST(dia AS DATE)) AS casos FROM w, generate_series(first, cutoff, INTERVAL 1 DAY) g(dia))
"""


def daily(spark, sf):
    a, first, last = cut(spark, sf)
    return S.daily_counts(a.rows(), "data_sintomas", first, last)


@query(CASES_SQL + DAILY_SQL + "SELECT dia, casos FROM s")
def daily_cases_zero_filled(spark, sf):
    return daily(spark, sf)


MONTHLY_SQL = """, ms AS (SELECT CAST(mes AS DATE) AS mes, (SELECT count(*) FROM v WHERE date_trunc('month', data_sintomas) = mes AND data_sintomas <= cutoff) AS casos,
  last_day(CAST(mes AS DATE)) > cutoff AS parcial FROM w, generate_series(date_trunc('month', cutoff) - INTERVAL 11 MONTH, date_trunc('month', cutoff), INTERVAL 1 MONTH) g(mes))
"""


def monthly(spark, sf):
    a, _, last = cut(spark, sf)
    return S.monthly_counts(a.rows(), "data_sintomas", last, 12)


@query(CASES_SQL + MONTHLY_SQL + "SELECT mes, casos, parcial FROM ms")
def monthly_cases_partial_flag(spark, sf):
    return monthly(spark, sf)


EVENTS_SQL = "WITH e AS (SELECT CAST(ts AS DATE) AS dia, count(*) AS casos FROM events GROUP BY 1) "


def event_days(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("dia")).agg(F.count("*").alias("casos"))


@query(EVENTS_SQL + "SELECT dia, casos FROM e")
def daily_events_series(spark, sf):
    return event_days(spark, sf)


@query(EVENTS_SQL + "SELECT CAST(sum(casos) AS BIGINT) AS total, round(avg(casos), 6) AS media, max(casos) AS maximo, min(casos) AS minimo, count(*) AS pontos FROM e")
def series_summary(spark, sf):
    return S.summary(event_days(spark, sf)).withColumn("media", F.round("media", 6))


@query(EVENTS_SQL + "SELECT dia, casos, round(avg(casos) OVER (ORDER BY dia ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS media_movel FROM e")
def moving_average_7(spark, sf):
    return S.moving_average(event_days(spark, sf)).withColumn("media_movel", F.round("media_movel", 6))


TREND = "CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 'alta' ELSE 'estavel' END WHEN abs(({a} - {b}) / {b} * 100) < 8 THEN 'estavel' WHEN {a} > {b} THEN 'alta' ELSE 'queda' END"


@query(
    EVENTS_SQL
    + ", n AS (SELECT *, row_number() OVER (ORDER BY dia DESC) AS n FROM e), m AS (SELECT avg(casos) FILTER (n <= 7) AS atual, avg(casos) FILTER (n BETWEEN 8 AND 14) AS anterior FROM n) "
    + f"SELECT round(atual, 6) AS atual, round(anterior, 6) AS anterior, round((atual - anterior) / anterior * 100, 6) AS variacao_pct, {TREND.format(a='atual', b='anterior')} AS tendencia FROM m"
)
def weekly_trend(spark, sf):
    out = S.week_over_week(event_days(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("atual", "anterior", "variacao_pct")})


@query(
    CASES_SQL + MONTHLY_SQL + ", n AS (SELECT *, row_number() OVER (ORDER BY mes) AS n, count(*) OVER () // 2 AS h FROM ms WHERE NOT parcial), "
    "q AS (SELECT CAST(sum(casos) FILTER (n <= h) AS BIGINT) AS primeira, CAST(sum(casos) FILTER (n > h AND n <= 2 * h) AS BIGINT) AS segunda FROM n) "
    f"SELECT primeira, segunda, round((segunda - primeira) / CAST(primeira AS DOUBLE) * 100, 6) AS variacao_pct, {TREND.format(a='segunda', b='CAST(primeira AS DOUBLE)')} AS tendencia FROM q"
)
def monthly_half_trend(spark, sf):
    return S.half_over_half(monthly(spark, sf)).withColumn("variacao_pct", F.round("variacao_pct", 6))


@query(EVENTS_SQL + "SELECT dia AS pico_em, casos AS pico FROM e ORDER BY casos DESC, dia LIMIT 1")
def series_peak(spark, sf):
    return S.peak(event_days(spark, sf))


@query(EVENTS_SQL + ", n AS (SELECT *, row_number() OVER (ORDER BY dia) AS a, row_number() OVER (ORDER BY dia DESC) AS b FROM e) SELECT dia, casos FROM n WHERE a <= 3 OR b <= 3")
def series_ends(spark, sf):
    return S.ends(event_days(spark, sf))


# Growth

GROWTH = """SELECT count(*) FILTER (data_sintomas BETWEEN first AND cutoff) AS atual_bruto,
  count(*) FILTER (data_sintomas BETWEEN first - 180 AND first - 1) AS anterior_bruto,
  count(*) FILTER (data_sintomas BETWEEN first AND cutoff AND data_digitacao <= cutoff + 21) AS atual,
  count(*) FILTER (data_sintomas BETWEEN first - 180 AND first - 1 AND data_digitacao <= first - 1 + 21) AS anterior FROM v, w"""


@query(CASES_SQL + f"SELECT atual, anterior, round((atual - anterior) / CAST(anterior AS DOUBLE) * 100, 6) AS taxa FROM ({GROWTH})")
def case_growth_symmetric(spark, sf):
    a, _, last = cut(spark, sf)
    r = M.growth_counts(a.rows(), last, WINDOW, SETTINGS.reporting_lag_days)
    return r.select("atual", "anterior", F.round(C.ratio(F.col("atual") - F.col("anterior"), F.col("anterior")), 6).alias("taxa"))


@query(CASES_SQL + f"SELECT atual_bruto, anterior_bruto FROM ({GROWTH})")
def case_growth_raw(spark, sf):
    a, _, last = cut(spark, sf)
    return M.growth_counts(a.rows(), last, WINDOW, SETTINGS.reporting_lag_days).select("atual_bruto", "anterior_bruto")


# Fatality

FATALITY = """count(*) AS casos, count(*) FILTER (caso_encerrado) AS encerrados, count(*) FILTER (eh_obito_srag) AS obitos, count(*) FILTER (EVOLUCAO = 3) AS obitos_outras_causas,
  count(*) FILTER (EVOLUCAO = 9) AS evolucao_ignorada, count(*) FILTER (EVOLUCAO IS NULL) AS evolucao_ausente"""
MATURITY = "(SELECT quantile_cont(date_diff('day', data_sintomas, data_encerramento), 0.9) FROM v WHERE caso_encerrado AND data_encerramento IS NOT NULL AND data_encerramento >= data_sintomas)"


@query(CASES_SQL + f", x AS (SELECT {FATALITY} FROM v, w WHERE data_sintomas BETWEEN first AND cutoff) SELECT *, round(obitos / CAST(encerrados AS DOUBLE) * 100, 6) AS letalidade FROM x")
def fatality_rate(spark, sf):
    a, first, last = cut(spark, sf)
    return M.fatality_counts(a.between(first, last)).withColumn("letalidade", F.round(C.ratio(F.col("obitos"), F.col("encerrados")), 6))


@query(CASES_SQL + f", x AS (SELECT CAST(greatest(1, least(round_even({MATURITY}, 0), 120)) AS INTEGER) AS d) SELECT {FATALITY} FROM v, w, x WHERE data_sintomas BETWEEN first - d AND cutoff - d")
def fatality_mature_cohort(spark, sf):
    a, first, last = cut(spark, sf)
    shift = M.outcome_maturity(a) * M.DAY
    return M.fatality_counts(a.between(first - shift, last - shift))


@query(CASES_SQL + f"SELECT {MATURITY} AS dias")
def outcome_maturity_p90(spark, sf):
    return M.maturity_percentile(analysis(spark, sf).rows(), 0.9)


# Intensive care

ADMISSION = """count(*) FILTER (i) AS internados, count(*) FILTER (i AND uti_informado) AS uti_informado, count(*) FILTER (i AND teve_admissao_uti) AS admitidos_uti,
  count(*) FILTER (i AND UTI = 9) AS uti_ignorado, count(*) FILTER (i AND UTI IS NULL) AS uti_ausente, count(*) FILTER (uti_informado AND HOSPITAL IS NULL) AS uti_hospital_ausente,
  count(*) FILTER (uti_informado AND HOSPITAL = 9) AS uti_hospital_ignorado, count(*) FILTER (teve_admissao_uti AND HOSPITAL = 2) AS uti_hospital_negado"""


@query(CASES_SQL + f"SELECT {ADMISSION} FROM (SELECT *, foi_hospitalizado OR NOT hospitalizacao_informada AS i FROM v, w WHERE data_sintomas BETWEEN first AND cutoff)")
def admission_rate_denominator_rescue(spark, sf):
    a, first, last = cut(spark, sf)
    return M.admission_counts(a.between(first, last))


CAP = "(SELECT quantile_cont(date_diff('day', data_entrada_uti, data_saida_uti), 0.95) FROM v WHERE estadia_uti_utilizavel AND data_saida_uti IS NOT NULL AND data_saida_uti >= data_entrada_uti)"
STAYS_SQL = f""", t AS (SELECT CAST(greatest(1, round_even({CAP}, 0)) AS INTEGER) AS teto),
e AS (SELECT k, data_entrada_uti AS entrada,
    least(coalesce(data_saida_uti, least(data_evolucao, data_entrada_uti + teto), data_entrada_uti + teto), cutoff) AS saida,
    data_saida_uti IS NULL AS imputada, data_saida_uti IS NULL AND data_evolucao IS NOT NULL AS por_evolucao, data_saida_uti IS NULL AND data_evolucao IS NULL AS em_aberto,
    data_saida_uti IS NULL AND coalesce(data_evolucao, cutoff) > data_entrada_uti + teto AS truncada FROM v, w, t WHERE estadia_uti_utilizavel),
c AS (SELECT CAST(dia AS DATE) AS dia, count(entrada) AS pacientes, count(entrada) FILTER (imputada) AS imputados
  FROM (SELECT dia FROM w, generate_series(first, cutoff, INTERVAL 1 DAY) g(dia)) LEFT JOIN e ON dia BETWEEN entrada AND saida GROUP BY 1)
"""


@query(CASES_SQL + f"SELECT {CAP} AS percentil, count(*) AS estadias FROM v WHERE estadia_uti_utilizavel AND data_saida_uti IS NOT NULL AND data_saida_uti >= data_entrada_uti")
def stay_cap_p95(spark, sf):
    return T.cap_percentile(analysis(spark, sf).rows(), 0.95)


@query(CASES_SQL + STAYS_SQL + "SELECT entrada, saida, imputada, truncada, count(*) AS n FROM e GROUP BY ALL")
def stay_end_imputed(spark, sf):
    a, _, last = cut(spark, sf)
    return T.stays(a.rows(), T.stay_cap(a)["dias"], last).groupBy("entrada", "saida", "imputada", "truncada").agg(F.count("*").alias("n"))


@query(CASES_SQL + STAYS_SQL + "SELECT dia, pacientes, imputados FROM c")
def stay_census_daily(spark, sf):
    a, first, last = cut(spark, sf)
    return T.census(a.rows(), T.stay_cap(a)["dias"], first, last)


@query(CASES_SQL + STAYS_SQL + "SELECT count(*) AS estadias, count(*) FILTER (NOT imputada) AS saida_registrada, count(*) FILTER (por_evolucao) AS por_evolucao, count(*) FILTER (em_aberto) AS em_aberto, count(*) FILTER (truncada) AS truncadas FROM e, w WHERE entrada <= cutoff AND saida >= first")
def stay_completeness(spark, sf):
    a, first, last = cut(spark, sf)
    return T.completeness(a.rows(), T.stay_cap(a)["dias"], first, last)


@query(CASES_SQL + STAYS_SQL + "SELECT dia AS pico_em, pacientes AS pico FROM c, w, t WHERE dia <= cutoff - teto ORDER BY pacientes DESC, dia LIMIT 1")
def census_mature_peak(spark, sf):
    a, first, last = cut(spark, sf)
    cap = T.stay_cap(a)["dias"]
    points = T.census(a.rows(), cap, first, last).where(F.col("dia") <= F.lit(last - cap * M.DAY))
    return S.peak(points, "dia", "pacientes")


@query(
    "WITH s AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE)), "
    "d AS (SELECT CAST(dia AS DATE) AS dia FROM generate_series(DATE '1999-01-01', DATE '1999-01-30', INTERVAL 1 DAY) g(dia)) SELECT dia, count(a) AS presentes FROM d LEFT JOIN s ON dia BETWEEN a AND b GROUP BY 1"
)
def stay_census_range_join(spark, sf):
    """Intervals that cover the days of a month, of any length, without a range join."""
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.to_date("o_orderdate").alias("a"), F.to_date("l_shipdate").alias("b"))
    first, last = datetime.date(1999, 1, 1), datetime.date(1999, 1, 30)
    counts = T.covered_days(rows, "a", "b", first, last).groupBy("dia").agg(F.count("*").alias("presentes"))
    return S.zero_filled(counts, S.calendar(spark, first, last), "dia", "presentes")


# Capacity

BY_COMPETENCE = "SELECT competencia, CAST(sum(leitos_existentes) AS BIGINT) AS existentes, CAST(sum(leitos_sus) AS BIGINT) AS sus, count(DISTINCT uf) AS ufs FROM cap WHERE tipo_leito IN ('UTI_ADULTO', 'UTI_PEDIATRICA') GROUP BY 1"
DISTANCE = "abs((year(cutoff) - CAST(substr(competencia, 1, 4) AS INTEGER)) * 12 + month(cutoff) - CAST(substr(competencia, 6, 2) AS INTEGER))"
NEAREST = f", n AS (SELECT *, {DISTANCE} AS defasagem FROM ({BY_COMPETENCE}), w WHERE ufs >= 25 ORDER BY defasagem, competencia LIMIT 1)"


@query(CASES_SQL + CAPACITY_SQL + BY_COMPETENCE)
def capacity_coverage_guard(spark, sf):
    return M.capacity_by_competence(P.capacity(spark, sf), None).select("competencia", "existentes", "sus", "ufs")


@query(CASES_SQL + CAPACITY_SQL + NEAREST + " SELECT competencia, existentes, sus, CAST(defasagem AS INTEGER) AS defasagem FROM n")
def capacity_nearest_competence(spark, sf):
    a, _, last = cut(spark, sf)
    return M.nearest_competence(M.capacity_by_competence(a.references["capacity"], None), last, 25).select("competencia", "existentes", "sus", "defasagem")


@query(CASES_SQL + STAYS_SQL + CAPACITY_SQL + NEAREST + " SELECT dia, pacientes, round(pacientes / CAST(existentes AS DOUBLE) * 100, 6) AS ocupacao_pct FROM c, n")
def bed_occupancy_daily(spark, sf):
    a, first, last = cut(spark, sf)
    beds = M.nearest_competence(M.capacity_by_competence(a.references["capacity"], None), last, 25).select("existentes")
    points = T.census(a.rows(), T.stay_cap(a)["dias"], first, last)
    return points.crossJoin(F.broadcast(beds)).select("dia", "pacientes", F.round(C.ratio(F.col("pacientes"), F.col("existentes")), 6).alias("ocupacao_pct"))  # beds: one row


# Vaccination, incidence, baseline

VACC = """count(*) AS casos, count(*) FILTER (vacina_covid_informada) AS covid_informada, count(*) FILTER (vacinado_covid) AS covid_sim, count(*) FILTER (VACINA_COV = 9) AS covid_ignorada,
  count(*) FILTER (VACINA_COV IS NULL) AS covid_ausente, count(*) FILTER (vacina_influenza_informada) AS influenza_informada, count(*) FILTER (vacinado_influenza) AS influenza_sim,
  count(*) FILTER (VACINA = 9) AS influenza_ignorada, count(*) FILTER (VACINA IS NULL) AS influenza_ausente"""


@query(CASES_SQL + f"SELECT {VACC} FROM v, w WHERE data_sintomas BETWEEN first AND cutoff")
def declared_coverage(spark, sf):
    a, first, last = cut(spark, sf)
    return M.vaccination_counts(a.between(first, last))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS informados, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) AS sim, round(count(*) FILTER (l_linestatus = 'F' AND l_quantity > 25) / CAST(nullif(count(*) FILTER (l_linestatus = 'F'), 0) AS DOUBLE) * 100, 6) AS cobertura FROM lineitem GROUP BY 1")
def declared_coverage_by_group(spark, sf):
    known = F.col("l_linestatus") == "F"
    code = F.when(~known, 9).when(F.col("l_quantity") > 25, 1).otherwise(2)
    doses = {"VACINA_COV": code, "VACINA": code, "vacina_covid_informada": known, "vacinado_covid": code == 1, "vacina_influenza_informada": known, "vacinado_influenza": code == 1}
    counts = M.vaccination_counts(table(spark, sf, "lineitem").withColumns(doses), "l_returnflag")
    out = counts.select("l_returnflag", F.col("casos").alias("n"), F.col("covid_informada").alias("informados"), F.col("covid_sim").alias("sim"))
    return out.withColumn("cobertura", F.round(C.ratio(F.col("sim"), F.col("informados")), 6))


@query(
    CASES_SQL + POPULATION_SQL + DOSES_SQL + ", g AS (SELECT campanha, CAST(sum(doses) AS BIGINT) AS doses, CAST(sum(alvo) AS BIGINT) AS alvo, count(*) FILTER (alvo IS NULL) AS sem_alvo, string_agg(DISTINCT fonte, '; ' ORDER BY fonte) AS fontes, count(DISTINCT uf) AS ufs, bool_and(completo) AS completo FROM dose GROUP BY 1), "
    "p AS (SELECT CAST(sum(populacao) AS BIGINT) AS populacao FROM pop WHERE ano = (SELECT ano FROM pop ORDER BY abs(ano - 2001), ano LIMIT 1)) "
    "SELECT campanha, doses, fontes, ufs, completo, CASE WHEN alvo IS NOT NULL AND sem_alvo = 0 THEN alvo ELSE populacao END AS denominador, "
    "CASE WHEN completo THEN round(doses / CAST(CASE WHEN alvo IS NOT NULL AND sem_alvo = 0 THEN alvo ELSE populacao END AS DOUBLE) * 100, 6) END AS cobertura FROM g, p"
)
def population_coverage_by_campaign(spark, sf):
    people = P.population(spark, sf)
    year = M.nearest_year(people, 2001).withColumnRenamed("ano", "chosen")
    total = people.join(F.broadcast(year), F.col("ano") == F.col("chosen")).agg(F.sum("populacao").alias("populacao"))
    rows = M.campaign_sums(P.doses(spark, sf)).crossJoin(F.broadcast(total))  # total: one row
    denominator = F.when(F.col("alvo").isNotNull() & (F.col("sem_alvo") == 0), F.col("alvo")).otherwise(F.col("populacao"))
    return rows.select("campanha", "doses", "fontes", "ufs", "completo", denominator.alias("denominador"), F.round(F.when(F.col("completo"), C.ratio(F.col("doses"), denominator)), 6).alias("cobertura"))


@query(
    CASES_SQL + POPULATION_SQL + ", x AS (SELECT count(*) AS casos, count(*) FILTER (uf_residencia IS NULL) AS sem_residencia FROM v, w WHERE data_sintomas BETWEEN first AND cutoff) "
    "SELECT casos, sem_residencia, round(casos / CAST((SELECT sum(populacao) FROM pop WHERE ano = (SELECT ano FROM pop ORDER BY abs(ano - (SELECT year(cutoff) FROM w)), ano LIMIT 1)) AS DOUBLE) * 100000, 6) AS incidencia FROM x"
)
def incidence_per_100k(spark, sf):
    a, first, last = cut(spark, sf)
    people, _ = M.reference_population(a.references["population"], None, last.year)
    r = M.incidence_counts(a.view.where(M.inside("data_sintomas", first, last)), a.filters.predicate("SG_UF"))
    return r.withColumn("incidencia", F.round(C.ratio(F.col("casos"), F.lit(people), 100_000.0), 6))


@query(CASES_SQL + POPULATION_SQL + "SELECT p.uf, count(v.k) AS casos, round(count(v.k) / CAST(any_value(p.populacao) AS DOUBLE) * 100000, 6) AS incidencia FROM w, pop p LEFT JOIN v ON v.SG_UF = p.uf AND v.data_sintomas BETWEEN w.first AND w.cutoff WHERE p.ano = 1999 GROUP BY 1")
def incidence_by_nation(spark, sf):
    a, first, last = cut(spark, sf)
    people = a.references["population"].where("ano = 1999")
    counts = a.between(first, last).groupBy(F.col("SG_UF").alias("uf")).agg(F.count("*").alias("casos"))
    return people.join(counts, "uf", "left").select("uf", F.coalesce("casos", F.lit(0)).alias("casos"), F.round(C.ratio(F.coalesce("casos", F.lit(0)), F.col("populacao"), 100_000.0), 6).alias("incidencia"))


SHIFTED = "CAST({d} - to_years(year(cutoff) - {y}) AS DATE)"
BY_YEAR = "(SELECT count(*) FROM v, w WHERE data_sintomas BETWEEN " + SHIFTED.format(d="first", y="{y}") + " AND " + SHIFTED.format(d="cutoff", y="{y}") + ") AS ano_{y}"
BASELINE = "SELECT (SELECT count(*) FROM v, w WHERE data_sintomas BETWEEN first AND cutoff) AS atual, " + ", ".join(BY_YEAR.format(y=y) for y in (1998, 1999, 2000))


@query(CASES_SQL + BASELINE)
def seasonal_baseline_by_year(spark, sf):
    a, first, last = cut(spark, sf)
    return M.baseline_counts(a.rows(), first, last, [1998, 1999, 2000])


@query(CASES_SQL + f", b AS ({BASELINE}), m AS (SELECT atual, list_median(list_filter([ano_1998, ano_1999, ano_2000], lambda x: x > 0)) AS mediana FROM b) SELECT atual, CAST(mediana AS DOUBLE) AS mediana, round((atual - mediana) / mediana * 100, 6) AS excesso FROM m".replace("list_median(", "list_aggregate(").replace("lambda x: x > 0))", "lambda x: x > 0), 'median')"))
def seasonal_excess(spark, sf):
    a, first, last = cut(spark, sf)
    r = M.baseline_counts(a.rows(), first, last, [1998, 1999, 2000])
    years = r.select("atual", F.explode(F.array("ano_1998", "ano_1999", "ano_2000")).alias("n")).where("n > 0")
    return years.groupBy("atual").agg(F.median("n").alias("mediana")).withColumn("excesso", F.round(C.ratio(F.col("atual") - F.col("mediana"), F.col("mediana")), 6))


# Diagnostics


@query(CASES_SQL + ", d AS (SELECT date_diff('day', data_sintomas, data_digitacao) AS x FROM v, w WHERE data_sintomas BETWEEN cutoff - 365 AND cutoff AND data_digitacao IS NOT NULL) SELECT quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, count(*) AS registros FROM d")
def delay_percentiles(spark, sf):
    a, _, last = cut(spark, sf)
    return M.delay_percentiles(a.between(last - 365 * M.DAY, last))


@query(CASES_SQL + "SELECT (SELECT max(data_sintomas) FROM v WHERE data_sintomas <= DATE '2001-12-31') AS sintomas, reference AS digitacao, cutoff AS corte, CAST(DATE '2001-12-31' - cutoff AS INTEGER) AS defasagem FROM w")
def data_currency(spark, sf):
    found = M.data_currency(analysis(spark, sf))
    one = spark.createDataFrame([tuple(found[k] for k in ("sintomas_mais_recentes", "digitacao_mais_recente", "corte", "defasagem_ate_o_corte"))], "a string, b string, c string, d int")
    return one.selectExpr("date(a) as sintomas", "date(b) as digitacao", "date(c) as corte", "d as defasagem")


MEASURES = "count(*) AS casos, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_linestatus = 'F') AS f"


@query(f"WITH j AS (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_linenumber FROM lineitem), u AS (SELECT DISTINCT * FROM j) SELECT 'todas' AS base, {MEASURES} FROM j UNION ALL SELECT 'distintas', {MEASURES} FROM u")
def duplicate_sensitivity(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_linenumber")
    flags = {m: F.lit(False) for m in ("teve_admissao_uti", "vacina_covid_informada", "vacinado_covid")}
    marked = rows.withColumns({"caso_encerrado": F.col("l_returnflag") == "A", "eh_obito_srag": F.col("l_returnflag") == "N", "uti_informado": F.col("l_linestatus") == "F"} | flags)
    return M.sensitivity_counts(marked).select("base", "casos", F.col("caso_encerrado").alias("a"), F.col("eh_obito_srag").alias("n"), F.col("uti_informado").alias("f"))


@query("SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)) AS identicas")
def identical_rows(spark, sf):
    n = Q.identical_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))
    return spark.createDataFrame([(n,)], "identicas bigint")


@query(CASES_SQL + "SELECT SG_UF_NOT, CLASSI_FIN, count(*) AS n FROM v WHERE SG_UF_NOT = 'N05' AND CLASSI_FIN = 2 GROUP BY ALL")
def filter_by_geo_and_class(spark, sf):
    return analysis(spark, sf, "n05", 2).rows().groupBy("SG_UF_NOT", F.col("CLASSI_FIN").cast("int").alias("CLASSI_FIN")).agg(F.count("*").alias("n"))


# Codes, bands, weeks


@query("SELECT code, CASE WHEN code IS NULL THEN 'nao_informado' WHEN code = 1 THEN 'Sim' WHEN code = 2 THEN 'Nao' ELSE 'fora_do_dominio' END AS rotulo, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN CASE WHEN l_linenumber = 1 THEN NULL ELSE 7 END END AS code FROM lineitem) GROUP BY ALL")
def code_labels(spark, sf):
    code = F.expr("case l_returnflag when 'A' then 1 when 'N' then 2 when 'R' then if(l_linenumber = 1, null, 7) end")
    return table(spark, sf, "lineitem").select(code.alias("code")).withColumn("rotulo", C.label(F.col("code"), {1: "Sim", 2: "Nao"}, "nao_informado")).groupBy("code", "rotulo").agg(F.count("*").alias("n"))


COMPLETE = "SELECT '{c}' AS coluna, count(*) AS total, count(*) FILTER ({c} IN ({valid})) AS valid, count(*) FILTER ({ignored}) AS ignored, count(*) FILTER ({c} IS NULL) AS absent, count(*) FILTER ({c} IS NOT NULL AND NOT ({c} IN ({valid})) AND NOT ({ignored})) AS outside FROM f"


@query(CASES_SQL + " UNION ALL ".join(COMPLETE.format(c=c, valid=v, ignored=i) for c, v, i in (("UTI", "1, 2", "UTI = 9"), ("EVOLUCAO", "1, 2, 3", "EVOLUCAO = 9"), ("CLASSI_FIN", "1, 2, 3, 4, 5", "false"))))
def code_completeness_identity(spark, sf):
    return Q.code_completeness(cases(spark, sf), ("UTI", "EVOLUCAO", "CLASSI_FIN")).select("coluna", "total", "valid", "ignored", "absent", "outside")


@query("SELECT faixa, count(*) AS n FROM (SELECT CASE WHEN p_size BETWEEN 0 AND 4 THEN '0-4' WHEN p_size BETWEEN 5 AND 11 THEN '5-11' WHEN p_size BETWEEN 12 AND 17 THEN '12-17' WHEN p_size BETWEEN 18 AND 29 THEN '18-29' WHEN p_size BETWEEN 30 AND 39 THEN '30-39' WHEN p_size BETWEEN 40 AND 49 THEN '40-49' WHEN p_size BETWEEN 50 AND 59 THEN '50-59' END AS faixa FROM part) GROUP BY 1")
def age_band_case(spark, sf):
    return table(spark, sf, "part").groupBy(C.age_band(C.age_years(F.col("p_size"), F.lit(3))).alias("faixa")).agg(F.count("*").alias("n"))


WEEK = "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), a AS (SELECT d, d - CAST(dayofweek(d) AS INTEGER) AS ws FROM o), b AS (SELECT *, CAST(year(ws + 3) AS INTEGER) AS y FROM a), c AS (SELECT *, make_date(y, 1, 4) - CAST(dayofweek(make_date(y, 1, 4)) AS INTEGER) AS w1 FROM b), e AS (SELECT d, y, CAST((ws - w1) // 7 + 1 AS INTEGER) AS n FROM c) "


@query(WEEK + "SELECT y AS ano, n AS semana, y || '-' || lpad(CAST(n AS VARCHAR), 2, '0') AS rotulo, count(*) AS casos FROM e GROUP BY ALL")
def epi_week(spark, sf):
    year, number, name = D.epi_week(F.to_date("o_orderdate"))
    return table(spark, sf, "orders").groupBy(year.cast("int").alias("ano"), number.cast("int").alias("semana"), name.alias("rotulo")).agg(F.count("*").alias("casos"))


@query(WEEK + "SELECT count(*) AS comparadas, count(*) FILTER (n <> week(d)) AS divergentes FROM e")
def epi_week_reconcile(spark, sf):
    """ISO weeks as the published ones, against the weeks that cleaning derives."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("DT_SIN_PRI"), F.weekofyear("o_orderdate").cast("string").alias("SEM_PRI"))
    rows = Q.derive_epi_week(days, Q.Context(2001, TODAY, SETTINGS))
    return rows.agg(F.count_if("__obs_epiweek_compared").alias("comparadas"), F.count_if("__obs_epiweek_mismatch").alias("divergentes"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, last_day(CAST(o_orderdate AS DATE)) AS fim, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS ano_antes, CAST(abs((2000 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) AS INTEGER) AS distancia FROM orders")
def month_arithmetic(spark, sf):
    d = F.col("d")
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return rows.select("d", F.trunc(d, "month").alias("mes"), F.last_day(d).alias("fim"), D.shift_years(d, -1).alias("ano_antes"), D.month_distance(F.date_format(d, "yyyy-MM"), F.lit("2000-06-15").cast("date")).alias("distancia"))


FLAGS = ("flag_data_invalida", "flag_internacao_inconsistente", "flag_uti_inconsistente", "flag_evolucao_inconsistente", "flag_data_implausivel")


@query(CASES_SQL + f"SELECT {', '.join(FLAGS)}, count(*) AS n FROM f GROUP BY ALL")
def coherence_flags(spark, sf):
    return cases(spark, sf).groupBy(*FLAGS).agg(F.count("*").alias("n"))


@query("SELECT ajustes, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantidade' END, CASE WHEN l_discount = 0 THEN 'sem_desconto' END, CASE WHEN l_tax > 0.07 THEN 'imposto' END) AS ajustes FROM lineitem) GROUP BY 1")
def adjustment_codes(spark, sf):
    codes = {"quantidade": F.col("l_quantity") > 45, "sem_desconto": F.col("l_discount") == 0, "imposto": F.col("l_tax") > 0.07}
    rows = Q.gather_codes(Q.noted(table(spark, sf, "lineitem"), codes, {}))
    return rows.groupBy(F.col("ajustes_aplicados").alias("ajustes")).agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d lixo') ELSE strftime(o_orderdate, '%Y%m%d') END AS texto, CASE WHEN o_orderkey % 5 <> 3 THEN CAST(o_orderdate AS DATE) END AS data, count(*) AS n FROM orders GROUP BY ALL")
def date_multi_format_parse(spark, sf):
    f = lambda p: f"date_format(o_orderdate, \"{p}\")"
    text = F.expr(f"case o_orderkey % 5 when 0 then {f('yyyy-MM-dd')} when 1 then {f('dd/MM/yyyy')} when 2 then concat({f('yyyy-MM-dd')}, 'T00:00:00.000Z') when 3 then concat({f('yyyy-MM-dd')}, ' lixo') else {f('yyyyMMdd')} end")
    rows = table(spark, sf, "orders").select(text.alias("texto"))
    return rows.groupBy("texto", D.parse_date(F.col("texto")).alias("data")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 100 AS SMALLINT) WHEN 1 THEN CAST(o_orderkey % 100 AS SMALLINT) WHEN 2 THEN CAST(o_orderkey % 100 AS SMALLINT) WHEN 3 THEN 100 END AS codigo FROM orders")
def nullable_int_cast(spark, sf):
    text = F.expr("case o_orderkey % 6 when 0 then concat(' ', o_orderkey % 100, ' ') when 1 then concat(o_orderkey % 100, '.0') when 2 then concat(o_orderkey % 100, '.7') when 3 then '1e2' when 4 then '65537' else 'X' end")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), C.whole(text).alias("codigo"))


# Drift as data

LINES = "(SELECT year(l_shipdate) AS ano, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS desconto, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag, l_linestatus FROM lineitem)"


def lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("cast(year(l_shipdate) as bigint) as ano", "nullif(l_discount, 0) as desconto", "nullif(l_returnflag, 'R') as flag", "l_linestatus", "l_linenumber", "l_shipdate")


@query(f"SELECT ano, coluna, round(taxa, 6) AS taxa FROM (SELECT ano, 'desconto' AS coluna, count(*) FILTER (desconto IS NULL) / CAST(count(*) AS DOUBLE) * 100 AS taxa FROM {LINES} GROUP BY 1 UNION ALL SELECT ano, 'flag', count(*) FILTER (flag IS NULL) / CAST(count(*) AS DOUBLE) * 100 FROM {LINES} GROUP BY 1)")
def missing_rate_by_column(spark, sf):
    return DR.missing_rates(lines(spark, sf), ["desconto", "flag"], ["ano"]).withColumn("taxa", F.round("taxa", 6))


@query("SELECT DISTINCT l_linenumber AS valor FROM lineitem WHERE year(l_shipdate) = 2000 EXCEPT SELECT DISTINCT l_linenumber FROM lineitem WHERE year(l_shipdate) = 1999 AND l_linenumber < 6")
def new_categories_except(spark, sf):
    """Line numbers read as the codes of a column: what a year brings that neither the one before nor the dictionary (1, 2, 3, 9) has."""
    load = lambda rule, year: DR.observe(lines(spark, sf).where(rule).selectExpr("cast(l_linenumber as string) as EVOLUCAO"), year)
    found = DR.detect(load("ano = 2000", 2000), load("ano = 1999 and l_linenumber < 6", 1999))
    values = [(int(v),) for f in found if f["kind"] == "new_categories" for v in f["detail"].split(", ")]
    return spark.createDataFrame(values, table(spark, sf, "lineitem").selectExpr("l_linenumber as valor").schema)


@query("WITH c AS (SELECT column_name AS k FROM (DESCRIBE customer)), s AS (SELECT column_name AS k FROM (DESCRIBE supplier)) SELECT k AS coluna, 'nova' AS lado FROM c ANTI JOIN s USING (k) UNION ALL SELECT k, 'ausente' FROM s ANTI JOIN c USING (k)")
def header_difference(spark, sf):
    now, before = (DR.Observation(2001, table(spark, sf, t).columns, {}, {}, {}, 0) for t in ("customer", "supplier"))
    side = {"new_columns": "nova", "missing_columns": "ausente"}
    return spark.createDataFrame([(f["column"], side[f["kind"]]) for f in DR.detect(now, before)], "coluna string, lado string")


@query(f"WITH n AS (SELECT ano, count(*) AS n FROM {LINES} GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY ano) AS antes FROM n) SELECT ano, n, antes, CASE WHEN antes IS NULL THEN 'inicio' WHEN (n - antes) / CAST(antes AS DOUBLE) * 100 <= -20 THEN 'ERROR' WHEN (n - antes) / CAST(antes AS DOUBLE) * 100 >= 50 THEN 'WARNING' ELSE 'ok' END AS nivel FROM p")
def record_count_change(spark, sf):
    counts = lines(spark, sf).groupBy("ano").agg(F.count("*").alias("n")).orderBy("ano").collect()  # a row per year
    loads = [DR.Observation(r["ano"], [], {}, {}, {}, r["n"]) for r in counts]
    level = lambda now, before: "inicio" if before is None else next((f["severity"] for f in DR.detect(now, before) if f["kind"] == "record_count_changes"), "ok")
    rows = [(now.year, now.record_count, before and before.record_count, level(now, before)) for before, now in zip([None, *loads], loads)]
    return spark.createDataFrame(rows, "ano bigint, n bigint, antes bigint, nivel string")


# Behind the numbers

CELLS = "(SELECT c_nationkey AS nation, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS classe, count(*) FILTER (o_orderstatus = 'P') AS numerator, count(*) AS denominator FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '2001-07-01' GROUP BY ALL)"


def cells(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '2001-07-01'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy(F.col("c_nationkey").alias("nation"), F.expr("cast(substr(o_orderpriority, 1, 1) as int)").alias("classe")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("numerator"), F.count("*").alias("denominator"))
    return out.withColumn("value", F.round(C.ratio(F.col("numerator"), F.col("denominator")), 6))


@query(f"SELECT nation, classe, denominator, CASE WHEN denominator >= 5 THEN numerator END AS numerator, CASE WHEN denominator >= 5 THEN round(numerator / CAST(denominator AS DOUBLE) * 100, 6) END AS value, CASE WHEN denominator < 5 THEN 'denominator below 5' END AS reason FROM {CELLS}")
def small_cell_suppression(spark, sf):
    return R.suppress_small_cells(cells(spark, sf))


@query(f"SELECT nation, classe, numerator, denominator, round(numerator / CAST(denominator AS DOUBLE) * 100, 6) AS value, numerator < 20 AS instavel FROM {CELLS}")
def rate_reliability(spark, sf):
    return R.mark_unstable(cells(spark, sf))


@query("WITH m AS (SELECT 'case_growth_rate' AS metric, 20.0 AS value UNION ALL SELECT 'mortality_rate', CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) * 100 FROM orders), r(regra, metric, limiar) AS (VALUES ('crescimento_de_casos', 'case_growth_rate', 20.0), ('letalidade', 'mortality_rate', 10.0), ('excesso_sazonal', 'seasonal_excess', 50.0)) SELECT regra, r.metric, CAST(limiar AS DOUBLE) AS limiar, round(CAST(value AS DOUBLE), 6) AS value, coalesce(value > limiar, false) AS disparada, CASE WHEN value IS NULL THEN 'atencao' WHEN value > limiar THEN 'alerta' ELSE 'normal' END AS nivel FROM r LEFT JOIN m ON r.metric = m.metric")
def alert_rules(spark, sf):
    one = table(spark, sf, "orders").agg(C.ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("value")).select(F.lit("mortality_rate").alias("metric"), "value")
    metrics = one.unionByName(spark.createDataFrame([("case_growth_rate", 20.0)], "metric string, value double"))
    return R.evaluate_rules(metrics, spark.createDataFrame(R.rules(SETTINGS), "regra string, metric string, limiar double")).withColumn("value", F.round("value", 6))


@query("WITH h AS (SELECT year(o_orderdate) AS gerado_em, o_orderstatus AS uf, 1 AS classification, 'n' AS metric, count(*) AS value FROM orders GROUP BY ALL) SELECT gerado_em, uf, classification, metric, value, lag(value) OVER (PARTITION BY uf ORDER BY gerado_em) AS anterior, value - lag(value) OVER (PARTITION BY uf ORDER BY gerado_em) AS variacao FROM h")
def history_lag_compare(spark, sf):
    h = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("gerado_em"), F.col("o_orderstatus").alias("uf"), F.lit(1).alias("classification"), F.lit("n").alias("metric")).agg(F.count("*").alias("value"))
    return R.previous_values(h)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return R.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def first_wins_dedupe(spark, sf):
    return R.latest_per_key(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", last=False)


@query("SELECT event_type AS tool, count(*) AS n, round(avg(value), 6) AS media, round(max(value), 6) AS maximo FROM events GROUP BY 1")
def audit_by_tool(spark, sf):
    events = audit_by(table(spark, sf, "events").selectExpr("event_type as tool", "cast(value as double) as duration_ms"), "tool")
    return events.select("tool", F.col("eventos").alias("n"), F.round("duracao_media_ms", 6).alias("media"), F.round("duracao_maxima_ms", 6).alias("maximo"))


# Links and texts

HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"


@query(f"SELECT page_id, host, (" + " OR ".join(f"host = '{d}' OR host LIKE '%.{d}'" for d in X.DOMAINS) + f") AS confiavel FROM (SELECT page_id, {HOST} AS host FROM pages)")
def trusted_domain_filter(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.host(u).alias("host"), X.trusted(u).alias("confiavel"))


CANONICAL = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^?#]+)', 1)), '/+$', '')"


@query(f"SELECT page_id, {CANONICAL} AS canonica FROM pages")
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonica"))


TITLE = r"trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9 ]+', ' ', 'g'))"


@query(f"SELECT page_id, substr(sha256({TITLE} || '|' || {CANONICAL}), 1, 16) AS id FROM pages")
def article_id_hash(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.article_id(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("url")).alias("id"))


@query("SELECT doc_id, (" + " OR ".join(f"contains(t, ' {k} ')" for k in X.TOPICS) + ") AS no_tema " r"FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9 ]+', ' ', 'g')) || ' ' AS t FROM documents)")
def topic_keyword_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.on_topic(F.col("text")).alias("no_tema"))


@query(r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 280) AS trecho FROM pages")
def html_snippet(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.snippet(F.col("html")).alias("trecho"))


@query(r"SELECT doc_id, regexp_matches(text, '\b\d{5}-\d{3}\b') AS cep, regexp_matches(text, '\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b') AS cpf, regexp_matches(text, '\b[1-9]\d{2}[ .]?\d{4}[ .]?\d{4}[ .]?\d{4}\b') AS cns FROM documents")
def pii_findings(spark, sf):
    has = lambda k: F.array_contains(X.find_pii(F.col("text")), k).alias(k)
    return table(spark, sf, "documents").select("doc_id", has("cep"), has("cpf"), has("cns"))


@query()
def pii_mask(spark, sf):
    masked = X.mask_pii(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(masked, 256).alias("masked_sha256"), (masked != F.col("text")).alias("alterado"))


@query(r"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(text, '[\x{00}-\x{08}\x{0B}-\x{1F}\x{7F}-\x{9F}\p{Cf}]', '', 'g') AS t FROM documents)")
def invisible_strip(spark, sf):
    clean = X.strip_invisible(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(clean).cast("bigint").alias("n"), F.md5(clean.cast("binary")).alias("digest"))


@query()
def injection_risk(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.injection_risk(t).alias("risco"), X.injection_findings(t).alias("achados"))


@query()
def request_verdict(spark, sf):
    return G.judge_requests(table(spark, sf, "conversations")).select("conv_id", "turn", "verdict", "risk")


@query(r"SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS frases FROM documents")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("frases"))


@query()
def number_extraction(spark, sf):
    return G.cited_numbers(table(spark, sf, "documents"), "doc_id")


@query()
def evidence_match(spark, sf):
    evidence = table(spark, sf, "part").select(F.col("p_retailprice").alias("value"))
    return G.unsupported_numbers(G.cited_numbers(table(spark, sf, "documents"), "doc_id"), G.evidence_variants(evidence), "doc_id")


@query()
def output_verdict(spark, sf):
    return G.judge_outputs(table(spark, sf, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), F.coalesce("text", F.lit("")).alias("text")), table(spark, sf, "part").select(F.col("p_retailprice").alias("value")), "id")


@query("WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS similarity FROM e, q ORDER BY list_cosine_similarity(e.v, q.v) DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))  # the id is a key: one row
    return N.top_similar(rows.crossJoin(F.broadcast(one)), F.col("q"), 10, tie=["vec_id"]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS antes, 1.0::DOUBLE AS depois FROM embeddings")
def l2_normalise(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("u", V.normalise(F.col("embedding")))
    return rows.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 5).alias("antes"), F.round(V.dot(F.col("u"), F.col("u")), 6).alias("depois"))


@query("SELECT ngrama, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS ngrama FROM (SELECT ' ' || p_name || ' ' AS t FROM part)) GROUP BY 1")
def char_ngrams(spark, sf):
    return table(spark, sf, "part").select(F.explode(V.char_ngrams(F.col("p_name"))).alias("ngrama")).groupBy("ngrama").agg(F.count("*").alias("n"))


@query()
def hashing_embedder(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.hashing_embedding(F.col("text")).alias("embedding"))


@query()
def nfkd_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(V.fold(F.col("text")), 256).alias("folded_sha256"))


# Extracts


@query("SELECT campanha, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'COVID') THEN 'covid19' WHEN NOT contains(t, 'HAEMOPHILUS') AND contains(t, 'GRIPE') THEN 'influenza' END AS campanha FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'VACINA COVID ' WHEN 1 THEN 'GRIPE ' WHEN 2 THEN 'HAEMOPHILUS GRIPE ' ELSE '' END || upper(p_name) AS t FROM part)) GROUP BY 1")
def campaign_classify(spark, sf):
    name = F.concat(F.expr("case p_partkey % 4 when 0 then 'vacina Covid ' when 1 then 'gripe ' when 2 then 'Haemophilus gripe ' else '' end"), F.col("p_name"))
    return table(spark, sf, "part").groupBy(C.campaign(name).alias("campanha")).agg(F.count("*").alias("n"))


@query("SELECT s_nationkey, tipo, CAST(sum(leitos) AS BIGINT) AS leitos FROM (SELECT s_nationkey, 'par' AS tipo, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END AS leitos FROM supplier UNION ALL SELECT s_nationkey, 'impar', CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey ELSE 0 END FROM supplier) WHERE leitos <> 0 GROUP BY ALL")
def unpivot_bed_types(spark, sf):
    """Suppliers as a capacity extract: nations as states, even keys as beds of one type, odd ones as beds of another."""
    names = {"UTI_ADULTO": "par", "UTI_NEONATAL": "impar"}
    states = F.array(*map(F.lit, UF_CODES))
    cells = {c: F.lit("0") for pair in BED_TYPES.values() for c in pair}
    for i, kind in enumerate(names):
        cells[BED_TYPES[kind][0]] = F.when(F.col("s_suppkey") % 2 == i, F.col("s_suppkey").cast("string")).otherwise(F.lit("0"))
    raw = table(spark, sf, "supplier").select(F.lit("199901").alias("COMP"), F.get(states, F.col("s_nationkey").cast("int")).alias("UF"), *(c.alias(k) for k, c in cells.items()))
    kind = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    beds = aggregate_beds(raw, "", "")
    return beds.select((F.array_position(states, F.col("uf")) - 1).alias("s_nationkey"), kind[F.col("tipo_leito")].alias("tipo"), F.col("leitos_existentes").alias("leitos"))
