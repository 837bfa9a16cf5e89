"""Case rows made from orders and customers, and references from nations, for the parity queries.

Every column is a fixed function of an order, so that the same rows can be written in SQL.
"""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.config import Settings
from caseflow.operators.cleaning import Context, analytic_view, coherence, semantics
from caseflow.operators.filters import Analysis, AnalyticFilters

TODAY = datetime.date(2001, 12, 31)
WINDOW = 180
SETTINGS = replace(Settings(), min_valid_date="1995-02-01", baseline_years=(1996, 1998, 1999, 2000), pandemic_years=(1996,), required_coverage=25)
NATIONS = tuple(f"N{i:02d}" for i in range(25))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey k", "o_custkey ck", "cast(o_orderdate as date) s", "o_orderstatus st", "o_orderpriority p")
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey ck", "c_nationkey nk")
    rows = orders.join(customer, "ck").selectExpr(
        "k", "ck", "s as DT_SIN_PRI", "date_add(s, cast(k % 40 as int)) as DT_DIGITA", "if(st = 'O', null, date_add(s, cast(k % 30 as int))) as DT_EVOLUCA",
        "if(st = 'F', date_add(s, cast(k % 60 as int)), null) as DT_ENCERRA",
        "cast(case when k % 11 = 0 then null when k % 3 = 0 then 9 else k % 3 end as smallint) as UTI",
        "cast(case k % 4 when 0 then 1 when 1 then 2 when 2 then 9 end as smallint) as HOSPITAL",
        "cast(case st when 'F' then case when k % 5 = 0 then 2 when k % 7 = 0 then 3 else 1 end when 'P' then 9 end as smallint) as EVOLUCAO",
        "cast(substr(p, 1, 1) as smallint) as CLASSI_FIN", "cast(case when k % 5 = 0 then null when k % 5 = 4 then 9 else k % 5 end as smallint) as SUPORT_VEN",
        "cast(if(k % 10 = 0, 1, 2) as smallint) as NOSOCOMIAL", "cast(k % 4 + 1 as smallint) as CRITERIO",
        "cast(case k % 6 when 0 then 1 when 1 then 2 when 2 then 9 end as smallint) as VACINA", "cast(case k % 5 when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 9 end as smallint) as VACINA_COV",
        "concat('N', lpad(cast(nk as string), 2, '0')) as SG_UF_NOT", "if(k % 19 = 0, null, concat('N', lpad(cast((nk + k % 2) % 25 as string), 2, '0'))) as SG_UF",
    )
    rows = rows.withColumn("DT_ENTUTI", F.expr("if(UTI = 1, date_add(DT_SIN_PRI, cast(k % 5 - if(k % 17 = 0, 10, 0) as int)), null)"))
    return rows.withColumns(
        {
            "DT_SAIDUTI": F.expr("if(UTI = 1 and k % 4 != 0, date_add(DT_ENTUTI, cast(ck % 20 as int)), null)"),
            "DT_INTERNA": F.expr("if(HOSPITAL = 1 and k % 13 != 0, date_add(DT_SIN_PRI, cast(k % 3 - 1 as int)), null)"),
        }
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = Context(2001, TODAY, SETTINGS)
    rows = semantics(coherence(raw_cases(spark, sf_dir), context))
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("semana_epi", "semana_epi_ano", "semana_epi_num")} | {"mes_sintomas": F.date_format("DT_SIN_PRI", "yyyy-MM")})


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "customer").groupBy(F.expr("concat('N', lpad(cast(c_nationkey as string), 2, '0'))").alias("uf")).agg((F.count("*") * 100).alias("n"))
    return per.select("uf", F.explode(F.array(F.lit(1999), F.lit(2003))).alias("ano"), "n").select("uf", "ano", (F.col("n") + F.col("ano") - 1999).alias("populacao"))


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    per = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = nation.join(per, "n_nationkey", "left").select(F.expr("concat('N', lpad(cast(n_nationkey as string), 2, '0'))").alias("uf"), "n_nationkey", (F.coalesce("n", F.lit(0)) + 5).alias("beds"))
    months = F.array(*map(F.lit, ("2000-12", "2001-05", "2001-11")))
    rows = rows.select("*", F.explode(months).alias("competencia")).where("not (competencia = '2001-11' and n_nationkey = 3)")
    rows = rows.select("*", F.explode(F.array(F.lit("UTI_ADULTO"), F.lit("UTI_PEDIATRICA"), F.lit("UTI_NEONATAL"))).alias("tipo_leito"))
    return rows.selectExpr("uf", "competencia", "tipo_leito", "beds as leitos_existentes", "beds div 2 as leitos_sus", "'CNES' as fonte", "'' as url", "'2001-12-01' as data_extracao")


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference of doses by nation and part size as campaign."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy((F.col("p_size") % 4).alias("c"), (F.col("l_suppkey") % 25).alias("u")).agg(F.count("*").alias("doses"))
    return rows.selectExpr(
        "concat('N', lpad(cast(u as string), 2, '0')) as uf", "2001 as ano", "concat('campanha', cast(c as string)) as campanha", "doses as doses_aplicadas", "if(c = 1 or (c = 2 and u = 7), null, doses * 2) as populacao_alvo",
        "if(u % 2 = 0, 'a', 'b') as fonte", "'' as url", "cast(null as string) as data_extracao", "c != 3 or u != 5 as periodo_completo",
    )


def analysis(spark: SparkSession, sf_dir: str, uf: str | None = None, classification: int | None = None) -> Analysis:
    references = {"population": population(spark, sf_dir), "capacity": capacity(spark, sf_dir), "vaccination": doses(spark, sf_dir)}
    return Analysis(analytic_view(cases(spark, sf_dir)), TODAY, SETTINGS, AnalyticFilters(uf, classification, NATIONS), references)


#: The same rows in SQL: ``v`` is the analytic view, ``f`` its rows before the time axis is checked, ``w`` the windows.
CASES_SQL = """WITH r0 AS (
  SELECT o_orderkey AS k, o_custkey AS ck, CAST(o_orderdate AS DATE) AS s, o_orderstatus AS st, o_orderpriority AS p, c_nationkey AS nk
  FROM orders JOIN customer ON o_custkey = c_custkey),
r1 AS (SELECT k, ck, s AS DT_SIN_PRI, s + CAST(k % 40 AS INTEGER) AS DT_DIGITA,
  CASE WHEN st = 'O' THEN NULL ELSE s + CAST(k % 30 AS INTEGER) END AS DT_EVOLUCA,
  CASE WHEN st = 'F' THEN s + CAST(k % 60 AS INTEGER) END AS DT_ENCERRA,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN 9 ELSE k % 3 END AS UTI,
  CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 9 END AS HOSPITAL,
  CASE st WHEN 'F' THEN CASE WHEN k % 5 = 0 THEN 2 WHEN k % 7 = 0 THEN 3 ELSE 1 END WHEN 'P' THEN 9 END AS EVOLUCAO,
  CAST(substr(p, 1, 1) AS INTEGER) AS CLASSI_FIN, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 4 THEN 9 ELSE k % 5 END AS SUPORT_VEN,
  CASE WHEN k % 10 = 0 THEN 1 ELSE 2 END AS NOSOCOMIAL, k % 4 + 1 AS CRITERIO,
  CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 9 END AS VACINA, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 9 END AS VACINA_COV,
  'N' || lpad(CAST(nk AS VARCHAR), 2, '0') AS SG_UF_NOT, CASE WHEN k % 19 = 0 THEN NULL ELSE 'N' || lpad(CAST((nk + k % 2) % 25 AS VARCHAR), 2, '0') END AS SG_UF
  FROM r0),
r2 AS (SELECT *, CASE WHEN UTI = 1 THEN DT_SIN_PRI + CAST(k % 5 - CASE WHEN k % 17 = 0 THEN 10 ELSE 0 END AS INTEGER) END AS DT_ENTUTI,
  CASE WHEN HOSPITAL = 1 AND k % 13 <> 0 THEN DT_SIN_PRI + CAST(k % 3 - 1 AS INTEGER) END AS DT_INTERNA FROM r1),
r3 AS (SELECT *, CASE WHEN UTI = 1 AND k % 4 <> 0 THEN DT_ENTUTI + CAST(ck % 20 AS INTEGER) END AS DT_SAIDUTI FROM r2),
f AS (SELECT *,
  coalesce(DT_SIN_PRI < DATE '1995-02-01' OR DT_SIN_PRI > DT_DIGITA, false) AS flag_data_invalida,
  (coalesce(DT_INTERNA < DT_SIN_PRI, false) AND NOT coalesce(NOSOCOMIAL = 1, false)) OR (coalesce(HOSPITAL = 1, false) AND DT_INTERNA IS NULL) AS flag_internacao_inconsistente,
  coalesce(DT_ENTUTI < DT_SIN_PRI, false) OR coalesce(DT_SAIDUTI < DT_ENTUTI, false) OR (coalesce(UTI = 1, false) AND DT_ENTUTI IS NULL) OR (DT_SAIDUTI IS NOT NULL AND DT_ENTUTI IS NULL) AS flag_uti_inconsistente,
  coalesce(DT_EVOLUCA < DT_SIN_PRI, false) OR (coalesce(EVOLUCAO IN (1, 2, 3), false) AND DT_EVOLUCA IS NULL) AS flag_evolucao_inconsistente,
  list_bool_or(list_transform([DT_SIN_PRI, DT_INTERNA, DT_ENTUTI, DT_SAIDUTI, DT_EVOLUCA, DT_ENCERRA, DT_DIGITA],
    lambda d: coalesce(d < DATE '1995-02-01' OR d > DATE '2001-12-31' OR d > DT_DIGITA + 365, false))) AS flag_data_implausivel
  FROM r3),
v AS (SELECT *, DT_SIN_PRI AS data_sintomas, DT_DIGITA AS data_digitacao, DT_EVOLUCA AS data_evolucao, DT_ENCERRA AS data_encerramento, DT_ENTUTI AS data_entrada_uti, DT_SAIDUTI AS data_saida_uti,
  SG_UF AS uf_residencia, coalesce(EVOLUCAO IN (1, 2, 3), false) AS caso_encerrado, coalesce(EVOLUCAO = 2, false) AS eh_obito_srag, coalesce(UTI IN (1, 2), false) AS uti_informado,
  coalesce(UTI = 1, false) AS teve_admissao_uti, coalesce(UTI = 1, false) AND DT_ENTUTI IS NOT NULL AND NOT flag_uti_inconsistente AS estadia_uti_utilizavel,
  coalesce(HOSPITAL = 1, false) AS foi_hospitalizado, coalesce(HOSPITAL IN (1, 2), false) AS hospitalizacao_informada,
  coalesce(VACINA_COV IN (1, 2), false) AS vacina_covid_informada, coalesce(VACINA_COV = 1, false) AS vacinado_covid,
  coalesce(VACINA IN (1, 2), false) AS vacina_influenza_informada, coalesce(VACINA = 1, false) AS vacinado_influenza
  FROM f WHERE NOT flag_data_invalida),
w0 AS (SELECT max(data_digitacao) AS reference FROM v WHERE data_digitacao <= DATE '2001-12-31'),
w AS (SELECT reference, reference - 21 AS cutoff, reference - 21 - 179 AS first FROM w0)
"""
CAPACITY_SQL = """, cap AS (
  SELECT uf, competencia, tipo_leito, beds AS leitos_existentes, beds // 2 AS leitos_sus FROM (
    SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS uf, n_nationkey, 5 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS beds FROM nation) x
  CROSS JOIN (VALUES ('2000-12'), ('2001-05'), ('2001-11')) m(competencia) CROSS JOIN (VALUES ('UTI_ADULTO'), ('UTI_PEDIATRICA'), ('UTI_NEONATAL')) t(tipo_leito)
  WHERE NOT (competencia = '2001-11' AND n_nationkey = 3))
"""
POPULATION_SQL = """, pop AS (
  SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS uf, ano, count(*) * 100 + ano - 1999 AS populacao FROM customer CROSS JOIN (VALUES (1999), (2003)) y(ano) GROUP BY c_nationkey, ano)
"""
DOSES_SQL = """, d0 AS (SELECT p_size % 4 AS c, l_suppkey % 25 AS u, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
dose AS (SELECT 'N' || lpad(CAST(u AS VARCHAR), 2, '0') AS uf, 'campanha' || CAST(c AS VARCHAR) AS campanha, n AS doses, CASE WHEN c = 1 OR (c = 2 AND u = 7) THEN NULL ELSE n * 2 END AS alvo,
  CASE WHEN u % 2 = 0 THEN 'a' ELSE 'b' END AS fonte, (c <> 3 OR u <> 5) AS completo FROM d0)
"""
