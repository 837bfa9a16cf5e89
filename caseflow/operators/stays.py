"""Intervals in a unit: imputed ends, daily census, completeness.

The census does not join days to intervals: a clipped interval is spread into its days, which are
counted by a hash aggregate, and the calendar fills the gaps.  The work is in proportion to the days that
intervals share with the window.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.codes import ratio
from caseflow.operators.filters import Analysis, AnalyticFilters
from caseflow.operators.series import calendar


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("estadia_uti_utilizavel")


def cap_percentile(rows: DataFrame, p: float) -> DataFrame:
    """One row: percentile of recorded stays in days, and their number."""
    days = F.datediff("data_saida_uti", "data_entrada_uti")
    complete = usable(rows).where("data_saida_uti is not null and data_saida_uti >= data_entrada_uti")
    return complete.agg(F.percentile(days, F.lit(p)).alias("percentil"), F.count("*").alias("estadias"))


def stay_cap(a: Analysis) -> dict:
    """Days that an imputed stay lasts at most, and where the number is from."""
    if a.settings.icu_stay_cap_days is not None:
        return {"dias": a.settings.icu_stay_cap_days, "origem": "configurado"}
    row = cap_percentile(a.rows(), a.settings.icu_stay_cap_percentile).first()
    if row["percentil"] is None:
        if a.filters.uf is None and a.filters.classification is None:
            return {"dias": 0, "origem": "sem estadias completas na base"}
        return stay_cap(a.filtered(AnalyticFilters()))
    return {"dias": max(1, round(row["percentil"])), "origem": f"percentil de {row['estadias']} estadias com saida registrada"}


def stay_end(cap: int, cutoff: datetime.date) -> Column:
    """The recorded end; else the outcome, else open, both up to the cap; never behind the cutoff."""
    longest = F.date_add("data_entrada_uti", cap)
    return F.least(F.coalesce("data_saida_uti", F.least("data_evolucao", longest), longest), F.lit(cutoff))


def stays(rows: DataFrame, cap: int, cutoff: datetime.date) -> DataFrame:
    return usable(rows).select(
        F.col("data_entrada_uti").alias("entrada"),
        stay_end(cap, cutoff).alias("saida"),
        F.col("data_saida_uti").isNull().alias("imputada"),
        (F.col("data_saida_uti").isNull() & F.col("data_evolucao").isNotNull()).alias("por_evolucao"),
        (F.col("data_saida_uti").isNull() & F.col("data_evolucao").isNull()).alias("em_aberto"),
        (F.col("data_saida_uti").isNull() & (F.coalesce("data_evolucao", F.lit(cutoff)) > F.date_add("data_entrada_uti", cap))).alias("truncada"),
    )


def covered_days(intervals: DataFrame, start: str, end: str, first: datetime.date, last: datetime.date) -> DataFrame:
    """A row, ``dia`` and the other columns, for each day of the window in each interval; ends count."""
    a, b = F.col(start), F.col(end)
    inside = intervals.where((a <= F.lit(last)) & (b >= F.lit(first)) & (b >= a))
    return inside.select(F.explode(F.sequence(F.greatest(a, F.lit(first)), F.least(b, F.lit(last)))).alias("dia"), *(c for c in intervals.columns if c not in (start, end)))


def census(rows: DataFrame, cap: int, first: datetime.date, last: datetime.date) -> DataFrame:
    """``dia, pacientes, imputados`` for every day of the window."""
    days = covered_days(stays(rows, cap, last).select("entrada", "saida", "imputada"), "entrada", "saida", first, last)
    counts = days.groupBy("dia").agg(F.count("*").alias("pacientes"), F.count_if("imputada").alias("imputados"))
    filled = calendar(rows.sparkSession, first, last).join(counts, "dia", "left")
    return filled.select("dia", F.coalesce("pacientes", F.lit(0)).cast("bigint").alias("pacientes"), F.coalesce("imputados", F.lit(0)).cast("bigint").alias("imputados"))


def with_imputed_share(series: DataFrame) -> DataFrame:
    return series.withColumn("percentual_imputado", ratio(F.col("imputados"), F.col("pacientes")))


def completeness(rows: DataFrame, cap: int, first: datetime.date, last: datetime.date) -> DataFrame:
    """How the ends of the stays in the window were found."""
    inside = stays(rows, cap, last).where((F.col("entrada") <= F.lit(last)) & (F.col("saida") >= F.lit(first)))
    return inside.agg(
        F.count("*").alias("estadias"),
        F.count_if(~F.col("imputada")).alias("saida_registrada"),
        F.count_if("por_evolucao").alias("por_evolucao"),
        F.count_if("em_aberto").alias("em_aberto"),
        F.count_if("truncada").alias("truncadas"),
    )
