"""Series over a calendar without gaps, and what is read from them."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.functions.codes import ratio


def calendar(spark: SparkSession, first: datetime.date | Column, last: datetime.date | Column, step: str = "day", name: str = "dia") -> DataFrame:
    """Every day, or the first of every month, from one date to another."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    if step == "month":
        a, b = F.trunc(a, "month"), F.trunc(b, "month")
    return spark.range(1).select(F.explode(F.sequence(a, b, F.expr(f"interval 1 {step}"))).alias(name))


def zero_filled(counts: DataFrame, days: DataFrame, key: str = "dia", value: str = "casos") -> DataFrame:
    """The calendar with counts; a day without rows is a real zero.  Both sides have a row per point at most."""
    return days.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("bigint").alias(value))


def daily_counts(rows: DataFrame, day: str, first: datetime.date, last: datetime.date) -> DataFrame:
    inside = rows.where(F.col(day).between(F.lit(first), F.lit(last)))
    return zero_filled(inside.groupBy(F.col(day).alias("dia")).agg(F.count("*").alias("casos")), calendar(rows.sparkSession, first, last))


def monthly_counts(rows: DataFrame, day: str, cutoff: datetime.date, months: int) -> DataFrame:
    """``mes, casos, parcial`` of the last months up to the cutoff; the last one is partial unless the cutoff ends it."""
    last = F.trunc(F.lit(cutoff), "month")
    first = F.add_months(last, 1 - months)
    inside = rows.where((F.col(day) >= first) & (F.col(day) <= F.lit(cutoff)))
    counts = inside.groupBy(F.trunc(day, "month").alias("mes")).agg(F.count("*").alias("casos"))
    filled = zero_filled(counts, calendar(rows.sparkSession, first, last, "month", "mes"), "mes")
    return filled.withColumn("parcial", F.last_day("mes") > F.lit(cutoff))


def summary(series: DataFrame, value: str = "casos") -> DataFrame:
    return series.agg(F.sum(value).alias("total"), F.avg(value).alias("media"), F.max(value).alias("maximo"), F.min(value).alias("minimo"), F.count("*").alias("pontos"))


def moving_average(series: DataFrame, key: str = "dia", value: str = "casos", width: int = 7) -> DataFrame:
    """Mean of the point and those before it, up to ``width``.  A series has one row per calendar point."""
    return series.withColumn("media_movel", F.avg(value).over(W.orderBy(key).rowsBetween(1 - width, 0)))


def peak(series: DataFrame, key: str = "dia", value: str = "casos") -> DataFrame:
    """The largest point; the earliest of equals."""
    return series.orderBy(F.desc(value), key).limit(1).select(F.col(key).alias("pico_em"), F.col(value).alias("pico"))


def trend(current: Column, previous: Column, band: float = 8.0) -> Column:
    """Rising, falling or stable within a band of per cent; from nothing to something is rising."""
    change = ratio(current - previous, previous)
    return (
        F.when(previous == 0, F.when(current > 0, F.lit("alta")).otherwise(F.lit("estavel")))
        .when(F.abs(change) < band, F.lit("estavel"))
        .when(change > 0, F.lit("alta"))
        .otherwise(F.lit("queda"))
    )


def week_over_week(series: DataFrame, key: str = "dia", value: str = "casos", width: int = 7) -> DataFrame:
    """Means of the last points and of those before, with change and trend."""
    placed = series.withColumn("__n", F.row_number().over(W.orderBy(F.desc(key))))
    means = placed.agg(
        F.avg(F.when(F.col("__n") <= width, F.col(value))).alias("atual"), F.avg(F.when(F.col("__n").between(width + 1, 2 * width), F.col(value))).alias("anterior")
    )
    return means.select("atual", "anterior", ratio(F.col("atual") - F.col("anterior"), F.col("anterior")).alias("variacao_pct"), trend(F.col("atual"), F.col("anterior")).alias("tendencia"))


def half_over_half(series: DataFrame, key: str = "mes", value: str = "casos") -> DataFrame:
    """Sums of the first and second half of the complete months (the odd one out at the end is left out)."""
    whole = series.where("not parcial").withColumn("__n", F.row_number().over(W.orderBy(key))).withColumn("__half", F.floor(F.count("*").over(W.partitionBy()) / 2))
    sums = whole.agg(
        F.sum(F.when(F.col("__n") <= F.col("__half"), F.col(value))).alias("primeira"),
        F.sum(F.when((F.col("__n") > F.col("__half")) & (F.col("__n") <= 2 * F.col("__half")), F.col(value))).alias("segunda"),
    )
    return sums.select("primeira", "segunda", ratio(F.col("segunda") - F.col("primeira"), F.col("primeira")).alias("variacao_pct"), trend(F.col("segunda"), F.col("primeira")).alias("tendencia"))


def ends(series: DataFrame, key: str = "dia", n: int = 3) -> DataFrame:
    """The first and last points."""
    placed = series.withColumns({"__a": F.row_number().over(W.orderBy(key)), "__b": F.row_number().over(W.orderBy(F.desc(key)))})
    return placed.where((F.col("__a") <= n) | (F.col("__b") <= n)).drop("__a", "__b")
