"""Coded values, ages and ratios as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.dates import blank_to_null, strip
from caseflow.schema import AGE_BANDS, AGE_RANGE, AGE_UNIT_DOMAIN, CAMPAIGNS, NOT_INFLUENZA

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def whole(c: Column, kind: str = "smallint") -> Column:
    """A whole number from text such as ``1``, ``1.0``, ``1.5`` (cut to 1) or ``1e2``; null if unreadable or out of range."""
    x = strip(c.cast("string"))
    value = F.when(x.rlike(NUMBER), x.try_cast("double"))
    most = {"tinyint": 2**7, "smallint": 2**15, "int": 2**31, "bigint": 2**63}[kind]
    cut = F.signum(value) * F.floor(F.abs(value)).cast("double")
    return F.when((cut >= float(-most)) & (cut < float(most)), cut).cast(kind)


def tolerant_int(c: Column) -> Column:
    """A count from an extract: 0 if empty or unreadable."""
    x = strip(F.regexp_replace(c.cast("string"), '"', ""))
    return F.coalesce(F.when(x.rlike(NUMBER), x.try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))


def tolerant_bool(c: Column) -> Column:
    """True for the usual words of agreement; anything else, unknown included, is false."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("true", "1", "sim", "s", "yes", "y", "verdadeiro"), F.lit(False))


def is_code(c: Column, *codes: int) -> Column:
    """Strict membership, never null."""
    return F.coalesce(c.isin(*codes), F.lit(False))


def label(c: Column, mapping: dict[int, str], absent: str, unknown: str = "fora_do_dominio") -> Column:
    out = F.when(c.isNull(), F.lit(absent))
    for code, text in mapping.items():
        out = out.when(c == code, F.lit(text))
    return out.otherwise(F.lit(unknown))


def normal_text(c: Column) -> Column:
    return F.upper(blank_to_null(c))


def age_years(amount: Column, unit: Column) -> Column:
    """Age in years by its unit: 1 day, 2 month, 3 year."""
    n = amount.cast("double")
    return F.when(unit == 1, n / 365.25).when(unit == 2, n / 12).when(unit == 3, n)


def age_outside_unit(amount: Column, unit: Column) -> Column:
    out = F.lit(False)
    for code, (low, high) in AGE_UNIT_DOMAIN.items():
        out = out | ((unit == code) & ((amount < low) | (amount > high)))
    return F.coalesce(out, F.lit(False))


def age_outside_range(years: Column) -> Column:
    return F.coalesce((years < AGE_RANGE[0]) | (years > AGE_RANGE[1]), F.lit(False))


def age_band(years: Column) -> Column:
    """Bands of whole years; what lies between two of them has none."""
    out = F.lit(None).cast("string")
    for low, high, text in reversed(AGE_BANDS):
        out = F.when(years.between(low, high), F.lit(text)).otherwise(out)
    return out


def ratio(n: Column, d: Column, factor: float = 100.0) -> Column:
    """n / d * factor as a double; null without a denominator."""
    return n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)) * F.lit(factor)


def campaign(description: Column) -> Column:
    """The campaign of a vaccine's name: covid first; a bacterium's name is no influenza."""
    x = F.upper(F.coalesce(description, F.lit("")))
    has = lambda words: x.rlike("|".join(words))
    return F.when(has(CAMPAIGNS["covid19"]), F.lit("covid19")).when(~F.contains(x, F.lit(NOT_INFLUENZA)) & has(CAMPAIGNS["influenza"]), F.lit("influenza"))
