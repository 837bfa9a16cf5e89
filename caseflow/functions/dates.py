"""Dates as columns: parsing, epidemiological weeks, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$"
ISO_BASIC = r"^\d{8}$"
ISO_MONTH = r"^\d{4}-\d{1,2}$"
ISO_YEAR = r"^\d{4}$"
LOCAL_DAY = r"^\d{1,2}/\d{1,2}/\d{4}$"


def strip(c: Column) -> Column:
    """Without any Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def parse_date(c: Column) -> Column:
    """ISO 8601 (day, instant with or without offset, compact, month, year) or day/month/year; null if none fits."""
    x = strip(c.cast("string"))
    at = lambda fmt, value=x: F.to_date(F.try_to_timestamp(value, F.lit(fmt)))
    return (
        F.when(x.rlike(ISO_DAY), at("yyyy-M-d"))
        .when(x.rlike(ISO_INSTANT), F.to_date(x.try_cast("timestamp")))
        .when(x.rlike(ISO_BASIC), at("yyyyMMdd"))
        .when(x.rlike(ISO_MONTH), at("yyyy-M-d", F.concat(x, F.lit("-1"))))
        .when(x.rlike(ISO_YEAR), at("yyyy-M-d", F.concat(x, F.lit("-1-1"))))
        .when(x.rlike(LOCAL_DAY), at("d/M/yyyy"))
    )


def week_start(d: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def epi_week(d: Column) -> tuple[Column, Column, Column]:
    """Year, number and label of the epidemiological week: from Sunday, week 1 holds 4 January."""
    start = week_start(d)
    year = F.year(F.date_add(start, 3))
    number = F.floor(F.datediff(start, week_start(F.make_date(year, F.lit(1), F.lit(4)))) / 7) + 1
    label = F.concat(year.cast("string"), F.lit("-"), F.lpad(number.cast("string"), 2, "0"))
    return year.cast("short"), number.cast("byte"), label


def shift_years(d: Column, years: Column | int) -> Column:
    """The same day of another year; 29 February becomes 28 February."""
    return F.add_months(d, (F.lit(years) if isinstance(years, int) else years) * 12)


def month_distance(competence: Column, d: Column) -> Column:
    """Months between a label ``AAAA-MM`` and a date, without sign."""
    y, m = F.substring(competence, 1, 4).cast("int"), F.substring(competence, 6, 2).cast("int")
    return F.abs((F.year(d) - y) * 12 + F.month(d) - m)


def competence(c: Column) -> Column:
    """``AAAAMM`` as ``AAAA-MM``; null unless the month is 1 to 12."""
    x = strip(F.regexp_replace(c, '"', ""))
    month = F.substring(x, 5, 2)
    return F.when(x.rlike(r"^\d{6}$") & month.between("01", "12"), F.concat(F.substring(x, 1, 4), F.lit("-"), month))


def rfc822(c: Column) -> Column:
    """The instant of a feed's publication date; UTC without an offset."""
    x = F.regexp_replace(F.regexp_replace(strip(c), r"^\w{3},\s*", ""), r"\s(GMT|UTC?)$", " +0000")
    x = F.when(x.rlike(r"[+-]\d{4}$"), x).otherwise(F.concat(x, F.lit(" +0000")))
    return F.try_to_timestamp(x, F.lit("d MMM yyyy HH:mm:ss Z"))


MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")  # fixed values


def local_day(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yy")


def local_month(d: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.lit("/"), F.date_format(d, "yy"))
