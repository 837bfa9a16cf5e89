"""Closed-domain filters and the time anchor of every window."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.config import Settings
from caseflow.schema import UF_CODES


class InvalidFilterError(ValueError):
    """A filter value outside its domain."""


@dataclass(frozen=True)
class AnalyticFilters:
    """A state and a final classification, both optional, typed and bound as literals."""

    uf: str | None = None
    classification: int | None = None
    domain: tuple[str, ...] = field(default=UF_CODES, repr=False)

    def __post_init__(self) -> None:
        if self.uf is not None:
            uf = self.uf.strip().upper()
            if uf not in self.domain:
                raise InvalidFilterError(f"unknown state {self.uf!r}")
            object.__setattr__(self, "uf", uf)
        if self.classification is not None and (isinstance(self.classification, bool) or self.classification not in range(1, 6)):
            raise InvalidFilterError("the final classification lies between 1 and 5")

    def predicate(self, uf_dimension: str = "SG_UF_NOT") -> Column:
        out = F.lit(True)
        if self.uf is not None:
            out = out & (F.col(uf_dimension) == self.uf)
        if self.classification is not None:
            out = out & (F.col("CLASSI_FIN") == self.classification)
        return out

    def to_dict(self) -> dict:
        return {"uf": self.uf, "classification": self.classification}


class EmptyBaseError(ValueError):
    """No entry date to anchor windows at."""


def reference_date_frame(view: DataFrame, today: datetime.date) -> DataFrame:
    """One row: the latest entry date that is not in the future."""
    return view.where(F.col("data_digitacao") <= F.lit(today)).agg(F.max("data_digitacao").alias("reference"))


@dataclass
class Analysis:
    """A view with its windows: the anchor is read once and shared by all operators."""

    view: DataFrame
    today: datetime.date
    settings: Settings = Settings()
    filters: AnalyticFilters = AnalyticFilters()
    references: dict[str, DataFrame] = field(default_factory=dict)
    _reference: datetime.date | None = None

    @property
    def reference(self) -> datetime.date:
        if self._reference is None:
            self._reference = reference_date_frame(self.view, self.today).first()[0]
            if self._reference is None:
                raise EmptyBaseError("no row has an entry date up to today")
        return self._reference

    @property
    def cutoff(self) -> datetime.date:
        return self.reference - datetime.timedelta(days=self.settings.reporting_lag_days)

    def window(self, days: int | None = None) -> tuple[datetime.date, datetime.date]:
        days = self.settings.growth_window_days if days is None else days
        return self.cutoff - datetime.timedelta(days=days - 1), self.cutoff

    def rows(self, uf_dimension: str = "SG_UF_NOT") -> DataFrame:
        return self.view.where(self.filters.predicate(uf_dimension))

    def between(self, first: datetime.date, last: datetime.date) -> DataFrame:
        return self.rows().where(F.col("data_sintomas").between(F.lit(first), F.lit(last)))

    def filtered(self, filters: AnalyticFilters) -> Analysis:
        return Analysis(self.view, self.today, self.settings, filters, self.references, self._reference)
