"""Formal definitions of the indicators, and the policies that texts are held to."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Definition:
    key: str
    name: str
    formula: str
    numerator: str
    denominator: str
    period: str
    limits: tuple[str, ...] = ()


DEFINITIONS = {
    d.key: d
    for d in (
        Definition("case_growth_rate", "growth of cases", "(current - previous) / previous * 100", "difference of two consecutive windows", "cases of the previous window, as known one lag after its end", "two windows up to the cutoff", ("says nothing about cause",)),
        Definition("mortality_rate", "fatality among closed cases", "deaths / closed * 100", "deaths by the disease", "cases closed by cure or death", "one window up to the cutoff", ("deaths close sooner than cures", "open and ignored outcomes are left out")),
        Definition("icu_admission_rate", "admission to intensive care", "admitted / known * 100", "cases in intensive care", "cases not declared outside hospital that tell", "one window up to the cutoff", ("is no occupancy of beds",)),
        Definition("icu_patient_census", "patients in intensive care per day", "patients present on the day", "stays that cover the day", "-", "one window up to the cutoff", ("ends without record are imputed up to a cap",)),
        Definition("icu_bed_occupancy_rate", "occupancy of beds", "patients on the peak day / beds * 100", "peak of the mature census", "adult and paediatric beds of the nearest month", "a window that ends one cap before the cutoff", ("a floor: other patients are not counted",)),
        Definition("vaccination_coverage_among_cases", "declared vaccination among cases", "vaccinated / known * 100", "cases that declare a dose", "cases that tell", "one window up to the cutoff", ("is no coverage of the population",)),
        Definition("population_vaccination_coverage", "coverage of the population", "doses / target * 100", "doses applied in the campaign", "target, or residents where a target is missing", "the reference's year", ("needs a complete period",)),
        Definition("incidence_rate", "incidence", "cases / residents * 100000", "cases by state of residence", "residents of the nearest reference year", "one window up to the cutoff"),
        Definition("seasonal_excess", "excess over the season", "(current - median) / median * 100", "difference to the median", "median of the same calendar window of baseline years", "one window up to the cutoff", ("pandemic years are left out",)),
        Definition("notification_delay", "delay of entry", "percentiles of entry minus symptoms", "-", "-", "a year up to the cutoff"),
        Definition("duplicate_sensitivity", "sensitivity to identical rows", "indicator over distinct rows minus over all", "-", "-", "one window up to the cutoff", ("identical rows may be different persons",)),
    )
}

#: Key, what it forbids, and where it is enforced.
POLICIES = {
    "medical_advice": ("treatment or diagnosis of a person", ("request", "output")),
    "sensitive_data": ("records or identifiers of persons", ("request", "output", "schema")),
    "prompt_injection": ("instructions aimed at the system", ("request", "news")),
    "evidence_binding": ("numbers without evidence, causes without source", ("output",)),
    "closed_catalogue": ("queries other than those of the catalogue", ("tools",)),
    "small_cells": ("values over fewer cases than the least cell", ("tools",)),
    "unavailable_is_not_zero": ("zero where there is no denominator", ("indicators",)),
    "minimisation": ("columns that no indicator needs", ("reading",)),
}
