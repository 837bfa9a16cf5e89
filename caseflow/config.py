"""Parameters of the analysis, each with its range, read from the environment where set."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    reporting_lag_days: int = 21
    growth_window_days: int = 30
    icu_stay_cap_percentile: float = 0.95
    icu_stay_cap_days: int | None = None
    min_cell_size: int = 5
    baseline_years: tuple[int, ...] = (2022, 2023, 2024)
    baseline_min_years: int = 2
    pandemic_years: tuple[int, ...] = (2020, 2021)
    icu_capacity_max_lag_months: int = 6
    alert_growth_pct: float = 20.0
    alert_mortality_pct: float = 10.0
    alert_excess_pct: float = 50.0
    news_max_age_days: int = 45
    news_max_results: int = 12
    drift_missing_rate_pp: float = 5.0
    drift_drop_pct: float = 20.0
    drift_growth_pct: float = 50.0
    drift_unreadable_pct: float = 0.5
    drift_min_records: int = 100
    drift_category_cap: int = 64
    drift_max_missing_pct: dict[str, float] = field(default_factory=lambda: {"DT_SIN_PRI": 5.0, "DT_DIGITA": 60.0})
    min_valid_date: str = "2019-01-01"
    max_days_after_entry: int = 365
    required_coverage: int = 27
    outcome_maturity_percentile: float = 0.90
    outcome_maturity_cap_days: int = 120
    materiality_pp: float = 0.5
    stable_events: int = 20

    def __post_init__(self) -> None:
        if not 0 <= self.reporting_lag_days <= 90:
            raise ValueError("reporting_lag_days lies between 0 and 90")
        if not 1 <= self.growth_window_days <= 365:
            raise ValueError("growth_window_days lies between 1 and 365")

    @classmethod
    def from_env(cls) -> Settings:
        found = {}
        for f in fields(cls):
            raw = os.environ.get(f.name.upper())
            if raw is not None and f.type in ("int", "float", "int | None"):
                found[f.name] = float(raw) if f.type == "float" else int(raw)
        return cls(**found)
