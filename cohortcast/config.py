"""Run configuration (country + model config) and the run-spec overlay.

``CohortConfig`` holds the settings of one run as numbers.  ``ConfigColumns`` is the same for many runs at once: a table
of settings by country, read from YAML files and overlaid by run specifications (``sources/config_files.py``), whose
columns stand where the numbers would, so that one job serves runs with different windows.  Tables derived from either
(age grids, cohort ranges, run grids) are produced on the executors with ``sequence``/``explode``.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.small import small_side


class Windows:
    """Values that follow from a run's settings, whether these are numbers or columns of a table."""

    @property
    def jump_off(self) -> int:
        return self.last_year - self.T_holdback

    @property
    def n_ages(self) -> int:
        return self.maximum_age - self.minimum_age + 1

    @property
    def n_ages_obs(self) -> int:
        return self.last_data_age - self.first_data_age + 1

    @property
    def data_gap_low(self) -> int:
        return self.first_data_age - self.minimum_age

    @property
    def data_gap_high(self) -> int:
        return self.maximum_age - self.last_data_age

    @property
    def last_insample_cohort(self) -> int:
        return self.jump_off - self.first_data_age

    @property
    def T_insample(self) -> int:
        return self.last_insample_cohort - self.first_full_cohort + 1

    @property
    def T_total(self) -> int:
        return self.T_insample + self.T_forecast

    @property
    def start_time(self) -> int:
        """First index of the time axis (quirk X3: period axis starts at max(1950, first_year))."""
        return self.first_full_cohort if self.time_dimension == "Cohort" else self.first_period

    @property
    def first_period(self) -> int:
        return max(1950, self.first_year)

    def attach(self, df):
        """``df`` with the settings beside each row, where they are a table's."""
        return df


@dataclass(frozen=True)
class CohortConfig(Windows):
    # fixed values: the countries of the reports, in order
    countries: tuple[str, ...] = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    # country config
    first_year: int = 1995
    last_year: int = 2001
    first_full_cohort: int = 1944
    first_data_age: int = 8
    last_data_age: int = 52
    # model config
    model: str = "mixture"
    param_func: tuple[str, str] = ("gamma_density", "weibull_density")
    dispersion: str = "variable"
    minimum_age: int = 6
    maximum_age: int = 55
    time_dimension: str = "Cohort"
    T_holdback: int = 2
    T_forecast: int = 2
    n_dispersion_basis: int = 8
    n_interior_knots: int = 6
    # comparator (freeze-slope) settings
    n_trend: int = 3
    n_holdback: int = 2
    n_predict: int = 2
    n_extrapolate: int = 1
    slope_ages: tuple[int, int] = (14, 49)
    freeze_ages: tuple[int, int] = (14, 50)
    # posterior draws
    n_draws: int = 200
    n_chains: int = 4
    max_treedepth: int = 10
    rhat_threshold: float = 1.05
    pareto_k_threshold: float = 0.7
    seed: int = 20190310

    @property
    def iters_per_chain(self) -> int:
        return self.n_draws // self.n_chains

    def with_(self, **kw) -> "CohortConfig":
        return replace(self, **kw)

    def as_dict(self) -> dict:
        return asdict(self)


class ConfigColumns(Windows):
    """Settings by ``Country`` in ``table`` (columns named like those of ``CohortConfig``), as columns of the rows that
    ``attach`` joined them to."""

    PREFIX = "config_"

    def __init__(self, table: DataFrame) -> None:
        self.table = small_side(table.select("Country", *[F.col(c).alias(self.PREFIX + c) for c in table.columns if c != "Country"]))

    def __getattr__(self, name: str) -> Column:
        if self.PREFIX + name not in self.table.columns:
            raise AttributeError(f"the configuration has no {name}")
        return F.col(self.PREFIX + name)

    @property
    def start_time(self) -> Column:
        return F.when(self.time_dimension == "Cohort", self.first_full_cohort).otherwise(self.first_period)

    @property
    def first_period(self) -> Column:
        return F.greatest(F.lit(1950), self.first_year)

    @property
    def freeze_ages(self) -> tuple[Column, Column]:
        return self.first_freeze_age, self.last_freeze_age

    def attach(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.table.columns[1:]).join(self.table, "Country")


FIXTURE = CohortConfig()

# The three parametric families of the study.
PARAM_TYPES = ("gamma_density", "weibull_density", "hadwiger_density")
DISPERSIONS = ("constant", "variable", "poisson", "var_unsmooth")
