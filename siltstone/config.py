"""Parameters of the analysis, with the reference's values as defaults, and those that suit the TPC-H-like view."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars per unit of each currency.
USD_RATES = {
    "Australian Dollar": 0.72,
    "Bitcoin": 78.33,
    "Brazil Real": 0.20,
    "Canadian Dollar": 0.73,
    "Euro": 1.17,
    "Mexican Peso": 0.06,
    "Ruble": 0.01,
    "Rupee": 0.01,
    "Saudi Riyal": 0.27,
    "Shekel": 0.33,
    "Swiss Franc": 1.27,
    "UK Pound": 1.35,
    "US Dollar": 1.0,
    "Yen": 0.006,
    "Yuan": 0.15,
}


@dataclass(frozen=True)
class Period:
    """Text bounds are closed and compare as text; timestamp bounds are half-open."""

    start: str
    end: str
    text: bool = True

    def holds(self, ts: Column) -> Column:
        if self.text:
            return ts.between(self.start, self.end)
        return (ts >= F.lit(self.start).cast("timestamp_ntz")) & (ts < F.lit(self.end).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Settings:
    currency: str = "US Dollar"
    small_amount: float = 50.0
    period1: Period = Period("2022/09/01", "2022/09/06")
    period2: Period = Period("2022/09/06", "2022/09/15")
    average_fraction: float = 0.01
    #: A kept sender has more than the first and fewer than the second number of distinct destinations.
    destinations: tuple[int, int] = (5, 10)
    path_pairs: int = 5
    #: The drawn variant: at least so many distinct counterparts or intermediaries.
    drawn_least: int = 5
    formats: tuple[str, ...] = ("Wire", "ACH")
    converted_below: float = 1.0
    rates: dict[str, float] = field(default_factory=lambda: dict(USD_RATES))

    @staticmethod
    def for_view() -> Settings:
        return replace(Settings(), period1=Period("1996-01-01", "1998-01-01", False), period2=Period("1998-01-01", "1999-01-01", False), average_fraction=0.05)


@dataclass(frozen=True)
class Run:
    """Where a run reads and writes, from the environment."""

    data_dir: str = "data"
    input_dir: str = "input"
    output_dir: str = "output/siltstone"
    expected_dir: str = "output/expected"
    n_samples: int = 500_000
    n_clients: int = 5
    batch_size: int = 100
    #: This one of so many instances, and where a socket source listens.
    instance_id: int = 1
    instance_total: int = 1
    gateway_host: str = "localhost"
    gateway_port: int = 8080

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Run:
        """Each field from the variable of its name in capitals, where that is set and not empty."""
        env = dict(os.environ) if env is None else env
        return Run(**{f.name: type(f.default)(env[f.name.upper()]) for f in fields(Run) if env.get(f.name.upper())})
