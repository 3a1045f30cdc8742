"""Registries: channel specs and the named transforms that callers may extend."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

SPEC_SCHEMA = "name string, topic string, unit string, low double, high double, nominal_hz double, role string"
ROLES = ("command", "context", "response", "truth")


@dataclass(frozen=True)
class ChannelSpec:
    """One registered channel: where it comes from, its valid range, natural rate and role."""

    name: str
    topic: str
    unit: str
    low: float
    high: float
    nominal_hz: float
    role: str

    def __post_init__(self) -> None:
        if not self.name or not self.topic:
            raise ValueError("name and topic are required")
        if not (math.isfinite(self.low) and math.isfinite(self.high) and self.low < self.high):
            raise ValueError(f"{self.name}: range must be finite and increasing")
        if not self.nominal_hz > 0:
            raise ValueError(f"{self.name}: rate must be positive")
        if self.role not in ROLES:
            raise ValueError(f"{self.name}: role must be one of {ROLES}")

    def tolerance(self, periods: float = 1.5) -> float:
        return periods / self.nominal_hz


def channel_table(spark: SparkSession, specs: Sequence[ChannelSpec]) -> DataFrame:
    names = [s.name for s in specs]
    if len(set(names)) != len(names):
        raise ValueError("channel names must be unique")
    return spark.createDataFrame([astuple(s) for s in specs], SPEC_SCHEMA)
