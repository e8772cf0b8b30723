"""Throughput of an action, measured in the same pass."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Throughput:
    rows: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0


def measured(df: DataFrame, action: Callable[[DataFrame], object]) -> Throughput:
    """Runs action on df; the rows that passed and the time. Rows are counted as they pass, not by a second job."""
    seen, began = Observation(), time.monotonic()
    action(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return Throughput(seen.get["n"], time.monotonic() - began)
