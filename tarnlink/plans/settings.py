"""Settings from the session, then the environment, then defaults. Secrets never have defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    register_dir: str
    web_dir: str
    target_dir: str
    threshold: float

    @classmethod
    def of(cls, spark: SparkSession, environ: dict[str, str] | None = None) -> Settings:
        env = os.environ if environ is None else environ

        def get(name: str, default: str) -> str:
            return spark.conf.get(f"spark.tarnlink.{name}", None) or env.get(f"TARNLINK_{name.upper()}", default)

        return cls(get("register_dir", "data/register"), get("web_dir", "data/web"), get("target_dir", "data/out"), float(get("threshold", "85")))
