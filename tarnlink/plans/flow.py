"""Named stages run in order, each on what the stages before gave."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
Stage = tuple[str, Callable[[SparkSession, dict[str, DataFrame]], DataFrame]]


def _file_of(name: str, folder: str) -> logging.Handler | None:
    """A handler that writes to folder/name.log, unless the log or one above it has handlers already."""
    if log.hasHandlers():
        return None
    os.makedirs(folder, exist_ok=True)
    handler = logging.FileHandler(os.path.join(folder, f"{name}.log"), encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    return handler


def run(spark: SparkSession, stages: list[Stage], given: dict[str, DataFrame] | None = None, log_dir: str | None = None) -> dict[str, DataFrame]:
    """Results by stage name. A stage that fails ends the run: nothing is lost silently. log_dir: a folder on the driver with
    a log file for each stage, where nothing else has set up logging."""
    out = dict(given or {})
    for name, stage in stages:
        began, handler = time.monotonic(), _file_of(name, log_dir) if log_dir else None
        level = log.level
        if handler:
            log.setLevel(logging.INFO)
        try:
            out[name] = stage(spark, out)
            log.info("stage %s planned in %.1f s", name, time.monotonic() - began)
        except Exception:
            log.exception("stage %s failed", name)
            raise
        finally:
            if handler:
                log.removeHandler(handler)
                handler.close()
                log.setLevel(level)
    return out


class Models:
    """SQL models that refer to each other by ref(name), as views or tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sql: dict[str, tuple[str, bool]] = {}

    def add(self, name: str, sql: str, table: bool = False) -> None:
        self.sql[name] = (sql, table)

    def build(self, name: str, seen: tuple[str, ...] = ()) -> DataFrame:
        """The model's rows, after building what it refers to."""
        import re

        if name in seen:
            raise ValueError(f"models refer to each other in a circle: {' -> '.join([*seen, name])}")
        sql, table = self.sql[name]
        for other in re.findall(r"\{\{\s*ref\(\s*'(\w+)'\s*\)\s*\}\}", sql):
            self.build(other, (*seen, name))
        df = self.spark.sql(re.sub(r"\{\{\s*ref\(\s*'(\w+)'\s*\)\s*\}\}", r"\1", sql))
        if table:
            df.write.mode("overwrite").saveAsTable(name)
            return self.spark.table(name)
        df.createOrReplaceTempView(name)
        return df
