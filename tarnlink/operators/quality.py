"""Data-quality checks, metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unused


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of values that occur more than once; nulls don't count."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, failures): nulls of each column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "failures")


def orphans(child: DataFrame, parent: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows of child whose key (child column, parent column, ...) is set throughout and isn't in parent."""
    names = [unused(child, f"_k{i}") for i in range(len(keys))]
    known = parent.select(*[F.col(f"`{b}`").alias(n) for (_, b), n in zip(keys, names, strict=True)]).distinct()
    same, whole = F.lit(True), F.lit(True)
    for (a, _), n in zip(keys, names, strict=True):
        same, whole = same & (F.col(f"`{a}`") == F.col(n)), whole & F.col(f"`{a}`").isNotNull()
    return child.filter(whole).join(known, same, "left_anti")


def metrics(df: DataFrame, measures: dict[str, tuple[Column, float]], run_id: str | None = None) -> DataFrame:
    """(metric_name, metric_value, threshold_value, status), and pipeline_run_id first where run_id is given, of percentages
    over rows: a measure is a condition and the percentage that passes. Without rows values are null and the status is
    `no rows`."""
    shares = df.agg(*[F.try_divide(100.0 * F.count_if(c), F.count("*")).cast("decimal(10,2)").alias(n) for n, (c, _) in measures.items()])
    rows = shares.unpivot([], list(measures), "metric_name", "metric_value")
    limit = F.element_at(F.create_map(*[F.lit(x) for n, (_, t) in measures.items() for x in (n, t)]), F.col("metric_name")).cast("decimal(10,2)")
    status = F.when(F.col("metric_value").isNull(), "no rows").when(F.col("metric_value") >= F.col("threshold_value"), "pass").otherwise("fail")
    rows = rows.withColumn("threshold_value", limit).withColumn("status", status)
    return rows if run_id is None else rows.select(F.lit(run_id).alias("pipeline_run_id"), "*")


def company_measures(required: list[str], formats: dict[str, str], confidence: str | None = None, stamp: str | None = None, now: Column | None = None, days: int = 30) -> dict[str, tuple[Column, float]]:
    """The four measures of company rows: completeness (all required columns set), accuracy (a match confidence of 85 or more,
    or no measure without that column), consistency (texts in their formats, missing ones aside), timeliness (stamp at most
    days before now)."""
    whole, formed = F.lit(True), F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    for c, pattern in formats.items():
        formed = formed & F.coalesce(F.col(c).rlike(pattern), F.lit(True))
    out = {"completeness": (whole, 90.0)}
    if confidence:
        out["accuracy"] = (F.coalesce(F.col(confidence) >= 85, F.lit(False)), 80.0)
    out["consistency"] = (formed, 95.0)
    if stamp:
        out["timeliness"] = (F.coalesce(F.datediff(now if now is not None else F.current_timestamp(), F.col(stamp)) <= days, F.lit(False)), 90.0)
    return out


def gate(df: DataFrame, *, unique: list[str] = (), not_null: list[str] = ()) -> DataFrame:
    """df, once it is known that the columns of unique together name rows and those of not_null are set; else ValueError.
    What constraints do in a database, before anything is written."""
    if not_null:
        bad = {r["column_name"]: r["failures"] for r in missing(df, list(not_null)).collect() if r["failures"]}
        if bad:
            raise ValueError(f"missing values: {bad}")
    if unique and not df.groupBy(*unique).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():
        raise ValueError(f"not unique: {', '.join(unique)}")
    return df
