"""Catalog tables: DDL scripts, statistics, scans and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

#: What a script consists of, longest first: comments, quoted texts and names, semicolons, anything else.
_TOKEN = re.compile(r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quoted>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`)|(?P<end>;)|(?P<other>.)", re.S)


def statements(script: str) -> list[str]:
    """The statements of a SQL script: split at semicolons outside quotes and comments, comments left out."""
    parts = [[]]
    for m in _TOKEN.finditer(script):
        if m.lastgroup == "end":
            parts.append([])
        else:
            parts[-1].append(" " if m.lastgroup == "comment" else m[0])
    return [p for p in ("".join(x).strip() for x in parts) if p]


def run_script(spark: SparkSession, script: str) -> int:
    """Runs the statements in order; how many there were. CREATE ... IF NOT EXISTS makes a script repeatable."""
    found = statements(script)
    for s in found:
        spark.sql(s)
    return len(found)


def optimize(spark: SparkSession, table: str, columns: list[str] | None = None) -> None:
    """Statistics for the optimizer, of columns or of the table. Spark has no indexes; bucketing takes their place."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))


def scan(spark: SparkSession, name: str) -> DataFrame:
    """All rows and columns of a table or view."""
    return spark.table(name)


def page(df: DataFrame, order: list[str | Column], number: int, size: int) -> DataFrame:
    """Page number (from 0) of df in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)
