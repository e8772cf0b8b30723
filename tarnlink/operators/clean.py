"""Cleaning of the two sides: register rows and web rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, known, snake_columns, strip, strip_strings, title
from .dedup import keep_first

# The columns of a cleaned register.
REGISTER = ["abn", "entity_name", "entity_type", "entity_status", "address_line1", "address_line2", "suburb", "state", "postcode", "start_date"]


def matches(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column matches; missing is no match. df unchanged where it has no such column."""
    return df.filter(F.coalesce(F.col(f"`{column}`").rlike(pattern), F.lit(False))) if column in df.columns else df


def clean_register(df: DataFrame, ordinal: str, active: tuple[str, str] | None = None) -> DataFrame:
    """Names in snake case, texts stripped, rows with a valid number and postcode, distinct, the first of each number,
    in the register's columns (absent ones as ''). active: (column, value) that the first row of a number must have, case aside:
    a number whose first row is another one is dropped."""
    df = strip_strings(snake_columns(df))
    df = df.select(*[known(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    df = matches(matches(df, "abn", "^[0-9]{11}$"), "postcode", "^[0-9]{4}$")
    df = keep_first(df, ["abn"] if "abn" in df.columns else df.columns, [ordinal])
    if active and active[0] in df.columns:
        df = df.filter(F.lower(F.col(f"`{active[0]}`")) == active[1].lower())
    absent = {c: F.lit("") for c in REGISTER if c not in df.columns}
    return df.withColumns(absent).select(*REGISTER)


def clean_web(df: DataFrame, ordinal: str) -> DataFrame:
    """Urls stripped, of at most 500 characters, their case kept; names in title case with single spaces; rows with both,
    the first of each pair. Names of white space only count as missing."""
    df = snake_columns(df)
    url = F.substring(strip(known(F.col("website_url"))), 1, 500)
    name = title(collapse(strip(known(F.col("company_name")))))
    df = df.withColumns({"website_url": url, "company_name": name}).dropna(subset=["website_url", "company_name"]).filter("company_name <> ''")
    return keep_first(df, ["website_url", "company_name"], [ordinal]).select("website_url", "company_name", "industry")
