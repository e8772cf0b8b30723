"""Text normalisation as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing value in delimited files.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space (Unicode's, too) at either end; Spark's trim removes U+0020 only."""
    return F.regexp_replace(c, _EDGES, "")


def known(c: Column) -> Column:
    """NULL where c is a text that stands for a missing value."""
    return F.when(~c.isin(NULL_TOKENS), c)


def collapse(c: Column) -> Column:
    """Runs of U+0020 as one."""
    return F.regexp_replace(c, " +", " ")


def title(c: Column) -> Column:
    """A capital after every non-letter, the rest in lower case. initcap would only look at spaces."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), lambda w: F.initcap(w)), "")


def name_key(c: Column) -> Column:
    """The form in which names are compared: stripped, lower case, missing as ''. Lower case, since engines agree
    on it more than on upper case."""
    return F.coalesce(F.lower(strip(c)), F.lit(""))


def block_key(name: Column, size: int = 2) -> Column:
    return F.substring(name, 1, size)


def token_sort(name: Column) -> Column:
    """The white-space separated tokens, sorted."""
    return F.array_join(F.array_sort(F.filter(F.split(name, r"(?U)\s+"), lambda t: t != "")), " ")


def last_part(c: Column) -> Column:
    """What follows the last hyphen, bar or dash."""
    return strip(F.element_at(F.split(c, r"[-|–—]"), -1))


def word_tokens(c: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def snake_columns(df: DataFrame) -> DataFrame:
    """Columns renamed: stripped, lower case, spaces as underscores. Of names that become equal the later ones get a number."""
    names: list[str] = []
    for c in df.columns:
        base = name = c.strip().lower().replace(" ", "_")
        i = 1
        while name in names:
            i += 1
            name = f"{base}_{i}"
        names.append(name)
    return df.toDF(*names)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it as far as df has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def file_stamp(at: Column | None = None) -> Column:
    """A time, by default the current one, as names of files have it: yyyyMMdd_HHmmss."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")


def strip_strings(df: DataFrame) -> DataFrame:
    """Every string column stripped."""
    return df.select(*[strip(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema])


def or_default(df: DataFrame, name: str, default: object = None) -> Column:
    """Column name where df has it, else the default."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(default)).alias(name)
