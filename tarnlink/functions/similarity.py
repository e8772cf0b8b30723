"""String similarity: Indel ratio (longest common subsequence) and TF-IDF cosine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import token_sort, word_tokens


def lcs_sql(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by higher-order functions only. For checks; the Arrow form is faster."""
    width = F.length(b)

    def row(prev: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), width), F.array(F.lit(0)),
            lambda acc, j: F.array_append(acc, F.greatest(F.element_at(acc, -1), F.element_at(prev, j + 1), F.element_at(prev, j) + F.when(F.substr(b, j, F.lit(1)) == ch, 1).otherwise(0))),
        )

    found = F.element_at(F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), width + 1), row), -1)
    return F.when((F.length(a) == 0) | (width == 0), 0).otherwise(found)


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel: one step a character of b on an integer of len(a) bits."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & at.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@F.arrow_udf(DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """100 * 2 * LCS / (length a + length b); null where either is."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        n = None if x is None or y is None else len(x) + len(y)
        out.append(None if n is None else 100.0 if n == 0 else 200.0 * lcs_length(x, y) / n)
    return pa.array(out, pa.float64())


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(token_sort(a), token_sort(b))


def may_reach(length_a: Column, length_b: Column, threshold: float) -> Column:
    """False only for lengths at which no two strings reach the ratio: LCS is at most the shorter length."""
    return 200 * F.least(length_a, length_b) >= threshold * (length_a + length_b)


def grams(c: Column, n: int) -> Column:
    """Word tokens, and for n = 2 also every two neighbours joined by a space."""
    t = word_tokens(c)
    if n == 1:
        return t
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda x, y: F.concat_ws(" ", x, y)))
    return F.concat(t, F.coalesce(pairs, F.array().cast("array<string>")))


def term_counts(names: DataFrame, text: Column, n: int) -> DataFrame:
    """(name, times, term, tf) of distinct names (name, times), without an exchange: the terms of a name are sorted where they are, and
    each run of equal ones is counted."""
    sorted_ = names.select("name", "times", F.array_sort(grams(text, n)).alias("_t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: ~F.get("_t", i - 1).eqNullSafe(F.get("_t", i)))
    run = lambda end, k: F.struct(F.get("_t", end - 1).alias("term"), (end - F.coalesce(F.get("_e", k - 1), F.lit(0))).alias("tf"))
    return sorted_.withColumn("_e", ends).select("name", "times", F.explode(F.transform("_e", run)).alias("_x")).select("name", "times", "_x.*")


def inverse_frequencies(counts: DataFrame, names: DataFrame, *, max_df: float = 1.0, max_features: int | None = None) -> DataFrame:
    """(term, idf, number) of term_counts, fitted on all names as often as they stand: ln((1 + n) / (1 + df)) + 1. Numbers rise with df;
    they hold once the result is settled.

    max_df drops terms in more than that share of rows; max_features keeps the most frequent ones, ties by term."""
    terms = counts.groupBy("term").agg(F.sum("times").alias("df"), F.sum(F.col("tf") * F.col("times")).alias("total"))
    total = names.agg(F.sum("times").alias("n"))
    terms = terms.crossJoin(F.broadcast(total))  # one row
    if max_df < 1:
        terms = terms.filter(F.col("df") <= max_df * F.col("n"))
    if max_features:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return terms.orderBy("df", "term").select("term", idf.alias("idf"), F.monotonically_increasing_id().alias("number"))


def tfidf(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(name, terms, weights) of term_counts: the numbers of a name's terms, rising, and raw counts times idf, scaled to unit length."""
    w = counts.join(idf, "term").select("name", "number", (F.col("tf") * F.col("idf")).alias("w")).repartition("name")  # rows are smaller than lists of one
    v = w.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("number", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return v.select("name", F.col("v.number").alias("terms"), F.transform("v.w", lambda x: x / F.col("norm")).alias("weights"))
