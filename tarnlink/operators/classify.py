"""Pair classification by a language model: prompt, pluggable client, answer parsing. No network here: the default client
is a fixed rule."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "is_match boolean, confidence double, reasoning string, unified_name string"


def prompt(left: Column, right: Column) -> Column:
    return F.format_string("Do these two records describe the same company?\nA: %s\nB: %s\nAnswer as JSON with is_match, confidence, reasoning and unified_name.", left, right)


def rule_client(left: str, right: str) -> str:
    """Same words in any order: a match."""
    a, b = sorted((left or "").lower().split()), sorted((right or "").lower().split())
    share = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
    return json.dumps({"is_match": share >= 0.5, "confidence": round(share, 4), "reasoning": "shared words", "unified_name": left if share >= 0.5 else None})


def ask(pairs: DataFrame, left: str, right: str, client: Callable[[str, str], str] = rule_client) -> DataFrame:
    """pairs with `answer`, the client's text."""

    @F.arrow_udf("string")
    def answers(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([client(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return pairs.withColumn("answer", answers(left, right))


def parse(answer: Column) -> Column:
    """The answer as a struct; null fields where it isn't the JSON asked for."""
    return F.from_json(answer, ANSWER)
