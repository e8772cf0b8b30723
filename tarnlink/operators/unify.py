"""The unified company table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unified_companies(matches: DataFrame) -> DataFrame:
    """One row per abn of matches (abn, company_name, website_url, industry, entity_type, entity_status, state, postcode,
    score in 0..1, data_source): attributes of its best match, all its sources."""
    best = F.struct(F.col("score"), F.col("company_name"), F.col("website_url"), F.col("industry"), F.col("entity_type"), F.col("entity_status"), F.struct("state", "postcode").alias("address"))
    per = matches.groupBy("abn").agg(F.max(best).alias("b"), F.array_sort(F.collect_set("data_source")).alias("data_sources"))
    return per.select(
        F.col("b.company_name").alias("unified_name"), F.col("abn").alias("primary_abn"), "b.website_url", "b.industry", "b.entity_type", "b.entity_status",
        "b.address", F.col("b.score").cast("decimal(4,3)").alias("confidence_score"), "data_sources",
    )
