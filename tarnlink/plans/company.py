"""The company flow: extract, clean, match, load, from folders to folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_key, or_default
from ..operators import clean, linkage, quality, upsert
from ..operators.dedup import keep_first
from ..sources import register, web
from ..sources.files import exists
from ..sources.versions import Versions
from .flow import run
from .settings import Settings


def match_rows(web_rows: DataFrame, register_rows: DataFrame, threshold: float, block: int = 2) -> DataFrame:
    """The 14 columns of a match record, for each web row whose best register row in its block reaches the threshold. web_rows:
    website_url, company_name, industry; register_rows as cleaned; both may have an id, which becomes the record's source id.
    Of several matches of one key the best stays."""
    key = F.struct(F.col("website_url"), F.col("company_name"))
    w = web_rows.select(key.alias("left_id"), "website_url", "company_name", "industry", or_default(web_rows, "id").cast("string").alias("source_commoncrawl_id"))
    r = register_rows.select(
        F.col("abn").alias("right_id"), "abn", "entity_name", "entity_type", "entity_status", "state", "postcode", "start_date",
        (F.col("address") if "address" in register_rows.columns else F.trim(F.concat_ws(" ", "state", "postcode"))).alias("address"),
        or_default(register_rows, "id").cast("string").alias("source_abr_id"),
    )
    sides = w.select(F.col("left_id").alias("id"), name_key(F.col("company_name")).alias("name")), r.select(F.col("right_id").alias("id"), name_key(F.col("entity_name")).alias("name"))
    out = linkage.blocked(*sides, threshold=threshold, block=block).join(w, "left_id").join(r, "right_id")
    out = out.select(
        "abn", F.col("website_url").alias("url"), "company_name", F.col("entity_name").alias("abr_company"), "industry", "entity_type", "entity_status",
        "address", "postcode", "state", F.try_to_date("start_date", "yyyyMMdd").alias("start_date"), F.col("score").alias("match_confidence"), "source_commoncrawl_id", "source_abr_id",
    )
    return keep_first(out, ["abn", "url", "company_name", "abr_company"], [F.desc("match_confidence"), "source_commoncrawl_id", "source_abr_id"])


def company_flow(spark: SparkSession, settings: Settings, log_dir: str | None = None) -> dict[str, DataFrame]:
    """Register XML and pages (Parquet: url, html) to three tables of upserted rows: register, web, matches, each in versions
    (sources.versions): a load counts once its version is committed, so a run that stops anywhere loses nothing.

    What is extracted is kept; as long as both extracts are there, sources are not read again. Loads without rows leave their
    table as it is, and a load whose keys are missing or repeated is refused."""
    s = settings

    def load(name: str, policy: upsert.Policy, not_null: list[str]):
        def stage(spark: SparkSession, got: dict[str, DataFrame]) -> DataFrame:
            table, rows = Versions(spark, f"{s.target_dir}/{name}"), got[name]
            if not rows.isEmpty():
                merged = upsert.classify(table.read(rows.schema), quality.gate(rows, unique=list(policy.key), not_null=not_null), policy)
                table.replace(merged.drop("action"))
            return table.read(rows.schema)

        return stage

    def extracted(name: str, rows):
        """The stage of an extract: the kept one where both are whole."""

        def stage(spark: SparkSession, got: dict[str, DataFrame]) -> DataFrame:
            path = f"{s.target_dir}/extract/{name}"
            if not all(exists(spark, f"{s.target_dir}/extract/{n}/_SUCCESS") for n in ("register", "web")):
                rows(spark).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        return stage

    def pages(spark: SparkSession) -> DataFrame:
        html = F.col("html")
        return spark.read.parquet(s.web_dir).select(F.col("url").alias("website_url"), web.company_name(html).alias("company_name"), web.industry(html).alias("industry"))

    stages = [
        ("register_raw", extracted("register", lambda spark: register.register_row(register.read_register(spark, s.register_dir)))),
        ("web_raw", extracted("web", pages)),
        ("register", lambda spark, got: clean.clean_register(got["register_raw"], "abn")),
        ("web", lambda spark, got: clean.clean_web(got["web_raw"], "website_url")),
        ("register_table", load("register", upsert.REGISTER, ["abn"])),
        ("web_table", load("web", upsert.WEB, ["website_url"])),
        ("matches", lambda spark, got: match_rows(got["web_table"], got["register_table"], s.threshold)),
        ("matches_table", load("matches", upsert.MATCHES, ["abn"])),
    ]
    return run(spark, stages, log_dir=log_dir)
