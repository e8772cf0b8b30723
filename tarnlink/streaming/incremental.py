"""Incremental upserts: new files of a folder, micro-batch by micro-batch, into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import Policy, classify
from ..sources.versions import Versions


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, policy: Policy, buckets: int = 64) -> StreamingQuery:
    """Upserts each micro-batch of Parquet files that arrive in source into target. Keys are dealt to buckets, and a batch
    rewrites only those that it holds keys of. A version is named after its batch, so a batch that is run again writes the
    same version again; readers take the last committed one."""
    table = Versions(spark, target)

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            key = F.pmod(F.hash(*policy.key), F.lit(buckets)).cast("int")
            touched = sorted(r[0] for r in batch.select(key.alias("b")).distinct().collect())  # at most `buckets`
            if not touched:
                return
            before = table.read(batch.drop(policy.arrival).schema, below=number, buckets=touched)
            after = classify(before, batch, policy).drop("action")
            table.write(after.withColumn("_bucket", key), number, touched)
        finally:
            batch.unpersist()

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The last committed version, or None."""
    table = Versions(spark, target)
    return table.read() if table.last() is not None else None
