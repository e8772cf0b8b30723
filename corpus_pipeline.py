"""Corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

toxicity drops documents that score 0.7 or more, near_duplicates leaves one document of each group (word 5-grams,
Jaccard 0.8 or more), secrets replaces found secrets in the texts, mixing takes documents to the sources' target
weights (a document taken twice is two rows), pieces encodes what is left. Stages keep the columns of documents up to
the last, and other columns that documents may have, whatever their names. Ids name documents: rows that repeat an id and a
text count once.

Null and empty texts pass all stages: they are scored like texts that match no example, belong to no group, hold no secrets, are
taken once and have no pieces. Rows without an id pass like others (their texts decide the sampling); ties go to the smaller id.
An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlink.llm import mixing, nbest, ngram_join, secrets, toxicity
from tarnlink.llm.common import held_out, remove, shared_dir, table
from tarnlink.llm.queries import PIECES, quality


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that score 0.7 or more, by examples that aren't held out. Labels that aren't there, or of one kind only:
    all rows stay."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return toxicity.without_toxic(docs, index)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the row of the least id (null ids last) of each group of near duplicates; rows without words stay."""
    return ngram_join.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with found secrets replaced by a mark, and n_chars, where there is such a column, as the texts are then. The novelty
    dictionary is fitted on docs."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row as often as the mix takes it: complete epochs, then rows in the order of their keys up to and with the row
    at the source's budget. Rows without words stay once; null sources are a source."""
    weights = quality(spark, sf_dir)
    return mixing.apply_mix(docs, mixing.mix(docs, quality=weights), quality=weights)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the N best segmentations of each text: ids, n_pieces, scores, other_ids, round_trip. Null texts
    have no pieces."""
    return nbest.encode(docs, PIECES, ["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Scores, components and segmentations have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        if before:
            remove(spark, before)  # what a stage read isn't needed once its own rows are written
        before, docs = path, spark.read.schema(out.schema).parquet(path)
