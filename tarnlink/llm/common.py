"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Makes sure that checkpoints have a folder: the one the cluster names in spark.checkpoint.dir, a temporary one only
    where that is unset and everything runs on one machine (a local master). Elsewhere an unset folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that no later step depends on an
    executor's memory or disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this package's own."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows and bytes in a batch that goes to Python, where rows hold whole texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def text_batches(spark: SparkSession) -> None:
    """From now on batches to Python have at most BATCH_ROWS rows and about BATCH_BYTES bytes (or one row): the session's
    defaults of 10,000 rows and 64 MiB are too much for rows of whole texts, since several batches are held on either side at
    once. Plans read these settings when they run, so they cannot be put back."""
    for key, least, usual in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, "64m")):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < _bytes(spark.conf.get(key, usual)) <= least:
            spark.conf.set(key, str(least))


def _bytes(size: str) -> int:
    size = size.lower().removesuffix("b")
    return int(size[:-1]) << {"k": 10, "m": 20, "g": 30}[size[-1]] if size[-1:] in ("k", "m", "g") else int(size)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts, measured: Catalyst knows the size of files only. Used to size partitions."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0)


def held_out(doc_id: Column | str) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as df has such columns already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def results(keep: list[str], *names: str) -> list[str]:
    """The names of added columns, with underscores before those that a kept column has already."""
    taken, out = {c.lower() for c in keep}, []
    for n in names:
        while n in taken:
            n = f"_{n}"
        taken.add(n)
        out.append(n)
    return out


#: Bytes of a table up to which it is sent to every task.
SENT = 16 << 20


def fits(df: DataFrame, most: int = SENT) -> bool:
    """Whether df, measured, is small enough to be sent to every task: 16 bytes a value and the bytes of its texts."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    row = F.lit(16 * len(df.columns))
    for t in texts:
        row = row + t
    return int(df.agg(F.sum(row.cast("long")).alias("n")).first()["n"] or 0) <= most


def sent_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df) else df


def _give_back() -> None:
    """Memory that this worker has freed goes back to the system: workers live on between tasks, beside each other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker holds no more memory than it needs."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inside
