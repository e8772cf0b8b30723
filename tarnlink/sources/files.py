"""File sources and sinks: delimited text, archives and the shared folder for tables between steps."""

from __future__ import annotations

import io
import os
import tempfile
import urllib.request
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import known
from ..plans.metrics import measured
from .catalog import optimize


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and everything
    runs on one machine (a local master). Elsewhere an unset folder is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that no later step computes it again or depends on an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def settled_without(df: DataFrame, path: str) -> DataFrame:
    """df, computed and kept, and the temporary folder that it was read from removed."""
    out = settle(df)
    remove(df.sparkSession, path)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_delimited(spark: SparkSession, path: str, schema: str | None, nulls: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV files with a header under an explicit schema, so that numbers with leading zeros stay texts; schema None: types
    are inferred by a pass over the data. multi_line keeps line breaks in quotes, but makes each file one task: without
    it files are split, and quoted line breaks are an error. nulls: texts that stand for missing values become null."""
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"', mode="FAILFAST")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)
    return df.select(*[known(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]) if nulls else df


def row_range(df: DataFrame, start: int, end: int, columns: list[str] | None = None) -> DataFrame:
    """Rows start (from 0) up to before end of a scan, in the order of its files and of their rows; with columns, renamed by
    position, and none where the numbers of columns differ."""
    rows = df.offset(start).limit(max(0, end - start))
    return rows if columns is None else positional(rows, columns)


def download(url: str, path: str, chunk: int = 1 << 20) -> bool:
    """Fetches url to a file on the driver, a chunk at a time; whether it was fetched: a file that is there is kept. A status
    other than 200 is an error. The file takes its name when it is whole."""
    if os.path.exists(path):
        return False
    try:
        with urllib.request.urlopen(url) as answer, open(f"{path}.part", "wb") as out:
            if getattr(answer, "status", 200) not in (200, None):
                raise OSError(f"{url}: status {answer.status}")
            while piece := answer.read(chunk):
                out.write(piece)
        os.replace(f"{path}.part", path)
    finally:
        if os.path.exists(f"{path}.part"):
            os.remove(f"{path}.part")
    return True


def positional(df: DataFrame, columns: list[str]) -> DataFrame:
    """df under other column names; no rows where the numbers of columns differ."""
    if len(df.columns) == len(columns):
        return df.toDF(*columns)
    return df.sparkSession.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def write_delimited(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV files with a header each in a folder; append adds files to those there."""
    df.write.mode("append" if append else "overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_table(df: DataFrame, name: str, *, append: bool = False, buckets: tuple[int, str] | None = None) -> None:
    """A catalog table; buckets (number, column) lets later joins on that column do without an exchange."""
    w = df.write.mode("append" if append else "overwrite")
    (w.bucketBy(*buckets).sortBy(buckets[1]) if buckets else w).saveAsTable(name)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


#: Bytes up to which a load goes out in one piece.
BULK = 100 << 20


def load(spark: SparkSession, path: str, schema: str, table: str, columns: list[str] | None = None, bulk: bool = True) -> int:
    """Appends delimited files to a catalog table and gives the number of rows. Below BULK bytes (and with bulk) as one file,
    else by as many tasks as there are splits; statistics are gathered if there were rows."""
    df = read_delimited(spark, path, schema, nulls=False)
    if columns is not None:
        df = positional(df, columns)
    if bulk and size_of(spark, path) < BULK:
        df = df.coalesce(1)
    done = measured(df, lambda rows: write_table(rows, table, append=True))
    if done.rows:
        optimize(spark, table)
    return done.rows


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 1000, connections: int = 8) -> None:
    """Appends to a database table, `batch` rows an insert, over at most `connections` connections at a time."""
    df.write.mode("append").option("batchsize", batch).option("numPartitions", connections).jdbc(url, table, properties=properties)


def unzip(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """(archive, member, content) of the members of zip archives whose names end in suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.namelist():
                        if m.endswith(suffix):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m]), pa.array([z.read(m)], pa.binary())], names=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, content binary")
