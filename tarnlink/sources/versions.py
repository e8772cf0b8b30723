"""A table in a folder, in versions: a version is a set of buckets, most of which it shares with the one before.

folder/data/version=N/_bucket=B holds the rows that version N wrote of bucket B; folder/manifest/N says for every bucket
which version's rows count, and under which schema. A version counts once its manifest stands in its place, which is a
rename: a writer that dies leaves the version before as it was. The last KEEP manifests and the data that they name are
kept for readers, older ones are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEEP = 2


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/manifest")
        if not self._fs.exists(at):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(at)) if n.isdigit())

    def last(self, below: int | None = None) -> int | None:
        found = [n for n in self._numbers() if below is None or n < below]
        return found[-1] if found else None

    def _manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/manifest/{number:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, schema: StructType | None = None, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the last version (below a number), or of some of its buckets; none without a version, which needs
        a schema."""
        number = self.last(below)
        if number is None:
            if schema is None:
                raise ValueError(f"{self.folder} has no version")
            return self.spark.createDataFrame([], schema)
        found = self._manifest(number)
        kept = StructType.fromJson(found["schema"])
        paths = [f"{self.folder}/data/version={v:012d}/_bucket={b}" for b, v in found["buckets"].items() if buckets is None or int(b) in buckets]
        paths = [p for p in paths if self._fs.exists(self._path(p))]  # a bucket without rows has no folder
        return self.spark.read.schema(kept).parquet(*paths) if paths else self.spark.createDataFrame([], kept)

    def write(self, rows: DataFrame, number: int, buckets: list[int]) -> None:
        """rows (with _bucket) as what version `number` has in these buckets; the others stay as they are."""
        before = self.last(number)
        held = self._manifest(before)["buckets"] if before is not None else {}
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data/version={number:012d}")
        held |= {str(b): number for b in buckets}
        text = json.dumps({"buckets": held, "schema": rows.drop("_bucket").schema.jsonValue()})
        self._fs.mkdirs(self._path(f"{self.folder}/manifest"))
        out = self._fs.create(self._path(f"{self.folder}/manifest/_{number:012d}"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._commit(number)
        self._tidy()

    def replace(self, rows: DataFrame) -> int:
        """All rows anew, as the next version; its number."""
        last = self.last()
        number = 0 if last is None else last + 1
        self.write(rows.withColumn("_bucket", F.lit(0)), number, [0])
        return number

    def _commit(self, number: int) -> None:
        new, place = (self._path(f"{self.folder}/manifest/{mark}{number:012d}") for mark in ("_", ""))
        self._fs.delete(place, False)  # only there where this very version is written again
        if not self._fs.rename(new, place):
            raise OSError(f"version {number} of {self.folder} could not be committed")

    def _tidy(self) -> None:
        numbers = self._numbers()
        for n in numbers[:-KEEP]:
            self._fs.delete(self._path(f"{self.folder}/manifest/{n:012d}"), False)
        used = {v for n in numbers[-KEEP:] for v in self._manifest(n)["buckets"].values()}
        for s in self._fs.listStatus(self._path(f"{self.folder}/data")):
            name = s.getPath().getName()
            if name.startswith("version=") and int(name[8:]) < numbers[-1] and int(name[8:]) not in used:
                self._fs.delete(s.getPath(), True)
