"""Token counts as delta-maintained rollups.

Totals of rows and tokens by (source, lang, tokenizer) are the sum of batches of signed deltas: an insert adds a row
and its tokens, a delete takes them away, a revision adds the difference between its new and old count. A batch is
summed by key before it is written and is committed by its _SUCCESS mark under a name derived from its id, so
committing the same batch again, or retrying one that died half-way, changes nothing.

compact() folds the batches committed so far into one sum. It claims a number that no other compaction has, lists the batches
once, writes the sum of just those and the sum before, and publishes a list of what went in by renaming it into place; only the
last published list counts, so a compaction that dies, is slow or runs beside another one leaves the totals as they are, and so
do batches that arrive meanwhile. Batches that a published list holds are marked as absorbed, which is how a late retry
finds them, and then deleted. Totals that are being read while files go must be read again.

Defined cases: a null text counts 0 tokens, and still a row; null sources and languages are keys of their own; repeated rows
count each, there are no ties; an empty batch commits and changes nothing; keys whose rows and tokens come to 0 stay, with zeros;
an empty store has no totals; other columns, whatever their names, do not take part.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEY = ["source", "lang", "tokenizer"]
_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counter(path: str):
    """A column function: the tokens of a text. path: a rank file that every executor has."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        enc = encoding(path)
        return pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count


def deltas(changes: DataFrame, tokenizer: str, *, op: Column, tokens: Column, old: Column | None = None, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Signed sums by key of change rows. op: insert, delete or revise; tokens: the row's count (for a delete, the
    count that was inserted); old: for a revision, the count so far."""
    sign = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0).cast("long")
    change = F.when(op == "revise", tokens - (old if old is not None else F.lit(0))).otherwise(sign * tokens)
    rows = changes.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.lit(tokenizer).alias("tokenizer"), sign.alias("rows"), change.alias("tokens"))
    return rows.groupBy(*KEY).agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))


class Store:
    """Batches of deltas in a folder that driver and executors share, and totals over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def _name(self, batch_id: str) -> str:
        return f"batch-{hashlib.sha256(batch_id.encode()).hexdigest()[:32]}"

    def _absorbed(self, name: str) -> bool:
        return self._fs.exists(self._at(f"absorbed-{name[6:]}"))

    def _whole(self, name: str) -> bool:
        return self._fs.exists(self._at(f"{name}/_SUCCESS"))

    def committed(self, batch_id: str) -> bool:
        name = self._name(batch_id)
        return self._absorbed(name) or self._whole(name)

    def commit(self, batch_id: str, change: DataFrame) -> bool:
        """Writes the batch unless it is committed already; whether it was written now."""
        if self.committed(batch_id):
            return False
        change.withColumns({"rows": F.col("rows").cast("long"), "tokens": F.col("tokens").cast("long")}).write.mode("overwrite").parquet(f"{self.folder}/{self._name(batch_id)}")
        return True

    def _names(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))) if n.startswith(prefix))

    def _state(self) -> tuple[str | None, list[str]]:
        """The last published number, if any, and the committed batches that its sum does not hold."""
        last = self._names("list-")[-1:]
        held = set(self._listed(last[0])) if last else set()
        return (last[0][5:] if last else None), [n for n in self._names("batch-") if n not in held and self._whole(n) and not self._absorbed(n)]

    def _listed(self, name: str) -> list[str]:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Writes a file that must not be there yet."""
        out = self._fs.create(self._at(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _sum(self, number: str | None, batches: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, rows long, tokens long"
        names = ([f"sum-{number}"] if number else []) + batches
        parts = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)
        return parts.groupBy(*KEY).agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        return self._sum(*self._state())

    def _claim(self) -> str:
        while True:
            taken = self._names("claim-")
            number = f"{int(taken[-1][6:]) + 1 if taken else 0:08d}"
            try:
                self._write(f"claim-{number}", "")
                return number
            except Py4JJavaError:
                if not self._fs.exists(self._at(f"claim-{number}")):
                    raise

    def compact(self) -> None:
        """Folds all committed batches into one sum."""
        self._tidy()
        number = self._claim()
        before, batches = self._state()
        if not batches:
            return
        self._sum(before, batches).write.mode("overwrite").parquet(f"{self.folder}/sum-{number}")
        self._write(f"new-{number}", "\n".join(batches))
        self._publish(number)
        self._tidy()

    def _publish(self, number: str) -> None:
        if not self._fs.rename(self._at(f"new-{number}"), self._at(f"list-{number}")):
            raise OSError(f"list {number} could not be published")

    def _tidy(self) -> None:
        """Marks and deletes the batches that the last published sum holds."""
        for last in self._names("list-")[-1:]:
            for name in self._listed(last):
                if not self._absorbed(name):
                    self._fs.create(self._at(f"absorbed-{name[6:]}"), True).close()
                self._fs.delete(self._at(name), True)
