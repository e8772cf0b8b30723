"""Sharding by histogram sort: near-equal bytes in every shard, found without sorting first.

Rows are ordered by a 63-bit key: 43 bits of a hash of the text, then 20 bits of a hash of the id, so equal texts
lie together and yet a large group of copies can be split. Splitters are found by counting: exact bytes below
evenly spaced candidate keys, over all partitions at once, then below finer candidates inside the interval each
splitter fell into, until every splitter is within tolerance. Only then are rows exchanged, once.

DataFrame functions only. The driver holds at most PROBES + shards * FINER counts, whatever the input's size.

Defined cases: a null text has no bytes (crc32 of nothing, 0); every row weighs `overhead` bytes more, so rows
without text are spread too; null ids hash like the empty string; rows equal in text and id share a key and stay
together; an empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

KEY_BITS, ID_BITS = 63, 20
#: Candidates in the first round, as bits, and in each later round and interval.
PROBES, FINER = 12, 8
CELL_ROWS = 20_000


def shard_key(text: Column, doc_id: Column) -> Column:
    of_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - (KEY_BITS - ID_BITS))
    of_id = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("id")), 64 - ID_BITS)
    return F.shiftleft(of_text, ID_BITS) + of_id


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[int]:
    """shards - 1 keys of rows (key, size); shard i holds the keys from splitter i - 1 on and below splitter i."""
    low, bits = {0: 0}, PROBES  # bytes below each open interval, by the interval's number at this resolution
    counts: dict[int, int] = {int(r[0]): int(r[1]) for r in rows.groupBy(F.shiftright("key", KEY_BITS - bits).alias("bin")).agg(F.sum("size")).collect()}
    total = sum(counts.values())
    goals = {i: total * i / shards for i in range(1, shards)}
    within, found = tolerance * total / shards, {}
    below = low[0]
    starts = {}
    for b in sorted(counts):
        starts[b], below = below, below + counts[b]
    while goals:
        open_bins: dict[int, list[int]] = {}
        order = sorted(starts)
        for i, goal in list(goals.items()):
            b = max((x for x in order if starts[x] <= goal), default=order[0] if order else 0)
            left, right = starts.get(b, 0), starts.get(b, 0) + counts.get(b, 0)
            near, key = min((abs(goal - left), b), (abs(right - goal), b + 1))
            if near <= within or bits >= KEY_BITS:
                found[i] = key << (KEY_BITS - bits)
                del goals[i]
            else:
                open_bins.setdefault(b, []).append(i)
        if not goals:
            break
        finer = min(FINER, KEY_BITS - bits)
        inside = F.shiftright("key", KEY_BITS - bits).isin(list(open_bins))
        bits += finer
        deeper = rows.filter(inside).groupBy(F.shiftright("key", KEY_BITS - bits).alias("bin")).agg(F.sum("size")).collect()
        got = {int(r[0]): int(r[1]) for r in deeper}
        starts_next: dict[int, int] = {}
        for b in open_bins:
            below = starts[b]
            for x in sorted(k for k in got if k >> finer == b):
                starts_next[x], below = below, below + got[x]
        starts, counts = starts_next, got
    return [found[i] for i in sorted(found)]


def shard_of(key: Column, bounds: list[int]) -> Column:
    """The number of splitters at or below key."""
    return reduce(lambda a, b: a + b, [(key >= F.lit(b)).cast("int") for b in bounds], F.lit(0))


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, tolerance: float = 0.005) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, key, shard, slot (0, 1, ... within the shard, in cells of the
    key's order)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), shard_key(F.col(text_col), F.col(id_col)).alias("key"),
    ))
    n = rows.count()
    rows = rows.withColumn("shard", shard_of(F.col("key"), splitters(rows.select("key", "size"), shards, tolerance)))
    by_id = 6
    by_text = max(0, math.ceil(math.log2(max(1, n / CELL_ROWS))) - by_id)
    cell = F.shiftleft(F.shiftright("key", KEY_BITS - by_text), by_id) + F.shiftright(F.col("key").bitwiseAND((1 << ID_BITS) - 1), ID_BITS - by_id)
    rows = rows.withColumn("_cell", cell)
    ahead = Window.partitionBy("_sh").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(F.col("shard").alias("_sh"), F.col("_cell").alias("_c")).agg(F.count("*").alias("_n"))
    cells = cells.select("_sh", "_c", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    nth = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("key", "doc_id")) - 1
    out = rows.withColumn("_nth", nth).join(cells, (F.col("shard") == F.col("_sh")) & (F.col("_cell") == F.col("_c")))
    return out.select("doc_id", "size", "text_crc32", "key", "shard", (F.col("_ahead") + F.col("_nth")).alias("slot"))
