"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row draws an exponential key, -ln(u) / w with w its quality weight; the rows of a source in order of
their keys are a weighted sample without replacement, whatever prefix is taken. A source's word budget is first
spent on complete epochs, then the rest goes down that order until the running sum of sizes meets it. u comes
from a hash of the id, so reruns agree.

Running sums never bring a source into one task: rows are dealt into (source, key range) cells of bounded size,
cells are summed, and a row's sum is its cell's offset plus the sum within the cell. Cells are even on the logarithm of the key:
whatever its weight w, a key falls into a range of ratio 1 + d with a probability of at most d / e, so no mixture of weights
crowds a cell.

Defined cases: a null text has size 0; null sources form one source, ordered last; rows without an id draw by their texts
(ties go by id, then size); an empty table gives an empty result; other columns, whatever their names, are kept
aside and do not take part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, sent_if_small, settle

#: Rows in one (source, key range) cell, at most, as expected.
CELL_ROWS = 5_000


def sample_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of a hash of the id, or of the text's hash where there is no id."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(seed))), 1, 13), 16, 10)
    return -F.ln((bits.cast("long") + 0.5) / float(1 << 52)) / weight


#: Parts into which sources are dealt by their order, to be numbered.
PARTS = 200


def numbered(per: DataFrame, column: str) -> DataFrame:
    """per with _i, the number from 0 of its row in the order of column (different in every row, nulls last). Rows are dealt out
    by range; each part numbers its own, and the parts' counts are summed up."""
    at = F.col(column).asc_nulls_last()
    dealt = per.repartitionByRange(PARTS, at).sortWithinPartitions(at)
    dealt = settle(dealt.withColumns({"_p": F.spark_partition_id(), "_n": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in dealt.groupBy("_p").agg(F.count("*")).collect()):  # a row for each part
        offsets += [F.lit(p), F.lit(before).cast("long")]
        before += n
    if not offsets:
        return dealt.withColumn("_i", F.col("_n")).drop("_p", "_n")
    return dealt.withColumn("_i", F.element_at(F.create_map(*offsets), F.col("_p")) + F.col("_n")).drop("_p", "_n")


def budgets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """A row per source of (source, size): n, source_size, target.

    The budget is share * all sizes, dealt in proportion to weights (repeating over the sources by code point,
    nulls last); no target exceeds cap * its source's size, the excess is dealt again by weight until none does. Sources
    may be very many (hosts, say): each round is one aggregate over them, and the saturated ones only become more.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    per = numbered(per, "source")
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    per = settle(per.withColumn("_cap", cap * F.col("source_size")))
    everything = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    full, count, level = F.lit(False), -1, 0.0
    while True:
        some = per.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if some[0] == count:
            break
        count = some[0]
        level = (everything - (some[1] or 0.0)) / some[2] if some[2] else float("inf")
        full = F.col("_cap") / F.col("_w") <= level
    return per.select("source", "n", "source_size", F.when(full, F.col("_cap")).otherwise(level * F.col("_w")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, epochs, key, taken.

    quality: (doc_id, weight > 0), at most one row an id; documents without one weigh 1.
    taken counts words: epochs * size, plus what the fractional pass takes. The row at the budget's edge is taken
    in part, so a source's sum differs from its target by less than a word.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col(f"`{id_col}`").isNull(), F.col(f"`{text_col}`")).alias("_t"),
    )
    if quality is not None:
        rows = rows.join(quality.select(F.col("doc_id"), F.col("weight").alias("_q")), "doc_id", "left")
    else:
        rows = rows.withColumn("_q", F.lit(1.0))
    rows = settle(rows.select("doc_id", "source", "size", sample_key(F.col("doc_id"), F.col("_t"), F.coalesce("_q", F.lit(1.0)), seed).alias("key")))
    plan = settle(budgets(rows, list(weights), share, cap))
    same = rows["source"].eqNullSafe(plan["source"])
    cell = F.floor(F.ln("key") * F.greatest(F.lit(1.0), F.col("n") / (math.e * CELL_ROWS))).alias("_cell")
    rows = rows.join(plan, same, "left").select("doc_id", rows["source"], "size", "key", "source_size", "target", cell)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    cells = rows.groupBy("source", "_cell").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("source", "_cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")), "left")
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long") - F.col("_ahead") - F.col("_before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "key", (F.col("epochs") * F.col("size") + part).alias("taken"))


def edges(mixed: DataFrame) -> DataFrame:
    """A row per source: its epochs and the (key, id, size) of the last row that the fractional pass takes from."""
    partly = F.col("taken") > F.col("epochs") * F.col("size")
    return mixed.groupBy("source").agg(
        F.max("epochs").alias("epochs"),
        F.max(F.when(partly, F.struct("key", "doc_id", "size"))).alias("edge"),
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """docs with the mix in effect: each row as often as the mix takes it. The row at a budget's edge stays whole;
    rows without words stay once. Since a source's choice is a key threshold, texts are
    not exchanged (but to find their weights, where those are too many to send to all tasks)."""
    cols = docs.columns
    size, key, q, qid, src, epochs, edge, times = fresh(docs, "_size", "_key", "_q", "_qid", "_src", "_epochs", "_edge", "_times")
    out = docs.withColumn(size, F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long"))
    if quality is not None:
        weights = settle(quality.select(F.col("doc_id").alias(qid), F.col("weight").alias(q)))
        out = out.join(sent_if_small(weights), F.col(f"`{id_col}`") == F.col(qid), "left")
    else:
        out = out.withColumn(q, F.lit(1.0))
    out = out.withColumn(key, sample_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.coalesce(q, F.lit(1.0)), seed))
    limits = settle(edges(mixed).select(F.col("source").alias(src), F.col("epochs").alias(epochs), F.col("edge").alias(edge)))  # a row per source
    out = out.join(sent_if_small(limits), F.col(f"`{source_col}`").eqNullSafe(F.col(src)), "left")
    taken = F.struct(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(size).alias("size")) <= F.col(edge)
    count = F.when(F.col(size) == 0, 1).otherwise(F.col(epochs) + F.coalesce(taken, F.lit(False)).cast("long"))
    out = out.withColumn(times, count.cast("int")).filter(F.col(times) > 0)
    return out.withColumn(size, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in cols])
