"""Record linkage: exact, blocked, nested-loop, neighbour and TF-IDF matching, and their waterfall.

Both sides are (id, name), name in the form compared (functions.text.name_key). Empty names match nothing. Results are
(left_id, right_id, score, rank); ties go to the smaller right id. Scores are in 0..100 for ratios, in 0..1 for cosines. With
apart=True rows of the same id do not match, for a table that is linked with itself.

Equal names are compared once, whatever the number of rows that have them, and only the smallest ids of a name take part on
the right, since no other can win. Blocks of names are dealt out in slabs, every left one with every right one, and a slab pair is
one unit of work (operators.products) that holds no more than its two slabs and gives the n best of each left name. Slabs bound
what a task holds; their numbers are bounded, so that what is exchanged grows with the input. Ratios are computed for pairs that
have enough letters in common, cosines for pairs of which enough is left from the rarest term that they share. All of this is exact; the number of pairs that
are looked at (not held, not exchanged) still grows with the square of a block.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import inverse_frequencies, term_counts, tfidf
from ..functions.text import block_key, token_sort
from ..sources.files import settle
from . import classify
from .dedup import top
from .products import best_cosines, best_ratios, rising

#: Names in a left slab of a block at least, how many left slabs at most; names in a right slab.
SLAB, SLABS, WIDE = 2048, 48, 1 << 15
#: The same for vectors, of which all are one block; right slabs of more than VECTORS names up to which they are cut anyway, so
#: that both sides go out in few copies, as many at all sizes up to VECTORS_WIDE names a slab.
VECTORS, VECTOR_SLABS, VECTORS_WIDE, VECTORS_ACROSS = 100, 8, 1 << 17, 4
#: Rows of a value up to which an equi-join meets them in one task.
HOT = 2048


def _classes(df: DataFrame, block: int, least: int) -> DataFrame:
    """id, block (the first characters, '' for none) and s, the sorted name."""
    rows = df.filter(F.length("name") >= max(1, least)).select("id", (block_key(F.col("name"), block) if block else F.lit("")).alias("block"), token_sort(F.col("name")).alias("s"))
    return rows.filter("s <> ''")


def _dealt(left: DataFrame, right: DataFrame, size: int, most: int, wide: int, across: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both sides (block, s, ...) with _i and _j, their slabs, each row as often as the other side has slabs: slabs of size names,
    but no more than most left and across right ones, unless they would hold over wide names. Only blocks of more than one slab
    are looked up: there are few."""
    counts = lambda df, n, least: df.groupBy("block").agg(F.count("*").alias(n)).filter(F.col(n) > least)
    large = counts(left, "_l", size).join(counts(right, "_r", size if across > 1 else wide), "block", "full")
    slabs = lambda n, most: F.greatest(F.least(F.lit(most), F.ceil(F.coalesce(n, F.lit(1)) / size)), F.ceil(F.coalesce(n, F.lit(1)) / wide)).cast("int")
    large = large.select("block", slabs("_l", most).alias("_m"), slabs("_r", across).alias("_n"))
    large = F.broadcast(settle(large))
    own = lambda n: F.pmod(F.xxhash64("s"), F.coalesce(F.col(n), F.lit(1))).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    l, r = left.join(large, "block", "left"), right.join(large, "block", "left")
    return l.withColumn("_i", own("_m")).withColumn("_j", all_of("_n")).drop("_m", "_n"), r.withColumn("_j", own("_n")).withColumn("_i", all_of("_m")).drop("_m", "_n")


def _met(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run on each two slabs (block, _i, _j) that meet."""
    keys = ["block", "_i", "_j"]
    right = right.toDF(*right.columns)  # columns of its own, where both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _expanded(left: DataFrame, right: DataFrame, scored: DataFrame, key: list[str], n: int, apart: bool) -> DataFrame:
    """The n best right rows of each left row, from scores of name pairs (key, a, b, score); left and right: id, key, s."""
    held = n + 1 if apart else n
    ids = top(right.select(*key, F.col("s").alias("b"), F.col("id").alias("right_id")).distinct(), [*key, "b"], ["right_id"], held, "_i").drop("_i")
    best = top(scored.join(ids, [*key, "b"]), [*key, "a"], [F.desc("score"), "right_id"], held, "_b").drop("_b", "b")
    rows = left.select(*key, F.col("s").alias("a"), F.col("id").alias("left_id")).join(best, [*key, "a"])
    if apart:
        rows = rows.filter(F.col("left_id") != F.col("right_id"))
    return top(rows, ["left_id"], [F.desc("score"), "right_id"], n).select("left_id", "right_id", "score", "rank")


def _by_ratio(left: DataFrame, right: DataFrame, threshold: float, n: int, block: int, least: int, apart: bool) -> DataFrame:
    l, r = settle(_classes(left, block, least)), settle(_classes(right, block, least))
    held = n + 1 if apart else n

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(rising(b["least"]))
        i, j, score = best_ratios(a["s"].to_pylist(), b["s"].to_pylist(), threshold, held)
        return pa.table({"block": a["block"].take(i), "a": a["s"].take(i), "b": b["s"].take(j), "score": score})

    names = l.select("block", "s").distinct(), r.groupBy("block", "s").agg(F.min("id").alias("least"))
    scored = _met(*_dealt(*map(settle, names), SLAB, SLABS, WIDE), run, "block string, a string, b string, score double")
    return _expanded(l, r, scored, ["block"], n, apart)


def blocked(left: DataFrame, right: DataFrame, *, threshold: float = 85, n: int = 1, block: int = 2, least: int = 1, apart: bool = False) -> DataFrame:
    """The n best right rows within each left row's block (equal first characters)."""
    return _by_ratio(left, right, threshold, n, block, least, apart)


def nested_loop(left: DataFrame, right: DataFrame, *, threshold: float = 85, n: int = 1, apart: bool = False) -> DataFrame:
    """The n best right rows of all, for each left row."""
    return _by_ratio(left, right, threshold, n, 0, 1, apart)


def _equal(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of left (its columns begin with l_) and right (r_) where a = b. Values of more than HOT rows on a side are dealt out
    in parts of HOT rows, every left one with every right one: no task holds or writes all pairs of a value."""
    l, r = left.filter(F.col(a).isNotNull()), right.filter(F.col(b).isNotNull())
    many = lambda df, c, n: df.groupBy(F.col(c).alias("_value")).agg(F.count("*").alias(n))
    hot = many(l, a, "_l").join(many(r, b, "_r"), "_value").filter(f"_l > {HOT} or _r > {HOT}")
    hot = settle(hot.select("_value", F.ceil(F.col("_l") / HOT).cast("int").alias("_m"), F.ceil(F.col("_r") / HOT).cast("int").alias("_n"), F.monotonically_increasing_id().alias("_h")))
    usual = l.join(F.broadcast(hot), F.col(a) == F.col("_value"), "left_anti").join(r, F.col(a) == F.col(b))
    part = lambda df, c, own, other, count, copies: df.join(F.broadcast(hot), F.col(c) == F.col("_value")).withColumn(own, F.pmod(F.xxhash64(c[:2] + "id"), F.col(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("_value", "_m", "_n")
    dealt = part(l, a, "_i", "_j", "_m", "_n").join(part(r, b, "_j", "_i", "_n", "_m"), ["_h", "_i", "_j"]).drop("_h", "_i", "_j")
    return usual.unionByName(dealt)


def exact(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """(left_id, right_id) of rows that agree on any of the key pairs, each once: an equi-join a pair of keys, without what an
    earlier one has. Only where a side repeats ids are the pairs themselves compared."""
    l, r = (settle(df.select(*[F.col(f"`{c}`").alias(f"{side}_{c}") for c in dict.fromkeys(["id", *[k[at] for k in keys]])])) for df, side, at in ((left, "l", 0), (right, "r", 1)))
    out, before = None, F.lit(False)
    for a, b in keys:
        pairs = _equal(l, r, f"l_{a}", f"r_{b}").filter(~before).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))
        out = pairs if out is None else out.union(pairs)
        before = before | F.coalesce(F.col(f"l_{a}") == F.col(f"r_{b}"), F.lit(False))
    repeated = any(not df.groupBy(c).count().filter("count > 1").isEmpty() for df, c in ((l, "l_id"), (r, "r_id")))
    return out.distinct() if repeated else out


def neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of (id, key) rows where one key begins with the other. Prefixes are spelt out, so both ways are equi-joins."""
    prefixes = lambda df: df.filter("key <> ''").select("id", "key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr(F.col("key"), F.lit(1), i))).alias("_prefix"))
    down = prefixes(left).alias("l").join(right.alias("r"), F.col("l._prefix") == F.col("r.key"))
    up = left.alias("l").join(prefixes(right).alias("r"), F.col("r._prefix") == F.col("l.key"))
    cols = [F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), F.col("l.key").alias("left_key"), F.col("r.key").alias("right_key")]
    return down.select(*cols).union(up.select(*cols)).distinct()


def cosine(left: DataFrame, right: DataFrame, *, threshold: float = 0.7, n: int = 1, grams: int = 1, max_df: float = 1.0, max_features: int | None = None, apart: bool = False) -> DataFrame:
    """The n nearest right rows of each left row by TF-IDF cosine, fitted on both sides together. Names and terms go by number."""
    left, right = settle(left.select("id", "name")), settle(right.select("id", "name"))
    names = settle(left.select("name").unionAll(right.select("name")).groupBy("name").agg(F.count("*").alias("times")).withColumn("s", F.monotonically_increasing_id()))
    l, r = (settle(df.filter("name <> ''").join(names, "name").select("id", "s")) for df in (left, right))
    counts = term_counts(names.select(F.col("s").alias("name"), "times", F.col("name").alias("_text")), F.col("_text"), grams)
    idf = settle(inverse_frequencies(counts, names, max_df=max_df, max_features=max_features))
    vectors = settle(tfidf(counts, idf).withColumnRenamed("name", "s"))
    held = n + 1 if apart else n

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(rising(b["least"]))
        i, j, score = best_cosines(a, b, threshold, held)
        return pa.table({"a": a["s"].take(i), "b": b["s"].take(j), "score": score})

    one = F.lit(0).alias("block")
    sides = l.select("s").distinct().join(vectors, "s").select(one, "*"), r.groupBy("s").agg(F.min("id").alias("least")).join(vectors, "s").select(one, "*")
    scored = _met(*_dealt(*map(settle, sides), VECTORS, VECTOR_SLABS, VECTORS_WIDE, VECTORS_ACROSS), run, "a long, b long, score double")
    return _expanded(l, r, scored.withColumn("score", F.round("score", 6)).filter(F.col("score") >= threshold), [], n, apart)


def by_model(left: DataFrame, right: DataFrame, *, client: Callable[[str, str], str] = classify.rule_client, least: float = 0.2, n: int = 3, apart: bool = False) -> DataFrame:
    """The best right row of each left row by a language model's answers about its n nearest ones (cosine of least or more)."""
    pairs = cosine(left, right, threshold=least, n=n, apart=apart).select("left_id", "right_id")
    pairs = pairs.join(left.select(F.col("id").alias("left_id"), F.col("name").alias("_a")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("name").alias("_b")), "right_id")
    said = classify.ask(pairs, "_a", "_b", client).select("left_id", "right_id", classify.parse(F.col("answer")).alias("r")).filter("r.is_match")
    return top(said.select("left_id", "right_id", F.col("r.confidence").alias("score")), ["left_id"], [F.desc("score"), "right_id"], 1)


def waterfall(left: DataFrame, right: DataFrame, *, client: Callable[[str, str], str] | None = classify.rule_client, apart: bool = False) -> DataFrame:
    """Exact names first, then the best in the block, then the nearest by cosine, then what a language model takes for a match
    (none with client=None); each stage sees only left rows that the stages before left over, and is settled before the next.
    score is in 0..1, raw_score in the stage's own unit."""
    left, right = settle(left), settle(right)
    held = top(right.filter("name <> ''"), ["name"], ["id"], 2 if apart else 1, "_i").select(F.col("id").alias("right_id"), "name")
    pairs = left.filter("name <> ''").select(F.col("id").alias("left_id"), "name").join(held, "name")
    if apart:
        pairs = pairs.filter(F.col("left_id") != F.col("right_id"))
    first = top(pairs, ["left_id"], ["right_id"], 1)
    out = settle(first.select("left_id", "right_id", F.lit(1.0).alias("score"), F.lit(100.0).alias("raw_score"), F.lit("exact").alias("method")))
    stages = [("fuzzy", blocked, 100.0), ("tfidf", cosine, 1.0)]
    if client:
        stages.append(("llm", lambda a, b, apart: by_model(a, b, client=client, apart=apart), 1.0))
    rest = left
    done = out
    for method, match, unit in stages:
        rest = settle(rest.join(done.select(F.col("left_id").alias("id")), "id", "left_anti"))
        got = match(rest, right, apart=apart)
        done = settle(got.select("left_id", "right_id", (F.col("score") / unit).alias("score"), F.col("score").alias("raw_score"), F.lit(method).alias("method")))
        out = out.unionByName(done)
    return out
