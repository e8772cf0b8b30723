"""Embedding near-duplicates by an index of nearest pivots.

A vector is described by its NEAREST nearest reference points (pivots), in the order of their distances: a prefix of its
permutation of all pivots. Inverted lists are kept for sets of SHARED pivots; a vector is in the list of every such set of its
own pivots whose ranks (from 0) add up to RANKS at most, since near ranks are the ones that a neighbour has, too, and far ones
change places easily. Two vectors meet if they share SHARED pivots of such ranks in both; the least of their common sets says in
which of their common lists the pair is taken up, so each pair is verified once, by its cosine in double precision.

Vectors of different lengths have no cosine. Each of the SPACES most frequent lengths has pivots and lists of its own; the
vectors of any other length form one list, so their search is exact.

Equal vectors are one class with a weight (classes are told apart by two 64-bit hashes). Lists of one class are dropped before
vectors are fetched. A list is worked on as products of matrices; lists longer than BLOCK are cut into blocks, every two of
which are one unit of work, so no list is held whole by one task and none is cut short. A unit gives link counts and edges that
connect what its links connect, never its pairs.

Pivots are chosen farthest-first from at most SAMPLE vectors in all, those with the smallest hashes (a documented bound), so
that a dense group holds no more than one and its members agree on their nearest; their number grows with the square root of
the number of vectors. Every vector is indexed. The tests measure recall against brute force.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; equal vectors
link; repeated rows are vectors of their own, also under one id; null ids never name a component unless alone; other columns
do not take part; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, settle
from .components import components, joined

SAMPLE, NEAREST, SHARED, RANKS, BLOCK = 4096, 10, 3, 11, 1024
#: Lengths with pivots of their own; pivots at least and at most, and the number of vectors from which on they become more.
SPACES, PIVOTS, PIVOTS_MOST, GROWTH = 16, 256, 2048, 1 << 18


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice among unit vectors."""
    at = [0]
    near = sample @ sample[0]
    while len(at) < min(count, len(sample)):
        i = int(near.argmin())
        if near[i] > 0.999:
            break
        at.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[at]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components end to end, and where each vector begins (one more entry: the end)."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def picks(m: int) -> np.ndarray:
    """The sets of ranks, of m, whose pivots have lists."""
    width = min(SHARED, m)
    return np.array([c for c in itertools.combinations(range(m), width) if sum(c) <= RANKS], np.int64).reshape(-1, width)


def packed(pivots: np.ndarray) -> np.ndarray:
    """A number for each set of pivots (last axis)."""
    key = np.zeros(pivots.shape[:-1], np.int64)
    for c in np.moveaxis(np.sort(pivots, axis=-1), -1, 0):
        key = key * PIVOTS_MOST + c
    return key


def _listed(pivots: dict[int, np.ndarray]):
    """Nodes (node, embedding) to a row for each inverted list they are in: key, node, near (the ordered pivots as bytes). pivots: by
    vector length. A key holds the number of the length and SHARED pivots; for lengths without pivots it is minus the length."""
    order = {d: k for k, d in enumerate(sorted(pivots))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                flat, edge = _rows(batch.column(1))
                sizes = np.diff(edge)
                for d in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == d)
                    node = batch.column(0).take(pa.array(own))
                    if d not in pivots:
                        keys, near, rep = np.full(len(own), -d), [b""] * len(own), np.arange(len(own))
                    else:
                        x = flat[edge[own][:, None] + np.arange(d)].astype(np.float64)
                        m = min(NEAREST, len(pivots[d]))
                        best = np.argsort(-(_unit(x) @ pivots[d].T), axis=1, kind="stable")[:, :m].astype(np.uint16)
                        sets = picks(m)
                        keys = packed(best[:, sets].astype(np.int64)) + order[d] * PIVOTS_MOST ** sets.shape[1]
                        keys, rep, near = keys.ravel(), np.repeat(np.arange(len(own)), len(sets)), [r.tobytes() for r in best]
                    rep = pa.array(rep)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), node.take(rep), pa.array(near, pa.binary()).take(rep)], names=["key", "node", "near"])

    return run, "key long, node long, near binary"


def taken_up(key: np.ndarray, near: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of pairs (p, q) of members of the lists key[p], those for which that list is the first (of least key) that both are in."""
    if not near.shape[1]:
        return np.ones(len(p), bool)
    sets = picks(near.shape[1])
    own = key[p] % PIVOTS_MOST ** sets.shape[1]
    out = np.ones(len(p), bool)
    for s in range(0, len(p), 1 << 14):
        e = slice(s, s + (1 << 14))
        a = near[p[e]]
        same = a[:, :, None] == near[q[e]][:, None, :]
        rank = np.where(same.any(2), same.argmax(2), RANKS + 1)
        for c in sets:  # whether a set of a lesser key is in both
            out[e] &= ~((rank[:, c].sum(1) <= RANKS) & (packed(a[:, c].astype(np.int64)) < own[e]))
    return out


def unit_pairs(x: np.ndarray, left: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of one unit whose cosine reaches threshold. left: which are of the first block; all: pairs within,
    else pairs across."""
    a = np.flatnonzero(left)
    b = a if left.all() else np.flatnonzero(~left)
    hit = x[a] @ x[b].T >= threshold
    if b is a:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    return a[i], b[j]


#: Members of a unit up to which units of a size are worked on side by side; numbers that are gathered at once.
FEW, GATHERED = 32, 1 << 22


def small_pairs(x: np.ndarray, begin: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """What unit_pairs() gives, for many units of few members each, rows begin to begin + size."""
    ps, qs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size).tolist():
        a, b = np.triu_indices(m, 1)
        own = begin[size == m]
        p, q = (own[:, None] + a).ravel(), (own[:, None] + b).ravel()
        step = max(1, GATHERED // x.shape[1])
        for s in range(0, len(p), step):
            hit = np.einsum("ij,ij->i", x[p[s : s + step]], x[q[s : s + step]]) >= threshold
            ps.append(p[s : s + step][hit])
            qs.append(q[s : s + step][hit])
    return np.concatenate(ps), np.concatenate(qs)


def _linked(threshold: float, kind: type):
    """Rows of inverted lists, sorted by unit, to link counts (u, null, n) and edges (u, v, null)."""

    def of_length(t: pa.Table) -> pa.RecordBatch | None:
        n = len(t)
        key, i, j, node, weight, blk = (t.column(c).to_numpy() for c in ("key", "i", "j", "node", "weight", "blk"))
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint16).reshape(n, -1)
        x = _unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).reshape(n, -1).astype(np.float64))
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate((begin, [n])))
        few = (size <= FEW) & (i[begin] == j[begin])
        found = [small_pairs(x, begin[few], size[few], threshold)]
        count, up = np.zeros(n, np.int64), np.arange(n)

        def take(p: np.ndarray, q: np.ndarray) -> None:
            nonlocal up
            for s in range(0, len(p), 1 << 18):
                ps, qs = p[s : s + (1 << 18)], q[s : s + (1 << 18)]
                mine = taken_up(key, near, ps, qs)
                ps, qs = ps[mine], qs[mine]
                np.add.at(count, ps, weight[qs])
                np.add.at(count, qs, weight[ps])
                up = joined(n, np.concatenate((ps, np.arange(n))), np.concatenate((qs, up)))

        take(*found[0])
        for s, m in zip(begin[~few].tolist(), size[~few].tolist(), strict=True):
            p, q = unit_pairs(x[s : s + m], blk[s : s + m] == i[s], threshold)
            take(p + s, q + s)
        some, tied = np.flatnonzero(count), np.flatnonzero(up != np.arange(n))
        if not len(some) and not len(tied):
            return None
        u, v = np.concatenate((node[some], node[tied])), np.concatenate((np.zeros(len(some), np.int64), node[up[tied]]))
        c = np.concatenate((count[some], np.zeros(len(tied), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=c > 0), pa.array(c, mask=c == 0)], names=["u", "v", "n"])

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows).combine_chunks()
        length = pc.binary_length(t.column("vec")).to_numpy()
        for d in np.unique(length).tolist():
            if (made := of_length(t.filter(pa.array(length == d)).combine_chunks())) is not None:
                yield made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            unit = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in unit]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last unit may go on in the next batch
            if held and cut == 0 and any(h.column(h.schema.get_field_index(c))[-1].as_py() != batch.column(batch.schema.get_field_index(c))[0].as_py() for h in held[-1:] for c in ("key", "i", "j")):
                yield from flush(held)
                held = []
            if cut:
                yield from flush([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from flush(held)

    return run


def _packed(kind: type):
    """(node, weight, embedding) to (node, weight, vec), the components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, edge = _rows(batch.column(2))
            flat = flat.astype(kind)
            vec = [flat[s:e].tobytes() for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary())], names=["node", "weight", "vec"])

    return run, "node long, weight long, vec binary"


def fit(classes: DataFrame, pivots: int | None) -> dict[int, np.ndarray]:
    """Pivots by vector length, of the SPACES most frequent lengths of classes (node, embedding)."""
    lengths = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(SPACES).collect()
    found = {}
    for d, n in lengths:
        sample = classes.filter(F.size("embedding") == d).select(F.xxhash64("node").alias("h"), "embedding").orderBy("h").limit(SAMPLE // len(lengths)).collect()
        count = pivots or min(PIVOTS_MOST, max(PIVOTS, int(PIVOTS * (n / GROWTH) ** 0.5)))
        found[d] = choose_pivots(_unit(np.array([r["embedding"] for r in sample], np.float64)), count)
    return found


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, pivots: int | None = None) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept (whether it names its component). pivots: their number a
    length, where it shall not follow from the number of vectors."""
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<float>" if element == "float" else "array<double>").alias("embedding"))
    zero = F.lit(0.0).cast("float" if element == "float" else "double")
    rows = rows.withColumn("embedding", F.when(usable(F.col("embedding")), F.transform("embedding", lambda x: F.when(x == 0, zero).otherwise(x))))
    rows = rows.withColumns({"cls": F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")), "check": F.xxhash64(F.lit(1), "embedding")})
    classes = settle(rows.filter("cls is not null").groupBy("cls", "check").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")))
    twice = classes.groupBy(F.col("cls").alias("_c")).agg(F.count("*").alias("n")).filter("n > 1")
    if twice.isEmpty():
        classes = classes.withColumn("node", F.col("cls"))
    else:  # different vectors of one hash
        classes = settle(classes.join(twice, F.col("cls") == F.col("_c"), "left").withColumn("node", F.when(F.col("n").isNull(), F.col("cls")).otherwise(F.xxhash64("cls", "check"))).drop("_c", "n"))
    chosen = fit(classes, pivots)
    if not chosen:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lists, schema = _listed(chosen)
    listed = classes.select("node", "embedding").mapInArrow(lean(lists), schema)
    several = settle(listed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    listed = listed.join(several, "key")
    listed = listed.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pack, schema = _packed(kind)
    packed = classes.select("node", "weight", "embedding").mapInArrow(lean(pack), schema)
    listed = listed.join(packed, "node").select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "node", "weight", "near", "vec")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = settle(listed.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(_linked(threshold, kind)), "u long, v long, n long"))
    counts = found.filter("v is null").groupBy(F.col("u").alias("_u")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("v is not null").select("u", "v"))
    per = classes.select("node", "weight", "least", "cls", "check").join(counts, F.col("node") == F.col("_u"), "left").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    per = per.select("cls", "check", "least", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    heads = per.groupBy("root").agg(F.min("least").alias("component_id"))
    per = per.join(heads, "root").select("cls", "check", "n_links", "component_id")
    out = rows.select("vec_id", "cls", "check").join(per, ["cls", "check"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
