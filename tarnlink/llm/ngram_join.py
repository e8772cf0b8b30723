"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Every text becomes its set of shingle hashes, worked on in slabs of texts. Equal sets within a slab are one. Shingles are
   dealt to buckets by hash (4 bytes each plus a 2-byte reference) and counted exactly; only shingles that occur twice or
   more travel back to their slab. A shingle that HOT or more sets of one slab hold stays there: its bucket only gets a notice,
   and it counts as the most frequent kind everywhere, so no bucket holds a reference for each of very many texts. A text
   orders its shingles by (count, hash), so those that no other text has come first and use up the prefix; most texts
   have no shared shingle left in it and are done.
   Buckets and slabs grow in number with the input, partitions only up to a bound: what is exchanged goes out as one row for
   each partition, is cut into rows by bucket (or slab) where it arrives, sorted within the partition, which may spill,
   and worked on one bucket (or slab) at a time.
2. Equal sets are one class. Classes meet on the shared shingles of their prefixes. Shingles with at most FEW
   classes give pairs, cut by the length and the positional filter, made distinct, and verified once each, first by
   the suffix filter, then by exact intersection.
3. A shingle with more than FEW classes would give a square of pairs. The classes of such shingles form families;
   a family is cut by set size into blocks, and two blocks of compatible sizes are intersected exactly, giving edges that
   connect what their links connect. First each block by itself; then one member of each component that this has found
   with those of the others; then whatever is in two components still: the largest component's members aren't compared
   again with each other. No candidate is dropped.
4. Components over all links; a document's component is the least doc_id in it.

Shingle ids of 32 bits within a bucket may collide. That costs candidates, never links: the prefix length counts
shingles, and entries that collide count as shared. Sets count as equal when their 64-bit hashes agree.

The input must come back in the same order when read again (files, a checkpoint), as every scan does. Ids are integers.

Defined cases: null, empty and white-space texts have n_shingles 0 and are linked with nothing (component_id is
their own id); a text with fewer words than a shingle has the whole sequence as its one shingle; equal texts link;
null ids sort after all others and join a component without naming it unless they are alone; repeated rows are
rows of their own; an empty table gives no rows; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, lean, sent_if_small, settle, text_batches, text_bytes
from .components import components, joined
from .wordhash import U, mix, raw, shingle_sets, slabs

NULL_ID = -(1 << 63)
#: Classes that may share a shingle before blocks take over from pairs; classes in a block.
FEW, BLOCK = 48, 256
#: Bytes of text for each bucket of shingles, and in a slab; texts in a slab at most; partitions of an exchange at most.
BUCKET_BYTES, SLAB_BYTES, SLAB_TEXTS, PARTS_MOST = 7 << 20, 4 << 20, 1 << 16, 20_000
#: Sets of a slab from which on a shingle of theirs stays in it: at most HOT, fewer where slabs are many (HELD / slabs), at least 4.
HOT, HELD = 64, 1 << 24
#: The count that stands for "hot".
MANY = (1 << 31) - 1
#: Bytes that are cut into rows at once after an exchange.
HAND = 8 << 20
_SCHEMA = pa.schema([("part", pa.int32()), ("grp", pa.int64()), ("slab", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcd")])
_BLOBS = "part int, grp long, slab long, kind int, a binary, b binary, c binary, d binary"
# Kinds of rows: the documents of a slab (ids, classes, sizes); shingles and references; shingles that come back, with counts;
# hot shingles of a slab and the documents that have them; notices of hot shingles.
DOCS, REFS, COUNTS, HOTS, NOTICES = range(5)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((),) * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(x.to_pylist() for x in batch.columns), strict=True)


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of each run."""
    edge = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1], [True]))) if len(sorted_keys) else np.zeros(1, int)
    return zip(sorted_keys[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)


def _class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))], dtype=U)).view(np.int64)[0])


def _part_of(slab: np.ndarray | int, parts: int) -> np.ndarray:
    return (mix(np.atleast_1d(np.asarray(slab, np.int64)).view(U)) % U(parts)).astype(np.int64)


def _dealt(buckets: int, parts: int, hot: int, k: int):
    """Texts to rows of documents, of shingles by the partition of their bucket, of hot shingles and of notices."""

    def slab_rows(slab: int, ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
        cls = np.array([_class_of(s) for s in sets], np.int64)
        sizes = np.array([len(s) for s in sets], np.int64)
        home = int(_part_of(slab, parts)[0])
        rows = [(home, -1, slab, DOCS, ids.tobytes(), cls.tobytes(), sizes.astype(np.int32).tobytes(), b"")]
        once = np.sort(np.unique(cls, return_index=True)[1])  # of equal sets the first
        h = np.concatenate([sets[i] for i in once]) if len(once) else np.zeros(0, U)
        who = np.repeat(once, sizes[once]).astype(np.uint16)
        bucket = ((h >> U(32)) % U(buckets)).astype(np.int64)
        low = h.astype(np.uint32)
        del h
        order = np.lexsort((low, bucket))
        bucket, low, who = bucket[order], low[order], who[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (bucket[1:] != bucket[:-1])
        edge = np.flatnonzero(new)
        times = np.diff(np.concatenate((edge, [len(low)])))
        many = times >= hot
        if many.any():
            first, stay = edge[many], np.repeat(many, times)
            at = np.repeat(np.cumsum(many) - 1, times)[stay].astype(np.uint32)
            rows.append((home, -1, slab, HOTS, ((bucket[first] << 32) + low[first]).tobytes(), who[stay].tobytes(), at.tobytes(), b""))
            to = bucket[first] % parts
            rows += [(int(p), -2, slab, NOTICES, bucket[first][to == p].tobytes(), low[first][to == p].tobytes(), b"", b"") for p in np.unique(to)]
            bucket, low, who = bucket[~stay], low[~stay], who[~stay]
        order = np.argsort(bucket % parts, kind="stable")
        bucket, low, who = bucket[order], low[order], who[order]
        for p, s, e in _runs(bucket % parts):
            own = list(_runs(bucket[s:e]))
            rows.append((p, -2, slab, REFS, low[s:e].tobytes(), who[s:e].tobytes(), np.array([x for x, _, _ in own], np.int64).tobytes(), np.array([j - i for _, i, j in own], np.int64).tobytes()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        slab, held, ids, size, texts = (ctx.partitionId() if ctx else 0) << 24, [], [], 0, 0
        for batch in batches:
            own = batch.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            data, offsets = raw(batch.column(1))
            for i, j in slabs(offsets):
                for i in range(i, j, SLAB_TEXTS):
                    e = min(j, i + SLAB_TEXTS)
                    if held and (size + offsets[e] - offsets[i] > SLAB_BYTES or texts + e - i > SLAB_TEXTS):
                        yield _blobs(slab_rows(slab, np.concatenate(ids), held))
                        slab, held, ids, size, texts = slab + 1, [], [], 0, 0
                    held += shingle_sets(data, offsets[i : e + 1], k)
                    ids.append(own[i:e])
                    size, texts = size + int(offsets[e] - offsets[i]), texts + e - i
        if held:
            yield _blobs(slab_rows(slab, np.concatenate(ids), held))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by partition to rows by bucket; rows that go on to a slab's partition stay as they are."""
    held: list[tuple] = []
    size = 0

    def cut() -> pa.RecordBatch:
        out = []
        refs = [r for r in held if r[3] == REFS]
        if refs:
            low, who = np.concatenate([np.frombuffer(r[4], np.uint32) for r in refs]), np.concatenate([np.frombuffer(r[5], np.uint16) for r in refs])
            counts = [np.frombuffer(r[7], np.int64) for r in refs]
            count = np.concatenate(counts)
            slab = np.repeat(np.array([r[2] for r in refs], np.int64), [len(c) for c in counts])
            bucket = np.concatenate([np.frombuffer(r[6], np.int64) for r in refs])
            begin = np.cumsum(count) - count
            order = np.argsort(bucket, kind="stable")
            for b, s, e in _runs(bucket[order]):
                own = order[s:e]
                low_of = np.concatenate([low[begin[x] : begin[x] + count[x]] for x in own])
                who_of = np.concatenate([who[begin[x] : begin[x] + count[x]] for x in own])
                out.append((0, b, 0, REFS, low_of.tobytes(), who_of.tobytes(), slab[own].tobytes(), count[own].tobytes()))
        notes = [r for r in held if r[3] == NOTICES]
        if notes:
            bucket, low = np.concatenate([np.frombuffer(r[4], np.int64) for r in notes]), np.concatenate([np.frombuffer(r[5], np.uint32) for r in notes])
            order = np.argsort(bucket, kind="stable")
            out += [(0, b, 0, NOTICES, np.unique(low[order[s:e]]).tobytes(), b"", b"", b"") for b, s, e in _runs(bucket[order])]
        return _blobs(out)

    for batch in batches:
        for r in _rows(batch):
            if r[3] in (DOCS, HOTS):
                yield _blobs([r])
                continue
            held.append(r)
            size += sum(map(len, r[4:]))
            if size > HAND:
                yield cut()
                held, size = [], 0
    if held:
        yield cut()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each group, of rows that are sorted by group."""
    held: list[tuple] = []
    for batch in batches:
        for r in _rows(batch):
            if held and r[1] != held[0][1]:
                yield held[0][1], held
                held = []
            held.append(r)
    if held:
        yield held[0][1], held


def _counted(parts: int):
    """Rows by bucket, in order, to rows (COUNTS) of the shingles that occur twice or more, by the partition of their slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def cut() -> pa.RecordBatch:
            slab, who, tok, df = (np.concatenate(x) for x in zip(*held, strict=True))
            to = _part_of(slab, parts)
            order = np.lexsort((slab, to))
            slab, who, tok, df, to = slab[order], who[order], tok[order], df[order], to[order]
            out = []
            for p, s, e in _runs(to):
                own = np.array([(x, j - i) for x, i, j in _runs(slab[s:e])], np.int64)
                out.append((p, -1, 0, COUNTS, who[s:e].tobytes(), tok[s:e].tobytes(), df[s:e].tobytes(), own.tobytes()))
            return _blobs(out)

        for bucket, rows in _grouped(_passed(batches, (aside := []))):
            while aside:
                yield aside.pop()
            refs = [r for r in rows if r[3] == REFS]
            if not refs:
                continue
            low, who = np.concatenate([np.frombuffer(r[4], np.uint32) for r in refs]), np.concatenate([np.frombuffer(r[5], np.uint16) for r in refs])
            slab = np.repeat(np.concatenate([np.frombuffer(r[6], np.int64) for r in refs]), np.concatenate([np.frombuffer(r[7], np.int64) for r in refs]))
            noted = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[4], np.uint32) for r in rows if r[3] == NOTICES)]))
            order = np.argsort(low, kind="stable")
            low, who, slab = low[order], who[order], slab[order]
            edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
            count = np.diff(edge)
            count = np.where(np.isin(low[edge[:-1]], noted), MANY, count)
            df = np.repeat(count, np.diff(edge))
            keep = df > 1
            if keep.any():
                held.append((slab[keep], who[keep], low[keep].astype(np.int64) + (bucket << 32), df[keep].astype(np.int32)))
                size += 22 * int(keep.sum())
            if size > HAND:
                yield cut()
                held, size = [], 0
        while aside:
            yield aside.pop()
        if held:
            yield cut()

    return run


def _passed(batches: Iterator[pa.RecordBatch], aside: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches without rows of documents and of hot shingles, which go aside."""
    for batch in batches:
        kind = batch.column(3).to_numpy()
        on = (kind == DOCS) | (kind == HOTS)
        if on.any():
            aside.append(batch.filter(pa.array(on)))
        if not on.all():
            yield batch.filter(pa.array(~on))


def _by_slab(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by partition to rows by slab (the group)."""
    held: list[tuple] = []
    size = 0

    def cut() -> pa.RecordBatch:
        who, tok, df = (np.concatenate([np.frombuffer(r[c], t) for r in held]) for c, t in ((4, np.uint16), (5, np.int64), (6, np.int32)))
        run = np.concatenate([np.frombuffer(r[7], np.int64).reshape(-1, 2) for r in held])
        slab = np.repeat(run[:, 0], run[:, 1])
        order = np.argsort(slab, kind="stable")
        who, tok, df = who[order], tok[order], df[order]
        return _blobs([(0, x, x, COUNTS, who[s:e].tobytes(), tok[s:e].tobytes(), df[s:e].tobytes(), b"") for x, s, e in _runs(slab[order])])

    for batch in batches:
        for r in _rows(batch):
            if r[3] != COUNTS:
                yield _blobs([(0, r[2], *r[2:])])
                continue
            held.append(r)
            size += sum(map(len, r[4:]))
            if size > HAND:
                yield cut()
                held, size = [], 0
    if held:
        yield cut()


def _prefixes(num: int, den: int):
    """Rows by slab, in order, to a row per document with the shared part of its prefix."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("alone", pa.int32()), ("toks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            (docs,) = (r for r in rows if r[3] == DOCS)
            ids, cls, n = np.frombuffer(docs[4], np.int64), np.frombuffer(docs[5], np.int64), np.frombuffer(docs[6], np.int32)
            parts = [tuple(np.frombuffer(r[c], t) for c, t in ((4, np.uint16), (5, np.int64), (6, np.int32))) for r in rows if r[3] == COUNTS]
            for r in rows:
                if r[3] == HOTS:
                    at = np.frombuffer(r[6], np.uint32)
                    parts.append((np.frombuffer(r[5], np.uint16), np.frombuffer(r[4], np.int64)[at], np.full(len(at), MANY, np.int32)))
            at, tok, df = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (ids[:0], ids[:0], n[:0])
            at = at.astype(np.int64)
            shared = np.bincount(at, minlength=len(ids))
            alone = n - shared
            need = n - -(-num * n.astype(np.int64) // den) + 1 - alone  # entries of the prefix that others have, too
            live = need[at] > 0
            at, tok, df = at[live], tok[live], df[live]
            order = np.lexsort((tok, df, at))
            at, tok = at[order], tok[order]
            if len(at):
                new = np.concatenate(([True], (at[1:] != at[:-1]) | (tok[1:] != tok[:-1])))
                at, tok = at[new], tok[new]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                keep = rank < need[at]
                at, tok = at[keep], tok[keep]
            ends = np.searchsorted(at, np.arange(len(ids) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=ids == NULL_ID), pa.array(n), pa.array(cls), pa.array(alone.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(tok)),
            ], schema=out)

    return run, "doc_id long, n int, cls long, alone int, toks array<long>"


def prefixes(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """A row per document: doc_id, n, cls, alone (shingles that no other document has) and toks, the rest of its
    rare-first prefix; position of toks[i] in the order: alone + i. Kept in the checkpoint folder."""
    text_batches(docs.sparkSession)
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must hold integers")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = text_bytes(rows, "text")
    buckets = max(4, -(-size // BUCKET_BYTES))
    parts = min(max(4, buckets // 2), max(PARTS_MOST, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = min(HOT, max(4, HELD // max(1, size // SLAB_BYTES)))
    blobs = rows.mapInArrow(lean(_dealt(buckets, parts, hot, k)), _BLOBS)
    blobs = blobs.repartition(parts, "part").mapInArrow(lean(_by_bucket), _BLOBS).sortWithinPartitions("grp").mapInArrow(lean(_counted(parts)), _BLOBS)
    blobs = blobs.repartition(parts, "part").mapInArrow(lean(_by_slab), _BLOBS).sortWithinPartitions("grp")
    fn, schema = _prefixes(num, den)
    return settle(blobs.mapInArrow(lean(fn), schema))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """At least so many elements are in one of the sorted sets only."""
    if depth == 0 or len(x) < 2 or len(y) < 2:
        return abs(len(x) - len(y))
    m = len(y) // 2
    i = int(np.searchsorted(x, y[m]))
    hit = i < len(x) and x[i] == y[m]
    return suffix_bound(x[:i], y[:m], depth - 1) + suffix_bound(x[i + hit :], y[m + 1 :], depth - 1) + (not hit)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union, for sorted distinct hashes."""
    total = len(x) + len(y)
    need = -(-num * total // (num + den))
    if min(len(x), len(y)) < need or suffix_bound(x, y) > total - 2 * need:
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def _verified(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in (2, 3):
                data, offsets = raw(batch.column(c))
                sets.append([s for i, j in slabs(offsets) for s in shingle_sets(data, offsets[i : j + 1], k)])
            keep = pa.array([linked(x, y, num, den) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return run


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect what the links between left and right connect, or those within left where right is None, by exact
    intersection sizes: a product of 0/1 matrices over the shingles that occur twice or more, some at a time."""
    sets = left + (right or [])
    n, size = len(left), np.array([len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    col = np.where(times[col] > 1, (np.cumsum(times > 1) - 1)[col], -1)
    width, a, b = 8192, slice(0, n), slice(n, None) if right else slice(0, n)
    common = np.zeros((n, len(right) if right else n), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int((times > 1).sum()), width):
        i, j = np.searchsorted(col, [at, at + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[row[i:j], col[i:j] - at] = 1
        common += m[a] @ m[b].T
    union = size[a][:, None] + size[b][None, :] - common
    hit = den * common.astype(np.int64) >= num * union
    if not right:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    up = joined(len(sets), i, j + (n if right else 0))
    apart = np.flatnonzero(up != np.arange(len(sets)))
    return list(zip(apart.tolist(), up[apart].tolist(), strict=True))


def _blocks(k: int, num: int, den: int):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        data, offsets = raw(t.column("text"))
        sets = [s for i, j in slabs(offsets) for s in shingle_sets(data, offsets[i : j + 1], k)]
        blk, cls = t.column("blk").to_pylist(), t.column("cls").to_pylist()
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        first = t.column("i")[0].as_py()
        a = [x for x, b in enumerate(blk) if b == first]
        b = [] if same else [x for x, y in enumerate(blk) if y != first]
        names = [cls[x] for x in a + b]
        found = block_links([sets[x] for x in a], [sets[x] for x in b] if b else None, num, den) if same or (a and b) else []
        return pa.Table.from_arrays([pa.array([names[i] for i, _ in found], pa.int64()), pa.array([names[j] for _, j in found], pa.int64())], schema=out)

    return run


def class_texts(docs: DataFrame, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(cls, text), one row for each class in wanted (cls). wanted is sent to all tasks only where its count
    shows that it is small; otherwise texts are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(0))
            cls = [_class_of(s) for i, j in slabs(offsets) for s in shingle_sets(data, offsets[i : j + 1], k)]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), batch.column(0)], names=["cls", "text"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(run), "cls long, text string")
    return rows.join(sent_if_small(wanted), "cls", "left_semi").groupBy("cls").agg(F.first("text").alias("text"))


def cells(member: DataFrame, *also: str) -> DataFrame:
    """member (cls, n, root, ...) with blk: blocks of about BLOCK members of like size within each root (and the columns also).
    Sizes fall into bands of one part in a hundred; bands are summed up in their order, and a band with more than BLOCK members is
    dealt out by hash. No root is sorted by one task: only its bands are, which are about 1,000 for sizes up to 20,000."""
    member = member.withColumn("band", F.floor(F.ln("n") * 100))
    per = member.groupBy("root", *also, "band").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("root", *also).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumns({"base": F.floor(before / BLOCK), "ways": F.ceil(F.col("c") / BLOCK)}).drop("c")
    place = (F.col("base") + F.pmod(F.xxhash64("cls"), F.col("ways"))).cast("int")
    return member.join(per, ["root", *also, "band"]).withColumn("blk", place).drop("base", "ways", "band")


def inside(member: DataFrame, duos: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (u, v) from intersecting the blocks i and j of a root, for each row of duos (root, i, j). member: cls, root, blk."""
    sides = duos.withColumn("blk", F.explode(F.array_distinct(F.array("i", "j"))))
    sides = sides.join(member.select("root", "blk", "cls"), ["root", "blk"]).join(texts, "cls").select("root", "i", "j", "blk", "cls", "text")
    return settle(sides.groupBy("root", "i", "j").applyInArrow(_blocks(k, num, den), "u long, v long"))


def compatible(member: DataFrame, num: int, den: int, *also: str) -> DataFrame:
    """Pairs of blocks (sides p and q of a root, p.blk < q.blk) whose sizes allow links; also: columns that a block has one
    value of."""
    span = member.groupBy("root", "blk", *also).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    p, q = span.alias("p"), span.alias("q")
    near = (F.col("q.least") * num <= F.col("p.most") * den) & (F.col("p.least") * num <= F.col("q.most") * den)
    return p.join(q, (F.col("p.root") == F.col("q.root")) & (F.col("p.blk") < F.col("q.blk")) & near)


def family_links(member: DataFrame, found: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges that connect what the links within families (member: cls, n, root) connect, given those found already."""
    duo = lambda pairs: pairs.select(F.col("p.root").alias("root"), F.col("p.blk").alias("i"), F.col("q.blk").alias("j"))

    def labelled(edges: DataFrame) -> DataFrame:
        own = components(edges).select(F.col("node").alias("_n"), F.col("root").alias("_l"))
        return member.join(own, F.col("cls") == F.col("_n"), "left").select("cls", "n", "root", F.coalesce("_l", "cls").alias("label"))

    first = settle(cells(member))
    edges = inside(first, first.select("root", F.col("blk").alias("i"), F.col("blk").alias("j")).distinct(), texts, k, num, den).union(found)
    if first.filter("blk > 0").isEmpty():
        return edges
    rows = settle(labelled(edges))
    heads = settle(rows.groupBy("root", "label").agg(F.min(F.struct("cls", "n")).alias("h")).select("root", "h.cls", "h.n"))
    some = settle(cells(heads))
    edges = edges.union(inside(some, duo(compatible(some, num, den)).union(some.select("root", F.col("blk").alias("i"), F.col("blk").alias("j")).distinct()), texts, k, num, den))
    rows = settle(labelled(edges))
    sizes = rows.groupBy("root", "label").agg(F.count("*").alias("m"))
    main = settle(sizes.groupBy("root").agg(F.max(F.struct("m", "label"))["label"].alias("main")))
    seen = heads.select("cls", F.lit(True).alias("head"))
    rows = rows.join(sent_if_small(main), "root").join(seen, "cls", "left").withColumn("state", F.when(F.col("label") == F.col("main"), 0).when(F.col("head").isNull(), 1).otherwise(2))
    # 0: in the largest component; 1, 2: outside it, 2 compared with the other heads already
    rows = settle(cells(rows.select("cls", "n", "root", "state"), "state").withColumn("blk", F.col("blk") * 3 + F.col("state")).select("cls", "n", "root", "state", "blk"))
    p, q = F.col("p.state"), F.col("q.state")
    duos = duo(compatible(rows, num, den, "state").filter(~((p == q) & p.isin(0, 2))))
    duos = duos.union(rows.filter("state = 1").select("root", F.col("blk").alias("i"), F.col("blk").alias("j")).distinct())
    return edges.union(inside(rows, duos, texts, k, num, den))


def links(docs: DataFrame, table: DataFrame, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Links (u, v) between classes of table (as prefixes() makes it): every link up to connectivity."""
    per = table.filter(F.size("toks") > 0).groupBy("cls", "n", "alone").agg(F.first("toks").alias("toks"))
    rows = per.select("cls", "n", F.posexplode("toks").alias("i", "tok"), "alone").select("tok", "cls", "n", (F.col("alone") + F.col("i")).alias("pos"))
    many = rows.groupBy("tok").agg(F.count("*").alias("m")).filter("m > 1")
    rows = settle(rows.join(many, "tok"))
    few = rows.filter(F.col("m") <= FEW).select("tok", "cls", "n", "pos")
    x, y = few.alias("x"), few.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * num / (num + den))
    rest = 1 + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - 1
    near = (F.col("x.cls") < F.col("y.cls")) & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")) & (rest >= need)
    pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & near).select(F.col("x.cls").alias("u"), F.col("y.cls").alias("v")).distinct()
    hot = rows.filter(F.col("m") > FEW).select("tok", "cls", "n")
    star = hot.groupBy("tok").agg(F.min("cls").alias("v"))
    roots = components(hot.join(star, "tok").select(F.col("cls").alias("u"), "v"))
    pairs = settle(pairs)
    member = settle(hot.select("cls", "n").distinct().join(roots, F.col("cls") == F.col("node")).select("cls", "n", "root"))
    wanted = settle(pairs.select(F.explode(F.array("u", "v")).alias("cls")).union(member.select("cls")).distinct())
    texts = settle(class_texts(docs, text_col, k, wanted))
    a, b = texts.select(F.col("cls").alias("u"), F.col("text").alias("ta")), texts.select(F.col("cls").alias("v"), F.col("text").alias("tb"))
    found = pairs.join(a, "u").join(b, "v").select("u", "v", "ta", "tb").mapInArrow(lean(_verified(k, num, den)), "u long, v long")
    if member.isEmpty():
        return found
    return family_links(member, settle(found), texts, k, num, den)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, class (equal sets share one), group (the same for all
    classes of a component; null without words). Texts are linked when den * intersection >= num * union of their
    shingle sets."""
    table = prefixes(docs, id_col, text_col, k, num, den)
    roots = components(links(docs, table, text_col, k, num, den))
    full = table.filter("n > 0")
    least = full.groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "root").select(F.col("cls").alias("_c"), "component_id", F.col("root").alias("group"))
    out = table.join(named, (F.col("cls") == F.col("_c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class"), "group")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: the one of least id (null ids last). Rows without words all stay."""
    text_batches(docs.sparkSession)
    found = settle(near_duplicates(docs, id_col=id_col, text_col=text_col, k=k, num=num, den=den).filter("n_shingles > 0").select("doc_id", "class", "group"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")
    best = found.groupBy("group").agg(F.min(key).alias("best"), F.count("*").alias("n")).filter("n > 1").select(F.col("group").alias("_g"), "best")
    best = settle(best.select("_g", *[F.col(f"best.{c}").alias(f"_{c}") for c in ("none", "doc_id", "class")]))
    tagged, lost, of = fresh(docs, "_tag", "_lost", "_class")
    first = F.struct(F.col("_none").alias("none"), F.col("_doc_id").alias("doc_id"), F.col("_class").alias("class"))
    beside = found.join(sent_if_small(best), F.col("group") == F.col("_g")).filter(~key.eqNullSafe(first))
    beside = settle(beside.select(F.col("doc_id").alias(lost), F.col("class").alias(of)).distinct())
    at, names, schema = docs.columns.index(text_col), docs.columns, StructType([*docs.schema.fields]).add(tagged, "long")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(at))
            cls = [_class_of(s) if len(s) else None for i, j in slabs(offsets) for s in shingle_sets(data, offsets[i : j + 1], k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls, pa.int64())], names=[*names, tagged])

    rows = docs.mapInArrow(lean(tag), schema)
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(lost)) & (F.col(tagged) == F.col(of))
    rows = rows.join(sent_if_small(beside), same, "left_anti")
    if found.groupBy("doc_id", "class").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows.drop(tagged)
    worded = rows.filter(F.col(tagged).isNotNull()).dropDuplicates([id_col, tagged])  # repeated rows, where there are any
    return worded.union(rows.filter(F.col(tagged).isNull())).drop(tagged)
