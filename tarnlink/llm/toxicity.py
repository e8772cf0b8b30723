"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of letters, A-Z in lower case) and the first 4, 5 and 6 bytes of longer ones. The vocabulary is
the terms whose presence tells most about the label among all labelled rows (likelihood ratio above what the best of
so many terms would reach by chance); idf counts all
documents. The index holds examples' vectors in blocks of similar ones, with the largest weight of each
term in each block. A query bounds every block by those maxima and reads blocks in order of their bounds until none
left can hold a nearer example, so its neighbours are exact. Every labelled row stands with the example nearest to it (an
example with itself), and examples vote with the share of toxic rows among those that stand with them, their similarities as
weights; a logistic curve fitted to the votes on all labelled rows, each left out of its own, makes the vote a probability.

What is bounded is the model's size, not what it learns from (documented parameters): at most VOCABULARY terms; as examples
POSITIVE toxic and NEGATIVE other labelled rows, those with the smallest hashes of their ids, and one row for each term, so that
no row that has terms is without an example. Up to so many labelled rows each is an example of its own. Where there are more, terms
are ranked by their shares of toxic and other rows as so many rows would show them, and rare terms count that toxic rows have
TIMES as often as others. Texts stay on the executors; the driver gets the examples' weights and counts.

Defined cases: null, empty and termless texts are scored like texts that match no example (the share of toxic ones among
such examples); equal texts and repeated rows give equal scores; without labelled rows of both kinds every score is 0;
repeated labels count once (toxic if any says so), labels without a value or an id do not; of several texts under one
labelled id the one with the smallest hash counts; ids may be of any type and are shown as text; an empty table gives no rows;
other columns do not take part, and a kept column of the name of a result leaves that result an underscore before its name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, results, sent_if_small, settle, text_batches
from .wordhash import U, mix, powers, raw, slabs, words

POSITIVE, NEGATIVE, VOCABULARY, BLOCK, NEIGHBOURS = 1500, 2500, 4096, 64, 15
#: Similarity that the examples without any match hold in a vote.
PRIOR = 0.1
#: How much more often toxic rows have a term that is too rare for a high rank; steps to which votes are counted for the curve.
TIMES, STEPS = 4, 4096
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all texts, with repeats: text numbers ascending within each kind of term."""
    w = words(data, offsets, LETTER)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    docs, out = [doc], [w.hashes]
    p = powers(8)
    h, done = np.zeros(len(w.starts), dtype=U), 0
    for k in (4, 5, 6):
        long = w.lengths > k
        while done < k:
            at = np.minimum(w.starts + done, max(0, len(w.data) - 1))
            h = h + (w.data[at].astype(U) + U(1)) * p[done] if len(w.data) else h
            done += 1
        docs.append(doc[long])
        out.append(mix(h[long] + U(k << 20)))
    return np.concatenate(docs), np.concatenate(out)


@dataclass
class Index:
    vocabulary: np.ndarray  #: sorted term hashes
    idf: np.ndarray
    starts: np.ndarray  #: term x block: where its postings in that block begin
    most: np.ndarray  #: term x block: largest weight
    example: np.ndarray  #: postings
    weight: np.ndarray
    ids: list[str]
    label: np.ndarray  #: of the examples themselves
    toxic: np.ndarray  #: share of toxic rows among those that stand with an example
    prior: float
    slope: float
    shift: float

    def __post_init__(self) -> None:
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.vocabulary & U(0xFFFF)).astype(np.int64)] = True

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms (numbers in the vocabulary) and normalised weights of each text."""
        return [(at, self.weigh(at, tf)) for at, tf in self.counts(data, offsets)]

    def weigh(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = (1 + np.log(tf)) * self.idf[at]
        return x / np.sqrt(x @ x) if len(x) else x

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms (numbers in the vocabulary) of each text and how often they stand in it."""
        n, v = len(offsets) - 1, len(self.vocabulary)
        doc, term = terms(data, offsets)
        maybe = self.bits[(term & U(0xFFFF)).astype(np.int64)]
        doc, term = doc[maybe], term[maybe]
        at = np.searchsorted(self.vocabulary, term)
        hit = self.vocabulary[np.minimum(at, max(0, v - 1))] == term if v else np.zeros(0, bool)
        key, tf = np.unique(doc[hit] * max(1, v) + at[hit], return_counts=True)
        doc, at = key // max(1, v), key % max(1, v)
        ends = np.searchsorted(doc, np.arange(n + 1))
        return [(at[a:b], tf[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0 (ties: the earlier in the index) and those cosines, exactly."""
        bound = x @ self.most[at] if len(at) else np.zeros(0)
        best, sims = np.zeros(0, np.int64), np.zeros(0)
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[: np.count_nonzero(bound > 0)]
        step = 4
        while len(blocks):
            cells = np.ix_(at, blocks[:step])
            begins = self.starts[cells]
            lengths = self.starts[cells[0], cells[1] + 1] - begins
            sizes = lengths.ravel()
            ends = np.cumsum(sizes)
            items = np.repeat(begins.ravel() - ends + sizes, sizes) + np.arange(ends[-1])
            score = np.bincount(self.example[items], np.repeat(x, lengths.sum(1)) * self.weight[items])
            got = np.flatnonzero(score > 0)
            got = got[got != without]
            best, sims = np.concatenate((best, got)), np.concatenate((sims, score[got]))
            order = np.lexsort((best, -sims))[:k]
            best, sims = best[order], sims[order]
            blocks, step = blocks[step:], 4 * step
            if len(sims) == k:
                blocks = blocks[: np.count_nonzero(bound[blocks] >= sims[-1])]
        return best, sims

    def vote(self, at: np.ndarray, x: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        best, sims = self.nearest(at, x, without=without)
        return float((sims @ self.toxic[best] + PRIOR * self.prior) / (sims.sum() + PRIOR)), best, sims

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-4), 1 - 1e-4)
        return float(1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift))))


def logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.1) and shift of a weighted one-variable logistic fit, by damped Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (p - y) * z).sum() + 0.1 * (a - 1), (w * (p - y)).sum() + 0.1 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.1, float(a)), float(b)


def empty_index(vocabulary: np.ndarray, idf: np.ndarray) -> Index:
    return Index(vocabulary, idf, np.zeros((len(vocabulary), 1), np.int64), np.zeros((len(vocabulary), 0)), np.zeros(0, np.int64), np.zeros(0), [], np.zeros(0), np.zeros(0), 0.0, 1.0, 0.0)


def arrange(vocabulary: np.ndarray, df: np.ndarray, n: int, examples: list[tuple[str, int, np.ndarray, np.ndarray]]) -> Index:
    """An index of the examples (id, toxic, terms, counts) that have terms, each the only row that stands with it."""
    index = empty_index(vocabulary, np.log((1 + n) / (1 + df)) + 1)
    live = [(e, (e[2], index.weigh(e[2], e[3]))) for e in examples if len(e[2])]
    live.sort(key=lambda ev: (int(ev[1][0][ev[1][1].argmax()]), ev[0][0]))  # by heaviest term: similar ones together
    blocks = -(-len(live) // BLOCK)
    t = np.concatenate([v[0] for _, v in live]) if live else np.zeros(0, np.int64)
    w = np.concatenate([v[1] for _, v in live]) if live else np.zeros(0)
    e = np.repeat(np.arange(len(live)), [len(v[0]) for _, v in live])
    order = np.lexsort((e, t))
    t, w, e = t[order], w[order], e[order]
    cells = np.searchsorted(t * (blocks + 1) + e // BLOCK, (np.arange(len(vocabulary))[:, None] * (blocks + 1) + np.arange(blocks + 1)[None, :]).ravel())
    most = np.zeros((len(vocabulary), blocks))
    np.maximum.at(most, (t, e // BLOCK), w)
    ids, y = [x[0][0] for x in live], np.array([x[0][1] for x in live], float)
    return Index(vocabulary, index.idf, cells.reshape(len(vocabulary), blocks + 1), most, e, w, ids, y, y.copy(), 0.0, 1.0, 0.0)


def without_match(clean: float, toxic: float, weight: float = 1.0) -> float:
    """The share of toxic rows among those without terms; weight: rows that a toxic one stands for."""
    return float((toxic + 0.5 * weight * bool(not toxic)) / max(1.0, clean + toxic + 1))


def build(vocabulary: np.ndarray, df: np.ndarray, n: int, examples: list[tuple[str, int, np.ndarray, np.ndarray]], share: tuple[float, float]) -> Index:
    """An index of examples (id, toxic, terms, counts) at hand, and its curve; share: rows that each clean and toxic example stands
    for. fit does the same over tables."""
    index = arrange(vocabulary, df, n, examples)
    blank = np.array([e[1] for e in examples if not len(e[2])], float)
    index.prior = without_match((1 - blank).sum() * share[0], blank.sum() * share[1], share[1])
    own = {e[0]: e for e in examples}
    votes = [index.vote(own[x][2], index.weigh(own[x][2], own[x][3]), without=i)[0] for i, x in enumerate(index.ids)] + [index.prior] * len(blank)
    z = np.clip(np.array(votes), 1e-4, 1 - 1e-4)
    y = np.concatenate((index.label, blank))
    index.slope, index.shift = logistic(np.log(z / (1 - z)), y, np.where(y > 0, share[1], share[0]) / max(share))
    return index


def labelled(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """id, t, y, h of each labelled row (docs: id, t; marked: id, y, h), settled: of several texts the one with the smallest hash."""
    rows = settle(docs.join(sent_if_small(marked), "id").select("id", "t", "y", "h"))
    many = settle(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    if many.isEmpty():
        return rows
    many = sent_if_small(many)
    one = rows.join(many, "id", "left_semi").groupBy("id", "y", "h").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.length("t"))).alias("t"))
    return settle(rows.join(many, "id", "left_anti").unionByName(one))


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index | None:
    """An index learnt from all labelled rows where train (of the id) holds."""
    text_batches(docs.sparkSession)
    valid = labels.filter(train & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    marked = settle(valid.groupBy(F.col(f"`{id_col}`").alias("id")).agg((F.max(f"`{label_col}`") > 0).cast("int").alias("y")).withColumn("h", F.xxhash64("id")))
    chosen = labelled(docs.filter(train).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")), marked)
    totals = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    a, b = totals.get(1, 0), totals.get(0, 0)
    if not a or not b:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = raw(batch.column(0))
            for i, j in slabs(offsets):
                doc, term = terms(data, offsets[i : j + 1])
                order = np.lexsort((doc, term))
                doc, term = doc[order], term[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
                doc, term = doc[new], term[new]
                edge = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, int)
                if len(edge):
                    pos = np.add.reduceat(y[i:j][doc], edge)
                    n = np.diff(np.concatenate((edge, [len(term)])))
                    yield pa.RecordBatch.from_arrays([pa.array(term[edge].view(np.int64)), pa.array(pos), pa.array(n - pos)], names=["term", "pos", "neg"])

    per = chosen.select("t", "y").mapInArrow(lean(count), "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"))
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)

    def tells(p: Column, q: Column, a: float, b: float) -> Column:
        rate = (p + q) / (a + b)
        return 2 * (part(p, rate * a) + part(q, rate * b) + part(a - p, (1 - rate) * a) + part(b - q, (1 - rate) * b))

    p, q = F.col("p"), F.col("q")
    able = settle(per.filter((p + q >= 4) & (p + q < a + b)))
    telling = max(12.0, 2 * float(np.log(max(1, able.count()))))  # fewer than about one term reaches this by chance
    c, d = min(1.0, POSITIVE / a), min(1.0, NEGATIVE / b)
    found = able.withColumn("g", tells(p * c, q * d, a * c, b * d)).filter((tells(p, q, a, b) >= telling) & ((F.col("g") >= telling) | ((p + 0.5) / (a + 1) >= TIMES * (q + 0.5) / (b + 1))))
    vocabulary = np.sort(np.array([r["term"] for r in found.orderBy(F.desc("g"), "term").limit(VOCABULARY).select("term").collect()], np.int64).view(U))
    seen = empty_index(vocabulary, np.ones(len(vocabulary)))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            found = [v for i, j in slabs(offsets) for v in seen.counts(data, offsets[i : j + 1])]
            at, tf = (pa.array([v[k].astype(np.int32).tobytes() for v in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), at, tf], names=["id", "y", "h", "at", "tf"])

    told = settle(chosen.select(F.col("id").cast("string").alias("id"), "t", "y", "h").mapInArrow(lean(tell), "id string, y int, h long, at binary, tf binary"))
    live = told.filter("length(at) > 0")

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[int, str]] = {}
        for batch in batches:
            for i, h, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for t in np.frombuffer(at, np.int32).tolist():
                    if t not in first or (h, i) < first[t]:
                        first[t] = (h, i)
        yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int32()), pa.array([x[0] for x in first.values()], pa.int64()), pa.array([x[1] for x in first.values()], pa.string())], names=["t", "h", "id"])

    picked = [live.filter(F.col("y") == y).orderBy("h", "id").limit(most).select("id") for y, most in ((1, POSITIVE), (0, NEGATIVE))]
    if a > POSITIVE or b > NEGATIVE:
        picked.append(live.select("id", "h", "at").mapInArrow(lean(holders), "t int, h long, id string").groupBy("t").agg(F.min_by("id", F.struct("h", "id")).alias("id")).select("id"))
    ids = settle(functools.reduce(DataFrame.union, picked).distinct())  # no more than POSITIVE + NEGATIVE + VOCABULARY rows
    examples = live.join(F.broadcast(ids), "id").select("id", "y", "at", "tf").collect()
    examples = [(r["id"], r["y"], np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["tf"], np.int32)) for r in sorted(examples, key=lambda r: r["id"])]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            data, offsets = raw(batch.column(0))
            df[-1] += len(batch)
            for i, j in slabs(offsets):
                for at, _ in seen.counts(data, offsets[i : j + 1]):
                    df[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df)), pa.int32()), pa.array(df)], names=["t", "n"])

    df = np.zeros(len(vocabulary) + 1)
    for t, n in docs.select(F.col(f"`{text_col}`")).mapInArrow(lean(spread), "t int, n long").groupBy("t").agg(F.sum("n")).collect():
        df[t] = n
    index = arrange(vocabulary, df[:-1], int(df[-1]), examples)
    learn(index, told)
    return index


def learn(index: Index, told: DataFrame) -> None:
    """Gives index what all labelled rows (id, y, at, tf) say: the shares of its examples, the prior and the curve."""
    place = {x: i for i, x in enumerate(index.ids)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, near, sims = [], [], []
            for i, at, tf in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                at = np.frombuffer(at, np.int32).astype(np.int64)
                best, s = index.nearest(at, index.weigh(at, np.frombuffer(tf, np.int32)), NEIGHBOURS + 1)
                own.append(place.get(i, int(best[0]) if len(best) else -1))
                near.append(best.astype(np.int32).tobytes())
                sims.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.int32()), pa.array(near, pa.binary()), pa.array(sims, pa.binary())], names=["y", "own", "near", "sims"])

    met = settle(told.select("id", "y", "at", "tf").mapInArrow(lean(meet), "y int, own int, near binary, sims binary"))
    rows = np.zeros((len(index.ids) + 1, 2))  # the last: rows without terms
    for own, y, n in met.groupBy("own", "y").count().collect():
        rows[own, y] = n
    index.prior = prior = without_match(*rows[-1])
    total, toxic = rows[:-1].sum(1), rows[:-1, 1]
    index.toxic = toxic / np.maximum(total, 1)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, STEPS, 2))
        for batch in batches:
            for y, own, near, sims in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                near, sims = np.frombuffer(near, np.int32), np.frombuffer(sims)
                share = index.toxic[near]
                if own >= 0 and total[own] > 1:
                    share[near == own] = (toxic[own] - y) / (total[own] - 1)
                elif own >= 0:
                    near, sims, share = (v[near != own] for v in (near, sims, share))
                sims, share = sims[:NEIGHBOURS], share[:NEIGHBOURS]
                vote = min(max(float((sims @ share + PRIOR * prior) / (sims.sum() + PRIOR)), 1e-4), 1 - 1e-4)
                sums[y, int(vote * STEPS)] += np.log(vote / (1 - vote)), 1
        y, k = np.nonzero(sums[:, :, 1])
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(k, pa.int32()), *(pa.array(sums[y, k, i]) for i in (0, 1))], names=["y", "k", "z", "n"])

    cells = met.mapInArrow(lean(votes), "y int, k int, z double, n double").groupBy("y", "k").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).collect()
    y, z, n = (np.array([float(r[c]) for r in cells]) for c in ("y", "z", "n"))
    index.slope, index.shift = logistic(z / n, y, n)


def score(docs: DataFrame, index: Index | None, keep: list[str], text_col: str = "text", evidence: int = 3) -> DataFrame:
    """keep, score (0 to 1) and evidence: the nearest examples' ids, labels and similarities."""
    text_batches(docs.sparkSession)
    names = results(keep, "score", "evidence")
    kind = pa.list_(pa.struct([("example", pa.string()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(len(keep)))
            scores, shown = [], []
            if index is None:
                scores, shown = [0.0] * len(batch), [[] for _ in range(len(batch))]
            else:
                blank = index.calibrated(index.prior)
                for i, j in slabs(offsets):
                    for at, x in index.vectors(data, offsets[i : j + 1]):
                        if not len(at):
                            scores.append(blank)
                            shown.append([])
                            continue
                        vote, best, sims = index.vote(at, x)
                        scores.append(index.calibrated(vote))
                        shown.append([{"example": index.ids[b], "toxic": int(index.label[b]), "similarity": float(s)} for b, s in zip(best[:evidence], sims, strict=False)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array(shown, kind)], names=[*keep, *names])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text")).mapInArrow(lean(run), f"{schema}`{names[0]}` double, `{names[1]}` array<struct<example: string, toxic: int, similarity: double>>")


def without_toxic(docs: DataFrame, index: Index | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    text_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(at))
            keep = []
            for i, j in slabs(offsets):
                for terms_of, x in index.vectors(data, offsets[i : j + 1]):
                    keep.append(index.calibrated(index.vote(terms_of, x)[0] if len(terms_of) else index.prior) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs if index is None else docs.mapInArrow(lean(run), docs.schema)
