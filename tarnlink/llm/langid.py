"""Language identification by nearest centroid.

A text is a vector of hashed letter trigrams (lower case, runs of other characters count as one space), weighted
log(1 + count) * idf and normalised. Each language has several centroids, from spherical k-means over a sample of
its texts. The prediction is the language of the nearest centroid by cosine; a text further from it than nearly all
texts that the centroid was made of is marked as rejected.

idf counts all training rows. The centroids come from at most SAMPLE distinct texts a language, those with the
smallest hashes (a documented bound of the fit); everything else covers all rows.

Defined cases: null texts and texts without letters give `und`, score 0, rejected; equal texts give equal results;
repeated rows are rows of their own; ties go to the language that comes first; without training rows every text is `und`; an
empty table gives no rows; other columns do not take part, and a kept column of the name of a result leaves that result an
underscore before its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, results, settle, text_batches

#: Hashed trigrams (a power of two); distinct texts a language to cluster; centroids a language.
DIM, SAMPLE, CENTROIDS = 1 << 13, 400, 3
TEMPERATURE = 0.05
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point, whether it's a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def counts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first text, counts of its trigrams and those of the texts after it), some texts at a time."""
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and j - i < 64 and (j == i or chars < 1 << 19):
            chars += len(texts[j] or "")
            j += 1
        part = [f"\0{(t or '').lower()} " for t in texts[i:j]]
        c = np.frombuffer("".join(part).encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(t) for t in part])
        letter = letters()[c]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[np.cumsum(sizes) - sizes] = True
        doc = np.repeat(np.arange(j - i), sizes)[keep]
        c = np.where(letter, c, np.uint32(32))[keep]
        same = doc[2:] == doc[:-2]
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        g = (h >> np.uint32(32 - (DIM.bit_length() - 1)))[same].astype(np.int64)
        got = np.bincount(doc[:-2][same] * DIM + g, minlength=(j - i) * DIM).reshape(j - i, DIM)
        got[np.bincount(doc, weights=letter[keep], minlength=j - i) == 0] = 0
        yield i, got
        i = j


def weigh(got: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(got.astype(np.float32)) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray  #: DIM x (languages * centroids)
    of: np.ndarray  #: language of each centroid
    reach: np.ndarray  #: least cosine that is accepted, by language


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from a farthest-first start; deterministic."""
    mean = x.mean(0)
    at = [int(np.argmax(x @ mean))]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin((x @ x[at].T).max(1))))
    c = x[at]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, train: Column, *, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model from the rows of docs where train holds and lang isn't null."""
    text_batches(docs.sparkSession)
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for _, got in counts(batch.column(0).to_pylist()):
                df[:DIM] += (got > 0).sum(0)
                df[DIM] += len(got)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1), pa.int32()), pa.array(df)], names=["g", "n"])

    df = np.zeros(DIM + 1)
    for g, n in rows.select("text").mapInArrow(lean(frequencies), "g int, n long").groupBy("g").agg(F.sum("n")).collect():
        df[g] = n
    idf = (np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1).astype(np.float32)
    hashed = rows.select("lang", F.xxhash64("text").alias("h"), "text")
    distinct = settle(hashed.groupBy("lang", "h").agg(F.lit(1)).select("lang", "h"))
    cuts = {}
    for (lang,) in distinct.select("lang").distinct().collect():  # a row for each language
        cuts[lang] = distinct.filter(F.col("lang") == lang).select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if not cuts:
        return Model(idf, [], np.zeros((DIM, 0), np.float32), np.zeros(0, int), np.zeros(0))
    under = F.element_at(F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv]), F.col("lang"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, val = [], []
            for _, got in counts(batch.column(2).to_pylist()):
                for x in weigh(got, idf):
                    hit = np.flatnonzero(x)
                    at.append(hit.astype(np.uint16).tobytes())
                    val.append(x[hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(val, pa.binary())], names=["lang", "h", "at", "val"])

    picked: dict[str, dict[int, np.ndarray]] = {}
    for lang, h, at, val in hashed.filter(F.col("h") <= under).mapInArrow(lean(vectors), "lang string, h long, at binary, val binary").dropDuplicates(["lang", "h"]).collect():
        x = np.zeros(DIM, np.float32)
        x[np.frombuffer(at, np.uint16)] = np.frombuffer(val, np.float32)
        if len(at):
            picked.setdefault(lang, {})[h] = x
    langs, cs, of, reach = sorted(picked), [], [], []
    for i, lang in enumerate(langs):
        x = np.stack([picked[lang][h] for h in sorted(picked[lang])])
        c = kmeans(x, centroids)
        cs.append(c)
        of += [i] * len(c)
        reach.append(float(np.quantile((x @ c.T).max(1), 0.005)) * 0.8)
    return Model(idf, langs, np.concatenate(cs).T.astype(np.float32) if cs else np.zeros((DIM, 0), np.float32), np.array(of, int), np.array(reach))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, lang_pred, score (0 to 1: how much nearer the best language is than the others), similarity (cosine with the
    nearest centroid), rejected."""
    text_batches(docs.sparkSession)
    names = results(keep, "lang_pred", "score", "similarity", "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, cosine, far = [], [], [], []
            for _, got in counts(batch.column(len(keep)).to_pylist()):
                some = got.any(1)
                best = np.full((len(got), len(model.langs)), -1.0)
                sims = weigh(got, model.idf) @ model.centroids
                for i in range(len(model.langs)):
                    best[:, i] = sims[:, model.of == i].max(1)
                for ok, b in zip(some.tolist(), best, strict=True):
                    if not ok or not len(b):
                        row = ("und", 0.0, 0.0, True)
                    else:
                        i = int(b.argmax())
                        row = (model.langs[i], float(1 / np.exp((b - b[i]) / TEMPERATURE).sum()), float(b[i]), bool(b[i] < model.reach[i]))
                    for c, v in zip((lang, score, cosine, far), row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64()), pa.array(far, pa.bool_())], names=[*keep, *names])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text")).mapInArrow(lean(run), schema + ", ".join(f"`{n}` {k}" for n, k in zip(names, ("string", "double", "double", "boolean"), strict=True)))
