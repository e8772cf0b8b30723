"""Linkage by slabs: the same results however blocks are dealt out, and exchanges that grow with the rows, not with the pairs."""

import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlink.functions.similarity import lcs_length, term_counts
from tarnlink.operators import linkage, products

from .test_operators import made_names, plain_best


def written(spark, run):
    """Records that run() writes to exchanges."""
    sc = spark.sparkContext

    def ids():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = ids()
    run()
    return sum(n for i, n in ids().items() if i not in before)


def sentences(count, words, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randrange(2, 9))) for _ in range(words)]
    return [f"th {' '.join(rng.choices(vocabulary, k=8))}" for _ in range(count)]


@pytest.mark.parametrize("match", ["ratio", "cosine", "low"])
def test_exchanges_grow_with_rows(spark, match):
    """Names of one block, of frequent letters and words: nearly every two share some."""
    run = {"ratio": lambda a, b: linkage.blocked(a, b, apart=True), "cosine": lambda a, b: linkage.cosine(a, b, apart=True), "low": lambda a, b: linkage.cosine(a, b, threshold=0.2, n=3, apart=True)}[match]
    df = spark.createDataFrame(list(enumerate(sentences(600, 60, 5))), "id long, name string")
    assert written(spark, lambda: run(df, df).collect()) < 200 * 600


def test_copies_do_not_grow(spark):
    """Vectors go out in as many copies whatever their number."""
    names = sentences(3000, 900, 8)
    few, many = (spark.createDataFrame(list(enumerate(names[:n])), "id long, name string") for n in (800, 3000))
    each = [written(spark, lambda df=df: linkage.cosine(df, df, apart=True).collect()) / n for df, n in ((few, 800), (many, 3000))]
    assert each[1] < 1.2 * each[0]


def test_terms_are_counted_in_place(spark):
    """No exchange counts the terms of a name: what is left counts them over all names, numbers them and gathers vectors."""
    names = sentences(1500, 40_000, 11)
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    terms = sum(len(set(w) | set(zip(w, w[1:], strict=False))) for w in (re.findall(r"\w{2,}", t) for t in names))
    assert written(spark, lambda: linkage.cosine(df, df, grams=2, apart=True).collect()) < 7 * terms


def test_term_counts(spark):
    names = ["a bb", "bb BB bb cc bb cc", "", " ", None, "é x_ é1 é1", "bb " * 3000 + "aa"]
    df = spark.createDataFrame([(i, 2, t) for i, t in enumerate(names)], "name long, times long, t string")
    for n in (1, 2):
        want = []
        for i, t in enumerate(names):
            words = re.findall(r"\w{2,}", (t or "").lower())
            want += [(i, 2, x, c) for x, c in Counter(words + [" ".join(p) for p in zip(words, words[1:], strict=False)] * (n - 1)).items()]
        assert sorted(map(tuple, term_counts(df, F.col("t"), n).collect())) == sorted(want)


def vectors(names, known):
    """Terms by rising frequency and weights, as linkage.cosine makes them."""
    words = [re.findall(r"\w{2,}", t) for t in known]
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    number = {t: i for i, t in enumerate(df)}
    terms, weights = [], []
    for t in names:
        items = sorted((df[x], number[x], w.count(x) * (np.log((1 + len(known)) / (1 + df[x])) + 1)) for w in [re.findall(r"\w{2,}", t)] for x in set(w))
        terms.append([x for _, x, _ in items])
        weights.append((lambda v: (v / np.sqrt((v * v).sum())).tolist())(np.array([x for _, _, x in items])))
    return pa.table({"terms": pa.array(terms, pa.list_(pa.int64())), "weights": pa.array(weights, pa.list_(pa.float64()))})


def test_cosines_work_by_batches(monkeypatch):
    """Many left vectors are looked up by one call; bounds, batches and steps leave the results alone."""
    names = sentences(700, 300, 9)
    left, right = vectors(names[:500], names), vectors(names[200:], names)
    calls = [0]
    sys.setprofile(lambda _, event, __: calls.__setitem__(0, calls[0] + (event in ("call", "c_call"))))
    try:
        want = [products.best_cosines(left, right, threshold, n) for threshold, n in ((0.7, 2), (0.2, 4))]
    finally:
        sys.setprofile(None)
    assert calls[0] < 10 * 500 and all(len(x[0]) >= 300 for x in want)
    for name, value in (("QUERIES", 7), ("ITEMS", 30), ("PAIRS", 50), ("ADDED", 9)):
        monkeypatch.setattr(products, name, value)
    for (threshold, n), x in zip(((0.7, 2), (0.2, 4)), want, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(products.best_cosines(left, right, threshold, n), x, strict=True))


def test_vectors_without_shared_terms():
    """Nothing in common, no items at all, one side empty."""
    table = lambda terms: pa.table({"terms": pa.array(terms, pa.list_(pa.int64())), "weights": pa.array([[1.0] * len(t) for t in terms], pa.list_(pa.float64()))})
    for left, right, want in (([[1], [], [7]], [[2], [7]], [(2, 1)]), ([[1]], [[2]], []), ([[1]], [], []), ([], [[1]], []), ([[], [3]], [[]], [])):
        i, j, _ = products.best_cosines(table(left), table(right), 0.5, 2)
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("threshold, n, block", [(60, 2, 0), (85, 1, 2)])
def test_slabs_do_not_matter(spark, monkeypatch, threshold, n, block):
    left, right = list(enumerate(made_names(80, 7))), list(enumerate(made_names(80, 8)))
    a, b = (spark.createDataFrame(x, "id long, name string") for x in (left, right))
    for name, value in (("SLAB", 3), ("SLABS", 4), ("WIDE", 5), ("VECTORS", 3), ("VECTOR_SLABS", 4), ("VECTORS_WIDE", 5)):
        monkeypatch.setattr(linkage, name, value)
    got = linkage.blocked(a, b, threshold=threshold, n=n, block=block) if block else linkage.nested_loop(a, b, threshold=threshold, n=n)
    assert sorted((r["left_id"], r["right_id"], round(r["score"], 6), r["rank"]) for r in got.collect()) == plain_best(left, right, threshold, n, block)
    dealt = sorted(map(tuple, linkage.cosine(a, b, threshold=0.2, n=n).collect()))
    monkeypatch.undo()
    assert dealt == sorted(map(tuple, linkage.cosine(a, b, threshold=0.2, n=n).collect())) and dealt


def test_ids_of_any_type(spark):
    """Ties go to the smaller id: texts by their bytes, structs by their fields, nulls first."""
    left = spark.createDataFrame([(1, "acme pty ltd")], "id long, name string")
    right = spark.createDataFrame([("b", "x", "acme pty ltds"), ("b", None, "acme pty ltdt"), ("a", "y", "acme pty ltdu"), ("Z", "z", "acme pty ltd inc")], "p string, q string, name string")
    got = linkage.blocked(left, right.select(F.struct("p", "q").alias("id"), "name"), n=3).collect()
    assert [tuple(r["right_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [("a", "y"), ("b", None), ("b", "x")]
    assert [r["right_id"] for r in linkage.blocked(left, right.select(F.col("q").alias("id"), "name")).collect()] == [None]


def test_ratios_of_all_lengths(monkeypatch):
    rng = random.Random(3)
    for words in (1, 16):
        monkeypatch.setattr(products, "WORDS", words)
        for letters in ("ab", "abcdefghij kléü", "".join(map(chr, range(0x4E00, 0x4F00)))):
            left = list({"".join(rng.choices(letters, k=rng.choice([1, 5, 63, 64, 65, 129, 300]))) for _ in range(30)})
            right = [*left[:9], *("".join(c for c in t if rng.random() > 0.1) + "q" for t in left)]
            for threshold, n in ((50, 2), (85, 99)):
                want = []
                for i, x in enumerate(left):
                    found = sorted((-200.0 * lcs_length(x, y) / (len(x) + len(y)), j) for j, y in enumerate(right))
                    want += [(i, j, -s) for s, j in found if -s >= threshold][:n]
                i, j, score = products.best_ratios(left, right, threshold, n)
                assert sorted(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == sorted(want) and want


def test_cosines_of_vectors():
    rng = np.random.default_rng(4)

    def table(count, most):
        rows = [np.unique(rng.integers(0, 12 if i % 3 else 400, rng.integers(1, most))) for i in range(count)]
        weights = [(lambda w: w / np.sqrt((w * w).sum()))(rng.integers(1, 4, len(r)).astype(float)) for r in rows]
        return pa.table({"terms": pa.array([r.tolist() for r in rows], pa.list_(pa.int64())), "weights": pa.array([w.tolist() for w in weights], pa.list_(pa.float64()))}), [dict(zip(r.tolist(), w.tolist(), strict=True)) for r, w in zip(rows, weights, strict=True)]

    (left, x), (right, y) = table(60, 9), table(90, 6)
    for threshold, n in ((0.2, 3), (0.7, 1), (0.5, 200)):
        want = []
        for i, u in enumerate(x):
            found = sorted((-round(sum(w * v.get(t, 0) for t, w in u.items()), 6), j) for j, v in enumerate(y))
            want += [(i, j, -s) for s, j in found if -s >= threshold][:n]
        i, j, score = products.best_cosines(left, right, threshold, n)
        assert sorted((a, b, round(s, 6)) for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == sorted(want) and want


@pytest.mark.parametrize("repeated", [False, True])
def test_exact_pairs_are_not_gathered(spark, monkeypatch, repeated):
    """Frequent values are met part by part; where ids are unique no step holds pairs."""
    monkeypatch.setattr(linkage, "HOT", 4)
    rng = random.Random(6)
    make = lambda: [(i // (1 + repeated), rng.choice(["a", "a", "a", "b", "", None]), rng.choice(["p", "q", None, str(i)])) for i in range(40)]
    left, right = make(), make()
    a, b = (spark.createDataFrame(x, "id long, name string, code string") for x in (left, right))
    out = linkage.exact(a, b, keys=[("name", "name"), ("id", "id"), ("code", "code")])
    want = {(x[0], y[0]) for x in left for y in right if any(p is not None and p == q for p, q in ((x[1], y[1]), (x[0], y[0]), (x[2], y[2])))}
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert repeated or "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
