"""The corpus pipeline on odd, empty and driver tables; each stage against a plain version on its own input."""

import hashlib
import math
import os
from collections import Counter

import pytest

import corpus_pipeline as cp
from tarnlink.llm import nbest, queries

from . import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["odd", pytest.param("small", marks=pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables"))])
def stages(request, spark, odd, tmp_path_factory):
    d = odd if request.param == "odd" else SMALL
    out, df = [spark.read.parquet(f"{d}/documents.parquet")], None
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, out[-1], d).write.parquet(path)
        out.append(spark.read.parquet(path))
    return d, out


def test_columns_stay(stages):
    _, out = stages
    assert all(df.columns == out[0].columns for df in out[:-1])


def test_toxicity(spark, stages):
    d, out = stages
    rejected = {r["doc_id"] for r in queries.QUERIES["op6_toxicity"](spark, d).filter("predicted = 1").collect()}
    assert Counter(r["doc_id"] for r in out[1].collect()) == Counter(r["doc_id"] for r in out[0].collect() if r["doc_id"] not in rejected)


def test_near_duplicates(stages):
    _, out = stages
    rows = out[1].collect()
    sets = [brute.shingles(r["text"], 5) for r in rows]
    root = brute.groups(sets, 80, 100)
    best = {}
    for r, s, g in zip(rows, sets, root, strict=True):
        if s:
            key = (r["doc_id"] is None, r["doc_id"] or 0)
            best[g] = min(best.get(g, key), key)
    want = Counter((None if k[0] else k[1]) for k in best.values()) + Counter(r["doc_id"] for r, s in zip(rows, sets, strict=True) if not s)
    assert Counter(r["doc_id"] for r in out[2].collect()) == want


def test_secrets(stages):
    _, out = stages
    assert Counter(r["doc_id"] for r in out[3].collect()) == Counter(r["doc_id"] for r in out[2].collect())
    assert not any(brute.base_secrets(r["text"]) for r in out[3].collect())
    before = {r["doc_id"]: r["text"] for r in out[2].collect()}
    assert all(r["text"] == before[r["doc_id"]] or "[SECRET]" in r["text"] for r in out[3].collect() if r["doc_id"] is not None)


def test_mixing(spark, stages):
    """Each source against plain targets and a plain draw: keys from ids, epochs, then rows up to the budget's edge."""
    d, out = stages
    good = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        if r["quality"] is not None:
            good[r["doc_id"]] = max(good.get(r["doc_id"], 0), r["quality"])
    rows = [(r["doc_id"], r["text"], r["source"], len(brute.WORD.findall((r["text"] or "").encode()))) for r in out[3].collect()]

    def key(i, text):
        name = hashlib.md5((text or "").encode()).hexdigest() if i is None else str(i)
        u = (int(hashlib.md5(f"{name}mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / (1.0 if good.get(i) is None else 2.0 if good[i] >= 1 else 0.5)

    size = Counter()
    for _, _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight, free, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, list(order), 1.5 * sum(size.values()), {}
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 2 * size[s]]
        for s in over or free:
            target[s] = 2 * size[s] if over else left * weight[s] / w
        if not over:
            break
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    want = Counter()
    for s in order:
        own = sorted(((key(i, t), i is None, i or 0, n, t) for i, t, x, n in rows if x == s), key=lambda r: r[:4])
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest = round(target[s] - epochs * size[s])
        for _, none, i, n, t in own:
            times = 1 if n == 0 else epochs + (rest > 0)
            rest -= n
            want[None if none else i, t] += times
    got = Counter((r["doc_id"], r["text"]) for r in out[4].collect())
    assert got == +want


def test_pieces(stages):
    """Ids of all ranks against an encoder on the driver; decoded, they give the text."""
    _, out = stages
    v = nbest.load(queries.PIECES)
    texts = {}
    for r in out[4].collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    last = out[5].collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in out[4].collect())
    for r in last:
        some = [t for t in texts[r["doc_id"]] if v.decode(r["ids"]) == t.replace(nbest.MARK, " ")]
        assert some and r["round_trip"] and r["n_pieces"] == len(r["ids"]) and len(r["scores"]) == 1 + len(r["other_ids"])
        assert any(math.isclose(r["scores"][0], sum(v.score[v.pieces[i]][0] if i not in v.byte else 0 for i in r["ids"]) + v.low * unknown(v, t), abs_tol=1e-6) for t in some)
        assert all(v.decode(ids) == v.decode(r["ids"]) for ids in r["other_ids"]) and r["scores"] == sorted(r["scores"], reverse=True)


def unknown(v, text):
    return sum(c not in v.score for c in text.replace(" ", nbest.MARK))


def test_empty(spark, void):
    assert cp.run(spark, void).count() == 0
