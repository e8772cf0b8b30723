"""The operators' own interfaces: paths that small tables don't reach."""

import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlink.llm import components, flac, langid, mixing, nbest, ngram_join, pivots, queries, secrets, sharding, token_rollup, toxicity, wordhash

from . import brute


def test_flac_shapes():
    rng = random.Random(1)
    waves = [bytes(rng.randrange(256) for _ in range(960)), b"a" * 384, bytes(int(127 + 100 * np.sin(i / 20)) for i in range(1920)), flac.payload(b"")]
    for lpc in (0, 2, 4):
        media = flac.encode(waves, lpc)
        assert [x.tobytes() for x in flac.decode(media)] == waves
        for m, w in zip(media, waves, strict=True):
            assert all(flac.seek(m, at, 7) == w[at : at + 7] for at in (0, 100, len(w) - 7))
    assert len(flac.encode([waves[2]], 4)[0]) < 0.6 * len(waves[2])  # predictors pay on a wave


def test_flac_blocks(spark):
    text = "some words " * 900
    df = flac.add_media(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "text")
    rows = sorted((r["id"], r["sample_offset"], bytes(r["pcm"])) for r in flac.pcm_blocks(df, "id").collect())
    assert b"".join(p for i, _, p in rows if i == 1) == flac.payload(text.encode())
    at = 0
    for i, offset, p in rows:
        if i == 1:
            assert offset == at
            at += len(p)


def test_word_hashes_cross_no_text():
    import pyarrow as pa

    texts = ["ab", "c d", None, " x", ""]
    data, offsets = wordhash.raw(pa.array(texts, pa.string()))
    w = wordhash.words(data, offsets)
    assert np.diff(w.first).tolist() == [1, 2, 0, 1, 0]
    assert len(set(w.hashes.tolist())) == 4


def near(spark, texts, monkeypatch, few, block, small=1 << 19):
    monkeypatch.setattr(components, "SMALL", small)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    df = df.checkpoint()
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(df, k=3, num=60, den=100).collect()}
    assert [got[i] for i in range(len(texts))] == brute.groups([brute.shingles(t, 3) for t in texts], 60, 100)


def mutants(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(30)}"
        out.append(" ".join(w[: rng.randrange(25, 41)]))
    return out


def test_join_by_pairs(spark, monkeypatch):
    near(spark, mutants(60), monkeypatch, 1000, 256)


def test_join_by_blocks(spark, monkeypatch):
    near(spark, mutants(60), monkeypatch, 2, 7)


def test_join_with_distributed_components(spark, monkeypatch):
    near(spark, mutants(60, 7), monkeypatch, 2, 7, 0)


def test_suffix_bound_is_a_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(2))
        assert ngram_join.suffix_bound(x, y) <= len(np.setxor1d(x, y))


def test_one_of_each_group(spark):
    t = "a b c d e f g h i j k l m n o p"
    rows = [(5, t), (3, t), (3, t), (None, t), (None, "alone in the world with nobody near"), (7, ""), (8, None), (9, t + " q")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").checkpoint())
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[1], *rows[4:7]], "doc_id long, text string").collect()))


@pytest.mark.parametrize("small", [0, 100])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 4), (20, 21), (None, 1)]
    got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), *((i, 4) for i in range(4, 10)), (20, 20), (21, 20)}


def test_pivot_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 8)
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.04 * rng.normal(size=(40, 16)) for c in rng.normal(size=(3, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(df, pivots=12).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.95 * want.sum() > 0


def test_mix_in_effect(spark):
    rows = [(i, "w " * (i % 7), "s" + str(i % 3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    mixed = mixing.mix(df)
    out = mixing.apply_mix(df, mixed)
    assert out.columns == df.columns
    want = {r["doc_id"]: -(-r["taken"] // r["size"]) if r["size"] else 1 for r in mixed.collect()}
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert {i: n for i, n in want.items() if n} == got


def test_heavier_rows_come_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    weights = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 8.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(df, quality=weights, weights=(1, 1), share=0.2).filter("taken > 0").groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    n = {r["odd"]: r["count"] for r in got}
    assert n[0] > 4 * n[1] > 0


def test_shard_splits_a_group_of_copies(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1200, "same text").otherwise(F.concat(F.lit("text number "), "id")).alias("text"))
    got = [r["size"] for r in sharding.shard(df, 10).groupBy("shard").agg(F.sum("size").alias("size")).collect()]
    assert len(got) == 10 and max(got) - min(got) <= 0.03 * sum(got)


def test_nearest_is_exact(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i:03d}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(400)]
    import pyarrow as pa

    data, offsets = wordhash.raw(pa.array(texts, pa.string()))
    terms = np.unique(toxicity.terms(data, offsets)[1])
    told = toxicity.empty_index(terms, np.ones(len(terms))).counts(data, offsets)
    index = toxicity.build(terms, np.full(len(terms), 10.0), 400, [(str(i), i % 2, *v) for i, v in enumerate(told)], (1.0, 1.0))
    dense = np.zeros((400, len(terms)))
    dense[index.example, np.repeat(np.arange(len(terms)), index.starts[:, -1] - index.starts[:, 0])] = index.weight
    for at, x in index.vectors(data, offsets)[:40]:
        q = np.zeros(len(terms))
        q[at] = x
        want = np.sort(dense @ q)[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(index.nearest(at, x)[1], want)


def test_rejection(spark):
    rows = [(i, "the house of the man is on the hill and it was good " * 3, "en") for i in range(30)] + [(i + 50, "das haus des mannes steht auf dem berg und es war gut " * 3, "de") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    got = langid.predict(spark.createDataFrame([(1, "das haus des mannes steht auf dem berg und es war gut"), (2, "ξενοδοχειο θαλασσα"), (3, "42 !")], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert got[0]["lang_pred"] == "de" and not got[0]["rejected"] and got[1]["rejected"] and got[2]["lang_pred"] == "und"


@pytest.fixture(scope="module")
def scanner():
    return secrets.learnt(())


def found_in(text, scanner):
    return [text[f["start"] : f["end"]] for f in secrets.findings(text, secrets.Novelty(scanner.dictionary), scanner.threshold) if f["kind"] == "novel"]


def test_novelty(scanner):
    random_key = "xK9mQ2vL8pRt5WzJ3nBc7YdF"
    assert found_in(f"the bearer {random_key} and the private configuration_certificate_environment of it", scanner) == [random_key]
    assert found_in(f"a word {random_key} here", scanner) == []  # not in a sensitive context


@pytest.mark.parametrize("text", [
    "the key Donaudampfschifffahrtsgesellschaftskapitaen of the private ship", "a token pseudohypoparathyroidism-related-disorders here", "private getUserProfileInformationFromDatabase key",
    "key in /home/users/projects/data-science/notebooks it is", "the author https://www.example.org/aB3dE6gH9jK2mN5pQ8sT1vW4/index", "the key https://www.example.org/blog/2021/09/how-to-write-clean-code",
    "key date 2024-01-15T10:30:00Z and token 0049-171-1234567-89", "the monkey xK9mQ2vL8pRt5WzJ3nBc7YdF on the keyboard", "", "key",
])
def test_no_false_alarm(text, scanner):
    assert found_in(text, scanner) == []


def test_planted_secrets(scanner):
    """Random strings that no base pattern matches and names, paths and long words, each in a sensitive context."""
    rng = random.Random(11)
    words = sorted({w for x in (inspect, random, np) for w in dir(x) if w.isalpha() and len(w) > 3})
    names, keys = secrets.names_and_strings(words, 400, 12)
    forms = ["the bearer {} was", "private key: {}", "auth={}", "MY_SIGNING_KEY={} x", "credential '{}'", "{} is the passphrase", "accessKey {}"]
    around = ["Thorti ensttion of eahe onnthaly and. ", "Als der Mann zum Haus kam, war es schon dunkel. ", "for i in range(10): print(i) "]
    hits = {0: 0, 1: 0}
    for secret, tokens in ((0, names), (1, keys)):
        for t in tokens:
            text = rng.choice(around) + rng.choice(forms).format(t) + " " + rng.choice(around)
            assert not brute.base_secrets(text)
            hits[secret] += bool(found_in(text, scanner))
    assert hits[1] >= 0.9 * len(keys) and hits[1] >= 0.9 * (hits[0] + hits[1])


@pytest.mark.parametrize(
    "form",
    ["AWS_SECRET_ACCESS_KEY={}", "SECRET_KEY={}", "PRIVATE_KEY={}", "auth={}", "credential={}", "bearer_{}", "SECRET_KEY='{}'", "access_key = {}", "signing key: {}", "AccountKey: {}", "{} is the password", "{}_secret", "auth {}=="],
)
def test_joined_and_named_secrets(form, scanner):
    value = "q7Zt2LwXv9KcR4mHn8Yb3PfJ6sGd5QaTe1UiVoNx"
    (found,) = found_in(f"some words before it, {form.format(value)} and some words after it", scanner)
    assert found.rstrip("=") == value


@pytest.mark.parametrize("between", ["", "and some other words, " * 4, "x" * 225])
def test_repeated_secret(between, scanner):
    value = "q7Zt2LwXv9KcR4mHn8Yb3PfJ6sGd5QaTe1UiVoNx"
    text = f"export SECRET_KEY={value}\n{between}curl -H 'bearer {value}' {between} again, token {value}."
    assert found_in(text, scanner) == [value] * 3


def test_words_of_the_corpus(spark, scanner):
    """Common words of the corpus go into the dictionary: what was novel is not any more; words of one text do not."""
    word, once = "Qxzvwkjyhtpbqzxgkvjw", "Wvkzqjxybghqpwzxkvtj"
    df = spark.createDataFrame([(i, f"{word} text number {i}") for i in range(9)] + [(10, once)], "doc_id long, text string")
    own = secrets.fit(df)
    assert own == secrets.fit(df.repartition(3))
    text = "the secret key {} of it"
    assert found_in(text.format(word), scanner) == [word] and found_in(text.format(word), own) == []
    assert found_in(text.format(once), own) == [once]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "api_key = ABCDEFGHIJKL1234 done"), (2, None), (3, "clean")], "score long, text string")
    assert [r["text"] for r in secrets.redact(df).orderBy("score").collect()] == ["[SECRET] done", None, "clean"]


def test_rollup_deltas(spark, tmp_path):
    store = token_rollup.Store(spark, str(tmp_path / "s"))
    schema = "op string, source string, lang string, tokens long, old long"

    def batch(*rows):
        df = spark.createDataFrame(list(rows), schema)
        return token_rollup.deltas(df, "v1", op=F.col("op"), tokens=F.col("tokens"), old=F.col("old"))

    def totals():
        return {(r["source"], r["lang"]): (r["rows"], r["tokens"]) for r in store.totals().collect()}

    first = batch(("insert", "a", "en", 10, None), ("insert", "a", "en", 5, None), ("insert", None, None, 7, None))
    assert store.totals().count() == 0
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert totals() == {("a", "en"): (2, 15), (None, None): (1, 7)}
    second = batch(("delete", "a", "en", 5, None), ("revise", None, None, 9, 7))
    assert store.commit("b2", second)
    store.compact()
    assert totals() == {("a", "en"): (1, 10), (None, None): (1, 9)}
    assert not store.commit("b2", second) and store.commit("b3", batch(("insert", "b", "de", 1, None)))
    store.compact()
    assert totals() == {("a", "en"): (1, 10), (None, None): (1, 9), ("b", "de"): (1, 1)}


def test_decoding(spark):
    texts = ["some text here", "", None, "naïve 漢字\n\tx", "  two  spaces "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ids = nbest.encode(df, queries.PIECES, ["id"])
    got = {r["id"]: r["text"] for r in nbest.decode(ids, queries.PIECES, ["id"]).collect()}
    assert [got[i] for i in range(5)] == [t or "" for t in texts]


def test_every_segmentation_comes_out(spark):
    """All n segmentations against brute force: other ones each, with their scores, and the text when decoded."""
    v, n = nbest.load(queries.PIECES), 5
    texts = ["some text here", "", None, "a", "abracadabra", "naïve 漢字\n\tx", "  two  spaces ", "aaaaaa aaaaaa", "one of very many words in a longer sentence, and some more"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in nbest.encode(df, queries.PIECES, ["id"], n=n).collect():
        t = texts[r["id"]] or ""
        m = nbest.MARK + t.replace(" ", nbest.MARK) if t else ""
        best = [[(0.0, ())]] + [[] for _ in m]
        for j in range(1, len(m) + 1):
            best[j] = sorted(((x + s, (*p, m[i:j])) for i, s in v.edges(m, j) for x, p in best[i]), reverse=True)[: n + 20]
        want = [(s, [i for piece in p for i in v.ids(piece)]) for s, p in best[-1]]
        found = [r["ids"], *r["other_ids"]]
        assert len(found) == len(r["scores"]) == len({tuple(x) for x in found}) == min(n, len(want)) and r["round_trip"]
        assert np.allclose(r["scores"], [s for s, _ in want[:n]])
        for ids, s in zip(found, r["scores"], strict=True):
            assert v.decode(ids) == t
            assert any(ids == i and np.isclose(s, x) for x, i in want)


def test_every_rank_has_a_digest(spark):
    import hashlib

    df = spark.createDataFrame([(1, "some text here"), (2, "")], "id long, text string")
    plain = {r["id"]: r for r in nbest.encode(df, queries.PIECES, ["id"]).collect()}
    for r in nbest.encode(df, queries.PIECES, ["id"], digest=True).collect():
        want = [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in [plain[r["id"]]["ids"], *plain[r["id"]]["other_ids"]]]
        assert [r["ids_sha256"], *r["other_ids_sha256"]] == want and len(want) == len(r["scores"])


@pytest.mark.parametrize("word", ["▁the", "▁abracadabra", "▁▁x"])
def test_alternatives_in_order(word):
    v = nbest.load(queries.PIECES)
    found = v._alternatives(word, 8)
    scores = [s for s, _ in found]
    assert scores == sorted(scores, reverse=True) and len({c for _, c in found}) == len(found)


def recall(spark, x, **options):
    """Share of all links found; none may be found that isn't one."""
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.concatenate([(u[i : i + 1000] @ u.T >= 0.95).sum(1) - 1 for i in range(0, len(u), 1000)])
    got = np.zeros(len(x), int)
    for r in pivots.near_duplicates(df, **options).collect():
        got[r["vec_id"]] = r["n_links"]
    assert (got <= want).all() and want.sum() > 0
    return got.sum() / want.sum()


@pytest.mark.parametrize("count", [None, 1024])
def test_pivot_recall(spark, count):
    """Over 10,500 vectors: single ones, pairs around the threshold and a dense group of 900."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8000, 64))
    pairs = base[:1600] + rng.normal(size=(1600, 64)) * rng.uniform(0.05, 0.33, (1600, 1))
    dense = rng.normal(size=64) + 0.15 * rng.normal(size=(900, 64))
    assert recall(spark, pairs_only := np.concatenate((base, pairs)), pivots=count) >= 0.97
    assert recall(spark, np.concatenate((pairs_only, dense)), pivots=count) >= 0.99


def test_every_length_is_indexed(spark, monkeypatch):
    monkeypatch.setattr(pivots, "SPACES", 2)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.01, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [1.0, 0.0, 0.0, 0.0]), (6, [9.0, 0.0, 0.0, 0.0]), (7, [1.0]), (8, []), (9, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_duplicates(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (0, 8), 9: (1, 7)}


def test_joined():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = 30
        i, j = rng.integers(0, n, 20), rng.integers(0, n, 20)
        least = list(range(n))
        for _ in range(n):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
        assert components.joined(n, i, j).tolist() == least


def test_agreement_with_the_models_own_encoder():
    """Words that are cut as the library cuts them, and pieces in all."""
    import re

    import sentencepiece

    v, own = nbest.load(queries.PIECES), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    text = " ".join(inspect.getdoc(x) or "" for x in (str, dict, list, int, re, random, random.Random.sample, sorted)) * 2
    words = [w for w in text.split() if len(w) > 1]
    found = [o[0][0].tolist() for o in nbest.Encoder(v).encode(words, 1)]
    want = [own.encode(w) for w in words]
    assert sum(a == b for a, b in zip(found, want, strict=True)) >= 0.8 * len(words)
    assert abs(sum(map(len, found)) / sum(map(len, want)) - 1) <= 0.02


def test_word_hashes_that_collide(monkeypatch):
    v = nbest.Vocabulary(queries.PIECES)
    want = [o[0][0].tolist() for o in nbest.Encoder(v).encode(["some words here", "other ones"], 2)]
    plain = nbest.mix
    encoder = nbest.Encoder(v)
    monkeypatch.setattr(nbest, "mix", lambda h: plain(h) % nbest.U(3) if encoder.salt == 0 and len(h) < 6 else plain(h))
    monkeypatch.setattr(v, "tables", v.tables)
    assert [o[0][0].tolist() for o in encoder.encode(["some words here", "other ones"], 2)] == want and encoder.salt == 1


def test_header_look_alikes():
    """Bytes within a frame that look like the next frame's header, and seeks behind them."""
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 20 * flac.BLOCK).astype(np.uint8)
    for i in range(19):
        head = np.frombuffer(flac._header(i + 1), np.uint8)
        raw[i * flac.BLOCK + 60 : i * flac.BLOCK + 60 + len(head)] = head ^ 128
    p = raw.tobytes()
    media = flac.encode([p, flac.payload(b"plain")])
    assert [x.tobytes() for x in flac.decode(media)] == [p, flac.payload(b"plain")]
    assert all(flac.seek(media[0], at, 9) == p[at : at + 9] for at in (0, 500, 1700, len(p) - 9))


def test_broken_files():
    good = flac.encode([flac.payload(b"some text " * 300)])[0]
    for bad in (b"", b"fLaC", good[:12], good[:-1], good + b"x", good[: len(good) // 2], b"ID3" + good):
        with pytest.raises(ValueError):
            flac.decode([bad])
    rng = random.Random(3)
    for _ in range(60):
        at, bit = rng.randrange(60, len(good)), rng.randrange(8)
        bad = bytearray(good)
        bad[at] ^= 1 << bit
        try:
            assert flac.decode([bytes(bad)])[0].tobytes() == flac.payload(b"some text " * 300)  # a seek point, say
        except ValueError:
            pass


def test_files_may_be_missing(spark):
    df = flac.add_media(spark.createDataFrame([(1, "abc", "x"), (2, None, "y")], "id long, text string, media string"), "text")
    assert df.columns == ["id", "text", "media", "n_bytes"]
    df = df.withColumn("media", F.when(F.col("id") == 1, F.col("media"))).withColumn("feature", F.lit(7))
    got = {r["id"]: r for r in flac.features(df, ["id", "feature"]).collect()}
    assert got[1]["payload_bytes"] == 192 and got[1]["feature"] == 7 and got[1]["_feature"] and got[2]["media_sha256"] is None
    assert [r["id"] for r in flac.pcm_blocks(df, "id").collect()] == [1]


def rollup(spark, tmp_path, *batches):
    """A store with a batch of one inserted row of 10 tokens for each name."""
    store = token_rollup.Store(spark, str(tmp_path / "s"))
    one = token_rollup.deltas(spark.createDataFrame([("a", "en")], "source string, lang string"), "v1", op=F.lit("insert"), tokens=F.lit(10))
    for b in batches:
        assert store.commit(b, one)
    return store, one


def test_batch_that_arrives_during_compaction(spark, tmp_path, monkeypatch):
    store, one = rollup(spark, tmp_path, "b1", "b2")
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda number: (store.commit("late", one), publish(number)))
    store.compact()
    assert store.totals().first()["tokens"] == 30
    monkeypatch.undo()
    store.compact()
    assert store.totals().first()["tokens"] == 30 and not any(store.commit(b, one) for b in ("b1", "b2", "late"))


def test_compaction_that_dies(spark, tmp_path, monkeypatch):
    """Before its list is published, and after, before batches are deleted."""
    store, one = rollup(spark, tmp_path, "b1", "b2")
    for broken in ("_publish", "_tidy"):
        with monkeypatch.context() as m:
            calls = []
            def fail(*a):
                calls.append(a)
                if broken == "_publish" or len(calls) > 1:
                    raise OSError("stopped")
            m.setattr(store, broken, fail)
            with pytest.raises(OSError):
                store.compact()
        again = token_rollup.Store(spark, store.folder)
        assert again.totals().first()["tokens"] == 20 and not again.commit("b1", one)
    store.compact()
    assert store.totals().first()["tokens"] == 20 and store._names("batch-") == []


def test_two_compactions_and_a_late_writer(spark, tmp_path, monkeypatch):
    store, one = rollup(spark, tmp_path, "b1")
    other = token_rollup.Store(spark, store.folder)
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda number: (other.commit("b2", one), other.compact(), publish(number)))
    store.compact()  # its list has a lower number than the other's, and doesn't count
    assert store.totals().first()["tokens"] == 20
    one.withColumns({"rows": F.col("rows").cast("long")}).write.parquet(f"{store.folder}/{store._name('b1')}")  # a slow second try of b1
    assert store.totals().first()["tokens"] == 20


def test_cells_hold_for_small_weights(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    weights = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 0.001).otherwise(1000.0).alias("weight"))
    rows = mixing.mix(df, quality=weights, weights=(1,), share=0.5)
    assert rows.agg(F.sum("taken")).first()[0] == 30_000
    key, n = F.ln("key"), 30_000
    most = rows.groupBy(F.floor(key * (n / (np.e * 1000)))).count().agg(F.max("count")).first()[0]
    assert most <= 1100  # cells of 1,000 rows


def exchanged(texts, buckets, parts, hot):
    """The exchanges of the join without Spark: rows that are exchanged, and (n, alone, prefix sizes) by document."""
    import pyarrow as pa

    def sorted_rows(batches, keys):
        rows = sorted((r for b in batches for r in ngram_join._rows(b)), key=keys)
        return [ngram_join._blobs(rows[i : i + 7]) for i in range(0, len(rows), 7)]

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    sent = list(ngram_join._dealt(buckets, parts, hot, 3)([batch.slice(i, 50) for i in range(0, len(texts), 50)]))
    first = sum(map(len, sent))
    back = []
    for p in range(parts):
        mine = [ngram_join._blobs([r for r in ngram_join._rows(b) if r[0] == p]) for b in sent]
        back += ngram_join._counted(parts)(sorted_rows(ngram_join._by_bucket(mine), lambda r: r[1]))
    out = {}
    for p in range(parts):
        mine = [ngram_join._blobs([r for r in ngram_join._rows(b) if r[0] == p]) for b in back]
        for b in ngram_join._prefixes(60, 100)[0](sorted_rows(ngram_join._by_slab(mine), lambda r: r[1])):
            out |= {r["doc_id"]: (r["n"], r["alone"], len(r["toks"])) for r in b.to_pylist()}
    return first, sum(map(len, back)), out


def test_exchanges_grow_with_the_input_only(monkeypatch):
    monkeypatch.setattr(ngram_join, "SLAB_BYTES", 4000)
    monkeypatch.setattr(ngram_join, "HAND", 3000)
    texts = mutants(200, seed=8) + ["", None, "x y"]
    count = {}
    for t in texts:
        for g in brute.shingles(t, 3):
            count[g] = count.get(g, 0) + 1
    unique = {t: i for i, t in reversed(list(enumerate(texts)))}
    rows = {}
    for buckets, parts in ((4, 4), (97, 4), (10_000, 4), (1_000_000, 4), (300, 11)):
        a, b, got = exchanged(texts, buckets, parts, 10**6)
        rows[buckets, parts] = a + b
        for t, i in unique.items():
            s = brute.shingles(t, 3)
            alone = sum(count[g] == 1 for g in s)
            assert got[i][:2] == (len(s), alone) or alone < got[i][1]  # copies in one slab are one
    assert rows[1_000_000, 4] <= rows[97, 4] * 1.3


def test_hot_shingles_are_hot_everywhere(spark, monkeypatch):
    """Lines that a third of all texts share, in some slabs and not in others."""
    rng = random.Random(2)
    line = "this line stands in very many of the texts and in all of them alike"
    texts = [f"{line if i % 3 == 0 or 20 < i < 60 else ''} {' '.join(rng.choices('abcdefghij', k=rng.randrange(4, 12)))}" for i in range(150)]
    texts += [line, line + " end", "start " + line, line, line + " end"]
    monkeypatch.setattr(ngram_join, "HOT", 4)
    monkeypatch.setattr(ngram_join, "SLAB_BYTES", 900)
    near(spark, texts, monkeypatch, 1000, 256)
    near(spark, texts, monkeypatch, 3, 9)


def test_dense_families_are_not_squared(spark, monkeypatch):
    """Near copies of one text: blocks of what is connected already aren't compared again, and outliers are."""
    units = []
    plain = ngram_join.inside
    monkeypatch.setattr(ngram_join, "inside", lambda member, duos, *a: (units.append(duos.count()), plain(member, duos, *a))[1])
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(60)] = f"v{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:22] + [f"x{i}y{j}" for j in range(25)]) for i in range(6)]
    near(spark, texts, monkeypatch, 2, 8)
    blocks = len(texts) / 8
    assert sum(units) < 0.6 * blocks * (blocks + 1) / 2


def test_kept_columns_of_the_same_names(spark):
    """Kept columns named like results stay; the results get an underscore before their names."""
    df = spark.createDataFrame([(1, "some text of a house", "en", 5), (2, None, "en", 6)], "score int, text string, lang string, ids int").withColumns({"findings": F.lit("f"), "lang_pred": F.lit("x")})
    got = {r["score"]: r for r in nbest.encode(df, queries.PIECES, ["score", "ids"]).collect()}
    assert got[1]["ids"] == 5 and len(got[1]["_ids"]) == got[1]["n_pieces"] > 0 and got[2]["_ids"] == []
    got = {r["score"]: r for r in secrets.scan(df, ["score", "findings"]).collect()}
    assert got[1]["findings"] == "f" and got[1]["_findings"] == []
    model = langid.fit(df, F.lit(True))
    got = {r["score"]: r for r in langid.predict(df, model, ["score", "lang_pred"]).collect()}
    assert got[1]["lang_pred"] == "x" and got[1]["_lang_pred"] == "en" and got[2]["_lang_pred"] == "und" and got[2]["_score"] == 0
    got = {r["score"]: r for r in toxicity.score(df, None, ["score"]).collect()}
    assert got[1]["_score"] == 0.0 and got[1]["evidence"] == []


def test_ids_that_are_texts(spark):
    rows = [(f"d{i}", "worthless idiot words here" if i % 3 == 0 else f"plain text of number {'abcdefgh'[i % 8]}") for i in range(60)] * 2
    df = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(60)] + [(None, 1), ("d1", None)], "doc_id string, toxic int")
    index = toxicity.fit(df, labels, F.lit(True))
    assert len(index.ids) <= 60 and all(isinstance(i, str) for i in index.ids)  # a text an id, however often it stands there
    got = toxicity.score(df, index, ["doc_id"]).collect()
    assert all((r["score"] >= 0.7) == (int(r["doc_id"][1:]) % 3 == 0) for r in got) and any(r["evidence"] for r in got)
    with pytest.raises(ValueError):
        ngram_join.near_duplicates(df)


def test_settled_folder_on_a_cluster():
    from tarnlink.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        common.shared_dir(Session())


@pytest.mark.parametrize("word", ["漢字" * 300, "x" * 400, "漢" * 90 + "internationalization" * 12 + "字" * 200, "a漢" * 200, "📚" * 150 + "ab"])
def test_long_words(word):
    """Cut into independent parts or not: best score, runner-up and pieces are those of the walk over all of it."""
    v = nbest.load(queries.PIECES)
    cp = np.frombuffer(word.encode("utf-32-le"), np.uint32)[None].astype(nbest.U)
    for a, b in zip(v.long(cp), v.walk(cp), strict=True):
        assert np.allclose(a, b)


def test_words_that_are_forgotten(monkeypatch):
    monkeypatch.setattr(nbest, "SLAB", 200)
    monkeypatch.setattr(nbest, "KNOWN", 30)
    v = nbest.load(queries.PIECES)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", f"word{rng.randrange(500)}", "漢字"]) for _ in range(12)) for _ in range(120)]
    encoder = nbest.Encoder(v)
    for t, (ids, scores) in zip(texts, encoder.encode(texts, 3), strict=True):
        (want, points), = nbest.Encoder(v).encode([t], 3)
        assert [x.tolist() for x in ids] == [x.tolist() for x in want] and np.allclose(scores, points)
    assert 0 < len(encoder.hash) < 120


def test_words_of_all_texts_are_counted(spark):
    """No sample: words count in every distinct text, copies of a text once."""
    rows = [(f"text{'abcdefghij'[i % 10]} of number {i} common" + (" rareword" if i % 1000 == 7 else ""),) for i in range(5000)]
    docs = spark.createDataFrame([*rows, *rows[:100], ("copied copied",), ("copied copied",), ("copied copied",), (None,)], "text string")
    got = {r["w"]: r["n"] for r in secrets.word_counts(docs).collect()}
    assert got["common"] == 5000 and got["rareword"] == 5 and got["copied"] == 1 and got["textj"] == 500


def labelled_texts(count, seed):
    """(id, text, toxic): a tenth toxic; each toxic text has one of 200 words that no other has, all have some of the usual ones."""
    rng, bad = random.Random(seed), random.Random(1)
    words, rude = ([f"{p}{''.join(bad.choices('abcdefghiklmnop', k=7))}" for _ in range(200)] for p in "uz")
    return [(i, " ".join([*rng.choices(words, k=8), *([rng.choice(rude)] if i % 10 == 0 else [])]), int(i % 10 == 0)) for i in range(count)]


def toxic_frames(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """With room for 40 examples by hash, words that these do not have count, all rows stand with an example, and shares are theirs."""
    monkeypatch.setattr(toxicity, "POSITIVE", 15)
    monkeypatch.setattr(toxicity, "NEGATIVE", 25)
    rows = labelled_texts(18000, 3)
    df, labels = toxic_frames(spark, rows)
    index = toxicity.fit(df, labels, F.lit(True))
    assert len(index.vocabulary) >= 200 and len(index.ids) <= 40 + len(index.vocabulary)
    new = toxic_frames(spark, labelled_texts(1000, 4))[0]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(new, index, ["doc_id"]).collect()}
    assert sum((s >= 0.7) == (i % 10 == 0) for i, s in got.items()) >= 980


def test_toxicity_fit_as_at_hand(spark):
    """The curve and the prior learnt over tables are those of the examples at hand where every row is one."""
    import pyarrow as pa

    rows = labelled_texts(1500, 5)
    df, labels = toxic_frames(spark, rows)
    index = toxicity.fit(df, labels, F.lit(True))
    data, offsets = wordhash.raw(pa.array([t for _, t, _ in rows], pa.string()))
    told = index.counts(data, offsets)
    df = np.zeros(len(index.vocabulary))
    for at, _ in told:
        df[at] += 1
    plain = toxicity.build(index.vocabulary, df, len(rows), [(str(i), y, *v) for (i, _, y), v in zip(rows, told, strict=True)], (1.0, 1.0))
    assert plain.ids == index.ids and np.array_equal(plain.toxic, index.toxic) and len(index.ids) < len(rows)
    assert np.allclose([plain.prior, plain.slope, plain.shift], [index.prior, index.slope, index.shift], atol=1e-3)
