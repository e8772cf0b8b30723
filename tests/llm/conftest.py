import pytest

LONG = "lorem ipsum dolor " * 8000


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Tables with nulls everywhere, empty and very long texts, ties, repeated rows and columns with the names that
    operators use themselves."""
    d = str(tmp_path_factory.mktemp("odd"))
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of some deadly nightshade near the old bridge at dawn"
    texts = [
        None, "", "  \t\n", "one", "two words", "three word text", base, base, base.upper(), base + " again", base.replace("potion", "brew"), LONG, LONG + "end",
        "x" * 50_000, "password = 'Zk3+9fQpLm2Wx8Rt'", "naïve Ünïcödé ▁ 漢字 ﬁ x \U0001f600", "1234 5678 !!", base, "the the the the the", "idiot scum trash", "idiot moron trash",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("src0", None, "src1")[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, "en", "src0", 1), (None, "nobody else says this at all", None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "1 as score, 2 as n, 3 as cls, 4 as size, 5 as key, 6 as findings, 7 as _text, 8 as _tag, 9 as taken, 10 as weight, 11 as _r"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *extra.split(", "))
    docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
    labels = [(i, i % 2, int(i in (19, 20))) for i in range(len(texts))] + [(3, None, None), (None, 1, 1), (6, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.01, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1.0, 0.0]), (10, []), (11, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def void(spark, odd, tmp_path_factory):
    """The same tables without rows."""
    d = str(tmp_path_factory.mktemp("void"))
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d
