import gzip
import json
import logging
import math
import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnlink.operators import clean, linkage, quality, upsert
from tarnlink.plans import flow
from tarnlink.sources import catalog, files, markup, register, web
from tarnlink.sources.versions import Versions
from tarnlink.streaming import incremental


def test_register_filters(spark):
    rows = [(1, "12345678901", "2000"), (2, " 12345678901 ", "0800"), (3, "1234567890", "2000"), (4, "1234567890a", "2000"), (5, None, "2000"), (6, "１２３４５６７８９０１", "2000"), (7, "12345678902", "800"), (8, "12345678903", None)]
    got = clean.clean_register(spark.createDataFrame(rows, "n int, ABN string, Postcode string"), "n").collect()
    assert [(r["abn"], r["postcode"], r["suburb"]) for r in got] == [("12345678901", "2000", "")]


def test_upsert_actions(spark):
    target = spark.createDataFrame([("k1", None, "v1"), ("k2", "n", "v2")], "website_url string, company_name string, industry string")
    stage = spark.createDataFrame([("k1", None, "v1"), ("k2", "n", "v9"), ("k3", "n", "v3")], target.schema)
    got = {r["website_url"]: (r["industry"], r["action"]) for r in upsert.classify(target, stage, upsert.WEB).collect()}
    assert got == {"k1": ("v1", "NOOP"), "k2": ("v9", "UPDATE"), "k3": ("v3", "INSERT")}


def test_upsert_of_matches(spark):
    schema = "abn string, url string, company_name string, abr_company string, industry string, entity_type string, entity_status string, match_confidence double"
    target = spark.createDataFrame([("1", None, "a", "a", "i", "t", "s", 90.0), ("2", None, "a", "a", "i", "t", "s", 90.0)], schema)
    stage = spark.createDataFrame([("1", None, "a", "a", "i", "t", "s", 80.0), ("2", None, "a", "a", "i", "t", "s", 95.0)], schema)
    got = {r["abn"]: (r["match_confidence"], r["action"]) for r in upsert.classify(target, stage, upsert.MATCHES).collect()}
    assert got == {"1": (90.0, "NOOP"), "2": (95.0, "UPDATE")}


def test_unique_ignores_nulls(spark):
    got = quality.duplicates(spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "abn int"), "abn").collect()
    assert [(r["value"], r["n"]) for r in got] == [(1, 2)]


def test_matching_keeps_schema_when_empty(spark):
    a = spark.createDataFrame([(1, "")], "id long, name string")
    for f in (linkage.blocked, linkage.nested_loop, linkage.cosine):
        out = f(a, a)
        assert out.columns == ["left_id", "right_id", "score", "rank"] and out.count() == 0


def made_names(count, seed):
    rng = random.Random(seed)
    words = ["acme", "pty", "ltd", "limited", "zenith", "zenit", "co", "company", "north", "south", "a", "the"]
    names = [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(count)]
    for i in range(0, count, 3):  # with some letters gone, doubled or changed
        n = list(names[i])
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(n))
            n[at] = rng.choice(["", n[at] * 2, "q", " "])
        names[i] = "".join(n).strip()
    return names + ["", "x", "xy", names[0], names[0], "é", "aaaaaaaaaaaa", "aaaaaaaaa"]


def plain_best(left, right, threshold, n, block=0, least=1, apart=False):
    from tarnlink.functions.similarity import lcs_length

    key = lambda s: " ".join(sorted(s.split()))
    out = []
    for i, x in left:
        found = []
        for j, y in right:
            a, b = key(x), key(y)
            if a and b and len(x) >= least and len(y) >= least and x[:block] == y[:block] and not (apart and i == j):
                score = 200 * lcs_length(a, b) / (len(a) + len(b))
                if score >= threshold:
                    found.append((-score, j))
        out += [(i, j, round(-s, 6), r + 1) for r, (s, j) in enumerate(sorted(found)[:n])]
    return sorted(out)


@pytest.mark.parametrize("threshold, n, block, apart", [(50, 2, 0, True), (60, 1, 2, False), (70, 99, 0, False), (85, 1, 0, True), (85, 3, 2, True), (97, 2, 0, True), (100, 1, 0, True)])
def test_ratios_equal_all_pairs(spark, threshold, n, block, apart):
    left, right = list(enumerate(made_names(90, 1))), list(enumerate(made_names(90, 1 if apart else 2)))
    a, b = (spark.createDataFrame(x, "id long, name string") for x in (left, right))
    got = linkage.blocked(a, b, threshold=threshold, n=n, block=block, apart=apart) if block else linkage.nested_loop(a, b, threshold=threshold, n=n, apart=apart)
    assert sorted((r["left_id"], r["right_id"], round(r["score"], 6), r["rank"]) for r in got.collect()) == plain_best(left, right, threshold, n, block, apart=apart)


@pytest.mark.parametrize("threshold, grams, apart", [(0.3, 1, False), (0.7, 1, True), (0.7, 2, False), (0.95, 1, True)])
def test_cosines_equal_all_pairs(spark, threshold, grams, apart):
    left, right = list(enumerate(made_names(70, 3))), list(enumerate(made_names(70, 3 if apart else 4)))
    a, b = (spark.createDataFrame(x, "id long, name string") for x in (left, right))

    def terms(s):
        t = re.findall(r"\w{2,}", s.lower())
        return Counter(t + ([f"{x} {y}" for x, y in zip(t, t[1:])] if grams == 2 else []))

    rows = [terms(s) for _, s in left + right]
    df = Counter(t for r in rows for t in r)

    def vector(s):
        w = {t: c * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, c in terms(s).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    want = []
    vectors = [(j, vector(y)) for j, y in right]
    for i, x in left:
        v = vector(x)
        found = sorted((-round(sum(p * y.get(t, 0) for t, p in v.items()), 6), j) for j, y in vectors if not (apart and i == j))
        want += [(i, j, -s) for s, j in found[:2] if v and -s >= threshold]
    got = linkage.cosine(a, b, threshold=threshold, n=2, grams=grams, apart=apart)
    assert sorted((r["left_id"], r["right_id"], r["score"]) for r in got.collect()) == sorted(want)


def test_one_name_in_very_many_rows(spark):
    """A third of all rows have one name: pairs of names are scored once, and only the least ids win."""
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "acme pty").otherwise(F.concat(F.lit("firm number "), F.col("id") + 1000)).alias("name"))
    best = {r["left_id"]: r["right_id"] for r in linkage.blocked(many, many, threshold=100, apart=True).collect()}
    assert best == {i: 3 if i == 0 else 0 for i in range(0, 3000, 3)}
    near = {r["left_id"]: r["right_id"] for r in linkage.cosine(many, many, threshold=0.999, apart=True).collect()}
    assert near == best


def test_fourth_stage(spark):
    left = spark.createDataFrame([(1, "acme pty ltd"), (2, "north wind trading"), (3, "zebra"), (4, "")], "id long, name string")
    right = spark.createDataFrame([(7, "acme pty ltd"), (8, "trading north wind company of perth"), (9, "wind")], "id long, name string")
    asked = lambda a, b: json.dumps({"is_match": "north" in b, "confidence": 0.9, "reasoning": "", "unified_name": a}) if b != "wind" else "no json"
    got = {(r["left_id"], r["right_id"], r["method"]) for r in linkage.waterfall(left, right, client=asked).collect()}
    assert got == {(1, 7, "exact"), (2, 8, "llm")} and linkage.waterfall(left, right, client=None).count() == 1


def test_xml_folder(spark, tmp_path):
    ok = '<X><ABR><ABN status="ACT">12345678901</ABN><EntityType><EntityTypeText>T</EntityTypeText></EntityType><BusinessAddress><AddressDetails><State>NSW</State><Postcode>0800</Postcode></AddressDetails></BusinessAddress><MainName>M</MainName></ABR></X>'
    (tmp_path / "a.xml").write_text(ok)
    (tmp_path / "b.txt").write_text(ok)
    rows = register.register_row(register.read_register(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in rows] == [("12345678901", "M", "T", "ACT", "NSW 0800", "0800", "NSW", "")]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.xml", "<a/>")
        z.writestr("y.txt", "no")
    got = files.unzip(spark, str(tmp_path / "a.zip")).collect()
    assert [(r["member"], bytes(r["content"])) for r in got] == [("x.xml", b"<a/>")]


def test_index_lines(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"url": "u", "filename": "f", "offset": "3", "length": "4"}\n[1]\nbad\n\n{"url": "v", "mime": "image/png"}\n')
    got = web.read_index(spark, str(tmp_path / "i.json")).select("url", web.byte_range(F.col("offset"), F.col("length"))).collect()
    assert [tuple(r) for r in got] == [("u", "bytes=3-6")]


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("0800", 'a "q"\nb'), ("007", None)], "code string, name string")
    files.write_delimited(df, str(tmp_path / "o"))
    got = files.read_delimited(spark, str(tmp_path / "o"), "code string, name string", multi_line=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert files.positional(df, ["x"]).count() == 0 and files.positional(df, ["x", "y"]).columns == ["x", "y"]


def test_stream_of_upserts(spark, tmp_path):
    schema = "website_url string, company_name string, industry string"
    src, target, mark = (str(tmp_path / x) for x in ("src", "target", "mark"))
    for rows in ([("a", "n", "1"), ("b", "n", "1")], [("b", "n", "2"), ("c", "n", "1")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.upsert_stream(spark, src, schema, target, mark, upsert.WEB).awaitTermination()
    got = sorted((r["website_url"], r["industry"]) for r in incremental.current(spark, target).collect())
    assert got == [("a", "1"), ("b", "2"), ("c", "1")]


def test_stages_run_in_order(spark):
    out = flow.run(spark, [("a", lambda s, got: s.range(3)), ("b", lambda s, got: got["a"].filter("id > 0"))])
    assert out["b"].count() == 2


def test_models_refer(spark):
    m = flow.Models(spark)
    m.add("a_model", "select 1 as id union all select null")
    m.add("b_model", "select * from {{ ref('a_model') }} where id = 1", table=True)
    assert m.build("b_model").count() == 1
    assert quality.missing(m.build("a_model"), ["id"]).first()["failures"] == 1


def test_the_last_staged_row_counts(spark):
    schema = "website_url string, company_name string, industry string"
    target = spark.createDataFrame([("k1", "n", "old")], schema)
    stage = spark.createDataFrame([("k1", "n", "zeta"), ("k1", "n", "alpha"), ("k2", "n", "alpha"), ("k2", "n", "zeta")], schema).coalesce(1)
    got = {r["website_url"]: (r["industry"], r["action"]) for r in upsert.classify(target, stage, upsert.WEB).collect()}
    assert got == {"k1": ("alpha", "UPDATE"), "k2": ("zeta", "INSERT")}
    late = stage.withColumn("arrival", F.when(F.col("industry") == "zeta", 9).otherwise(3))
    got = upsert.classify(target, late, upsert.WEB)
    assert {r["industry"] for r in got.collect()} == {"zeta"} and got.columns == [*target.columns, "action"]


def test_own_columns_stay(spark):
    """Columns of the names that operators use themselves."""
    from tarnlink.operators import dedup

    df = spark.createDataFrame([(1, 5, "a"), (1, 4, "b")], "k int, _rank int, _k0 string")
    got = dedup.keep_first(df, ["k"], ["_rank"])
    assert got.columns == df.columns and got.first()["_k0"] == "b"
    assert quality.orphans(df, df.filter("_rank = 5"), [("k", "k"), ("_k0", "_k0")]).first()["_k0"] == "b"
    target = spark.createDataFrame([("u", "n", "i", "mine", 1)], "website_url string, company_name string, industry string, action string, _old int")
    got = upsert.classify(target, target.withColumn("industry", F.lit("j")), upsert.WEB).first()
    assert (got["action"], got["_action"], got["_old"], got["industry"]) == ("mine", "UPDATE", 1, "j")


def test_odd_headers(spark):
    df = spark.createDataFrame([(1, " 12345678901", "2000", "x", "y", "z")], "n int, ABN string, Postcode string, `a.b` string, `A B` string, `a b` string")
    assert clean.clean_register(df, "n").first()["abn"] == "12345678901"
    from tarnlink.functions.text import snake_columns

    assert snake_columns(df).columns == ["n", "abn", "postcode", "a.b", "a_b", "a_b_2"]


def test_first_row_of_a_number_decides(spark):
    rows = [(1, "12345678901", "2000", "Cancelled"), (2, "12345678901", "2000", "Active"), (3, "12345678902", "2000", "active")]
    got = clean.clean_register(spark.createDataFrame(rows, "n int, abn string, postcode string, status string"), "n", active=("status", "active"))
    assert [r["abn"] for r in got.collect()] == ["12345678902"]


def test_urls_keep_their_case(spark):
    rows = [(1, "https://a.example/X", "acme", None), (2, "https://a.example/x", "acme", None), (3, " https://a.example/x ", "ACME", None)]
    assert clean.clean_web(spark.createDataFrame(rows, "n int, website_url string, company_name string, industry string"), "n").count() == 2


def test_metrics_without_rows(spark):
    df = spark.createDataFrame([], "a string, seen date")
    got = quality.metrics(df, quality.company_measures(["a"], {"a": "x"}, stamp="seen"), run_id="r").collect()
    assert {(r["pipeline_run_id"], r["metric_value"], r["status"]) for r in got} == {("r", None, "no rows")} and len(got) == 3


def test_gate(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    assert quality.gate(df, not_null=["k"]) is df
    for bad in ({"unique": ["k"]}, {"not_null": ["v"]}):
        with pytest.raises(ValueError):
            quality.gate(df, **bad)


def test_statements():
    script = "insert into t values ('a--b', 'c;d', \"e;/*\"); -- a comment; here\n/* and ; another */ select `x;y`, 'it''s; ok';\n;\nselect 1"
    assert catalog.statements(script) == ["insert into t values ('a--b', 'c;d', \"e;/*\")", "select `x;y`, 'it''s; ok'", "select 1"]


def test_nested_markup(spark):
    page = '<div class="logo"><div>Acme</div> Holdings</div><p itemprop="name">Caf&eacute; &#8217;x&#8217;<br>y</p><span class="xbrand">no</span>'
    assert markup.first_texts(page) == {"logo": "Acme Holdings", "itemprop": "Caf\u00e9 \u2019x\u2019y"}
    for broken in ("<div class=logo>open <b>all", "<div class='logo'>a</b></div>", "<div class=logo/>", "<", "<!DOCTYPE", "<div class=logo><![x"):
        markup.first_texts(broken)
    assert one_page(spark, "<title>A &amp; B -</title><h1><b>C&eacute;</b></h1>") == "C\u00e9"
    assert one_page(spark, "<title>  </title><h1>x<b>y</b></h1>") is None


def one_page(spark, html):
    return spark.createDataFrame([(html,)], "h string").select(web.company_name(F.col("h")).alias("n")).first()["n"]


def test_index_to_pages(spark, tmp_path):
    """A landed index and its archive: pattern, pages until one is empty, members by offset and length."""
    blobs, lines, at = b"", [], 0
    for i, status in enumerate(("200 OK", "404 No", "206 Part")):
        http = f"HTTP/1.1 {status}\r\n\r\n<title>Firm {i}</title>".encode()
        member = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n")
        lines.append(json.dumps({"url": f"https://Shop{i}.Example.au/x", "filename": "seg/a.warc.gz", "offset": str(at), "length": str(len(member)), "mime": "text/html"}))
        blobs, at = blobs + member, at + len(member)
    lines.append(json.dumps({"url": "https://au.example.com", "filename": "seg/a.warc.gz", "offset": "0", "length": "5", "mime": "text/html"}))
    (tmp_path / "a.warc.gz").write_bytes(blobs)
    (tmp_path / "index.json").write_text("\n".join(lines))
    index = web.read_index(spark, str(tmp_path / "index.json"), "*.au")
    got = [p.count() for p in web.pages(index, 2)]
    assert got == [2, 1] and [p.count() for p in web.pages(index, 2, most=1)] == [2]
    archives = spark.read.format("binaryFile").load(str(tmp_path / "a.warc.gz")).select("path", "content")
    rows = web.members(index, archives).select(web.company_name(F.col("html")).alias("n")).collect()
    assert sorted(r["n"] for r in rows) == ["Firm 0", "Firm 2"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(2500)], "a int, b string")
    for _ in range(2):
        files.write_delimited(df, str(tmp_path / "csv"), append=True)
    assert files.read_delimited(spark, str(tmp_path / "csv"), "a int, b string").count() == 5000
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for _ in range(2):
        files.write_jdbc(df, url, "rows_of", driver, batch=1000, connections=2)
    assert spark.read.jdbc(url, "rows_of", properties=driver).count() == 5000
    files.write_table(df, "flat_t")
    files.write_table(df, "flat_t", append=True)
    assert catalog.scan(spark, "flat_t").count() == 5000
    for t in ("left_t", "right_t"):
        files.write_table(df, t, buckets=(4, "a"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_t").join(spark.table("right_t"), "a")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2500 and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("flat_t", "left_t", "right_t"):
            spark.sql(f"drop table {t}")


def test_adaptive_load(spark, tmp_path, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("int").alias("a"), F.lit("x").alias("b")).repartition(4)
    files.write_delimited(df, str(tmp_path / "csv"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a split a file
    try:
        for size, files_written in ((files.BULK, 1), (10, 4)):
            monkeypatch.setattr(files, "BULK", size)
            assert files.load(spark, str(tmp_path / "csv"), "a int, b string", "loaded_t", ["x", "y"]) == 1000
            assert spark.table("loaded_t").columns == ["x", "y"] and len(spark.table("loaded_t").inputFiles()) == files_written
            assert "1000 rows" in spark.sql("describe extended loaded_t").filter("col_name = 'Statistics'").first()["data_type"]
            spark.sql("drop table loaded_t")
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_row_range(spark, tmp_path):
    files.write_delimited(spark.range(50).coalesce(1), str(tmp_path / "r"))
    scan = files.read_delimited(spark, str(tmp_path / "r"), None)
    assert scan.dtypes == [("id", "int")]
    assert [r["k"] for r in files.row_range(scan, 10, 13, ["k"]).collect()] == [10, 11, 12] and files.row_range(scan, 0, 9, ["a", "b"]).count() == 0


def test_versions_survive_a_stop(spark, tmp_path, monkeypatch):
    t = Versions(spark, str(tmp_path / "t"))
    assert t.last() is None
    t.replace(spark.range(2))
    with monkeypatch.context() as m:
        m.setattr(t, "_commit", lambda number: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            t.replace(spark.range(5))
    again = Versions(spark, t.folder)
    assert again.last() == 0 and again.read().count() == 2
    for n in range(3, 7):
        again.replace(spark.range(n))
    assert again.read().count() == 6 and again._numbers() == [3, 4] and len(list((tmp_path / "t/data").glob("version=*"))) == 2


def test_stream_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "website_url string, company_name string, industry string, arrival int"
    src, target, mark = (str(tmp_path / x) for x in ("src", "target", "mark"))
    first = [(f"u{i}", "n", "1", 1) for i in range(100)]
    for rows in (first, [("u5", "n", "late", 3), ("u5", "n", "early", 2)], [("new", "n", "1", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.upsert_stream(spark, src, schema, target, mark, upsert.WEB, buckets=16).awaitTermination()
    got = {r["website_url"]: r["industry"] for r in incremental.current(spark, target).collect()}
    assert len(got) == 101 and got["u5"] == "late" and got["u6"] == "1"
    t = Versions(spark, target)
    held = t._manifest(t.last())["buckets"]
    assert sorted(held.values()).count(0) >= 14 and set(held.values()) <= {0, 1, 2}


def test_log_files(spark, tmp_path):
    root = logging.getLogger()
    kept, root.handlers = root.handlers, []
    try:
        flow.run(spark, [("one", lambda s, got: s.range(1))], log_dir=str(tmp_path))
        with pytest.raises(ZeroDivisionError):
            flow.run(spark, [("two", lambda s, got: 1 / 0)], log_dir=str(tmp_path))
    finally:
        root.handlers = kept
    assert "stage one planned" in (tmp_path / "one.log").read_text() and "ZeroDivisionError" in (tmp_path / "two.log").read_text()


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        files.shared_folder(Session())


def test_file_stamp(spark):
    from tarnlink.functions.text import file_stamp

    r = spark.range(1).select(file_stamp().alias("now"), file_stamp(F.to_timestamp(F.lit("2024-05-06 07:08:09"))).alias("then")).first()
    assert r["then"] == "20240506_070809" and re.fullmatch(r"\d{8}_\d{6}", r["now"])


def test_register_names(spark):
    xml = "<ABR><ABN status='ACT'>1</ABN><MainEntity><NonIndividualName><NonIndividualNameText>{}</NonIndividualNameText></NonIndividualName>{}</MainEntity><MainName>Main</MainName></ABR>"
    line = "<MainBusinessPhysicalAddress><StateCode>NSW</StateCode><Postcode>2000</Postcode><AddressLine>1 High St</AddressLine></MainBusinessPhysicalAddress>"
    raw = spark.createDataFrame([(xml.format("", ""),), (xml.format("Firm", line),)], "x string").select(register.parse_record(F.col("x")).alias("r"))
    assert sorted(r["entity_name"] for r in register.register_row(raw, "r.").collect()) == ["", "Firm"]
    assert sorted(r["address"] for r in register.register_row_with_line(raw, "r.").collect()) == ["", "1 High St"]


def test_download(tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response({"/ok": 200, "/part": 206}.get(self.path, 404))
            self.end_headers()
            self.wfile.write(b"x" * 3000)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, to = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "f")
    try:
        for bad in ("/none", "/part"):
            with pytest.raises(OSError):
                files.download(base + bad, to)
        assert list(tmp_path.iterdir()) == []
        assert files.download(base + "/ok", to, chunk=1024) and not files.download(base + "/none", to)
        assert (tmp_path / "f").read_bytes() == b"x" * 3000
    finally:
        server.shutdown()


def test_a_failing_task_fails_the_job(spark):
    from tarnlink.operators import classify

    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    with pytest.raises(Exception, match="no answer"):
        classify.ask(pairs, "a", "b", lambda a, b: (_ for _ in ()).throw(ValueError("no answer"))).collect()
