import gzip

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlink.functions import similarity, text
from tarnlink.sources import web


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()[0]


def test_title_case(spark):
    cases = {"o'brien & sons pty-ltd 3m": "O'Brien & Sons Pty-Ltd 3M", "école d'été  x": "École D'Été X", "McDonald's (NSW)": "Mcdonald'S (Nsw)"}
    for a, b in cases.items():
        assert one(spark, a, lambda c: text.title(text.collapse(c))) == b


def test_null_tokens_and_strip(spark):
    for v in ("", "NA", "None", "N/A"):
        assert one(spark, v, text.known) is None
    assert one(spark, "Acme", text.known) == "Acme"
    assert one(spark, "  a b\t", text.strip) == "a b"
    assert one(spark, None, text.name_key) == ""


def test_last_part(spark):
    assert one(spark, "Buy Now - Acme", text.last_part) == "Acme"
    assert one(spark, "Acme", text.last_part) == "Acme"
    html = "<title>Acme -</title><h1>Acme Co</h1>"
    assert one(spark, html, web.company_name) == "Acme Co"


def test_references_end_in_a_semicolon(spark):
    """A title cut within a reference stays as it is; whole references are resolved once."""
    page = "<title>Erre*** und&amp;&&amp</title><h1>&lt;b&gt; &amp;lt; &eacute;&#39;&#x2019; &nosuch; &notit; &amp</h1>"
    assert one(spark, page, web.title_name) == "Erre*** und&&&amp"
    assert one(spark, page, web.heading) == "<b> &lt; \u00e9'\u2019 &nosuch; &notit; &amp"


def test_ratio_golden(spark):
    pair = spark.createDataFrame([("kitten", "sitting"), ("acme pty ltd", "acme limited pty"), ("pty ltd acme", "acme ltd pty")], "a string, b string")
    got = pair.select(similarity.indel_ratio("a", "b"), similarity.token_sort_ratio(F.col("a"), F.col("b"))).collect()
    assert round(got[0][0], 6) == 61.538462 and round(got[1][0], 6) == 57.142857 and got[2][1] == 100.0


def table_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[-1]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcß é", max_size=12), st.text("abcß é", max_size=12))
def test_lcs_bits(a, b):
    assert similarity.lcs_length(a, b) == table_lcs(a, b) == similarity.lcs_length(b, a)


def test_lcs_sql_form(spark):
    pair = spark.createDataFrame([("kitten", "sitting"), ("", "x"), ("ab", "ba")], "a string, b string")
    assert [r[0] for r in pair.select(similarity.lcs_sql(F.col("a"), F.col("b"))).collect()] == [4, 0, 1]


def test_archive_member(spark):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<title>x</title>"
    member = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    rows = [(bytearray(gzip.compress(member)),), (bytearray(member.replace(b"200 OK", b"404 No")),), (bytearray(b"junk"),), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "m binary").select(web.response_html("m")).collect()]
    assert bytes(got[0]) == b"<title>x</title>" and got[1:] == [None, None, None]


def test_linked_data_override(spark):
    script = '<script type="application/ld+json">{}</script>'
    listed = script.format('[{"@type": "Organization", "name": "A"}]')
    assert one(spark, listed + script.format('{"@type": "Organization", "name": "B"}'), web.organization) == "B"
    assert one(spark, script.format('{"@type": "Organization", "name": "B"}') + listed, web.organization) == "B"
    assert one(spark, script.format("{bad"), web.organization) is None
