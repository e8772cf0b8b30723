"""Crawled pages: index records, archive members and the company name and industry of a page."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.text import last_part, strip
from .markup import elements, unescaped

INDEX = "url string, filename string, offset string, length string, mime string"


def read_index(spark: SparkSession, path: str, pattern: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Index records, one JSON object a line; other lines are dropped. Only HTML, by the record's own type if it has one.
    pattern: of the url's host, * for any characters (`*.au`). limit and offset: a part of the records, in the order of their
    archives and places."""
    rows = spark.read.text(path).select(parse_index(F.col("value")).alias("r")).select("r.*")
    rows = rows.filter("url is not null and coalesce(mime, 'text/html') = 'text/html'")
    if pattern:
        rows = rows.filter(host_like(F.col("url"), pattern))
    return rows if limit is None and not offset else part(rows, offset, limit)


def host_like(url: Column, pattern: str) -> Column:
    """Whether the host of a url is of the pattern, case aside; * stands for any characters."""
    like = "".join(".*" if c == "*" else re.escape(c) for c in pattern.lower())
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)).rlike(f"^(?:{like})$")


def part(records: DataFrame, offset: int, limit: int | None) -> DataFrame:
    """Records from offset on, at most limit, in the order of archive, place and url."""
    rows = records.orderBy("filename", F.col("offset").cast("long"), "url").offset(offset)
    return rows if limit is None else rows.limit(limit)


def pages(records: DataFrame, size: int, most: int | None = None) -> Iterator[DataFrame]:
    """Page after page of records, until one is empty or there were `most`."""
    number = 0
    while most is None or number < most:
        got = part(records, number * size, size)
        if got.isEmpty():
            return
        yield got
        number += 1


def members(records: DataFrame, archives: DataFrame) -> DataFrame:
    """records with `html`, the page that the archive holds at their offset and length; records without a good response
    there are dropped. archives: path, content (as the binaryFile reader gives them); their names must end in filename."""
    name = F.element_at(F.split("path", "/"), -1)
    held = archives.select(name.alias("_name"), F.col("content").alias("_content"))
    rows = records.join(held, F.element_at(F.split("filename", "/"), -1) == F.col("_name"))
    piece = F.substring(F.col("_content"), F.col("offset").cast("int") + 1, F.col("length").cast("int"))
    out = rows.withColumn("html", response_html(piece)).drop("_name", "_content")
    return out.filter("html is not null").withColumn("html", F.col("html").cast("string"))


def parse_index(line: Column) -> Column:
    return F.when(F.ltrim(line).startswith("{"), F.from_json(line, INDEX))


def byte_range(offset: Column, length: Column) -> Column:
    """A range header for a member."""
    return F.format_string("bytes=%d-%d", offset.cast("long"), offset.cast("long") + length.cast("long") - 1)


@F.arrow_udf(BinaryType())
def response_html(member: pa.Array) -> pa.Array:
    """The body of the first response record (status 200 or 206) of a compressed archive member; null without one."""
    out = []
    for raw in member.to_pylist():
        body = None
        try:
            rest = gzip.decompress(raw) if raw and raw[:2] == b"\x1f\x8b" else raw or b""
            while rest and body is None:
                head, _, rest = rest.partition(b"\r\n\r\n")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                size = int(fields.get(b"content-length", b"0"))
                block, rest = rest[:size], rest[size:].lstrip(b"\r\n")
                if fields.get(b"warc-type") == b"response":
                    http, _, content = block.partition(b"\r\n\r\n")
                    status = http.split(b"\r\n", 1)[0].split()[1:2]
                    body = content if status and status[0] in (b"200", b"206") else None
                    break
        except (OSError, ValueError, EOFError):
            body = None
        out.append(body)
    return pa.array(out, pa.binary())


def _inner(html: Column, pattern: str, group: int) -> Column:
    """A group of the first match, its tags taken out; null where there is none or it's blank."""
    text = strip(unescaped(F.regexp_replace(F.regexp_extract(html, pattern, group), r"<[^>]*>", "")))
    return F.nullif(text, F.lit(""))


def _meta(html: Column, attribute: str, value: str) -> Column:
    return _inner(html, rf"""(?is)<meta\b(?=[^>]*\b{attribute}\s*=\s*["']{value}["'])[^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1)


#: Pages that may have one of the wanted elements; only these are parsed.
_MARKED = r"""(?is)<[^>]*\b(?:itemprop\s*=\s*["']?name\b|class\s*=\s*["']?[^"'>]*(?:company-name|logo|brand))"""


def organization(html: Column) -> Column:
    """The name of an Organization in linked data. An object's ends the search; a list's may be replaced by a later script's."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    one, many = "`@type` string, name string", "array<struct<`@type`: string, name: string>>"

    def step(acc: Column, s: Column) -> Column:
        s = F.trim(s)
        single = F.when(s.startswith("{"), F.from_json(s, one))
        hit = F.when(single["@type"] == "Organization", single["name"])
        item = F.when(s.startswith("["), F.try_element_at(F.filter(F.from_json(s, many), lambda x: (x["@type"] == "Organization") & x["name"].isNotNull()), F.lit(1))["name"])
        return F.when(acc["done"], acc).when(hit.isNotNull(), F.struct(F.lit(True).alias("done"), hit.alias("name"))).otherwise(F.struct(F.lit(False).alias("done"), F.coalesce(item, acc["name"]).alias("name")))

    start = F.struct(F.lit(False).alias("done"), F.lit(None).cast("string").alias("name"))
    return F.nullif(strip(F.aggregate(scripts, start, step)["name"]), F.lit(""))


def title_name(html: Column) -> Column:
    """The page title: what follows its last separator, null where nothing does; whole without one."""
    whole = _inner(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.when(whole.rlike(r"[-|–—]"), last_part(whole)).otherwise(whole), F.lit(""))


def heading(html: Column) -> Column:
    """The text of the first h1, if that is all it holds (within other elements or not)."""
    inner = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return F.nullif(strip(unescaped(F.regexp_extract(inner, r"(?s)^(?:<\w[^>]*>)*([^<]*)(?:</\w+\s*>)*$", 1))), F.lit(""))


def company_name(html: Column) -> Column:
    """The first rule that finds something: site name, linked data, itemprop, class, title, heading."""
    parsed = elements(F.when(html.rlike(_MARKED), html))
    return F.coalesce(_meta(html, "property", "og:site_name"), organization(html), parsed["itemprop"], parsed["company_name"], parsed["logo"], parsed["brand"], title_name(html), heading(html))


def industry(html: Column) -> Column:
    return _meta(html, "name", "keywords")
