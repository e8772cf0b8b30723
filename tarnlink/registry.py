"""Named queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import similarity, text
from .operators import classify, clean, dedup, linkage, quality, unify, upsert
from .plans import company
from .plans.flow import Models
from .sources import catalog, files, register, web

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL fragments of the oracles ---------------------------------------------------------------------------------

STRIP = "regexp_replace({0}, '^[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g')"
SORTED = "array_to_string(list_sort(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')), ' ')"

def lcs(a: str, b: str) -> str:
    """DuckDB: length of the longest common subsequence of two non-empty texts, row by row."""
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda acc, j: list_append(acc, greatest(acc[-1], prev[j[1] + 1], prev[j[1]] + case when {b}[j[1]:j[1]] = ch[1] then 1 else 0 end)), [0::bigint])"
    row = row.replace("ch[1]", f"{a}[ch[1]:ch[1]]")
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda prev, ch: {row}, list_transform(range(0, length({b}) + 1), lambda z: 0::bigint))[-1]"


def ratio(a: str, b: str) -> str:
    return f"(200.0::double * {lcs(a, b)} / (length({a}) + length({b})))"


#: The two sides of the linkage queries: titles and headings of pages, whole; a page does not match itself.
_NAMES = f"""l as (select page_id as id, lower({STRIP.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) as name from pages),
r as (select page_id as id, lower({STRIP.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}) as name from pages)"""


def names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    return tuple(pages.select(F.col("page_id").alias("id"), text.name_key(F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)).alias("name")) for tag in ("title", "h1"))


def best_sql(threshold: float, n: int = 1, block: int = 0, least: int = 1, tag: str = "") -> str:
    """Oracle: the n best of each row of l by the ratio of sorted names, from r, of another id, each pair of names scored once."""
    key = f"name[1:{block}]" if block else "''"
    sides = ", ".join(f"{tag}{x}s as (select id, {key} k, {SORTED.format('name')} s from {x} where length(name) >= {least} and {SORTED.format('name')} <> '')" for x in ("l", "r"))
    return f"""{sides},
{tag}p as materialized (select distinct x.k, x.s a, y.s b from (select distinct k, s from {tag}ls) x join (select distinct k, s from {tag}rs) y on x.k = y.k and 200 * least(length(x.s), length(y.s)) >= {threshold} * (length(x.s) + length(y.s))),
{tag}q as materialized (select k, a, b, case when a = b then 100.0::double else {ratio("a", "b")} end sc from {tag}p),
{tag}k as (select x.id lid, y.id rid, sc, row_number() over (partition by x.id order by sc desc, y.id) rk from {tag}q q join {tag}ls x on x.k = q.k and x.s = q.a join {tag}rs y on y.k = q.k and y.s = q.b where sc >= {threshold} and x.id <> y.id),
{tag}f as (select lid as left_id, rid as right_id, round(sc, 6) as score, rk::int as rank from {tag}k where rk <= {n})"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("int")})


# --- linkage ------------------------------------------------------------------------------------------------------


@query(f"with {_NAMES}, {best_sql(85, block=2)} select * from f")
def match_blocked_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkage.blocked(*names(spark, sf_dir), apart=True))


#: All part names, each under its least key: names meet other names.
_PARTS = "l as (select p_name as name, min(p_partkey) as id from part group by p_name), r as (select * from l)"


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name")


@query(f"with {_PARTS}, {best_sql(60)} select * from f")
def match_nested_loop_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = part_names(spark, sf_dir)
    return rounded(linkage.nested_loop(n, n, threshold=60, apart=True))


@query(f"with {_PARTS}, {best_sql(60, 5, block=2, least=2)} select * from f")
def match_blocked_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = part_names(spark, sf_dir)
    return rounded(linkage.blocked(n, n, threshold=60, n=5, least=2, apart=True))


@query(f"with l as (select p_partkey as id, p_name as name from part where p_name <> '' order by id limit 1000), r as (select p_name as name, min(p_partkey) as id from part group by p_name), {best_sql(70)} select * from f")
def match_reverse_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,000 register rows by id (a limit that is the feature), each with its best row of all on the other side."""
    first = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).filter("name <> ''").orderBy("id").limit(1000)
    return rounded(linkage.nested_loop(first, part_names(spark, sf_dir), threshold=70, apart=True))


def tfidf_sql(n: int, max_df: float, features: int | None, threshold: float = 0.7, best: int = 1, tag: str = "t") -> str:
    toks = "regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]{2,}')"
    if n == 2:
        toks = f"list_concat({toks}, coalesce(list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1]), []))"
    keep = f"where df <= {max_df} * n" if max_df < 1 else ""
    limit = f"order by total desc, term limit {features}" if features else ""
    return f"""{tag}c as (select 'l' side, id, name from l union all select 'r', id, name from r),
{tag}t as (select side, id, unnest({toks}) term from {tag}c), {tag}n as (select side, id, term, count(*) tf from {tag}t group by all),
{tag}d as (select term, count(*) df, sum(tf) total, (select count(*) from {tag}c) n from {tag}n group by term),
{tag}v as (select * from {tag}d {keep} {limit}),
{tag}w as (select side, id, term, tf * (ln((1 + n)::double / (1 + df)) + 1) w from {tag}n join {tag}v using (term)),
{tag}u as (select *, w / sqrt(sum(w * w) over (partition by side, id)) x from {tag}w),
{tag}s as (select a.id lid, b.id rid, round(sum(a.x * b.x), 6) sc from {tag}u a join {tag}u b on a.term = b.term and a.side = 'l' and b.side = 'r' and a.id <> b.id group by all),
{tag}k as (select *, row_number() over (partition by lid order by sc desc, rid) rk from {tag}s where sc >= {threshold}),
{tag}f as (select lid as left_id, rid as right_id, sc as score, rk::int as rank from {tag}k where rk <= {best})"""


@query(f"with {_NAMES}, {tfidf_sql(1, 1.0, None)} select * from tf")
def match_tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkage.cosine(*names(spark, sf_dir), apart=True))


@query(f"with {_NAMES}, {tfidf_sql(2, 0.95, 10_000)} select * from tf")
def match_tfidf_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(linkage.cosine(*names(spark, sf_dir), grams=2, max_df=0.95, max_features=10_000, apart=True))


@query(f"with {_NAMES} select l.id left_id, r.id right_id from l join r on l.name = r.name union select l.id, r.id from l join r on l.id = r.id")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.exact(*names(spark, sf_dir), keys=[("name", "name"), ("id", "id")])


_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> ''))"
_SAID = f"""select lid, rid, sc from (select *, row_number() over (partition by lid order by sc desc, rid) rk from (
  select c.left_id lid, c.right_id rid, round(len(list_intersect({_WORDS.format("a.name")}, {_WORDS.format("b.name")}))::double / greatest(1, len(list_distinct(list_concat({_WORDS.format("a.name")}, {_WORDS.format("b.name")})))), 4) sc,
    len(list_intersect({_WORDS.format("a.name")}, {_WORDS.format("b.name")}))::double / greatest(1, len(list_distinct(list_concat({_WORDS.format("a.name")}, {_WORDS.format("b.name")})))) raw
  from cf c join l a on a.id = c.left_id join r b on b.id = c.right_id) where raw >= 0.5) where rk = 1"""


@query(f"""with {_NAMES.replace("l as", "al as", 1)},
e as (select al.id lid, min(r.id) rid from al join r on al.name = r.name and al.id <> r.id where al.name <> '' group by 1),
fz as (with l as (select * from al where id not in (select lid from e)), {best_sql(85, block=2)} select left_id lid, right_id rid, score from f),
tz as (with l as (select * from al where id not in (select lid from e union all select lid from fz)), {tfidf_sql(1, 1.0, None)} select left_id lid, right_id rid, score from tf),
mz as (with l as (select * from al where id not in (select lid from e union all select lid from fz union all select lid from tz)), {tfidf_sql(1, 1.0, None, 0.2, 3, "c")} {_SAID})
select lid left_id, rid right_id, 1.0::double score, 100.0::double raw_score, 'exact' as method from e
union all select lid, rid, round(score / 100, 6), score, 'fuzzy' from fz union all select lid, rid, score, score, 'tfidf' from tz union all select lid, rid, sc, sc, 'llm' from mz""")
def match_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linkage.waterfall(*names(spark, sf_dir), apart=True)
    return out.withColumns({"score": F.round("score", 6), "raw_score": F.round("raw_score", 6)})


@query("""with k as (select p_name[1:2 + p_partkey % 3] as key, count(*) n from part group by 1)
select l.key left_key, r.key right_key, l.n * r.n as pairs from k l join k r on starts_with(l.key, r.key) or starts_with(r.key, l.key)""")
def match_prefix_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys with all: equal keys are compared once, with the number of row pairs that they stand for."""
    keys = table(spark, sf_dir, "part").groupBy(F.expr("substring(p_name, 1, int(2 + p_partkey % 3))").alias("key")).agg(F.count("*").alias("id"))
    found = linkage.neighbours(keys, keys)
    return found.select("left_key", "right_key", (F.col("left_id") * F.col("right_id")).alias("pairs"))


_lcs_pairs = "with n as (select distinct p_name from part), p as materialized (select a.p_name a, b.p_name b from n a join n b on a.p_name[1:1] = b.p_name[1:1])"


@query(f"{_lcs_pairs} select a, b, {lcs('a', 'b')}::int as lcs, round({ratio('a', 'b')}, 6) as ratio from p")
def lcs_sql_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The higher-order form and the Arrow form side by side."""
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, F.substring("a.p_name", 1, 1) == F.substring("b.p_name", 1, 1)).select(F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b"))
    return pairs.select("a", "b", similarity.lcs_sql(F.col("a"), F.col("b")).alias("lcs"), F.round(similarity.indel_ratio("a", "b"), 6).alias("ratio"))


# --- cleaning and projections -------------------------------------------------------------------------------------


def dirty_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select(
        k.alias("n"), F.when(k % 7 == 0, F.concat(F.lit(" "), F.lpad(k.cast("string"), 11, "0"))).when(k % 11 == 0, k.cast("string")).otherwise(F.lpad((k - k % 5).cast("string"), 11, "0")).alias("ABN"),
        F.when(k % 13 == 0, "NA").otherwise(F.concat(F.lit("  "), F.col("c_name"))).alias("Entity Name"), F.col("c_mktsegment").alias("Entity Type"),
        F.when(F.col("c_acctbal") > 0, "Active").otherwise("Cancelled").alias("Entity Status"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("Postcode"), F.lit("NSW").alias("State"),
    )
    return rows


@query("""with d as (select c_custkey n, case when n % 7 = 0 then lpad(n::varchar, 11, '0') when n % 11 = 0 then n::varchar else lpad((n - n % 5)::varchar, 11, '0') end abn,
  case when n % 13 = 0 then null else c_name end nm, c_mktsegment et, case when c_acctbal > 0 then 'Active' else 'Cancelled' end es, lpad(c_nationkey::varchar, 4, '0') pc from customer),
k as (select *, row_number() over (partition by abn order by n) rk from d where regexp_full_match(abn, '[0-9]{11}'))
select abn, nm as entity_name, et as entity_type, es as entity_status, '' as address_line1, '' as address_line2, '' as suburb, 'NSW' as state, pc as postcode, '' as start_date from k where rk = 1 and lower(es) = 'active'""")
def clean_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_register(dirty_register(spark, sf_dir), "n", active=("entity_status", "active"))


@query("""with d as (select p_partkey n, case when n % 9 = 0 then null else case when n % 2 = 0 then ' HTTPS://Shop.example/A' else ' HTTPS://Shop.example/a' end || (n % 25) || ' ' end u,
  case when n % 8 = 0 then ' ' when n % 10 = 0 then null else '  ' || p_name || '   o''brien-co 3m' end nm, p_type i from part),
c as (select n, trim(u)[1:500] u, list_aggregate(list_transform(regexp_extract_all(regexp_replace(trim(nm), ' +', ' ', 'g'), '[a-zA-Z]+|[^a-zA-Z]+'), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', '') nm, i from d),
k as (select *, row_number() over (partition by u, nm order by n) rk from c where u is not null and nm is not null and nm <> '')
select u as website_url, nm as company_name, i as industry from k where rk = 1""")
def clean_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(
        n.alias("n"), F.when(n % 9 != 0, F.concat(F.when(n % 2 == 0, " HTTPS://Shop.example/A").otherwise(" HTTPS://Shop.example/a"), n % 25, F.lit(" "))).alias("Website URL"),
        F.when(n % 8 == 0, " ").when(n % 10 != 0, F.concat(F.lit("  "), F.col("p_name"), F.lit("   o'brien-co 3m"))).alias("Company Name"), F.col("p_type").alias("Industry"),
    )
    return clean.clean_web(d, "n")


@query("select c_custkey, trim(case when c_custkey % 2 = 0 then 'NSW' else '' end || ' ' || lpad(c_nationkey::varchar, 4, '0')) as address, 'none' as suburb, c_name as name, substr(c_name, 1, 5) as short from customer")
def project_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite text, a default for an absent column, positional names and truncation."""
    c = table(spark, sf_dir, "customer")
    state = F.when(F.col("c_custkey") % 2 == 0, "NSW").otherwise("")
    address = F.trim(F.concat_ws(" ", state, F.lpad(F.col("c_nationkey").cast("string"), 4, "0")))
    out = c.select("c_custkey", address, text.or_default(c, "suburb", "none"), text.or_default(c, "c_name"), F.substring("c_name", 1, 5))
    return files.positional(out, ["c_custkey", "address", "suburb", "name", "short"])


@query("select p_partkey, upper(p_name) as up, lower(p_brand) as low, length(p_type)::int as len, substr(p_name, 1, 2) as block, regexp_matches(p_brand, '^Brand#[0-9]+$') as full_match, replace(p_type, ' ', '_') as snake, coalesce(nullif(p_type, p_type), 'none') as fallback, starts_with(p_name, 'a') as starts, ends_with(p_name, 'e') as ends, array_to_string(list_sort(string_split(p_name, ' ')), ' ') as sorted from part")
def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, name = table(spark, sf_dir, "part"), F.col("p_name")
    return p.select(
        "p_partkey", F.upper(text.strip(name)).alias("up"), text.name_key(F.col("p_brand")).alias("low"), F.length("p_type").alias("len"), text.block_key(name).alias("block"), F.col("p_brand").rlike("^Brand#[0-9]+$").alias("full_match"),
        F.replace("p_type", F.lit(" "), F.lit("_")).alias("snake"), F.coalesce(F.nullif("p_type", "p_type"), F.lit("none")).alias("fallback"), name.startswith("a").alias("starts"), name.endswith("e").alias("ends"), text.token_sort(name).alias("sorted"),
    )


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') as stamp, 'bytes=' || (o_orderkey * 10) || '-' || (o_orderkey * 10 + 99) as range_header, coalesce(floor(o_totalprice / nullif(o_custkey, 0))::bigint, 0) as per, least(o_orderkey, 100)::bigint as low, 'order ' || o_orderkey || ' of ' || o_orderstatus as label from orders")
def scalar_misc(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("stamp"), web.byte_range(F.col("o_orderkey") * 10, F.lit(100)).alias("range_header"),
        F.coalesce(F.floor(F.try_divide("o_totalprice", "o_custkey")), F.lit(0)).alias("per"), F.least("o_orderkey", F.lit(100)).cast("long").alias("low"), F.format_string("order %d of %s", "o_orderkey", "o_orderstatus").alias("label"),
    )


# --- sources ------------------------------------------------------------------------------------------------------


@query("""select lpad(c_custkey::varchar, 11, '0') abn, case when c_custkey % 3 = 0 then 'Ann ' || replace(c_name, '#', ' ') when c_custkey % 7 = 1 then '' when c_custkey % 7 = 2 then 'Main ' || c_name else c_name end entity_name, c_mktsegment entity_type, 'Active' entity_status,
  case when c_custkey % 2 = 0 then 'VIC ' else 'QLD ' end || lpad(c_nationkey::varchar, 4, '0') address, lpad(c_nationkey::varchar, 4, '0') postcode, case when c_custkey % 2 = 0 then 'VIC' else 'QLD' end state, case when c_custkey % 5 = 0 then '20200101' else '' end start_date from customer where c_custkey % 17 <> 0""")
def xml_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register records as XML text, parsed and mapped to rows; every 17th is cut off and left out."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    post = F.lpad(F.col("c_nationkey").cast("string"), 4, "0")
    person = F.concat(F.lit("<LegalEntity><IndividualName><GivenName>Ann</GivenName><FamilyName>"), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit("</FamilyName></IndividualName></LegalEntity>"))
    firm = F.concat(F.lit("<NonIndividualName><NonIndividualNameText>"), "c_name", F.lit("</NonIndividualNameText></NonIndividualName>"))
    near = F.concat(F.lit("<BusinessAddress><AddressDetails><State>VIC</State><Postcode>"), post, F.lit("</Postcode></AddressDetails></BusinessAddress>"))
    main = F.concat(F.lit("<MainBusinessPhysicalAddress><StateCode>QLD</StateCode><Postcode>"), post, F.lit("</Postcode></MainBusinessPhysicalAddress>"))
    xml = F.concat(
        F.lit('<ABR><ABN status="Active">'), F.lpad(k.cast("string"), 11, "0"), F.lit("</ABN><EntityType><EntityTypeText>"), "c_mktsegment", F.lit("</EntityTypeText></EntityType>"), F.when(k % 3 == 0, person).otherwise(""),
        F.lit("<MainEntity>"), F.when(k % 3 == 0, "").when(k % 7 == 1, "<NonIndividualName><NonIndividualNameText></NonIndividualNameText></NonIndividualName>").when(k % 7 == 2, "").otherwise(firm), F.when(k % 2 == 0, near).otherwise(""), F.lit("</MainEntity>"), F.when(k % 2 == 1, main).otherwise(""), F.when(k % 7 < 3, F.concat(F.lit("<MainName>Main "), "c_name", F.lit("</MainName>"))).otherwise(""),
        F.when(k % 5 == 0, "<ABNStatusFromDate>20200101</ABNStatusFromDate>").otherwise(""), F.lit("</ABR>"),
    )
    xml = F.when(k % 17 == 0, F.substring(xml, 1, 30)).otherwise(xml)
    return register.register_row(c.select(register.parse_record(xml).alias("r")).filter("r.ABN is not null and r.EntityType is not null"), "r.")


@query("select event_id, (json_extract_string(props, '$.k'))::int as k, 'https://a.example/' || event_id as url, (event_id * 7)::varchar as byte_offset from events where event_id % 4 = 0")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines: a quarter are pages, the others another type, no object, or broken."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    line = F.concat(F.lit('{"url": "https://a.example/'), k, F.lit('", "offset": "'), k * 7, F.lit('", "mime": "'), F.when(k % 4 == 0, "text/html").otherwise("image/png"), F.lit('"}'))
    line = F.when(k % 4 == 2, "[1]").when(k % 4 == 3, '{"url": ').otherwise(line)
    rows = e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), web.parse_index(line).alias("r"))
    return rows.filter("r.mime = 'text/html'").select("event_id", "k", F.col("r.url").alias("url"), F.col("r.offset").alias("byte_offset"))


@query("""select c_custkey, case c_custkey % 5 when 2 then 'Firm ' || c_name else c_name end as company_name from customer where c_custkey % 5 not in (1, 3)""")
def warc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members as records: good responses (200, 206), behind another record, a bad status, and no response at all."""
    c, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_name")
    http = lambda status, body: F.concat(F.lit(f"HTTP/1.1 {status}\r\nContent-Type: text/html\r\n\r\n"), body)
    record = lambda kind, block: F.concat(F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))
    page = lambda text: F.concat(F.lit("<html><title>"), text, F.lit("</title></html>"))
    member = (
        F.when(k % 5 == 0, record("response", http("200 OK", page(n))))
        .when(k % 5 == 1, record("response", http("404 Not Found", page(n))))
        .when(k % 5 == 2, F.concat(record("request", F.lit("GET /")), record("response", http("206 Partial", page(F.concat(F.lit("Firm "), n))))))
        .when(k % 5 == 3, record("metadata", n))
        .otherwise(record("response", http("200", page(n))))
    )
    rows = c.select("c_custkey", web.response_html(F.encode(member, "UTF-8")).alias("html")).filter("html is not null")
    return rows.select("c_custkey", web.company_name(F.col("html").cast("string")).alias("company_name"))


_UNESC = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"


@query(f"""with t as (select page_id, nullif({STRIP.format(_UNESC.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')"))}, '') t,
  nullif({STRIP.format(_UNESC.format("regexp_extract(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '^([^<]*)$', 1)"))}, '') h from pages),
n as (select page_id, h, nullif(case when regexp_matches(t, '[-|–—]') then {STRIP.format("string_split_regex(t, '[-|–—]')[-1]")} else t end, '') t from t)
select page_id, t as title_name, h as heading, coalesce(t, h) as company_name from n""")
def html_name_h5_h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, h = table(spark, sf_dir, "pages"), F.col("html")
    return p.select("page_id", web.title_name(h).alias("title_name"), web.heading(h).alias("heading"), F.coalesce(web.title_name(h), web.heading(h)).alias("company_name"))


@query("""select c_custkey, case c_custkey % 6 when 0 then c_name || ' Holdings' when 1 then 'Café ’' || c_name || '’ & Söhne' when 2 then c_name when 3 then 'A ' || c_name || ' B' when 4 then 'Head ' || c_name else c_name || ' é' end as company_name from customer""")
def html_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only a parser settles: elements within the wanted one, all character references, scripts and comments inside, a title
    that ends in its separator."""
    c, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_name")
    tag = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    body = (
        F.when(k % 6 == 0, tag('<div class="logo"><div>', "</div> Holdings</div><div>rest</div>"))
        .when(k % 6 == 1, tag('<span itemprop="name">Caf&eacute; &#8217;', "&#x2019; &amp; S&ouml;hne</span>"))
        .when(k % 6 == 2, tag('<p class="brand company-name"><!-- x --><script>var a = "</p>";</script><br><b>', "</b></p>"))
        .when(k % 6 == 3, tag('<div class=logo><img src="x.png">A <span>', "</span> <i>B</i></div>"))
        .when(k % 6 == 4, tag("<h1><b>Head ", "</b></h1>"))
        .otherwise(tag("<ul><li class='logo'>", " &eacute;<ul></ul></li><li>next</li></ul>"))
    )
    html = F.concat(F.when(k % 6 == 4, "<title>Shop -</title>").otherwise("<title>Other</title>"), body)
    return c.select("c_custkey", html.alias("h")).select("c_custkey", web.company_name(F.col("h")).alias("company_name"))


@query("""with r as (select event_id, 'crawl-' || (event_id % 3) as filename, event_id * 11 as off, case when event_id % 5 = 0 then 'shop.example.au' else 'shop.example.com' end host from events where event_id % 2 = 0)
select 'https://' || host || '/p/' || event_id as url, filename, off as byte_offset from r where host like '%.au' order by filename, off, url limit 40 offset 10""")
def index_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines in files, read again: a host pattern, and the second to fifth page of ten records."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    host = F.when(k % 5 == 0, "shop.example.au").otherwise("shop.example.com")
    line = F.format_string('{"url": "https://%s/p/%d", "filename": "crawl-%d", "offset": "%d", "length": "9", "mime": "%s"}', host, k, k % 3, k * 11, F.when(k % 2 == 0, "text/html").otherwise("image/png"))
    path = f"{files.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    e.select(line.alias("value")).write.text(path)
    return files.settled_without(web.read_index(spark, path, "*.au", limit=40, offset=10).select("url", "filename", F.col("offset").cast("long").alias("byte_offset")), path)


@query("select c_custkey, c_name as company_name, c_mktsegment as industry from customer")
def html_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names behind each rule in turn, with decoys for the later rules."""
    c, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_name")
    tag = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    body = (
        F.when(k % 7 == 0, tag('<meta content="', "\" property='og:site_name'>"))
        .when(k % 7 == 1, tag('<script type="application/ld+json">{"@type": "Organization", "name": "', '"}</script>'))
        .when(k % 7 == 2, tag('<script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type": "Person", "name": "x"}, {"@type": "Organization", "name": "', '"}]</script>'))
        .when(k % 7 == 3, tag('<span itemprop="name"><b>', "</b></span>"))
        .when(k % 7 == 4, tag('<div class="big logo">', '</div><div class="brand">other</div>'))
        .when(k % 7 == 5, tag('<p class="company-name">', '</p><p class="logo">other</p>'))
        .otherwise(tag("<h1>", "</h1>"))
    )
    title = F.when(k % 7 == 6, "<title></title>").otherwise("<title>Buy - Other</title>")
    html = F.concat(F.lit("<html><head>"), title, F.lit("<meta name='keywords' content='"), "c_mktsegment", F.lit("'></head><body>"), body, F.lit("</body></html>"))
    return c.select("c_custkey", html.alias("h")).select("c_custkey", web.company_name(F.col("h")).alias("company_name"), web.industry(F.col("h")).alias("industry"))


@query("select lpad(n_nationkey::varchar, 4, '0') as code, case when n_nationkey = 3 then null else n_name || ', \"x\"' || chr(10) || 'y' end as name, r_name as region from nation join region on n_regionkey = r_regionkey")
def csv_scan_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as delimited text and read again: leading zeros, quotes, line breaks and missing values survive."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("code"), F.when(F.col("n_nationkey") == 3, "NA").otherwise(F.concat("n_name", F.lit(', "x"\ny'))).alias("name"), F.col("r_name").alias("region"))
    path = f"{files.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_delimited(rows, path)
    return files.settled_without(files.read_delimited(spark, path, "code string, name string, region string", multi_line=True), path)


@query("select n_nationkey as k, n_name as name from nation order by n_nationkey limit 7 offset 5")
def row_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 5 up to 12 of a delimited file with inferred types, renamed by position; a range under other columns has none."""
    path = f"{files.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_delimited(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").coalesce(1), path)
    scan = files.read_delimited(spark, path, None)
    none = files.row_range(scan, 0, 3, ["k", "name", "more"]).select(F.col("k").cast("int").alias("k"), "name")
    return files.settled_without(files.row_range(scan, 5, 12, ["k", "name"]).select(F.col("k").cast("int").alias("k"), "name").union(none), path)


@query("select n_regionkey, count(*) as n from nation group by 1 union all select -1, count(*) from nation")
def load_and_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files loaded into a catalog table, with the number of rows loaded, and scanned again."""
    path, name = f"{files.shared_folder(spark)}/csv-{uuid.uuid4().hex}", f"load_{uuid.uuid4().hex}"
    files.write_delimited(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), path)
    rows = files.load(spark, path, "n_nationkey int, n_regionkey int", name)
    out = files.settle(catalog.scan(spark, name).groupBy("n_regionkey").agg(F.count("*").alias("n")))
    spark.sql(f"drop table {name}")
    files.remove(spark, path)
    return out.select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "n").union(spark.createDataFrame([(-1, rows)], "n_regionkey int, n long"))


# --- distinct, counts, order, set operations ----------------------------------------------------------------------


@query("with k as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_quantity, l_partkey) rk from lineitem) select l_suppkey, l_orderkey, l_linenumber, l_quantity from k where rk = 1")
def dedup_keep_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey"]).drop("l_partkey")


@query("with k as (select *, row_number() over (partition by conv_id, role order by turn) rk from conversations) select conv_id, role, turn, text from k where rk = 1")
def dedup_keep_first_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], ["turn"])


@query("""with m as (select 'fuzzy' as method, 1 as o, p_name as a, p_brand as b from part where p_size < 20 union all select 'tfidf', 2, p_name, p_brand from part where p_size >= 10),
k as (select *, row_number() over (partition by a, b order by o) rk from m) select a as cc_company, b as abr_company, method from k where rk = 1""")
def dedup_keep_first_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_size", F.col("p_name").alias("cc_company"), F.col("p_brand").alias("abr_company"))
    both = p.filter("p_size < 20").withColumn("method", F.lit("fuzzy")).unionByName(p.filter("p_size >= 10").withColumn("method", F.lit("tfidf")))
    return dedup.keep_first(both.drop("p_size"), ["cc_company", "abr_company"], [F.when(F.col("method") == "fuzzy", 1).otherwise(2)])


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("""with a as (select p_name[1:2] block, count(*) n from part group by 1), b as (select lower(c_name[1:2]) block, count(*) n from customer group by 1),
u as (select block from a union select block from b) select block, coalesce(a.n, 0)::bigint as left_rows, coalesce(b.n, 0)::bigint as right_rows, (a.n is not null and b.n is not null) as both from u left join a using (block) left join b using (block) order by block""")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").groupBy(text.block_key(F.col("p_name")).alias("block")).agg(F.count("*").alias("a"))
    b = table(spark, sf_dir, "customer").groupBy(text.block_key(text.name_key(F.col("c_name"))).alias("block")).agg(F.count("*").alias("b"))
    both = a.join(b, "block", "full_outer")
    return both.select("block", F.coalesce("a", F.lit(0)).alias("left_rows"), F.coalesce("b", F.lit(0)).alias("right_rows"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both")).orderBy("block")


@query("with b as (select l_suppkey % 10 as batch, count(*) n, sum(l_quantity) q from lineitem group by 1) select sum(n)::bigint as n_rows, round(sum(q) / sum(n), 6) as mean_quantity, count(*)::bigint as batches, max(n)::bigint as largest from b")
def count_avg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("batch")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return b.agg(F.sum("n").alias("n_rows"), F.round(F.sum("q") / F.sum("n"), 6).alias("mean_quantity"), F.count("*").alias("batches"), F.max("n").alias("largest"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 50")
def sort_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(100)


@query("select 1 as id")
def model_ref_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Models(spark)
    m.add("first_model", "select 1 as id union all select null as id")
    m.add("second_model", "select * from {{ ref('first_model') }} where id = 1")
    return m.build("second_model")


@query("select * from (select n_name as name, 'nation' as kind from nation union all select r_name, 'region' from region)")
def union_all_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return n.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


# --- upserts ------------------------------------------------------------------------------------------------------


#: Customers with an even key are in the target, those whose key leaves 1 or 2 by 3 are staged: every row is in one or both.
def _upsert_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged keys come twice with different values; the later arrival counts, whatever its value."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    row = lambda industry: (F.concat(F.lit("u"), k).alias("website_url"), F.when(k % 12 != 0, F.col("c_name")).alias("company_name"), industry.alias("industry"))
    target = c.filter((k % 2 == 0) | (k % 3 == 0)).select(*row(F.col("c_mktsegment")))
    staged = c.filter(k % 3 != 0)
    late = F.when(k % 9 == 1, "A NEW ONE").when(k % 9 == 2, "ZZ NEW").otherwise(F.col("c_mktsegment"))
    stage = staged.select(*row(late), F.lit(2).alias("arrival")).union(staged.select(*row(F.lit("ZZZ FIRST")), F.lit(1).alias("arrival")))
    return upsert.classify(target, stage, upsert.WEB)


_WEB_SQL = """with t as (select 'u' || c_custkey u, case when c_custkey % 12 <> 0 then c_name end n, c_mktsegment i from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0),
s2 as (select c_custkey k, case when c_custkey % 9 = 1 then 'A NEW ONE' when c_custkey % 9 = 2 then 'ZZ NEW' else c_mktsegment end i, 2 a, c_name from customer where c_custkey % 3 <> 0 union all select c_custkey, 'ZZZ FIRST', 1, c_name from customer where c_custkey % 3 <> 0),
s as (select 'u' || k u, case when k % 12 <> 0 then c_name end n, arg_max(i, a) i from s2 group by all),
j as (select coalesce(t.u, s.u) u, coalesce(t.n, s.n) n, case when t.u is null then 'INSERT' when s.u is null then 'KEEP' when t.i is distinct from s.i then 'UPDATE' else 'NOOP' end a, t.i ti, s.i si
  from t full join s on t.u is not distinct from s.u and t.n is not distinct from s.n)"""


@query(f"{_WEB_SQL} select u as website_url, n as company_name, case when a in ('INSERT', 'UPDATE') then si else ti end as industry, a as action from j")
def upsert_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert_web(spark, sf_dir)


@query(f"{_WEB_SQL} select a as action, count(*) as n from j group by 1")
def upsert_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.accounting(_upsert_web(spark, sf_dir))


@query("""with t as (select c_custkey k, c_name n, c_mktsegment y, '' a2, 'NSW' st, timestamp '2020-01-01' ca, timestamp '2020-01-01' ua from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0),
s as (select c_custkey k, c_name || '!' n, case when c_custkey % 9 = 1 then 'X' else c_mktsegment end y, 'line' a2, 'NSW' st from customer where c_custkey % 3 <> 0),
j as (select coalesce(t.k, s.k) k, case when t.k is null then 'INSERT' when s.k is null then 'KEEP' when t.y is distinct from s.y then 'UPDATE' else 'NOOP' end a, t.n tn, s.n sn, t.y ty, s.y sy, t.a2 ta, s.a2 sa from t full join s on t.k = s.k)
select lpad(k::varchar, 11, '0') abn, case when a = 'INSERT' then sn else tn end entity_name, case when a in ('INSERT', 'UPDATE') then sy else ty end entity_type, 'Active' entity_status, '' address_line1,
  case when a in ('INSERT', 'UPDATE') then sa else ta end address_line2, '' suburb, 'NSW' as state, '2000' postcode, '' start_date,
  case when a = 'INSERT' then '2024-05-06 07:08:09' else '2020-01-01 00:00:00' end created, case when a in ('INSERT', 'UPDATE') then '2024-05-06 07:08:09' else '2020-01-01 00:00:00' end updated, a as action from j""")
def upsert_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed name alone, or a changed second address line alone, is no change; the name is never set by an update, the
    time of change always."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    row = lambda name, kind, line: c.select(F.lpad(k.cast("string"), 11, "0").alias("abn"), name.alias("entity_name"), kind.alias("entity_type"), F.lit("Active").alias("entity_status"), F.lit("").alias("address_line1"), line.alias("address_line2"), F.lit("").alias("suburb"), F.lit("NSW").alias("state"), F.lit("2000").alias("postcode"), F.lit("").alias("start_date"), k)
    begun = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
    target = row(F.col("c_name"), F.col("c_mktsegment"), F.lit("")).filter((k % 2 == 0) | (k % 3 == 0)).drop("c_custkey").withColumns({"created_at": begun, "updated_at": begun})
    stage = row(F.concat("c_name", F.lit("!")), F.when(k % 9 == 1, "X").otherwise(F.col("c_mktsegment")), F.lit("line")).filter(k % 3 != 0).drop("c_custkey")
    out = upsert.classify(target, stage, upsert.REGISTER, now=F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    text_of = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.withColumns({"created": text_of("created_at"), "updated": text_of("updated_at")}).drop("created_at", "updated_at")


@query("""with t as (select c_custkey k, c_name n, c_mktsegment i, (50 + c_custkey % 40)::double s from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0),
s as (select c_custkey k, c_name n, case when c_custkey % 7 = 1 then null else c_mktsegment end i, (50 + c_custkey % 60)::double s from customer where c_custkey % 3 <> 0),
j as (select coalesce(t.k, s.k) k, coalesce(t.n, s.n) n, case when t.k is null then 'INSERT' when s.k is null then 'KEEP' when t.s < s.s or t.i is distinct from s.i then 'UPDATE' else 'NOOP' end a, t.s ts, s.s ss, t.i ti, s.i si from t full join s on t.k = s.k),
f as (select *, a in ('INSERT', 'UPDATE') new from j)
select k::varchar abn, null::varchar url, n as company_name, n as abr_company, case when new then si else ti end as industry, 'P' entity_type, 'A' entity_status, case when new then 'new' else 'old' end address, case when new then '3000' else '2000' end postcode,
  case when new then 'VIC' else 'NSW' end as state, case when new then date '2021-01-01' else date '2020-01-01' end start_date, case when new then ss else ts end match_confidence, case when new then 'c2' else 'c1' end source_commoncrawl_id, case when new then 'a2' else 'a1' end source_abr_id, a as action from f""")
def upsert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update sets all columns but the key, also where the confidence alone has risen."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")

    def rows(industry, score, v):
        fixed = {"address": ("old", "new"), "postcode": ("2000", "3000"), "state": ("NSW", "VIC"), "start_date": ("2020-01-01", "2021-01-01"), "source_commoncrawl_id": ("c1", "c2"), "source_abr_id": ("a1", "a2")}
        out = c.select(k.cast("string").alias("abn"), F.lit(None).cast("string").alias("url"), F.col("c_name").alias("company_name"), F.col("c_name").alias("abr_company"), industry.alias("industry"), F.lit("P").alias("entity_type"), F.lit("A").alias("entity_status"), score.cast("double").alias("match_confidence"), k)
        return out.withColumns({n: F.lit(x[v]).cast("date") if n == "start_date" else F.lit(x[v]) for n, x in fixed.items()})

    seg = F.col("c_mktsegment")
    target = rows(seg, 50 + k % 40, 0).filter((k % 2 == 0) | (k % 3 == 0)).drop("c_custkey")
    return upsert.classify(target, rows(F.when(k % 7 != 1, seg), 50 + k % 60, 1).filter(k % 3 != 0).drop("c_custkey"), upsert.MATCHES)


_RECORD = """l as (select min(p_partkey) id, p_name as name from part group by p_name),
r as (select row_number() over (order by s) id, s as name from (select distinct (string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1]) || case when length(p_name) % 2 = 0 then 's' else '' end s from part))"""


@query(f"""with {_RECORD}, {best_sql(85).replace("and x.id <> y.id", "")}
select lpad((1000 + y.id)::varchar, 11, '0') abn, 'u' || x.id url, x.name company_name, y.name abr_company, 'tools' industry, 'PRV' entity_type, 'ACT' entity_status, 'NSW 2000' address, '2000' postcode, 'NSW' as state,
  date '2020-02-03' start_date, score match_confidence, x.id::varchar source_commoncrawl_id, ('r' || y.id) source_abr_id from f join l x on x.id = left_id join r y on y.id = right_id""")
def match_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 columns of match records: part names as web rows, their words the other way round (some with a letter more) as the
    register."""
    part = table(spark, sf_dir, "part")
    web_rows = part_names(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("u"), "id").alias("website_url"), F.col("name").alias("company_name"), F.lit("tools").alias("industry"))
    w = F.split("p_name", " ")
    turned = part.select(F.concat(w[1], F.lit(" "), w[0], F.when(F.length("p_name") % 2 == 0, "s").otherwise("")).alias("s")).distinct()
    n = F.row_number().over(Window.orderBy("s"))
    register_rows = turned.withColumn("n", n).select(
        F.concat(F.lit("r"), "n").alias("id"), F.lpad((F.lit(1000) + F.col("n")).cast("string"), 11, "0").alias("abn"), F.col("s").alias("entity_name"), F.lit("PRV").alias("entity_type"), F.lit("ACT").alias("entity_status"),
        F.lit("NSW").alias("state"), F.lit("2000").alias("postcode"), F.lit("20200203").alias("start_date"),
    )
    out = company.match_rows(web_rows, register_rows, 85, block=0)
    return out.withColumn("match_confidence", F.round("match_confidence", 6))


# --- quality ------------------------------------------------------------------------------------------------------

_DIRTY = "with d as (select case when c_custkey % 10 = 0 then null else c_custkey - c_custkey % 4 end abn, case when c_custkey % 15 = 0 then null else c_name end entity_name, case when c_custkey % 6 = 0 then null else '2000' end postcode from customer)"


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.when(k % 10 != 0, k - k % 4).alias("abn"), F.when(k % 15 != 0, F.col("c_name")).alias("entity_name"), F.when(k % 6 != 0, "2000").alias("postcode"))


@query(f"{_DIRTY} select abn as value, count(*) as n from d where abn is not null group by 1 having count(*) > 1")
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(_checked(spark, sf_dir), "abn")


@query(f"{_DIRTY} select 'abn' as column_name, count(*) filter (abn is null) as failures from d union all select 'entity_name', count(*) filter (entity_name is null) from d union all select 'postcode', count(*) filter (postcode is null) from d")
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing(_checked(spark, sf_dir), ["abn", "entity_name", "postcode"])


@query(f"""{_DIRTY}, w as (select *, date '2024-03-31' - (abn % 60)::int as seen, 70 + coalesce(abn, 0) % 31 as conf from d),
m as (select 'completeness' metric_name, (100.0 * count(*) filter (abn is not null and trim(entity_name) <> '' and postcode is not null) / count(*))::decimal(10,2) metric_value, 90::decimal(10,2) threshold_value from w
union all select 'accuracy', (100.0 * count(*) filter (conf >= 85) / count(*))::decimal(10,2), 80::decimal(10,2) from w
union all select 'consistency', (100.0 * count(*) filter (abn is null or regexp_full_match(abn::varchar, '[0-9]{{1,3}}')) / count(*))::decimal(10,2), 95::decimal(10,2) from w
union all select 'timeliness', (100.0 * count(*) filter (date '2024-04-01' - seen <= 30) / count(*))::decimal(10,2), 90::decimal(10,2) from w)
select 'run-1' as pipeline_run_id, metric_name, metric_value::double as metric_value, threshold_value::double as threshold_value, case when metric_value >= threshold_value then 'pass' else 'fail' end as status from m""")
def dq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, accuracy, consistency and timeliness of one run."""
    abn = F.col("abn")
    rows = _checked(spark, sf_dir).withColumns({"seen": F.date_sub(F.to_date(F.lit("2024-03-31")), (abn % 60).cast("int")), "conf": F.lit(70) + F.coalesce(abn, F.lit(0)) % 31})
    measures = quality.company_measures(["abn", "entity_name", "postcode"], {"abn": "^[0-9]{1,3}$"}, confidence="conf", stamp="seen", now=F.to_date(F.lit("2024-04-01")))
    out = quality.metrics(rows, measures, run_id="run-1")
    return out.withColumns({c: F.col(c).cast("double") for c in ("metric_value", "threshold_value")})


@query("""with d as (select case when page_id % 10 = 0 then null else url end u, case when page_id % 15 = 0 then null else page_id end n from pages),
c as (select 'website_url' as column_name, count(*) filter (u is null) as failures from d union all select 'company_name', count(*) filter (n is null) from d)
select column_name, 'not_null' as test, failures from c union all select 'website_url', 'unique', (select count(*) from (select u from d where u is not null group by u having count(*) > 1))""")
def dq_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register's checks on the keys of the web side."""
    k = F.col("page_id")
    d = table(spark, sf_dir, "pages").select(F.when(k % 10 != 0, F.col("url")).alias("website_url"), F.when(k % 15 != 0, k).alias("company_name"))
    empty = quality.missing(d, ["website_url", "company_name"]).select("column_name", F.lit("not_null").alias("test"), "failures")
    return empty.union(quality.duplicates(d, "website_url").agg(F.count("*").alias("failures")).select(F.lit("website_url"), F.lit("unique"), "failures"))


@query("select o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where (l_partkey, l_suppkey) not in (select l_partkey, l_suppkey from lineitem where l_quantity >= 10)")
def fk_orphans_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose pair of keys isn't in the parent."""
    lines = table(spark, sf_dir, "lineitem")
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    parent = lines.filter("l_quantity >= 10").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return quality.orphans(rows, parent, [("l_partkey", "part"), ("l_suppkey", "supp")]).select("o_orderkey", "l_linenumber")


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 5 <> 0)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")
    return quality.orphans(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parent, [("o_custkey", "c_custkey")])


# --- unified table and classification -----------------------------------------------------------------------------


@query("""with m as (select 'a' || (c_custkey % 400) abn, c_name n, 'u' || c_custkey u, c_mktsegment i, c_nationkey % 3 st, (c_custkey % 7) / 10.0::double sc, 'src' || (c_custkey % 2) src from customer),
k as (select *, row_number() over (partition by abn order by sc desc, n desc, u desc) rk from m), g as (select abn, string_agg(distinct src, ',' order by src) srcs from m group by 1)
select n as unified_name, abn as primary_abn, u as website_url, i as industry, 'S' || st as state, round(sc, 3) as confidence_score, srcs as data_sources from k join g using (abn) where rk = 1""")
def unified_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("a"), k % 400).alias("abn"), F.col("c_name").alias("company_name"), F.concat(F.lit("u"), k).alias("website_url"), F.col("c_mktsegment").alias("industry"), F.lit("P").alias("entity_type"), F.lit("A").alias("entity_status"),
        F.concat(F.lit("S"), F.col("c_nationkey") % 3).alias("state"), F.lit("2000").alias("postcode"), ((k % 7) / 10.0).alias("score"), F.concat(F.lit("src"), k % 2).alias("data_source"),
    )
    out = unify.unified_companies(m)
    return out.select("unified_name", "primary_abn", "website_url", "industry", F.col("address.state").alias("state"), F.col("confidence_score").cast("double").alias("confidence_score"), F.array_join("data_sources", ",").alias("data_sources"))


@query("""with p as (select c_custkey k, 'acme ' || c_mktsegment a, case when c_custkey % 2 = 0 then c_mktsegment || ' ACME' else 'other firm' end b from customer)
select k as c_custkey, (k % 2 = 0) as is_match, case when k % 2 = 0 then 1.0::double else 0.0::double end as confidence, case when k % 2 = 0 then a end as unified_name from p""")
def llm_stub_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    pairs = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("acme "), seg).alias("a"), F.when(k % 2 == 0, F.concat(seg, F.lit(" ACME"))).otherwise("other firm").alias("b"))
    r = classify.ask(pairs, "a", "b").select("c_custkey", classify.parse(F.col("answer")).alias("r"))
    return r.select("c_custkey", "r.is_match", "r.confidence", "r.unified_name")
