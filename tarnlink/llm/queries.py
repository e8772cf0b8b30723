"""The registered query of each operator: whole tables, production parameters, digest columns."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac, langid, mixing, nbest, ngram_join, pivots, secrets, sharding, token_rollup, toxicity
from .common import held_out, remove, settle, shared_dir, table

#: Public tokenizer files; every executor has them at this path.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
RANKS, PIECES = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/piece_bpe_32k.model"


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights from the quality labels: 2 for good documents, a half for bad ones."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return labels.filter("q is not null").select("doc_id", F.when(F.col("q") >= 1, 2.0).otherwise(0.5).alias("weight"))


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), quality=quality(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = flac.add_media(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return flac.features(media, ["doc_id", "n_bytes"])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    out = toxicity.score(docs, index, ["doc_id"])
    shown = F.transform("evidence", lambda e: F.concat_ws(":", e["example"], e["toxic"].cast("string"), F.format_number(e["similarity"], 4)))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.array_join(shown, ",").alias("evidence"))


def op8_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out("doc_id"))
    out = langid.predict(docs, model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "similarity", "rejected")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that sees every kind of change: all documents arrive with an estimate of their tokens, are revised to their
    counts, a tenth of them is deleted and comes back. Each batch is committed twice, as by a retry, and the batches are
    folded into one half-way. The totals are those of the table as it is."""
    shared_dir(spark)
    store = token_rollup.Store(spark, f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid.uuid4().hex}")
    count = token_rollup.token_counter(RANKS)
    guess = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long")
    docs = settle(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", count("text").alias("tokens"), guess.alias("guess")))
    leaves = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    tokens = F.col("tokens")
    for name, rows, op, now, old in (
        ("arrived", docs, "insert", F.col("guess"), None), ("counted", docs, "revise", tokens, F.col("guess")),
        ("deleted", leaves, "delete", tokens, None), ("returned", leaves, "insert", tokens, None),
    ):
        change = token_rollup.deltas(rows, "byte_bpe_50k", op=F.lit(op), tokens=now, old=old)
        for _ in range(2):
            store.commit(name, change)
        if name == "deleted":
            store.compact()
    out = settle(store.totals())
    remove(spark, store.folder)
    return out


def op9_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode(table(spark, sf_dir, "documents"), PIECES, ["doc_id"], digest=True)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    said = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"] != "novel")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"),
    )


QUERIES = {f.__name__: f for f in (op1_flac_media, op2_ngram_join, op3_pivot_index, op4_mix_sources, op5_shard_histogram, op6_toxicity, op7_token_rollup, op8_language_centroids, op9_nbest_pieces, op10_secret_scan)}

ORACLE: dict[str, str] = {
    "op4_mix_sources": """
with q as (select doc_id, max(quality) q from labels group by doc_id),
d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, md5(coalesce(text, ''))) || 'mix'), 1, 13))::bigint + 0.5::double) / 4503599627370496)
      / (case when q is null then 1.0::double when q >= 1 then 2.0::double else 0.5::double end) k
  from documents left join q using (doc_id)),
s as (select source, sum(size)::bigint ss, row_number() over (order by source nulls last) - 1 i from d group by source),
w as (select *, [3.0, 1.0, 2.0][i % 3 + 1]::double w, 2.0::double * ss cap, 1.5::double * sum(ss) over () tot from s),
l as (select *, (tot - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) lev
  from w window b as (order by cap / w, i rows between unbounded preceding and 1 preceding)),
t as (select source, ss, case when cap / w <= lev then cap else w * max(case when cap / w > lev then lev end) over () end target from l),
e as (select d.*, ss, target, case when ss > 0 then floor(target / ss) else 0 end::bigint e,
  coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint bf
  from d join t on d.source is not distinct from t.source)
select doc_id, size, ss as source_size, target,
  (e * size + greatest(0, least(size, round(target - e * ss)::bigint - bf)))::bigint as taken from e""",
    "op2_ngram_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
b as (select x, y from e union all select y, x from e),
r as (select x, y from b union select r.x, b.y from r join b on r.y = b.x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join (select x, min(y) m from r group by 1) c on c.x = d.doc_id""",
    "op3_pivot_index": """
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id x, b.vec_id y from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select x, y from p union select r.x, p.y from r join p on r.y = p.x),
c as (select x, min(y) m from r group by 1), k as (select x, count(*) k from p group by 1)
select vec_id, coalesce(k, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(m, vec_id)) as kept
from embeddings left join c on c.x = vec_id left join k on k.x = vec_id""",
}
