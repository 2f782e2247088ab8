"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from propensia.llm import bpe, compact_windows, hard_negatives, interpolation, lexical, license_scan, minhash, packing, suffix_dedup, surrogates, warc, weak_rules, winnowing

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MINHASH_SQL = r"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as materialized (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [ws]
    else list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) end) as sh
  from w
), n as materialized (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
e as materialized (
  select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)
), arcs as materialized (select a, b from e union all select b, a from e),
reach as (
  select distinct a as root, a as node from arcs
  union
  select r.root, arcs.b from reach r join arcs on arcs.a = r.node
), comp as (select root, min(node) as component from reach group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component, w.doc_id) as component_id,
  coalesce(component, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join comp on root = w.doc_id
"""


@query("op10_minhash_near_dedup", MINHASH_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


WINNOW_SQL = r"""
with d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as materialized (
  select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), bw as materialized (
  select distinct item_id, least(len(ws), 13) as k, unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2), lambda i: ws[i:i + least(len(ws), 13) - 1])) as win
  from b where len(ws) > 0
), dw as materialized (
  select r, k, unnest(range(1, len(ws) - k + 2)) as i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) as win
  from d, (select distinct k from bw) where len(ws) >= k
), m as materialized (select distinct dw.r, dw.i, dw.k, bw.item_id from dw join bw on dw.win = bw.win),
h as (select r, count(distinct i + o.o) as n_hit from m, range(0, 13) o(o) where o.o < m.k group by 1),
t as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from m) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h using (r) left join t using (r)
"""


@query("op8_winnowing_decontamination", WINNOW_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@query("op7_weak_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.assess(table(spark, sf_dir, "documents")).drop("votes", "p_good")


VOCABULARY = "word_bpe_49k.json"


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


#: a deployment passes its own secret; the queries' surrogates must only be repeatable
DEMO_KEY = b"surrogates of the registered query"


@query("op9_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_private(table(spark, sf_dir, "documents"), DEMO_KEY)


WARC_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p group by 1)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from p join f using (d)
"""


@query("op1_warc_round_trip", WARC_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri", "record_id", "refers_to_id", "path")


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents")).drop("spans")


@query("op2_deleted_interpolation")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


@query("op5_license_scans")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op4_compact_window_passages")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_bpe_round_trip")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, packed=True, keep=["doc_id"])
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


NEGATIVES_SQL = """
with raw as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, embedding from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from raw),
s as materialized (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as materialized (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::integer as rank,
  id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 5
"""


@query("op12_threshold_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(hard_negatives.quantised(vectors.withColumn("label", moved)), F.col("id") % 100 == 0)


LEXICAL_SQL = r"""
with d as materialized (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), s as (select count(*) filter (len(ws) > 0) as big_n, sum(len(ws))::bigint as big_l from d),
t as materialized (select doc_id, r, len(ws)::bigint as n, unnest(ws) as term from d),
tf as materialized (select doc_id, r, n, term, count(*) as tf from t group by all),
df as (select term, count(*) as df from tf group by 1),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), w as materialized (select item_id, term, floor(1000 * ln((2.0::double * big_n + 2) / (2 * df + 1)))::bigint as w from q join df using (term), s),
x as (
  select item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::bigint as score
  from w join tf using (term), s group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from x where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""


@query("op13_ranked_lexical_search", LEXICAL_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
