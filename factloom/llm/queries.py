"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import minhash, mixing, pii, reputation, sentencepiece_codec, sharding, topk, toxicity, vectors, warc
from factloom.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_string(F.col("base")), 256).alias("base_sha256"), pii.span_string(F.col("spans")).alias("spans"))


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return reputation.judge(table(spark, sf_dir, "pages"), labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), "page_id")
    return made.select("page_id", "type", "record_id", "refers_to", "target_uri", F.element_at("headers", "WARC-Block-Digest").alias("block_digest"), F.octet_length("block").alias("n_bytes"), F.col("block").cast("string").alias("content"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


SQL: dict[str, str] = {}


def _weight_sql(level: str) -> str:
    cases = "".join(f" when {level} = '{k}' then {w}" for k, w in mixing.WEIGHTS[level].items())
    return f"case{cases} else 1 end" if cases else "1"


def _fill_sql(name: str, level: str, keys: str, parent: str) -> str:
    over = f"partition by {parent}" if parent else ""
    budget = f"from n_{name} join b_{name} using ({parent})" if parent else f"from n_{name}, b_{name}"
    return f"""
n_{name} as (select {keys}, sum(tokens)::hugeint * 4 as cap from leaves group by {keys}),
w_{name} as (select *, {_weight_sql(level)} as w {budget}),
s_{name} as (select *, sum(cap) over o - cap as before, sum(w) over ({over}) - sum(w) over o + w as remaining from w_{name} window o as ({over} order by cap / w, {level})),
f_{name} as (select *, cap * remaining <= w * (budget - before) as is_full from s_{name}),
g_{name} as (select *, budget - coalesce(sum(case when is_full then cap end) over ({over}), 0) as excess, sum(case when not is_full then w end) over ({over}) as open_w from f_{name}),
h_{name} as (select *, case when is_full then cap else (w * excess) // open_w end as share from g_{name}),
i_{name} as (select *, budget - sum(share) over ({over}) as leftover, sum(case when not is_full then 1 end) over ({over} order by cap / w, {level}) as nth from h_{name}),
r_{name} as (select {keys}, (case when not is_full and nth <= leftover then share + 1 else share end)::hugeint as budget from i_{name})"""


def _mixing_sql() -> str:
    domain = "'forum'"
    for name, members in mixing.DOMAINS.items():
        domain = f"case when source in ({', '.join(repr(m) for m in members)}) then '{name}' else {domain} end"
    return f"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
rows_ as (select doc_id, {domain} as domain, lang, source, n_tokens from d),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from rows_ group by all),
b_domain as (select (sum(tokens)::hugeint // 2) as budget from leaves),{_fill_sql("domain", "domain", "domain", "")},
b_lang as (select * from r_domain),{_fill_sql("lang", "lang", "domain, lang", "domain")},
b_source as (select * from r_lang),{_fill_sql("source", "source", "domain, lang, source", "domain, lang")},
plan as (select *, coalesce((budget // nullif(tokens, 0))::bigint, 0) as whole, (budget - coalesce((budget // nullif(tokens, 0))::bigint, 0) * tokens)::bigint as rest from leaves join r_source using (domain, lang, source)),
drawn as (select rows_.*, whole, rest, md5('17:' || whole || ':' || coalesce(doc_id::varchar, '')) as draw from rows_ join plan using (domain, lang, source)),
upto as (select *, sum(n_tokens) over (partition by domain, lang, source order by draw, doc_id, n_tokens rows unbounded preceding) as u from drawn)
select doc_id, domain, lang, source, n_tokens, (whole + case when rest > 0 and u <= rest then 1 else 0 end)::bigint as repeats from upto"""


SQL["op2_source_mixing"] = _mixing_sql()

SQL["op3_near_duplicates"] = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
links as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
sym as (select a, b from links union all select b, a from links),
reach(id, c) as (select a, a from sym union select reach.id, sym.b from reach join sym on sym.a = reach.c),
comp as (select id, min(c) as c from reach group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.c, d.doc_id) as component_id, coalesce(comp.c, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join comp on comp.id = d.doc_id"""


SQL["op4_near_vectors"] = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
sym as (select a, b from links union all select b, a from links),
reach(id, c) as (select a, a from sym union select reach.id, sym.b from reach join sym on sym.a = reach.c),
comp as (select id, min(c) as c from reach group by id),
deg as (select a as id, count(*) as n from sym group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings left join comp on comp.id = vec_id left join deg on deg.id = vec_id"""

SQL["op5_exact_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.e, d.e)::bigint as score from v q join v d on q.vec_id <> d.vec_id and len(q.e) = len(d.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


def _strength_sql(units: str, mean: str) -> str:
    between = "(q - v * (j - 1) / j) / nullif(t - t2 / t, 0)"
    return f"""select round(greatest(1.0, least(1e4, case when {between} > 0 then a / ({between}) - 1 when {between} <= 0 then 1e4 else 1.0 end)), 6) as s
from (select sum(n * pow(k / n - {mean}, 2)) as q, sum({mean} * (1 - {mean})) as v, sum(n)::double as t, sum(n::double * n) as t2, avg({mean} * (1 - {mean})) as a, count(*)::double as j from {units} where n > 0)"""


SQL["op8_url_reputation"] = f"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '{reputation.PATTERN}', 1), '{reputation.UPPER}', '{reputation.LOWER}') as host, regexp_extract(coalesce(url, ''), '{reputation.PATTERN}', 2) as path from pages),
r as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as site, case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/' when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/' when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/' when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from u),
l as (select doc_id as page_id, min(quality) as good from labels group by doc_id),
o as (select r.site as host, count(good) as n, coalesce(sum(good), 0)::bigint as k from r left join l using (page_id) group by r.site),
h as (select *, case when regexp_matches(host, '^[0-9.]+$|^\\[') then host else array_to_string(string_split(host, '.')[-2:], '.') end as domain, case when regexp_matches(host, '^[0-9.]+$|^\\[') then 'address' else string_split(host, '.')[-1] end as suffix from o),
sl as (select suffix, sum(n) as n, sum(k) as k from h group by suffix),
dl as (select domain, suffix, sum(n) as n, sum(k) as k from h group by all),
top as (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) as m from h),
s1 as (select sl.*, m from sl, top), p1 as (select suffix, (k + s * m) / (n + s) as m from s1, ({_strength_sql("s1", "m")})),
s2 as (select dl.*, m from dl join p1 using (suffix)), p2 as (select domain, (k + s * m) / (n + s) as m from s2, ({_strength_sql("s2", "m")})),
s3 as (select h.*, m from h join p2 using (domain)), p3 as (select host, (k + s * m) / (n + s) as p, s, n from s3, ({_strength_sql("s3", "m")})),
b as (select host, p, p + 1.645 * sqrt(p * (1 - p) / (n + s + 1)) as bound from p3)
select page_id, r.host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when bound < 0.7 then 'block' else 'allow' end as verdict, round(p, 6) as host_rate, round(bound, 6) as host_bound
from r left join b on b.host = r.site"""


def oracle_sql() -> dict[str, str]:
    return SQL
