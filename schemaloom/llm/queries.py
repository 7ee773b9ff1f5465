"""The thin queries of the operators, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, jaccard, lmscore, packing, quality, secrets, sharding, toxicity, urls
from .common import table


def tokenizer_path() -> str:
    """Where the public tokenizer's file is; never copied here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_samples(spark)))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(table(spark, sf_dir, "embeddings"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op1_secrets, which SQL can express."""
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_sharding's law says of each shard: its rows, and slots without a gap."""
    slots = [F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("slots")]
    return op5_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("rows"), *slots)


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_sharding(spark, sf_dir).select("doc_id", "size", "law", "grown_shard")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_urls without what its trees decide."""
    return op7_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_lm_score without the tree's score."""
    return op10_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


OPERATORS = (op1_secrets, op2_ann, op3_jaccard_join, op4_packing, op5_sharding, op6_quality, op7_urls, op8_decontamination, op9_toxicity, op10_lm_score)
PARTS = (secrets_base, sharding_law, sharding_sizes, url_rules, lm_base)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The ten operators' queries, and the parts of some that SQL can hold to account."""
    return {f.__name__: f for f in (*OPERATORS, *PARTS)}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the other queries have models, permutations or tokenizers and are tested by brute force."""
    return {"op3_jaccard_join": NEAR_DUPLICATES, "secrets_base": SECRETS, "sharding_law": SHARDS, "sharding_sizes": SIZES, "url_rules": URLS, "lm_base": LANGUAGE}


#: crc32 of a text, bit by bit; 8 bits a byte, the lowest first.
_BITS = "flatten(list_transform(range(1, strlen({0}) + 1), lambda i: list_transform(range(0, 8), lambda k: ((ord(substr({0}, i, 1)) >> k) & 1)::ubigint)))"
_CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, " + _BITS + "), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"

_KINDS = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": "[0-9a-f]+"}
_KEPT = {"assign": f"length(regexp_extract(x, '{secrets.ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8", "access": "length(x) >= 16", "hex": "length(x) >= 32"}
_FOUND = " union all ".join(
    f"select doc_id, {n} as n, '{kind}' as kind, regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}') as f, string_split_regex(t, '{p.replace(chr(39), chr(39) * 2)}') as g from texts" for n, (kind, p) in enumerate(_KINDS.items())
)
SECRETS = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents), found as ({_FOUND}),
spans as (select doc_id, n, kind, f[i] as x, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0))::bigint as s from (select *, unnest(range(1, len(f) + 1)) as i from found)),
kept as (select *, kind || ':' || s || ':' || (s + length(x)) as said from spans where case kind {' '.join(f"when '{k}' then {v}" for k, v in _KEPT.items())} end)
select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, sha256(coalesce(string_agg(said, ',' order by s, n), '')) as base_sha256
from (select doc_id from documents) left join kept using (doc_id) group by doc_id"""

SHARDS = """
with d as (select count(*) as n from documents), s as (select unnest(range(0, 24))::int as shard)
select shard, n // 24 + (shard < n % 24)::bigint as rows, 0::bigint as first_slot, n // 24 + (shard < n % 24)::bigint - 1 as last_slot, n // 24 + (shard < n % 24)::bigint as slots from s, d where shard < n"""

SIZES = "select doc_id, strlen(coalesce(text, ''))::bigint + 8 as size, 'rows' as law, null::int as grown_shard from documents"

URLS = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/' when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
  when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/' when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from p)
select *, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' end as ruled from r"""

LANGUAGE = f"""
with d as (select doc_id, {_CRC.format("coalesce(doc_id::varchar, '')")} % 5 = 1 as held_out,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
tokens as (select doc_id, held_out, unnest(list_append(w, null)) as t from d), counts as (select t, count(*) as c from tokens where not held_out group by t), totals as (select sum(c)::bigint as n, count(*) as v from counts),
scored as (select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 0.5::double) / (n + 0.5::double * (v + 1)))) as s, any_value(n) as train_tokens
  from tokens left join counts on tokens.t is not distinct from counts.t, totals group by doc_id, held_out)
select doc_id, held_out, n_tokens, n_known, train_tokens, round(s, 4) as base_score from scored"""

NEAR_DUPLICATES = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach as (select doc_id as d, doc_id as r from documents union select reach.d, links.b from reach join links on links.a = reach.r
) select d.doc_id, coalesce(n, 0)::bigint as n_shingles, m.c as component_id
from documents d left join sizes using (doc_id) join (select d, min(r) as c from reach group by d) m on m.d = d.doc_id"""
