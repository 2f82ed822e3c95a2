"""One query for each operation, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, imatch, language_id, licenses, minhash, packing, pieces, prefix_trie, quality, resample, substring, topk, url_filter
from .common import table

#: Path of the tokenizer files; None takes the installed ones.
TOKENIZERS: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Rules of the url filter as (host, path, verdict), and the listed hosts.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SPAM_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = [f"{name}.example.{top}" for name in SPAM_NAMES for top in ("com", "net", "org")]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES, listed)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), span=20)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)


def queries() -> dict:
    return {
        "op1_language": op1_language,
        "op2_minhash": op2_minhash,
        "op3_url_filter": op3_url_filter,
        "op4_pack": op4_pack,
        "op5_repeats": op5_repeats,
        "op6_top_k": op6_top_k,
        "op7_pieces": op7_pieces,
        "op8_imatch": op8_imatch,
        "op9_quality": op9_quality,
        "op10_licenses": op10_licenses,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_resample": op12_resample,
        "op13_decontaminate": op13_decontaminate,
    }


OP3_SQL = f"""
with p as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p)
select page_id, host, path,
  case when ends_with('.' || host, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when ends_with('.' || host, '.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when ends_with('.' || host, '.org') and starts_with(path, '/fr/') then 'org/fr/'
    when ends_with('.' || host, '.net') and starts_with(path, '/') then 'net/' end as rule,
  case when ends_with('.' || host, '.example.com') and starts_with(path, '/de/') then 'block'
    when ends_with('.' || host, '.example.net') and starts_with(path, '/en/') then 'allow'
    when ends_with('.' || host, '.org') and starts_with(path, '/fr/') then 'allow'
    when ends_with('.' || host, '.net') and starts_with(path, '/') then 'block'
    when {" or ".join(f"ends_with('.' || host, '.{k}')" for k in LISTED)} then 'block'
    else 'allow' end as verdict
from h
"""

OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, x.vec_id, cast(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v x on q.vec_id <> x.vec_id and len(q.e) = len(x.e) where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


#: One row with the table of CRC-32, made from its polynomial.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as tab"
#: Lower-cased words of a text, null as none.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def crc_sql(text: str) -> str:
    """CRC-32 of an expression's UTF-8 bytes, byte by byte; `tab` is in scope."""
    return (
        f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint), "
        "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )


OP11_SQL = f"""
with tab as ({CRC_TABLE}),
turns as (
  select conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as t,
    row_number() over (partition by conv_id order by turn nulls first, sha256(sha256(coalesce(role, '')) || coalesce(text, ''))) - 1 as i
  from conversations where conv_id is not null),
convs as (select conv_id, list(t order by i) as own from turns group by conv_id),
h as (select conv_id, own, {crc_sql("cast(conv_id as varchar)")} % 9 as h from convs, tab),
built as (
  select h.conv_id, case when h.conv_id % 5 = 0 then h.own else list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) end as path
  from h left join convs b on b.conv_id = h.conv_id - h.conv_id % 5),
members as (select conv_id, path, d, path[1:d] as node from built, unnest(range(len(path) + 1)) u(d)),
nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(path) = d), '')) as ends_sha256
  from members group by node, d),
leaves as (select n.* from nodes n where not exists (select 1 from nodes c where c.d = n.d + 1 and c.node[1:n.d] = n.node)),
below as (
  select a.node, sum((c.n_convs - 1) * case when c.d = 0 then 0 else strlen(c.node[c.d].text) end) as saved_tokens,
    count(*) filter (where c.d = a.d + 1) as n_children, count(*) filter (where c.node in (select node from leaves)) as n_leaves
  from nodes a join nodes c on c.d >= a.d and c.node[1:a.d] = a.node group by a.node)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n_convs, b.n_children, b.n_leaves, cast(b.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join below b on b.node = n.node left join nodes p on n.d > 0 and p.d = n.d - 1 and p.node = n.node[1:n.d - 1]
"""

OP12_SQL = f"""
with tab as ({CRC_TABLE}),
d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
b as (select {WORDS} as w from benchmark),
df as (select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
bf as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
dn as (select r, f, count(*) as n from df group by r, f),
bn as (select f, count(*) as n from bf group by f),
code as (select f, {crc_sql("f")} % 10000 as bucket from (select f from dn union select f from bn), tab),
s as (select bucket, sum(n) as s from dn join code using (f) group by bucket),
t as (select bucket, sum(n) as t from bn join code using (f) group by bucket),
gain as (
  select k as bucket, cast(floor(1000 * ln((cast(coalesce(t, 0) + 1 as double) * cast((select coalesce(sum(s), 0) from s) + 10000 as double))
    / (cast(coalesce(s, 0) + 1 as double) * cast((select coalesce(sum(t), 0) from t) + 10000 as double)))) as bigint) as gain
  from range(10000) u(k) left join s on s.bucket = k left join t on t.bucket = k),
weight as (select r, cast(sum(n) as bigint) as n_features, cast(floor(sum(n * gain) / sum(n)) as bigint) as weight from dn join code using (f) join gain using (bucket) group by r),
scored as (
  select d.r, d.doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(cast(doc_id as varchar), ''))[1:8])::bigint + 0.5::double) / 4294967296))) as bigint) as score
  from d left join weight using (r)),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, n_features) as k from scored where n_words >= 20)
select doc_id, n_features, weight, score,
  case when k <= 25 * (select count(*) from ranked) // 100 then k end as rank
from scored left join ranked using (r)
"""

OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, {WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {WORDS} as w from benchmark),
tests as (select distinct item, w[i:i + least(len(w), 10) - 1] as test from b, unnest(range(1, len(w) - least(len(w), 10) + 2)) u(i) where len(w) > 0),
sizes as (select distinct len(test) as size from tests),
found as (
  select r, i, size, test from (select r, i, size, w[i:i + size - 1] as test from d, sizes, unnest(range(1, len(w) - size + 2)) u(i) where len(w) >= size)
  where test in (select test from tests)),
hit as (select r, count(distinct i + k) as n_hit from found, unnest(range(size)) u(k) group by r),
items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct r, item from (select distinct r, test from found) join tests using (test) where item is not null) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op6_top_k": OP6_SQL, "op11_prefix_trie": OP11_SQL, "op12_resample": OP12_SQL, "op13_decontaminate": OP13_SQL}
