"""Queries of this subpackage's operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.alignment import alignment_table
from larkspur.llm.bpe import bpe_digests
from larkspur.llm.conversations import damage, repair_table
from larkspur.llm.decontamination import decontamination_table
from larkspur.llm.fingerprints import fingerprint_table
from larkspur.llm.html_text import extract_table
from larkspur.llm.langid import language_table
from larkspur.llm.licenses import license_scan
from larkspur.llm.mixing import mix_table
from larkspur.llm.near_duplicates import near_duplicate_table
from larkspur.llm.quality import quality_table
from larkspur.llm.token_files import token_table
from larkspur.llm.topk import top_k_table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file and the pattern that goes with the rank files."""
    public = importlib.import_module("public_tokenizers")
    return public.path(name), public.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_table(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(table(spark, sf_dir, "documents"), path, pattern)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_table(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")[0])


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_table(table(spark, sf_dir, "embeddings"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_table(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")[0], vocabulary("piece_bpe_32k.model")[0])


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_table(damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_ngram_jaccard, op3_byte_bpe, op4_mix_sources, op5_quality_rules, op6_language_id,
        op7_token_files, op8_exact_top_k, op9_fingerprints, op10_html_text, op11_token_alignment, op12_decontamination,
        op13_conversation_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then []::varchar[] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) end) shingle from w),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) n from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where c.n * 5 >= 4 * (x.n + y.n - c.n)),
r(a, b) as (select doc_id, doc_id from w union select r.a, l.b from r join l on r.b = l.a),
k as (select a doc_id, min(b) class_id from r group by a),
d as (select doc_id, case when len(words) > 0 then count(*) over (partition by words) - 1 else 0 end n_copies from w)
select k.doc_id, k.class_id, cast((select count(*) from l where l.a = k.doc_id) as bigint) n_links, cast(d.n_copies as bigint) n_copies
from k join d on d.doc_id = k.doc_id
""",
    "op8_exact_top_k": """
with e as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select * from e where vec_id % 50 = 0),
s as (
  select q.vec_id query_id, e.vec_id, cast(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) as bigint) score
  from q join e on q.vec_id <> e.vec_id and len(q.v) = len(e.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as int) rank, vec_id, score from r where rank <= 5
""",
    "op12_decontamination": r"""
with d as (
  select row_number() over () k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda s: array_to_string(w[s:s + 9], ' '))) g
  from i where len(w) > 0),
sizes as (select distinct n from windows),
runs as (select k, n, unnest(list_transform(range(1, len(w) - n + 2), lambda s: {s: s, g: array_to_string(w[s:s + n - 1], ' ')})) r from d, sizes where len(w) >= n),
hits as (select runs.k, r.s s, runs.n n, item_id from runs join windows on runs.r.g = windows.g and runs.n = windows.n),
places as (select k, count(*) n_hit from (select distinct k, unnest(range(s, s + n)) p from hits) group by k),
named as (select k, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct k, cast(item_id as varchar) item from hits where item_id is not null) group by k)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join places using (k) left join named using (k)
""",
    "op13_conversation_repair": r"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as bytes
  from conversations),
crc as (
  select bytes, 0 as i, cast(4294967295 as ubigint) as r from (select distinct bytes from c)
  union all
  select bytes, i + 1, list_reduce([xor(r, cast(ascii(bytes[i + 1]) as ubigint)), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: case when x % 2 = 1 then xor(x // 2, cast(3988292384 as ubigint)) else x // 2 end)
  from crc where i < length(bytes)),
hit as (select bytes, xor(r, cast(4294967295 as ubigint)) % 20 as h from crc where i = length(bytes)),
d as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when h = 3 then [0, 1] else [0] end) as copy
  from c join hit using (bytes) where h <> 0),
g as (select *, sha256(cast(length(role) as varchar) || ':' || role || text) as digest from d),
f as (
  select *, row_number() over w as rn, row_number() over (partition by conv_id, digest order by turn nulls first, copy) as seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as ends, lag(left(role, 1)) over w as before
  from g window w as (partition by conv_id order by turn nulls first, digest, copy)),
k as (
  select *, left(role, 1) as i, case when ends = '' then 'b' when seen > 1 then 'd' when ends not in ('.', '!', '?') then 't' else '' end as fault from f),
conv as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (rn > 1 and coalesce(before, '') || i not in ('su', 'ua', 'au')) as illegal, max(rn) as n
  from k group by conv_id),
-- Least (cost, audit) of each state: s0 nothing yet, s1 after the system, s2 after a user, s3 after an assistant; 1000000000 is out of reach.
dp(conv_id, rn, s0, s1, s2, s3) as (
  select conv_id, cast(0 as bigint), {c: 0, a: ''}, {c: 1000000000, a: ''}, {c: 1000000000, a: ''}, {c: 1000000000, a: ''} from conv
  union all
  select conv_id, rn + 1, {c: s0.c + 4, a: s0.a || 'D'},
    least({c: s1.c + 4, a: s1.a || 'D'}, {c: s0.c + ks, a: s0.a || 'K'}),
    least({c: t2.c + 4, a: t2.a || 'D'}, least({c: s0.c + ku, a: s0.a || 'K'}, {c: s0.c + e, a: s0.a || 'R'}),
      least({c: s1.c + ku, a: s1.a || 'K'}, {c: s1.c + e, a: s1.a || 'R'}), least({c: t3.c + ku, a: t3.a || 'K'}, {c: t3.c + e, a: t3.a || 'R'})),
    least({c: t3.c + 4, a: t3.a || 'D'}, least({c: t2.c + ka, a: t2.a || 'K'}, {c: t2.c + e, a: t2.a || 'R'}))
  from (
    select *, least(s3, {c: t2.c + 3, a: t2.a || 'I'}) as t3
    from (select *, least(s2, least({c: s0.c + 3, a: s0.a || 'I'}, least({c: s1.c + 3, a: s1.a || 'I'}, {c: s3.c + 3, a: s3.a || 'I'}))) as t2 from dp)
  ) p join (
    select conv_id as cid, rn as r, case when fault in ('b', 'd') then 1000000000 when fault = 't' then 6 else 3 end as e,
      case when fault in ('b', 'd') or i <> 's' then 1000000000 when fault = 't' then 3 else 0 end as ks,
      case when fault in ('b', 'd') or i <> 'u' then 1000000000 when fault = 't' then 3 else 0 end as ku,
      case when fault in ('b', 'd') or i <> 'a' then 1000000000 when fault = 't' then 3 else 0 end as ka
    from k) x on x.cid is not distinct from p.conv_id and x.r = p.rn + 1),
best as (
  select dp.conv_id, least(s0, least(s3, {c: t2.c + 3, a: t2.a || 'I'})) as b
  from (select *, least(s2, least({c: s0.c + 3, a: s0.a || 'I'}, least({c: s1.c + 3, a: s1.a || 'I'}, {c: s3.c + 3, a: s3.a || 'I'}))) as t2 from dp) dp
  join conv on conv.conv_id is not distinct from dp.conv_id and conv.n = dp.rn),
edits as (select conv_id, b.c as cost, b.a as audit, unnest(range(1, length(b.a) + 1)) as p from best),
steps as (
  select conv_id, p, audit[p] as edit, count(*) filter (audit[p] <> 'I') over w as rn, count(*) filter (audit[p] <> 'D') over w as kept
  from edits window w as (partition by conv_id order by p)),
turns as (
  select s.conv_id, s.p, s.edit, s.kept, k.role, k.text,
    max(case when s.edit = 'K' and k.i = 's' then 1 else 0 end) over (partition by s.conv_id) as sys
  from steps s left join k on k.conv_id is not distinct from s.conv_id and k.rn = s.rn and s.edit <> 'I' where s.edit <> 'D'),
fixed as (
  select conv_id, string_agg(case edit when 'K' then role || ':' || text
    else (case when (kept - sys) % 2 = 1 then 'user:' else 'assistant:' end) || (case edit when 'R' then text else '' end) end, chr(10) order by p) as body
  from turns group by conv_id)
select o.conv_id, coalesce(cast(gaps as bigint), 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(coalesce(b.c, 0) as bigint) as cost, coalesce(b.a, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join conv on conv.conv_id is not distinct from o.conv_id
left join best on best.conv_id is not distinct from o.conv_id left join fixed on fixed.conv_id is not distinct from o.conv_id
""",
}
