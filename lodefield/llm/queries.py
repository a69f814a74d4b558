"""The queries of this package's operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, decontam, idstore, jaccard, linededup, lm, mixing, packing, quality, sharding, tries, vectors, whitening
from .shared import new_path, ready

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sharding.tree(40)
    return sharding.shard_documents(read(spark, sf_dir, "documents"), own, sharding.grown(own))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.clean(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(read(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary())


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_path(spark, "store")
    idstore.write_store(read(spark, sf_dir, "documents"), to, vocabulary())
    return idstore.read_digests(spark, to).drop("rank")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed_in(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.select("doc_id", "source", "mix_epoch", "mix_block", "mix_at")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digests(read(spark, sf_dir, "embeddings"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.nodes(read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_sharding, op3_quality_rules, op4_line_dedup, op5_chat_formatting, op6_packing, op7_lm_scoring, op8_token_output, op9_embedding_near_dedup, op10_mixing,
        op11_decontamination, op12_embedding_whitening, op13_conversation_trie,
    )
}

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op3_quality_rules": rf"""
with w as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
wi as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) as p from w),
win as (select doc_id, p, list_slice(ws, p, p + 7) as k from wi),
again as (select doc_id, p from win qualify count(*) over (partition by doc_id, k) > 1),
rep as (select doc_id, count(*) as n from (select distinct doc_id, p + unnest(range(0, 8)) as p from again) group by doc_id),
m as (
  select w.doc_id, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from w left join rep on w.doc_id = rep.doc_id),
f as (
  select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
    cast(word_chars < 2.0 * n_words or word_chars > 15.0 * n_words as int) + cast(100 * n_symbols > 10.0 * n_words as int)
      + cast(100 * n_dup_lines > 30.0 * n_lines as int) + cast(100 * n_repeat_words > 20.0 * n_words as int) as soft_failed
  from m),
h as (select source, count(*) as n, sum(cast(base_failed or soft_failed > 0 as int)) as k from f group by source),
prior as (select avg(k / n) as m, var_pop(k / n) as v from h),
size as (select m, case when v > 0 then least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) else 1000.0 end as s from prior),
strict as (select source, (k + m * s) / (n + s) > 0.5 as strict from h, size)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed,
  not base_failed and soft_failed < 3 and not (strict and soft_failed > 0) as kept
from f join strict on f.source is not distinct from strict.source""",
    "op4_line_dedup": r"""
with l as (select doc_id, source, unnest(list_distinct(string_split(text, chr(10)))) as line from documents),
pages as (select source, count(*) as pages from documents group by source),
common as (
  select l.source, line from l join pages on l.source is not distinct from pages.source
  where regexp_matches(line, '[^\x20\x09-\x0D]')
  group by l.source, line having count(*) >= 5 and count(*) > 0.1 * any_value(pages)),
lists as (select source, list(line) as lines from common group by source),
d as (select doc_id, string_split(text, chr(10)) as own, coalesce(lines, []) as lines from documents left join lists on documents.source is not distinct from lists.source),
k as (select doc_id, own, list_filter(own, lambda x: not list_contains(lines, x)) as kept from d)
select doc_id, array_to_string(kept, chr(10)) as text, cast(len(own) as bigint) as n_lines, cast(len(own) - len(kept) as bigint) as n_dropped from k""",
    "op5_chat_formatting": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    case when role is null then 'n' else 'r' || role end || chr(1) || case when text is null then 'n' else 't' || text end as own from conversations),
c as (select conv_id, count(*) as n, list(md5(own) order by turn, role, text) as owns from t group by conv_id),
p as (select conv_id, n, unnest(range(1, n + 1)) as k, owns from c),
q as (select conv_id, n, k, md5(array_to_string(list_slice(owns, 1, k), '')) as pre from p),
whole as (select n, pre, min(conv_id) as conv_id, count(*) as n_copies from q where k = n group by n, pre),
kept as (select * from whole where not exists (select 1 from q where q.k < q.n and q.k = whole.n and q.pre = whole.pre)),
pos as (select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as nth from t)
select kept.conv_id, cast(floor(nth / 4096) as bigint) as segment, cast(kept.n as bigint) as n_turns, kept.n_copies,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>', chr(10) order by nth) as text
from kept join pos on pos.conv_id = kept.conv_id group by kept.conv_id, cast(floor(nth / 4096) as bigint), kept.n, kept.n_copies""",
    "op11_decontamination": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bp as (select item_id, ws, least(len(ws), 10) as l, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as p from b where len(ws) > 0),
bw as (select distinct item_id, l, array_to_string(list_slice(ws, p, p + l - 1), ' ') as k from bp),
dp as (select r, ws, l, unnest(range(1, len(ws) - l + 2)) as p from d, (select distinct l from bw) where len(ws) >= l),
hits as (select r, p, dw.l, item_id from (select r, p, l, array_to_string(list_slice(ws, p, p + l - 1), ' ') as k from dp) dw join bw on dw.l = bw.l and dw.k = bw.k),
words as (select r, count(*) as n_hit from (select distinct r, p + unnest(range(0, l)) as p from (select distinct r, p, l from hits)) group by r),
items as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from hits where item_id is not null) group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on d.r = words.r left join items on d.r = items.r""",
}
