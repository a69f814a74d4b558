"""Tokens, stems, scores of words, personal data, ids and overlap with a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import privacy as P
from ..functions import text as T
from ..operators import overlap, postings, retrieval, words
from .registry import index, num, plain, query, regex, table

QUERY = "What is the nation of tion, est or her and than that ble?"
_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_:+./-]*"


def duck_tokens(source: str = "documents", key: str = "doc_id", text: str = "text", name: str = "tok") -> str:
    """CTEs that end in (key, t), DuckDB's wording of tokenize()."""
    own = rf"lower(strip_accents(replace(lower({text}), 'ß', 'ss')))"
    strip = rf"regexp_replace({{}}, '^[./:+-]+|[./:+-]+$', '', 'g')"
    return rf"""{name}_raw as (select {key}, unnest(regexp_extract_all({own}, '{_PATTERN}')) as t from {source}),
{name}_low as (select {key}, {strip.format('t')} as t from {name}_raw),
{name} as (select {key}, t from {name}_low where t <> ''
  union all select {key}, p as t from (select {key}, t, {strip.format('p0')} as p from (select {key}, t, unnest(string_split(t, '-')) as p0 from {name}_low where contains(t, '-'))) where p <> '' and p <> t)"""


def duck_stem(source: str, keys: str, name: str) -> str:
    """CTEs that end in (keys, t, stem) of (keys, t), DuckDB's wording of stem()."""
    single = "case when length(b) >= 3 and right(b, 1) = substr(b, length(b) - 1, 1) and not regexp_matches(b, '[lsz]$') then left(b, length(b) - 1) else b end"
    irregular = " ".join(f"when '{a}' then '{b}'" for a, b in T.IRREGULAR.items())
    return rf"""{name}_1 as (select {keys}, t, case t {irregular} end as odd,
  case when length(t) >= 5 and t like '%es' and not regexp_matches(t, '[aeo]es$') then left(t, length(t) - case when regexp_matches(t, '(ch|sh|ss|x|z)es$') then 2 else 1 end)
    when t like '%s' and not regexp_matches(t, '[suiao]s$') then left(t, length(t) - 1) else t end as p from {source}),
{name}_2 as (select *, case when length(p) >= 6 and p like '%ing' then left(p, length(p) - 3) when length(p) >= 5 and p like '%ed' and p not like '%eed' then left(p, length(p) - 2) end as b from {name}_1),
{name}_3 as (select *, case when b is null then p else {single} end as e from {name}_2),
{name} as (select {keys}, t, case when odd is not null then odd when length(t) < 4 or not regexp_full_match(t, '[a-z]+') then t
  when length(t) >= 5 and regexp_matches(t, 'ie[sd]$') then left(t, length(t) - 3) || 'y'
  when length(e) >= 4 and e like '%e' and not regexp_matches(e, '[eiyo]e$') then left(e, length(e) - 1) else e end as stem from {name}_3)"""


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""with {duck_tokens()}, n as (select count(*) as n from documents)
select t as term, count(distinct doc_id) as df, cast(count(*) as bigint) as tf, round(ln(1 + (any_value(n) - count(distinct doc_id) + 0.5) / (count(distinct doc_id) + 0.5)), 6) as idf,
  round(ln((any_value(n) + 1.0) / (count(distinct doc_id) + 0.5)), 6) as live_idf from tok, n group by t""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.term_stats(table(spark, sf_dir, "documents"))


@query(f"""with {duck_tokens()}, {duck_stem('(select distinct t from tok)', '1 as one', 'st')} select t as term, stem from st""")
def term_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")).distinct()
    return terms.select("term", T.stem(F.col("term")).alias("stem"))


@query(f"""with {duck_tokens('conversations', 'conv_id, turn, role')}, u as (select * from tok where role = 'user'),
content as (select conv_id, turn, t from u where t not in ({_STOP})),
chosen as (select * from content union all select conv_id, turn, t from u where not exists (select 1 from content c where c.conv_id = u.conv_id and c.turn = u.turn)),
{duck_stem('chosen', 'conv_id, turn', 'st')} select conv_id, turn, stem as term, count(*) as n from st group by all""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    rows = turns.select("conv_id", "turn", F.explode(T.query_terms(T.tokenize(F.col("text")))).alias("term"))
    return rows.groupBy("conv_id", "turn", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {duck_tokens('conversations', 'conv_id, turn, role')}, w as (select distinct t from tok where role = 'user' and t not in ({_STOP})),
{duck_stem('w', '1 as one', 'st')}, s as (select distinct stem from st)
select stem as term, case when regexp_full_match(stem, '[A-Za-z]+') and length(stem) >= 3 then '"' || case when stem like '%y' and length(stem) >= 4 then left(stem, length(stem) - 1) else stem end || '"*' else '"' || stem || '"' end as clause from s
union all select stem, '"' || w || '"' from s join (values {", ".join(f"('{a}', '{b}')" for a, b in T.IRREGULAR.items())}) i(w, b) on i.b = s.stem""")
def fts_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    words_ = turns.select(F.explode(T.tokenize(F.col("text"))).alias("t")).distinct().where(~F.col("t").isin(T.STOPWORDS))
    return retrieval.match_clauses(words_.select(T.stem(F.col("t")).alias("term")).distinct())


@query(f"with {duck_tokens()} select distinct doc_id from tok where t like 'nation%' or t like 'tion%' or t = 'est'")
def fts_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.candidates(spark, index(spark, sf_dir), prefixes=["nation", "tion"], exact=["est"])


@query(f"with {duck_tokens()}, s as (select doc_id, bool_and(regexp_full_match(t, '[a-z0-9_]+')) as safe from tok group by doc_id) select d.doc_id, coalesce(safe, true) as safe from documents d left join s on s.doc_id = d.doc_id")
def fts_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.forall(T.tokenize(F.col("text")), lambda t: t.rlike("^[a-z0-9_]+$")).alias("safe"))


_QTOK = "select unnest(regexp_extract_all(lower('" + QUERY + "'), '[a-z]+')) as t"


@query(f"""with {duck_tokens()}, q as (select t, count(*) as qtf from ({_QTOK}) group by t), len as (select doc_id, count(*) as len from tok group by doc_id),
tf as (select doc_id, t, count(*) as tf from tok group by doc_id, t)
select tf.doc_id, round(sum((1 + ln(tf)) * qtf / sqrt(len)), 6) as score from tf join q on tf.t = q.t join len on len.doc_id = tf.doc_id group by tf.doc_id""")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.lexical(spark, index(spark, sf_dir), QUERY).select("doc_id", F.round("score", 6).alias("score"))


#: (bm.doc_id, bm.score): DuckDB's wording of bm25() for QUERY.
DUCK_BM25 = f"""{duck_tokens()}, {duck_stem('tok', 'doc_id', 'st')}, {duck_stem(f"(select t from ({_QTOK}) where t not in ({_STOP}))", '1 as one', 'qs')},
q as (select stem, count(*) as qtf from qs group by stem), len as (select d.doc_id, count(t) as len from documents d left join tok on d.doc_id = tok.doc_id group by d.doc_id),
ms as (select count(*) as n, avg(len) as mean from len), tf as (select doc_id, stem, count(*) as tf from st where stem in (select stem from q) group by doc_id, stem), df as (select stem, count(*) as df from tf group by stem),
bm as (select tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score
  from tf join df on tf.stem = df.stem join q on q.stem = tf.stem join len on len.doc_id = tf.doc_id, ms group by tf.doc_id)"""


@query(f"with {DUCK_BM25} select doc_id, round(score, 6) as score from bm")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.bm25(spark, index(spark, sf_dir), QUERY).select("doc_id", F.round("score", 6).alias("score"))


_CODED = {"email": P.EMAIL, "phone": P.PHONE, "date-of-birth": P.BIRTH, "passport": P.PASSPORT, "street-address": P.ADDRESS}
_SSN_DUCK = r"\b(?:00[1-9]|0[1-9]\d|[1-57-8]\d{2}|6(?:[0-57-9]\d|6[0-57-9]))[- ](?:0[1-9]|[1-9]\d)[- ](?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"
_LUHN_DUCK = r"""length(d) between 13 and 19 and len(list_distinct(string_split(d, ''))) >= 2 and list_sum(list_transform(range(1, length(d) + 1), lambda i:
  case when (length(d) - i) % 2 = 1 then case when 2 * cast(substr(d, i, 1) as int) > 9 then 2 * cast(substr(d, i, 1) as int) - 9 else 2 * cast(substr(d, i, 1) as int) end else cast(substr(d, i, 1) as int) end)) % 10 = 0"""


#: DuckDB's word bounds know ASCII letters alone: for it, other letters are written as a sign that is part of words.
_ASCII = r"regexp_replace(text, '[^\x00-\x7F\P{L}]', '_', 'g')"


def _quoted(s: str) -> str:
    return s.replace("'", "''")


@query(rf"""with c as (select doc_id, unnest(list_transform(regexp_extract_all({_ASCII}, '{P.CARD}'), lambda m: regexp_replace(m, '\D', '', 'g'))) as d from documents),
card as (select distinct doc_id from c where {_LUHN_DUCK}),
ip as (select distinct doc_id from (select doc_id, unnest(regexp_extract_all({_ASCII}, '{P.IPV4}')) as m from documents) where list_max(list_transform(string_split(m, '.'), lambda x: cast(x as int))) <= 255)
select documents.doc_id, array_to_string(list_filter([{", ".join("case when " + c + f" then '{k}' end" for k, c in {
    "email": f"regexp_matches(text, '{_quoted(P.EMAIL)}')", "ssn": f"regexp_matches(text, '{_SSN_DUCK}')", "phone": f"regexp_matches(text, '{P.PHONE}')", "payment-card": "card.doc_id is not null",
    "ip-address": "ip.doc_id is not null", "date-of-birth": f"regexp_matches(text, '{P.BIRTH}')", "passport": f"regexp_matches(text, '{P.PASSPORT}')", "street-address": f"regexp_matches(text, '{_quoted(P.ADDRESS)}')"}.items())}], lambda x: x is not null), ',') as tags
from (select doc_id, {_ASCII} as text from documents) documents left join card on card.doc_id = documents.doc_id left join ip on ip.doc_id = documents.doc_id""")
def pii_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.tags(F.col("text")), ",").alias("tags"))


@query()
def pii_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.redacted(F.col("text")).alias("text"))


def _duck_scrub() -> tuple[str, str]:
    n, t = "0", "text"
    for label, pattern in P.SECRETS:
        own = _quoted(pattern.replace("(?!ant-)", ""))
        n, t = f"{n} + len(regexp_extract_all({t}, '{own}'))", f"regexp_replace({t}, '{own}', '[REDACTED:{label}]', 'g')"
    return n, t


@query("select doc_id, {1} as text, cast({0} as bigint) as n_secrets from documents".format(*_duck_scrub()))
def secrets_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = P.scrubbed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), n.alias("n_secrets"))


_ESCAPED = "replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
#: Addresses scope private content to its owner: key order is that of sorted JSON.
plain("evidence_cids", f"""select doc_id, ⟦sha2¦sha256⟧('{{"content":"' || {_ESCAPED} || '","metadata":{{"content_pointer":null,"modality":"text","source_type":"' || source || '"' ||
  case when scoped then ',"subject_scope":"user"' else '' end || ',"tenant_id":"' || lang || '"' || case when scoped then ',"user_id":"' || source || '"' else '' end || '}}}}'⟦, 256¦⟧) as cid
  from (select d.doc_id, text, source, lang, coalesce(toxic = 1, false) or ⟦text rlike {regex(P.EMAIL)}¦regexp_matches(text, '{P.EMAIL}')⟧ as scoped from documents d left join labels l on d.doc_id = l.doc_id where text is not null) x""".replace("{{", "{").replace("}}", "}"))


@query("""with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
  sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') as entry from events),
c(user_id, idx, link) as (select user_id, idx, sha256(repeat('0', 64) || ':' || entry) from e where idx = 0
  union all select e.user_id, e.idx, sha256(c.link || ':' || e.entry) from c join e on e.user_id = c.user_id and e.idx = c.idx + 1)
select user_id, idx as link_index, link as link_sha256 from c""")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.sha2(F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"event_type":"'), F.col("event_type"), F.lit('"}')), 256)
    return words.hash_chain(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], entry)


_GRAMS = "select distinct {k}, array_to_string(list_slice(w, i, i + 7), ' ') as g from (select {k}, w, unnest(range(1, len(w) - 6)) as i from (select {k}, regexp_extract_all(lower(text), '[a-z0-9]+') as w from {t}) where len(w) >= 8)"
_ITEMS = f"i as ({_GRAMS.format(k='item_id', t='benchmark')}), dev as (select item_id from benchmark order by sha256(cast(item_id as varchar)), item_id limit 10)"


@query(f"select item_id, count(distinct doc_id) as docs from ({_GRAMS.format(k='item_id', t='benchmark')}) b join ({_GRAMS.format(k='doc_id', t='documents')}) d on b.g = d.g group by item_id")
def shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = overlap.hits(table(spark, sf_dir, "documents"), overlap.shingled(table(spark, sf_dir, "benchmark"), "item_id"))
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))


@query(f"""with {_ITEMS}, own as (select g, min(item_id) as item_id from i group by g having count(distinct item_id) = 1),
probe as (select * from own where item_id not in (select item_id from dev) and g not in (select g from i where item_id in (select item_id from dev)))
select distinct item_id, doc_id from probe join ({_GRAMS.format(k='doc_id', t='documents')}) d on d.g = probe.g""")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return overlap.contaminated(table(spark, sf_dir, "documents"), items, overlap.development(items, "item_id", 10))


@query("select item_id, item_id in (select item_id from benchmark order by sha256(cast(item_id as varchar)), item_id limit 10) as held_out from benchmark")
def held_out_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    dev = overlap.development(items, "item_id", 10).withColumn("dev", F.lit(True))
    return items.join(F.broadcast(dev), "item_id", "left").select("item_id", F.coalesce("dev", F.lit(False)).alias("held_out"))


_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"


@query(rf"""with dev as (select item_id from benchmark order by sha256(cast(item_id as varchar)), item_id limit 10),
n as (select distinct item_id, unnest(regexp_extract_all({_ASCII}, '{_NAME}')) as name from benchmark),
low as (select distinct unnest(regexp_extract_all({_ASCII}, '\b[a-z][a-z]+\b')) as w from benchmark where item_id in (select item_id from dev))
select name, count(*) as owners from n where item_id not in (select item_id from dev) and name not in (select name from n where item_id in (select item_id from dev)) and length(name) >= 4
  and (contains(name, ' ') or lower(name) not in (select w from low)) group by name having count(*) <= 2""")
def rare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return overlap.rare_names(items, overlap.development(items, "item_id", 10))


@query(f"""with {duck_tokens('conversations', 'conv_id')}, {duck_tokens(name='dt')}, known as (select distinct t from dt), new as (select distinct t from tok where length(t) >= 6 and regexp_full_match(t, '[a-z]+') and t not in (select t from known)),
less as (select t, t as v from new union select t, left(t, i - 1) || substr(t, i + 1) from (select t, unnest(range(2, length(t) + 1)) as i from new)),
fine as (select t from known where length(t) >= 6 and regexp_full_match(t, '[a-z]+')), other as (select t, t as v from fine union select t, left(t, i - 1) || substr(t, i + 1) from (select t, unnest(range(2, length(t) + 1)) as i from fine))
select distinct a.t as term, b.t as correction from less a join other b on a.v = b.v where left(a.t, 1) = left(b.t, 1) and damerau_levenshtein(a.t, b.t) <= 1""")
def typo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name: table(spark, sf_dir, name).select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")).distinct()
    return words.corrections(of("conversations"), of("documents"))


_EXPANSIONS = [(a, b) for a, bs in words.HYPONYMS.items() for b in bs]


@query(f"""with {duck_tokens('conversations', 'conv_id, turn, role')}, t as (select distinct t from tok where role = 'user') select t as term, t as expansion from t
union all select a, b from t join (values {", ".join(f"('{a}', '{b}')" for a, b in _EXPANSIONS)}) x(a, b) on x.a = t.t""")
def taxonomy_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return words.expanded(turns.select(F.explode(T.tokenize(F.col("text"))).alias("term")).distinct())


@query(f"""with {duck_tokens()}, u as (select distinct doc_id, t from tok where regexp_full_match(t, '[a-z]+') and length(t) > 2 and t not in ({_STOP})),
df as (select t, count(*) as df from u group by t), n as (select count(*) + 2.0 as n from documents),
v as (select t from df where df between 3 and 8), p as (select a.t as a, b.t as b, count(*) as c from u a join u b on a.doc_id = b.doc_id and a.t < b.t where a.t in (select t from v) and b.t in (select t from v) group by a.t, b.t)
select p.a, p.b, c as docs, round(greatest(0, ln(c * n / (da.df * db.df)) / ln(2)), 4) as ppmi from p join df da on da.t = p.a join df db on db.t = p.b, n where ln(c * n / (da.df * db.df)) / ln(2) >= 0.5 and c >= 3""")
def term_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.associations(table(spark, sf_dir, "documents"), least_docs=3, most_docs=8, least_pairs=3, least_pmi=0.5)


@query("""with w as (select doc_id, list_filter(regexp_extract_all(lower(strip_accents(replace(lower(text), 'ß', 'ss'))), '[a-z]+'), lambda x: length(x) > 2) as w from documents),
z as (select unnest(list_zip(list_slice(w, 1, len(w) - 1), list_slice(w, 2, len(w)))) as p from w where len(w) > 1), b as (select p[1] as a, p[2] as b from z), c as (select a, b, count(*) as n from b where a <> b group by a, b having count(*) >= 5),
df as (select t, count(*) as df from (select distinct doc_id, unnest(w) as t from w) group by t), n as (select count(*) + 2.0 as n from documents)
select c.a, c.b, c.n, round(greatest(0, ln((c.n / n.n) / ((x.df / n.n) * (y.df / n.n))) / ln(2)), 4) as pmi from c join df x on x.t = c.a join df y on y.t = c.b, n""")
def bigram_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.bigrams(table(spark, sf_dir, "documents"), least=5)


plain("amounts", f"""select o_orderkey, cast(replace(⟦regexp_extract(quote, {regex(r'([0-9]+(?:,[0-9]{3})*(?:[.][0-9]{1,2})?)')}, 1)¦regexp_extract(quote, '([0-9]+(?:,[0-9]{{3}})*(?:[.][0-9]{{1,2}})?)', 1)⟧, ',', '') as double) as amount
  from (select o_orderkey, 'paid $' || cast(cast(floor(o_totalprice / 1000) as bigint) as ⟦string¦varchar⟧) || ',' || ⟦lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as string), 3, '0')¦lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as varchar), 3, '0')⟧ || '.50 for it' as quote from orders) x""".replace("{{", "{").replace("}}", "}"))
plain("honeytokens", f"""select doc_id, marker from (select doc_id, lang, ⟦explode(regexp_extract_all(t, {regex('(HTKN-S[0-4]-[0-9a-f]{16})')}, 1))¦unnest(regexp_extract_all(t, 'HTKN-S[0-4]-[0-9a-f]{{16}}'))⟧ as marker from
  (select doc_id, lang, text || ' HTKN-S2-' || substr(⟦sha2('S2:' || lang, 256)¦sha256('S2:' || lang)⟧, 1, 16) as t from documents where text is not null) a) b
  where substr(marker, 9) <> substr(⟦sha2(substr(marker, 6, 2) || ':en', 256)¦sha256(substr(marker, 6, 2) || ':en')⟧, 1, 16)""".replace("{{", "{").replace("}}", "}"))


@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.hashed_embeddings(table(spark, sf_dir, "documents"), 64).select("doc_id", "embedding")


@query()
def contextual_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    return words.contextual_embeddings(docs, 64)


@query()
def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", F.posexplode(words.clauses(F.col("text"))).alias("nth", "clause"))


@query("""with t as (select conv_id, turn, case when role = 'user' then 'User: ' else 'Assistant: ' end || replace(replace(text, chr(10), ' '), ':', '.') as line from conversations where text is not null),
s as (select conv_id, turn, line, coalesce(sum(length(line) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as pos, lead(turn) over (partition by conv_id order by turn) is null as last from t)
select conv_id, lower(split_part(line, ':', 1)) as speaker, cast(pos + length(line) - length(ltrim(substr(line, instr(line, ':') + 1))) as bigint) as span_start, cast(pos + length(line) + case when last then 0 else 1 end as bigint) as span_end from s""")
def speaker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(":"), F.lit(".")))
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return whole.select("conv_id", F.explode(words.speaker_spans(F.col("text"))).alias("s")).select("conv_id", "s.speaker", "s.span_start", "s.span_end")


_ENDS = [("ingly", 5, ""), ("edly", 4, ""), ("ing", 3, ""), ("ied", 3, "y"), ("ies", 3, "y"), ("ed", 2, ""), ("es", 2, ""), ("s", 1, "")]


@query(f"""with {duck_tokens()}, t as (select distinct t from tok) select t as term, case when t in ('owned', 'owning', 'owns') then 'own' when t in ('notifications', 'notification', 'notified', 'notifies', 'notify') then 'notify' when t = 'co2' then 'carbon'
  {" ".join(f"when length(t) > {n + 3} and t like '%{e}' then left(t, length(t) - {n}) || '{y}'" for e, n, y in _ENDS)} when length(t) = 4 and t like '%s' and not regexp_matches(t, '([suiao]s|yes|was|has|his)$') then left(t, 3) else t end as normalised from t""")
def normalised_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")).distinct()
    return terms.select("term", T.normalised(F.col("term")).alias("normalised"))


@query("""select c_custkey, 'residence' as predicate, 'Nation ' || c_nationkey as object, false as negative from customer union all select c_custkey, 'work_at', 'Segment ' || c_mktsegment, c_custkey % 3 = 0 from customer
union all select c_custkey, 'like', 'part ' || c_custkey, false from customer where c_custkey % 2 = 0""")
def said_of_oneself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sentences made of customers state of them."""
    said = F.expr("""'I live in Nation ' || c_nationkey || case when c_custkey % 3 = 0 then '. Now I no longer work at Segment ' else ' and work at Segment ' end || c_mktsegment || case when c_custkey % 2 = 0 then '; I really like part ' || c_custkey else '.' end""")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(words.claims(said)).alias("c"))
    return rows.select("c_custkey", "c.predicate", "c.object", "c.negative")
