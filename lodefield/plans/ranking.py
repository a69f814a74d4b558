"""Channels, fusion, selection under budgets, and the scores that answers are held to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, times
from ..functions import text as T
from ..operators import postings
from ..operators import retrieval as R
from ..operators import search
from ..operators import selection as S
from ..operators import vectors as V
from ..operators import words
from .registry import index, num, plain, query, regex, table
from .texts import DUCK_BM25, QUERY

_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: cast(z[1] as double) * cast(z[2] as double)))"
_DENSE = f"select e.vec_id, {_DOT} as score from embeddings e, embeddings q where q.vec_id = 0 and e.vec_id <> 0"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return e.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", R.dot(F.col("embedding"), F.col("q")).alias("score")).where("score > 0")


@query(f"select vec_id, round(score, 6) as score from ({_DENSE}) where score > 0 order by score desc, vec_id limit 50")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).orderBy(F.desc("score"), "vec_id").limit(50).select("vec_id", F.round("score", 6).alias("score"))


@query("""with q as (select embedding as q from embeddings where vec_id = 0), s as (select vec_id, embedding, q,
  list_sum(list_transform(range(1, 65), lambda i: cast((embedding[i] > 0) <> (q[i] > 0) as int))) as far from embeddings, q order by far, vec_id limit 256),
c as (select *, case when list_max(list_transform(embedding, lambda v: abs(cast(v as double)))) > 1e-8 then list_max(list_transform(embedding, lambda v: abs(cast(v as double)))) / 127 else 1 / 127::double end as sx,
  list_max(list_transform(q, lambda v: abs(cast(v as double)))) / 127 as sq from s),
a as (select *, round(list_sum(list_transform(range(1, 65), lambda i: cast(greatest(-127, least(127, round_even(cast(embedding[i] as double) / sx, 0))) as int) * cast(greatest(-127, least(127, round_even(cast(q[i] as double) / sq, 0))) as int))) * sx * sq, 9) as approx from c order by approx desc, vec_id limit 64)
select vec_id, round(list_sum(list_transform(range(1, 65), lambda i: cast(embedding[i] as double) * cast(q[i] as double))), 6) as score from a order by score desc, vec_id limit 10""")
def quantized_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return V.staged(e, e.where("vec_id = 0").select(F.col("embedding").alias("q")), 10, 64).select("vec_id", F.round("score", 6).alias("score"))


@query("""select e.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: cast(cast(e.embedding[i] as float) as double) * cast(q.embedding[i] as double))), 5) as score from embeddings e, embeddings q where q.vec_id = 1""")
def compensated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", F.round(R.compensated(F.col("embedding"), F.col("q")), 5).alias("score"))


_CHANNELS = f"""{DUCK_BM25}, hits as (
  select 'lexical' as channel, 'document' as kind, doc_id as id, row_number() over (order by round(score, 9) desc, doc_id) as rank from bm qualify rank <= 100
  union all select 'vector', 'vector', vec_id, row_number() over (order by round(score, 9) desc, vec_id) as rank from ({_DENSE}) where score > 0 qualify rank <= 100
  union all select 'recency', 'document', doc_id, row_number() over (order by n_chars desc, doc_id) as rank from documents qualify rank <= 100)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexical = R.ranked(postings.bm25(spark, index(spark, sf_dir), QUERY).withColumn("score", F.round("score", 9)), "lexical", "document", "doc_id", 100)
    dense = R.ranked(_dense(spark, sf_dir).withColumn("score", F.round("score", 9)), "vector", "vector", "vec_id", 100)
    long = R.ranked(docs.select("doc_id", F.col("n_chars").cast("double").alias("score")), "recency", "document", "doc_id", 100)
    return lexical.unionByName(dense).unionByName(long)


@query(f"""with {_CHANNELS} select kind, id, round(sum(case channel when 'lexical' then 0.35 when 'vector' then 0.45 else 0.4 end / (60.0 + rank)), 9) as score, string_agg(distinct channel, '+' order by channel) as channels
from hits group by kind, id order by score desc, kind, id limit 24""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.rrf(channels(spark, sf_dir), weights={"lexical": 0.35, "vector": 0.45}).withColumn("score", F.round("score", 9))
    return fused.orderBy(F.desc("score"), "kind", "id").limit(24).select("kind", "id", "score", "channels")


@query(f"""with {_CHANNELS}, f as (select kind, id, min((rank, case channel when 'lexical' then 1 when 'vector' then 2 else 3 end)) as spot, string_agg(distinct channel, '+' order by channel) as channels from hits group by kind, id),
top as (select *, row_number() over (order by spot) as place from f qualify place <= 40) select kind, id, place, 1.0::double / place as score, channels from top""")
def interleaved_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.interleaved(channels(spark, sf_dir), ["lexical", "vector", "recency"], 40)


# Words that call for the deep path.
MARKERS = ["why", "histor", "reconstruct", "trace", "timeline", "as of", "as-of", "originally", "evolve", "evolution", "decision", "how did", "what changed", "root cause", "over time", "across sessions", "back then"]
plain("query_router", f"""select conv_id, turn, case when override is not null then override when {" or ".join(f"low like '%{m}%'" for m in MARKERS)} then 'deep' when n >= 12 then 'deep' else 'fast' end as mode, n as n_tokens from
  (select conv_id, turn, lower(text) as low, case when turn >= 6 then 'deep' end as override, cast(⟦size(filter(split(text, {regex("[ \\t\\n\\r]+")}), x -> x <> ''))¦len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))⟧ as int) as n from conversations where role = 'user') x""")

# What tells a query's intent, and the weights of the routes for each.
TEMPORAL = r"(?i)\b(?:when|yesterday|today|tonight|last\s+(?:night|week|month|year)|this\s+(?:week|month|year)|\d+\s+(?:days?|weeks?|months?|years?)\s+ago|before|after|since|earliest|latest|recently|most\s+recent|chronological|timeline)\b"
MULTIHOP = r"(?:\b[A-Z]\w*(?:\x27s|’s)\b|\b(?:reports?\s+to|assigned\s+to|led\s+by|managed\s+by|depends?\s+on|connected\s+to|linked\s+to|works?\s+(?:for|with)|belongs?\s+to)\b)"
PREFERENCE = r"(?i)\b(?:prefer|prefers|preferred|preference|preferences|favorite|favourite|dislike|always\s+use|never\s+use|usually|habit|habits|avoid|instead\s+of|workflow\s+style)\b"
_ROUTES = {"temporal": (0.40, 0.35, 0.15, 0.35, 0.20), "multihop": (0.35, 0.25, 0.45, 0.25, 0.15), "preference": (0.45, 0.35, 0.15, 0.30, 0.20)}
_WEIGHT = lambda i: "case intent " + " ".join(f"when '{k}' then {num(v[i])}" for k, v in _ROUTES.items()) + " end"
plain("intent_weights", f"""select conv_id, turn, intent, {", ".join(f"{_WEIGHT(i)} as {name}" for i, name in enumerate(("vector", "lexical", "graph", "working", "prospective")))} from (select conv_id, turn,
  case when ⟦text rlike {regex(TEMPORAL)}¦regexp_matches(text, '{TEMPORAL}')⟧ then 'temporal' when ⟦text rlike {regex(MULTIHOP)}¦regexp_matches(text, '{MULTIHOP}')⟧ then 'multihop'
    when ⟦text rlike {regex(PREFERENCE)}¦regexp_matches(text, '{PREFERENCE}')⟧ then 'preference' end as intent from
  (select conv_id, turn, case when turn % 4 = 2 then 'What happened after ' || text when turn % 8 = 4 then 'I prefer ' || text else text end as text from conversations where role = 'user' and text is not null) y) x""")


def hits(spark: SparkSession, sf_dir: str, most: int = 48) -> DataFrame:
    """(query_id, id, rank, score, vector, query_vector, tokens, n_words): for the first vector of each label its nearest,
    with documents of the same number as their texts. The queries are one a label, all other vectors are held against them."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vector"), F.min("vec_id").alias("query_id")).drop("label")
    both = e.join(F.broadcast(q), F.col("vec_id") != F.col("query_id")).withColumn("score", F.round(R.dot(F.col("embedding"), F.col("query_vector")), 9)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = both.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", F.col("vec_id").alias("id"), "rank", "score", F.col("embedding").cast("array<double>").alias("vector"), F.col("query_vector").cast("array<double>").alias("query_vector"))
    text = top.join(d.select(F.col("doc_id").alias("id"), "text"), "id", "left")  # only texts of hits are split
    return text.withColumn("tokens", F.coalesce(T.tokenize(F.col("text")), F.array().cast("array<string>"))).withColumn("n_words", F.size("tokens"))


@query()
def mmr_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mmr(hits(spark, sf_dir).select("query_id", "id", "rank", "score", "vector", "query_vector"), 8)


@query()
def mmr_normalized_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mmr_normalized(hits(spark, sf_dir).select("query_id", "id", "rank", "score", "vector", "tokens"), 8)


@query()
def marginal_gain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.marginal_gain(hits(spark, sf_dir).select("query_id", "id", "rank", "score", "tokens", "n_words"), 400)


@query()
def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = F.filter(F.transform(F.array(F.lit("the"), F.lit("tion"), F.lit("her")), lambda f, i: F.when(F.array_contains("tokens", f), i)), lambda x: x.isNotNull())
    return S.covering(hits(spark, sf_dir).select("query_id", "id", "rank", facets.alias("facets")))


@query()
def trimmed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trimmed(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), ["the", "tion", "and"], 200)


@query("""with recursive t as (select conv_id, turn, greatest(1, ceil(length(text) / 4)) as cost, row_number() over (partition by conv_id order by turn) as rank from conversations where text is not null),
f(conv_id, rank, turn, used, kept) as (select conv_id, cast(0 as bigint), cast(-1 as bigint), cast(0 as bigint), false from (select distinct conv_id from t)
  union all select t.conv_id, t.rank, t.turn, cast(case when used + cost <= 300 then used + cost else used end as bigint), used + cost <= 300 from f join t on t.conv_id = f.conv_id and t.rank = f.rank + 1)
select conv_id as query_id, turn as id, row_number() over (partition by conv_id order by rank) as place, used from f where kept""")
def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return S.within_budget(turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("id"), F.col("turn").alias("rank"), T.approx_tokens(F.col("text")).alias("cost")), 300)


@query("""with e as (select event_id as id, user_id as query_id, ts, value as score, (epoch(max(ts) over (partition by user_id)) - epoch(min(ts) over (partition by user_id))) / 86400.0 as span from events),
b as (select *, case when span > 365 then strftime(ts, '%Y') when span > 45 then strftime(ts, '%Y-%m') when span > 7 then isoyear(ts) || '-W' || lpad(cast(week(ts) as varchar), 2, '0') else strftime(ts, '%Y-%m-%d') end as bucket from e),
r as (select *, row_number() over w as round, max(score) over (partition by query_id, bucket) as top, first_value(id) over w as first from b window w as (partition by query_id, bucket order by score desc, id))
select id, query_id, bucket, row_number() over (partition by query_id order by round, top desc, first, score desc, id) as place from r""")
def bucket_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("query_id"), "ts", F.col("value").alias("score"))
    return S.spread(rows).select("id", "query_id", "bucket", "place")


# Scores of ranked hits: events of a user are the hits of a query, their type is the channel.
_RANKED = "(select event_id, user_id, event_type, value, ts, row_number() over (partition by user_id order by value desc, event_id) as rank, count(*) over (partition by user_id) as n, max(value) over (partition by user_id) as top, case event_type when 'purchase' then 0 when 'signup' then 1 when 'click' then 3 when 'view' then 4 else 5 end as tier from events) h"
_D = num
plain("u_curve", "select event_id, user_id, case when (rank - 1) % 2 = 0 then cast(floor((rank - 1) / 2) as bigint) else n - 1 - cast(floor((rank - 2) / 2) as bigint) end as place from " + _RANKED)
plain("fact_cap", f"select event_id, user_id, rank from (select *, sum(case when event_type in ('purchase', 'signup') then 1 else 0 end) over (partition by user_id order by rank) as facts from {_RANKED}) x where event_type not in ('purchase', 'signup') or facts <= 3")
plain("learning_turns", "select conv_id, turn from (select conv_id, turn, role, text, row_number() over (partition by role, text, conv_id order by turn) as nth from conversations where text is not null) x where role <> 'user' or nth = 1")
_ACT = f"least({_D(1.0)}, ln(1 + demand) / ln({_D(11.0)}))"
plain("activation", f"""select event_id, user_id, round(value * (0.5 + greatest({_D(0.0)}, least({_D(1.0)}, ({_D(0.10)} * base + {_D(0.55)} * value / greatest(top, {_D(0.01)}) + {_D(0.20)} * {_D(0.7)} * (1 - tier / {_D(5.0)}) + {_D(0.15)} * recency)))), 6) as score from
  (select *, {_ACT} as base, power({_D(0.5)}, age / {_D(30.0)}) as recency from (select h.*, 0 as demand, (⟦unix_micros(timestamp '2024-01-31 00:00:00') - unix_micros(cast(ts as timestamp))¦epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts)⟧) / {_D(86400000000.0)} as age from {_RANKED}) y) x""")
# Hits that share a day or a type: those of the day, and those of the type, less those of both; no pairs are made.
plain("spreading_activation", """select event_id, round(case when n <= 1 then 0 else (days + types - twice - 1) / cast(n - 1 as double) end, 6) as spreading from
  (select event_id, count(*) over (partition by user_id) as n, count(*) over (partition by user_id, cast(ts as date)) as days, count(*) over (partition by user_id, event_type) as types, count(*) over (partition by user_id, cast(ts as date), event_type) as twice from events) x""")
_QUALITY = f"({_D(0.03)} + {_D(0.25)} * value / greatest(top, {_D(0.01)}) + {_D(0.35)} * (1 - tier / {_D(5.0)}) + {_D(0.10)} / 3 + {_D(0.27)} / 3) * ({_D(0.55)} + {_D(0.45)} * (1 - tier / {_D(5.0)}))"
plain("decision_confidence", f"""select user_id, round(case when support < {_D(2.0)} / 3 then greatest({_D(0.0)}, least({_D(0.91)}, eq * ({_D(1.28)} + {_D(0.14)} * (1 - support / ({_D(2.0)} / 3)))))
    else greatest({_D(0.0)}, least({_D(0.91)}, eq * ({_D(1.21)} + {_D(0.10)} * (support - {_D(2.0)} / 3) / ({_D(1.0)} - {_D(2.0)} / 3) + {_D(0.04)} * strength))) end, 6) as confidence from
  (select user_id, n, (n % 10) / {_D(10.0)} as support, case when top > 1 then least({_D(1.0)}, ln(1 + top) / ln({_D(13.0)})) else greatest({_D(0.25)}, top) end as strength,
    greatest({_D(0.0)}, least({_D(1.0)}, q * ({_D(0.90)} + {_D(0.10)} * greatest({_D(0.0)}, least({_D(1.0)}, (top - second) / greatest(top, {_D(0.01)})))) * ({_D(0.85)} + {_D(0.15)} * least(n / {_D(3.0)}, {_D(1.0)})))) as eq from
    (select user_id, max(n) as n, max(top) as top, max(case when rank = 2 then value end) as second, sum(greatest({_D(0.0)}, least({_D(1.0)}, quality)) * w) / greatest(sum(w), {_D(0.01)}) as q from
      (select *, {_QUALITY} as quality, (value / greatest(top, {_D(0.01)}) + {_D(0.01)} / greatest(top, {_D(0.01)})) / rank as w from {_RANKED}) a group by user_id having max(n) >= 4) b) c""")
plain("schema_boost", f"select event_id, user_id, row_number() over (partition by user_id order by boosted desc, hit desc, rank) as place, boosted as score from (select *, event_type = 'signup' as hit, round(value + case when event_type = 'signup' then {_D(1.25)} else 0 end, 6) as boosted from {_RANKED}) x")
plain("collapsed_turns", """with rec as (select doc_id, source, text, n_chars / 1000.0 as score from documents where text is not null), work as (select doc_id + 1000000 as id, doc_id as cites, text, 0.25 as score from documents where doc_id % 3 = 0 and text is not null)
select rec.doc_id, cast(round(rec.score + coalesce(sum(work.score), 0), 6) as double) as score, count(work.id) as absorbed from rec left join work on work.cites = rec.doc_id and trim(work.text) = trim(rec.text) group by rec.doc_id, rec.score""")
plain("covered_sources", """with obs as (select distinct min(doc_id) over (partition by text) as observation, doc_id as cid from documents where text is not null), multi as (select observation from obs group by observation having count(*) > 1)
select doc_id, n_chars from documents d where not exists (select 1 from obs join multi on obs.observation = multi.observation where obs.cid = d.doc_id and obs.cid <> obs.observation)""")
plain("dated_hits", "select e.event_id, e.user_id, o.o_orderdate as dated, c.c_name as origin from events e left join orders o on o.o_orderkey = e.event_id left join customer c on c.c_custkey = o.o_custkey")
plain("prefetch_candidates", "select user_id, event_type, next_type, n, round(n / cast(total as double), 6) as p from (select user_id, event_type, next_type, count(*) as n, sum(count(*)) over (partition by user_id, event_type) as total from (select user_id, event_type, lead(event_type) over (partition by user_id order by ts, event_id) as next_type from events) x where next_type is not null group by user_id, event_type, next_type) y where n / cast(total as double) >= 0.3 and total >= 5")


@query("""with recursive t as (select conv_id, turn, length(text) as size, row_number() over (partition by conv_id order by turn) as rank from conversations where text is not null),
f(conv_id, rank, turn, window_no, used, items) as (select conv_id, rank, turn, cast(1 as bigint), cast(size as bigint), cast(1 as bigint) from t where rank = 1
  union all select t.conv_id, t.rank, t.turn, case when items >= 4 or used + size > 1500 then window_no + 1 else window_no end, case when items >= 4 or used + size > 1500 then size else used + size end, case when items >= 4 or used + size > 1500 then 1 else items + 1 end
  from f join t on t.conv_id = f.conv_id and t.rank = f.rank + 1) select conv_id, turn, window_no from f""")
def provider_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in windows of at most 4 turns and 1500 characters, but one turn at least."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("size")))).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("items"), F.array().cast("array<struct<turn: bigint, w: bigint>>").alias("out"))

    def step(s, x):
        full = (s["w"] == 0) | (s["items"] >= 4) | (s["used"] + x["size"] > 1500)
        w = F.when(full, s["w"] + 1).otherwise(s["w"])
        return F.struct(w.alias("w"), F.when(full, x["size"]).otherwise(s["used"] + x["size"]).alias("used"), F.when(full, F.lit(1).cast("long")).otherwise(s["items"] + 1).alias("items"), F.concat(s["out"], F.array(F.struct(x["turn"].alias("turn"), w.alias("w")))).alias("out"))

    return turns.select("conv_id", F.explode(F.aggregate("t", start, step, lambda s: s["out"])).alias("o")).select("conv_id", "o.turn", F.col("o.w").alias("window_no"))


@query()
def local_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by 0.55 * lexical score and 0.45 * cosine of hashed embeddings with the query, 0 at least."""
    asked = spark.range(1).select(T.tokenize(F.lit(QUERY)).alias("q"))
    q = list(asked.first()["q"])  # the query's own tokens
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("tokens")).join(F.broadcast(asked))
    hits = F.filter("tokens", lambda t: F.array_contains(F.col("q"), t))
    lexical = T.let(hits, lambda own: R.lexical_score(F.col("q"), own, F.size("tokens")))
    own = words.likeness(rows.select("doc_id", lexical.alias("lexical"), "tokens"), words.hashed(q, 256).tolist(), 256)
    score = F.greatest(F.lit(0.0), 0.55 * F.col("lexical") + 0.45 * F.col("score"))
    return own.select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query()
def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for a question, from the channels to the decision whether to answer."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tier = F.when(F.col("toxic") == 1, 5).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 3).otherwise(2)
    rows = d.join(l, "doc_id", "left").select("doc_id", "text", tier.alias("tier"), (F.col("doc_id") % 5).cast("int").alias("sensitivity"), F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 30 as int))").alias("ts"))
    return search.retrieve(rows, QUERY, datetime(2024, 1, 31), index=index(spark, sf_dir))


_PROSE = "case o_orderkey % 5 when 0 then 'sent on ' || {iso} || ' by mail' when 1 then 'due ' || {month} || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) when 2 then 'it was ' || day(o_orderdate) || ' ' || {month} || ' ' || year(o_orderdate) when 3 then 'we talked ' || (o_orderkey % 9) || ' days ago' else 'nothing said' end"


@query("select o_orderkey, coalesce(cast(day0 as varchar), 'none') as day from (select o_orderkey, case o_orderkey % 5 when 0 then cast(o_orderdate as date) when 1 then cast(o_orderdate as date) when 2 then cast(o_orderdate as date) when 3 then cast(o_orderdate as date) - cast(o_orderkey % 9 as int) end as day0 from orders)")
def prose_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that sentences about orders name."""
    said = F.expr(_PROSE.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", month="date_format(o_orderdate, 'MMMM')"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"), F.col("o_orderdate").cast("date").alias("on"))
    return o.select("o_orderkey", F.coalesce(dates.prose_date(F.col("said"), F.col("on")).cast("string"), F.lit("none")).alias("day"))


@query("""select event_id, round(case when ts >= timestamp '2024-01-22' and ts < timestamp '2024-01-29' then 1.35 else 0.65 + 0.35 / (1 + case when ts < timestamp '2024-01-22' then floor(epoch(timestamp '2024-01-22')) - floor(epoch(ts)) else floor(epoch(ts)) - floor(epoch(timestamp '2024-01-29')) end / 86400.0 / 7.0) end, 6) as factor from events""")
def window_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the span of "What happened last week?" weighs events, asked on 31 January 2024."""
    start, end, _ = dates.window("What happened last week?", datetime(2024, 1, 31))
    return table(spark, sf_dir, "events").select("event_id", F.round(dates.window_factor(F.col("ts").cast("timestamp"), start, end), 6).alias("factor"))


# Turns that begin with a commitment, or a question about the past; said in January 2024 and after, in UTC.
_SAID_AT = "timestamp '2024-01-15 10:00:00' + interval 1 day * (conv_id % 40)"
_COMMITS = "case (conv_id * 3 + turn) % 8 when 0 then 'I will call Ann tomorrow at 5pm. ' when 1 then 'Pay the rent by ' || {iso} || '. ' when 2 then 'We plan to meet in three weeks. ' when 3 then 'Finish it this Friday. ' when 4 then 'Remind me on Friday. ' when 5 then 'Call in 90 minutes. ' when 6 then 'Submit the form tomorrow at 5. ' else '' end"
_ASKS = "case (conv_id * 3 + turn) % 6 when 0 then 'What did I say yesterday morning? ' when 1 then 'What did we discuss last week? ' when 2 then 'What did you tell me three days ago? ' when 3 then 'What did I write in March 2023? ' when 4 then 'What did I buy on Friday? ' else 'What did I do as of 2024-01-02? ' end"


def _said(spark: SparkSession, sf_dir: str, words: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").withColumn("said_at", F.expr("timestamp_ntz '2024-01-15 10:00:00' + make_dt_interval(cast(conv_id % 40 as int))"))
    text = F.concat(F.expr(words.format(iso="date_format(date_add(cast(said_at as date), 10), 'yyyy-MM-dd')")), F.coalesce("text", F.lit("")))
    return own.select("conv_id", "turn", "said_at", text.alias("text"), F.lit("UTC").alias("zone"))


@query(f"""with s as (select conv_id, turn, (conv_id * 3 + turn) % 8 as k, {_SAID_AT} as at_, cast({_SAID_AT} as date) as d from conversations),
w as (select *, case k when 0 then d + 1 when 1 then d + 10 when 2 then d + 21 when 3 then d + cast((5 - isodow(d) + 7) % 7 as int) end as due from s)
select conv_id, turn, coalesce(case k when 0 then 'tomorrow' when 1 then 'iso' when 2 then 'offset' when 3 then 'weekday' when 4 then 'weekday' when 5 then 'offset' when 6 then 'tomorrow' end, '') as rule, case when k in (4, 6) then 'ambiguous' when k = 7 then 'unknown' else 'resolved' end as status,
  case k when 4 then 'weekday_reference_ambiguous' when 6 then 'meridiem_required' else '' end as reason, case when k in (0, 5) then 'instant' when k = 7 then 'unknown' else 'day' end as precision,
  case k when 0 then cast(due as timestamp) + interval 17 hour when 5 then at_ + interval 90 minute else cast(due as timestamp) end as due_start, case k when 0 then cast(due as timestamp) + interval 17 hour when 5 then at_ + interval 90 minute else cast(due + 1 as timestamp) end as due_end from w""")
def commitment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When what turns commit to is due."""
    own = times.commitment_times(_said(spark, sf_dir, _COMMITS), "text", "said_at", "zone")
    none = lambda c: F.coalesce(f"due.{c}", F.lit("")).alias(c)
    return own.select("conv_id", "turn", none("rule"), "due.status", none("reason"), "due.precision", F.col("due.start").alias("due_start"), F.col("due.end").alias("due_end"))


@query(f"""with s as (select conv_id, turn, (conv_id * 3 + turn) % 6 as k, cast({_SAID_AT} as date) as d from conversations), w as (select *, date_trunc('week', d)::date as monday, cast((isodow(d) - 5 + 7) % 7 as int) as back from s)
select conv_id, turn, coalesce(case k when 0 then 'yesterday morning' when 1 then 'last week' when 2 then 'three days ago' when 3 then 'march 2023' when 4 then 'friday' end, '') as label,
  case k when 0 then cast(d - 1 as timestamp) + interval 5 hour when 1 then cast(monday - 7 as timestamp) when 2 then cast(d - 3 as timestamp) when 3 then timestamp '2023-03-01 00:00:00' when 4 then cast(d - back as timestamp) end as span_start,
  case k when 0 then cast(d - 1 as timestamp) + interval 12 hour when 1 then cast(monday as timestamp) when 2 then cast(d - 2 as timestamp) when 3 then timestamp '2023-04-01 00:00:00' when 4 then cast(d - back + 1 as timestamp) end as span_end from w""")
def time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that questions about the past ask for."""
    own = times.time_windows(_said(spark, sf_dir, _ASKS), "text", "said_at", "zone")
    return own.select("conv_id", "turn", F.coalesce("asked.label", F.lit("")).alias("label"), F.col("asked.start").alias("span_start"), F.col("asked.end").alias("span_end"))
