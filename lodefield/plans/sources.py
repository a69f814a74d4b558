"""Journals, stores, documents, pages, conversations and adapters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..operators import postings
from ..operators.lineage import new_path
from ..sources import journal as J
from ..sources import stores as S
from .registry import index, plain, query, table

plain("change_feed", "select event_id as revision, event_type, user_id from events where event_id > 500")


@query("select event_id, cast(event_id as varchar) as cid, event_type from events where event_id % 100 <> 3")
def journal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, read back, and a copy without what was purged."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("cid"), "event_type")
    at, to, schema = new_path(spark, "journal"), new_path(spark, "journal"), "event_id long, cid string, event_type string"
    for k in (0, 1):
        J.append(e.where(F.col("event_id") % 2 == k), at)
    J.purge(spark, at, to, schema, e.where("event_id % 100 = 3"))
    return J.read(spark, to, schema)


@query("select 'nation' as collection, n_nationkey as key, n_name as name from nation union all select 'region', r_regionkey, r_name from region")
def json_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "store")
    S.persist({"nation": table(spark, sf_dir, "nation"), "region": table(spark, sf_dir, "region")}, at)
    got = S.load(spark, at, {"nation": "n_nationkey int, n_name string", "region": "r_regionkey int, r_name string"})
    return got["nation"].select(F.lit("nation").alias("collection"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).union(got["region"].select(F.lit("region"), "r_regionkey", "r_name"))


@query("select doc_id, case when text is not null then '[REDACTED]' end as text, source from documents where lang = 'de'")
def tenant_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "export")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.col("lang").alias("tenant"))
    S.export(d, at, "de", {"text": "[REDACTED]"})
    return spark.read.schema("doc_id long, text string, source string").json(at)


@query("select sha256(text) as cid, length(any_value(text)) as chars from documents where text is not null group by sha256(text)")
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "blobs")
    d = table(spark, sf_dir, "documents")
    for k in (0, 1):  # the second put adds what is new
        S.put_blobs(d.where(F.col("doc_id") % 3 >= k), "text", at)
    return S.blobs(spark, at).select("cid", F.length(F.col("content").cast("string")).cast("long").alias("chars"))


@query(r"with p as (select doc_id, regexp_replace(text, '((?:\r?\n)[\t ]*(?:\r?\n)(?:[\t ]*\r?\n)*)', '\1' || chr(2), 'g') as t from documents where text is not null), s as (select doc_id, unnest(list_filter(string_split(t, chr(2)), lambda x: x <> '')) as part, generate_subscripts(list_filter(string_split(t, chr(2)), lambda x: x <> ''), 1) as i from p), c as (select doc_id, i, part, unnest(range(0, cast(ceil(length(part) / 512.0) as bigint))) as j from s) select doc_id, row_number() over (partition by doc_id order by i, j) - 1 as nth, substr(part, j * 512 + 1, 512) as chunk from c")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(D.paragraphs(F.col("text"), 512)).alias("nth", "chunk")).withColumn("nth", F.col("nth").cast("long"))


_BLOCK = "br|/p|/div|/li|/h[1-6]|/tr|/title|/section|/article|/header|/footer|/nav|/ul|/ol|/table|/blockquote"


@query(rf"""with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<(noscript|template)\b.*?</(noscript|template)\s*>|<!DOCTYPE[^>]*>', '', 'g') as t from pages),
b as (select page_id, regexp_replace(regexp_replace(t, '(?i)<(?:{_BLOCK})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from a),
c as (select page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') as t from b)
select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from c""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", D.page_text(F.col("html")).alias("text"))


@query("""with d as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null), b as (select doc_id, i, trim(line) as line, cast(floor((i - 1) / 4) as bigint) as nth from d),
m as (select doc_id, nth, max(case when (i - 1) % 4 = 0 then line end) as heading, string_agg(case when (i - 1) % 4 <> 0 then line end, chr(10) order by i) as body from b group by doc_id, nth) select doc_id, nth, heading, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') as body from m""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown, each fourth line a heading, and its blocks."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("# "), F.trim(x))).otherwise(F.trim(x)))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(line, "\n").alias("text"))
    return S.blocks(d, "doc_id").withColumn("nth", F.col("nth").cast("long"))


@query("select o_orderkey, case when o_orderkey % 10 = 0 then 'Z' else o_orderstatus end as o_orderstatus, case when o_orderkey % 4 = 3 then 'added' when o_orderkey % 10 = 0 then 'changed' else 'kept' end as effect from orders")
def source_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held rows after a sync that adds every fourth and changes every tenth."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 10 = 0 or o_orderkey % 4 = 3").withColumn("o_orderstatus", F.expr("case when o_orderkey % 10 = 0 then 'Z' else o_orderstatus end"))
    return S.synced(o.where("o_orderkey % 4 <> 3"), new, ["o_orderkey"])


plain("conversation_rounds", """with t as (select conv_id, turn, case when role = 'user' then 'user' else 'assistant' end as speaker, coalesce(text, '') as text from conversations), n as (select *, lead(speaker) over w as next_speaker, lead(text) over w as next_text, lag(speaker) over w as prev from t window w as (partition by conv_id order by turn))
select conv_id, 'turn' as granularity, turn, text as passage from n where speaker = 'user' union all
select conv_id, 'round', turn, case when speaker = 'user' and next_speaker = 'assistant' then text || chr(10) || next_text else text end from n where speaker = 'user' or prev is null or prev <> 'user' union all
select conv_id, 'session', cast(0 as bigint), ⟦array_join(transform(array_sort(collect_list(struct(turn, text))), x -> x.text), chr(10))¦string_agg(text, chr(10) order by turn)⟧ from t group by conv_id""")


@query(r"""with p as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ps, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2)), lambda x: trim(x)), lambda x: x <> '') as ss from documents where text is not null),
w as (select doc_id, case when len(ps) > 1 then ps when len(ss) > 3 then list_transform(range(0, cast(floor((len(ss) - 1) / 2) as bigint) + 1), lambda i: array_to_string(list_slice(ss, i * 2 + 1, i * 2 + 3), ' ')) else [text] end as ws from p) select doc_id, unnest(ws) as passage, generate_subscripts(ws, 1) - 1 as nth from w""")
def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(D.windows(F.col("text"))).alias("nth", "passage")).withColumn("nth", F.col("nth").cast("long"))


@query()
def adapter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a ranker from outside plugs in: it gets batches of candidates and gives ids and scores; ids that it was not
    given do not come back."""

    def adapter(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": pdf["text"].str.count("the").fillna(0).astype(float) / (1 + pdf["text"].str.len().fillna(0))})

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.mapInPandas(adapter, "doc_id long, score double").join(d.select("doc_id"), "doc_id", "left_semi")


@query()
def passage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by sessions, rounds and turns of a query's words and stems."""
    got = postings.passage_scores(spark, index(spark, sf_dir, "conversations"), "Where does the nation of tion and est go with her money?")
    return got.select("conv_id", *(F.round(c, 6).alias(c) for c in ("session", "best_round", "best_turn", "score")))
