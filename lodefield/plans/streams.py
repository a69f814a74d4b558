"""Streams over the event files, drained to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digests as DG
from ..operators import postings
from ..operators.lineage import new_path
from ..streaming import prospective as PR
from ..streaming import streams as S
from .registry import index, plain, query, table
from .texts import duck_tokens

_SESSIONS = """with m as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events), s as (select *, sum(case when prev is null or ts >= prev + interval 2 hour then 1 else 0 end) over (partition by user_id order by ts, event_id) as nth from m),
g as (select user_id, min(ts) as session_start, max(ts) + interval 2 hour as session_end, count(*) as n from s group by user_id, nth)"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(spark, sf_dir)


@query(_SESSIONS + " select user_id, session_start, session_end, n from g where session_end <= (select max(ts) - interval 1 hour from events)")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.sessions(stream(spark, sf_dir)))


@query("select day as window_start, event_type, count(*) as n, round(sum(value), 6) as total from (select *, date_trunc('day', ts) as day from events) where day + interval 1 day <= (select max(ts) - interval 1 hour from events) group by day, event_type")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.counts(stream(spark, sf_dir)))


@query("""with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type = 'purchase' and value >= 60),
f as (select user_id, i, event_id, ts, cast(0 as bigint) as occurrence, ts + interval 3 day as due, true as fired from e where i = 1
  union all select e.user_id, e.i, e.event_id, e.ts, f.occurrence + case when f.occurrence < 4 and e.ts >= f.due then 1 else 0 end, case when f.occurrence < 4 and e.ts >= f.due then f.due + interval 3 day else f.due end, f.occurrence < 4 and e.ts >= f.due from f join e on e.user_id = f.user_id and e.i = f.i + 1)
select user_id, occurrence, event_id, ts as fired_at from f where fired""")
def trigger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.triggers(stream(spark, sf_dir), "purchase", 60.0))


@query(f"""with {duck_tokens()} select t as term, count(distinct doc_id) as df, cast(count(*) as bigint) as tf from tok where doc_id % 7 <> 3 group by t""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an index that a stream of documents has filled, a seventh of which was taken back since."""
    at = new_path(spark, "index")
    S.indexed(S.rows(spark, sf_dir, "documents").select("doc_id", "text"), at)
    postings.retire(table(spark, sf_dir, "documents").where("doc_id % 7 = 3").select("doc_id"), at, 1 << 30)
    return postings.term_stats(spark, at)


@query(f"""with {duck_tokens()} select t as term, count(distinct doc_id) as df, cast(count(*) as bigint) as tf from tok group by t""")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of the stored index of documents."""
    return postings.term_stats(spark, index(spark, sf_dir))


_INTENTIONS = """select user_id, cast(1 as bigint) as intention_id, 'event' as kind, 'purchase' as event_type, 60.0::double as least, epoch_us(min(ts)) as due, cast(-1 as bigint) as until, 259200000000 as step, cast(5 as bigint) as most from events group by user_id
  union all select user_id, 2, 'exact_time', '', 0.0, epoch_us(timestamp '2024-01-05 06:30:00') + user_id % 7 * 86400000000, -1, 604800000000, 3 from (select distinct user_id from events) u
  union all select user_id, 3, 'event', 'error', 0.0, epoch_us(timestamp '2024-01-10 00:00:00'), epoch_us(timestamp '2024-01-12 00:00:00'), -1, 1 from (select distinct user_id from events) u"""


@query(f"""with recursive i as ({_INTENTIONS}), top as (select max(ts) - interval 1 hour as mark from events),
e as (select i.*, event_id, epoch_us(ts) as us, row_number() over (partition by i.user_id, intention_id order by ts, event_id) as nth from events join i on events.user_id = i.user_id and events.event_type = i.event_type and value >= least and epoch_us(ts) >= due and (until < 0 or epoch_us(ts) < until), top where kind = 'event' and ts <= mark),
f as (select user_id, intention_id, nth, event_id, us, cast(0 as bigint) as occurrence, due + step as next_due, true as fired, step, most from e where nth = 1
  union all select e.user_id, e.intention_id, e.nth, e.event_id, e.us, f.occurrence + case when g then 1 else 0 end, case when g then f.next_due + e.step else f.next_due end, g, e.step, e.most from f join (select *, 0 as z from e) e on e.user_id = f.user_id and e.intention_id = f.intention_id and e.nth = f.nth + 1, lateral (select e.step > 0 and f.occurrence + 1 < e.most and e.us >= f.next_due as g) x)
select user_id, intention_id, occurrence, event_id, make_timestamp(us) as fired_at from f where fired
union all select user_id, intention_id, k, -1, make_timestamp(due + k * step) from i, (select unnest(range(0, 3)) as k) r, top where kind = 'exact_time' and make_timestamp(due + k * step) <= mark""")
def intention_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three intentions of each user: one that waits for purchases and comes again, one for days, one for an error within
    two days."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    at = lambda text: PR.micros(F.lit(text))
    row = lambda i, kind, event_type, least, due, until, step, most: F.struct(*(F.lit(v).cast(t).alias(n) for (n, t), v in zip((f.split() for f in PR.INTENTIONS.split(", ")), (i, kind, event_type, least, due, until, step, most))))
    day = 86_400_000_000
    rows = F.array(
        row(1, "event", "purchase", 60.0, PR.micros(F.col("first")), -1, 3 * day, 5),
        row(2, "exact_time", "", 0.0, at("2024-01-05 06:30:00") + F.col("user_id") % 7 * day, -1, 7 * day, 3),
        row(3, "event", "error", 0.0, at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"), -1, 1),
    )
    got = S.drained(PR.fired(stream(spark, sf_dir), users.select("user_id", F.explode(rows).alias("r")).select("user_id", "r.*")))
    return got.withColumn("event_id", F.coalesce("event_id", F.lit(-1)))


@query("""with top as (select max(ts) - interval 1 hour as mark from events), e as (select user_id, event_id, ts, lead(ts, 12) over (partition by user_id order by ts, event_id) as pushed from events, top where ts <= mark)
select user_id, event_id, case when pushed < ts + interval 36 hour then 'evicted' else 'expired' end as reason, least(coalesce(pushed, ts + interval 36 hour), ts + interval 36 hour) as left_at from e, top where pushed < ts + interval 36 hour or ts + interval 36 hour <= mark""")
def memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves each user's working memory of twelve items and 36 hours."""
    return S.drained(PR.forgotten(stream(spark, sf_dir), "36 hours", 12))


@query("select event_id, user_id, event_type from events")
def deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.deduplicated(stream(spark, sf_dir))).select("event_id", "user_id", "event_type")


@query("select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as nth from events where ts + interval 10 day > timestamp '2024-01-31 00:00:00') where nth <= 20")
def working_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.working_memory(table(spark, sf_dir, "events"), "2024-01-31 00:00:00", "10 days", 20).select("event_id", "user_id", "ts")


@query("select event_type, count(*) as n, count(distinct user_id) as users from events group by event_type")
def incremental_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings kept up to date batch by batch, and counted."""

    def add(df: DataFrame, batch_id: int, at: str) -> None:
        df.select("event_id", "event_type", "user_id").withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(at)

    got = S.drained(stream(spark, sf_dir).select("event_id", "event_type", "user_id"), batch=add)
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


plain("cadence", "select user_id, count(*) as n, case when count(*) >= 50 then 'hourly' when count(*) >= 20 then 'daily' else 'weekly' end as tier, max(ts) as last_at from events group by user_id")
@query("select source, count(*) as n, sha256(array_to_string(list_sort(list(cast(doc_id as varchar))), ',')) as fingerprint, max(doc_id) as newest from documents group by source")
def model_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source, what tells whether a model of it is out of date: how many documents, a digest of all their numbers,
    sorted, and the newest."""
    d = table(spark, sf_dir, "documents")
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("newest"))
    digests = DG.ids_sha256(d, "source", "doc_id").withColumnRenamed("source", "of")
    return counts.join(digests, F.col("source").eqNullSafe(F.col("of"))).select("source", "n", F.col("sha256").alias("fingerprint"), "newest")
