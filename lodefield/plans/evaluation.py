"""Measures of answers: latencies, calibration, rankings, correlations, posteriors, sets of a kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.ledger import deduplicated
from .registry import num, plain, query, table

N = num


@query("select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, round(avg(value), 6) as mean, max(value) as top from events group by event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return got.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean")), "top")


_SCORED = f"(select l.doc_id, l.quality, least({N(1.0)}, d.n_chars / {N(4000.0)}) as conf, d.source, l.toxic from labels l join documents d on l.doc_id = d.doc_id) x"
plain("calibration_error", f"select bin, count(*) as n, round(avg(cast(quality as double)), 6) as accuracy, round(avg(conf), 6) as confidence, round(abs(avg(cast(quality as double)) - avg(conf)), 6) as gap from (select *, greatest(cast(ceil(conf * 10) as int), 1) as bin from {_SCORED}) b group by bin")
plain("expected_error", f"select round(sum(abs(hits - total)) / sum(n), 6) as ece, count(*) as bins from (select greatest(cast(ceil(conf * 10) as int), 1) as bin, count(*) as n, sum(quality) as hits, sum(conf) as total from {_SCORED} group by greatest(cast(ceil(conf * 10) as int), 1)) b")
plain("expected_error_clamped", f"select round(coalesce(sum(abs(hits - total)) / sum(n), 0), 6) as ece, count(*) as bins from (select least(9, cast(floor(greatest({N(0.0)}, least({N(1.0)}, conf)) * 10) as int)) as bin, count(*) as n, sum(quality) as hits, sum(conf) as total from {_SCORED} group by least(9, cast(floor(greatest({N(0.0)}, least({N(1.0)}, conf)) * 10) as int))) b")
_Z = f"{N(3.8416)}"


@query(f"select source, n, round(greatest(0, (p + {_Z} / (2 * n) - 1.96 * sqrt((p * (1 - p) + {_Z} / (4 * n)) / n)) / (1 + {_Z} / n)), 6) as low, round(least(1, (p + {_Z} / (2 * n) + 1.96 * sqrt((p * (1 - p) + {_Z} / (4 * n)) / n)) / (1 + {_Z} / n)), 6) as high from (select source, count(*) as n, sum(quality) / count(*)::double as p from {_SCORED} group by source)")
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return rows.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""with s as (select q.vec_id as query_id, e.vec_id as id, e.label, q.label as want, list_sum(list_transform(range(1, 65), lambda i: cast(e.embedding[i] as double) * cast(q.embedding[i] as double))) as score from embeddings e, embeddings q where q.vec_id in (select min(vec_id) from embeddings group by label) and e.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s), need as (select query_id, count(*) as need from s where label = want group by query_id),
g as (select query_id, count(*) as found, sum(1 / log2(rank + 1)) as dcg from r where rank <= 10 and label = want group by query_id)
select need.query_id, round(coalesce(found, 0) / need::double, 6) as recall, round(coalesce(dcg, 0), 6) as dcg, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(need, 10) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg from need left join g on g.query_id = need.query_id""")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("query_id")).withColumnRenamed("label", "want")
    both = e.join(F.broadcast(q), F.col("vec_id") != F.col("query_id"))
    scored = both.select("query_id", F.col("vec_id").alias("id"), F.round(R.dot(F.col("embedding"), F.col("q")), 9).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 10")
    got = E.ranking_scores(ranked, both.where("label = want").select("query_id", F.col("vec_id").alias("id")), 10)
    return got.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "dcg", "ndcg")))


@query()
def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", F.col("doc_id").alias("seq"), "quality"), "source", "quality", iterations=500)


@query()
def bootstrap_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.bootstrap(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", F.col("doc_id").alias("seq"), "n_chars"), "lang", "n_chars", q=0.95, iterations=200, seed=4321)


@query("""with v as (select doc_id, n_chars as a, length(text) - length(replace(text, ' ', '')) as b from documents where text is not null), r as (select (rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0) as ra, (rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0) as rb, a, b from v)
select round(case when stddev_pop(ra) = 0 or stddev_pop(rb) = 0 then 0 else corr(ra, rb) end, 6) as spearman, round(case when stddev_pop(a) = 0 or stddev_pop(b) = 0 then 0 else corr(a, b) end, 6) as pearson, count(*) as n from r""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").where("text is not null").select(F.col("n_chars").alias("a"), (F.length("text") - F.length(F.replace("text", F.lit(" ")))).alias("b"))
    r = E.average_ranks(E.average_ranks(v, "a", "ra"), "b", "rb")
    flat = lambda x, y: F.when((F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0), 0.0).otherwise(F.corr(x, y))
    return r.agg(F.round(flat("ra", "rb"), 6).alias("spearman"), F.round(flat("a", "b"), 6).alias("pearson"), F.count(F.lit(1)).alias("n"))


plain("block_rates", f"select source, round(greatest(0, least(blocked, total)) / cast(total as double), 6) as block_rate, round((good - bad) / cast(total as double), 6) as lift from (select source, count(*) as total, sum(toxic) as blocked, sum(quality) as good, sum(1 - quality) as bad from {_SCORED} group by source) y")
plain("linear_trend", f"select user_id, round(case when count(*) < 2 then 0 else sum((nth - mid) * (value - mean)) / sum((nth - mid) * (nth - mid)) end, 6) as slope from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as nth, avg(value) over (partition by user_id) as mean, (count(*) over (partition by user_id) - 1) / {N(2.0)} as mid from events) x group by user_id")
_LOW = lambda k, n: f"greatest({N(0.0)}, ({k} / {n} + {_Z} / (2 * {n}) - {N(1.96)} * sqrt(({k} / {n} * (1 - {k} / {n}) + {_Z} / (4 * {n})) / {n})) / (1 + {_Z} / {n}))"
_HIGH = lambda k, n: f"least({N(1.0)}, ({k} / {n} + {_Z} / (2 * {n}) + {N(1.96)} * sqrt(({k} / {n} * (1 - {k} / {n}) + {_Z} / (4 * {n})) / {n})) / (1 + {_Z} / {n}))"
plain("posteriors", f"select source, round(1 + good, 6) as alpha, round(1 + n - good, 6) as beta, round((1 + good) / (2 + n), 6) as mean, round((1 + good) * (1 + n - good) / ((2 + n) * (2 + n) * (3 + n)), 9) as variance, round({_LOW('good', 'n')}, 6) as lower_bound from (select source, sum(quality * w) as good, sum(w) as n from (select *, {N(0.5)} + conf / 2 as w from {_SCORED}) a group by source) y")
plain("contingency", f"select source, case when least(n1, n0) < 8 then null else round({_LOW('k1', 'n1')} - {_HIGH('k0', 'n0')}, 6) end as bound from (select source, sum(case when toxic = 0 then cast(quality as double) else 0 end) as k1, sum(case when toxic = 0 then {N(1.0)} else 0 end) as n1, sum(case when toxic = 1 then cast(quality as double) else 0 end) as k0, sum(case when toxic = 1 then {N(1.0)} else 0 end) as n0 from {_SCORED} group by source) y where n1 > 0 and n0 > 0")


@query()
def prob_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    own = rows.groupBy(F.col("source").alias("key")).agg((1.0 + F.sum("quality")).alias("a"), (1.0 + F.sum(1 - F.col("quality"))).alias("b"))
    return E.probability_better(own.withColumn("c", F.lit(3.0)).withColumn("d", F.lit(3.0)))


plain("semantic_entropy", f"select user_id, round(case when count(*) <= 1 then 0 else -sum(p * ln(p) / ln({N(2.0)})) / (ln(cast(count(*) as double)) / ln({N(2.0)})) end, 6) as entropy from (select user_id, event_type, count(*) / cast(sum(count(*)) over (partition by user_id) as double) as p from events group by user_id, event_type) x group by user_id")
plain("vector_widths", "select width, n from (select width, n, row_number() over (order by n desc, width) as place from (select ⟦size(embedding)¦cast(len(embedding) as int)⟧ as width, count(*) as n from embeddings group by 1) x) y where place = 1")
plain("source_counts", "select user_id, case when count(distinct origin) = 0 then 0 else greatest(1, count(distinct origin)) end as sources from (select user_id, case when event_type <> 'error' then coalesce(case when event_id % 3 = 0 then event_type end, cast(cast(ts as date) as ⟦string¦varchar⟧), cast(event_id as ⟦string¦varchar⟧)) end as origin from events) x group by user_id")
plain("reality_classes", "select user_id, case when min(rank) = 4 and max(rank) = 4 then 'grounded' when min(rank) = 1 then 'self_generated' when min(rank) = 2 then 'simulated' when min(rank) = 3 then 'externally_suggested' else 'unknown' end as reality from (select user_id, case event_type when 'error' then 1 when 'view' then 2 when 'click' then 3 else 4 end as rank from events where event_id % 4 = 0) x group by user_id")
_ROOTS = f"(select l_partkey, l_suppkey, l_orderkey, l_linenumber, case when l_returnflag = 'R' then 3 when l_returnflag = 'A' then 1 else 2 end as tier, case when l_linestatus = 'O' and l_quantity < 5 then 'self_generated' when l_quantity > 48 then 'quarantined' else null end as bad from lineitem) x"
plain("corroboration", f"select l_partkey, round(least(sum(case when nth = 1 then 1 - tier / {N(5.0)} else 0 end), {N(5.0)}) / {N(5.0)}, 6) as score, count(case when nth = 1 then 1 end) as roots, count(case when nth > 1 then 1 end) as duplicates from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) as nth from {_ROOTS} where bad is null) y group by l_partkey")


@query("""with s as (select least(1.0, round(n_chars / 4000.0, 2)) as x, quality as y from labels join documents on labels.doc_id = documents.doc_id), g as (select x, sum(y) as t, count(*) as n from s group by x),
c as (select x, sum(t) over (order by x) as ct, sum(n) over (order by x) as cn, t, n from g),
m as (select a.x as lo, b.x as hi, (b.ct - a.ct + a.t) / (b.cn - a.cn + a.n)::double as mean from c a join c b on a.x <= b.x)
select g.x::double as x, round(max(low), 6) as y from g join (select lo, x, min(mean) as low from (select m.lo, g.x, m.mean from m join g on m.lo <= g.x and m.hi >= g.x) group by lo, x) w on w.x = g.x group by g.x""")
def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.round(F.col("n_chars") / 4000.0, 2).alias("s"), "quality")
    return E.isotonic(rows, "s", "quality").select("x", F.round("y", 6).alias("y"))


@query()
def isotonic_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated quality of every document, by its length."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 4000.0).alias("s"))
    knots = E.isotonic(table(spark, sf_dir, "labels").join(d, "doc_id"), "s", "quality")
    return E.interpolated(d, knots, "s").select("doc_id", F.round("y", 6).alias("y"))


@query("""with s as (select greatest(0.0::double, least(1.0::double, n_chars / 4000.0::double)) as s from labels join documents on labels.doc_id = documents.doc_id where quality = 1),
r as (select s, row_number() over (order by s) as nth, count(*) over () as n from s), t as (select s as threshold from r where nth = least(n - 1, greatest(0, cast(floor((n + 1) * (1.0::double - 0.9::double)) as bigint) - 1)) + 1)
select doc_id % 50 as query_id, count(case when c >= threshold then 1 end) as size, count(case when c >= threshold then 1 end) = 0 or count(case when c >= threshold then 1 end) > 3 as abstains from (select doc_id, least(1.0::double, n_chars / 4000.0::double) as c from documents), t group by doc_id % 50""")
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group of candidates, how many reach the threshold of the calibration set, and whether that means no answer."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("c"))
    t = E.conformal_threshold(table(spark, sf_dir, "labels").where("quality = 1").join(d, "doc_id"), "c", 0.9)
    size = F.count(F.when(F.col("c") >= F.col("threshold"), 1))
    return d.join(F.broadcast(t)).groupBy((F.col("doc_id") % 50).alias("query_id")).agg(size.alias("size"), ((size == 0) | (size > 3)).alias("abstains"))


plain("fused_confidence", f"select doc_id, round(greatest({N(0.0)}, least({N(1.0)}, {N(0.35)} * conf + {N(0.20)} * (1 - (doc_id % 5) / {N(5.0)}) + {N(0.20)} * ((doc_id % 3) / {N(2.0)}) + {N(0.15)} * quality + {N(0.10)} * (1 - toxic))), 9) as confidence from {_SCORED}")
_SPENT = "(select l_partkey, l_orderkey, l_linenumber, l_extendedprice as cost, p_type, p_name, case when p_type like '%BRASS%' or p_type like '%a%' then 1 else 0 end as borderline from lineitem join part on p_partkey = l_partkey) x"
plain("set_aggregate", f"select l_partkey, count(case when borderline = 0 then 1 end) as strict_count, count(*) as inclusive_count, round(sum(case when borderline = 0 then cost else 0 end), 2) as strict_sum, round(sum(cost), 2) as inclusive_sum from {_SPENT} group by l_partkey")


@query()
def ledger_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's purchases without those that say the same: by key, else by name with one amount or one without any."""
    o = table(spark, sf_dir, "orders")
    return deduplicated(o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"), F.concat_ws("-", "o_orderstatus", F.floor(F.col("o_totalprice") / 50000)).alias("key"), F.concat(F.lit("the "), F.col("o_orderpriority")).alias("entity"), F.when(F.col("o_orderkey") % 3 != 0, F.round("o_totalprice", -4)).alias("value"), F.repeat(F.lit("q"), (F.col("o_orderkey") % 7).cast("int")).alias("quote")))

