"""Ranks and neighbourhoods in graphs of entities, triggers of intentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import selection as S
from ..operators.lineage import folder, written
from .registry import num, plain, query, table

_EDGES = "p as (select lower(n_name) as a, lower(r_name) as b from nation join region on n_regionkey = r_regionkey union select lower(s_name), lower(n_name) from supplier join nation on s_nationkey = n_nationkey union select lower(c_name), lower(n_name) from customer join nation on c_nationkey = n_nationkey), e as (select a, b from p union select b, a from p)"


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers with their nations, nations with their regions, by lower-cased names."""
    n, r, s, c = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer"))
    low = lambda x, y: (F.lower(x).alias("a"), F.lower(y).alias("b"))
    one = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(*low("n_name", "r_name"))
    two = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(*low("s_name", "n_name"))
    three = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(*low("c_name", "n_name"))
    return one.union(two).union(three).distinct()


_RANKED = f"""with recursive {_EDGES}, d as (select a, b, count(*) over (partition by a) as deg from e),
it as (select 0 as i, node, case when node in ('europe', 'asia') then 1.0::double else 0.0::double end as rank from (select distinct a as node from e)
  union all select i + 1, b, 0.85::double * sum(rank / deg) + case when b in ('europe', 'asia') then 0.15::double else 0.0::double end from it join d on it.node = d.a where i < 12 group by i, b), r as (select node, rank from it where i = 12)"""


@query(_RANKED + " select node, round(rank, 6) as rank from r")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank over customer-supplier-nation-region edges from the seeds europe and asia: each begins with 1, dead ends lose."""
    return G.rank_lossy(entity_edges(spark, sf_dir), F.col("node").isin("europe", "asia")).select("node", F.round("rank", 6).alias("rank"))


@query(_RANKED + """, rel as (select a, b, case when a in ('europe', 'asia') and b in ('europe', 'asia') then 2.0 else greatest(ra.rank, rb.rank) end as score, (a in ('europe', 'asia'))::int + (b in ('europe', 'asia'))::int as seeds from p join r ra on ra.node = p.a join r rb on rb.node = p.b)
select a as source, b as target, round(score, 6) as score from rel order by seeds desc, round(score, 9) desc, a, b limit 24""")
def relation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the number of their ends that are seeds, then by the larger rank of both."""
    pairs = written(entity_edges(spark, sf_dir))
    rank = written(G.rank_lossy(pairs, F.col("node").isin("europe", "asia")))
    of = lambda k: rank.select(F.col("node").alias(k), F.col("rank").alias(f"r{k}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    seeds = F.col("a").isin("europe", "asia").cast("int") + F.col("b").isin("europe", "asia").cast("int")
    score = F.when(seeds == 2, 2.0).otherwise(F.greatest("ra", "rb"))
    return both.select(F.col("a").alias("source"), F.col("b").alias("target"), score.alias("s"), seeds.alias("n")).orderBy(F.desc("n"), F.desc(F.round("s", 9)), "source", "target").limit(24).select("source", "target", F.round("s", 6).alias("score"))


@query(f"with {_EDGES}, seeds as (select distinct a as node from e where a = 'europe'), h1 as (select node from seeds union select b from e join seeds on e.a = seeds.node), h2 as (select node from h1 union select b from e join h1 on e.a = h1.node) select a as source, b as target from p where a in (select node from h2) and b in (select node from h2)")
def hop_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both of whose ends are within two hops of europe."""
    pairs = entity_edges(spark, sf_dir)
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = G.reached(both, spark.createDataFrame([("europe",)], "node string"), hops=2).select("node")
    return pairs.join(near.withColumnRenamed("node", "a"), "a", "left_semi").join(near.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("source"), F.col("b").alias("target"))


@query("""with recursive e as (select distinct l_partkey as a, 1000000 + l_suppkey as b from lineitem), x as (select a, b from e union all select b, a from e), d as (select a, b, 1.0::double / count(*) over (partition by a) as p from x),
z as (select distinct a as node from x), rs as (select node, case when node % 7 = 0 then 1.0::double else 0.0::double end / (select count(*) from z where node % 7 = 0) as reset from z),
it as (select 0 as i, node, reset as rank from rs union all select i + 1, rs.node, 0.5::double * any_value(rs.reset) + 0.5::double * coalesce(sum(case when d.b = rs.node then it.rank * d.p end), 0) from it join d on d.a = it.node join rs on rs.node = d.b where i < 40 group by i, rs.node)
select node, round(rank, 6) as rank from it where i = 40""")
def passage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank over parts and suppliers from every seventh of them: half goes on along edges, half back."""
    l = written(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct())
    both = l.union(l.select("b", "a")).withColumn("weight", F.lit(1.0))
    reset = l.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("reset", (F.col("node") % 7 == 0).cast("double"))
    return G.rank_conserved(both, reset).select("node", F.round("rank", 6).alias("rank"))


@query()
def fact_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors ranked from the five facts nearest to a query: a fact ties two vectors of a label, and scores by them."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    dense = written(e.join(F.broadcast(q)).select(F.col("vec_id").alias("node"), F.col("label").cast("long").alias("label"), R.dot(F.col("embedding"), F.col("q")).alias("s")))
    facts = dense.groupBy("label").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.avg("s").alias("score"))
    low, high = facts.agg(F.min("score"), F.max("score")).first()
    linked = facts.orderBy(F.desc("score"), "label").limit(5).withColumn("w", (F.col("score") - low) / ((high - low) or 1.0))
    ends = linked.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.avg("w").alias("w"))
    least, most = dense.agg(F.min("s"), F.max("s")).first()
    reset = dense.join(F.broadcast(ends), "node", "left").select("node", (0.05 * (F.col("s") - least) / ((most - least) or 1.0) + F.coalesce("w", F.lit(0.0))).alias("reset"))
    hub = facts.select("label", F.col("a").alias("hub"))
    edges = dense.join(F.broadcast(hub), "label").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    edges = edges.union(edges.select("b", "a")).withColumn("weight", F.lit(1.0))
    return G.rank_conserved(edges, reset).select("node", F.round("rank", 8).alias("rank"))


plain("entity_timeline", "select kind, id, happened from (select 'assertion' as kind, o_orderkey as id, cast(o_orderdate as ⟦string¦varchar⟧) as happened, o_custkey as who from orders union all select 'event', event_id, cast(ts as ⟦string¦varchar⟧), user_id from events) x where who = 7".replace("cast(ts as ⟦string¦varchar⟧)", "substr(cast(ts as ⟦string¦varchar⟧), 1, 19)"))
plain("graph_neighbours", "select distinct n.n_name as node, m.n_name as neighbour from supplier s join nation n on s.s_nationkey = n.n_nationkey join nation m on n.n_regionkey = m.n_regionkey and n.n_nationkey <> m.n_nationkey")


@query(_RANKED + " select node, round(rank, 6) as rank from r")
def cached_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pagerank(), kept under a fingerprint of its edges and seeds: read again as long as these are the same."""
    from ..sources.cache import fingerprinted

    edges = entity_edges(spark, sf_dir)
    return fingerprinted(edges, "rank|europe|asia|12|0.85|0.15", lambda: pagerank(spark, sf_dir), folder(spark))


plain("graph_signal", "select node, score from (select n_name as node, cast(n_nationkey as double) as score, count(case when n_name like '%AN%' then 1 end) over () as any_hit from nation) x where any_hit = 0 or node like '%AN%'")

# Intentions: views wait for a purchase of the same user within a day that is worth enough; a replayed signal does not count.
plain("event_triggers", f"""select a.event_id as trigger_id, min(⟦struct¦row⟧(b.ts, b.event_id)).{{}} as fired_by from (select event_id, user_id, ts, ⟦explode(array(cast(ts as date), cast(ts as date) + 1))¦unnest(list_value(cast(ts as date), cast(ts as date) + 1))⟧ as day from events where event_type = 'view') a join events b on a.user_id = b.user_id and cast(b.ts as date) = a.day
  where b.event_type = 'purchase' and b.value / {num(300.0)} >= 0.2 and b.ts >= a.ts and b.ts <= a.ts + interval 1 day group by a.event_id""".replace("min(⟦struct¦row⟧(b.ts, b.event_id)).{}", "⟦min_by(b.event_id, struct(b.ts, b.event_id))¦arg_min(b.event_id, (b.ts, b.event_id))⟧"))
plain("dependencies_met", "select o.o_orderkey from orders o where o.o_orderkey % 2 = 0 and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_linestatus <> 'F') and o.o_orderdate <= timestamp '2000-01-01 00:00:00'")
plain("joined_by_hash", "select d.doc_id, g.vector_of, g.copies from (select doc_id, ⟦sha2(text, 256)¦sha256(text)⟧ as cid from documents where text is not null) d join (select ⟦sha2(text, 256)¦sha256(text)⟧ as cid, min(doc_id) as vector_of, count(*) as copies from documents where text is not null group by 1) g on d.cid = g.cid")
plain("recurrence", """select event_id, n, cast(due as timestamp) as due from (select event_id, ⟦explode(sequence(0, least(cast(event_id % 5 as int), 3)))¦unnest(range(0, least(event_id % 5, 3) + 1))⟧ as n, ts from events where event_type = 'signup') x, (select 0 as z) y where n >= 0""".replace("cast(due as timestamp) as due", "⟦ts + make_interval(0, 0, 0, n * 7)¦ts + to_days(cast(n * 7 as int))⟧ as due"))
@query("""with recursive f as (select o_orderkey as id, o_custkey, o_totalprice as score, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as next_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders),
c as (select id, id as live from f where next_id is null union all select f.id, c.live from f join c on f.next_id = c.id),
h as (select f.o_custkey, f.id, c.live, f.place as spot, f.score from f join c on c.id = f.id where f.place <= 8),
own as (select o_custkey, id, spot, 1 as below, score from h union all select o_custkey, live, min(spot), 0, max(score) from h where live <> id group by o_custkey, live),
best as (select o_custkey, id, min(spot * 2 + below) as spot, max(score) as score, min(below) = 0 as lifted from own group by o_custkey, id)
select o_custkey as query_id, id, cast(row_number() over (partition by o_custkey order by spot, id) as bigint) as place, score, lifted from best""")
def lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's eight largest orders, each of which the next one superseded; the last, which is live, comes above them."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = o.select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("next"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), rank.alias("rank"), F.col("o_totalprice").alias("score")).where("rank <= 8")
    return S.lifted(hits, G.ends(links))

