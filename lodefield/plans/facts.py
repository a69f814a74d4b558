"""Temporal facts: supersession, points in time, arrival of assertions, closures, branches, calendars and decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import belief as B
from ..operators import branches as BR
from ..operators import entities as EN
from ..operators import forgetting as FG
from ..operators import graph as G
from ..operators import justify as J
from ..operators.lineage import written
from ..operators.ranges import least
from ..operators.words import clauses  # noqa: F401  (claims come from clauses)
from .registry import num, plain, query, regex, run_sql, table

_FACTS = "select o_orderkey, o_custkey, o_orderstatus, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to from orders"
plain("supersession", _FACTS)
plain("as_of", f"select o_custkey, o_orderkey, o_orderstatus, valid_from from ({_FACTS}) f where valid_from <= timestamp '1995-06-17 00:00:00' and (valid_to is null or timestamp '1995-06-17 00:00:00' < valid_to)")
_DAYS = "⟦datediff({1}, {0})¦date_diff('day', {0}, {1})⟧"
plain("trajectory_deltas", "select * from (select o_orderkey, o_custkey, cast(greatest(0, " + _DAYS.format("cast(lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date)", "cast(o_orderdate as date)") + ") as int) as days_since, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders) x where prev is not null")

# Assertions: a customer's orders, each a claim about one attribute; every predicate but two is spelt in more than one way.
ASSERTIONS = f"""select o_orderkey as id, o_orderkey as seq, o_custkey as subject, case o_orderpriority when '1-URGENT' then 'Lives in' when '2-HIGH' then 'resides_in' when '3-MEDIUM' then 'likes' when '4-NOT SPECIFIED' then 'does not like' else 'works_at' end as predicate,
  o_orderstatus as object, o_orderdate as valid_from, cast(null as timestamp) as valid_to, (o_orderkey % 7) / {num(10.0)} + {num(0.3)} as confidence, cast(o_orderkey % 3 as int) as tier, ⟦array¦list_value⟧('s' || cast(o_orderkey % 11 as ⟦string¦varchar⟧)) as sources from orders"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import either

    return run_sql(spark, sf_dir, either(ASSERTIONS)[0])


_NEG = r"^(?:(?:do|does|did|am|is|are|was|were)_)?(?:not|never|no_longer)_"
_KEYS = f"""select id, subject, object, valid_from, tier, confidence, case bare {" ".join(f"when '{a}' then '{b}'" for a, b in B.ALIASES.items())} else bare end as key, negative from
  (select *, ⟦regexp_replace(plain, {regex(_NEG)}, '')¦regexp_replace(plain, '{_NEG}', '')⟧ as bare, ⟦plain rlike {regex(_NEG)}¦regexp_matches(plain, '{_NEG}')⟧ as negative from
    (select *, ⟦regexp_replace(lower(trim(predicate)), {regex(r"[ ]+")}, '_')¦regexp_replace(lower(trim(predicate)), '[ ]+', '_', 'g')⟧ as plain from ({ASSERTIONS}) a0) a1) a2"""
_MANY = ", ".join(f"'{p}'" for p in B.ADDITIVE)


@query(f"select id, key, negative, negative or key in ({_MANY}) as additive from ({_KEYS}) k")
def predicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, negative, additive = B.predicate_key(F.col("predicate"))
    return assertions(spark, sf_dir).select("id", key.alias("key"), negative.alias("negative"), additive.alias("additive"))


@query()
def assertion_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.upserted(assertions(spark, sf_dir)).drop("sources", "predicate", "seq", "replaces", "contradicts")


@query()
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after each customer's own correction of the residence, of the best tier, the last to arrive."""
    own = assertions(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    said = c.select((-1 - F.col("c_custkey")).alias("id"), F.lit(1 << 60).alias("seq"), F.col("c_custkey").alias("subject"), F.lit("residence").alias("predicate"), F.col("c_mktsegment").alias("object"),
                    F.lit("2025-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(1.0).alias("confidence"), F.lit(0).alias("tier"), F.array(F.lit("user")).alias("sources"))
    return B.upserted(own.unionByName(said)).where("key = 'residence'").select("id", "subject", "object", "status", "effect", "superseded_by")


# Peers in conflict: they hold at the same time, of the same attribute, and cannot both.
plain("conflicts", f"""select a.id as left_id, b.id as right_id, a.key from ({_KEYS}) a join ({_KEYS}) b on a.subject = b.subject and a.key = b.key and a.id < b.id and a.valid_from < b.valid_from + interval 30 day and b.valid_from < a.valid_from + interval 30 day
  where (a.negative <> b.negative and a.object = b.object) or (a.negative = b.negative and not a.negative and a.object <> b.object and a.key not in ({_MANY}))""")
plain("contested", f"""select id, subject, key, object, round(greatest(confidence, {num(0.01)}) / sum(greatest(confidence, {num(0.01)})) over (partition by subject, key), 6) as probability from ({_KEYS}) k""")
_JUST = "(select o_orderkey as id, cast(floor(o_orderkey / 3) as bigint) as dep, cast(floor(o_orderkey / 5) as bigint) as dep2, case when o_orderstatus = 'P' then 'retracted' when o_orderstatus = 'F' then 'superseded' else 'active' end as status from orders)"
plain("atms_labels", f"""select j.id, case when j.status <> 'active' then 'out' when coalesce(a.status, '') <> 'retracted' or coalesce(b.status, '') <> 'retracted' then 'in' else 'out' end as label from {_JUST} j left join {_JUST} a on a.id = j.dep left join {_JUST} b on b.id = j.dep2""")


@query("""with recursive r as (select cast(3 as bigint) as node, 0 as hop union all select o_orderkey, hop + 1 from r join orders on cast(floor(o_orderkey / 3) as bigint) = node and o_orderkey <> node) select node, hop from r""")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims that rest, directly or not, on the retracted claim 3."""
    edges = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 3).cast("long").alias("a"), F.col("o_orderkey").alias("b")).where("a <> b")
    return G.reached(edges, spark.range(1).select(F.lit(3).cast("long").alias("node")))


# Lines justify their orders: a line's part and supplier name orders that it rests on, a line of a large quantity one more.
_LINES = "(select l_orderkey as assertion_id, l_orderkey * 10 + l_linenumber as justification_id, l_partkey as d1, l_suppkey * 3 as d2, case when l_quantity > 40 then cast(floor(l_orderkey / 2) as bigint) end as d3 from lineitem)"
_CLAIMS = "(select o_orderkey as id, case when o_orderkey % 97 = 5 then 'retracted' when o_orderstatus = 'P' then 'contested' when o_orderkey % 11 = 3 then 'superseded' else 'active' end as status from orders)"


def claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = run_sql(spark, sf_dir, f"select 't' as tenant, 'main' as branch, c.* from {_CLAIMS} c")
    links = run_sql(spark, sf_dir, f"select 't' as tenant, j.* from {_LINES} j")
    return own, links.select("tenant", "justification_id", "assertion_id", F.array_compact(F.array("d1", "d2", "d3")).alias("dependency_ids"))


_LABELS = """broken as (select distinct justification_id from links join st on links.dep = st.id where st.status = 'retracted'), stands as (select assertion_id as id, bool_or(b.justification_id is null) as ok from j left join broken b on b.justification_id = j.justification_id group by assertion_id)"""


@query(f"""with j as {_LINES}, st as {_CLAIMS}, links as (select assertion_id, justification_id, unnest([d1, d2, d3]) as dep from j), {_LABELS}
select st.id, case when st.status in ('active', 'contested') and coalesce(ok, true) then 'in' else 'out' end as label from st left join stands on stands.id = st.id""")
def belief_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims are believed: any justification will do all of whose dependencies stand."""
    return J.labels(*claims(spark, sf_dir)).select("id", "label")


@query(f"""with recursive j as {_LINES}, st0 as {_CLAIMS}, links as (select assertion_id, justification_id, unnest([d1, d2, d3]) as dep from j),
edge as (select distinct dep as a, assertion_id as b from links where dep in (select id from st0) and assertion_id in (select id from st0)),
r as (select id as node from st0 where id % 4001 = 7 union select b from r join edge on a = node), st as (select id, case when id in (select node from r) then 'retracted' else status end as status from st0), {_LABELS}
select st.id, st.status, case when st.status in ('active', 'contested') and coalesce(ok, true) then 'in' else 'out' end as label from st left join stands on stands.id = st.id""")
def belief_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims and what is believed of them after some, and all that rests on them, are retracted."""
    own, links = claims(spark, sf_dir)
    after, _ = J.contracted(own, links, own.where("id % 4001 = 7").select("tenant", "id"), "withdrawn")
    return after.select("tenant", "id", "status").join(J.labels(after, links).hint("shuffle_hash"), ["tenant", "id"]).select("id", "status", "label")


@query()
def branch_merge_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' facts on main and on a copy, both of which go on; the copy is then merged into main."""
    base = assertions(spark, sf_dir).withColumns({"tenant": F.lit("t"), "branch": F.lit("main")})
    kept = ["tenant", "branch", "id", "seq", "subject", "predicate", "object", "valid_from", "valid_to", "confidence", "tier", "sources", "status", "superseded_by", "replaces"]
    main = written(B.upserted(base).where("status <> 'merged'").select(*kept), "main")
    c = table(spark, sf_dir, "customer")

    def more(branch: str, at: int, value, day: str, where: str) -> DataFrame:
        said = c.where(where).select((F.lit(at) - F.col("c_custkey")).alias("id"), (F.lit(1 << 60) + F.col("c_custkey")).alias("seq"), F.col("c_custkey").alias("subject"), F.lit("lives in").alias("predicate"), value.alias("object"))
        return said.withColumns({"tenant": F.lit("t"), "branch": F.lit(branch), "valid_from": F.lit(day).cast(dict(base.dtypes)["valid_from"]), "valid_to": F.lit(None).cast(dict(base.dtypes)["valid_from"]), "confidence": F.lit(0.9), "tier": F.lit(1), "sources": F.array(F.lit("user")), "status": F.lit("active"), "superseded_by": F.lit(None).cast("long"), "replaces": F.lit(None).cast("long")})

    def gone_on(rows: DataFrame, new: DataFrame) -> DataFrame:
        return B.upserted(rows.withColumn("held", F.lit(True)).unionByName(new.withColumn("held", F.lit(False)))).where("status <> 'merged'").select(*kept)

    copy = BR.created(main, "main", "scratch").where("branch = 'scratch'")
    copy = gone_on(copy, more("scratch", -1, F.col("c_mktsegment"), "2024-03-01", "c_custkey % 2 = 0"))
    own = gone_on(main, more("main", -(1 << 40), F.col("c_mktsegment").substr(1, 4), "2024-02-01", "c_custkey % 3 = 0"))
    state, _ = BR.merged_assertions(written(own.unionByName(copy), "branches"), "scratch", "main")
    return state.select("id", "subject", "key", "object", "status", "effect", "valid_to", "superseded_by")


_ROUNDS = 14


@query("""with s as (select doc_id as id, cast(floor(doc_id / 2) as bigint) as source from documents where doc_id > 1 union select doc_id, cast(floor(doc_id / 3) as bigint) from documents where doc_id > 1),
n as (select id, count(*) as need from s group by id), e0 as (select cast(1 as bigint) as id union select 2 union select 5)"""
       + "".join(f", e{k} as (select id from e{k - 1} union select s.id from s join n on n.id = s.id join e{k - 1} on e{k - 1}.id = s.source group by s.id having count(*) = max(need))" for k in range(1, _ROUNDS + 1))
       + f" select id from e{_ROUNDS}")
def erasure_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents that derive from two others each, those with no source left once 1, 2 and 5 are erased."""
    d = table(spark, sf_dir, "documents").where("doc_id > 1")
    of = lambda n: d.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / n).cast("long").alias("source"))
    return G.erased(of(2).union(of(3)), spark.createDataFrame([(1,), (2,), (5,)], "id long"))


# Validity windows: an open order's has no end. Overlapping ones of a customer and status are one.
_WINDOWS = f"select o_custkey, o_orderstatus, o_orderkey, o_orderdate as f, case when o_orderkey % 50 = 7 then null else o_orderdate + interval 90 day end as u, (o_orderkey % 10) / {num(10.0)} as confidence, ⟦array¦list_value⟧('s' || cast(o_orderkey % 5 as ⟦string¦varchar⟧)) as sources from orders"
plain("interval_coalesce", f"""with s as ({_WINDOWS}), m as (select *, max(coalesce(u, timestamp '9999-01-01 00:00:00')) over (partition by o_custkey, o_orderstatus order by f, o_orderkey rows between unbounded preceding and 1 preceding) as seen from s),
g as (select *, sum(case when seen is null or f >= seen then 1 else 0 end) over (partition by o_custkey, o_orderstatus order by f, o_orderkey rows between unbounded preceding and current row) as island from m)
select o_custkey, o_orderstatus, cast(island as bigint) as island, min(f) as valid_from, case when count(*) = count(u) then max(u) end as valid_to, count(*) as n, max(confidence) as confidence,
  ⟦array_join(array_sort(array_distinct(flatten(collect_list(sources)))), ',')¦array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',')⟧ as sources from g group by o_custkey, o_orderstatus, island""")

plain("trajectory", """select o_custkey, o_orderkey, o_orderstatus, valid_from, case when nth = last_live then null else coalesce(valid_to, next_from) end as valid_to, case when nth = last_live then 'CURRENT' when o_orderstatus = 'P' then 'CONTESTED' else 'SUPERSEDED' end as status from
  (select *, max(case when o_orderstatus <> 'P' and valid_to is null then nth end) over (partition by o_custkey) as last_live from
    (select o_custkey, o_orderkey, o_orderstatus, o_orderdate as valid_from, case when o_orderkey % 4 = 0 then o_orderdate + interval 10 day end as valid_to, lead(o_orderdate) over w as next_from, row_number() over w as nth from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) a) b""")

# Calendar differences from a reference day; a month's last day counts as the whole month where the earlier day is later.
_LATE = "⟦last_day(hi)¦last_day(hi)⟧ = hi and day(lo) >= day(hi)"
plain("calendar_delta", f"""select o_orderkey, days, weeks, months, years, case when days = 0 then 'today' when past then n || ' ' || unit || case when n = 1 then '' else 's' end || ' ago' else 'in ' || n || ' ' || unit || case when n = 1 then '' else 's' end end as relative from
  (select *, case when years >= 1 then years when months >= 1 then months when weeks >= 1 then weeks else days end as n, case when years >= 1 then 'year' when months >= 1 then 'month' when weeks >= 1 then 'week' else 'day' end as unit from
    (select o_orderkey, past, cast({_DAYS.format("lo", "hi")} as bigint) as days, cast(floor({_DAYS.format("lo", "hi")} / 7) as bigint) as weeks,
      cast(greatest(0, year(hi) - year(lo) - case when (month(hi) < month(lo) or (month(hi) = month(lo) and day(hi) < day(lo))) and not (month(lo) = month(hi) and {_LATE}) then 1 else 0 end) as bigint) as years,
      cast(greatest(0, (year(hi) - year(lo)) * 12 + month(hi) - month(lo) - case when day(hi) < day(lo) and not ({_LATE}) then 1 else 0 end) as bigint) as months from
      (select o_orderkey, d <= date '1996-02-29' as past, least(d, date '1996-02-29') as lo, greatest(d, date '1996-02-29') as hi from (select o_orderkey, cast(o_orderdate as date) as d from orders) o) p) q) r""")

# Decay and standing.
_NOW = "timestamp '2024-01-31 00:00:00'"
_AGE = f"(⟦unix_micros(cast({_NOW} as timestamp)) - unix_micros(cast(ts as timestamp))¦epoch_us({_NOW}) - epoch_us(ts)⟧) / {num(86400000000.0)}"
N = num
plain("recency", f"""select event_id, round(case event_type when 'error' then {N(0.5)} when 'view' then greatest({N(0.1)}, least({N(1.0)}, 1 - age / {N(60.0)})) when 'click' then least({N(0.5)}, power({N(0.5)}, age / {N(30.0)}))
  when 'signup' then greatest({N(0.35)}, least({N(0.5)}, power({N(0.5)}, age / {N(30.0)}))) else case when age <= 0 then {N(1.0)} else power({N(0.5)}, age / {N(30.0)}) end end, 6) as recency from
  (select event_id, event_type, case when ts > {_NOW} then null when {_AGE} < 60 / {N(86400.0)} then {N(0.0)} else {_AGE} end as age from events) x""")
_SAL = f"greatest({N(0.0)}, least({N(1.0)}, base * case when event_type = 'view' then power(1 + age, -{N(0.5)}) else exp(-age / {N(45.0)}) end + importance * {N(0.35)} + outcome * {N(0.35)}))"
plain("salience", f"""select event_id, round(utility, 6) as salience, not protected and not must_keep and utility <= {N(0.18)} and tier < 3 as demoted, case when not protected and not must_keep and utility <= {N(0.18)} and tier < 3 then tier + 1 else tier end as tier, not protected and not must_keep and utility <= {N(0.18)} and tier < 3 and tier >= 1 as confabulation_risk from
  (select event_id, {_SAL} as utility, protected, must_keep, tier from (select event_id, event_type, coalesce({_AGE}, {N(30.0)}) as age, (event_id % 10) / {N(10.0)} as base, (event_id % 4) / {N(10.0)} as importance, ((event_id % 5) - 3) / {N(10.0)} as outcome, event_id % 17 = 0 as protected, event_id % 13 = 0 as must_keep, cast(event_id % 4 as int) as tier from events) e) x""")


@query("""with u as (select event_id, (event_id % 10) / 10.0 * exp(-((epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts)) / 86400000000.0) / 45.0) as s from events), n as (select cast(floor(0.02 * count(*)) as bigint) as cap from events),
r as (select event_id, round(s, 9) as salience, row_number() over (order by round(s, 9), event_id) as nth from u where s <= 0.18) select event_id, salience from r, n where nth <= cap""")
def lifecycle_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least salient rows below the threshold, no more than a fiftieth of all."""
    e = table(spark, sf_dir, "events")
    age = (F.unix_micros(F.to_timestamp(F.lit("2024-01-31 00:00:00"))) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400000000.0
    s = (F.col("event_id") % 10) / 10.0 * F.exp(-age / 45.0)
    low = e.select("event_id", F.round(s, 9).alias("salience"), s.alias("s")).where("s <= 0.18").drop("s")
    return least(low, ["salience", "event_id"], int(0.02 * e.count()))


plain("rehearsals", f"""select event_id, case least(done, 7) when 0 then 1 when 1 then 3 when 2 then 7 when 3 then 14 when 4 then 30 when 5 then 60 when 6 then 120 else 240 end as days, ts + case least(done, 7) when 0 then interval 1 day when 1 then interval 3 day when 2 then interval 7 day when 3 then interval 14 day when 4 then interval 30 day when 5 then interval 60 day when 6 then interval 120 day else interval 240 day end <= {_NOW} as due
  from (select event_id, ts, cast(event_id % 10 as int) as done from events where event_type in ('purchase', 'signup')) x""")
plain("traces", f"""select event_id, round(share * power({N(0.7)}, turns) * exp(-minutes / {N(30.0)}), 9) as trace, round(greatest({N(0.01)}, least({N(0.5)}, {N(0.3)} * (1 + volatility) / (1 + n / {N(8.0)}))), 9) as rate, round(case when failed then share else share * greatest({N(0.05)}, 1 / (1 + n / {N(10.0)})) end, 9) as step from
  (select event_id, value / {N(300.0)} as share, cast(event_id % 6 as int) as turns, (event_id % 90) / {N(1.0)} as minutes, (event_id % 3) / {N(4.0)} as volatility, (event_id % 40) / {N(1.0)} as n, event_type = 'error' as failed from events) x""")
plain("dynamic_standing", f"""select user_id, sources, round(case when sources <= 0 then {N(0.49)} when against > 0 then greatest({N(0.0)}, least({N(0.99)}, grown - {N(0.15)} * against)) else greatest({N(0.51)}, least({N(0.99)}, grown)) end, 4) as standing, round(greatest({N(0.0)}, least({N(1.0)}, {N(0.25)} + {N(0.3)} * greatest({N(0.0)}, least({N(1.0)}, outcome)) + {N(0.2)} * exp(-{N(0.05)} * hours))), 4) as salience from
  (select *, {N(0.51)} + {N(0.10)} * least(4, greatest(0, sources - 1)) + case when velocity > 0 then {N(0.05)} * tanh(velocity) else 0 end as grown from
    (select user_id, count(distinct case when event_type <> 'error' then cast(ts as date) end) as sources, count(*) / {N(30.0)} as velocity, least(3, count(case when event_type = 'error' then 1 end)) as against, avg(value) / {N(300.0)} as outcome, (⟦unix_micros(cast({_NOW} as timestamp)) - unix_micros(cast(min(ts) as timestamp))¦epoch_us({_NOW}) - epoch_us(min(ts))⟧) / {N(3600000000.0)} as hours from events group by user_id) a) b""")
plain("groundedness", f"""select doc_id, round(case when tier <= 3 then greatest({N(0.51)}, least({N(1.0)}, {N(0.51)} + {N(0.20)} * w + {N(0.14)} * conf + {N(0.10)} * (5 - tier) / {N(5.0)} - {N(0.18)} * pressure - {N(0.10)} * decay)) else greatest({N(0.0)}, least({N(0.49)}, {N(0.08)} + {N(0.08)} * conf + {N(0.06)} * (5 - tier) / {N(5.0)} - {N(0.16)} * pressure - {N(0.08)} * decay)) end, 6) as groundedness from
  (select d.doc_id, case when l.toxic = 1 then 5 when l.quality = 1 then 1 when l.quality = 0 then 3 else 4 end as tier, least(d.doc_id % 7, 5) / {N(5.0)} as w, least({N(1.0)}, n_chars / {N(4000.0)}) as conf, (d.doc_id % 3) / {N(10.0)} as pressure, (d.doc_id % 5) / {N(10.0)} as decay from documents d left join labels l on l.doc_id = d.doc_id) x""")
plain("write_priority", f"""select event_id, round(score, 6) as score, round(greatest(score, least(cap, floor_)), 6) as effective, round(least({N(20.0)}, 1 / greatest(greatest(score, least(cap, floor_)), {N(0.000001)})), 6) as weight from
  (select *, greatest({N(0.0)}, least({N(1.0)}, least(raw, cap))) as score from (select event_id, ({N(0.35)} * (event_id % 10) / {N(10.0)} + {N(0.25)} * {N(0.65)} + {N(0.25)} * (event_id % 7) / {N(7.0)}) as raw, case event_type when 'purchase' then {N(1.0)} when 'signup' then {N(0.9)} when 'click' then {N(0.7)} when 'view' then {N(0.5)} else {N(0.2)} end as cap, case event_type when 'purchase' then {N(0.1)} else {N(0.02)} end as floor_ from events) a) b""")

# A store of documents, two others of which each derives from, claims that labels make of two documents each, and relations of pages.
def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    n = F.col("doc_id")
    of = F.when(n > 1, F.array(name(F.floor(n / 2)), name(F.floor(n / 3)))).otherwise(F.array().cast("array<string>"))
    own = [F.lit("t").alias("tenant"), F.lit("main").alias("branch")]
    evidence = d.select(*own, name(n).alias("cid"), F.col("source").alias("user_id"), F.col("text").alias("content"), F.lit(False).alias("erased"), F.lit(None).cast("array<float>").alias("embedding"), of.alias("sources"))
    claims = l.select(*own, n.alias("id"), F.lit("s").alias("subject"), F.lit("p").alias("predicate"), F.lit("o").alias("object"), F.lit("active").alias("status"), F.array(name(n), name(F.floor(n / 7))).alias("sources"), (n % 3 == 0).alias("conjunctive"))
    p = F.col("page_id")
    relations = table(spark, sf_dir, "pages").select(*own, p.alias("id"), F.lit("a").alias("source"), F.lit("r").alias("predicate"), F.lit("b").alias("target"), F.lit(None).cast("timestamp").alias("valid_to"), F.array(name(p)).alias("sources"))
    return evidence, claims, relations


_FORGOTTEN = """select 'evidence' as collection, 'd' || doc_id as id, {erased} as action, sha256('forgotten-evidence:v1' || chr(31) || 't' || chr(31) || coalesce(source, '') || chr(31) || coalesce(text, '')) as digest from documents where doc_id in (select id from gone)
union all select 'evidence', 'd' || doc_id, 'trimmed', '' from documents where doc_id > 1 and doc_id not in (select id from gone) and (cast(floor(doc_id / 2) as bigint) in (select id from gone) or cast(floor(doc_id / 3) as bigint) in (select id from gone))
union all select 'claims', cast(doc_id as varchar), case when doc_id % 3 = 0 or (doc_id in (select id from gone) and cast(floor(doc_id / 7) as bigint) in (select id from gone)) then 'retracted' else 'trimmed' end, '' from labels where doc_id in (select id from gone) or cast(floor(doc_id / 7) as bigint) in (select id from gone)
union all select 'relations', cast(page_id as varchar), 'expired', '' from pages where page_id in (select id from gone)"""
_DERIVED = """s as (select doc_id as id, cast(floor(doc_id / 2) as bigint) as source from documents where doc_id > 1 union select doc_id, cast(floor(doc_id / 3) as bigint) from documents where doc_id > 1)"""


def _receipt(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    got = FG.forget(*store(spark, sf_dir), spark.createDataFrame([("d1",), ("d2",), ("d5",)], "cid string"), mode)
    return got.receipt.select("collection", "id", "action", F.coalesce("digest", F.lit("")).alias("digest"))


@query(f"with recursive {_DERIVED}, n as (select id, count(*) as need from s group by id), e0 as (select cast(1 as bigint) as id union select 2 union select 5)"
       + "".join(f", e{k} as (select id from e{k - 1} union select s.id from s join n on n.id = s.id join e{k - 1} on e{k - 1}.id = s.source group by s.id having count(*) = max(need))" for k in range(1, _ROUNDS + 1))
       + f", gone as (select id from e{_ROUNDS}) " + _FORGOTTEN.format(erased="'erased'"))
def forget_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt of forgetting three documents: what is emptied, trimmed, retracted and ended."""
    return _receipt(spark, sf_dir, "tombstone")


@query(f"with recursive {_DERIVED}, gone as (select unnest([1, 2, 5]::bigint[]) as id union select s.id from s join gone on s.source = gone.id) " + _FORGOTTEN.format(erased="'removed'"))
def forget_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt of erasing three documents and all that derives from them."""
    return _receipt(spark, sf_dir, "legal")


# Branches: every third order is changed on a copy, and comes back.
_MAIN = "select o_orderkey as id, o_custkey as subject, o_orderstatus as object, 'main' as branch from orders"
plain("branch_create", f"select id, subject, object, branch from ({_MAIN}) m union all select id, subject, object, 'scratch' as branch from ({_MAIN}) m")
plain("branch_discard", f"select id, subject, object, branch from (select id, subject, object, branch from ({_MAIN}) m union all select id, subject, object, 'scratch' as branch from ({_MAIN}) m) u where branch <> 'scratch'")
plain("branch_merge", """select id, max(case when branch = 'scratch' then object else null end) as theirs, max(case when branch = 'main' then object end) as ours, count(*) as n, max(subject) as subject from
  (select o_orderkey as id, o_custkey as subject, o_orderstatus as object, 'main' as branch from orders where o_orderkey % 5 <> 0 union all
   select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end, 'scratch' from orders) u group by id having count(*) = 1 or min(object) <> max(object)""")
plain("export_difference", """select 'missing' as side, o_orderkey from (select o_orderkey, o_orderstatus from orders except select o_orderkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end from orders where o_orderkey % 7 <> 0) a
  union all select 'extra' as side, o_orderkey from (select o_orderkey, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end from orders where o_orderkey % 7 <> 0 except select o_orderkey, o_orderstatus from orders) b""")
plain("journal_divergence", "select 'missing_from_journal' as side, cid from (select sha2(text, 256) as cid from documents where text is not null except select sha2(text, 256) from documents where doc_id % 9 <> 0 and text is not null) a union all select 'journal_only' as side, cid from (select sha2(text || '!', 256) as cid from documents where doc_id % 50 = 0 and text is not null) b".replace("sha2(text, 256)", "⟦sha2(text, 256)¦sha256(text)⟧").replace("sha2(text || '!', 256)", "⟦sha2(text || '!', 256)¦sha256(text || '!')⟧"))
plain("merged_sources", "select a.id, ⟦array_join(array_sort(array_union(a.s, b.s)), ',')¦array_to_string(list_sort(list_distinct(list_concat(a.s, b.s))), ',')⟧ as sources, ⟦size(array_intersect(a.s, b.s))¦cast(len(list_intersect(a.s, b.s)) as int)⟧ as shared from (select o_orderkey as id, ⟦array¦list_value⟧('s' || cast(o_orderkey % 5 as ⟦string¦varchar⟧), 't' || cast(o_orderkey % 3 as ⟦string¦varchar⟧)) as s from orders) a join (select o_orderkey as id, ⟦array¦list_value⟧('s' || cast(o_orderkey % 4 as ⟦string¦varchar⟧), 't' || cast(o_orderkey % 3 as ⟦string¦varchar⟧)) as s from orders) b on a.id = b.id")
plain("reconciled_observations", """select source, norm, count(*) as seen, count(distinct lang) as sources, case when count(*) = 1 then 'new' when count(distinct lang) > 1 then 'corroborated' else 'unchanged' end as effect from
  (select source, lang, ⟦lower(array_join(filter(split(text, '[ \\n\\t]+'), x -> x <> ''), ' '))¦lower(array_to_string(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> ''), ' '))⟧ as norm from documents where text is not null) x group by source, norm""")
_NTH = "(select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as nth, count(*) over (partition by source) as n from documents)"
plain("summary_clusters", f"select source, cluster, count(*) as members, min(doc_id) as first_doc from (select *, case when n % 8 = 1 and n > 8 and cast(floor(nth / 8) as bigint) = cast(floor((n - 1) / 8) as bigint) then cast(floor(nth / 8) as bigint) - 1 else cast(floor(nth / 8) as bigint) end as cluster from {_NTH} x) y group by source, cluster")


@query("""with recursive up as (select doc_id as id, doc_id as node from labels where toxic = 1 union all select id, cast(floor(node / 4) as bigint) from up where node > 0),
bad as (select distinct node from up), ok as (select doc_id, n_chars, case when doc_id = 0 then 0 else cast(floor(ln(doc_id * 3 + 1) / ln(4)) as int) end as level from documents where doc_id not in (select node from bad)),
top as (select o.*, row_number() over (partition by doc_id % 10 order by n_chars desc, level, doc_id) as nth from ok o) select doc_id, row_number() over (order by case when nth = 1 then 0 else 1 end, n_chars desc, level, doc_id) as place from top qualify place <= 50""")
def sensemaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries in a tree of four children each: a hidden one hides all above it. One of each theme first, then the best."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    up = d.where("doc_id > 0").select(F.col("doc_id").alias("a"), F.floor(F.col("doc_id") / 4).cast("long").alias("b"))
    hidden = G.reached(up, table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("node")))
    level = F.when(F.col("doc_id") == 0, 0).otherwise(F.floor(F.log(F.col("doc_id") * 3 + F.lit(1)) / F.log(F.lit(4.0))).cast("int"))
    ok = d.join(hidden, d["doc_id"] == hidden["node"], "left_anti").withColumn("level", level).withColumn("theme", F.col("doc_id") % 10)
    first = ok.groupBy("theme").agg(F.min_by("doc_id", F.struct((-F.col("n_chars")).alias("c"), "level", "doc_id")).alias("first"))
    own = ok.join(F.broadcast(first), "theme").withColumn("later", (F.col("doc_id") != F.col("first")).cast("int"))
    top = own.orderBy("later", F.desc("n_chars"), "level", "doc_id").limit(50)
    from pyspark.sql import Window

    return top.select("doc_id", F.row_number().over(Window.orderBy("later", F.desc("n_chars"), "level", "doc_id")).cast("long").alias("place"))


@query("""with recursive e as (select c_custkey as b, cast(floor(c_custkey / 2) as bigint) as a from customer where c_custkey > 0), s as (select e.a, e.b from e join customer x on x.c_custkey = e.a join customer y on y.c_custkey = e.b where x.c_mktsegment = y.c_mktsegment),
u as (select a, b from s union select b, a from s), r as (select a as node, a as root from u union select u.b, r.root from r join u on u.a = r.node) select node, min(root) as root from r group by node""")
def entity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that aliases tie together: one of half its number and of the same segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    half = c.select(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("seg"))
    pairs = c.where("c_custkey > 0").join(half, (F.floor(F.col("c_custkey") / 2) == F.col("a")) & (F.col("c_mktsegment") == F.col("seg"))).select("a", F.col("c_custkey").alias("b")).where("a <> b")
    return G.components(pairs)


plain("structural_holes", """select a, b, count(*) as shared, round(sum(ln(n / 2.0)), 6) as surprise from (select min(doc_id) as a, max(doc_id) as b, max(n) as n from (select doc_id, w, count(*) over (partition by w) as df, n from
  (select distinct doc_id, n, ⟦explode(regexp_extract_all(lower(text), '([a-z]{8,})', 1))¦unnest(regexp_extract_all(lower(text), '[a-z]{8,}'))⟧ as w from documents, (select count(*) as n from documents) c) x) y where df = 2 group by w) z group by a, b having count(*) >= 3""")
plain("promotion_gate", f"""select source, n, base, candidate, round(candidate - base, 6) as lift, candidate >= base - {N(0.02)} and roots >= 2 as promoted from (select d.source, count(*) as n, round(avg(cast(quality as double)), 6) as base, round(avg(case when toxic = 1 then {N(0.0)} else {N(1.0)} end), 6) as candidate, count(distinct lang) as roots from labels l join documents d on d.doc_id = l.doc_id group by d.source) x""")


# Parts of the same words in any order are one thing, but for those that a veto keeps apart; one merge in five is taken back.
_PART = "case when p_partkey % 3 = 0 then p_name || ' ' || p_brand when p_partkey % 3 = 1 then p_brand || ', ' || p_name else upper(p_name) || ' by ' || p_brand end"
_SAME = f"select array_to_string(list_sort(regexp_extract_all(lower({_PART}), '[a-z0-9]+')), '-') as block, array_to_string(regexp_extract_all(lower({_PART}), '[a-z0-9]+'), '-') as key from part"


@query(f"""with k as ({_SAME}), b as (select block, key, dense_rank() over (partition by block order by key) as nth, min(key) over (partition by block) as head from k)
select key, any_value(case when nth = 1 or length(key) % 5 = 0 then key else head end) as entity, count(*) as mentions from b group by key""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of parts' names after merges, a fifth of which were undone."""
    names = table(spark, sf_dir, "part").select(F.lit("t").alias("tenant"), F.expr(_PART).alias("name"))
    pairs = EN.candidates(names.select("tenant", EN.key(F.col("name")).alias("key"))).where("score = 1.0")
    seq = F.abs(F.xxhash64("left_key", "right_key"))
    merges = written(pairs.select("tenant", seq.alias("seq"), F.lit("merge").alias("kind"), "left_key", "right_key", F.lit(None).cast("long").alias("undoes")), "merges")
    none = F.lit(None).cast("string")
    back = merges.where(F.length("right_key") % 5 == 0).select("tenant", (-F.col("seq") - 1).alias("seq"), F.lit("undo").alias("kind"), none.alias("left_key"), none.alias("right_key"), F.col("seq").alias("undoes"))
    got = EN.resolved(names, merges.unionByName(back))
    return got.groupBy("key", "entity").agg(F.count(F.lit(1)).alias("mentions"))
