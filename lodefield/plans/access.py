"""What a caller may see: ceilings, decisions, policies, redaction, sources that stand behind derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import exports as EX
from .registry import either, num, plain, query, regex, run_sql, table

_TIER = "case when l.toxic = 1 then 5 when l.quality = 1 then 1 when l.quality = 0 then 3 else 2 end"
plain("readable_evidence", "select doc_id, ⟦sha2(text, 256)¦sha256(text)⟧ as cid, source, cast(greatest(1, ceil(length(text) / 4)) as bigint) as approx_tokens from documents where text is not null")
plain("trust_tiers", f"select d.doc_id, {_TIER} as tier, round(1 - least(5, greatest(0, {_TIER})) / {num(5.0)}, 6) as weight from documents d left join labels l on d.doc_id = l.doc_id where {_TIER} <= 4")
plain("scoped_scan", "select doc_id, source, n_chars from documents where lang = 'en' and source in ('src1', 'src2', 'src3') and n_chars between 200 and 4000")
plain("scoped_candidates", f"""select 'evidence' as kind, cast(doc_id as ⟦string¦varchar⟧) as id, lang as scope, n_chars / {num(1000.0)} as score from documents where text is not null and lang = 'en' and source <> 'src0'
  union all select 'assertion', 'a' || cast(o_orderkey as ⟦string¦varchar⟧), o_orderpriority, o_totalprice / {num(100000.0)} from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as nth from orders) o where nth = 1 and o_orderstatus in ('O', 'P')
  union all select 'preference', 'p' || cast(c_custkey as ⟦string¦varchar⟧), c_mktsegment, c_acctbal / {num(1000.0)} from customer where c_acctbal > 0""")
plain("source_passages", "select d.doc_id, d.source from documents d left join labels l on l.doc_id = d.doc_id where text is not null and source not in ('src0', 'src9') and coalesce(l.toxic, 0) = 0")
plain("retired_filter", "select doc_id from (select doc_id, text, min(doc_id) over (partition by text) as first_doc, max(doc_id) over (partition by source) as newest from documents where text is not null) x where doc_id = first_doc and doc_id <> newest")
plain("sink_guard", "select d.doc_id, l.toxic = 1 as quarantined from documents d join labels l on l.doc_id = d.doc_id where not (l.toxic = 1 and l.quality = 1) and case when l.toxic = 1 then 5 when l.quality = 1 then 1 else 3 end <= 3")
plain("operational_demand", """with dep as (select doc_id as derived, cast(floor(doc_id / 2) as bigint) as src from documents union all select doc_id, cast(floor(doc_id / 3) as bigint) from documents)
select distinct doc_id from documents where doc_id not in (select derived from dep join labels l on l.doc_id = dep.src where l.toxic = 1)""")
plain("authorized_edges", "select distinct l_partkey, l_suppkey from lineitem l where exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_orderstatus <> 'P' and o.o_totalprice < 300000)")
plain("assertions_citing", "select o.id, count(*) as cited from (select o_orderkey as id, ⟦explode(array(¦unnest(list_value(⟧o_custkey, o_custkey + 1, o_orderkey % 100)) as cid from orders) o where exists (select 1 from customer c where c.c_custkey = o.cid and c.c_acctbal > 5000) group by o.id")

# Items: documents with policies made of their number. Callers: one a tenant and role.
_LIST = lambda *xs: "⟦array¦list_value⟧(" + ", ".join(xs) + ")"
_EMPTY = "⟦cast(array() as array<string>)¦cast([] as varchar[])⟧"
_ITEMS = f"""select d.doc_id, d.lang as tenant, cast(coalesce(l.toxic * 3 + l.quality, d.doc_id % 3) as int) as sensitivity, case when d.doc_id % 19 = 0 then 'retired' else 'active' end as status, d.doc_id % 23 = 0 as erased, d.doc_id % 4 <> 0 as has_policy,
  d.doc_id % 29 = 0 as restricted, case when d.doc_id % 7 = 0 then 1 end as max_sensitivity, case when d.doc_id % 5 = 0 then {_LIST("'agent'", "'consolidator'")} else {_EMPTY} end as allow_roles, case when d.doc_id % 6 = 0 then {_LIST("'audit'")} else {_EMPTY} end as require_capabilities,
  case when d.doc_id % 8 = 0 then {_LIST("'research'")} when d.doc_id % 8 = 1 then {_LIST("'research'", "'billing'")} else {_EMPTY} end as purposes, case when d.doc_id % 9 = 0 then {_LIST("'name'")} else {_EMPTY} end as redact_fields, case when d.doc_id % 9 in (0, 1) then 'consolidator' end as min_role_for_raw,
  d.doc_id % 31 = 0 as unknown_key, d.doc_id % 37 = 0 as expired, case when d.doc_id % 41 = 0 then 'other' end as policy_tenant, d.doc_id % 11 <> 0 as embed_ok, d.source, date '2024-01-01' + cast(d.doc_id % 300 as int) as expires_at, case when d.doc_id % 2 = 0 then 'pii' else 'plain' end as data_class
  from documents d left join labels l on l.doc_id = d.doc_id"""
_CALLERS = f"select r_regionkey, case r_regionkey when 0 then 'reader' when 1 then 'agent' when 2 then 'consolidator' when 3 then 'operator' else 'guest' end as role, case when r_regionkey = 2 then {_LIST("'audit'")} else {_EMPTY} end as capabilities, {_LIST("'research'")} as purposes from region"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    own = run_sql(spark, sf_dir, either(_ITEMS)[0])
    policy = F.struct("restricted", F.lit(None).cast("string").alias("hold"), F.col("policy_tenant").alias("tenant"), "expired", "unknown_key", "max_sensitivity", "allow_roles", "require_capabilities", none.alias("allow_principals"), none.alias("scopes"), "purposes",
                      none.alias("residency"), none.alias("lawful_basis"), "redact_fields", "min_role_for_raw", F.lit(False).alias("break_glass"), "embed_ok")
    return own.withColumn("policy", F.when(F.col("has_policy"), policy))


_DENY = [("unknown_access_policy_key", "has_policy and unknown_key"), ("erased", "erased"), ("inactive_status", "status <> 'active'"), ("policy_tenant_mismatch", "has_policy and policy_tenant is not null"), ("restricted", "has_policy and restricted"), ("expired_access_policy", "has_policy and expired"),
         ("s4_raw_not_retrievable", "sensitivity >= 4"), ("operator_break_glass_required", "role = 'operator' and sensitivity >= 2"), ("sensitivity_ceiling", "sensitivity > least(case role when 'reader' then 1 when 'agent' then 2 when 'consolidator' then 3 else 1 end, 3, case when has_policy then coalesce(max_sensitivity, 99) else 99 end)"),
         ("role_not_allowed", "has_policy and len(allow_roles) > 0 and not list_contains(allow_roles, role)"), ("missing_capability", "has_policy and not list_has_all(capabilities, require_capabilities)"), ("purpose_mismatch", "has_policy and len(i.purposes) > 0 and not list_has_any(i.purposes, c.purposes)"),
         ("raw_role_required", "has_policy and min_role_for_raw is not null and role in ('reader', 'agent') and len(redact_fields) = 0")]


@query(f"""with i as ({_ITEMS}), c as ({_CALLERS}), d as (select doc_id, role, case when role = 'guest' then 'invalid_role' {" ".join(f"when {cond} then '{name}'" for name, cond in _DENY)} else 'allowed' end as reason,
  has_policy and min_role_for_raw is not null and role in ('reader', 'agent') and len(redact_fields) > 0 as limited from i, c) select doc_id, role, reason, reason = 'allowed' as allowed, reason = 'allowed' and limited as redacted from d""")
def access_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against one caller of each role, all of the document's tenant: five callers, broadcast."""
    none = F.lit(None).cast("array<string>")
    who = run_sql(spark, sf_dir, either(_CALLERS)[0]).select(F.struct(F.lit(None).cast("string").alias("tenant"), "role", F.lit(None).cast("int").alias("max_sensitivity"), F.lit(False).alias("break_glass"), "capabilities", none.alias("principals"), none.alias("scopes"), "purposes", none.alias("residency"), none.alias("lawful_basis")).alias("caller"))
    got = A.decide(items(spark, sf_dir).select("doc_id", "tenant", "sensitivity", "status", "erased", "policy").join(F.broadcast(who)))
    return got.select("doc_id", F.col("caller.role").alias("role"), "reason", "allowed", "redacted")


@query(f"""with i as ({_ITEMS}) select doc_id, case when erased or status <> 'active' or sensitivity >= 4 or (has_policy and (unknown_key or restricted or not embed_ok)) then 'none' when sensitivity >= 2 or (has_policy and (len(redact_fields) > 0 or min_role_for_raw is not null)) then 'private' else 'public' end as part from i""")
def vector_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return rows.select("doc_id", A.partition(rows).alias("part"))


def _duck_permit(name: str) -> str:
    return f"(select source, list_sort(list(v) filter (where has = need)) as {name} from (select source, v, count(*) as has, any_value(need) as need from (select source, unnest(list_distinct({name})) as v, count(*) over (partition by source) as need0, need from (select *, count(*) over (partition by source) as need from i where len({name}) > 0)) group by source, v) group by source)"


@query(f"""with i as ({_ITEMS}), b as (select source, min(tenant) as tenant, bool_or(restricted) or min(tenant) <> max(tenant) as restricted, min(max_sensitivity) as max_sensitivity, cast(min(expires_at) as date) as expires_at, max(min_role_for_raw) as min_role_for_raw, bool_and(embed_ok) as embed_ok,
  case when min(data_class) = max(data_class) then min(data_class) else 'mixed' end as data_class from i group by source)
select b.*, array_to_string(coalesce(r.allow_roles, []), ',') as allow_roles, array_to_string(coalesce(p.purposes, []), ',') as purposes, array_to_string(list_sort(q.v), ',') as require_capabilities, array_to_string(list_sort(f.v), ',') as redact_fields from b
left join {_duck_permit('allow_roles')} r on r.source = b.source left join {_duck_permit('purposes')} p on p.source = b.source
left join (select source, list(distinct v) as v from (select source, unnest(require_capabilities) as v from i) group by source) q on q.source = b.source left join (select source, list(distinct v) as v from (select source, unnest(redact_fields) as v from i) group by source) f on f.source = b.source""")
def policy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = A.merged_policies(run_sql(spark, sf_dir, either(_ITEMS)[0]), "source")
    text = lambda c, none: F.coalesce(F.array_join(c, ","), none).alias(c)
    return got.select("source", "tenant", "restricted", "max_sensitivity", F.col("expires_at").cast("date").alias("expires_at"), "min_role_for_raw", "embed_ok", "data_class", text("allow_roles", F.lit("")), text("purposes", F.lit("")), text("require_capabilities", F.lit(None)), text("redact_fields", F.lit(None)))


_LABELLED = "'name: ' || source || ', note: ' || text"


@query(r"select doc_id, case when regexp_replace(t, '(?i)(\bname\b\s*[:=]\s*)([^,;\n]+)', '\1[REDACTED:name]') = t then '[REDACTED]' else regexp_replace(t, '(?i)(\bname\b\s*[:=]\s*)([^,;\n]+)', '\1[REDACTED:name]', 'g') end as text from (select doc_id, case when doc_id % 2 = 0 then " + _LABELLED + " else text end as t from documents where text is not null)")
def text_redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", A.redacted_text(F.expr(f"case when doc_id % 2 = 0 then {_LABELLED} else text end"), ["name"]).alias("text"))


# Conditions are compared with regard to type: 1 is not 1.0, and text is not a number.
_KIND = "case when {0} in ('true', 'false') then 'bool' when ⟦{0} rlike {1}¦regexp_full_match({0}, '-?[0-9]+')⟧ then 'int' when ⟦{0} rlike {2}¦regexp_full_match({0}, '-?[0-9]+[.][0-9]+')⟧ then 'float' else 'text' end"
_K = lambda c: _KIND.format(c, regex("^-?[0-9]+$"), regex("^-?[0-9]+[.][0-9]+$"))
plain("condition_compare", f"""select event_id, op, coalesce(cast(case when op = 'eq' then k1 = k2 and seen = want when op = 'ne' then not (k1 = k2 and seen = want) when k1 <> k2 or k1 not in ('int', 'float', 'text') then null when op = 'lt' then cast(seen as double) < cast(want as double) when op = 'gte' then cast(seen as double) >= cast(want as double) end as int), -1) as holds from
  (select *, {_K('seen')} as k1, {_K('want')} as k2 from (select event_id, ⟦get_json_object(props, '$.k')¦json_extract_string(props, '$.k')⟧ as seen, case when event_id % 3 = 0 then '50.0' else '50' end as want, case event_id % 4 when 0 then 'eq' when 1 then 'ne' when 2 then 'lt' else 'gte' end as op from events) a) b""")
plain("metadata_access", "select event_id, cast(⟦get_json_object(props, '$.k')¦json_extract_string(props, '$.k')⟧ as int) as k, ⟦get_json_object(props, '$.missing')¦json_extract_string(props, '$.missing')⟧ as missing from events")


@query("select e.event_id from events e where cast(json_extract(props, '$.k') as int) = 26 or (event_type = 'view' and cast(json_extract(props, '$.k') as int) = 9)")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type and properties contain one of two patterns."""
    from ..functions.documents import json_contains as contains

    whole = F.to_json(F.struct("event_type", F.from_json("props", "k int").alias("props")))
    e = table(spark, sf_dir, "events")
    return e.where(contains(whole, '{"props": {"k": 26}}') | contains(whole, '{"event_type": "view", "props": {"k": 9}}')).select("event_id")


_LOGS = "(select event_id, ts, event_type, user_id, case when event_id % 10 = 0 then 'true' when event_id % 10 = 1 then 'x1' when event_id % 10 = 2 then null else cast(round(value / 200.0, 6) as ⟦string¦varchar⟧) end as raw from events) x"
_PRIORITY = f"case when raw = 'true' then {num(1.0)} when raw = 'false' then {num(0.0)} else greatest({num(0.0)}, least({num(1.0)}, coalesce(try_cast(raw as double), {num(0.0)}))) end"
plain("priority_parse", f"select event_id, round({_PRIORITY}, 6) as priority from {_LOGS}")
plain("lease_order", f"select event_type, ⟦min_by(event_id, struct(-priority, ts, event_id))¦arg_min(event_id, (-priority, ts, event_id))⟧ as event_id from (select event_type, event_id, ts, {_PRIORITY} as priority from {_LOGS}) y group by event_type")
plain("queue_transitions", """select o_orderkey, case when status = 'running' and attempts >= 3 and stale then 'dead' when status = 'running' and stale then 'retry' else status end as status, attempts + case when status in ('queued', 'retry') then 1 else 0 end as attempts from
  (select o_orderkey, cast(o_orderkey % 5 as int) as attempts, case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'complete' end as status, o_orderdate < timestamp '1998-01-01 00:00:00' as stale from orders) x""")
plain("status_counts", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by o_orderstatus, o_orderpriority")


# What an agent may take out: a third of the documents derive from two others, and go only if these may.
_AGENT = f"(select 'agent' as role, {_EMPTY} as capabilities, {_LIST("'research'")} as purposes)"
_AGENT_REASON = f"""i as (select * from ({_ITEMS}) x), c as (select * from {_AGENT} y), own as (select doc_id, case {" ".join(f"when {cond} then '{name}'" for name, cond in _DENY)} else 'allowed' end as reason, has_policy and min_role_for_raw is not null and len(redact_fields) > 0 as limited, redact_fields from i, c),
dep as (select doc_id as id, cast(floor(doc_id / 2) as bigint) as src from documents where doc_id % 3 = 0 and doc_id > 1 union select doc_id, cast(floor(doc_id / 3) as bigint) from documents where doc_id % 3 = 0 and doc_id > 1)"""
_NAMED = "case when doc_id % 2 = 0 then 'name: ' || source || ', note: ' || coalesce(text, '') else coalesce(text, '') end"


@query(rf"""with recursive {_AGENT_REASON}, r as (select dep.id from dep join own on own.doc_id = dep.src where own.reason <> 'allowed' union select dep.id from dep join r on dep.src = r.id)
select o.doc_id, case when reason = 'allowed' and o.doc_id in (select id from r) then 'source_denied' else reason end as reason,
  case when reason <> 'allowed' or o.doc_id in (select id from r) then '' when not limited then {_NAMED.replace("doc_id", "d.doc_id")} when d.doc_id % 2 = 0 then regexp_replace({_NAMED.replace("doc_id", "d.doc_id")}, '(?i)(\bname\b\s*[:=]\s*)([^,;\n]+)', '\1[REDACTED:name]', 'g') else '[REDACTED]' end as content from own o join documents d on d.doc_id = o.doc_id""")
def policy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with the reason why they may leave the store or not, and what leaves."""
    none = F.lit(None).cast("array<string>")
    who = run_sql(spark, sf_dir, either(f"select * from {_AGENT} y")[0]).select(F.struct(F.lit(None).cast("string").alias("tenant"), "role", F.lit(None).cast("int").alias("max_sensitivity"), F.lit(False).alias("break_glass"), "capabilities", none.alias("principals"), none.alias("scopes"), "purposes", none.alias("residency"), none.alias("lawful_basis")).alias("caller"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_NAMED).alias("content"))
    own = A.decide(items(spark, sf_dir).join(F.broadcast(who))).join(d, "doc_id")
    n = F.col("doc_id")
    of = F.when((n % 3 == 0) & (n > 1), F.array(F.floor(n / 2).cast("long"), F.floor(n / 3).cast("long"))).otherwise(F.array().cast("array<long>"))
    rows = own.select("doc_id", n.alias("cid"), of.alias("sources"), "reason", "allowed", "redacted", F.col("policy.redact_fields").alias("redact_fields"), "content")
    out = EX.redacted(EX.closed(rows), keep=("doc_id", "cid", "sources", "reason", "allowed"), texts=("content",))
    return out.select("doc_id", "reason", F.when(F.col("allowed"), F.col("content")).otherwise("").alias("content"))
