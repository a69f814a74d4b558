"""Who may read what: the first denial of an ordered chain, policies merged in the most restrictive way, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sensitivity that a role may see, and the order of roles.
CEILINGS = {"reader": 1, "agent": 2, "consolidator": 3, "operator": 1}
RANKS = {"reader": 0, "agent": 1, "consolidator": 2, "operator": 3}
LIVE = ("active", "candidate", "contested")


def _of(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), key)


def ceiling(role: Column, most: Column, requested: Column, break_glass: Column) -> Column:
    """The caller's effective ceiling: never above its role's, the policy's or what it asked for; -1 for unknown roles."""
    own = F.when((role == "operator") & break_glass, F.greatest(_of(CEILINGS, role), F.lit(3))).otherwise(_of(CEILINGS, role))
    return F.coalesce(F.greatest(F.lit(-1), F.least(most, own, F.coalesce(requested, F.lit(99)))), F.lit(-1))


def _denied(policy: Column, caller: Column) -> Column:
    """Whether a policy names values and the caller has none of them."""
    return (F.size(F.coalesce(policy, F.array().cast("array<string>"))) > 0) & ~F.coalesce(F.arrays_overlap(policy, caller), F.lit(False))


def decide(rows: DataFrame, most_sensitive: int = 3) -> DataFrame:
    """rows with reason, allowed and redacted. Columns: tenant, sensitivity, status, erased, policy (struct of restricted,
    hold, tenant, expired, unknown_key, max_sensitivity, allow_roles, require_capabilities, allow_principals, scopes,
    purposes, residency, lawful_basis, redact_fields, min_role_for_raw, break_glass; null: no policy) and caller (struct
    of tenant, role, max_sensitivity, break_glass, capabilities, principals, scopes, purposes, residency, lawful_basis)."""
    p, c = (lambda k: F.col("policy")[k]), (lambda k: F.col("caller")[k])
    role, has = c("role"), F.col("policy").isNotNull()
    glass = F.coalesce(c("break_glass"), F.lit(False))
    both = glass & F.coalesce(p("break_glass"), F.lit(False)) & (role == "operator")
    own = ceiling(role, F.lit(most_sensitive), c("max_sensitivity"), glass)
    own = F.when(both, F.greatest(own, F.least(F.lit(most_sensitive), F.lit(3)))).otherwise(own)
    own = F.least(own, F.coalesce(p("max_sensitivity"), F.lit(99)))
    raw = F.coalesce(_of(RANKS, role), F.lit(-1)) < F.coalesce(_of(RANKS, p("min_role_for_raw")), F.lit(99))
    wants_raw = p("min_role_for_raw").isNotNull()
    none = lambda x: F.size(F.coalesce(x, F.array().cast("array<string>"))) == 0
    # The reasons, in the order in which they are looked for.
    chain = [
        ("invalid_role", _of(RANKS, role).isNull()),
        ("unknown_access_policy_key", has & F.coalesce(p("unknown_key"), F.lit(False))),
        ("erased", F.col("erased")),
        ("inactive_status", ~F.col("status").isin(*LIVE)),
        ("tenant_mismatch", c("tenant").isNotNull() & (c("tenant") != F.col("tenant"))),
        ("policy_tenant_mismatch", has & p("tenant").isNotNull() & (p("tenant") != F.col("tenant"))),
        ("restricted", has & (F.coalesce(p("restricted"), F.lit(False)) | p("hold").isNotNull())),
        ("expired_access_policy", has & F.coalesce(p("expired"), F.lit(False))),
        ("s4_raw_not_retrievable", F.col("sensitivity") >= 4),
        ("operator_break_glass_required", ~F.coalesce(both, F.lit(False)) & (role == "operator") & (F.col("sensitivity") >= 2)),
        ("sensitivity_ceiling", F.col("sensitivity") > own),
        ("role_not_allowed", has & _denied(p("allow_roles"), F.array(role))),
        ("missing_capability", has & ~none(p("require_capabilities")) & (F.size(F.array_except(p("require_capabilities"), F.coalesce(c("capabilities"), F.array().cast("array<string>")))) > 0)),
        ("principal_not_allowed", has & _denied(p("allow_principals"), c("principals"))),
        ("scope_mismatch", has & _denied(p("scopes"), c("scopes"))),
        ("purpose_mismatch", has & _denied(p("purposes"), c("purposes"))),
        ("residency_mismatch", has & _denied(p("residency"), c("residency")) & ~none(c("residency"))),
        ("lawful_basis_mismatch", has & _denied(p("lawful_basis"), c("lawful_basis"))),
        ("invalid_min_role_for_raw", has & wants_raw & _of(RANKS, p("min_role_for_raw")).isNull()),
        ("raw_role_required", has & wants_raw & raw & none(p("redact_fields"))),
    ]
    reason = F.coalesce(*(F.when(hit, F.lit(name)) for name, hit in chain), F.lit("allowed"))
    out = rows.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "allowed")
    return out.withColumn("redacted", F.col("allowed") & has & F.coalesce(wants_raw & raw & ~none(p("redact_fields")), F.lit(False)))


def partition(rows: DataFrame) -> Column:
    """none, private or public: where a row's vector may be kept (columns as for decide(), policy.embed_ok besides)."""
    p = lambda k: F.coalesce(F.col("policy")[k], F.lit(False))
    gone = F.col("erased") | ~F.col("status").isin(*LIVE) | (F.col("sensitivity") >= 4) | p("unknown_key") | p("restricted") | F.col("policy.hold").isNotNull() | (~F.coalesce(F.col("policy.embed_ok"), F.lit(True)))
    own = (F.col("sensitivity") >= 2) | (F.size(F.coalesce(F.col("policy.redact_fields"), F.array().cast("array<string>"))) > 0) | F.col("policy.min_role_for_raw").isNotNull()
    return F.when(gone, "none").when(own, "private").otherwise("public")


def merged_policies(rows: DataFrame, key: str) -> DataFrame:
    """One policy for each key: lists that permit are intersected, lists that demand are united, the lowest ceiling, the
    earliest end, the highest raw role; tenants that disagree, a hold or a restriction of any restrict. Rows: key and the
    policy's columns, of which allow_principals, scopes, residency and lawful_basis (permits), break_glass (only if all
    policies have it) and hold (kept if any has one: that of the conflict, else the first by name) may be missing. Counts
    of rows and values are enough, so that each key is aggregated map-side first."""

    def permit(name: str) -> DataFrame:
        named = rows.where(F.size(name) > 0)
        need = named.groupBy(key).agg(F.count(F.lit(1)).alias("need"))
        has = named.select(key, F.explode(F.array_distinct(name)).alias("v")).groupBy(key, "v").agg(F.count(F.lit(1)).alias("has"))
        return need.join(has, key).groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("has") == F.col("need"), F.col("v")))).alias(name))

    def demand(name: str) -> DataFrame:
        return rows.select(key, F.explode(name).alias("v")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("v")).alias(name))

    rank = _of(RANKS, F.col("min_role_for_raw"))
    base = rows.groupBy(key).agg(
        F.min("tenant").alias("tenant"),
        (F.coalesce(F.max(F.col("restricted").cast("int")), F.lit(0)) + (F.min("tenant") != F.max("tenant")).cast("int") > 0).alias("restricted"),
        F.min("max_sensitivity").alias("max_sensitivity"),
        F.min("expires_at").alias("expires_at"),
        F.max_by("min_role_for_raw", rank).alias("min_role_for_raw"),
        (F.min(F.col("embed_ok").cast("int")) == 1).alias("embed_ok"),
        F.when(F.min("data_class") == F.max("data_class"), F.min("data_class")).otherwise(F.lit("mixed")).alias("data_class"),
    )
    more = [c for c in ("allow_principals", "scopes", "residency", "lawful_basis") if c in rows.columns]
    for part in (permit("allow_roles"), permit("purposes"), *map(permit, more), demand("require_capabilities"), demand("redact_fields")):
        base = base.join(part, key, "left")
    if "break_glass" in rows.columns:
        every = rows.groupBy(key).agg(F.coalesce(F.bool_and(F.coalesce("break_glass", F.lit(False))), F.lit(False)).alias("break_glass"))
        base = base.join(every, key, "left")
    if "hold" in rows.columns:
        held = rows.groupBy(key).agg(F.when(F.min("tenant") != F.max("tenant"), F.lit("tenant-conflict")).otherwise(F.min(F.when(F.col("hold") != "", F.col("hold")))).alias("hold"))
        base = base.join(held, key, "left").withColumn("restricted", F.col("restricted") | F.col("hold").isNotNull())
    return base


def redacted_text(text: Column, fields: list[str]) -> Column:
    """Values that stand behind a field's name and a colon or equals sign are replaced; a text without one is replaced whole."""
    out = text
    for f in fields:
        out = F.regexp_replace(out, rf"(?i)(\b{f}\b\s*[:=]\s*)([^,;\n]+)", f"$1[REDACTED:{f}]")
    return F.when(out == text, F.lit("[REDACTED]")).otherwise(out)
