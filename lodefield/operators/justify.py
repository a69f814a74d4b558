"""Claims that rest on others: justifications are sets of dependencies, a claim may have many, any one of which will do.

Claims have (tenant, branch, id, status), justifications (tenant, justification_id, assertion_id, dependency_ids). A claim is
`in` if it is live and has no justification, or one none of whose dependencies is retracted; else it is `out`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .belief import LIVE, upserted
from .graph import reached
from .lineage import beside, written


def _links(justifications: DataFrame) -> DataFrame:
    return justifications.select("tenant", "justification_id", "assertion_id", F.explode_outer("dependency_ids").alias("dep"))


def labels(claims: DataFrame, justifications: DataFrame, branch: str = "main") -> DataFrame:
    """(tenant, id, label) of a branch's claims. A dependency that is no claim of the branch doesn't undermine what rests on
    it. A claim that very many rest on is one row, joined with theirs; justifications of any size are exploded, not held."""
    own = claims.where(F.col("branch") == branch)
    gone = own.where("status = 'retracted'").select("tenant", F.col("id").alias("dep")).hint("shuffle_hash")
    broken = _links(justifications).join(gone, ["tenant", "dep"], "left_semi").select("tenant", "justification_id").distinct().withColumn("broken", F.lit(True)).hint("shuffle_hash")
    stands = justifications.select("tenant", "justification_id", "assertion_id").join(broken, ["tenant", "justification_id"], "left")
    stands = stands.groupBy("tenant", F.col("assertion_id").alias("id")).agg(F.bool_or(F.col("broken").isNull()).alias("stands")).hint("shuffle_hash")
    live = F.coalesce(F.col("status").isin(*LIVE), F.lit(False)) & F.coalesce("stands", F.lit(True))
    return own.join(stands, ["tenant", "id"], "left").select("tenant", "id", F.when(live, "in").otherwise("out").alias("label"))


def invalidated(claims: DataFrame, justifications: DataFrame, roots: DataFrame, branch: str = "main") -> DataFrame:
    """(tenant, id, hop) of the roots (tenant, id) and all claims of the branch that rest on them, directly or not, by any
    justification, whether or not another one still holds."""
    own = written(claims.where(F.col("branch") == branch).select(F.struct("tenant", "id").alias("node")).distinct(), "claims")
    edges = _links(justifications).where("dep is not null").select(F.struct("tenant", F.col("dep").alias("id")).alias("a"), F.struct("tenant", F.col("assertion_id").alias("id")).alias("b")).distinct()
    n = own.count()
    edges = edges.join(beside(own.withColumnRenamed("node", "a"), n), "a", "left_semi").join(beside(own.withColumnRenamed("node", "b"), n), "b", "left_semi")
    start = roots.select(F.struct("tenant", "id").alias("node")).join(beside(own, n), "node", "left_semi")
    return reached(written(edges, "edges"), start).select("node.tenant", "node.id", "hop")


def contracted(claims: DataFrame, justifications: DataFrame, roots: DataFrame, reason: str, branch: str = "main") -> tuple[DataFrame, DataFrame]:
    """(claims, report): claims with the roots and all that rests on them retracted for that reason (invalidated_reason; what
    was retracted before keeps its own), and (tenant, id, label) of the roots and what went with them."""
    hit = written(invalidated(claims, justifications, roots, branch), "invalidated")
    named = claims if "invalidated_reason" in claims.columns else claims.withColumn("invalidated_reason", F.lit(None).cast("string"))
    after = named.join(beside(hit.select("tenant", "id", F.lit(branch).alias("branch"), F.lit(True).alias("hit")), hit.count()), ["tenant", "id", "branch"], "left")
    now = F.coalesce(F.col("hit"), F.lit(False)) & ~F.col("status").eqNullSafe(F.lit("retracted"))
    after = after.withColumns({"status": F.when(now, "retracted").otherwise(F.col("status")), "invalidated_reason": F.when(now, F.lit(reason)).otherwise(F.col("invalidated_reason"))})
    after = written(after.select(*named.columns), "contracted")
    touched = hit.select("tenant", "id").union(roots.select("tenant", "id")).distinct()
    labelled = touched.join(labels(after, justifications, branch).hint("shuffle_hash"), ["tenant", "id"], "left").select("tenant", "id", F.coalesce("label", F.lit("out")).alias("label"))
    return after, labelled


def revised(claims: DataFrame, justifications: DataFrame, new: DataFrame, branch: str = "main") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, justifications, contradictions) after new assertions have arrived on a branch: claims and new are as in
    belief.upserted(), with tenant and branch; new may have rule and dependency_ids. Each new assertion that isn't refused
    gives a justification of where it went, which rests on its dependencies; what it supersedes or contests is a
    contradiction (tenant, left_id, right_id)."""
    own = claims.where(F.col("branch") == branch).withColumn("held", F.lit(True))
    come = new.where(F.col("branch") == branch).withColumn("held", F.lit(False))
    state = written(upserted(own.unionByName(come.select(*[c for c in come.columns if c not in ("rule", "dependency_ids")]), allowMissingColumns=True)), "revised")
    arrived = state.where("effect not in ('held', 'refuse')")
    rule = F.col("rule") if "rule" in new.columns else F.lit(None).cast("string")
    deps = F.col("dependency_ids") if "dependency_ids" in new.columns else F.array().cast("array<long>")
    said = come.select("tenant", F.col("id").alias("source_id"), rule.alias("rule"), F.coalesce(deps, F.array().cast("array<long>")).alias("dependency_ids"))
    went = arrived.select("tenant", F.col("id").alias("source_id"), F.when(F.col("status") == "merged", F.col("superseded_by")).otherwise(F.col("id")).alias("assertion_id"), "label")
    made = went.join(said, ["tenant", "source_id"]).select("tenant", F.xxhash64(F.lit("justification"), "tenant", "source_id").alias("justification_id"), "assertion_id", "dependency_ids", F.coalesce("rule", "label").alias("rule"))
    against = arrived.where("label in ('SUPERSEDE', 'CONTEST')").select("tenant", F.explode("contradicts").alias("left_id"), F.col("id").alias("right_id"))
    return state.where(~F.col("status").isin("merged", "refused")), justifications.unionByName(made, allowMissingColumns=True), against
