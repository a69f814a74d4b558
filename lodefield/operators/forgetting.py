"""Forgetting evidence, and what rests on it, over all collections of one tenant's branch.

    tombstone   rows stay, emptied and marked; derived evidence goes with its last source, else its sources are trimmed
    hard        rows go; refused, whole, if an active claim would be left without support and never had enough of it
    legal       rows go, and all evidence derived from them by any source, whatever rests on it

Evidence has (tenant, branch, cid, user_id, content, erased, embedding, sources), claims and relations name their sources
too. What is forgotten is joined, never collected; a receipt has a row for everything touched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import erased, reached
from .lineage import written

MODES = ("tombstone", "hard", "legal")
#: What stands for erased words, what a receipt's digest begins with, what parts its fields.
ERASED, SALT, FIELD = "[erased]", "forgotten-evidence:v1", "\x1f"
RECEIPT = "collection string, id string, action string, digest string"


class Forgotten(NamedTuple):
    evidence: DataFrame
    claims: DataFrame
    relations: DataFrame
    receipt: DataFrame


def digest(tenant: Column, user: Column, content: Column) -> Column:
    """Proves what went to whoever still has it: a salted hash of whose it was and what it said."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.lit(SALT), F.lit(FIELD), none(tenant), F.lit(FIELD), none(user), F.lit(FIELD), none(content)), 256)


def affected(evidence: DataFrame, roots: DataFrame, legal: bool) -> DataFrame:
    """(cid) of roots (cid) that are there and of live evidence derived from them: by any source, or with none left."""
    known = roots.select("cid").distinct().join(evidence.select("cid").distinct(), "cid", "left_semi")
    # A root's own sources don't matter; what is erased already goes on passing nothing on.
    links = evidence.where(~F.coalesce("erased", F.lit(False))).select(F.col("cid").alias("id"), F.explode("sources").alias("source")).where("source <> id").distinct()
    if legal:
        return reached(links.select(F.col("source").alias("a"), F.col("id").alias("b")), known.select(F.col("cid").alias("node"))).select(F.col("node").alias("cid"))
    return erased(links, known.select(F.col("cid").alias("id"))).select(F.col("id").alias("cid"))


def _left(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows with `kept`, their sources that are left, in their order, or null where none of them went. A source that very
    many rows have is one row of gone, joined with theirs."""
    own = rows.withColumn("row_at", F.monotonically_increasing_id())
    own = written(own, "rows")
    hit = own.select("row_at", F.explode("sources").alias("cid")).join(gone, "cid").groupBy("row_at").agg(F.collect_set("cid").alias("went"))
    own = own.join(hit, "row_at", "left")
    return own.withColumn("kept", F.when(F.col("went").isNotNull(), F.filter("sources", lambda s: ~F.array_contains(F.col("went"), s)))).drop("row_at", "went")


def forget(evidence: DataFrame, claims: DataFrame, relations: DataFrame, roots: DataFrame, mode: str = "tombstone", tenant: str = "t", branch: str = "main", least: int = 2) -> Forgotten:
    """The collections and a receipt after roots (cid) are forgotten on a tenant's branch; other rows are as they were.

    claims have (tenant, branch, id, subject, predicate, object, status, sources, conjunctive), relations (tenant, branch, id,
    source, predicate, target, valid_to, sources). A claim or relation loses the sources that went; one without a source
    left loses its words: the claim is retracted, the relation ends. A conjunctive claim needs all its sources and is
    retracted with the first, and so are relations that say the same from the same sources. Roots that aren't there are
    passed over. mode hard: if an active claim of fewer than `least` sources would lose all of them, nothing changes, and
    the receipt has the claims in the way (`blocks`). Null lists of sources are empty."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    here = (F.col("tenant") == tenant) & (F.col("branch") == branch)
    listed = lambda df: df.where(here).withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    rest = lambda df: df.where(~F.coalesce(here, F.lit(False)))
    own = listed(evidence)
    gone = written(affected(own, roots, mode == "legal"), "gone")
    held = _left(listed(claims), gone)
    held = written(held, "claims")
    lost = F.col("kept").isNotNull() & ((F.size("kept") == 0) | F.coalesce("conjunctive", F.lit(False)))
    if mode == "hard":
        blocks = held.where((F.col("status") == "active") & F.col("kept").isNotNull() & (F.size("kept") == 0) & (F.size(F.array_distinct("sources")) < least))
        if not blocks.isEmpty():
            receipt = blocks.select(F.lit("claims").alias("collection"), F.col("id").cast("string").alias("id"), F.lit("blocks").alias("action"), F.lit(None).cast("string").alias("digest"))
            return Forgotten(evidence, claims, relations, receipt)
    # Evidence.
    trimmed = _left(own, gone).join(gone.withColumn("is_gone", F.lit(True)), "cid", "left")
    trimmed = written(trimmed, "evidence")
    is_gone = F.coalesce("is_gone", F.lit(False))
    stays = trimmed if mode == "tombstone" else trimmed.where(~is_gone)
    keeps = ~is_gone & F.col("kept").isNotNull() & ~F.coalesce("erased", F.lit(False))
    after = stays.select(
        *(
            F.when(is_gone, F.lit("")).otherwise(F.col(c)).alias(c) if c == "content"
            else F.when(is_gone, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "erased"
            else F.when(is_gone, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "embedding"
            else F.when(keeps, F.col("kept")).otherwise(F.col(c)).alias(c) if c == "sources"
            else F.col(c)
            for c in evidence.columns
        )
    )
    went = F.when(is_gone, "erased" if mode == "tombstone" else "removed").when(keeps, "trimmed")
    noted = [trimmed.where(is_gone | keeps).select(F.lit("evidence").alias("collection"), F.col("cid").alias("id"), went.alias("action"), F.when(is_gone, digest(F.col("tenant"), F.col("user_id"), F.col("content"))).alias("digest"))]
    # Claims.
    blank = {"subject": ERASED, "object": ERASED, "predicate": "erased", "status": "retracted"}
    empty = F.array().cast("array<string>")
    sources = F.when(lost, empty).when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.col("sources"))
    new_claims = held.select(*(F.when(lost, F.lit(blank[c])).otherwise(F.col(c)).alias(c) if c in blank else sources.alias(c) if c == "sources" else F.col(c) for c in claims.columns))
    noted.append(held.where("kept is not null").select(F.lit("claims"), F.col("id").cast("string"), F.when(lost, "retracted").otherwise("trimmed"), F.lit(None).cast("string")))
    # Relations, and those that say what a conjunctive claim said, from the same sources.
    said = held.where(lost & F.coalesce("conjunctive", F.lit(False))).select(F.col("subject").alias("source"), "predicate", F.col("object").alias("target"), F.array_sort(F.array_distinct("sources")).alias("from")).distinct().withColumn("falls", F.lit(True))
    tied = _left(listed(relations), gone).withColumn("from", F.array_sort(F.array_distinct("sources"))).join(said, ["source", "predicate", "target", "from"], "left")
    tied = written(tied, "relations")
    ends = F.col("kept").isNotNull() & ((F.size("kept") == 0) | F.coalesce("falls", F.lit(False)))
    blank = {"source": ERASED, "target": ERASED, "predicate": "erased"}
    sources = F.when(ends, empty).when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.col("sources"))
    now = F.current_timestamp().cast(dict(relations.dtypes)["valid_to"])
    new_relations = tied.select(*(F.when(ends, F.lit(blank[c])).otherwise(F.col(c)).alias(c) if c in blank else sources.alias(c) if c == "sources" else F.when(ends, now).otherwise(F.col(c)).alias(c) if c == "valid_to" else F.col(c) for c in relations.columns))
    noted.append(tied.where("kept is not null").select(F.lit("relations"), F.col("id").cast("string"), F.when(ends, "expired").otherwise("trimmed"), F.lit(None).cast("string")))
    receipt = noted[0]
    for more in noted[1:]:
        receipt = receipt.union(more)
    return Forgotten(rest(evidence).unionByName(after), rest(claims).unionByName(new_claims), rest(relations).unionByName(new_relations), written(receipt, "receipt"))
