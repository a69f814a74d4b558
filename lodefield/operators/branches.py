"""Branches of a store: copies, what is thrown away, and merges by replay onto what the target holds.

Tables have a tenant and a branch. A merge takes evidence that the target lacks, replays the branch's assertions in their
order onto the target's peers, points chains of supersession at where their rows went, and folds relations whose times
overlap into one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .belief import LIVE, folded, predicate_key, stamp, upserted
from .lineage import written

_BY = ["tenant", "branch"]


def created(rows: DataFrame, frm: str, to: str) -> DataFrame:
    """rows and, of each of branch frm, a copy on branch `to`."""
    return rows.unionByName(rows.where(F.col("branch") == frm).withColumn("branch", F.lit(to)))


def discarded(rows: DataFrame, branch: str) -> DataFrame:
    """rows without those of a branch, which can't be main. Rows without a branch stay."""
    if branch == "main":
        raise ValueError("the main branch stays")
    return rows.where(~F.col("branch").eqNullSafe(F.lit(branch)))


def merged_evidence(evidence: DataFrame, frm: str, into: str) -> DataFrame:
    """evidence (tenant, branch, cid, erased) and, on branch into, copies of what frm has and it lacks; erased rows and rows
    without a cid stay where they are."""
    new = evidence.where((F.col("branch") == frm) & ~F.coalesce("erased", F.lit(False)) & (F.coalesce("cid", F.lit("")) != "")).withColumn("branch", F.lit(into))
    there = evidence.where(F.col("branch") == into).select("tenant", "cid").distinct()
    return evidence.unionByName(new.join(there, ["tenant", "cid"], "left_anti").select(*evidence.columns))


def merged_assertions(assertions: DataFrame, frm: str, into: str) -> tuple[DataFrame, DataFrame]:
    """The state of branch into after the merge, and where each of the branch's assertions went (tenant, source_id, id,
    effect). Assertions are as in belief.upserted(), with tenant, branch, status and superseded_by; ids are those of one
    branch only once. Other branches are as they were and not returned."""
    both = assertions.where(F.col("branch").isin(frm, into)).withColumn("held", F.col("branch") == into).withColumn("branch", F.lit(into))
    state = written(upserted(both), "replayed")
    arrived = F.col("effect") != "held"
    went = state.where(arrived).select("tenant", F.col("id").alias("source_id"), F.when(F.col("status") == "merged", F.col("superseded_by")).otherwise(F.col("id")).alias("id"), "effect")
    went = written(went, "went")
    # A row that arrived stands for the target's of its id, among whatever peers that was.
    kept = state.where(~F.col("status").isin("merged", "refused"))
    stands = kept.where(arrived).select("tenant", "id")
    kept = kept.where(~arrived).join(stands, ["tenant", "id"], "left_anti").unionByName(kept.where(arrived))
    dest = went.select("tenant", "id").distinct().withColumn("is_dest", F.lit(True))
    moved = went.select("tenant", F.col("source_id").alias("superseded_by"), F.col("id").alias("moved"))
    out = kept.join(dest, ["tenant", "id"], "left").join(moved, ["tenant", "superseded_by"], "left")
    out = out.withColumn("superseded_by", F.when(F.col("is_dest"), F.coalesce("moved", "superseded_by")).otherwise(F.col("superseded_by")))
    return out.select(*state.columns), went


def _overlap(a: dict, b: dict) -> bool:
    return all(x["valid_to"] is None or y["valid_from"] < x["valid_to"] for x, y in ((a, b), (b, a)))


def _joined(target: dict, other: dict) -> None:
    target["confidence"] = max(target["confidence"], other["confidence"])
    target["valid_from"] = min(target["valid_from"], other["valid_from"])
    target["valid_to"] = None if target["valid_to"] is None or other["valid_to"] is None else max(target["valid_to"], other["valid_to"])
    target["sources"] = sorted({*target["sources"], *other["sources"]})


def _related(held: list[dict], new: dict) -> None:
    """Folds `new` and all that its time comes to overlap into the earliest of these, or adds it."""
    wide, part, left = dict(new), [], sorted(held, key=lambda r: (r["valid_from"], r["id"]))
    while True:
        hit = []
        for r in left:
            again = (r["id"], r["valid_from"], r["valid_to"]) == (new["id"], new["valid_from"], new["valid_to"])
            if again or _overlap(r, wide):
                _joined(wide, r)
                hit.append(r)
        if not hit:
            break
        part += hit
        left = [r for r in left if all(r is not h for h in hit)]
    if not part:
        new["effect"] = "add"
        held.append(new)
        return
    winner = min(part, key=lambda r: (r["valid_from"], r["id"]))
    for r in [*part, new]:
        if r is not winner:
            _joined(winner, r)
    held[:] = [r for r in held if r is winner or all(r is not h for h in part)]


def merged_relations(relations: DataFrame, frm: str, into: str) -> DataFrame:
    """The relations (tenant, branch, id, seq, source, predicate, target, confidence, valid_from, valid_to, sources) of
    branch into after the merge. One triple's relations are one task's fold. A relation whose id the target has elsewhere
    gets a new one."""
    both = relations.where(F.col("branch").isin(frm, into)).withColumn("held", F.col("branch") == into).withColumn("branch", F.lit(into))
    keys = ["tenant", "source", "predicate", "target"]
    own = both.select(*_BY, "id", "seq", "source", "predicate", "target", F.col("confidence").cast("double").alias("confidence"), "valid_from", "valid_to", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "held")

    def settle(rows: list[dict]) -> list[dict]:
        held: list[dict] = []
        for r in rows:
            r.update(effect="held", sources=sorted(set(r["sources"])))
            if r["held"]:
                held.append(r)
            else:
                _related(held, r)
        return held

    kind, at = dict(own.dtypes), stamp(relations, "valid_from")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "string": pa.string()}
    fields = [(c, kind[c]) for c in own.columns if c != "held"] + [("effect", "string")]
    schema = pa.schema([(c, at if c.startswith("valid_") else arrow[t]) for c, t in fields])
    ordered = own.repartition(*keys).sortWithinPartitions(*keys, F.desc("held"), "seq", "id")
    state = written(folded(ordered, keys, schema, ", ".join(f"{c} {t}" for c, t in fields), settle), "relations")
    taken = relations.where(F.col("branch") == into).select("tenant", "id").distinct().withColumn("taken", F.lit(True))
    out = state.join(taken, ["tenant", "id"], "left")
    fresh = F.abs(F.xxhash64(F.lit(frm), "tenant", "id", "source", "predicate", "target"))
    return out.withColumn("id", F.when((F.col("effect") == "add") & F.col("taken"), fresh).otherwise(F.col("id"))).select(*state.columns)


def report(went: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of how many assertions and relations a merge added, and how many assertions it merged."""
    merged = F.col("effect") == "reinforce"
    a = went.agg(F.count_if(merged).alias("assertions_merged"), F.count_if(~merged).alias("assertions_added"))
    return a.join(relations.agg(F.count_if(F.col("effect") == "add").alias("relations_added")))


def live_values(assertions: DataFrame) -> DataFrame:
    """(tenant, branch, subject, key, object) of what a branch holds."""
    key, negative, _ = predicate_key(F.col("predicate"))
    return assertions.where(F.col("status").isin(*LIVE) & ~negative).select(*_BY, "subject", key.alias("key"), "object").distinct()
