"""Names that mean one thing: candidates from blocks, merges that a log keeps, vetoes, and merges taken back.

The log is all there is: (tenant, seq, kind, left_key, right_key, undoes) of kind merge, distinct (the two are not one, and
never will be in one cluster) or undo (of the merge of that seq). The state follows from it, so a merge that is taken back
leaves the state that the rest of the log gives. Merges are taken in the order of seq; one that would bring two distinct
keys, or keys with different numbers in them, together is vetoed and does nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import osa_at_most_one
from .belief import folded
from .graph import components
from .lineage import written

LOG = "tenant string, seq long, kind string, left_key string, right_key string, undoes long"


def key(name: Column) -> Column:
    """A name's letters and digits in lower case, words parted by hyphens; null without any."""
    own = F.array_join(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), 0), "-")
    return F.when(own != "", own)


def candidates(names: DataFrame, least: int = 6) -> DataFrame:
    """(tenant, left_key, right_key, score) of keys (tenant, key) that may mean one thing: of the same words in any order
    (1.0), or one edit or swap apart (0.9; of `least` characters or more, numbers left out). In a block each key is paired
    with its first alone; a chain of such pairs joins the rest, so a large block gives as many pairs as it has keys."""
    keys = written(names.where("key is not null").select("tenant", "key").distinct(), "keys")

    def first(blocked: DataFrame) -> DataFrame:
        heads = blocked.groupBy("tenant", "block").agg(F.min("key").alias("left_key"))
        return blocked.join(heads, ["tenant", "block"]).where("key <> left_key").select("tenant", "left_key", F.col("key").alias("right_key"))

    same = first(keys.withColumn("block", F.array_join(F.array_sort(F.split("key", "-")), "-"))).withColumn("score", F.lit(1.0))
    k = F.col("key")
    gone = F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(k, 1, i - 1), F.substr(k, i + 1)))
    long = keys.where((F.length("key") >= least) & ~F.col("key").rlike(r"\p{N}"))
    # Two keys an edit apart share one of their one-letter deletions, or one is a deletion of the other.
    near = first(long.select("tenant", "key", F.explode(F.array_distinct(F.concat(F.array(k), gone))).alias("block")))
    near = near.where(osa_at_most_one(F.col("left_key"), F.col("right_key"))).withColumn("score", F.lit(0.9))
    pairs = same.unionByName(near).select("tenant", F.least("left_key", "right_key").alias("left_key"), F.greatest("left_key", "right_key").alias("right_key"), "score")
    return pairs.groupBy("tenant", "left_key", "right_key").agg(F.max("score").alias("score"))


def _numbers(k: str) -> frozenset:
    return frozenset(w for w in k.split("-") if w.isdigit())


def _settled(rows: list[dict]) -> list[dict]:
    """One component's merges in order, each applied or vetoed, and the clusters of its keys."""
    top: dict[str, str] = {}
    members: dict[str, set[str]] = {}

    def find(k: str) -> str:
        members.setdefault(top.setdefault(k, k), {k})
        while top[k] != k:
            top[k] = k = top[top[k]]
        return k

    apart: dict[str, set[str]] = {}
    for r in rows:
        if r["kind"] == "distinct":
            apart.setdefault(r["left_key"], set()).add(r["right_key"])
            apart.setdefault(r["right_key"], set()).add(r["left_key"])
    out = []
    for r in rows:
        if r["kind"] != "merge":
            continue
        a, b = find(r["left_key"]), find(r["right_key"])
        if a != b:
            small, large = sorted((members[a], members[b]), key=len)
            numbers = {n for k in (*small, *large) if (n := _numbers(k))}
            if len(numbers) > 1 or any(apart.get(k, set()) & large for k in small):
                out.append({**r, "result": "vetoed"})
                continue
            a, b = min(a, b), max(a, b)
            top[b] = a
            members[a] = members[a] | members.pop(b)
        out.append({**r, "result": "applied"})
    for k in list(top):
        out.append({**rows[0], "seq": None, "kind": "key", "left_key": k, "right_key": find(k), "result": "member"})
    return out


def replayed(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, merges): the entity (tenant, key, entity) of each key that a merge names, the smallest key of its cluster, and
    what became of each merge (tenant, seq, result: applied, vetoed or undone). Components of the merges that stand are
    found first; the order of merges matters inside one alone, which is one task's fold. An undo of what isn't there, or
    is no merge, does nothing; undoing an undo is a new merge."""
    log = written(log.select("tenant", "seq", "kind", "left_key", "right_key", "undoes"), "log")
    undone = log.where("kind = 'undo'").select("tenant", F.col("undoes").alias("seq")).distinct()
    merges = log.where("kind = 'merge' and left_key is not null and right_key is not null")
    stand = merges.join(undone, ["tenant", "seq"], "left_anti")
    node = lambda c: F.concat("tenant", F.lit("\x1f"), F.col(c))
    own = components(stand.where("left_key <> right_key").select(node("left_key").alias("a"), node("right_key").alias("b")))
    own = written(own, "components")
    at = lambda c, name: own.select(F.col("node").alias(f"n_{name}"), F.col("root").alias(name))
    rows = stand.join(at("left_key", "root"), node("left_key") == F.col("n_root")).drop("n_root")
    held = log.where("kind = 'distinct'")
    held = held.join(at("left_key", "root"), node("left_key") == F.col("n_root")).join(at("right_key", "other"), node("right_key") == F.col("n_other")).where("root = other").drop("n_root", "n_other", "other")
    both = rows.unionByName(held).select("root", "tenant", "seq", "kind", "left_key", "right_key")
    schema = pa.schema([(c, pa.int64() if c == "seq" else pa.string()) for c in ("tenant", "seq", "kind", "left_key", "right_key", "result")])
    ordered = both.repartition("root").sortWithinPartitions("root", "seq", "left_key", "right_key")
    done = written(folded(ordered, ["root"], schema, "tenant string, seq long, kind string, left_key string, right_key string, result string", _settled), "replayed")
    alone = stand.where("left_key = right_key").select("tenant", "seq", F.lit("applied").alias("result"))
    results = done.where("kind = 'merge'").select("tenant", "seq", "result").unionByName(alone).unionByName(merges.join(undone, ["tenant", "seq"], "left_semi").select("tenant", "seq", F.lit("undone").alias("result")))
    return done.where("kind = 'key'").select("tenant", F.col("left_key").alias("key"), F.col("right_key").alias("entity")), results


def resolved(mentions: DataFrame, log: DataFrame) -> DataFrame:
    """mentions (tenant, name) with key and entity: a key that no standing merge names is an entity by itself; a name without
    letters and digits has neither."""
    keys, _ = replayed(log)
    own = mentions.withColumn("key", key(F.col("name")))
    return own.join(keys, ["tenant", "key"], "left").withColumn("entity", F.coalesce("entity", "key")).select(*mentions.columns, "key", "entity")


def entities(mentions: DataFrame) -> DataFrame:
    """(tenant, entity, aliases, mentions) of resolved() mentions: distinct keys are gathered, mentions are counted."""
    keys = mentions.where("entity is not null").groupBy("tenant", "entity", "key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("tenant", "entity").agg(F.array_sort(F.collect_list("key")).alias("aliases"), F.sum("n").alias("mentions"))
