"""Assertions in the order in which they arrive: reinforced, superseded, contested or rejected by what is already held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of one predicate, predicates with many values at a time, what negates one.
ALIASES = {
    "likes": "like", "prefers": "prefer", "owns": "own", "uses": "use", "speaks": "speak", "knows": "know", "live_in": "residence", "lives_in": "residence",
    "reside_in": "residence", "resides_in": "residence", "works_at": "work_at", "employed_by": "work_at", "works_for": "work_for", "has_allergy": "allergic_to",
}
ADDITIVE = (
    "is_a has_pet has_family has_child has_sibling education milestone expense likes dislikes prefers owns has_hobby has_interest speaks speaks_language "
    "knows allergic_to has_allergy like dislike prefer own speak know use uses has_project has_server has_repository has_service has_app has_application "
    "depends_on hosts supports requires plan_to intend_to committed_to promised_to decided_to believes"
).split()
NEGATION = r"^(?:(?:do|does|did|am|is|are|was|were)_)?(?:not|never|no_longer)_"


def predicate_key(predicate: Column) -> tuple[Column, Column, Column]:
    """The attribute that a predicate names, whether it is denied, and whether it can have many values at a time."""
    plain = F.regexp_replace(F.lower(F.trim(predicate)), r"\s+", "_")
    negative, bare = plain.rlike(NEGATION), F.regexp_replace(plain, NEGATION, "")
    key = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in ALIASES.items() for x in p)), bare), bare)
    return key, negative, negative | key.isin(ADDITIVE)


def _overlap(a: dict, b: dict) -> bool:
    return all(x["valid_to"] is None or x["valid_to"] > y["valid_from"] for x, y in ((a, b), (b, a)))


def _same(a: dict, b: dict) -> bool:
    return a["negative"] == b["negative"] and a["object"] == b["object"] and _overlap(a, b)


def _conflict(a: dict, b: dict) -> bool:
    if not _overlap(a, b):
        return False
    if a["negative"] != b["negative"]:
        return a["object"] == b["object"]
    return a["object"] != b["object"] and not a["additive"]


LIVE = ("active", "contested")


def _arrive(held: dict, new: dict) -> None:
    """What `new` does to what its peers hold (by id), and to itself; sets its label and effect. A row that names the one it
    replaces is against that one alone; if that is no live peer it is refused, unless it is the row itself coming again."""
    live = [x for x in held.values() if x["status"] in LIVE]
    target, own = new["replaces"], held.get(new["id"])
    if target is not None and own is not None and own["status"] in LIVE and own["replaces"] == target:
        target = None
    if new["status"] not in LIVE:  # it takes no part, and stands for what had its id
        new.update(label="ADD", effect="keep")
        held[new["id"]] = new
        return
    if target is not None and not any(x["id"] == target for x in live):
        new.update(status="refused", label="REFUSED", effect="refuse")
        return
    same = [x for x in live if _same(x, new)]
    best = max(same, key=lambda x: x["confidence"]) if same else None
    against = [x for x in live if x not in same and (x["id"] == target if target is not None else not same and _conflict(x, new))]
    # The label looks at trust, then at the newest; the effect looks at the strongest, and may differ from the label.
    if same and (target is None or any(x["id"] == target for x in same)):
        new["label"] = "UPDATE" if new["confidence"] > best["confidence"] or set(new["sources"]) - set(best["sources"]) else "NOOP"
    elif not against:
        new["label"] = "ADD"
    else:
        stronger = new["tier"] < min(x["tier"] for x in against) or new["valid_from"] > max(x["valid_from"] for x in against)
        new["label"] = "SUPERSEDE" if stronger else "CONTEST"
    new["effect"] = "add"
    if against:
        new["contradicts"] = sorted(x["id"] for x in against)
        top = min(against, key=lambda x: (x["tier"], -x["valid_from"].timestamp()))
        if new["tier"] > top["tier"]:
            new.update(status="superseded", superseded_by=top["id"], effect="reject")
        elif new["tier"] < top["tier"] or new["valid_from"] > top["valid_from"]:
            for x in against:
                later = new["valid_from"] > x["valid_from"]
                x.update(status="superseded", superseded_by=best["id"] if best else new["id"], valid_to=new["valid_from"] if later else x["valid_from"] + timedelta(microseconds=1))
            new["effect"] = "supersede"
        elif new["valid_from"] == top["valid_from"]:
            top["status"] = "contested"
            new.update(status="contested", effect="contest")
        else:
            new.update(status="superseded", valid_to=top["valid_from"], effect="historical")
    if same and (target is None or new["status"] != "superseded"):
        best.update(confidence=max(best["confidence"], new["confidence"]), sources=sorted({*best["sources"], *new["sources"]}), tier=min(best["tier"], new["tier"]))
        new.update(status="merged", superseded_by=best["id"], effect="reinforce")
        return
    held[new["id"]] = new


RESULT = "id long, subject long, key string, object string, status string, label string, effect string, valid_from timestamp, valid_to timestamp, superseded_by long, confidence double, tier int, sources array<string>"
#: Columns that assertions can have besides: whose peers they are, and what they come with.
OWNERS = ("tenant", "branch", "user_id", "scope")
EXTRA = {"status": "string", "superseded_by": "long", "replaces": "long", "held": "boolean"}


def folded(rows: DataFrame, keys: list[str], schema: pa.Schema, fields: str, settle: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """What settle() makes of each group of sorted rows; groups follow one another in a task, and one is in memory."""
    names = schema.names

    def run(batches) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            done: list[dict] = []
            for row in batch.to_pylist():
                if group and any(row[k] != group[0][k] for k in keys):
                    done += settle(group)
                    group = []
                group.append(row)
            if done:
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in done], schema=schema)
        if group:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in settle(group)], schema=schema)

    return rows.mapInArrow(run, fields)


def stamp(df: DataFrame, column: str) -> pa.DataType:
    return pa.timestamp("us", tz=df.sparkSession.conf.get("spark.sql.session.timeZone")) if dict(df.dtypes)[column] == "timestamp" else pa.timestamp("us")


def upserted(assertions: DataFrame) -> DataFrame:
    """The state after all assertions (id, seq, subject, predicate, object, valid_from, valid_to, confidence, tier, sources),
    in the order of seq, with how each was labelled, what it did and whom it contradicts.

    Peers have one subject and attribute, and one tenant, branch, user_id and scope where there are such columns. Further
    columns that count: status (null or `candidate`: active; superseded and retracted rows take no part), superseded_by,
    replaces (the id that a row is to replace) and held (true: the row is part of the state before all others arrive, as it
    is). A row that repeated a held value is merged: the held one has the larger confidence, both sources and the better
    tier. A row stands for a held one of its id. Order matters within a group of peers, so each is one task's fold; its rows
    are held in memory."""
    key, negative, additive = predicate_key(F.col("predicate"))
    owners = [c for c in OWNERS if c in assertions.columns]
    extra = [F.col(c) if c in assertions.columns else F.lit(None).cast(t).alias(c) for c, t in EXTRA.items()]
    own = assertions.select("id", "seq", "subject", *owners, "predicate", key.alias("key"), negative.alias("negative"), additive.alias("additive"), "object", "valid_from", "valid_to", "confidence", "tier", "sources", *extra)
    own = own.withColumns({"held": F.coalesce("held", F.lit(False)), "status": F.when(F.col("status").isNull() | (F.col("status") == "candidate"), "active").otherwise(F.col("status"))})
    peers = [*owners, "subject", "key"]
    own = own.repartition(*peers).sortWithinPartitions(*peers, F.desc("held"), "seq", "id")

    def settle(rows: list[dict]) -> list[dict]:
        held: dict = {}
        out = []
        for row in rows:
            row.update(label=None, effect="held" if row["held"] else None, contradicts=[], sources=sorted(set(row["sources"] or [])))
            if row["held"]:
                held[row["id"]] = row
            else:
                _arrive(held, row)
                if held.get(row["id"]) is not row:
                    out.append(row)
        return out + list(held.values())

    kind = dict(assertions.dtypes)
    at = stamp(assertions, "valid_from")
    kinds = {"id": pa.int64(), "subject": pa.int64(), "valid_from": at, "valid_to": at, "superseded_by": pa.int64(), "confidence": pa.float64(), "tier": pa.int32(), "sources": pa.list_(pa.string()), "contradicts": pa.list_(pa.int64()), "seq": pa.int64(), "replaces": pa.int64()}
    fields = [*((c, kind[c]) for c in owners), *(f.split() for f in RESULT.replace(" timestamp", f" {kind['valid_from']}").split(", ")), ("predicate", "string"), ("seq", "long"), ("replaces", "long"), ("contradicts", "array<long>")]
    arrow = {**kinds, **{c: pa.int64() if kind[c] in ("bigint", "int") else pa.string() for c in owners}}
    return folded(own, peers, pa.schema([(n, arrow.get(n, pa.string())) for n, _ in fields]), ", ".join(f"{n} {t}" for n, t in fields), settle)
