"""Branch merges against a replay row by row, and justifications against their definition."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodefield.operators import belief, branches, justify

D = dt.datetime(2024, 1, 1)
A = "tenant string, branch string, id long, seq long, subject long, user_id string, predicate string, object string, valid_from timestamp, valid_to timestamp, confidence double, tier int, sources array<string>, status string, superseded_by long, replaces long"
FIELDS = [f.split()[0] for f in A.split(", ")]
KEYS = {"lives in": ("residence", False, False), "resides_in": ("residence", False, False), "likes": ("like", False, True), "does not like": ("like", True, True), "age": ("age", False, False)}


def day(n):
    return D + dt.timedelta(days=n)


def rows_of(rng, branch, ids, seq):
    out = []
    for i in ids:
        start = rng.randint(0, 20)
        out.append(dict(tenant=rng.choice("ab"), branch=branch, id=i, seq=seq + i, subject=rng.randint(1, 3), user_id=rng.choice(["u", None]), predicate=rng.choice(list(KEYS)), object=rng.choice(["x", "y", "z"]), valid_from=day(start), valid_to=rng.choice([None, None, day(start + rng.randint(1, 9))]), confidence=rng.randint(1, 9) / 10, tier=rng.randint(0, 2), sources=[f"s{rng.randint(0, 4)}"], status=rng.choice(["active"] * 6 + ["candidate", "contested", "superseded", "retracted"]), superseded_by=None, replaces=None))
    return out


def meet(a, b):
    return (a["valid_to"] is None or b["valid_from"] < a["valid_to"]) and (b["valid_to"] is None or a["valid_from"] < b["valid_to"])


class Store:
    """A store that takes one assertion after the other, over all rows of a branch."""

    def __init__(self, rows):
        self.rows = {(r["tenant"], r["id"]): dict(r, sources=sorted(set(r["sources"]))) for r in rows}

    def take(self, r):
        r = dict(r, sources=sorted(set(r["sources"])))
        if r["status"] == "candidate":
            r["status"] = "active"
        key, negative, additive = KEYS[r["predicate"]]
        peers = []
        if r["status"] in ("active", "contested"):
            peers = [p for p in self.rows.values() if (p["tenant"], p["subject"], p["user_id"]) == (r["tenant"], r["subject"], r["user_id"]) and KEYS[p["predicate"]][0] == key and p["status"] in ("active", "contested")]
        same = [p for p in peers if KEYS[p["predicate"]][1] == negative and p["object"] == r["object"] and meet(p, r)]
        if same:
            win = max(same, key=lambda p: p["confidence"])
            win["confidence"] = max(win["confidence"], r["confidence"])
            win["sources"] = sorted({*win["sources"], *r["sources"]})
            win["tier"] = min(win["tier"], r["tier"])
            return win["id"]
        foes = []
        for p in peers:
            if meet(p, r):
                pn = KEYS[p["predicate"]][1]
                if (pn != negative and p["object"] == r["object"]) or (pn == negative and p["object"] != r["object"] and not additive):
                    foes.append(p)
        if foes:
            cur = sorted(foes, key=lambda p: (p["tier"], -p["valid_from"].timestamp()))[0]
            if r["tier"] > cur["tier"]:
                r["status"], r["superseded_by"] = "superseded", cur["id"]
            elif r["tier"] < cur["tier"] or r["valid_from"] > cur["valid_from"]:
                for p in foes:
                    p["valid_to"] = r["valid_from"] if r["valid_from"] > p["valid_from"] else p["valid_from"] + dt.timedelta(microseconds=1)
                    p["status"], p["superseded_by"] = "superseded", r["id"]
            elif r["valid_from"] == cur["valid_from"]:
                cur["status"] = r["status"] = "contested"
            else:
                r["status"], r["valid_to"] = "superseded", cur["valid_from"]
        self.rows[r["tenant"], r["id"]] = r
        return r["id"]


def shown(rows):
    get = (lambda r, c: r[c]) if rows and isinstance(rows[0], dict) else (lambda r, c: getattr(r, c))
    return sorted((get(r, "tenant"), get(r, "id"), get(r, "object"), get(r, "status"), get(r, "superseded_by") or 0, str(get(r, "valid_from")), str(get(r, "valid_to")), get(r, "confidence"), get(r, "tier"), tuple(get(r, "sources"))) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_is_a_replay(spark, seed):
    rng = random.Random(seed)
    frame = lambda rows: spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], A)
    main = Store([])
    for r in rows_of(rng, "main", range(40), 0):
        main.take(r)
    settled = list(main.rows.values())
    got = belief.upserted(frame(rows_of(random.Random(seed), "main", range(40), 0))).where("status not in ('merged', 'refused')")
    assert shown(got.collect()) == shown(settled)
    scratch = Store([dict(r, branch="scratch") for r in settled])
    for r in rows_of(rng, "scratch", range(100, 130), 0):
        scratch.take(r)
    for r in rows_of(rng, "main", range(200, 230), 0):
        main.take(r)
    ours, theirs = list(main.rows.values()), sorted(scratch.rows.values(), key=lambda r: (r["seq"], r["id"]))
    start = frame([dict(r, branch="main") for r in ours] + [dict(r, branch="scratch") for r in theirs] + rows_of(rng, "other", range(5), 0))
    state, went = branches.merged_assertions(start, "scratch", "main")
    to = {}
    for r in theirs:
        to.setdefault(r["tenant"], {})[r["id"]] = main.take(dict(r, branch="main"))
    for r in theirs:
        dest = main.rows[r["tenant"], to[r["tenant"]][r["id"]]]
        dest["superseded_by"] = to[r["tenant"]].get(dest["superseded_by"], dest["superseded_by"])
    assert shown(state.collect()) == shown(list(main.rows.values()))
    assert {(r["tenant"], r["source_id"], r["id"]) for r in went.collect()} == {(t, a, b) for t, m in to.items() for a, b in m.items()}


def test_replacement(spark):
    row = lambda i, predicate, obj, at, replaces=None, tier=1: ("a", "main", i, i, 1, "u", predicate, obj, day(at), None, 0.5, tier, [f"s{i}"], "active", None, replaces)
    rows = [row(1, "likes", "tea", 0), row(2, "likes", "milk", 1), row(3, "likes", "rum", 2, replaces=1), row(4, "likes", "gin", 3, replaces=77), row(5, "likes", "milk", 4, replaces=3), row(6, "likes", "ale", 0, replaces=2)]
    got = {r["id"]: r for r in belief.upserted(spark.createDataFrame(rows, A)).collect()}
    assert got[1]["status"] == "superseded" and got[1]["superseded_by"] == 3 and got[3]["label"] == "SUPERSEDE" and got[3]["contradicts"] == [1]
    assert got[4]["status"] == "refused" and got[4]["label"] == "REFUSED"
    assert got[3]["status"] == "superseded" and got[3]["superseded_by"] == 2 and got[5]["status"] == "merged" and got[5]["superseded_by"] == 2  # 5 says what 2 holds
    assert got[6]["status"] == "superseded" and got[6]["effect"] == "historical" and got[2]["sources"] == ["s2", "s5"]


def test_relations(spark):
    rng = random.Random(7)
    schema = "tenant string, branch string, id long, seq long, source string, predicate string, target string, confidence double, valid_from timestamp, valid_to timestamp, sources array<string>"
    make = lambda branch, i: ("a", branch, i, i, rng.choice("pq"), "knows", "x", rng.randint(1, 9) / 10, day(s := rng.randint(0, 60)), rng.choice([None, *[day(s + rng.randint(0, 5))] * 9]), [f"s{i % 5}"])
    ours, theirs = [make("main", i) for i in range(25)], [make("scratch", i) for i in [*range(5), *range(50, 75)]]
    theirs.append(("a", "scratch", *ours[3][2:]))
    got = branches.merged_relations(spark.createDataFrame(ours + theirs, schema), "scratch", "main").collect()
    held = [list(r) for r in ours]
    for r in sorted(theirs, key=lambda r: (r[3], r[2])):
        r = list(r)
        over = lambda a, b: (a[9] is None or b[8] < a[9]) and (b[9] is None or a[8] < b[9])
        wide, part = list(r), []
        while True:
            hit = [h for h in held if h[4] == r[4] and not any(h is p for p in part) and ((h[2], h[8], h[9]) == (r[2], r[8], r[9]) or over(h, wide))]
            if not hit:
                break
            part += hit
            for h in hit:
                wide[8], wide[9] = min(wide[8], h[8]), None if wide[9] is None or h[9] is None else max(wide[9], h[9])
        if not part:
            held.append(r)
            continue
        win = min(part, key=lambda h: (h[8], h[2]))
        held = [h for h in held if not any(h is p for p in part)] + [win]
        win[7], win[10] = max(h[7] for h in [*part, r]), sorted({s for h in [*part, r] for s in h[10]})
        win[8], win[9] = min(h[8] for h in [*part, r]), None if any(h[9] is None for h in [*part, r]) else max(h[9] for h in [*part, r])
    show = lambda rows: sorted((r[4], str(r[8]), str(r[9]), r[7], tuple(r[10])) for r in rows)
    assert show([(r.tenant, r.branch, r.id, r.seq, r.source, r.predicate, r.target, r.confidence, r.valid_from, r.valid_to, r.sources) for r in got]) == show(held)
    assert len({r.id for r in got}) == len(got)


def test_evidence(spark):
    rows = [("a", "main", "c1", False), ("a", "scratch", "c1", False), ("a", "scratch", "c2", False), ("a", "scratch", "c3", True), ("b", "scratch", "c1", None), ("b", "scratch", None, False), ("b", None, "c9", False)]
    e = spark.createDataFrame(rows, "tenant string, branch string, cid string, erased boolean")
    got = branches.merged_evidence(e, "scratch", "main")
    assert got.count() == len(rows) + 2 and {(r[0], r[2]) for r in got.where("branch = 'main'").collect()} == {("a", "c1"), ("a", "c2"), ("b", "c1")}
    assert branches.discarded(e, "scratch").count() == 2 and branches.created(e, "scratch", "new").where("branch = 'new'").count() == 5
    with pytest.raises(ValueError):
        branches.discarded(e, "main")


def test_justifications(spark):
    """Labels, cascades and contraction of any shape of justifications, by their definition."""
    rng = random.Random(3)
    for _ in range(2):
        status = {(t, i): rng.choice(["active", "active", "contested", "superseded", "retracted"]) for t in "ab" for i in range(30)}
        just = [(t, 100 * n, rng.randint(0, 32), [rng.randint(0, 34) for _ in range(rng.randint(0, 4))] if rng.random() < 0.9 else None) for t in "ab" for n in range(40)]
        claims = spark.createDataFrame([(t, b, i, s if b == "main" else "retracted") for (t, i), s in status.items() for b in ("main", "other")], "tenant string, branch string, id long, status string")
        frame = spark.createDataFrame(just, "tenant string, justification_id long, assertion_id long, dependency_ids array<long>")

        def want(now):
            out = {}
            for (t, i), s in now.items():
                own = [d or [] for u, _, a, d in just if (u, a) == (t, i)]
                out[t, i] = "in" if s in ("active", "contested") and (not own or any(all(now.get((t, x)) != "retracted" for x in d) for d in own)) else "out"
            return out

        assert {(r["tenant"], r["id"]): r["label"] for r in justify.labels(claims, frame).collect()} == want(status)
        seen, todo = set(), [("a", 3), ("b", 4)]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += [(t, a) for t, _, a, d in just if t == at[0] and (t, a) in status and at[1] in (d or [])]
        after, report = justify.contracted(claims, frame, spark.createDataFrame([("a", 3), ("b", 4), ("a", 999)], "tenant string, id long"), "withdrawn")
        now = {k: "retracted" if k in seen else s for k, s in status.items()}
        assert {(r["tenant"], r["id"]): r["status"] for r in after.where("branch = 'main'").collect()} == now
        assert after.where("invalidated_reason is not null").count() == sum(status[k] != "retracted" for k in seen)
        assert {(r["tenant"], r["id"]): r["label"] for r in report.collect()} == {k: want(now)[k] for k in seen} | {("a", 999): "out"}


def test_revision(spark):
    row = lambda i, predicate, obj, at: ("a", "main", i, i, 1, "u", predicate, obj, day(at), None, 0.5, 1, [f"s{i}"], "active", None, None)
    claims = spark.createDataFrame([row(1, "lives in", "x", 0), row(2, "likes", "tea", 0)], A)
    new = spark.createDataFrame([(*row(3, "lives in", "y", 5), None, [1, 2]), (*row(4, "likes", "tea", 5), "derived", None)], A + ", rule string, dependency_ids array<long>")
    none = spark.createDataFrame([], "tenant string, justification_id long, assertion_id long, dependency_ids array<long>, rule string")
    state, made, against = justify.revised(claims, none, new)
    assert {r["id"]: r["status"] for r in state.collect()} == {1: "superseded", 2: "active", 3: "active"}
    assert {(r["assertion_id"], tuple(r["dependency_ids"]), r["rule"]) for r in made.collect()} == {(3, (1, 2), "SUPERSEDE"), (2, (), "derived")}
    assert [tuple(r) for r in against.collect()] == [("a", 1, 3)]
